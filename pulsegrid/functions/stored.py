"""Tables written on the way, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session, or what setCheckpointDir was given.

    Only on a local master, where there is one disk, a temporary one is set if
    neither is; on a cluster that is an error.
    """
    named, context = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext
    current = named or context.getCheckpointDir()
    if not current:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="pulsegrid-"))
        current = context.getCheckpointDir()
    return current.rstrip("/")


#: Folders that this process has written, for ``clear_written``.
_PATHS: list[str] = []


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used, for ``clear_written`` to delete."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _PATHS.append(path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read back: cuts lineage, survives lost executors.

    It stays there, as results are read later; see ``clear_written``.
    """
    path = fresh_path(df.sparkSession, name)
    # row groups of a quarter of the usual size: a task holds one while it writes
    df.write.option("compression", "zstd").option("parquet.block.size", 32 << 20).parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table._written_at = path
    return table


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def drop_written(*tables: DataFrame) -> None:
    """Deletes tables that ``written`` has returned: only such as nothing that is still to be computed reads."""
    for table in tables:
        _delete(table.sparkSession, table._written_at)
        _PATHS.remove(table._written_at)


def clear_written(spark: SparkSession) -> int:
    """Deletes all tables that ``written`` has made in this process, and says how many; call it once the results are stored elsewhere."""
    n = len(_PATHS)
    while _PATHS:
        _delete(spark, _PATHS.pop())
    return n
