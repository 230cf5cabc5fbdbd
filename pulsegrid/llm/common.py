"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.stored import drop_written, shared_folder, written  # noqa: F401


#: A key is hot if more than one row in so many has it; so there are fewer hot keys than that, whatever the data.
HOT = 10_000


def join_by_size(rows: DataFrame, few: DataFrame, key: str | list[str], n: str = "n", total: int | None = None, hot: int = HOT) -> DataFrame:
    """``rows`` joined with ``few``, a written table with one row a key, that says in ``n`` how many rows have it.

    Rows of hot keys meet a broadcast of these, at most ``hot`` rows, where they
    stand; all others are shuffled, and no key of those is more than a
    ``hot``-th of all rows. ``total``: the sum of ``n``, where it is known.
    """
    total = few.agg(F.sum(n)).first()[0] or 0 if total is None else total
    heavy = F.col(n) * hot > total
    often = F.broadcast(few.where(heavy))
    rest = rows.join(F.broadcast(few.where(heavy).select(key)), key, "left_anti")
    return rows.join(often, key).unionByName(rest.join(few.where(~heavy), key))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_rows(df: DataFrame, fn: Callable[[Iterator[dict]], Iterator[dict]], schema: str) -> DataFrame:
    """Runs ``fn`` over the columns of each Arrow batch: takes and gives dicts of lists, a batch at a time.

    ``fn`` is called once a partition with an iterator of ``{column: list}``
    and yields such dicts, whose columns follow ``schema``.
    """
    arrow_schema = None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in fn({n: c.to_pylist() for n, c in zip(b.schema.names, b.columns)} for b in batches):
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in arrow_schema], schema=arrow_schema)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow_schema = to_arrow_schema(_parse_datatype_string(schema))
    return df.mapInArrow(run, schema)


def text_bytes(column: str = "text"):
    """The text as UTF-8 bytes, null as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")
