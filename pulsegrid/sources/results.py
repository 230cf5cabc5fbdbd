"""The result store: rows and summary become visible together, or not at all.

A write puts its files into a folder of its own. Tasks write Parquet and CSV in
one pass and tell the driver the names of their files; a failed or repeated
attempt leaves files that nobody names. The last step gives one small file its
final name, which readers go by, so that they see the result before or after.
"""

from __future__ import annotations

import csv
import io
import json
import re
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from .containers import opened

#: What a result is made of, and where it stands in a version's folder.
KINDS = ("rows", "data_csv", "summary_json")


def _text(value) -> str:
    """A value for CSV; null is empty, and what is nested is JSON."""
    if value is None:
        return ""
    if isinstance(value, bool):
        return "true" if value else "false"
    return json.dumps(value, default=str) if isinstance(value, list | dict) else str(value)


@dataclass
class Written(WriterCommitMessage):
    """Files of one task, by kind."""

    files: dict[str, list[str]]


class ResultWriter(DataSourceArrowWriter):
    """Writes a task's rows as Parquet and CSV, or as lines of JSON, under ``folder``; the commit lists all tasks' files there."""

    def __init__(self, folder: str, kinds: tuple[str, ...], schema: StructType):
        from pyspark.sql.pandas.types import to_arrow_schema

        self.folder, self.kinds, self.schema = folder, kinds, to_arrow_schema(schema)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, inside = opened(self.folder)
        name, files = uuid.uuid4().hex, {}
        outs: dict[str, pa.NativeFile] = {}
        table = None
        try:
            for kind in self.kinds:
                files[kind] = [f"{kind}/{name}.{ {'rows': 'parquet', 'data_csv': 'csv', 'summary_json': 'json'}[kind]}"]
                system.create_dir(f"{inside}/{kind}", recursive=True)
                outs[kind] = system.open_output_stream(f"{inside}/{files[kind][0]}", compression=None)
            if "rows" in outs:
                table = pq.ParquetWriter(outs["rows"], self.schema, compression="zstd")
            if "data_csv" in outs:
                outs["data_csv"].write(self._csv([self.schema.names]))
            for batch in iterator:
                batch = batch.cast(self.schema)
                if table:
                    table.write_batch(batch)
                if "data_csv" in outs or "summary_json" in outs:
                    rows = batch.to_pylist()
                if "data_csv" in outs:
                    outs["data_csv"].write(self._csv([[_text(v) for v in row.values()] for row in rows]))
                if "summary_json" in outs:
                    outs["summary_json"].write("".join(json.dumps({k: v for k, v in row.items() if v is not None}, default=str) + "\n" for row in rows).encode())
        finally:
            if table:
                table.close()
            for out in outs.values():
                out.close()
        return Written(files)

    @staticmethod
    def _csv(rows: list[list[str]]) -> bytes:
        out = io.StringIO()
        csv.writer(out, lineterminator="\n").writerows(rows)
        return out.getvalue().encode()

    def commit(self, messages: list[Written | None]) -> None:
        system, inside = opened(self.folder)
        for kind in self.kinds:
            listed = sorted(f for m in messages if m for f in m.files[kind])
            with system.open_output_stream(f"{inside}/{kind}.list", compression=None) as out:
                out.write(json.dumps(listed).encode())

    def abort(self, messages: list[Written | None]) -> None:
        """The whole version goes; nothing has named it yet."""
        _removed(self.folder)


def _removed(folder: str) -> None:
    system, inside = opened(folder)
    if system.get_file_info(inside).type != fs.FileType.NotFound:
        system.delete_dir(inside)


class ResultSink(DataSource):
    """``df.write.format("results")``: options folder and kinds (comma-separated)."""

    @classmethod
    def name(cls) -> str:
        return "results"

    def writer(self, schema: StructType, overwrite: bool) -> ResultWriter:
        return ResultWriter(self.options["folder"], tuple(self.options["kinds"].split(",")), schema)


class ResultStore:
    """Results under one folder, by result_id: rows as Parquet and CSV, summaries as JSON.

    Each write is a version; the newest committed one is the result, and older
    ones stay readable until ``prune``. Two writers may meet: the later commit
    wins. ``mirror``, off unless given, is called with (result_id, kind, path)
    after each commit; its failures don't fail the write.
    """

    def __init__(self, spark: SparkSession, folder: str, mirror: Callable[[str, str, str], None] | None = None):
        self.spark, self.folder, self.mirror = spark, folder.rstrip("/"), mirror
        spark.dataSource.register(ResultSink)

    def write(self, result_id: str, rows: DataFrame, summary: DataFrame) -> None:
        path = self._path(result_id)
        version = uuid.uuid4().hex
        folder = f"{path}/{version}"
        try:
            for df, kinds in ((rows, "rows,data_csv"), (summary, "summary_json")):
                df.write.format("results").mode("append").option("folder", folder).option("kinds", kinds).save()
            system, inside = opened(folder)
            with system.open_output_stream(f"{inside}/schema.json", compression=None) as out:
                out.write(json.dumps({"rows": rows.schema.jsonValue(), "summary_json": summary.schema.jsonValue()}).encode())
        except BaseException:
            _removed(folder)
            raise
        self._commit(path, version)
        for kind in KINDS if self.mirror else ():
            try:
                self.mirror(result_id, kind, f"{folder}/{kind}")
            except Exception:
                continue  # best effort

    def _commit(self, path: str, version: str) -> None:
        system, inside = opened(path)
        number = max((n for n, _ in self._commits(path)), default=0) + 1
        aside = f"{inside}/{version}/commit"
        with system.open_output_stream(aside, compression=None) as out:
            out.write(version.encode())
        # the version makes the name its own: two commits of one number both stand, and one of them is the newest
        system.move(aside, f"{inside}/commit-{number:012d}-{version}")

    def _commits(self, path: str) -> list[tuple[int, str]]:
        system, inside = opened(path)
        found = system.get_file_info(fs.FileSelector(inside, allow_not_found=True))
        return sorted((int(m[1]), m[2]) for f in found if (m := re.fullmatch(r"commit-(\d+)-(\w+)", f.base_name)))

    def _current(self, result_id: str, kind: str) -> tuple[StructType, list[str]]:
        path = self._path(result_id)
        commits = self._commits(path)
        if not commits:
            raise FileNotFoundError(f"no result {result_id!r}")
        folder = f"{path}/{commits[-1][1]}"
        system, inside = opened(folder)
        read = lambda name: json.loads(system.open_input_stream(f"{inside}/{name}", compression=None).read())
        return StructType.fromJson(read("schema.json")[kind if kind == "summary_json" else "rows"]), [f"{folder}/{f}" for f in read(f"{kind}.list")]

    def rows(self, result_id: str) -> DataFrame:
        schema, files = self._current(result_id, "rows")
        return self.spark.read.schema(schema).parquet(*files) if files else self.spark.createDataFrame([], schema)

    def csv_files(self, result_id: str) -> list[str]:
        return self._current(result_id, "data_csv")[1]

    def summary(self, result_id: str) -> DataFrame:
        schema, files = self._current(result_id, "summary_json")
        return self.spark.read.schema(schema).json(files) if files else self.spark.createDataFrame([], schema)

    def prune(self, result_id: str) -> int:
        """Deletes all versions but the newest committed one, and says how many; call it when no one writes or reads older ones."""
        path = self._path(result_id)
        system, inside = opened(path)
        commits = self._commits(path)
        last = commits[-1][1] if commits else None
        for number, version in commits[:-1]:
            system.delete_file(f"{inside}/commit-{number:012d}-{version}")
        old = [f for f in system.get_file_info(fs.FileSelector(inside, allow_not_found=True)) if f.type == fs.FileType.Directory and f.base_name != last]
        for f in old:
            system.delete_dir(f.path)
        return len(old)

    def _path(self, result_id: str) -> str:
        if not result_id or "/" in result_id or ".." in result_id:
            raise ValueError(f"no result id: {result_id!r}")
        return f"{self.folder}/result_id={result_id}"
