"""The result store: what is written comes back, all at once, and a write that fails changes nothing."""

import csv
import os

import pytest
from pyspark.sql import functions as F

from pulsegrid.sources import results


def files_under(path):
    return sorted(os.path.join(d, f) for d, _, fs in os.walk(path) for f in fs)


def test_store(spark, tmp_path):
    seen = []

    def mirror(*what):
        seen.append(what[:2])
        raise OSError("down")

    store = results.ResultStore(spark, str(tmp_path), mirror)
    rows = spark.createDataFrame([(k, [k / 2, None], "a,\"b\"\nc" if k else None, {"x": k}) for k in range(40)], "a int, l array<double>, t string, m struct<x int>").repartition(3)
    summary = spark.createDataFrame([("r", 3, None)], "recording_id string, n int, gone double")
    store.write("r1", rows, summary)
    assert sorted(store.rows("r1").collect()) == sorted(rows.collect()) and store.rows("r1").schema == rows.schema
    assert store.summary("r1").collect() == summary.collect() and seen == [("r1", k) for k in results.KINDS]
    lines = [line for f in store.csv_files("r1") for line in list(csv.reader(open(f, newline="")))[1:]]
    assert len(lines) == 40 and ["7", "[3.5, null]", "a,\"b\"\nc", '{"x": 7}'] in lines and ["0", "[0.0, null]", "", '{"x": 0}'] in lines
    for bad in ("", "a/b", "..", "x..y"):
        with pytest.raises(ValueError):
            store.rows(bad)
    with pytest.raises(FileNotFoundError):
        store.rows("other")


def test_versions(spark, tmp_path):
    """A later write replaces rows and summary together, also by fewer rows and other columns, or none; old versions go when asked."""
    store = results.ResultStore(spark, str(tmp_path))
    store.write("r", spark.range(100), spark.range(2))
    store.write("r", spark.range(5).select(F.col("id").cast("string").alias("name")), spark.range(1))
    assert sorted(r.name for r in store.rows("r").collect()) == list("01234") and store.summary("r").count() == 1
    store.write("r", spark.range(0), spark.range(0))
    assert store.rows("r").count() == 0 == store.summary("r").count() and store.rows("r").columns == ["id"]
    assert store.prune("r") == 2 and store.rows("r").count() == 0 and store.prune("r") == 0


@pytest.mark.parametrize("broken", ["rows", "summary"])
def test_a_failing_task_changes_nothing(spark, tmp_path, broken):
    store = results.ResultStore(spark, str(tmp_path))
    store.write("r", spark.range(10), spark.range(1).withColumnRenamed("id", "n"))
    before = files_under(tmp_path)
    bad = spark.range(0, 40, 1, 4).select(F.when(F.col("id") == 33, F.raise_error(F.lit("broken task")).cast("long")).otherwise(F.col("id")).alias("id"))
    with pytest.raises(Exception, match="broken task"):
        store.write("r", *((bad, spark.range(1)) if broken == "rows" else (spark.range(3), bad)))
    assert files_under(tmp_path) == before and store.rows("r").count() == 10 and store.summary("r").columns == ["n"]


def test_a_write_that_stops_before_its_commit_isn_t_seen(spark, tmp_path, monkeypatch):
    """What a driver that is lost leaves behind is in no result, and goes with prune."""
    store = results.ResultStore(spark, str(tmp_path))
    store.write("r", spark.range(10), spark.range(1))
    monkeypatch.setattr(results.ResultStore, "_commit", lambda *_: (_ for _ in ()).throw(KeyboardInterrupt()))
    with pytest.raises(KeyboardInterrupt):
        store.write("r", spark.range(3), spark.range(1))
    assert store.rows("r").count() == 10 and store.prune("r") == 1 and store.rows("r").count() == 10


def test_files_of_lost_attempts_aren_t_listed(spark, tmp_path):
    """A second attempt of a task writes files of its own; only those that the driver is told of count."""
    from pyspark.sql.types import StructType

    writer = results.ResultWriter(str(tmp_path), ("rows",), StructType.fromDDL("id long"))
    batches = [spark.range(4).toArrow().to_batches()[0]]
    writer.write(iter(batches))
    told = writer.write(iter(batches))
    writer.commit([told, None])
    assert len(files_under(tmp_path / "rows")) == 2 and (tmp_path / "rows.list").read_text().count("parquet") == 1
