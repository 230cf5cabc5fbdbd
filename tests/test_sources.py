"""Sources, the result store, the front door and the stream."""

import datetime
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.operators import pixels
from pulsegrid.plans import analyses
from pulsegrid.sources import recordings
from pulsegrid.streaming import hourly


def decode(path):
    """A decoder for the tests: the frame rate, then frames of a raw 4 x 5 file."""
    yield 5000
    for frame in np.fromfile(path, np.uint8).reshape(-1, 4, 5):
        yield frame


def raw_file(tmp_path, n=7):
    data = np.random.default_rng(0).integers(0, 255, (n, 4, 5), dtype=np.uint8)
    path = tmp_path / "a.raw"
    path.write_bytes(data.tobytes())
    return str(path), data


def test_raw_frames(spark, tmp_path):
    path, data = raw_file(tmp_path)
    rows = recordings.read_raw(spark, path, 4, 5, most_frames=5).orderBy("frame_idx").collect()
    assert [bytes(r.pixels) for r in rows] == [f.tobytes() for f in data[:5]]
    with pytest.raises(ValueError, match="over 10 bytes"):
        recordings.read_raw(spark, path, 4, 5, most_bytes=10)
    got = pixels.intensity(pixels.with_fps(pixels.decoded(recordings.read_raw(spark, path, 4, 5)), override=0)).orderBy("idx").first()
    assert abs(got.raw - data[0].mean()) < 1e-9 and got.fps == 30


def test_decoder_source(spark, tmp_path):
    path, data = raw_file(tmp_path)
    spark.dataSource.register(recordings.VideoSource)
    reader = recordings._VideoReader({"path": path, "decoder": f"{__name__}:decode", "most_frames": "3"})
    rows = [row for part in reader.partitions() for row in reader.read(part)]
    assert [r[1] for r in rows] == [0, 1, 2] and rows[0][5] == 30.0 and rows[2][4] == data[2].tobytes()


def test_png(spark, tmp_path):
    path, data = raw_file(tmp_path)
    png = bytes(recordings.first_frames(recordings.read_raw(spark, path, 4, 5)).first().png)
    assert png[:8] == b"\x89PNG\r\n\x1a\n" and struct.unpack(">II", png[16:24]) == (5, 4)
    at = png.index(b"IDAT")
    size = struct.unpack(">I", png[at - 4 : at])[0]
    lines = np.frombuffer(zlib.decompress(png[at + 4 : at + 4 + size]), np.uint8).reshape(4, 6)
    assert (lines[:, 1:] == data[0]).all()


def test_trace(spark, tmp_path):
    (tmp_path / "t.tsv").write_text("\n".join(f"{k * 50 / 3:.3f}\t{k}" for k in range(20)))
    rows = recordings.read_trace(spark, str(tmp_path / "t.tsv")).orderBy("idx").collect()
    assert len(rows) == 20 and abs(rows[0].fps - 60) < 0.1 and rows[19].raw == 19


def test_front_door(spark, tmp_path):
    rng = np.random.default_rng(1)
    rows = [(f"r{r}", k, 6, 6, (100 + 20 * np.sin(k / 3 + r) + rng.normal(0, 3, 36)).tolist(), 30.0) for r in range(6) for k in range(60)]
    frames = spark.createDataFrame(rows, "recording_id string, frame_idx int, height int, width int, pixels array<double>, fps double")
    table = analyses.batch(frames, "calcium")
    assert table.columns[0] == "filename" and table.count() == 6
    sides = spark.createDataFrame([(f"r{r}", r // 3, "ab"[r // 3], None) for r in range(6)], "recording_id string, group_idx int, label string, cluster string")
    assert analyses.compare(frames, sides, "calcium").count() > 0
    assert analyses.colocalize(frames, frames).select(F.min("pearson_r")).first()[0] > 0.999
    with pytest.raises(ValueError):
        analyses.analyze(frames, "other")
    (tmp_path / "m.csv").write_text("p,q\n1,2\n2,3\n3,5\nx,1\n")
    pairs, stats = analyses.agreement_of_csv(spark, str(tmp_path / "m.csv"), "p", "q")
    assert pairs.count() == stats.first().n == 3


def test_stream_equals_batch(spark, tmp_path):
    start = datetime.datetime(2024, 1, 1)
    rows = [("ab"[k % 2], start + datetime.timedelta(minutes=17 * k), float(k)) for k in range(60)]
    table = spark.createDataFrame(rows, "event_type string, ts timestamp, value double")
    table.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(table.schema).parquet(f"{tmp_path}/in")
    hourly.start(stream, f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination(120)
    got = {tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    want = {tuple(r) for r in hourly.hourly(table).collect()}
    assert got and got <= want and len(want - got) <= 8


def test_written_tables_are_cleared(spark):
    import os

    from pulsegrid.functions import stored

    stored.clear_written(spark)
    table = stored.written(spark.range(5), "five")
    assert table.count() == 5
    folder = stored._PATHS[-1].removeprefix("file:")
    assert os.path.isdir(folder) and stored.clear_written(spark) == 1 and not os.path.exists(folder)


def test_a_cluster_needs_a_shared_folder(monkeypatch):
    from types import SimpleNamespace

    from pulsegrid.functions import stored

    context = SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None)
    session = SimpleNamespace(conf=SimpleNamespace(get=lambda k, d: d), sparkContext=context)
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        stored.shared_folder(session)
    session.conf.get = lambda k, d: "hdfs://x/y/"
    assert stored.shared_folder(session) == "hdfs://x/y"
