"""Frame pairs and projections: the same however frames are dealt out, and only what must be is shuffled."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.operators import motion, neighbours, pixels

MEAN = lambda a, b: np.array([np.abs(b - a).mean()])


@pytest.fixture(scope="module")
def clips():
    rng = np.random.default_rng(1)
    return {name: rng.integers(0, 256, (n, 6, 7)).astype(float) for name, n in (("long", 40), ("short", 3), ("single", 1))}


def frame_rows(clips, left_out=()):
    return [(name, k, 6, 7, image.ravel().tolist(), 25.0) for name, clip in clips.items() for k, image in enumerate(clip) if (name, k) not in left_out]


SCHEMA = "recording_id string, frame_idx int, height int, width int, pixels array<double>, fps double"


@pytest.mark.parametrize("deal", ["files", "scattered", "bytes", "gaps"])
def test_pairs(spark, clips, deal):
    left_out = {("long", 0), ("long", 11), ("long", 12), ("short", 1)} if deal == "gaps" else set()
    rows = frame_rows(clips, left_out)
    frames = spark.createDataFrame(rows, SCHEMA)
    if deal == "bytes":
        frames = frames.withColumn("pixels", F.udf(lambda p: bytes(int(v) for v in p), "binary")("pixels"))
    if deal in ("scattered", "bytes"):
        frames = frames.repartition(5, F.xxhash64("recording_id", "frame_idx"))
    got = {(r.recording_id, r.pair_idx): r.m[0] for r in neighbours.with_next(frames, MEAN).collect()}
    there = {(name, k) for name, clip in clips.items() for k in range(len(clip))} - left_out
    assert set(got) == {(n, k) for n, k in there if (n, k + 1) in there}
    assert all(abs(v - np.abs(clips[n][k + 1] - clips[n][k]).mean()) < 1e-9 for (n, k), v in got.items())
    signal = pixels.consecutive_signal(frames).where("recording_id = 'long'")
    assert signal.count() == sum(n == "long" for n, _ in got) and signal.first().fps == 25.0


def test_only_ends_are_shuffled(spark, clips):
    """In files that hold frames in order two frames each are handed on, whatever a file's length; no plan shuffles all pixels."""
    many = {"long": np.concatenate([clips["long"]] * 5)}
    frames = spark.createDataFrame(frame_rows(many), SCHEMA).repartitionByRange(4, "frame_idx")
    found = neighbours.stretches(frames, MEAN)
    edges = found.where("edge is not null")
    assert edges.count() == 2 * 4 and edges.agg(F.sum(F.size("pixels"))).first()[0] == 8 * 42 and found.where("edge is null").count() == 200 - 4
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan
    # the pairs of PIV meet alike
    whole = motion.piv(frames, 4, 2).count()
    assert whole == 199 * 2 * 2
    # where each stretch is a frame, all frames meet
    lone = neighbours.stretches(frames.where("frame_idx % 2 = 0"), MEAN)
    assert lone.where("edge is not null").count() == 200


def test_projection_rows(spark, clips):
    """One running array for each task and recording, merged as they come; sizes that differ are an error."""
    frames = spark.createDataFrame(frame_rows(clips), SCHEMA).repartition(6)
    got = {r.recording_id: r for r in pixels.projected(frames).collect()}
    assert {n: r.pixels for n, r in got.items()} == {n: c.max(0).ravel().tolist() for n, c in clips.items()} and got["long"].height == 6
    partial = frames.select("recording_id", "height", "width", "pixels").mapInPandas(pixels._maxima, "recording_id string, height int, width int, pixels array<double>")
    tasks = frames.select("recording_id", F.spark_partition_id().alias("t")).distinct().count()
    assert partial.count() == tasks
    # held arrays are given away early where there are many recordings
    small = frames.mapInPandas(lambda b: pixels._maxima(b, limit=100), "recording_id string, height int, width int, pixels array<double>")
    assert small.groupBy("recording_id").count().count() == 3
    with pytest.raises(Exception, match="differ in size"):
        pixels.projected(frames.withColumn("height", F.when(F.col("frame_idx") == 2, 7).otherwise(6)).withColumn("width", F.when(F.col("frame_idx") == 2, 6).otherwise(7))).collect()
    assert pixels.max_projection(frames.limit(0)).count() == 0
