"""The rows that figures are drawn from, on inputs small enough to say what they must be."""

import math

import numpy as np
from pyspark.sql import functions as F

from pulsegrid.functions import kernels
from pulsegrid.operators import beats, figures, images, pairs, signals


def test_traces_and_marks(spark):
    wave = [0.0, 1.0, 3.0, 1.0, 0.0, 1.0, 4.0, 2.0, 0.0]
    packed = spark.createDataFrame([("a", 10.0, wave, [2, 6])], "recording_id string, fps double, smoothed array<double>, peaks array<int>")
    rows = figures.traces(packed).orderBy("t").collect()
    assert [r.v for r in rows] == wave and [k for k, r in enumerate(rows) if r.is_peak] == [2, 6] and abs(rows[5].t - 0.5) < 1e-12
    got = sorted((r.kind, round(r.t, 6)) for r in figures.marks(beats.beat_table(packed, "smoothed")).collect())
    assert got == [("before", 0.0), ("before", 0.4), ("peak", 0.2), ("peak", 0.6)]
    assert signals.pack(figures.traces(packed).select("recording_id", F.lit(0).alias("idx"), "v", F.lit(1.0).alias("fps")), "v").count() == 1


def test_field(spark):
    assert figures.field(spark.createDataFrame([(3.0, 4.0)], "u double, v double")).first().magnitude == 5


def test_axes(spark):
    flat = spark.createDataFrame([("a", 1, 10.0, 20.0, math.pi / 2, 6.0)], ["recording_id", "label", "centroid-0", "centroid-1", "orientation", "major_axis_length"])
    assert [round(x, 9) for x in figures.axes(flat).first()[2:]] == [10, 17, 10, 23]
    deep = spark.createDataFrame([("a", 1, 5.0, 10.0, 20.0, 0.6, 0.8, 10.0)], ["recording_id", "label", "centroid-0", "centroid-1", "centroid-2", "axis_y", "axis_x", "equivalent_diameter_area"])
    assert [round(x, 9) for x in figures.axes_3d(deep).first()[2:]] == [7, 16, 13, 24]


def test_outlines(spark):
    grid = np.zeros((6, 8), int)
    grid[1:4, 1:3], grid[1:4, 3:6] = 1, 2
    want = np.zeros_like(grid, bool)
    for y in range(6):
        for x in range(8):
            near = [grid[a, b] for a, b in ((y - 1, x), (y + 1, x), (y, x - 1), (y, x + 1)) if 0 <= a < 6 and 0 <= b < 8]
            around = {v for v in grid[max(y - 1, 0) : y + 2, max(x - 1, 0) : x + 2].ravel() if v}
            want[y, x] = any(v != grid[y, x] for v in near) and (grid[y, x] == 0 or len(around) > 1)
    assert (kernels.outer_boundaries(grid) == want).all() and want.sum() == 22
    table = spark.createDataFrame([("a", 6, 8, grid.ravel().tolist())], "recording_id string, height int, width int, labels array<int>")
    assert {(r.y, r.x) for r in images.outlines(table).collect()} == set(map(tuple, np.argwhere(want)))


def test_orientation_map(spark):
    y, x = np.mgrid[:40, :40]
    stripes = 100 + 80 * np.sin(2 * np.pi * x / 8)
    rows = images.orientation_map(spark.createDataFrame([("a", 40, 40, stripes.ravel().tolist())], "recording_id string, height int, width int, pixels array<double>")).collect()
    assert len(rows) == 1600 and all(0 <= r.hue <= 1 and 0 <= r.value <= 1 for r in rows) and max(r.value for r in rows) > 0.99
    theta, _ = kernels.orientation_2d(stripes)
    assert all(abs(r.hue - (theta[r.y, r.x] + math.pi / 2) / math.pi) < 1e-9 for r in rows)


def test_agreement_lines(spark):
    rows = [("p", float(k), 2.0 * k + 1) for k in range(5)]
    agreed = pairs.agreement(spark.createDataFrame(rows, "pair_id string, a double, b double"), with_p=False)
    got = {r.kind: (round(r.slope, 9), round(r.intercept, 9)) for r in figures.agreement_lines(agreed).collect()}
    spread = 1.96 * np.std([-k - 1 for k in range(5)], ddof=1)
    assert got == {"identity": (1, 0), "regression": (2, 1), "bias": (0, -3), "lower_limit": (0, round(-3 - spread, 9)), "upper_limit": (0, round(-3 + spread, 9))}


def test_comparison(spark):
    rows = [(f"m{k}", None if k == 3 else 0.2 - 0.01 * k, [{"p_value_bonferroni": 0.01}, {"p_value_bonferroni": 0.2}][: k % 3]) for k in range(15)]
    compared = spark.createDataFrame(rows, "metric string, p_value double, posthoc array<struct<p_value_bonferroni double>>")
    got = figures.comparison(compared).collect()
    assert [r.metric for r in got] == [f"m{k}" for k in range(14, -1, -1) if k != 3][:12] and [r.n_significant for r in got[:3]] == [1, 1, 0]
    assert figures.comparison(compared.drop("posthoc"), 2).first().n_significant is None


def test_scatter_and_merge(spark):
    rows = spark.createDataFrame([("i", float(k), 5.0) for k in range(100)], "image_id string, a double, b double")
    some = figures.scatter(rows, 30)
    assert some.count() == 30 == some.distinct().count() and figures.scatter(rows).count() == 100
    # the same rows however they are dealt out, others with another seed; rows alike are told apart by a key
    picks = [sorted(map(tuple, figures.scatter(rows.repartition(n), 30, seed).collect())) for n, seed in ((1, 0), (7, 0), (3, 1))]
    assert picks[0] == picks[1] == sorted(map(tuple, some.collect())) != picks[2]
    flat = spark.range(1000).select("id", F.lit(1.0).alias("a"))
    assert figures.scatter(flat, 10, key=("id",)).distinct().count() == 10 and figures.scatter(flat.drop("id"), 10).count() == 10 and figures.scatter(flat.limit(0)).count() == 0
    scaled = figures.min_max(rows, "a", "b").agg(F.min("a"), F.max("a"), F.max("b")).first()
    assert tuple(scaled) == (0, 1, 0)
