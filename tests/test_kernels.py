"""Kernels and tails against slow, plain forms."""

import heapq
import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.functions import kernels, tails


def queue_flood(relief, markers, mask):
    """One voxel at a time, the lowest first, then the one that was reached first."""
    out, queue, turn = np.where(mask, markers, 0), [], itertools.count()
    for p in map(tuple, np.argwhere(out > 0)):
        heapq.heappush(queue, (relief[p], next(turn), p))
    while queue:
        _, _, p = heapq.heappop(queue)
        for axis, s in itertools.product(range(mask.ndim), (-1, 1)):
            q = tuple(c + s * (k == axis) for k, c in enumerate(p))
            if all(0 <= c < n for c, n in zip(q, mask.shape)) and mask[q] and not out[q]:
                out[q] = out[p]
                heapq.heappush(queue, (relief[q], next(turn), q))
    return out


@pytest.mark.parametrize("shape", [(1, 1), (7, 9), (23, 30), (5, 8, 9), (40,)])
def test_watershed_by_levels(shape):
    rng = np.random.default_rng(sum(shape))
    for case in range(12):
        relief = rng.permutation(math.prod(shape)).reshape(shape).astype(float)
        mask = rng.random(shape) < (0.9, 0.6, 1.0)[case % 3]
        markers = np.where(rng.random(shape) < 0.1, rng.integers(1, 6, shape), 0)
        assert (kernels.watershed(relief, markers, mask) == queue_flood(relief, markers, mask)).all()


def test_watershed_with_ties():
    """On one level labels spread at the same pace, and the first in order of rows wins where they meet."""
    markers = np.zeros((3, 7), int)
    markers[1, 0], markers[1, 6] = 2, 1
    got = kernels.watershed(np.zeros((3, 7)), markers, np.ones((3, 7), bool))
    assert (got[:, :3] == 2).all() and (got[:, 4:] == 1).all() and got[1, 3] == 2
    assert not kernels.watershed(np.zeros((2, 2)), np.zeros((2, 2), int), np.ones((2, 2), bool)).any()


@pytest.mark.parametrize("shape", [(17,), (13, 21), (6, 9, 11)])
def test_distances(shape):
    rng = np.random.default_rng(len(shape))
    for share in (0.3, 0.9, 0.99):
        mask = rng.random(shape) < share
        zeros, places = np.argwhere(~mask), np.argwhere(np.ones(shape, bool))
        if len(zeros):
            want = ((places[:, None] - zeros[None]) ** 2).sum(-1).min(1).reshape(shape)
            assert (kernels.distance_squared(mask) == want).all()
    assert (kernels.distance_squared(np.ones(shape, bool)) == sum(s * s for s in shape) + 1).all()


def test_seeds_against_all_pairs():
    rng = np.random.default_rng(0)
    height = np.round(rng.random((40, 50)), 1)
    mask = rng.random((40, 50)) < 0.8
    for least in (0, 1, 4):
        top = (height == kernels._neighbourhood_max(np.where(mask, height, -np.inf), max(least, 1))) & mask & (height > 0)
        at, kept = np.argwhere(top), []
        for p in at[np.argsort(-height[tuple(at.T)], kind="stable")]:
            if all(np.abs(p - q).max() > least for q in kept):
                kept.append(p)
        assert kernels.seeds(height, mask, least).tolist() == [p.tolist() for p in kept]


def test_large_image_is_segmented():
    """2048 x 2048 with some two thousand discs that touch in pairs: every one is found."""
    y, x = np.mgrid[:2048, :2048]
    pair = np.minimum(np.hypot(y % 64 - 32, x % 64 - 19), np.hypot(y % 64 - 32, x % 64 - 44)) <= 13
    labels = kernels.segment(pair * 100.0)
    assert labels.max() == 2 * 32 * 32 and (labels > 0).sum() == pair.sum()


def test_tails_as_columns(spark):
    zs = [0.0, -0.3, 0.6, 0.66, 1.0, 1.96, 3.3, 5.6, 5.7, -8.0, 12.5, 29.9, 37.5, 60.0]
    got = spark.createDataFrame([(z,) for z in [*zs, None, float("nan")]], "z double").select(tails.normal_p_value("z")).collect()
    assert all(abs(r[0] - tails.normal_two_sided(z)) <= 1e-12 * tails.normal_two_sided(z) for r, z in zip(got, zs) if abs(z) < 37) and [r[0] for r in got[-2:]] == [None, None] and got[len(zs) - 1][0] == 0

    rows = [(x, df) for df in (1, 2, 3, 4, 7, 30, 101) for x in (0.0, 0.01, 0.7, 2.0, 9.5, 60.0, 300.0)] + [(2500.0, 2400), (None, 3), (1.0, 0)]
    got = spark.createDataFrame(rows, "x double, df int").select(tails.chi_square_p("x", F.col("df"))).collect()
    for r, (x, df) in zip(got[:-2], rows):
        assert abs(r[0] - tails.chi_square_tail(x, df)) < 1e-12, (x, df)
    assert got[-2][0] is got[-1][0] is None

    rows = [(t, df) for df in (1, 2, 3, 10, 99, 10_000) for t in (0.0, -0.1, 1.0, 1.7, 1.8, 2.5, 9.0, 40.0)] + [(float("inf"), 5), (None, 5), (1.0, 0), (float("nan"), 4)]
    got = spark.createDataFrame(rows, "t double, df int").select(tails.student_p_value("t", "df")).collect()
    for r, (t, df) in zip(got[:-4], rows):
        assert abs(r[0] - tails.student_two_sided(t, df)) < (1e-12 if df < 1000 else 1e-11), (t, df)
    assert [r[0] for r in got[-4:]] == [0.0, None, None, None]
    # with very many degrees it is the normal tail
    many = spark.createDataFrame([(t, 10.0**9) for t in (0.5, 1.8, 3.0, 6.0)], "t double, df double").select("t", tails.student_p_value("t", "df").alias("p")).collect()
    assert all(abs(r.p / tails.normal_two_sided(r.t) - 1) < 1e-6 for r in many)

    rows = [(0.5, 30), (-0.99, 5), (1.0, 9), (0.2, 2), (None, 9), (0.0, 7)]
    frame = spark.createDataFrame(rows, "r double, n long").select(tails.correlation_p_value("r", "n").alias("p"))
    got = [r.p for r in frame.collect()]
    assert abs(got[0] - tails.correlation_p(0.5, 30)) < 1e-12 and abs(got[1] - tails.correlation_p(-0.99, 5)) < 1e-12 and got[2:] == [0.0, None, None, 1.0]
    assert "Python" not in frame._jdf.queryExecution().executedPlan().toString()
