"""Recording operators: analytic ground truth on synthetic input, brute force beside kernels, edge cases."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.functions import kernels, ranks, tails
from pulsegrid.operators import beats, calcium, groups, images, motion, pairs, pixels, selection, signals

FRAME = "recording_id string, frame_idx int, height int, width int, pixels array<double>, fps double"


def frames_of(spark, videos, fps=30.0):
    rows = [(name, k, f.shape[0], f.shape[1], f.astype(float).ravel().tolist(), fps) for name, v in videos.items() for k, f in enumerate(v)]
    return spark.createDataFrame(rows, FRAME).repartition(3)


def plate(n=200, size=44, rate=0.75, grain=None):
    """A square whose half-width swells with a squared cosine, ``rate`` times a second at 25 frames a second."""
    far = np.abs(np.mgrid[:size, :size] - (size - 1) / 2).max(0)
    widths = [7 + 4 * max(math.cos(2 * math.pi * rate * (k / 25 - 0.5)), 0) ** 2 for k in range(n)]
    base = 20 if grain is None else 20 + 12 * np.random.default_rng(grain).random((n, size, size))
    return list(base + 150.0 * (far[None] <= np.array(widths)[:, None, None]))


def test_beating(spark):
    videos = {"plate": plate(), "still": [np.full((18, 22), 77.0)] * 30, "short": plate(6)}
    packed, table, summary = beats.beating(frames_of(spark, videos, 25.0))
    s = {r.recording_id: r for r in summary.collect()}
    assert 5 <= s["plate"].n_beats <= 7 and abs(s["plate"].mean_bpm - 45) < 4 and s["plate"].reference_frame_index is not None
    assert s["still"].n_beats == 0 and s["still"].mean_bpm is None and s["still"].duration_s == 1.2
    assert s["short"].reference_frame_index == 0
    rows = table.where("recording_id = 'plate'").orderBy("beat_index").collect()
    for r in rows:
        assert r.contraction_start_time_s <= r.peak_time_s <= r.relaxation_end_time_s
        t = [x for x in (r.time_to_decay_10_s, r.time_to_decay_50_s, r.time_to_decay_90_s) if x is not None]
        assert t == sorted(t)
    assert rows[0].inter_beat_interval_s is None and rows[1].inter_beat_interval_s > 0
    assert {r.recording_id: r.n for r in packed.select("recording_id", F.size("values").alias("n")).collect()} == {"plate": 200, "still": 30, "short": 6}


def test_consecutive_and_modes(spark):
    f = frames_of(spark, {"plate": plate()}, 25.0)
    assert pixels.consecutive_signal(f).count() == 199
    with pytest.raises(ValueError):
        beats.motion_signal(f, beats.BeatParams(signal_mode="other"))
    assert beats.motion_signal(f, beats.BeatParams(reference_index=999))[1].first().reference_index == 199


def test_piv_beating(spark):
    videos = {"textured": plate(70, 64, grain=41), "flat": [np.zeros((64, 64))] * 12}
    _, _, summary = beats.beating(frames_of(spark, videos, 25.0), beats.BeatParams(signal_mode="piv", window=16, step=8))
    s = {r.recording_id: r for r in summary.collect()}
    assert not s["textured"].piv_low_texture_warning and s["flat"].piv_low_texture_warning
    assert s["flat"].piv_median_window_std == 0 and s["flat"].piv_n_low_texture_windows_masked == s["flat"].piv_n_windows_total == 49


def dots(size=180):
    """Soft dots of random place, width and brightness, which wrap around."""
    rng = np.random.default_rng(90)
    grid, out = np.arange(size), np.zeros((size, size))
    for cy, cx, width, high in zip(*rng.uniform(0, size, (2, 6000)), rng.uniform(0.7, 1.1, 6000), rng.uniform(-90, 90, 6000)):
        y, x = (np.exp(-(((grid - c + size / 2) % size - size / 2) ** 2) / (2 * width**2)) for c in (cy, cx))
        out += high * y[:, None] * x[None]
    return out


def shifted(image, dx, dy):
    fy, fx = np.fft.fftfreq(image.shape[0])[:, None], np.fft.fftfreq(image.shape[1])[None]
    return np.fft.ifft2(np.fft.fft2(image) * np.exp(-2j * np.pi * (fx * dx + fy * dy))).real


@pytest.mark.parametrize("dx,dy", [(1, 1), (-2.4, 0.6), (0.25, -1.75), (3.2, 2.1)])
def test_displacement(dx, dy):
    a = dots()
    x, y, u, v = motion.displacement(a, shifted(a, dx, dy), 32, 16)
    inner = (slice(1, -1), slice(1, -1))
    assert abs(u[inner].mean() - dx) < 0.15 and abs(v[inner].mean() - dy) < 0.15 and x[0, 0] == y[0, 0] == 16


def test_displacement_edges():
    with pytest.raises(ValueError):
        motion.displacement(np.zeros((8, 8)), np.zeros((8, 8)), 16)
    with pytest.raises(ValueError):
        motion.displacement(np.zeros((8, 8)), np.zeros((8, 9)), 4)
    assert (motion.displacement(np.zeros((8, 8)), np.zeros((8, 8)), 4)[2] == -2).all()
    assert motion.window_stds(np.zeros((4, 4)), 8, 4).size == 0


def test_texture_equals_kernel(spark):
    image = dots(20)
    got = {(r.row, r.col): r.std for r in motion.texture(frames_of(spark, {"a": [image]}), 8, 4).collect()}
    want = motion.window_stds(image, 8, 4)
    assert len(got) == want.size and all(abs(got[k] - want[k]) < 1e-9 for k in got)


def test_calcium(spark):
    values = [60 + 150 * math.exp(-((6 * ((k / 30) % 1.0)) ** 2)) for k in range(180)]
    packed, table, summary = calcium.calcium(frames_of(spark, {"a": [np.full((20, 20), v) for v in values]}))
    assert summary.first().n_transients > 0 and table.count() == summary.first().n_transients
    trace = spark.createDataFrame([("t", k, v, 30.0) for k, v in enumerate([10.0] * 10 + [100.0])], "recording_id string, idx int, raw double, fps double")
    got = calcium.df_f0(trace).orderBy("idx").collect()
    assert got[0].f0 == 10 and got[0].df_f0 == 0 and got[10].df_f0 == 9
    zero = calcium.df_f0(trace.withColumn("raw", F.lit(0.0))).first()
    assert zero.f0 == 1e-6


def test_events_hold_what_lies_between_peaks(spark):
    """All rows together are no longer than twice the signal; troughs are those of the whole signal; peaks of one recording are dealt out."""
    v = np.random.default_rng(3).normal(size=4000)
    at = [0, *signals.local_maxima(v).tolist(), 3999]
    packed = spark.createDataFrame([("a", 30.0, v.tolist(), at), ("none", 30.0, v.tolist(), [])], "recording_id string, fps double, values array<double>, peaks array<int>")
    rows = beats.events(packed, "values").orderBy("no").collect()
    assert [r.peak for r in rows] == at and sum(len(r["values"]) for r in rows) <= 2 * len(v)
    for r, q, n in zip(rows, [None, *at[:-1]], [*at[1:], 4000]):
        assert r.previous == q and r.before == (q or 0) + (int(v[q or 0 : r.peak].argmin()) if r.peak else 0) and r.after == r.peak + int(v[r.peak : n].argmin())
        assert r["values"] == v[r.start : n].tolist() and r.start == (q or 0)
    dealt = calcium.transient_table(packed, "values")
    assert dealt.select(F.spark_partition_id()).distinct().count() > 1


@pytest.mark.parametrize("tau", [0.1, 0.4, 1.3])
def test_decay_constant(tau):
    t = np.arange(60) / 30
    assert abs(calcium.decay_constant(t, 3 * np.exp(-t / tau) + 0.5, 2.5, 0.6) - tau) < 1e-4


def test_masked_intensity(spark):
    f = frames_of(spark, {"a": [np.arange(4.0).reshape(2, 2)]})
    assert pixels.intensity(f, F.array(*map(F.lit, (True, False, False, True)))).first().raw == 1.5
    with pytest.raises(Exception, match="differ"):
        pixels.intensity(f, F.array(F.lit(True))).collect()


def test_smoothing():
    rng = np.random.default_rng(1)
    t = np.arange(50.0)
    cubic = 1 + 2 * t - 0.3 * t**2 + 0.01 * t**3
    assert np.allclose(signals.smooth_values(cubic, 30, 0.3), cubic)
    for n in (3, 4, 5):
        v = rng.normal(size=n)
        assert signals.smooth_values(v, 30) is v
    v = rng.normal(size=40)
    w, hat = 9, signals.cubic_fit(9)
    want = np.array([np.polyval(np.polyfit(np.arange(k - 4, k + 5), v[k - 4 : k + 5], 3), k) for k in range(4, 36)])
    assert np.allclose(signals.smooth_values(v, 30, 0.3)[4:-4], want) and np.allclose(hat @ hat, hat)


def brute_peaks(v, fps, per_minute, share):
    peaks, k = [], 1
    while k < len(v) - 1:
        end = k
        while end < len(v) - 1 and v[end + 1] == v[k]:
            end += 1
        if v[k - 1] < v[k] and end < len(v) - 1 and v[end + 1] < v[k]:
            peaks.append((k + end) // 2)
        k = end + 1
    distance, kept = max(int(round(60 / per_minute * fps)), 1), []
    for p in sorted(peaks, key=lambda p: (v[p], p), reverse=True):
        if all(abs(p - q) >= distance for q in kept):
            kept.append(p)

    def prominence(p):
        lo, hi = p, p
        while lo > 0 and v[lo - 1] <= v[p]:
            lo -= 1
        while hi < len(v) - 1 and v[hi + 1] <= v[p]:
            hi += 1
        return v[p] - max(min(v[lo : p + 1]), min(v[p : hi + 1]))

    return sorted(p for p in kept if prominence(p) >= max((max(v) - min(v)) * share, 1e-9))


def test_peaks_against_brute_force():
    rng = random.Random(0)
    for _ in range(200):
        v = [float(rng.randrange(12)) for _ in range(rng.randrange(3, 80))]
        assert signals.find_peaks(np.array(v), 30, 300, 0.15).tolist() == brute_peaks(v, 30, 300, 0.15)
    assert 18 <= len(signals.find_peaks(np.sin(2 * np.pi * 2 * np.arange(300) / 30), 30)) <= 20
    assert len(signals.find_peaks(np.array([1.0, 2.0]), 30)) == 0


def test_long_and_packed_peaks_agree(spark):
    rng = random.Random(3)
    rows = [(r, k, float(rng.randrange(9)), 30.0) for r in "ab" for k in range(120)]
    long = spark.createDataFrame(rows, "recording_id string, idx int, raw double, fps double")
    for r in "ab":
        v = np.array([x[2] for x in rows if x[0] == r])
        peaks = signals.local_maxima(v)
        got = {x.idx: x.prominence for x in signals.peak_prominence(long).where(f"recording_id = '{r}'").collect()}
        assert sorted(got) == peaks.tolist() and np.allclose([got[p] for p in peaks], signals.prominences(v, peaks))


def test_period():
    t = np.arange(300) / 30
    assert abs(signals.dominant_period_s(np.sin(2 * np.pi * t), 30) - 1) < 0.05
    assert signals.dominant_period_s(np.ones(50), 30) == 1.0 and signals.dominant_period_s(np.arange(9.0), 30) == 1.0


def test_argmin(spark):
    from pulsegrid.functions.columns import argmin_between

    row = spark.range(1).select(F.array(*map(F.lit, [5, 4, 1, 3, 6, 0, 2])).alias("v"))
    got = row.select(argmin_between(F.col("v"), F.lit(0), F.lit(4)), argmin_between(F.col("v"), F.lit(-3), F.lit(99)), argmin_between(F.col("v"), F.lit(3), F.lit(3))).first()
    assert tuple(got) == (2, 5, 3)


@pytest.mark.parametrize("box,want", [((3, 2, 4, 6), (3, 2, 7, 8)), ((9, -3, 40, 7), (9, 0, 13, 4)), ((50, 60, 5, 5), (12, 10, 13, 11)), ((-20, 4, 6, 1), (0, 4, 1, 5)), ((0, 0, 99, 99), (0, 0, 13, 11))])
def test_crop(spark, box, want):
    """A box inside, over two edges, wholly outside on either side, and over all."""
    image = np.random.default_rng(6).normal(size=(11, 13))
    f = frames_of(spark, {"a": [image]})
    r = pixels.crop(f, *box).first()
    x0, y0, x1, y1 = want
    assert (r.height, r.width) == (y1 - y0, x1 - x0) and r.pixels == image[y0:y1, x0:x1].ravel().tolist()
    assert pixels.crop(f, 1, None, 2, 2) is f


def circle(size, *spots):
    y, x = np.mgrid[: size[0], : size[1]]
    return np.any([(y - a) ** 2 + (x - b) ** 2 <= r * r for a, b, r in spots], axis=0) * 200.0


def test_objects(spark):
    """Three discs of different sizes that touch in a row, one far off, and nothing at all."""
    row = circle((48, 100), (24, 16, 15), (24, 41, 12), (24, 61, 10))
    f = frames_of(spark, {"row": [row, row / 2], "far": [row, circle((48, 100), (24, 88, 7))], "none": [np.zeros((7, 9))]})
    objects, summary = images.morphology_2d(f, distance=6)
    s = {r.recording_id: r for r in summary.collect()}
    assert (s["row"].n_objects, s["far"].n_objects, s["none"].n_objects) == (3, 4, 0)
    assert s["none"].total_covered_area_px == 0 and s["none"].alignment_score is None
    assert {r.recording_id: r.n_objects for r in images.morphology_2d(f, separate=False)[1].collect()} == {"row": 1, "far": 2, "none": 0}
    centres = sorted(r["centroid-1"] for r in objects.where("recording_id = 'row'").collect())
    assert all(abs(a - b) < 3 for a, b in zip(centres, (16, 41, 61))) and s["row"].total_covered_area_px == (row > 0).sum()


def test_straight_objects_whatever_the_order(spark):
    """The axis of a T that lies along the columns is the same however its pixels come."""
    pixels_of = list(itertools.permutations([(0, 5), (0, 6), (0, 7), (1, 6)]))
    rows = [(k, 1, 9.0, float(r), float(c)) for k, order in enumerate(pixels_of) for r, c in order]
    flat = spark.createDataFrame(rows, "recording_id int, label int, p double, r double, c double").coalesce(1)
    assert {(r.orientation, r.area) for r in images._regions_2d(flat).collect()} == {(math.pi / 2, 4)}


def test_volume(spark):
    z, y, x = np.mgrid[:12, :40, :40]
    ball = (((z - 6) / 4) ** 2 + ((y - 20) / 5) ** 2 + ((x - 20) / 14) ** 2 <= 1) * 180.0
    objects, summary = images.morphology_3d(frames_of(spark, {"v": list(ball)}), texture=True)
    r, s = objects.first(), summary.first()
    assert s.n_objects == 1 and s.stack_shape_zyx == [12, 40, 40] and r.volume_voxels == int((ball > 0).sum()) and abs(r.axis_x) > 0.99


@pytest.mark.parametrize("degrees", [0, 45, 90])
def test_stripes(spark, degrees):
    y, x = np.mgrid[:200, :200]
    a = math.radians(degrees)
    image = np.rint(127 + 100 * np.sin(2 * np.pi * (x * math.cos(a) + y * math.sin(a)) / 10))
    r = images.texture_2d(spark.createDataFrame([("s", 200, 200, image.ravel().tolist())], "recording_id string, height int, width int, pixels array<double>")).first()
    off = (r.texture_mean_orientation_deg - (degrees - 90) + 90) % 180 - 90
    assert abs(off) < 2 and r.texture_alignment_score > 0.95


def test_kernels_against_brute_force():
    rng = np.random.default_rng(4)
    mask = rng.random((14, 15)) < 0.7
    zeros = np.argwhere(~mask)
    want = np.array([[((zeros - (i, j)) ** 2).sum(1).min() if mask[i, j] else 0 for j in range(15)] for i in range(14)])
    assert (kernels.distance_squared(mask) == want).all()
    ring = np.zeros((9, 9), bool)
    ring[2:7, 2:7] = True
    ring[3:6, 3:6] = False
    assert kernels.fill_holes(ring).sum() == 25 and kernels.drop_small(ring, 17).sum() == 0 and kernels.drop_small(ring, 16).sum() == 16
    diagonal = np.eye(4, dtype=bool)
    assert kernels.label_components(diagonal).max() == 1 and kernels.label_components(diagonal, corners=False).max() == 4
    image = rng.integers(0, 50, 400)
    cuts = [np.var(image) - sum((image[m]).size * np.var(image[m]) for m in (image <= v, image > v) if m.any()) / 400 for v in np.unique(image)[:-1]]
    assert kernels.otsu_threshold(image) == np.unique(image)[int(np.argmax(np.round(cuts, 9)))] and kernels.otsu_threshold(np.full(5, 7)) == 7


def test_nematic_equals_eigen(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(50, 3)) * (1, 2, 5)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    rows = spark.createDataFrame([("a", *map(float, r), 1.0) for r in v] + [("one", 1.0, 0.0, 0.0, 1.0)], "recording_id string, z double, y double, x double, weight double")
    got = {r.recording_id: r for r in pairs.nematic_alignment(rows).collect()}
    values, vectors = np.linalg.eigh((3 * v.T @ v - 50 * np.eye(3)) / 100)
    assert abs(got["a"].alignment_score_3d - values[-1]) < 1e-9 and abs(abs(np.dot(got["a"].mean_direction_zyx, vectors[:, -1])) - 1) < 1e-6


def test_colocalization(spark):
    rng = np.random.default_rng(0)
    a = circle((40, 40), (12, 12, 6)).ravel()
    b = circle((40, 40), (28, 28, 6)).ravel()
    rows = [(n, float(p), float(q)) for n, x, y in (("same", a, a), ("apart", a, b), ("flat", a, np.zeros(1600))) for p, q in zip(x, y)]
    got = {r.image_id: r for r in pairs.colocalization(spark.createDataFrame(rows, "image_id string, a double, b double")).collect()}
    assert abs(got["same"].manders_m1 - 1) < 1e-12 and abs(got["same"].pearson_r - 1) < 1e-9 and got["apart"].manders_m1 == 0 and got["flat"].manders_m2 is None
    one = spark.createDataFrame([("i", 1, 2, [1.0, 2.0])], "image_id string, height int, width int, pixels array<double>")
    with pytest.raises(Exception, match="shape"):
        pairs.colocalize(one, one.withColumn("width", F.lit(3))).collect()
    assert pairs.colocalize(one, one).first().n_pixels == 2


def test_agreement(spark):
    rng = np.random.default_rng(1)
    a = rng.normal(50, 10, 60)
    rows = [("same", x, x) for x in a] + [("shift", x, x + 5) for x in a] + [("noise", x, x + e) for x, e in zip(a, rng.normal(0, 2, 60))]
    got = {r.pair_id: r for r in pairs.agreement(spark.createDataFrame([(k, float(x), float(y)) for k, x, y in rows], "pair_id string, a double, b double")).collect()}
    assert abs(got["same"].icc_2_1 - 1) < 1e-9 and abs(got["shift"].bland_altman_bias + 5) < 1e-9 and got["shift"].icc_2_1 < 0.95
    n = got["noise"]
    assert n.pearson_p < 1e-20 and 0.9 < n.spearman_r <= 1 and abs(n.regression_slope - 1) < 0.1
    few = spark.createDataFrame([("x", 1.0, 2.0), ("x", 2.0, 3.0)], "pair_id string, a double, b double")
    with pytest.raises(Exception, match="three pairs"):
        pairs.agreement(few).collect()
    messy = spark.createDataFrame([("1", "2"), ("x", "3"), (None, "4"), ("NaN", "1")], "p string, q string")
    assert [tuple(r) for r in pairs.complete_pairs(messy, "p", "q").collect()] == [(1.0, 2.0)]
    with pytest.raises(ValueError):
        pairs.complete_pairs(messy, "p", "z")


def metrics_of(spark, rows):
    return spark.createDataFrame(rows, "metric string, group_idx int, label string, recording_id string, cluster string, value double")


def test_two_groups(spark):
    rng = np.random.default_rng(0)
    rows = [(m, g, "AB"[g], f"{g}{k}", None, float(v)) for m, gap in (("far", 30), ("near", 0)) for g in (0, 1) for k, v in enumerate(rng.normal(60 + gap * g, 5, 12))]
    rows += [("constant", g, "AB"[g], f"{g}{k}", None, 1.0) for g in (0, 1) for k in range(3)] + [("partial", 0, "A", "00", None, 1.0)]
    got = groups.compare_groups(metrics_of(spark, rows), 2).collect()
    assert [r.metric for r in got] == ["far", "near", "constant"] and got[0].p_value < 0.05 < got[1].p_value and got[2].p_value is None and got[2].statistic is None
    assert [g.n for g in got[0].groups] == [12, 12] and got[0].lmm_pairwise is None


def test_exact_rank_test():
    from itertools import combinations

    for n1, n2 in ((3, 4), (5, 5), (2, 8)):
        us = [sum(c) - n1 * (n1 + 1) / 2 for c in combinations(range(1, n1 + n2 + 1), n1)]
        for u in range(n1 * n2 + 1):
            low = min(u, n1 * n2 - u)
            assert abs(tails.mann_whitney_exact(u, n1, n2) - min(1, 2 * sum(x <= low for x in us) / len(us))) < 1e-12


def test_mixed_model(spark):
    rng = np.random.default_rng(515)
    offsets = np.array([-6, -3, 0, 4, 5, -2, 1, 3, 6, 9.0])
    v = 20 + offsets[:, None] + rng.normal(0, 1.5, (10, 15))
    rows = [("m", int(c >= 5), "before after".split()[c >= 5], f"{c}-{k}", f"dish {c}", float(v[c, k])) for c in range(10) for k in range(15)]
    naive = groups.mann_whitney(metrics_of(spark, rows)).first().p_value
    pair = groups.lmm_pairwise(metrics_of(spark, rows)).first()
    assert naive < 0.01 and pair.p_value > 0.05 and pair.lmm_n_clusters == 10
    # balanced one-way: REML equals the moment estimators
    within = v.var(axis=1, ddof=1).mean()
    between = (v[:5].mean(1).var(ddof=1) + v[5:].mean(1).var(ddof=1)) / 2
    assert abs(pair.residual_variance - within) < 1e-4 and abs(pair.cluster_variance - (between - within / 15)) < 1e-3
    assert abs(pair.coefficient - (v[5:].mean() - v[:5].mean())) < 1e-6
    # residuals about the cluster's shrunken mean
    fixed = np.repeat([v[:5].mean(), v[5:].mean()], 5)
    shrunk = pair.cluster_variance * 15 / (pair.residual_variance + 15 * pair.cluster_variance) * (v.mean(1) - fixed)
    want = plain_shapiro((v - fixed[:, None] - shrunk[:, None]).ravel())
    assert abs(groups.residual_normality(metrics_of(spark, rows)).first().lmm_residual_shapiro_p - want) < 1e-6
    alone = [r[:4] + (r[3],) + r[5:] for r in rows]
    assert groups.lmm_pairwise(metrics_of(spark, alone)).count() == 0


def test_four_groups(spark):
    rng = np.random.default_rng(808)
    rows = [("m", g, "kale leek mint nori".split()[g], f"{g}{c}{k}", f"{g}-{c}", 30.0 + mean + shift + float(rng.normal(0, 2))) for g, mean in enumerate((0, 11, 10.5, 34)) for c, shift in enumerate((-0.8, 0.1, 0.7)) for k in range(8)]
    got = groups.compare_groups(metrics_of(spark, rows), 4, with_values=True).first()
    assert got.test == "kruskal_wallis" and len(got.posthoc) == 6 and len(got.lmm_pairwise) == 6 and got.p_value < 1e-6
    assert [len(g.values) for g in got.groups] == [24] * 4 and "values" not in groups.compare_groups(metrics_of(spark, rows), 4).schema["groups"].dataType.elementType.names
    contrast = {(p.group_a, p.group_b): p for p in got.lmm_pairwise}
    assert abs(contrast["kale", "leek"].coefficient - 11) < 2 and contrast["kale", "leek"].p_value < 1e-6 < contrast["leek", "mint"].p_value
    with pytest.raises(ValueError):
        groups.compare_groups(metrics_of(spark, rows), 1)


@pytest.mark.parametrize("in_range", [1_000_000, 50, 7])
def test_ranks_against_pandas(spark, in_range):
    import pandas as pd

    rng = random.Random(17)
    rows = [("big", float(rng.randrange(300))) for _ in range(900)] + [("same", 2.5)] * 40 + [("one", -1.0)] + [("wide", rng.gauss(0, 1e6)) for _ in range(200)]
    frame = pd.DataFrame(rows, columns=["g", "v"])
    frame["r"] = frame.groupby("g").v.rank()
    want = {(g, v): (t, r, len(frame[frame.g == g])) for (g, v, r), t in frame.groupby(["g", "v", "r"]).size().items()}
    got = ranks.ranked(spark.createDataFrame(rows, "g string, v double").repartition(4), "v", ("g",), in_range=in_range).collect()
    assert {(x.g, x.v): (x.t, x.r, x.total) for x in got} == want and len(got) == len(want)
    assert ranks.ranked(spark.createDataFrame([], "g string, v double"), "v", ("g",)).count() == 0


@pytest.mark.parametrize("wanted", [10, 1000])
def test_as_many_ranges_as_needed(spark, wanted):
    """One group's values are parted into ranges whose number follows from its size, none of them much larger than asked for."""
    n = 20_000
    counts = ranks.written(spark.range(n).select(F.lit("all").alias("g"), F.xxhash64("id").alias("v"), F.lit(1).alias("t")), "counts")
    sizes = [r["count"] for r in ranks.in_ranges(counts, "v", ("g",), n // wanted).groupBy("_range").count().collect()]
    assert sum(sizes) == n and 0.7 * wanted <= len(sizes) <= wanted and max(sizes) <= 6 * n / wanted


def plain_reml(y, group, cluster):
    """Group means, their covariance, residual variance and variance ratio from full matrices and a golden section."""
    names = sorted(set(group))
    X = np.array([[float(g == k) for k in names] for g in group])
    same = np.equal.outer(cluster, cluster).astype(float)

    def at(r):
        V = np.linalg.inv(np.eye(len(y)) + r * same)
        a = X.T @ V @ X
        beta = np.linalg.solve(a, X.T @ V @ y)
        rss = float((y - X @ beta) @ V @ (y - X @ beta))
        return (len(y) - len(names)) * math.log(rss) - np.linalg.slogdet(V)[1] + np.linalg.slogdet(a)[1], beta, a, rss

    scan = [0.0, *np.geomspace(1e-6, 1e6, 61)]
    k = min(range(len(scan)), key=lambda i: at(scan[i])[0])
    lo, hi = scan[max(k - 1, 0)], scan[min(k + 1, len(scan) - 1)]
    for _ in range(90):
        x, z = hi - (hi - lo) * 0.6180339887498949, lo + (hi - lo) * 0.6180339887498949
        lo, hi = (lo, z) if at(x)[0] <= at(z)[0] else (x, hi)
    r = min((0.0, (lo + hi) / 2), key=lambda v: at(v)[0])
    _, beta, a, rss = at(r)
    sigma2 = rss / (len(y) - len(names))
    return names, beta, sigma2 * np.linalg.inv(a), sigma2, r


def test_mixed_model_against_full_matrices(spark):
    """Unbalanced groups, clusters that groups share, clusters of many sizes, no variance between clusters, several metrics at once."""
    rng = np.random.default_rng(77)
    cases, rows = {}, []
    for name, spread, shared in (("apart", 3.0, False), ("shared", 1.5, True), ("none", 0.0, False), ("two", 2.0, True)):
        group, cluster, y = [], [], []
        for c in range(4 if name == "two" else 14):
            shift = spread * rng.normal()
            for k in range(int(rng.integers(2, 12))):
                g = (k if shared else c) % (2 if name == "two" else 3)
                group.append(g)
                cluster.append(c)
                y.append(50 + 4 * g + shift + rng.normal())
        cases[name] = plain_reml(np.array(y), group, np.array(cluster))
        rows += [(name, g, "abc"[g], f"{k}", f"c{c}", float(v)) for k, (g, c, v) in enumerate(zip(group, cluster, y))]
    frame = metrics_of(spark, rows).repartition(5)
    fits = groups.lmm_fit(frame)
    pairs_ = groups.lmm_pairwise(frame, fits).collect()
    for r in fits.collect():
        names, beta, cov, sigma2, ratio = cases[r.metric]
        assert list(r.groups) == names and np.abs(np.array(r.beta) - beta).max() < 1e-6 and abs(r.ratio - ratio) < 1e-6 * max(ratio, 1) and abs(r.sigma2 - sigma2) < 1e-6
        for p in (p for p in pairs_ if p.metric == r.metric):
            i, j = "abc".index(p.group_a), "abc".index(p.group_b)
            z = (beta[j] - beta[i]) / math.sqrt(cov[i, i] + cov[j, j] - 2 * cov[i, j])
            assert abs(p.coefficient - (beta[j] - beta[i])) < 1e-6 and abs(p.p_value - math.erfc(abs(z) / math.sqrt(2))) < 1e-6
    assert len(pairs_) == 3 + 3 + 3 + 1
    # nothing that the fit reads grows with the number of clusters of one size
    sizes = groups.by_cluster_size(groups.sufficient(frame.where("metric = 'apart'")))
    assert sizes.groupBy("size", "a", "b").count().where("count > 1").isEmpty()


def plain_shapiro(values):
    """Royston's p from the weights of all places."""
    from statistics import NormalDist

    x = np.sort(np.asarray(values, float))
    n = len(x)
    m = np.array([NormalDist().inv_cdf((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)])
    outer = lambda c, k: m[k] / math.sqrt(m @ m) + sum(v * n ** (-j / 2) for j, v in enumerate(c))
    if n == 3:
        a = np.array([-1, 0, 1]) / math.sqrt(2)
    else:
        ends = [outer(tails.OUTER, -1)] + [outer(tails.NEXT, -2)] * (n > 5)
        inner = m[len(ends) : n - len(ends)]
        a = m * math.sqrt((1 - 2 * sum(e * e for e in ends)) / (inner @ inner))
        for k, e in enumerate(ends):
            a[k], a[n - 1 - k] = -e, e
    return tails.shapiro_p(min(1.0, (a @ x) ** 2 / ((x - x.mean()) ** 2).sum()), n)


@pytest.mark.parametrize("at_once", [100_000, 7])
def test_normality_against_all_weights(spark, at_once):
    rng = np.random.default_rng(6)
    samples = {f"n{n}": rng.normal(3, 2, n) for n in (3, 4, 5, 6, 11, 12, 60, 6000)} | {"ties": rng.integers(0, 5, 80) * 1.0, "skew": np.exp(np.arange(20)), "flat": np.ones(9), "two": np.array([1.0, 2.0])}
    rows = spark.createDataFrame([(k, float(v)) for k, x in samples.items() for v in x], "g string, e double")
    sums = ranks.shapiro_sums(rows, "e", ("g",), at_once)
    fields = ("mm", "mx", "spread", "last_score", "next_score", "outer_gap", "inner_gap")
    got = {r.g: r.p for r in sums.select("g", tails.shapiro_p_value(F.col("n").cast("double"), *[F.coalesce(c, F.lit(0.0)) for c in fields]).alias("p")).collect()}
    for k, x in samples.items():
        assert (got[k] is None) if k in ("flat", "two") else abs(got[k] - plain_shapiro(x)) < 1e-9, k
    assert got["skew"] < 1e-4


def test_tails():
    assert abs(tails.chi_square_tail(9.4877, 4) - 0.05) < 1e-5 and abs(tails.chi_square_tail(3.8415, 1) - 0.05) < 1e-5
    assert abs(tails.student_two_sided(2.2281, 10) - 0.05) < 1e-5 and abs(tails.normal_two_sided(1.959964) - 0.05) < 1e-6
    assert abs(tails.chi_square_tail(50, 4) - math.exp(-25) * 26) < 1e-15


def test_unpivot_leaves_bookkeeping_out(spark):
    s = spark.createDataFrame([(0, "A", "r", None, 60.0, 10, True, 5.0), (0, "A", "q", None, None, 3, False, 6.0)], "group_idx int, label string, recording_id string, cluster string, mean_bpm double, n_beats int, flag boolean, duration_s double")
    assert sorted((r.recording_id, r.metric, r.value) for r in groups.unpivoted(s).collect()) == [("q", "n_beats", 3.0), ("r", "mean_bpm", 60.0), ("r", "n_beats", 10.0)]


def test_labels(spark):
    assert selection.parse_labels(" a,\n b\n", 2) == ["a", "b"] and selection.parse_labels(" ", 3) is None
    with pytest.raises(ValueError):
        selection.parse_labels("a", 2)
    assert selection.parse_groups({3: ("x", ["f"]), 5: (None, ["g"]), 7: ("y", [])}) == [(0, "x", "f"), (1, "Group 6", "g")]
    with pytest.raises(ValueError):
        selection.parse_groups({0: ("x", ["f"])})
    got = [r[0] for r in spark.createDataFrame([(" a,\n b\n",), ("\n , ",)], "t string").select(selection.label_list(F.col("t"))).collect()]
    assert got == [["a", "b"], None]
