"""Displacement fields by windowed cross-correlation (PIV), and their texture checks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import image_of
from .neighbours import firsts, joined, stretches

#: Standard deviation under which a window has too little texture to be followed.
LEAST_TEXTURE = 3.0
#: Copies of a recording's grid, so that all its frames aren't one task when they are joined.
SALTS = 16


def grid(length: int, window: int, step: int) -> np.ndarray:
    return np.arange(0, length - window + 1, step)


def windows_of(image: np.ndarray, window: int, step: int) -> np.ndarray:
    view = np.lib.stride_tricks.sliding_window_view(image, (window, window))
    return view[np.ix_(grid(image.shape[0], window, step), grid(image.shape[1], window, step))]


def window_stds(image: np.ndarray, window: int, step: int) -> np.ndarray:
    """Population standard deviation of each window; an empty grid where none fits."""
    return windows_of(image, window, step).std(axis=(2, 3)) if min(image.shape) >= window else np.zeros((0, 0))


def _subpixel(before: np.ndarray, at: np.ndarray, after: np.ndarray, inner: np.ndarray) -> np.ndarray:
    """Offset of the top of a Gaussian through three samples; 0 at the border or where it has none."""
    good = inner & (before > 0) & (at > 0) & (after > 0)
    a, b, c = (np.log(np.where(good, x, 1.0)) for x in (before, at, after))
    bend = a - 2 * b + c
    good &= np.abs(bend) > 1e-12
    return np.where(good, 0.5 * (a - c) / np.where(good, bend, 1.0), 0.0)


def displacement(a: np.ndarray, b: np.ndarray, window: int = 32, step: int | None = None) -> tuple[np.ndarray, ...]:
    """Grids x, y (window centres), u (right), v (down) between two frames, to sub-pixels."""
    step = step or window // 2
    if a.shape != b.shape:
        raise ValueError("the frames differ in shape")
    if window > min(a.shape):
        raise ValueError("the window is larger than the frame")
    wa, wb = (windows_of(f.astype(float), window, step) for f in (a, b))
    fa, fb = (np.fft.rfft2(w - w.mean(axis=(2, 3), keepdims=True)) for w in (wa, wb))
    found = np.fft.fftshift(np.fft.irfft2(fa.conj() * fb, s=(window, window)), axes=(2, 3))
    # what is zero but for rounding counts as zero, so that flat windows tie
    found[np.abs(found) < 1e-9] = 0
    rows, cols = found.shape[:2]
    flat = found.reshape(rows, cols, -1)
    top = flat.argmax(axis=2)
    py, px = top // window, top % window
    lifted = flat - flat.min(axis=2, keepdims=True) + 1e-6
    take = lambda y, x: np.take_along_axis(lifted, (np.clip(y, 0, window - 1) * window + np.clip(x, 0, window - 1))[..., None], 2)[..., 0]
    dy = _subpixel(take(py - 1, px), take(py, px), take(py + 1, px), (py > 0) & (py < window - 1))
    dx = _subpixel(take(py, px - 1), take(py, px), take(py, px + 1), (px > 0) & (px < window - 1))
    gy, gx = np.meshgrid(grid(a.shape[0], window, step) + window / 2, grid(a.shape[1], window, step) + window / 2, indexing="ij")
    return gx, gy, px - window // 2 + dx, py - window // 2 + dy


def usable_windows(frames: DataFrame, window: int, step: int) -> DataFrame:
    """recording_id, usable: for each window, row by row, whether it has texture in the recording's first frame."""

    @F.pandas_udf("array<boolean>")
    def textured(pixels: pd.Series, height: pd.Series, width: pd.Series) -> pd.Series:
        return pd.Series([(window_stds(image_of(*row), window, step) >= LEAST_TEXTURE).ravel() for row in zip(pixels, height, width)])

    first = frames.groupBy("recording_id").agg(F.min("frame_idx").alias("frame_idx"))
    return frames.join(first, ["recording_id", "frame_idx"]).select("recording_id", textured("pixels", "height", "width").alias("usable"))


def piv(frames: DataFrame, window: int = 32, step: int | None = None) -> DataFrame:
    """recording_id, pair_idx, fps, row, col, x, y, u, v, usable: one row for each window of each frame pair.

    A pair is a frame and the next number; pixels are numbers or uint8 bytes. It
    is followed where both frames stand, see ``neighbours``.
    usable: whether the window has texture in the recording's first frame.
    """
    step = step or window // 2
    measure = lambda a, b: np.stack(displacement(a, b, window, step)[2:]).ravel()
    found = stretches(frames, measure)
    pairs = joined(found, measure)
    half = F.floor(F.size("m") / 2).cast("int")
    both = F.arrays_zip(F.slice("m", F.lit(1), half).alias("u"), F.slice("m", half + 1, half).alias("v"), F.col("usable"))
    fields = pairs.select("recording_id", "pair_idx", "width", "fps", "m", F.pmod("pair_idx", F.lit(SALTS)).alias("_salt"))
    grids = usable_windows(firsts(found), window, step).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    cols = F.floor((F.col("width") - window) / step).cast("int") + 1
    rows = fields.join(grids, ["recording_id", "_salt"]).select("recording_id", "pair_idx", "fps", cols.alias("cols"), F.posexplode(both).alias("at", "w"))
    rows = rows.select("recording_id", "pair_idx", "fps", F.floor(F.col("at") / F.col("cols")).cast("int").alias("row"), (F.col("at") % F.col("cols")).cast("int").alias("col"), "w.*")
    place = lambda k: F.col(k) * F.lit(float(step)) + F.lit(window / 2)
    return rows.select("recording_id", "pair_idx", "fps", "row", "col", place("col").alias("x"), place("row").alias("y"), F.col(rows.columns[5]).alias("u"), F.col(rows.columns[6]).alias("v"), F.col(rows.columns[7]).alias("usable"))


def motion_signal(frames: DataFrame, window: int = 32, step: int | None = None) -> DataFrame:
    """recording_id, idx, raw, fps: mean displacement over the usable windows of each pair, over all where none is usable."""
    size = F.sqrt(F.col("u") * F.col("u") + F.col("v") * F.col("v"))
    mean = F.coalesce(F.avg(F.when(F.col("usable"), size)), F.avg(size))
    return piv(frames, window, step).groupBy("recording_id", F.col("pair_idx").alias("idx")).agg(mean.alias("raw"), F.max("fps").alias("fps"))


def texture(frames: DataFrame, window: int, step: int | None = None) -> DataFrame:
    """recording_id, frame_idx, row, col, std of each window, all in array expressions."""
    step = step or window // 2
    tops = frames.where((F.col("height") >= window) & (F.col("width") >= window)).withColumn("y0", F.explode(F.sequence(F.lit(0), F.col("height") - window, F.lit(step))))
    boxes = tops.withColumn("x0", F.explode(F.sequence(F.lit(0), F.col("width") - window, F.lit(step))))
    inside = F.flatten(F.transform(F.sequence("y0", F.col("y0") + window - 1), lambda r: F.slice(F.col("pixels"), r * F.col("width") + F.col("x0") + 1, window)))
    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v) / F.size(a)
    cut = boxes.select("recording_id", "frame_idx", (F.col("y0") / step).cast("int").alias("row"), (F.col("x0") / step).cast("int").alias("col"), inside.alias("w")).withColumn("m", mean(F.col("w")))
    return cut.select("recording_id", "frame_idx", "row", "col", F.sqrt(mean(F.transform("w", lambda v: (v - F.col("m")) * (v - F.col("m"))))).alias("std"))


def texture_summary(frames: DataFrame, window: int = 32, step: int | None = None, least: float = LEAST_TEXTURE) -> DataFrame:
    """Median texture of each recording's frames (0 without a window), the warning, and how many windows are masked."""
    found = texture(frames, window, step).groupBy("recording_id").agg(F.median("std").alias("m"), F.count("*").alias("n"), F.count_if(F.col("std") < least).alias("low"))
    out = frames.select("recording_id").distinct().join(found, "recording_id", "left")
    median = F.coalesce("m", F.lit(0.0))
    return out.select("recording_id", median.alias("piv_median_window_std"), (median < least).alias("piv_low_texture_warning"), F.coalesce("n", F.lit(0)).cast("int").alias("piv_n_windows_total"), F.coalesce("low", F.lit(0)).cast("int").alias("piv_n_low_texture_windows_masked"))
