"""Calcium transients: dF/F0, transients, decay constants and the summary."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectorized import vectorized
from ..functions.columns import between, percent_variation
from . import pixels, signals
from .beats import events


def df_f0(signal: DataFrame, percent: float = 10.0) -> DataFrame:
    """recording_id, idx, raw, f0, df_f0, fps: change over the interpolated low percentile of the recording."""
    base = signal.groupBy("recording_id").agg(F.greatest(F.percentile("raw", percent / 100), F.lit(1e-6)).alias("f0"))
    return signal.join(base, "recording_id").withColumn("df_f0", (F.col("raw") - F.col("f0")) / F.col("f0"))


def rise_time(values: Column, onset: Column, peak: Column, baseline: Column, amplitude: Column, fps: Column) -> Column:
    """Seconds between the first samples at a tenth and at nine tenths of the amplitude; null without amplitude."""
    part = between(values, onset, peak)
    at = lambda f: F.array_position(F.transform(part, lambda v: v >= baseline + f * amplitude), True)
    low, high = at(F.lit(0.1)), at(F.lit(0.9))
    return F.when((amplitude > 0) & (low > 0) & (high > 0), (high - low) / fps)


def decay_constant(t: np.ndarray, y: np.ndarray, amplitude: float, floor: float) -> float | None:
    """tau of a * exp(-t / tau) + c by Levenberg-Marquardt; None where it doesn't settle on a positive one."""
    p = np.array([max(amplitude, 1e-6), max(t[-1] / 2, 1e-3), floor])
    damping, slopes, normal = 1e-3, np.ones((len(t), 3)), None
    with np.errstate(all="ignore"):
        shape = np.exp(-t / p[1])
        error = p[0] * shape + p[2] - y
        cost = float(error @ error)
        for _ in range(2000):
            if normal is None:
                slopes[:, 0] = shape
                slopes[:, 1] = p[0] * shape * t / p[1] ** 2
                normal, pull = slopes.T @ slopes, -(slopes.T @ error)
                along = normal.diagonal() + 1e-12
            damped = normal.copy()
            damped.flat[::4] += damping * along
            try:
                q = p + np.linalg.solve(damped, pull)
            except np.linalg.LinAlgError:
                return None
            new_shape = np.exp(-t / q[1]) if q[1] else np.full_like(t, np.nan)
            new_error = q[0] * new_shape + q[2] - y
            new_cost = float(new_error @ new_error)
            if math.isfinite(new_cost) and new_cost < cost:
                done = cost - new_cost <= 1e-12 * cost
                p, shape, error, cost, damping, normal = q, new_shape, new_error, new_cost, max(damping / 5, 1e-12), None
                if done:
                    break
            else:
                damping *= 4
                if damping > 1e12:
                    break
    return float(p[1]) if np.isfinite(p[1]) and p[1] > 0 else None


@vectorized("double")
def decay_tau(segment: pd.Series, amplitude: pd.Series, floor: pd.Series, fps: pd.Series) -> pd.Series:
    """Decay constant in seconds of each segment from the peak on; null for fewer than four samples."""
    return pd.Series([None if s is None or len(s) < 4 else decay_constant(np.arange(len(s)) / f, np.asarray(s, float), a, c) for s, a, c, f in zip(segment, amplitude, floor, fps)], dtype="float64")


def transient_table(packed: DataFrame, values: str = "smoothed") -> DataFrame:
    """One row for each transient; the baseline is the trough before it alone."""
    # a fit costs more than all else: peaks are dealt out, whatever recordings they are of
    e = events(packed, values)
    e = e.repartition(3 * e.sparkSession.sparkContext.defaultParallelism, "recording_id", "no")
    before, peak, after = (F.col(c) - F.col("start") for c in ("before", "peak", "after"))
    e = e.withColumn("baseline", F.get("values", before)).withColumn("amplitude", F.get("values", peak) - F.col("baseline"))
    t = lambda c: F.col(c) / F.col("fps")
    segment = F.when(F.col("after") > F.col("peak") + 3, between(F.col("values"), peak, after - 1))
    return e.select(
        "recording_id", F.col("no").alias("transient_index"), t("peak").alias("peak_time_s"), F.col("amplitude").alias("amplitude_df_f0"),
        rise_time(F.col("values"), before, peak, F.col("baseline"), F.col("amplitude"), F.col("fps")).alias("rise_time_10_90_s"),
        decay_tau(segment, "amplitude", F.get("values", after), "fps").alias("decay_tau_s"),
        F.when(F.col("previous").isNotNull(), t("peak") - t("previous")).alias("inter_peak_interval_s"),
    )


def transient_summary(packed: DataFrame, transients: DataFrame) -> DataFrame:
    found = transients.groupBy("recording_id").agg(
        F.count("*").cast("int").alias("n_transients"), F.avg("inter_peak_interval_s").alias("mean_inter_peak_interval_s"), F.avg("amplitude_df_f0").alias("mean_amplitude_df_f0"),
        F.stddev_pop("amplitude_df_f0").alias("_spread"), F.avg("decay_tau_s").alias("mean_decay_tau_s"),
    )
    out = packed.select("recording_id", (F.size("values") / F.col("fps")).alias("duration_s")).join(found, "recording_id", "left").withColumn("n_transients", F.coalesce("n_transients", F.lit(0)))
    out = out.withColumn("mean_frequency_per_min", F.try_divide(F.lit(60.0), F.col("mean_inter_peak_interval_s")))
    return out.withColumn("amplitude_cv_percent", percent_variation(F.col("mean_amplitude_df_f0"), F.col("_spread"))).drop("_spread")


def calcium(frames: DataFrame, per_minute: float = 240.0, prominence: float = 0.2, mask: Column | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Signals (packed dF/F0), transients and summary of all recordings."""
    packed = signals.pack(df_f0(pixels.intensity(frames, mask)), "df_f0")
    packed = packed.withColumn("smoothed", signals.smooth("values", "fps", F.lit(0.15))).withColumn("peaks", signals.peaks("smoothed", "fps", F.lit(per_minute), F.lit(prominence)))
    transients = transient_table(packed)
    return packed, transients, transient_summary(packed, transients)
