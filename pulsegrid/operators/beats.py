"""Contraction events: motion signals, beats, and their summary for each recording.

Everything after the smoothed signal and its peaks is expressions on a
recording's arrays, so that a beat table costs no join and no shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import argmin_between, between, percent_variation, steps, usable
from ..functions.vectorized import vectorized
from . import motion, pixels, signals


@dataclass(frozen=True)
class BeatParams:
    signal_mode: str = "reference"
    reference_index: int | None = None
    beats_per_minute: float | None = None
    prominence: float = 0.15
    window: int = 32
    step: int | None = None


def reference_frames(frames: DataFrame) -> DataFrame:
    """recording_id, reference_index: the stillest frame, by the smoothed frame-to-frame differences away from both ends."""
    moved = signals.pack(pixels.consecutive_signal(frames)).withColumn("s", signals.smooth("values", "fps", F.lit(0.3)))
    n = F.size("values")
    margin = F.greatest(F.rint(0.03 * n).cast("int"), F.lit(2))
    inner = F.when(n <= 2 * margin, argmin_between(F.col("s"), F.lit(0), n)).otherwise(argmin_between(F.col("s"), margin, n - margin))
    counted = frames.groupBy("recording_id").agg(F.count("*").alias("n"))
    return counted.join(moved.select("recording_id", inner.alias("_at")), "recording_id", "left").select("recording_id", F.when(F.col("n") < 10, 0).otherwise(F.coalesce("_at", F.lit(0))).cast("int").alias("reference_index"))


def motion_signal(frames: DataFrame, params: BeatParams = BeatParams()) -> tuple[DataFrame, DataFrame | None]:
    """Long motion signal (recording_id, idx, raw, fps) in the mode asked for, and the reference frames if it has them."""
    if params.signal_mode == "consecutive":
        return pixels.consecutive_signal(frames), None
    if params.signal_mode == "piv":
        return motion.motion_signal(frames, params.window, params.step), None
    if params.signal_mode != "reference":
        raise ValueError(f"unknown signal mode {params.signal_mode!r}")
    if params.reference_index is None:
        chosen = reference_frames(frames)
    else:
        last = frames.groupBy("recording_id").agg(F.max("frame_idx").alias("last"))
        chosen = last.select("recording_id", F.least(F.greatest(F.lit(params.reference_index), F.lit(0)), "last").cast("int").alias("reference_index"))
    return pixels.reference_signal(frames, chosen), chosen


def tuned(packed: DataFrame, beats_per_minute: float | None = None, prominence: float = 0.15) -> DataFrame:
    """Packed signals with period, window_s, gap, smoothed and peaks: the smoothing and the gap follow the dominant period."""
    out = packed.withColumn("period", signals.dominant_period("values", "fps"))
    out = out.withColumn("window_s", signals.tuned_window(F.col("period"))).withColumn("gap", F.lit(float(beats_per_minute)) if beats_per_minute is not None else signals.tuned_gap(F.col("period")))
    out = out.withColumn("smoothed", signals.smooth("values", "fps", "window_s"))
    return out.withColumn("peaks", signals.peaks("smoothed", "fps", "gap", F.lit(float(prominence))))


def decay_time(values: Column, peak: Column, end: Column, baseline: Column, amplitude: Column, fraction: float, fps: Column) -> Column:
    """Seconds from the peak until the signal has lost a fraction of its amplitude, interpolated; null if it doesn't before ``end``."""
    target = baseline + (1 - F.lit(fraction)) * amplitude
    down = F.transform(between(values, peak + 1, end), lambda v: v <= target)
    k = F.array_position(down, True).cast("int")
    a, b = F.get(values, peak + k - 1), F.get(values, peak + k)
    part = F.when(a != b, F.try_divide(a - target, a - b)).otherwise(F.lit(0.0))
    return F.when((amplitude > 0) & (end > peak) & (k > 0), (k - 1 + part) / fps)


@vectorized("array<struct<no int, peak int, previous int, start int, part array<double>>>")
def _spans(values: pd.Series, peaks: pd.Series) -> pd.Series:
    """Of each peak the samples from the one before it to the one after it: a sample stands in two spans at most."""
    out = []
    for v, at in zip(values, peaks):
        at = np.asarray(at).tolist()
        ends = zip(at, [None, *at[:-1]], [*at[1:], len(v)])
        out.append([{"no": k, "peak": p, "previous": q, "start": q or 0, "part": v[q or 0 : r].tolist()} for k, (p, q, r) in enumerate(ends)])
    return pd.Series(out)


def events(packed: DataFrame, values: str = "smoothed") -> DataFrame:
    """A row for each peak of a packed signal: recording_id, fps, values, start, no, peak, before, after (the troughs beside it), previous.

    ``values`` are the samples between the neighbouring peaks, not the whole
    signal, so that all rows together are no longer than twice the signal; the
    first one is the recording's sample ``start``. Places are the recording's.
    """
    spans = packed.select("recording_id", "fps", F.inline(_spans(values, "peaks"))).withColumnRenamed("part", "values")
    peak = F.col("peak") - F.col("start")
    before = F.col("start") + argmin_between(F.col("values"), F.lit(0), peak)
    after = F.col("start") + argmin_between(F.col("values"), peak, F.size("values"))
    return spans.select("recording_id", "fps", "values", "start", "no", "peak", before.alias("before"), after.alias("after"), "previous")


def beat_table(packed: DataFrame, values: str = "smoothed") -> DataFrame:
    """One row for each beat: times in seconds, amplitude over the mean of both troughs, velocities, decay times, intervals."""
    e = events(packed, values)
    before, peak, after = (F.col(c) - F.col("start") for c in ("before", "peak", "after"))
    e = e.withColumn("baseline", (F.get("values", before) + F.get("values", after)) / 2)
    e = e.withColumn("amplitude", F.get("values", peak) - F.col("baseline"))
    t = lambda c: F.col(c) / F.col("fps")
    up, down = steps(between(F.col("values"), before, peak)), steps(between(F.col("values"), peak, after))
    interval = F.when(F.col("previous").isNotNull(), t("peak") - t("previous"))
    decay = lambda f: decay_time(F.col("values"), peak, after, F.col("baseline"), F.col("amplitude"), f, F.col("fps"))
    return e.select(
        "recording_id", F.col("no").alias("beat_index"), t("before").alias("contraction_start_time_s"), t("peak").alias("peak_time_s"), t("after").alias("relaxation_end_time_s"), "amplitude",
        (t("peak") - t("before")).alias("contraction_time_s"), (t("after") - t("peak")).alias("relaxation_time_s"),
        (F.array_max(up) * F.col("fps")).alias("max_contraction_velocity"), (-F.array_min(down) * F.col("fps")).alias("max_relaxation_velocity"),
        *[decay(f).alias(f"time_to_decay_{round(100 * f)}_s") for f in (0.1, 0.5, 0.9)],
        interval.alias("inter_beat_interval_s"), F.try_divide(F.lit(60.0), interval).alias("instantaneous_bpm"),
    )


MEANS = ("amplitude", "contraction_time_s", "relaxation_time_s", "max_contraction_velocity", "max_relaxation_velocity", "time_to_decay_10_s", "time_to_decay_50_s", "time_to_decay_90_s")


def beat_summary(packed: DataFrame, beats: DataFrame) -> DataFrame:
    """One row for each recording, with or without beats: counts, rates, spreads (population) and means."""
    recordings = packed.select("recording_id", (F.size("values") / F.col("fps")).alias("duration_s"), *[c for c in ("period", "window_s", "gap") if c in packed.columns])
    ibi = usable(F.col("inter_beat_interval_s"))
    found = beats.groupBy("recording_id").agg(
        F.count("*").cast("int").alias("n_beats"), F.avg(ibi).alias("mean_inter_beat_interval_s"), F.stddev_pop(ibi).alias("ibi_std_s"),
        F.stddev_pop("amplitude").alias("_spread"), *[F.avg(usable(F.col(c))).alias(f"mean_{c}") for c in MEANS],
    )
    out = recordings.join(found, "recording_id", "left").withColumn("n_beats", F.coalesce("n_beats", F.lit(0)))
    out = out.withColumn("mean_bpm", F.try_divide(F.lit(60.0), F.col("mean_inter_beat_interval_s"))).withColumn("ibi_cv_percent", percent_variation(F.col("mean_inter_beat_interval_s"), F.col("ibi_std_s")))
    out = out.withColumn("amplitude_cv_percent", percent_variation(F.col("mean_amplitude"), F.col("_spread"))).drop("_spread")
    return out.withColumnsRenamed({"period": "estimated_period_s", "window_s": "smoothing_window_s", "gap": "min_bpm_gap_used"})


def beating(frames: DataFrame, params: BeatParams = BeatParams()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Signals (packed), beats and summary of all recordings in ``frames``."""
    raw, chosen = motion_signal(frames, params)
    packed = tuned(signals.pack(raw), params.beats_per_minute, params.prominence)
    beats = beat_table(packed)
    summary = beat_summary(packed, beats).withColumn("signal_mode", F.lit(params.signal_mode))
    if chosen is not None:
        summary = summary.join(chosen.withColumnRenamed("reference_index", "reference_frame_index"), "recording_id", "left")
    if params.signal_mode == "piv":
        summary = summary.join(motion.texture_summary(frames.where("frame_idx = 0"), params.window, params.step), "recording_id", "left")
    return packed, beats, summary


def strongest_pair(packed: DataFrame) -> DataFrame:
    """recording_id, pair_idx: the frame pair of the highest smoothed peak, for a representative field."""
    heights = F.transform("peaks", lambda p: F.struct((-F.get("smoothed", p)).alias("minus"), p.alias("p")))
    return packed.where(F.size("peaks") > 0).select("recording_id", F.least(F.array_min(heights)["p"], F.size("smoothed") - 1).alias("pair_idx"))
