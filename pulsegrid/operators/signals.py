"""Signal operators: smoothing, peaks, dominant period, minima.

A packed signal is a row ``recording_id, fps, values array<double>``: one
recording's samples in order. Recordings are independent, so nothing here
shuffles; the long form is made and taken back by ``pack`` and ``unpack``.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import clamp
from ..functions.vectorized import vectorized


def pack(signal: DataFrame, value: str = "raw") -> DataFrame:
    """Long signal (recording_id, idx, value, fps) to one row a recording."""
    rows = F.sort_array(F.collect_list(F.struct("idx", F.col(value).cast("double").alias("v"))))
    return signal.groupBy("recording_id").agg(F.max("fps").alias("fps"), F.transform(rows, lambda r: r["v"]).alias("values"))


def unpack(packed: DataFrame, value: str = "raw") -> DataFrame:
    return packed.select("recording_id", "fps", F.posexplode("values").alias("idx", value))


def odd_window(seconds: float, fps: float, n: int) -> int | None:
    """Samples of the smoothing window, or None where the signal is too short and stays as it is."""
    w = max(int(round(seconds * fps)), 5)
    w += w % 2 == 0
    if w >= n:
        w = max(n - 1 if n % 2 == 0 else n, 3)
    return w if 5 <= w < n else None


def cubic_fit(w: int) -> np.ndarray:
    """Hat matrix of a cubic over w even steps: its middle row smooths, the outer ones serve the edges."""
    a = np.vander(np.arange(w) - w // 2, 4, increasing=True).astype(float)
    return a @ np.linalg.pinv(a)


def smooth_values(values: np.ndarray, fps: float, seconds: float = 0.15) -> np.ndarray:
    w = odd_window(seconds, fps, len(values))
    if w is None:
        return values
    hat, half = cubic_fit(w), w // 2
    out = np.convolve(values, hat[half], "same")
    out[:half] = hat[:half] @ values[:w]
    out[-half:] = hat[-half:] @ values[-w:]
    return out


@vectorized("array<double>")
def smooth(values: pd.Series, fps: pd.Series, seconds: pd.Series) -> pd.Series:
    """Savitzky-Golay smoothing, cubic, edges by the fit of the outermost window."""
    return pd.Series([smooth_values(np.asarray(v, float), f, s) for v, f, s in zip(values, fps, seconds)])


def local_maxima(values: np.ndarray) -> np.ndarray:
    """Places above both neighbours; a plateau counts once, at its middle (floor); ends don't count."""
    n = len(values)
    if n < 3:
        return np.zeros(0, int)
    first = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
    last = np.concatenate([first[1:] - 1, [n - 1]])
    level = values[first]
    inner = np.flatnonzero((level[1:-1] > level[:-2]) & (level[1:-1] > level[2:])) + 1
    return (first[inner] + last[inner]) // 2


def _lowest_since(values: list[float]) -> list[float]:
    """For each sample the least value from the nearest higher sample before it, that one left out, or from the start, up to itself."""
    out, higher = [], []
    for v in values:
        low = v
        # a sample is dropped once, by the first one that isn't lower
        while higher and not higher[-1][0] > v:
            seen = higher.pop()[1]
            low = seen if seen < low or seen != seen else low
        higher.append((v, low))
        out.append(low)
    return out


def prominences(values: np.ndarray, peaks: np.ndarray) -> np.ndarray:
    """Height of each peak over the higher of the lowest samples on its two sides, up to the next higher ones; linear in the samples."""
    if not len(peaks):
        return np.empty(0)
    listed = values.tolist()
    left, right = _lowest_since(listed), _lowest_since(listed[::-1])[::-1]
    return np.array([listed[p] - max(left[p], right[p]) for p in peaks.tolist()])


def dominant(at: np.ndarray, heights: np.ndarray, distance: int) -> np.ndarray:
    """Which of the places ``at`` (ascending) stay, from the highest down, later of equals first, if each drops all nearer than ``distance``.

    What a place can drop is a range of its neighbours, found for all at once; a
    place is looked at once, so that the work is linear after sorting.
    """
    lo, hi = np.searchsorted(at, at - distance + 1).tolist(), np.searchsorted(at, at + distance).tolist()
    keep = np.ones(len(at), bool)
    for k in np.argsort(heights, kind="stable")[::-1].tolist():
        if keep[k]:
            keep[lo[k] : hi[k]] = False
            keep[k] = True
    return keep


def find_peaks(values: np.ndarray, fps: float, per_minute: float = 300.0, prominence: float = 0.15) -> np.ndarray:
    """Local maxima, thinned from the highest down to a least distance, then those that stand out enough."""
    if len(values) < 3:
        return np.zeros(0, int)
    peaks = local_maxima(values)
    peaks = peaks[dominant(peaks, values[peaks], max(int(round(60.0 / per_minute * fps)), 1))]
    return peaks[prominences(values, peaks) >= max(np.ptp(values) * prominence, 1e-9)]


@vectorized("array<int>")
def peaks(values: pd.Series, fps: pd.Series, per_minute: pd.Series, prominence: pd.Series) -> pd.Series:
    return pd.Series([find_peaks(np.asarray(v, float), *x).astype(np.int32) for v, *x in zip(values, fps, per_minute, prominence)])


def dominant_period_s(values: np.ndarray, fps: float, slowest: float = 15.0, fastest: float = 200.0) -> float:
    """Seconds of the lag of greatest autocorrelation between two rates a minute; 1.0 where there is none."""
    n = len(values)
    if n < 10:
        return 1.0
    centred = values - values.mean()
    if np.allclose(centred, 0, atol=1e-8) or (power := float(centred @ centred)) <= 0:
        return 1.0
    lo, hi = max(int(round(fps * 60 / fastest)), 1), min(int(round(fps * 60 / slowest)), n - 1)
    if hi <= lo:
        return 1.0
    size = 1 << (2 * n - 1).bit_length()
    spectrum = np.fft.rfft(centred, size)
    lags = np.fft.irfft(spectrum * spectrum.conj(), size)[lo : hi + 1] / power
    return (lo + int(np.argmax(np.round(lags, 12)))) / fps


@vectorized("double")
def dominant_period(values: pd.Series, fps: pd.Series) -> pd.Series:
    return pd.Series([dominant_period_s(np.asarray(v, float), f) for v, f in zip(values, fps)])


def tuned_window(period: Column) -> Column:
    """Smoothing seconds for a period."""
    return clamp(period / 6, 0.05, 0.5)


def tuned_gap(period: Column) -> Column:
    """Peaks a minute, at most, for a period."""
    return clamp(100 / period, 30.0, 400.0)


# --- the same steps on the long form, for signals that aren't packed


def runs(signal: DataFrame, value: str = "raw") -> DataFrame:
    """Runs of equal neighbours: recording_id, run, first, last, v."""
    order = Window.partitionBy("recording_id").orderBy("idx")
    turned = signal.withColumn("_new", F.when(F.col(value).eqNullSafe(F.lag(value).over(order)), 0).otherwise(1))
    return turned.withColumn("run", F.sum("_new").over(order)).groupBy("recording_id", "run").agg(F.min("idx").alias("first"), F.max("idx").alias("last"), F.min(value).alias("v"))


def maxima(signal: DataFrame, value: str = "raw") -> DataFrame:
    """recording_id, idx, v of local maxima; plateaus at their middle."""
    order = Window.partitionBy("recording_id").orderBy("run")
    flanked = runs(signal, value).withColumn("before", F.lag("v").over(order)).withColumn("after", F.lead("v").over(order))
    return flanked.where("v > before and v > after").select("recording_id", F.floor((F.col("first") + F.col("last")) / 2).cast("int").alias("idx"), "v")


@vectorized("array<struct<idx int, v double, prominence double>>")
def _prominent(values: pd.Series) -> pd.Series:
    out = []
    for v in values:
        v = np.asarray(v, float)
        at = local_maxima(v)
        out.append([{"idx": int(k), "v": float(v[k]), "prominence": float(p)} for k, p in zip(at, prominences(v, at))])
    return pd.Series(out)


def peak_prominence(signal: DataFrame, value: str = "raw") -> DataFrame:
    """recording_id, idx (from the recording's first sample), v, prominence of local maxima, found on packed signals."""
    packed = pack(signal.withColumn("fps", F.lit(1.0)) if "fps" not in signal.columns else signal, value)
    return packed.select("recording_id", F.inline(_prominent("values")))


def thinned(peaks_df: DataFrame, distance: int) -> DataFrame:
    """recording_id, idx: greedy from the highest down, later of equals first, dropping peaks closer than ``distance``."""

    @F.pandas_udf("array<int>")
    def kept(idx: pd.Series, v: pd.Series) -> pd.Series:
        return pd.Series([np.asarray(i)[dominant(np.asarray(i), np.asarray(h, float), distance)].astype(np.int32) for i, h in zip(idx, v)])

    packed = peaks_df.groupBy("recording_id").agg(F.sort_array(F.collect_list(F.struct("idx", "v"))).alias("p"))
    return packed.select("recording_id", F.explode(kept(F.col("p.idx"), F.col("p.v"))).alias("idx"))


def autocorrelation(signal: DataFrame, low: int, high: int, value: str = "raw") -> DataFrame:
    """recording_id, lag, r for lags low..high: a self-join on the shifted index, so each lag is one equi-join key."""
    mean = F.avg(value).over(Window.partitionBy("recording_id"))
    centred = signal.select("recording_id", "idx", (F.col(value) - mean).alias("c"))
    power = centred.groupBy("recording_id").agg(F.sum(F.col("c") * F.col("c")).alias("power"))
    shifted = centred.withColumn("lag", F.explode(F.sequence(F.lit(low), F.lit(high)))).select("recording_id", (F.col("idx") + F.col("lag")).alias("idx"), "lag", F.col("c").alias("other"))
    sums = shifted.join(centred, ["recording_id", "idx"]).groupBy("recording_id", "lag").agg(F.sum(F.col("c") * F.col("other")).alias("s"))
    return sums.join(power, "recording_id").select("recording_id", "lag", F.when(F.col("power") > 0, F.col("s") / F.col("power")).alias("r"))
