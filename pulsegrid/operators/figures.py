"""The rows that figures are drawn from."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import groups


def traces(packed: DataFrame, values: str = "smoothed") -> DataFrame:
    """recording_id, t, v, is_peak along a packed signal."""
    rows = packed.select("recording_id", "fps", "peaks", F.posexplode(values).alias("idx", "v"))
    return rows.select("recording_id", (F.col("idx") / F.col("fps")).alias("t"), "v", F.array_contains("peaks", F.col("idx")).alias("is_peak"))


def marks(beats: DataFrame) -> DataFrame:
    """recording_id, t, kind: the peak of each beat and the trough before it."""
    kinds = F.array(F.struct(F.col("contraction_start_time_s").alias("t"), F.lit("before").alias("kind")), F.struct(F.col("peak_time_s").alias("t"), F.lit("peak").alias("kind")))
    return beats.select("recording_id", F.inline(kinds))


def field(vectors: DataFrame) -> DataFrame:
    return vectors.withColumn("magnitude", F.sqrt(F.col("u") * F.col("u") + F.col("v") * F.col("v")))


def axes(objects: DataFrame) -> DataFrame:
    """Ends of each object's long axis, for an overlay."""
    half = F.col("major_axis_length") / 2
    dr, dc = F.cos("orientation") * half, F.sin("orientation") * half
    r, c = F.col("centroid-0"), F.col("centroid-1")
    return objects.select("recording_id", "label", (r - dr).alias("r0"), (c - dc).alias("c0"), (r + dr).alias("r1"), (c + dc).alias("c1"))


def axes_3d(objects: DataFrame) -> DataFrame:
    """Ends of each object's long axis as seen along z, as long as its diameter."""
    half = F.col("equivalent_diameter_area") / 2
    r, c, dr, dc = F.col("centroid-1"), F.col("centroid-2"), F.col("axis_y") * half, F.col("axis_x") * half
    return objects.select("recording_id", "label", (r - dr).alias("r0"), (c - dc).alias("c0"), (r + dr).alias("r1"), (c + dc).alias("c1"))


def agreement_lines(agreed: DataFrame, by: tuple[str, ...] = ("pair_id",)) -> DataFrame:
    """by.., kind, slope, intercept: identity and regression over the values; bias and both limits over their means."""
    line = lambda kind, slope, intercept: F.struct(F.lit(kind).alias("kind"), slope.cast("double").alias("slope"), intercept.cast("double").alias("intercept"))
    flat = {"bias": "bland_altman_bias", "lower_limit": "bland_altman_loa_lower", "upper_limit": "bland_altman_loa_upper"}
    lines = F.array(line("identity", F.lit(1), F.lit(0)), line("regression", F.col("regression_slope"), F.col("regression_intercept")), *[line(k, F.lit(0), F.col(c)) for k, c in flat.items()])
    return agreed.select(*by, F.inline(lines))


def comparison(compared: DataFrame, n: int = 12) -> DataFrame:
    """The top metrics with the number of pairs that differ at 0.05."""
    top = groups.top_metrics(compared, n)
    return top.withColumn("n_significant", F.size(F.filter("posthoc", lambda p: p["p_value_bonferroni"] < 0.05)) if "posthoc" in compared.columns else F.lit(None).cast("int"))


def scatter(pixels: DataFrame, points: int = 20_000, seed: int = 0, key: tuple[str, ...] | None = None) -> DataFrame:
    """A seeded sample without replacement, for a scatter plot: the ``points`` rows whose keys have the smallest hashes, the same however rows are dealt out.

    ``key``: columns that tell rows apart, all unless given; rows alike in them
    have one hash, and stand together. Rows are first counted by the leading
    zeros of their hashes, so that about twice ``points`` are sorted at most.
    """
    hashed = pixels.withColumn("_h", F.xxhash64(F.lit(seed), *[F.col(c) for c in key or pixels.columns]))
    # as an unsigned number: the fewer binary digits, the smaller
    zeros = F.when(F.col("_h") < 0, 0).otherwise(64 - F.length(F.bin("_h")))
    levels = sorted((tuple(r) for r in hashed.groupBy(zeros.alias("z")).count().collect()), reverse=True)
    least, n = 0, 0
    for z, count in levels:
        n += count
        if n >= points:
            least = z
            break
    rest = [c for c in pixels.columns if c not in (key or ())]
    order = (F.col("_h") < 0, "_h", *(key or ()), *rest)
    return hashed.where(zeros >= least).orderBy(*order).limit(points).drop("_h")


def min_max(pixels: DataFrame, *channels: str) -> DataFrame:
    """Channels scaled to 0..1 over each image."""
    ranges = pixels.groupBy("image_id").agg(*[f(c).alias(f"{k}_{c}") for c in channels for k, f in (("lo", F.min), ("hi", F.max))])
    scaled = {c: F.coalesce(F.try_divide(F.col(c) - F.col(f"lo_{c}"), F.nullif(F.col(f"hi_{c}") - F.col(f"lo_{c}"), F.lit(0))), F.lit(0.0)) for c in channels}
    return pixels.join(ranges, "image_id").withColumns(scaled).drop(*[f"{k}_{c}" for c in channels for k in ("lo", "hi")])
