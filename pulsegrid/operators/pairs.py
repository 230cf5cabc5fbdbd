"""Paired measurements: two-channel overlap and agreement of two methods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import correlation, slope, usable
from ..functions.ranks import ranked
from ..functions.tails import correlation_p_value


def otsu(histogram: DataFrame, by: tuple[str, ...] = ("recording_id",)) -> DataFrame:
    """Threshold of each group from its histogram (by.., v, n): the first value that parts it best; a constant group gives its value."""
    order = Window.partitionBy(*by).orderBy("v")
    running = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy(*by)
    n, s = F.sum("n").over(running), F.sum(F.col("n") * F.col("v")).over(running)
    cut = histogram.withColumn("n0", n).withColumn("s0", s).withColumn("n1", F.sum("n").over(whole) - n).withColumn("s1", F.sum(F.col("n") * F.col("v")).over(whole) - s)
    gap = F.try_divide(F.col("s0"), F.col("n0")) - F.try_divide(F.col("s1"), F.col("n1"))
    between = F.coalesce(F.col("n0").cast("double") * F.col("n1") * gap * gap, F.lit(-1.0))
    return cut.withColumn("between", between).groupBy(*by).agg(F.min(F.struct((-F.col("between")).alias("minus"), F.col("v")))["v"].alias("threshold"))


def histogram(values: DataFrame, value: str = "v", by: tuple[str, ...] = ("recording_id",)) -> DataFrame:
    return values.groupBy(*by, F.col(value).alias("v")).agg(F.count("*").alias("n"))


def colocalization(pixels: DataFrame) -> DataFrame:
    """One row for each image_id of ``pixels`` (image_id, a, b: the two channels at one place): correlation, Manders, overlap.

    Thresholds are Otsu's; a pixel is positive above its channel's. Pair the
    channels by an equi-join on place first; places of one channel alone don't count.
    """
    cuts = otsu(histogram(pixels, "a", ("image_id",)), ("image_id",)).withColumnRenamed("threshold", "threshold_a").join(otsu(histogram(pixels, "b", ("image_id",)), ("image_id",)).withColumnRenamed("threshold", "threshold_b"), "image_id")
    p = pixels.join(cuts, "image_id").withColumn("pa", F.col("a") > F.col("threshold_a")).withColumn("pb", F.col("b") > F.col("threshold_b"))
    a, b = F.col("a").cast("double"), F.col("b").cast("double")
    share = lambda c: F.avg(c.cast("double"))
    sums = p.groupBy("image_id", "threshold_a", "threshold_b").agg(
        F.count("*").alias("n_pixels"), correlation(a, b).alias("pearson_r"),
        F.try_divide(F.sum(a * b), F.nullif(F.sqrt(F.sum(a * a) * F.sum(b * b)), F.lit(0.0))).alias("manders_overlap_coefficient"),
        F.when(F.sum(a) > 0, F.coalesce(F.sum(F.when(F.col("pb"), a)), F.lit(0.0)) / F.sum(a)).alias("manders_m1"),
        F.when(F.sum(b) > 0, F.coalesce(F.sum(F.when(F.col("pa"), b)), F.lit(0.0)) / F.sum(b)).alias("manders_m2"),
        share(F.col("pa")).alias("fraction_a_positive"), share(F.col("pb")).alias("fraction_b_positive"), share(F.col("pa") & F.col("pb")).alias("fraction_both_positive"),
    )
    return sums.withColumn("pearson_p", correlation_p_value("pearson_r", F.col("n_pixels").cast("double")))


def colocalize(projection_a: DataFrame, projection_b: DataFrame) -> DataFrame:
    """Overlap of two projections (image_id, height, width, pixels) of one size, paired place by place."""
    both = projection_a.alias("p").join(projection_b.alias("q"), "image_id").where(F.assert_true((F.col("p.height") == F.col("q.height")) & (F.col("p.width") == F.col("q.width")), F.lit("the channels differ in shape")).isNull())
    paired = both.select("image_id", F.inline(F.arrays_zip(F.col("p.pixels").alias("a"), F.col("q.pixels").alias("b"))))
    return colocalization(paired.toDF("image_id", "a", "b"))


def complete_pairs(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Columns a and b as numbers, where both are; an unknown column is an error that names those there are."""
    for c in (a, b):
        if c not in rows.columns:
            raise ValueError(f"no column {c!r}; there are {rows.columns}")
    number = lambda c: usable(F.col(c).try_cast("double"))
    return rows.select("*", number(a).alias("_a"), number(b).alias("_b")).where("_a is not null and _b is not null").drop(a, b).withColumnsRenamed({"_a": "a", "_b": "b"})


def bland_altman_rows(pairs: DataFrame) -> DataFrame:
    return pairs.withColumn("diff", F.col("a") - F.col("b")).withColumn("mean", (F.col("a") + F.col("b")) / 2)


def spearman(pairs: DataFrame, by: tuple[str, ...] = ("pair_id",)) -> DataFrame:
    """by.., spearman_r: the correlation of mean ranks; null without spread in one of them."""
    keys = list(by)
    counts = pairs.groupBy(*keys, "a", "b").agg(F.count("*").cast("double").alias("c"))
    of = lambda v: ranked(pairs, v, by).select(*keys, v, F.col("r").alias(f"r{v}"), F.col("total").alias(f"n{v}"))
    both = counts.join(of("a"), [*keys, "a"]).join(of("b"), [*keys, "b"])
    # ranks about their mean, which is known
    c, a, b = F.col("c"), F.col("ra") - (F.col("na") + 1) / F.lit(2.0), F.col("rb") - (F.col("nb") + 1) / F.lit(2.0)
    return both.groupBy(*keys).agg(F.try_divide(F.sum(c * a * b), F.nullif(F.sqrt(F.sum(c * a * a)) * F.sqrt(F.sum(c * b * b)), F.lit(0.0))).alias("spearman_r"))


def agreement(pairs: DataFrame, by: tuple[str, ...] = ("pair_id",), with_p: bool = True, with_ranks: bool = True) -> DataFrame:
    """One row for each group of ``pairs`` (by.., a, b): correlations, ICC(2,1), Bland-Altman and the regression of b on a.

    ``with_ranks``: also Spearman's, for which all values are ranked.

    Null where a value isn't defined; fewer than three pairs are an error.
    """
    keys = list(by)
    a, b = F.col("a"), F.col("b")
    n, d = F.count("*").cast("double"), F.col("a") - F.col("b")
    # squares of rows about the grand mean, which is the mean of the rows' means; of columns, halves of the gap about it
    rows = 2 * F.var_samp((a + b) / 2)
    columns = n * F.pow(F.avg(a) - F.avg(b), F.lit(2)) / 2
    rest = F.greatest(F.try_divide(n * (F.var_pop(a) + F.var_pop(b)), n - 1) - rows, F.lit(0.0))
    out = pairs.groupBy(*keys).agg(
        F.count("*").alias("n"), correlation(a, b).alias("pearson_r"),
        F.when(n > 1, F.try_divide(rows - rest, F.nullif(rows + rest + 2 * (columns - rest) / n, F.lit(0.0)))).alias("icc_2_1"),
        F.avg(d).alias("bland_altman_bias"), F.stddev_samp(d).alias("bland_altman_sd_diff"),
        slope(b, a).alias("regression_slope"), (F.avg(b) - slope(b, a) * F.avg(a)).alias("regression_intercept"), F.pow(correlation(a, b), F.lit(2)).alias("regression_r_squared"),
    )
    kinds = ("pearson", "spearman") if with_ranks else ("pearson",)
    out = out.join(spearman(pairs, by), keys, "left") if with_ranks else out
    enough = F.assert_true(F.col("n") >= 3, F.lit("agreement needs three pairs or more"))
    out = out.where(enough.isNull()).withColumns({c: usable(F.col(c)) for c in (*[f"{k}_r" for k in kinds], "icc_2_1", "regression_slope", "regression_intercept", "regression_r_squared")})
    limit = F.lit(1.96) * F.col("bland_altman_sd_diff")
    out = out.withColumn("bland_altman_loa_lower", F.col("bland_altman_bias") - limit).withColumn("bland_altman_loa_upper", F.col("bland_altman_bias") + limit)
    if with_p:
        out = out.withColumns({f"{k}_p": correlation_p_value(f"{k}_r", F.col("n").cast("double")) for k in kinds})
    return out


def weighted(column: Column, weight: Column) -> Column:
    return F.sum(weight * column)


def circular_alignment(rows: DataFrame, angle: str = "theta", weight: str = "weight", by: tuple[str, ...] = ("recording_id",)) -> DataFrame:
    """n, alignment_score and mean_orientation_deg of axial angles; null for fewer than two or without weight."""
    t, w = F.col(angle), F.col(weight)
    sums = rows.groupBy(*by).agg(F.count("*").alias("n"), F.sum(w).alias("_w"), weighted(F.cos(2 * t), w).alias("_c"), weighted(F.sin(2 * t), w).alias("_s"))
    good = (F.col("n") >= 2) & (F.col("_w") > 0)
    score = F.sqrt(F.col("_c") * F.col("_c") + F.col("_s") * F.col("_s")) / F.col("_w")
    return sums.select(*by, "n", F.when(good, score).alias("alignment_score"), F.when(good, F.degrees(F.atan2("_s", "_c") / 2)).alias("mean_orientation_deg"))


AXES = ("z", "y", "x")


def nematic_tensor(rows: DataFrame, weight: str = "weight", by: tuple[str, ...] = ("recording_id",)) -> DataFrame:
    """n and the six sums q_zz, q_zy .. of Q = sum w (3 n n' - 1) / (2 sum w) over unit vectors z, y, x."""
    w = F.col(weight)
    terms = {f"q_{i}{j}": F.sum(w * (3 * F.col(i) * F.col(j) - (1.0 if i == j else 0.0))) for k, i in enumerate(AXES) for j in AXES[k:]}
    sums = rows.groupBy(*by).agg(F.count("*").alias("n"), F.sum(w).alias("_w"), *[v.alias(k) for k, v in terms.items()])
    good = (F.col("n") >= 2) & (F.col("_w") > 0)
    return sums.select(*by, "n", *[F.when(good, F.col(k) / (2 * F.col("_w"))).alias(k) for k in terms])


def nematic_alignment(rows: DataFrame, weight: str = "weight", by: tuple[str, ...] = ("recording_id",)) -> DataFrame:
    """alignment_score_3d (largest eigenvalue, 0 at least) and its director as mean_direction_zyx, in closed form."""
    return nematic_of(nematic_tensor(rows, weight, by), (*by, "n"))


def nematic_of(q: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """``keep`` and the largest eigenvalue and its director of tensors q_zz, q_zy .."""
    zz, zy, zx, yy, yx, xx = (F.col(f"q_{k}") for k in ("zz", "zy", "zx", "yy", "yx", "xx"))
    off = zy * zy + zx * zx + yx * yx
    mean = (zz + yy + xx) / 3
    p = F.sqrt(((zz - mean) * (zz - mean) + (yy - mean) * (yy - mean) + (xx - mean) * (xx - mean) + 2 * off) / 6)
    a, b, c = zz - mean, yy - mean, xx - mean
    det = a * (b * c - yx * yx) - zy * (zy * c - yx * zx) + zx * (zy * yx - b * zx)
    angle = F.acos(F.least(F.greatest(F.try_divide(det, 2 * p * p * p), F.lit(-1.0)), F.lit(1.0))) / 3
    top = F.when(p < 1e-15, mean).otherwise(mean + 2 * p * F.cos(angle))
    out = q.withColumn("_t", top)
    t = F.col("_t")
    # the director is across two rows of Q - t: the longest of the three cross products
    r = [[zz - t, zy, zx], [zy, yy - t, yx], [zx, yx, xx - t]]
    crosses = []
    for i, j in ((0, 1), (0, 2), (1, 2)):
        v = [r[i][1] * r[j][2] - r[i][2] * r[j][1], r[i][2] * r[j][0] - r[i][0] * r[j][2], r[i][0] * r[j][1] - r[i][1] * r[j][0]]
        crosses.append(F.struct((v[0] * v[0] + v[1] * v[1] + v[2] * v[2]).alias("s"), F.array(*v).alias("v")))
    out = out.withColumn("_best", F.array_max(F.array(*crosses)))
    director = F.when(F.col("_best.s") > 1e-30, F.transform("_best.v", lambda v: v / F.sqrt("_best.s")))
    return out.select(*keep, F.greatest(t, F.lit(0.0)).alias("alignment_score_3d"), director.alias("mean_direction_zyx"))
