"""Comparison of groups of recordings, metric by metric.

``metrics``: metric, group_idx, label, recording_id, cluster, value. A metric
may hold all rows: ranks are those of its distinct values, range by range, and
the mixed model gets sufficient statistics of each (metric, group, cluster).
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, NumericType

from ..functions.vectorized import vectorized
from ..functions.columns import usable
from ..functions.ranks import ranked, shapiro_sums
from ..functions.stored import written
from ..functions.tails import chi_square_p, mann_whitney_exact, normal_p_value, shapiro_p_value

# Fields of a summary that describe the recording, not what is measured.
BOOKKEEPING = ("reference_frame_index", "n_frames", "image_area_px", "duration_s", "estimated_period_s", "min_bpm_gap_used", "smoothing_window_s")


def unpivoted(summaries: DataFrame, ids: tuple[str, ...] = ("group_idx", "label", "recording_id", "cluster")) -> DataFrame:
    """Summaries to metrics: every numeric column that is no id and no bookkeeping, where it has a finite value."""
    keep = [f.name for f in summaries.schema if isinstance(f.dataType, NumericType) and not isinstance(f.dataType, BooleanType) and f.name not in (*ids, *BOOKKEEPING)]
    wide = summaries.select(*ids, *[usable(F.col(c)).alias(c) for c in keep])
    return wide.unpivot(list(ids), keep, "metric", "value").where("value is not null")


def complete(metrics: DataFrame, groups: int) -> DataFrame:
    """Metrics with a value in every one of ``groups`` groups."""
    whole = metrics.groupBy("metric").agg(F.countDistinct("group_idx").alias("k")).where(F.col("k") == groups).select("metric")
    return metrics.join(whole, "metric", "left_semi")


def descriptive(metrics: DataFrame, with_values: bool = False) -> DataFrame:
    """n, mean and sample std (0 for one value) of each metric and group."""
    values = [F.sort_array(F.collect_list(F.struct("recording_id", "value"))).getField("value").alias("values")] if with_values else []
    return metrics.groupBy("metric", "group_idx", "label").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("std"), *values)


def rank_sums(metrics: DataFrame) -> DataFrame:
    """For each metric and group: n, rank_sum; and over the metric: total, ties (sum of t^3 - t), varied (whether values differ). Written, as tests share it."""
    counts = written(metrics.groupBy("metric", "group_idx", "label", "value").agg(F.count("*").alias("c")), "group_counts")
    t = F.col("t").cast("double")
    # each group bears its share of a tie: c (t^2 - 1), which adds up to t^3 - t
    own = counts.join(ranked(counts, "value", ("metric",), "c"), ["metric", "value"]).groupBy("metric", "group_idx", "label").agg(
        F.sum("c").alias("n"), F.sum(F.col("c") * F.col("r")).alias("rank_sum"), F.max("total").alias("total"), F.sum(F.col("c") * (t * t - 1)).alias("_ties"), F.min("value").alias("_lo"), F.max("value").alias("_hi"),
    )
    whole = Window.partitionBy("metric")
    out = own.select("metric", "group_idx", "label", "n", "rank_sum", "total", F.sum("_ties").over(whole).alias("ties"), (F.max("_hi").over(whole) > F.min("_lo").over(whole)).alias("varied"))
    return written(out, "rank_sums")


@vectorized("double")
def _exact(u: pd.Series, n1: pd.Series, n2: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or x != x else mann_whitney_exact(x, int(a), int(b)) for x, a, b in zip(u, n1, n2)], dtype="float64")


def mann_whitney(metrics: DataFrame, with_p: bool = True, sums: DataFrame | None = None) -> DataFrame:
    """metric, n1, n2, u (of the first group), z and p_value of exactly two groups.

    Exact p where a group has eight values or fewer and none tie, else normal
    with ties and continuity; u, z and p are null where all values are equal.
    ``sums``: the metrics' ``rank_sums``, if there are any yet.
    """
    sums = sums or rank_sums(metrics)
    first = sums.groupBy("metric").agg(F.min("group_idx").alias("low"))
    one = sums.join(first, "metric").where("group_idx = low").select("metric", F.col("n").alias("n1"), "rank_sum", "total", "ties", "varied").withColumn("n2", F.col("total") - F.col("n1"))
    n1, n2, n = F.col("n1").cast("double"), F.col("n2").cast("double"), F.col("total").cast("double")
    varied = F.col("varied")
    out = one.withColumn("u", F.when(varied, F.col("rank_sum") - n1 * (n1 + 1) / 2))
    spread = F.sqrt(n1 * n2 / 12 * ((n + 1) - F.col("ties") / (n * (n - 1))))
    top = F.greatest(F.col("u"), n1 * n2 - F.col("u"))
    out = out.withColumn("z", F.when(varied, (top - n1 * n2 / 2 - 0.5) / spread))
    if not with_p:
        return out.select("metric", "n1", "n2", "u", "z")
    small = (F.least("n1", "n2") <= 8) & (F.col("ties") == 0)
    exact = _exact(F.when(small, F.col("u")), F.when(small, F.col("n1")).otherwise(1), F.when(small, F.col("n2")).otherwise(1))
    # least and greatest skip nulls: a z that isn't defined stays null
    normal = F.when(F.col("z").isNotNull(), F.least(normal_p_value(F.greatest("z", F.lit(0.0))), F.lit(1.0)))
    return out.withColumn("_e", exact).withColumn("_n", normal).select("metric", "n1", "n2", "u", "z", F.when(small, F.col("_e")).otherwise(F.col("_n")).alias("p_value"))


def kruskal_wallis(metrics: DataFrame, sums: DataFrame | None = None) -> DataFrame:
    """metric, groups, h (corrected for ties) and p_value; null where all values are equal. ``sums``: the metrics' ``rank_sums``, if there are any yet."""
    sums = (sums or rank_sums(metrics)).groupBy("metric", "total", "ties", "varied").agg(F.count("*").alias("groups"), F.sum(F.col("rank_sum") * F.col("rank_sum") / F.col("n")).alias("s"))
    n = F.col("total").cast("double")
    h = (12 / (n * (n + 1)) * F.col("s") - 3 * (n + 1)) / (1 - F.col("ties") / (n * n * n - n))
    out = sums.withColumn("h", F.when(F.col("varied"), h))
    return out.withColumn("p_value", chi_square_p("h", (F.col("groups") - 1).cast("double"))).select("metric", "groups", "h", "p_value")


def dunn(metrics: DataFrame, with_p: bool = True, sums: DataFrame | None = None) -> DataFrame:
    """metric, group_a, group_b (labels), z, p_value and p_value_bonferroni of every pair of groups with a variance above 0. ``sums`` as above."""
    s = (sums or rank_sums(metrics)).where("varied")
    a = s.select("metric", F.col("group_idx").alias("ia"), F.col("label").alias("group_a"), F.col("n").alias("na"), F.col("rank_sum").alias("ra"))
    b = s.select("metric", F.col("group_idx").alias("ib"), F.col("label").alias("group_b"), F.col("n").alias("nb"), F.col("rank_sum").alias("rb"), "total", "ties")
    n = F.col("total").cast("double")
    variance = (n * (n + 1) / 12 - F.col("ties") / (12 * (n - 1))) * (1 / F.col("na") + 1 / F.col("nb"))
    pairs = a.join(b, "metric").where("ia < ib").withColumn("v", variance)
    # pairs that exist, also those that a variance of 0 leaves out
    pairs = pairs.withColumn("k", F.count("*").over(Window.partitionBy("metric"))).where("v > 0")
    out = pairs.withColumn("z", (F.col("ra") / F.col("na") - F.col("rb") / F.col("nb")) / F.sqrt("v"))
    if not with_p:
        return out.select("metric", "group_a", "group_b", "z")
    out = out.withColumn("p_value", normal_p_value("z"))
    return out.select("metric", "group_a", "group_b", "z", "p_value", F.least(F.col("p_value") * F.col("k"), F.lit(1.0)).alias("p_value_bonferroni"))


def sufficient(metrics: DataFrame) -> DataFrame:
    """n, s1 and s2 (sums of values and squares) of each metric, group and cluster."""
    return metrics.groupBy("metric", "group_idx", "label", "cluster").agg(F.count("*").alias("n"), F.sum("value").alias("s1"), F.sum(F.col("value") * F.col("value")).alias("s2"))


#: Ratios that are tried at first, and then between the neighbours of the best one, a few times.
FIRST_RATIOS, THEN, TURNS = (0.0, *np.logspace(-6, 6, 97).tolist()), 256, 2


def by_cluster_size(cells: DataFrame) -> DataFrame:
    """metric, size, a, b, t, m: over the clusters of one size, the summed products of what groups a and b (Y: the values' sum) have in each.

    The criterion weighs a cluster by its size alone, so that these are all that
    it needs of clusters. m is the number of clusters, in the row Y, Y.
    """
    one = cells.groupBy("metric", "cluster").agg(F.sum("n").alias("size"), F.sort_array(F.collect_list(F.struct(F.col("group_idx").cast("int").alias("g"), F.col("n").cast("double").alias("v")))).alias("of"), F.sum("s1").alias("y"))
    parts = F.concat("of", F.array(F.struct(F.lit(Y).alias("g"), F.col("y").alias("v"))))
    pairs = F.flatten(F.transform(parts, lambda p, k: F.transform(F.slice(parts, k + 1, F.size(parts)), lambda q: F.struct(p["g"].alias("a"), q["g"].alias("b"), (p["v"] * q["v"]).alias("t")))))
    rows = one.select("metric", "size", F.inline(pairs))
    return rows.groupBy("metric", "size", "a", "b").agg(F.sum("t").alias("t"), F.sum(F.when((F.col("a") == Y) & (F.col("b") == Y), 1)).alias("m"))


#: Stands for the values where groups have their numbers; it sorts behind all of them.
Y = 2**31 - 1


def profile(groups: list[int], n: np.ndarray, s: np.ndarray, yy: float, entries: dict[tuple[int, int], float], logs: float) -> tuple | None:
    """REML criterion of value ~ group + random cluster at one variance ratio, group means, the inverse of their precision, and the residual sum.

    ``entries`` are sums over clusters, weighed by ratio / (1 + ratio * size), of
    the products of ``by_cluster_size``; ``logs`` the sum of log(1 + ratio * size).
    """
    k, at = len(groups), {g: i for i, g in enumerate([*groups, Y])}
    whole = np.diag([*n, yy])
    whole[:k, k] = whole[k, :k] = s
    for (a, b), v in entries.items():
        i, j = at[a], at[b]
        whole[i, j] -= v
        if i != j:
            whole[j, i] -= v
    a, rhs = whole[:k, :k], whole[:k, k]
    sign, logdet = np.linalg.slogdet(a)
    if sign <= 0:
        return None
    beta = np.linalg.solve(a, rhs)
    rss = whole[k, k] - beta @ rhs
    if rss <= 0:
        return None
    return (n.sum() - k) * math.log(rss) + logs + logdet, beta, np.linalg.inv(a), rss


_FIT = "value double, beta array<double>, inverse array<double>, rss double"


def _tried(tries: DataFrame, sizes: DataFrame, totals: DataFrame) -> DataFrame:
    """``tries`` (metric, ratio) with value, beta, inverse and rss: sums over all clusters by Spark, a small solution for each row."""
    weight = F.col("ratio") / (1 + F.col("ratio") * F.col("size"))
    sums = sizes.join(tries, "metric").groupBy("metric", "ratio", "a", "b").agg(F.sum(weight * F.col("t")).alias("v"), F.sum(F.col("m") * F.log1p(F.col("ratio") * F.col("size"))).alias("l"))
    whole = sums.groupBy("metric", "ratio").agg(F.collect_list(F.struct("a", "b", "v")).alias("entries"), F.sum("l").alias("logs"))

    @F.pandas_udf(_FIT)
    def fit(groups: pd.Series, n: pd.Series, s: pd.Series, yy: pd.Series, entries: pd.Series, logs: pd.Series) -> pd.DataFrame:
        out = []
        for g, counts, totals_, square, es, log in zip(groups, n, s, yy, entries, logs):
            found = profile(list(g), np.asarray(counts, float), np.asarray(totals_, float), square, {(e["a"], e["b"]): e["v"] for e in es}, log)
            out.append((found[0], found[1].tolist(), found[2].ravel().tolist(), found[3]) if found else (None, None, None, None))
        return pd.DataFrame(out, columns=["value", "beta", "inverse", "rss"])

    return whole.join(totals, "metric").select("metric", "ratio", fit("groups", "ns", "ss", "yy", "entries", "logs").alias("f")).select("metric", "ratio", "f.*")


def _around(found: DataFrame) -> DataFrame:
    """metric, lo, best, hi (the best ratio and its neighbours among those tried), and vertex: the lowest point of the parabola through the three."""
    w = Window.partitionBy("metric").orderBy("ratio")
    rows = found.where("value is not null").select("metric", "ratio", "value", *[f(c).over(w).alias(f"{name}_{c}") for name, f in (("b", F.lag), ("a", F.lead)) for c in ("ratio", "value")])
    best = rows.groupBy("metric").agg(F.min_by(F.struct("ratio", "value", "b_ratio", "b_value", "a_ratio", "a_value"), F.struct("value", "ratio")).alias("r")).select("metric", "r.*")
    left, right = F.col("ratio") - F.col("b_ratio"), F.col("a_ratio") - F.col("ratio")
    down, up = (F.col("ratio") - F.col("b_ratio")) * (F.col("value") - F.col("a_value")), (F.col("a_ratio") - F.col("ratio")) * (F.col("value") - F.col("b_value"))
    vertex = F.col("ratio") - 0.5 * F.try_divide(left * down - right * up, down + up)
    lo, hi = F.coalesce("b_ratio", "ratio"), F.coalesce("a_ratio", "ratio")
    return best.select("metric", lo.alias("lo"), F.col("ratio").alias("best"), hi.alias("hi"), F.least(F.greatest(F.coalesce(vertex, F.col("ratio")), lo), hi).alias("vertex"))


def lmm_fit(metrics: DataFrame) -> DataFrame:
    """metric, lmm_n_clusters, ratio, sigma2, groups, labels, beta (group means) and inverse: one mixed model a metric, by profile REML.

    Only metrics whose every value has a cluster, with 2 or more clusters and
    fewer than values. A cluster label shared by groups is one cluster. The
    criterion is summed over clusters by Spark for a grid of variance ratios, 0
    included, then for finer ones around the best, so that no task holds a
    metric's clusters; what is solved has as many rows as there are groups.
    """
    gate = metrics.groupBy("metric").agg(F.count("*").alias("n"), F.count("cluster").alias("named"), F.countDistinct("cluster").alias("c")).where("n = named and c >= 2 and c < n").select("metric", F.col("c").cast("int").alias("lmm_n_clusters"))
    cells = written(sufficient(metrics.join(gate, "metric", "left_semi")), "cells")
    sizes = written(by_cluster_size(cells), "cluster_sizes")
    groups = cells.groupBy("metric", "group_idx").agg(F.first("label").alias("label"), F.sum("n").alias("n"), F.sum("s1").alias("s"), F.sum("s2").alias("yy"))
    listed = groups.groupBy("metric").agg(F.sort_array(F.collect_list(F.struct(F.col("group_idx").cast("int").alias("g"), "label", "n", "s"))).alias("o"), F.sum("yy").alias("yy"), F.sum("n").alias("total"))
    totals = listed.where(F.col("total") > F.size("o")).select("metric", "yy", "total", F.col("o.g").alias("groups"), F.col("o.label").alias("labels"), F.col("o.n").alias("ns"), F.col("o.s").alias("ss"))
    totals = written(totals.join(gate, "metric"), "totals")
    found = written(_tried(totals.select("metric", F.explode(F.array(*map(F.lit, FIRST_RATIOS))).alias("ratio")), sizes, totals), "tried")
    for _ in range(TURNS):
        near = _around(found)
        grid = F.transform(F.sequence(F.lit(0), F.lit(THEN)), lambda k: F.col("lo") + (F.col("hi") - F.col("lo")) * k / float(THEN))
        found = written(_tried(near.select("metric", F.explode(F.array_distinct(F.concat(grid, F.array("best")))).alias("ratio")), sizes, totals), "tried")
    last = _around(found).select("metric", F.explode(F.array_distinct(F.array(F.col("best"), F.col("vertex"), F.lit(0.0)))).alias("ratio"))
    best = _tried(last, sizes, totals).where("value is not null").groupBy("metric").agg(F.min_by(F.struct("ratio", "beta", "inverse", "rss"), F.struct("value", "ratio")).alias("b")).select("metric", "b.*")
    fits = best.join(totals, "metric").withColumn("sigma2", F.col("rss") / (F.col("total") - F.size("groups")))
    return written(fits.select("metric", "lmm_n_clusters", "ratio", "sigma2", "groups", "labels", "beta", "inverse"), "fits")


def lmm_pairwise(metrics: DataFrame, fits: DataFrame | None = None) -> DataFrame:
    """Contrasts of every pair of groups: the second one's mean minus the first's, with Wald's p. ``fits``: the metrics' ``lmm_fit``, if there are any yet."""
    fits = fits or lmm_fit(metrics)
    k = F.size("groups")
    at = lambda i, j: F.get("inverse", i * k + j)
    rows = fits.withColumn("i", F.explode(F.sequence(F.lit(0), k - 1))).withColumn("j", F.explode(F.sequence(F.lit(0), k - 1))).where("i < j")
    spread = F.sqrt(F.greatest(F.col("sigma2") * (at(F.col("i"), F.col("i")) + at(F.col("j"), F.col("j")) - 2 * at(F.col("i"), F.col("j"))), F.lit(0.0)))
    value = F.get("beta", F.col("j")) - F.get("beta", F.col("i"))
    out = rows.select("metric", F.lit(True).alias("lmm_converged"), "lmm_n_clusters", (F.col("ratio") * F.col("sigma2")).alias("cluster_variance"), F.col("sigma2").alias("residual_variance"), F.get("labels", F.col("i")).alias("group_a"), F.get("labels", F.col("j")).alias("group_b"), value.alias("coefficient"), spread.alias("_spread"))
    return out.withColumn("p_value", F.when(F.col("_spread") > 0, normal_p_value(F.col("coefficient") / F.col("_spread")))).drop("_spread")


def residual_normality(metrics: DataFrame, fits: DataFrame | None = None) -> DataFrame:
    """metric, lmm_residual_shapiro_p of the residuals conditional on the cluster; null below three values.

    Shapiro-Wilk from order statistics, which no task holds together; its p is
    an approximation made for up to 5000 values, and is carried on beyond.
    """
    fits = fits or lmm_fit(metrics)
    means = fits.select("metric", "ratio", F.explode(F.arrays_zip(F.col("groups").alias("g"), F.col("beta").alias("b"))).alias("o")).select("metric", F.col("o.g").alias("group_idx"), F.col("o.b").alias("fit"), "ratio")
    # sums of each cluster take the place of its rows
    sums = metrics.groupBy("metric", "group_idx", "cluster").agg(F.count("*").alias("n"), F.sum("value").alias("s")).join(means, ["metric", "group_idx"])
    cluster = sums.groupBy("metric", "cluster", "ratio").agg(F.sum("n").alias("n"), F.sum(F.col("s") - F.col("n") * F.col("fit")).alias("e"))
    shift = cluster.select("metric", "cluster", (F.col("ratio") * F.col("e") / (1 + F.col("ratio") * F.col("n"))).alias("blup"))
    offsets = sums.select("metric", "group_idx", "cluster", "fit").join(shift, ["metric", "cluster"]).select("metric", "group_idx", "cluster", (F.col("fit") + F.col("blup")).alias("offset"))
    residuals = metrics.join(offsets, ["metric", "group_idx", "cluster"]).select("metric", (F.col("value") - F.col("offset")).alias("e"))
    made = shapiro_sums(residuals, "e", ("metric",))
    return made.select("metric", shapiro_p_value(F.col("n").cast("double"), "mm", "mx", "spread", F.coalesce("last_score", F.lit(0.0)), F.coalesce("next_score", F.lit(0.0)), F.coalesce("outer_gap", F.lit(0.0)), F.coalesce("inner_gap", F.lit(0.0))).alias("lmm_residual_shapiro_p"))


def compare_groups(metrics: DataFrame, groups: int, with_values: bool = False) -> DataFrame:
    """One row a metric, most significant first (null p last, then by name): descriptives, omnibus test, post-hoc and mixed model.

    ``with_values``: also every value of each group, for figures of small tables.
    """
    if groups < 2:
        raise ValueError("a comparison needs two groups or more")
    m = complete(metrics, groups)
    fields = ["group_idx", "label", "n", "mean", "std", *(["values"] if with_values else [])]
    described = descriptive(m, with_values).groupBy("metric").agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("groups"))
    sums, fits = rank_sums(m), lmm_fit(m)
    if groups == 2:
        omnibus = mann_whitney(m, sums=sums).select("metric", F.lit("mann_whitney_u").alias("test"), F.col("u").alias("statistic"), "p_value")
        out = described.join(omnibus, "metric")
    else:
        omnibus = kruskal_wallis(m, sums).select("metric", F.lit("kruskal_wallis").alias("test"), F.col("h").alias("statistic"), "p_value")
        posthoc = dunn(m, sums=sums).groupBy("metric").agg(F.sort_array(F.collect_list(F.struct("group_a", "group_b", "z", "p_value", "p_value_bonferroni"))).alias("posthoc"))
        out = described.join(omnibus, "metric").join(posthoc, "metric", "left")
    pairs = lmm_pairwise(m, fits)
    mixed = pairs.groupBy("metric").agg(F.first("lmm_converged").alias("lmm_converged"), F.first("lmm_n_clusters").alias("lmm_n_clusters"), F.sort_array(F.collect_list(F.struct("group_a", "group_b", "coefficient", "p_value"))).alias("lmm_pairwise"))
    return out.join(mixed.join(residual_normality(m, fits), "metric", "left"), "metric", "left").orderBy(F.col("p_value").isNull(), "p_value", "metric")


def top_metrics(compared: DataFrame, n: int = 12) -> DataFrame:
    """The ``n`` most significant metrics, for a figure."""
    return compared.orderBy(F.col("p_value").isNull(), "p_value", "metric").limit(n)
