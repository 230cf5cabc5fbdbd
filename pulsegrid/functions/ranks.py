"""Ranks and order statistics of groups of any size: no group is sorted in one task."""

from __future__ import annotations

import math
from statistics import NormalDist

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .stored import written
from .vectorized import vectorized

#: Distinct values in a range, about: what one task sorts.
IN_RANGE = 1_000_000


def in_ranges(counts: DataFrame, value: str, by: tuple[str, ...], in_range: int) -> DataFrame:
    """``counts``, a written table, dealt to as many ranges of (by.., value) as its rows need, with ``_range``, their number in order."""
    ranges = -(-counts.count() // in_range)
    return counts.repartitionByRange(max(1, ranges), *by, value).withColumn("_range", F.spark_partition_id())


def ranked(rows: DataFrame, value: str, by: tuple[str, ...], n: str | None = None, in_range: int = IN_RANGE) -> DataFrame:
    """One row for each distinct value of each group: by.., value, t (rows with it), r (mean of their 1-based ranks), total (rows of the group).

    Values are counted first (rows count as often as ``n`` says) and written.
    They are dealt to ranges of about ``in_range`` values, whatever group they
    belong to, so that there are as many as the data needs; a value's rank is
    what its group has in the ranges before, and before it in its own. Keys
    aren't null.
    """
    keys = list(by)
    counts = written(rows.groupBy(*keys, value).agg((F.sum(n) if n else F.count("*")).alias("t")), "counts")
    dealt = in_ranges(counts, value, by, in_range)
    # a row for each range that a group has values in
    sizes = dealt.groupBy(*keys, "_range").agg(F.sum("t").alias("_n"))
    whole, upto = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy("_range")
    starts = sizes.select(*keys, "_range", (F.sum("_n").over(upto) - F.col("_n")).alias("_before"), F.sum("_n").over(whole).alias("total"))
    inside = F.sum("t").over(Window.partitionBy(*keys, "_range").orderBy(value)) - F.col("t")
    return dealt.withColumn("_inside", inside).join(starts, [*keys, "_range"]).select(*keys, value, "t", (F.col("_before") + F.col("_inside") + (F.col("t") + 1) / F.lit(2.0)).alias("r"), "total")


@vectorized("double")
def normal_quantile(p: pd.Series) -> pd.Series:
    return pd.Series([NormalDist().inv_cdf(x) for x in p], dtype="float64")


#: Places that one row of normal scores stands for, at most.
AT_ONCE = 100_000


@vectorized("struct<s double, q double>")
def _score_sums(first: pd.Series, last: pd.Series, total: pd.Series) -> pd.DataFrame:
    """Sums of the normal scores of places first..last, and of their squares."""
    out = []
    for lo, hi, n in zip(first, last, total):
        scores = [NormalDist().inv_cdf((i - 0.375) / (n + 0.25)) for i in range(lo, hi + 1)]
        out.append((math.fsum(scores), math.fsum(m * m for m in scores)))
    return pd.DataFrame(out, columns=["s", "q"])


def shapiro_sums(rows: DataFrame, value: str, by: tuple[str, ...], at_once: int = AT_ONCE) -> DataFrame:
    """What Shapiro-Wilk needs of each group: n, mm and mx (sums of squared normal scores, and of scores times values), spread, and the outer two scores and gaps.

    A value that ties holds a run of places, which is cut into parts of
    ``at_once`` places that are dealt out, however often it stands.
    """
    keys = list(by)
    first = (F.col("r") - (F.col("t") - 1) / F.lit(2.0)).cast("long")
    parts = ranked(rows, value, by).select(*keys, F.col(value).alias("x"), "total", (first + F.col("t") - 1).alias("_last"), F.explode(F.sequence(first, first + F.col("t") - 1, F.lit(at_once).cast("long"))).alias("lo"))
    parts = parts.withColumn("hi", F.least("_last", F.col("lo") + (at_once - 1))).repartition(*keys, "lo").withColumn("m", _score_sums("lo", "hi", "total"))
    at = lambda place: F.max(F.when((F.col("lo") <= place) & (F.col("hi") >= place), F.col("x")))
    n: Column = F.col("total")
    sums = parts.groupBy(*keys).agg(
        F.max("total").alias("n"), F.sum("m.q").alias("mm"), F.sum(F.col("m.s") * F.col("x")).alias("mx"),
        (at(n) - at(F.lit(1))).alias("outer_gap"), (at(n - 1) - at(F.lit(2))).alias("inner_gap"),
    )
    spreads = rows.groupBy(*keys).agg((F.var_pop(value) * F.count("*")).alias("spread"))
    score = lambda place: normal_quantile((place - 0.375) / (F.col("n") + 0.25))
    out = sums.join(spreads, keys).withColumn("last_score", score(F.col("n"))).withColumn("next_score", score(F.greatest(F.col("n") - 1, F.lit(1))))
    return out.select(*keys, "n", "mm", "mx", "spread", "last_score", F.when(F.col("n") > 1, F.col("next_score")).alias("next_score"), "outer_gap", "inner_gap")
