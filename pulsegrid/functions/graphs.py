"""Classes of nodes that pairs connect, by alternating stars, all in joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stored import drop_written, written


def _hung(edges: DataFrame, by: list[str], with_own: bool) -> tuple[DataFrame, DataFrame]:
    """Edges (u, v) with ``m``, the smallest node beside u (or u itself, if asked for); and u, m: a row for each u."""
    least = F.least("u", F.min("v")) if with_own else F.min("v")
    lowest = written(edges.groupBy(*by, "u").agg(least.alias("m")), "lowest")
    return edges.join(lowest, [*by, "u"]), lowest


def _stars(edges: DataFrame, by: list[str]) -> bool:
    """Whether every node either has one smaller node beside it, or is such a one."""
    up, down = edges.select(*by, F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")), edges.select(*by, "v", F.lit(0), F.lit(1))
    ends = up.union(down).groupBy(*by, "node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return ends.where("up > 1 or (up > 0 and down > 0)").isEmpty()


def classes(pairs: DataFrame, by: tuple[str, ...] = ("recording_id",), rounds: int = 60) -> DataFrame:
    """by.., ``node``, ``root`` (the smallest node of its class) for each node of ``pairs`` (by.., a, b: long, not null).

    Pairs connect nodes of the same ``by`` alone. Large stars hang each node's
    greater neighbours on its smallest one, small stars its smaller ones; after
    O(log^2 n) rounds every class is one star.
    """
    keys = list(by)
    now = written(pairs.where("a <> b").select(*keys, F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    while not _stars(now, keys):
        if not rounds:
            raise RuntimeError("classes aren't stars after all rounds")
        rounds -= 1
        both, lowest = _hung(now.union(now.select(*keys, F.col("v").alias("u"), F.col("u").alias("v"))), keys, True)
        large = written(both.where("v > u").select(*keys, F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "large")
        drop_written(lowest, now)
        small, lowest = _hung(large, keys, False)
        small = small.select(*keys, F.col("v").alias("u"), F.col("m").alias("v")).union(lowest.select(*keys, "u", F.col("m").alias("v")))
        now = written(small.where("u <> v").distinct(), "edges")
        drop_written(lowest, large)
    roots = now.select(*keys, F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(*keys, F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
