"""Connected components by alternating stars, all in joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def hung(edges: DataFrame, with_own: bool) -> tuple[DataFrame, DataFrame]:
    """Edges (u, v) with ``m``, the smallest node beside u (or u itself, if asked for); and u, m: a row for each u.

    The smallest nodes are a written table: two tables that are shuffled as they
    stand are what adaptive execution can split at a node with most of the edges.
    """
    least = F.least("u", F.min("v")) if with_own else F.min("v")
    lowest = written(edges.groupBy("u").agg(least.alias("m")), "lowest")
    return edges.join(lowest, "u"), lowest


def stars(edges: DataFrame) -> bool:
    """Whether every node either has one smaller node beside it, or is such a one."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    ends = ends.union(edges.select("v", F.lit(0), F.lit(1))).groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return ends.where("up > 1 or (up > 0 and down > 0)").agg(F.count("*")).first()[0] == 0


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``node``, ``component`` (its smallest node) for each node of ``edges`` (a, b: long, not null).

    Large stars hang each node's greater neighbours on its smallest one, small
    stars its smaller ones; after O(log^2 n) rounds every component is one star.
    """
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    while not stars(now):
        if not rounds:
            raise RuntimeError("components aren't stars after all rounds")
        rounds -= 1
        both, _ = hung(now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v"))), True)
        large = both.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small, lowest = hung(written(large, "large"), False)
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(lowest.select("u", F.col("m").alias("v")))
        now = written(small.where("u <> v").distinct(), "edges")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
