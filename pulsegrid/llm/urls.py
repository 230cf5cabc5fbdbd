"""Operator 8: URL filters, in DataFrame functions only.

Given rules decide first, and are the labels for the rest: a tree of path
templates is grown per host from all urls. Segments that vary become wildcards,
labelled branches that don't differ from their labelled siblings are merged,
and templates whose smoothed labelled purity is high enough are rejected.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_written, join_by_size, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# The rules (verdict, host, path).
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)

#: A node's segments vary if there are this many different ones, and at least one for every four urls; one with this part of the urls stays.
VARIED, URLS_EACH = 8, 4
#: Standard errors by which a branch's labels must differ from those of its siblings to stay apart.
APART = 2.0
#: Labels that the smoothing counts for, and the purity from which a template is rejected.
SMOOTHING, REJECT = 4.0, 0.8


def parts_of(pages: DataFrame, url: str = "url") -> DataFrame:
    """``pages`` with host (A-Z lower-cased) and path; both empty for a null url or one without ``://``."""
    at = F.instr(F.col(url), "://")
    rest = F.when(at > 0, F.expr(f"substring({url}, instr({url}, '://') + 3)")).otherwise(F.lit(""))
    out = pages.withColumn("_rest", F.coalesce(rest, F.lit(""))).withColumn("_host", F.regexp_extract("_rest", r"^[^/?#]*", 0))
    path = F.regexp_extract(F.expr("substring(_rest, length(_host) + 1)"), r"^[^?#]*", 0)
    return out.withColumn("path", path).withColumn("host", F.translate("_host", UPPER, LOWER)).drop("_rest", "_host")


def ruled(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """``pages`` (host, path) with the longest rule that fits (host and path as one string; of equals the first) and what it says; else nulls."""
    rule = said = None
    for verdict, host, path in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        rule = F.when(fits, host + path) if rule is None else rule.when(fits, host + path)
        said = F.when(fits, verdict) if said is None else said.when(fits, verdict)
    return pages.withColumn("rule", F.lit(None).cast("string") if rule is None else rule).withColumn("said", F.lit(None).cast("string") if said is None else said)


def _prefix(count) -> tuple:
    """A node below (host, template) as two hashes: its first ``count`` segments, told by 96 bits."""
    inside = ("host", "template", count, F.slice("rest", 1, count))
    return F.xxhash64(*inside).alias("high"), F.hash(*inside).alias("low")


def steps_of(rows: DataFrame) -> DataFrame:
    """id, bad, at, node, branch, named for each segment that is left of each url: the nodes above and below it, and whether it is spelled like a sign.

    ``rows``: id, host, template, rest (segments not yet in the template), bad.
    """
    step = lambda k: F.struct(k.alias("at"), F.struct(*_prefix(k)).alias("node"), F.struct(*_prefix(k + 1)).alias("branch"), F.get("rest", k).isin("*", "~").alias("named"))
    left = rows.where(F.size("rest") > 0)
    return left.select("id", "bad", F.explode(F.transform(F.sequence(F.lit(0), F.size("rest") - 1), step)).alias("step")).select("id", "bad", "step.*")


def branches(steps: DataFrame) -> DataFrame:
    """branch, n (urls in it), sign (``*``, ``~``, empty for one that is spelled like these, null for any other that stays as it is), as a written table.

    Nodes are prefixes of what is left, all judged at once: as far down as
    branches stay as they are, prefixes and nodes of the tree are the same.
    """
    children = steps.groupBy("node", "branch").agg(F.count("*").alias("urls"), F.count("bad").alias("l"), F.coalesce(F.sum("bad"), F.lit(0)).alias("b"), F.max("named").alias("named"))
    children = written(children, "children")
    nodes = children.groupBy("node").agg(F.count("*").alias("n"), F.sum("urls").alias("nn"), F.sum("l").alias("ll"), F.sum("b").alias("bb"))
    nodes = written(nodes, "nodes")
    n, l, b, kinds, nn, ll, bb = (F.col(c) for c in ("urls", "l", "b", "n", "nn", "ll", "bb"))
    varies = (kinds >= VARIED) & (kinds * URLS_EACH >= nn) & (n * VARIED < nn)
    # two shares of bad labels, the branch's own and that of its siblings without it
    gap = F.abs(F.try_divide(b, l) - F.try_divide(bb - b, ll - l))
    error = F.sqrt(F.try_divide(bb, ll) * (1 - F.try_divide(bb, ll)) * (F.try_divide(F.lit(1), l) + F.try_divide(F.lit(1), ll - l)))
    merged = (l > 0) & (ll > l) & (gap <= APART * error)
    # what is spelled like a sign ends the run too, as it falls together with what the sign stands for
    sign = F.when(varies, "*").when(merged, "~").when(F.col("named"), "")
    judged = written(join_by_size(children, nodes, "node").select("branch", n.alias("n"), sign.alias("sign")), "branches")
    drop_written(children, nodes)
    return judged


def templated(pages: DataFrame) -> DataFrame:
    """``pages`` with template, labelled and bad_labels of that template on its host, purity, and whether it is rejected.

    ``pages``: host, path, bad (1, 0, or null without a label) and any others. A
    round judges all nodes below the templates so far and takes each url down
    to its first wildcard or merged branch, however deep that is; there are as
    many rounds as one url has of these, and one more. Empty segments don't
    count, so a path without others has the empty template. A template without
    labels isn't rejected, whatever its siblings.
    """
    own = F.struct(*[F.col(f"`{c}`") for c in pages.columns]).alias("row")
    rows = pages.select(own, "host", "bad", F.lit("").alias("template"), F.array_remove(F.split("path", "/"), "").alias("rest"))
    # the numbers are written with the rows, so that they stay as they are
    rows = written(rows.withColumn("id", F.monotonically_increasing_id()), "paths")
    done = []
    while True:
        steps = steps_of(rows)
        judged = branches(steps)
        if judged.where("sign is not null").isEmpty():
            done.append(rows)
            break
        turns = join_by_size(steps.select("id", "at", "branch"), judged, "branch").where("sign is not null")
        turns = turns.groupBy("id").agg(F.min(F.struct("at", "sign")).alias("turn")).select("id", "turn.*")
        at = F.col("at")
        segment = F.when(F.col("sign") == "", F.get("rest", at)).otherwise(F.col("sign"))
        grown = F.concat("template", F.when(at > 0, F.concat(F.lit("/"), F.array_join(F.slice("rest", 1, at), "/"))).otherwise(""), F.lit("/"), segment)
        below = F.slice("rest", at + 2, F.greatest(F.size("rest") - at - 1, F.lit(0)))
        taken = rows.join(turns, "id", "left")
        taken = taken.select("row", "host", "bad", F.coalesce(grown, "template").alias("template"), F.when(at.isNull(), F.col("rest")).otherwise(below).alias("rest"), "id", at.isNotNull().alias("on"))
        taken = written(taken, "paths")
        drop_written(judged, *(() if done else (rows,)))
        done.append(taken.where("not on").drop("on"))
        rows = taken.where("on").drop("on")
    rows = reduce(DataFrame.unionByName, done)
    rows = rows.withColumn("template", F.when(F.size("rest") > 0, F.concat("template", F.lit("/"), F.array_join("rest", "/"))).otherwise(F.col("template"))).drop("rest", "id")
    whole = rows.groupBy("host", "template").agg(F.count("*").alias("n"), F.count("bad").alias("labelled"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad_labels"))
    whole = written(whole, "templates")
    prior = whole.agg(F.coalesce(F.try_divide(F.sum("bad_labels"), F.sum("labelled")), F.lit(0.0)).alias("p")).scalar()
    purity = (F.col("bad_labels") + SMOOTHING * prior) / (F.col("labelled") + SMOOTHING)
    whole = whole.withColumn("purity", purity).withColumn("rejected", (F.col("purity") >= REJECT) & (F.col("labelled") > 0))
    return join_by_size(rows, whole, ["host", "template"]).select("row.*", "template", "labelled", "bad_labels", "purity", "rejected")


def judge_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, template, purity for each row of ``pages`` (page_id, url).

    A page under a rule gets the rule's verdict, and is a label for the tree
    (block: bad); any other is blocked if its template is rejected, else
    allowed. Templates are null-free: a url without host or path has the empty
    template. Repeated rows, and rows without a page_id, are judged each by its
    own url; other columns are ignored, whatever their names.
    """
    known = ruled(parts_of(pages.select("page_id", "url")), rules).withColumn("bad", F.when(F.col("said") == "block", 1).when(F.col("said") == "allow", 0))
    verdict = F.coalesce("said", F.when(F.col("rejected"), "block").otherwise("allow"))
    return templated(known.drop("url")).select("page_id", "host", "path", "rule", verdict.alias("verdict"), "template", "purity")
