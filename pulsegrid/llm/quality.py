"""Operator 6: quality rules, in DataFrame functions only.

Counting rules reject what is short or repeats itself; the rest is judged by a
log-likelihood ratio of hashed n-grams between two multinomials, one of a
trusted target and one of the whole corpus, divided by the number of n-grams.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

SPACE = r"[\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
#: Hash buckets of the multinomials, whatever the corpus. Their ratios, four bytes each, are all that is broadcast of them.
BUCKETS = 1 << 15
#: Trusted documents that the target is learnt from, at most: those of the smallest hashed ids.
TARGET_DOCS = 1_000_000
#: Mean log ratio per n-gram under which a document is rejected.
LEAST_RATIO = -0.06
WINDOW = 5
#: n-grams that the corpus lends the target for each bucket: of a small target little is concluded, and its gaps don't count as bad text.
LENT = 4


def chosen_targets(trusted: DataFrame, most: int = TARGET_DOCS) -> DataFrame:
    """doc_id of at most so many trusted documents."""
    return trusted.select("doc_id").where("doc_id is not null").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE), "")


def hashes_of(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def buckets_of(hashes: Column, buckets: int) -> Column:
    """A bucket for each word and for each pair of neighbours."""
    pairs = F.transform(F.slice(hashes, 1, F.greatest(F.size(hashes) - 1, F.lit(0))), lambda h, i: F.pmod(F.xxhash64(h, F.get(hashes, i + 1)), F.lit(buckets)))
    return F.concat(F.transform(hashes, lambda h: F.pmod(h, F.lit(buckets))), pairs)


def measured(rows: DataFrame, buckets: int) -> DataFrame:
    """``rows`` (_row, doc_id, said) as _row, doc_id, n_words .. base_failed, buckets (of the n-grams): every text is split and hashed once."""
    said = F.col("said")
    lines = F.filter(F.split(said, "\n"), lambda x: F.length(F.translate(x, SPACES, "")) > 0)
    out = rows.withColumn("words", words_of(said)).withColumn("hashes", hashes_of(F.col("words")))
    out = out.withColumn("lines", lines)
    last = F.greatest(F.size("hashes") - (WINDOW - 1), F.lit(0))
    windows = F.transform(F.slice("hashes", 1, last), lambda h, i: F.struct(F.xxhash64(h, *[F.get("hashes", i + k) for k in range(1, WINDOW)]).alias("h"), i.alias("i")))
    out = out.withColumn("sorted", F.sort_array(windows))
    same = lambda s, j, k: s["h"].eqNullSafe(F.get("sorted", j + k)["h"])
    places = F.sort_array(F.transform(F.filter("sorted", lambda s, j: same(s, j, -1) | same(s, j, 1)), lambda s: s["i"]))
    # windows found twice or more, by place: each covers the words that the one before doesn't
    start = F.struct(F.lit(-WINDOW).alias("i"), F.lit(0).cast("long").alias("n"))
    covered = F.aggregate(places, start, lambda a, i: F.struct(i.alias("i"), (a["n"] + F.least(F.lit(WINDOW), i - a["i"])).alias("n")), lambda a: a["n"])
    out = out.select(
        "_row",
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.translate(said, SPACES, "")).cast("long").alias("word_chars"),
        (F.length(said) - F.length(F.translate(said, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        covered.alias("n_repeat_words"),
        F.transform(buckets_of(F.col("hashes"), buckets), lambda b: b.cast("int")).alias("buckets"),
    )
    return out.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))


def log_ratios(measures: DataFrame, targets: DataFrame, buckets: int) -> DataFrame:
    """One row, ``ratios``: for each bucket the log of its smoothed share in the target over that in the corpus; all 0 without a target.

    ``measures``: doc_id, buckets; all of them count for the corpus, towards
    which the target is smoothed. ``targets``: the doc_id of the target's, whose
    number is bounded; these ids are broadcast.
    """
    flagged = measures.select("doc_id", "buckets").join(F.broadcast(targets.withColumn("target", F.lit(1))), "doc_id", "left")
    counts = flagged.select("target", F.explode("buckets").alias("bucket")).groupBy("bucket").agg(F.count("*").alias("raw"), F.count("target").alias("target"))
    every = measures.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(counts, "bucket", "left").na.fill(0, ["raw", "target"])
    # all buckets as one array: as many as the parameter says
    packed = every.agg(F.sort_array(F.collect_list(F.struct("bucket", "raw", "target"))).alias("c"), F.sum("raw").alias("raws"), F.sum("target").alias("targets"))
    share = lambda c: (c["raw"] + 1.0) / (F.col("raws") + float(buckets))
    lent = float(LENT * buckets)
    ratio = lambda c: F.log((c["target"] / share(c) + lent) / (F.col("targets") + lent))
    return packed.select(F.transform("c", lambda c: ratio(c).cast("float")).alias("ratios"))


def judge(docs: DataFrame, trusted: DataFrame, least: float = LEAST_RATIO, buckets: int = BUCKETS, target_docs: int = TARGET_DOCS, text: str = "text", keep: tuple[str, ...] | None = None) -> DataFrame:
    """``docs`` (doc_id, text and any others) with the counts, base_failed, ratio and kept; only columns of these names are replaced.

    Words part at ASCII white space; a null text has none. n_dup_lines: lines
    with a word that equal an earlier one. n_repeat_words: words in windows of
    five that stand twice or more in the text. base_failed: under ten words, or
    more than a fifth of the words repeat. ratio: mean log ratio of the text's
    hashed words and pairs (null without words). kept: not base_failed, and a
    ratio of ``least`` or more. Repeated rows get repeated verdicts; rows without
    a doc_id are judged like others but never trusted; without trusted documents
    every ratio is 0. ``target_docs``: trusted documents that the target is learnt
    from, at most. ``buckets``: hash buckets; an n-gram's bucket depends on nothing
    else. ``keep``: columns of ``docs`` to return, else all. What is counted in each text is written first, with these columns, so that a
    filter on the result repeats none of it.
    """
    made = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "ratio", "kept")
    targets = written(chosen_targets(trusted, target_docs), "targets")
    own = [c for c in (docs.columns if keep is None else keep) if c not in made]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("_row"), "doc_id", F.coalesce(F.col(text).cast("string"), F.lit("")).alias("said"))
    found = written(measured(rows, buckets), "measured")
    found = found.withColumn("ratios", log_ratios(found, targets, buckets).scalar())
    total = F.aggregate("buckets", F.lit(0.0), lambda a, b: a + F.get("ratios", b))
    found = found.withColumn("ratio", F.when(F.size("buckets") > 0, total / F.size("buckets")))
    found = found.withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("ratio") >= least, F.lit(False)))
    return found.select(*[F.col("_row")[c].alias(c) for c in own], *made)
