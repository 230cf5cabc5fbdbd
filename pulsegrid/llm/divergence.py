"""Audit of sources: how far apart their words are, from wide vectors of term counts.

Each kept term of a language becomes one array of counts, indexed by the
language's sources; array functions turn it into probabilities and into the
contributions of all pairs of sources, which partial aggregation sums.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import join_by_size, map_rows, text_bytes, written

#: Probabilities are whole numbers of a billionth; PRIOR is added to each count.
SCALE, PRIOR = 1_000_000_000, 5
#: Entries that a task holds before it gives its counts away.
HELD = 200_000

#: Bytes of A-Z as a-z, of other ASCII but a-z as spaces: what is left between spaces are terms.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def _counts(batches: Iterator[dict], held: int) -> Iterator[dict]:
    """Partial counts of a task: for each language, source and term the occurrences and the documents."""
    groups: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    size = 0

    def given() -> Iterator[dict]:
        for (lang, source), (times, docs) in groups.items():
            terms = list(times)
            n = len(terms)
            yield {"lang": [lang] * n, "source": [source] * n, "term": [t.decode() for t in terms], "c": list(times.values()), "docs": [docs[t] for t in terms]}

    for batch in batches:
        for lang, source, text in zip(batch["lang"], batch["source"], batch["text"]):
            if (lang, source) not in groups:
                groups[lang, source] = Counter(), Counter()
            times, docs = groups[lang, source]
            terms = text.translate(_FOLD).split()
            size -= len(times)
            times.update(terms)
            docs.update(set(terms))
            size += len(times)
            if size > held:
                yield from given()
                groups, size = {}, 0
    yield from given()


def term_counts(docs: DataFrame, held: int = HELD) -> DataFrame:
    """lang, source, term, c, docs: partial counts over ``docs`` (lang, source, text), several rows a term, to be summed."""
    rows = docs.select("lang", "source", text_bytes().alias("text"))
    return map_rows(rows, lambda b: _counts(b, held), "lang string, source string, term string, c long, docs long")


def _chance(count: Column, total: Column, kinds: Column) -> Column:
    """1 + floor(SCALE * (count + PRIOR) / (total + PRIOR * kinds)), in decimals, as the product may not fit a long."""
    whole = lambda c, digits: c.cast(f"decimal({digits},0)")
    up = whole(F.lit(SCALE), 10) * (whole(count, 19) + whole(F.lit(PRIOR), 1))
    down = whole(total, 19) + whole(F.lit(PRIOR), 1) * whole(kinds, 12)
    return F.lit(1).cast("long") + F.call_function("div", up, down)


def audit_sources(docs: DataFrame, least_docs: int = 30, top: int = 50) -> DataFrame:
    """lang, source, part, item, value, rank: how far each source of ``docs`` (lang, source, text) is from others and from its language.

    A language keeps the terms that at least ``least_docs`` of its rows hold. A
    term's chance in a source or language is in billionths, smoothed by PRIOR.
    Part ``pair``: each other source of the language, by the summed difference of
    chances over all kept terms. Part ``term``: the kept terms that stand in the
    source and are likelier there than in the language, the ``top`` of them.
    Ranks go by value, falling, then by item in the order of UTF-8.

    Null text, lang and source count as empty. Each row is a document, repeated
    ones too. A source without terms, or a language without kept ones, has its
    pairs (value 0 without kept terms) and no terms; one source has no pairs.
    """
    named = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")], F.col("text"))
    one = term_counts(named).groupBy("lang", "term", "source").agg(F.sum("c").alias("c"), F.sum("docs").alias("docs"))
    terms = one.groupBy("lang", "term").agg(F.sum("c").alias("c"), F.sum("docs").alias("docs"), F.collect_list(F.struct("source", "c")).alias("of"))
    kept = written(terms.where(F.col("docs") >= least_docs).drop("docs"), "terms")
    # axes: of each language its sources in order, with their totals; n: how many terms it has
    totals = kept.select("lang", F.inline("of")).groupBy("lang", "source").agg(F.sum("c").alias("total"))
    groups = named.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").select("lang", F.struct("source", F.coalesce("total", F.lit(0).cast("long")).alias("total")).alias("s"))
    sizes = kept.groupBy("lang").agg(F.count("*").alias("n"), F.sum("c").alias("total"))
    axes = groups.groupBy("lang").agg(F.sort_array(F.collect_list("s")).alias("sources")).join(sizes, "lang", "left")
    axes = written(axes.select("lang", "sources", F.coalesce("n", F.lit(0).cast("long")).alias("n"), F.col("total").alias("whole")), "axes")
    counted = F.map_from_entries("of")
    wide = join_by_size(kept, axes, "lang").select(
        "lang", "term", "sources", _chance(F.col("c"), F.col("whole"), F.col("n")).alias("q"),
        F.transform("sources", lambda s: F.coalesce(F.try_element_at(counted, s["source"]), F.lit(0).cast("long"))).alias("counts"), "n",
    )
    wide = wide.withColumn("p", F.zip_with("counts", "sources", lambda c, s: _chance(c, s["total"], F.col("n"))))
    return _pairs(wide, axes).unionByName(_terms(wide, top))


def _pairs(wide: DataFrame, axes: DataFrame) -> DataFrame:
    first = wide.select("lang", "p", F.posexplode("p").alias("a", "pa"))
    both = first.select("lang", "a", "pa", F.explode(F.transform(F.slice("p", F.col("a") + 2, F.size("p")), lambda pb, k: F.struct((k + F.col("a") + 1).alias("b"), F.abs(pb - F.col("pa")).alias("f")))).alias("o"))
    summed = both.groupBy("lang", "a", F.col("o.b").alias("b")).agg(F.sum("o.f").alias("f"))
    # all pairs of sources are wanted, also where there are no terms
    order = F.sequence(F.lit(0), F.size("sources") - 1)
    each = axes.select("lang", "sources", F.explode(order).alias("x")).select("lang", "sources", "x", F.explode(order).alias("y")).where("x <> y")
    each = each.select("lang", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), F.get("sources", F.col("x"))["source"].alias("source"), F.get("sources", F.col("y"))["source"].alias("item"))
    return _ranked(each.join(summed, ["lang", "a", "b"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("f", F.lit(0).cast("long")).alias("value")))


def _terms(wide: DataFrame, top: int) -> DataFrame:
    rows = wide.select("lang", "term", "q", F.inline(F.arrays_zip(F.col("sources.source").alias("source"), F.col("counts").alias("c"), F.col("p").alias("p"))))
    rows = rows.toDF("lang", "item", "q", "source", "c", "p").where("c > 0 and p > q")
    return _ranked(rows.select("lang", "source", F.lit("term").alias("part"), "item", (F.col("p") - F.col("q")).alias("value"))).where(F.col("rank") <= top)


def _ranked(rows: DataFrame) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))
