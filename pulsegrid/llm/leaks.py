"""Operator 9: benchmark decontamination.

Windows of a text as long as an item get a SimHash of their shingles. The
fingerprints of the items are indexed by blocks of bits: of ``m`` blocks one at
least differs in no more than an ``m``-th of the radius, so that the items
within the radius are among those that some block returns. Only these are
verified, by the exact similarity of weighted shingles.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import map_rows, written
from .hashing import PLAIN, U, shingles, words

WIDTH, PERCENT, RADIUS = 5, 80, 18
#: Blocks of a fingerprint: few and wide, so that a random item agrees with one in seven windows at the default radius.
BLOCKS = 4
#: Items that block values have been found to return, kept by a task.
KEPT = 4_000_000
#: Bytes of items that one index holds; more items are a further pass over the texts.
INDEX_BYTES = 8_000_000
#: Windows whose fingerprints are computed at a time.
CHUNK = 4096


class ItemIndex:
    """Items with their shingles' weights, their fingerprints, and for each block of bits the items by its value.

    ``often``: in how many items of the whole benchmark each shingle is, and how
    many items there are; else these items are the whole.
    """

    def __init__(
        self,
        items: list[tuple[int, str]],
        width: int = WIDTH,
        radius: int = RADIUS,
        often: tuple[dict[int, int], int] | None = None,
        blocks: int = BLOCKS,
    ):
        self.width, self.radius = width, radius
        hashed = [h for _, h in words([t.encode() for _, t in items], PLAIN)]
        kept = [k for k, h in enumerate(hashed) if len(h)]
        self.ids = np.array([items[k][0] for k in kept], np.int64)
        self.widths = np.array([min(width, len(hashed[k])) for k in kept], np.int64)
        sets = [shingles(hashed[k], width) for k in kept]
        self.sizes = np.array([len(s) for s in sets], np.int64)
        # a shingle of few items weighs more, in sixteenths so that sums are exact
        every = np.concatenate([np.unique(s) for s in sets]) if sets else np.zeros(0, U)
        self.known, seen = np.unique(every, return_counts=True)
        if often:
            seen = np.array([often[0].get(int(s), n) for s, n in zip(self.known.view(np.int64), seen)], np.int64)
        most = np.log((often[1] if often else len(kept)) + 1.0)
        self.weights = np.rint(16 * (1 + most - np.log(seen))).astype(np.int64)
        self.rare = int(np.rint(16 * (1 + most)))
        self.counts = [np.unique(s, return_counts=True) for s in sets]
        self.totals = np.array([int((self.weigh(u) * c).sum()) for u, c in self.counts], np.int64)
        self.prints = np.array([self.fingerprints(s, len(s))[0] for s in sets], U)
        # for each known shingle the items that have it
        owner = np.repeat(np.arange(len(sets)), [len(u) for u, _ in self.counts]) if sets else np.zeros(0, np.int64)
        shingle = np.searchsorted(self.known, np.concatenate([u for u, _ in self.counts])) if sets else owner
        order = np.argsort(shingle, kind="stable")
        self.owners, self.first = owner[order], np.searchsorted(shingle[order], np.arange(len(self.known) + 1))
        edges = [64 * k // blocks for k in range(blocks + 1)]
        self.blocks = [(U(lo), U((1 << (hi - lo)) - 1)) for lo, hi in zip(edges[:-1], edges[1:])]
        self.values = [self.prints >> lo & mask for lo, mask in self.blocks]
        self.returned: dict[tuple[int, int], np.ndarray] = {}
        self.held = 0

    def weigh(self, shingle: np.ndarray) -> np.ndarray:
        if not len(self.known):
            return np.full(len(shingle), self.rare, np.int64)
        at = np.minimum(np.searchsorted(self.known, shingle), len(self.known) - 1)
        return np.where(self.known[at] == shingle, self.weights[at], self.rare)

    def fingerprints(self, shingle: np.ndarray, size: int) -> np.ndarray:
        """SimHash of each run of ``size`` shingles: the sign of each bit's weighted sum, ones where it is above zero."""
        bits = np.unpackbits(shingle.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.int64) * 2 - 1
        total = np.zeros((len(shingle) + 1, 64), np.int64)
        np.cumsum(bits * self.weigh(shingle)[:, None], axis=0, out=total[1:])
        return np.packbits(total[size:] > total[:-size], axis=1, bitorder="little").view(U).ravel()

    def agreeing(self, block: int, value: int) -> np.ndarray:
        """Items whose block differs from the value in no more than the block's part of the radius; found once for each value."""
        found = self.returned.get((block, value))
        if found is None:
            if self.held > KEPT:
                self.returned, self.held = {}, 0
            found = np.flatnonzero(np.bitwise_count(self.values[block] ^ U(value)) <= self.radius // len(self.blocks))
            self.returned[block, value] = found
            self.held += len(found) + 16
        return found

    def candidates(self, prints: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Fingerprints and wanted items (places in both) that some block brings together."""
        column = np.full(len(self.prints), -1)
        column[wanted] = np.arange(len(wanted))
        met = np.zeros((len(prints), len(wanted)), bool)
        for k, (lo, mask) in enumerate(self.blocks):
            values, of = np.unique(prints >> lo & mask, return_inverse=True)
            agree = np.zeros((len(values), len(wanted)), bool)
            for v, value in enumerate(values.tolist()):
                cols = column[self.agreeing(k, value)]
                agree[v, cols[cols >= 0]] = True
            met |= agree[of]
        return np.nonzero(met)

    def near(self, prints: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the candidates those within the radius, with their distance."""
        row, col = self.candidates(prints, wanted)
        far = np.bitwise_count(prints[row] ^ self.prints[wanted[col]]).astype(np.int64)
        kept = far <= self.radius
        return row[kept], col[kept], far[kept]

    def similarity(self, item: int, window: np.ndarray) -> float:
        """Weighted shingles in both over those in either, with their counts; one that the item hasn't weighs as one of no item."""
        u, c = np.unique(window, return_counts=True)
        iu, ic = self.counts[item]
        _, a, b = np.intersect1d(u, iu, assume_unique=True, return_indices=True)
        weights = self.weigh(u[a])
        shared = int((weights * np.minimum(c[a], ic[b])).sum())
        own = int((weights * c[a]).sum()) + self.rare * int(c.sum() - c[a].sum())
        return shared / (own + int(self.totals[item]) - shared)

    def search(self, hashes: np.ndarray, percent: int) -> Iterator[tuple[int, int, int, float, int]]:
        """For each item found in a text: item, first word, words, similarity, distance; the most similar window, of equals the first."""
        for width in np.unique(self.widths):
            if len(hashes) < width:
                continue
            own = shingles(hashes, int(width))
            at = np.searchsorted(self.known, own)
            at[at == len(self.known)] = 0
            hits = np.flatnonzero(self.known[at] == own)
            if not len(hits):
                continue
            # a window without any shingle of an item has no similarity to it
            lo, hi = self.first[at[hits]], self.first[at[hits] + 1]
            place = np.repeat(hits, hi - lo)
            item = self.owners[np.repeat(lo, hi - lo) + np.arange(len(place)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo)]
            fits = self.widths[item] == width
            place, item = place[fits], item[fits]
            for size in np.unique(self.sizes[item]):
                of = self.sizes[item] == size
                wanted = np.unique(item[of])
                span = min(int(size), len(own))
                edge = np.zeros(len(own) + 1, np.int64)
                np.add.at(edge, np.maximum(place[of] - span + 1, 0), 1)
                np.add.at(edge, place[of] + 1, -1)
                starts = np.flatnonzero(np.cumsum(edge)[: len(own) - span + 1] > 0)
                best: dict[int, tuple] = {}
                for k in range(0, len(starts), CHUNK):
                    some = starts[k : k + CHUNK]
                    # runs of starts share the sums over what lies between
                    for run in np.split(some, np.flatnonzero(np.diff(some) > span) + 1):
                        prints = self.fingerprints(own[run[0] : run[-1] + span], span)[run - run[0]]
                        for r, c, far in zip(*(x.tolist() for x in self.near(prints, wanted))):
                            s, i = int(run[r]), int(wanted[c])
                            got = self.similarity(i, own[s : s + span])
                            if 100 * got >= percent - 1e-9 and (i not in best or got > best[i][2]):
                                best[i] = (s, span - 1 + int(width), got, far)
                for i, (s, n, got, d) in best.items():
                    yield i, s, n, got, d


def _search(batches: Iterator[dict], index: ItemIndex, percent: int) -> Iterator[dict]:
    for batch in batches:
        out: dict[str, list] = {k: [] for k in ("row", "item_id", "first_word", "n_words", "similarity", "distance")}
        for at, hashes in words(batch["text"], PLAIN):
            for i, s, n, got, d in index.search(hashes, percent) if len(index.ids) else ():
                for k, v in zip(out, (batch["row"][at], int(index.ids[i]), s, n, got, d)):
                    out[k].append(v)
        yield out


def _item_shingles(batches: Iterator[dict], width: int) -> Iterator[dict]:
    for batch in batches:
        sets = [np.unique(shingles(h, width)).view(np.int64) for _, h in words([t.encode() for t in batch["text"]], PLAIN)]
        yield {"share": np.repeat(batch["share"], [len(s) for s in sets]), "shingle": np.concatenate([*sets, np.zeros(0, np.int64)])}


def indexes(benchmark: DataFrame, width: int, radius: int, index_bytes: int) -> tuple[int, Iterator[ItemIndex]]:
    """How many indexes of about ``index_bytes`` the items need, and these, each made when it is asked for."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.lower("text").alias("text"))
    items = items.where("item_id is not null and text is not null").distinct()
    size, count = items.agg(F.sum(F.octet_length("text")), F.count("*")).first()
    passes = -(-(size or 0) // index_bytes) or 1
    items = items.withColumn("share", F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)).cast("int"))
    # shingles are weighed by the whole benchmark, however many passes there are
    shingled = map_rows(items, lambda b: _item_shingles(b, width), "share int, shingle long")
    often = shingled.groupBy("shingle").agg(F.count("*").alias("n"))

    def one(k: int) -> ItemIndex:
        # bounded: a share of the items of about index_bytes, and their shingles
        share = items.where(F.col("share") == k).orderBy("item_id", "text").collect()
        weights = shingled.where(F.col("share") == k).select("shingle").distinct().join(often, "shingle").collect()
        return ItemIndex([(r.item_id, r.text) for r in share], width, radius, ({r.shingle: r.n for r in weights}, count))

    return passes, map(one, range(passes))


def lowered():
    return F.lower(F.coalesce(F.col("text").cast("string"), F.lit(""))).cast("binary").alias("text")


def find_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    width: int = WIDTH,
    percent: int = PERCENT,
    radius: int = RADIUS,
    index_bytes: int = INDEX_BYTES,
    keep: tuple[str, ...] = ("doc_id",),
) -> DataFrame:
    """The columns ``keep``, then item_id, first_word, n_words, similarity, distance for each text and each item that it contains.

    ``docs``: text and the columns ``keep``; ``benchmark``: item_id, text. Words
    are runs of letters and digits of any script, upper case as lower; a shingle
    is ``width`` words, or the whole of a shorter item. A text contains an item
    if the window of as many words that is most like it (of equals the first)
    reaches ``percent`` hundredths of weighted similarity. Null and wordless
    texts and items, and items without an id, are in nothing; texts without a
    doc_id take part like others. Repeated rows give repeated results. Items
    beyond ``index_bytes`` are searched in further passes, one after the other,
    each with an index of about that size, which is all that the tasks are sent.
    """
    passes, made = indexes(benchmark, width, radius, index_bytes)
    texts = docs.select(F.struct(*keep).alias("row"), lowered())
    kind = texts.schema["row"].dataType.simpleString()
    schema = f"row {kind}, item_id long, first_word long, n_words long, similarity double, distance int"
    names = ("item_id", "first_word", "n_words", "similarity", "distance")
    found = (map_rows(texts, lambda b, index=index: _search(b, index, percent), schema).select("row.*", *names) for index in made)
    # with more than one, each pass is run and written before the index of the next is made
    return next(found) if passes == 1 else reduce(DataFrame.unionByName, [written(f, "leaks") for f in found])


def without_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    width: int = WIDTH,
    percent: int = PERCENT,
    radius: int = RADIUS,
    index_bytes: int = INDEX_BYTES,
) -> DataFrame:
    """The rows of ``docs`` (text and any others) whose text contains no item; see ``find_leaks``.

    Each row is judged by itself: nothing is joined back, so repeated, shared
    and missing doc_ids change nothing.
    """
    passes, made = indexes(benchmark, width, radius, index_bytes)
    for k, index in enumerate(made):

        def clean(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for b in batches:
                texts = b.column(1).to_pylist()
                kept = [not len(index.ids) or next(index.search(h, percent), None) is None for _, h in words(texts, PLAIN)]
                yield b.select(["row"]).filter(pa.array(kept, pa.bool_()))

        rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), lowered())
        docs = rows.mapInArrow(clean, StructType([rows.schema["row"]])).select("row.*")
        if k < passes - 1:
            docs = written(docs, "clean")
    return docs
