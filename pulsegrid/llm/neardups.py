"""Operator 2: near-duplicates by one-permutation MinHash.

Each distinct shingle set is hashed once into bins; empty bins borrow from
random filled ones (optimal densification). Bands of bins are buckets, each
bucket's candidates are the edges from one hub to its members, and a link
counts only if the full sets confirm it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import groupby

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_written, map_rows, text_bytes, written
from .graphs import components
from .hashing import BASE, SPACE, U, mix, powers, shingles, words

BINS, BANDS = 128, 32
#: Members of a hub that one task compares at a time.
SALTED = 256
#: Of the bins, the part that must agree for a pair to be confirmed after the first stars: at a similarity of 0.8 it is five standard errors lower.
AGREEING = 0.6
#: Buckets of up to this many members are paired by a join; fuller ones by blocks, pair for pair as well.
PAIRED = 100
#: Members of a fuller bucket in one block.
BLOCK = 4096
#: Hashes of doc_ids that ``among`` tells apart.
SLOTS = 1 << 25
#: For each bin, the order in which it looks for a filled one to borrow from.
_BORROW = np.array([np.random.default_rng(1000 + k).permutation(BINS) for k in range(BINS)])
_EDGES = np.arange(BINS + 1, dtype=np.float64)


def signature(distinct: np.ndarray) -> np.ndarray:
    """Smallest hash of each bin, from sorted distinct hashes; a bin is the hash's top bits. At least one hash."""
    bins = (distinct >> U(64 - BINS.bit_length() + 1)).astype(np.int64)
    first = np.searchsorted(bins, np.arange(BINS + 1))
    filled = first[1:] > first[:-1]
    out = np.zeros(BINS, U)
    out[filled] = distinct[first[:-1][filled]]
    empty = np.flatnonzero(~filled)
    if len(empty):
        order = _BORROW[empty]
        out[empty] = out[order[np.arange(len(empty)), filled[order].argmax(1)]]
    return out


def bands_of(sig: np.ndarray) -> np.ndarray:
    """A hash for each run of bins, and of its place."""
    rows = BINS // BANDS
    return mix((sig.reshape(BANDS, rows) * powers(BASE, rows + 1)[1:]).sum(1, dtype=U) + np.arange(BANDS, dtype=U) * BASE)


def _sketch(batches: Iterator[dict], width: int) -> Iterator[dict]:
    for batch in batches:
        out: dict[str, list] = {k: [] for k in ("n_shingles", "set_a", "set_b", "bands", "bins")}
        for _, hashes in words(batch["text"], SPACE):
            distinct = np.unique(shingles(hashes, width))
            out["n_shingles"].append(len(distinct))
            if len(distinct):
                sig = signature(distinct)
                out["set_a"].append(int(mix(distinct + U(1)).sum(dtype=U).astype(np.int64)))
                out["set_b"].append(int(mix(distinct ^ BASE).sum(dtype=U).astype(np.int64)))
                out["bands"].append(bands_of(sig).astype(np.int64))
                out["bins"].append(mix(sig).astype(np.uint8).tobytes())
            else:
                for k in ("set_a", "set_b", "bands", "bins"):
                    out[k].append(None)
        yield {"doc_id": batch["doc_id"]} | out


def sketches(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, n_shingles, set_a and set_b (fingerprint of the set), bands, bins (a byte each); nulls for an empty set."""
    rows = docs.select("doc_id", text_bytes().alias("text"))
    return map_rows(rows, lambda b: _sketch(b, width), "doc_id long, n_shingles long, set_a long, set_b long, bands array<bigint>, bins binary")


def _confirm(batches: Iterator[dict], width: int, percent: int) -> Iterator[dict]:
    """Hubs, each followed by its members: the pairs whose full sets are similar enough."""
    hub, held, led = None, [], False
    for batch in batches:
        found: dict[str, list] = {"a": [], "b": []}
        sets = words(batch["text"], SPACE)
        for (at, hashes), a, doc, member in zip(sets, batch["hub"], batch["doc_id"], batch["member"]):
            own = np.unique(shingles(hashes, width))
            if not member:
                held = [*held, own] if led and hub == a else [own]
                hub, led = a, True
                continue
            led = False
            for other in held if a == hub and len(own) else ():
                shared = len(np.intersect1d(other, own, assume_unique=True))
                if 100 * shared >= percent * (len(other) + len(own) - shared):
                    found["a"].append(a)
                    found["b"].append(doc)
                    break
        yield found


def marked(docs: DataFrame, ids: DataFrame, how: str = "left") -> DataFrame:
    """``docs`` with ``_met``: true where doc_id is in ``ids`` (doc_id), and for few others, those whose hash is that of one.

    Before a join that needs some texts alone, so that others aren't shuffled.
    A bit for each of ``SLOTS`` hashes is broadcast, 4 MB whatever the corpus.
    """
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(SLOTS))
    bits = ids.groupBy(F.bitmap_bucket_number(slot).alias("_part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("_bits"))
    at = F.bitmap_bit_position(slot).cast("int")
    byte = F.conv(F.hex(F.substring("_bits", F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    met = docs.withColumn("_part", F.bitmap_bucket_number(slot)).join(F.broadcast(bits), "_part", how)
    bit = F.call_function("shiftright", byte, at % 8).bitwiseAND(F.lit(1)) == 1
    return met.select(*docs.columns, F.coalesce(bit, F.lit(False)).alias("_met"))


def among(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose doc_id is in ``ids`` (doc_id), and few others, see ``marked``."""
    return marked(docs, ids, "inner").where("_met").select(*docs.columns)


def only(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose doc_id is in ``ids`` (doc_id), no others; texts of few others are shuffled, see ``among``.

    An inner join: a semi join is moved below the one that leaves the others
    out, and shuffles all texts as soon as ``ids`` are too many for a broadcast.
    """
    return among(docs, ids).join(ids.distinct().hint("merge"), "doc_id").select(*docs.columns)


def confirmed(pairs: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Of ``pairs`` (hub, doc_id), distinct, those similar on full sets, as a and b.

    A hub's members are dealt out in salted groups of about ``SALTED``, each led
    by a copy of the hub's text, and stream past it: no group is held.
    """
    salts = written(pairs.groupBy("hub").agg(F.ceil(F.count("*") / SALTED).cast("int").alias("salts")), "salts")
    texts = among(docs, salts.select(F.col("hub").alias("doc_id")).union(pairs.select("doc_id"))).select("doc_id", text_bytes().alias("text"))
    led = salts.select("hub", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col("hub").alias("doc_id"), F.lit(False).alias("member"))
    members = pairs.join(salts, "hub").select("hub", F.pmod(F.xxhash64("doc_id"), "salts").cast("int").alias("salt"), "doc_id", F.lit(True).alias("member"))
    # merged whatever the sizes, so that a small table's plan is a large one's
    rows = led.unionByName(members).join(texts.hint("merge"), "doc_id").repartition("hub", "salt").sortWithinPartitions("hub", "salt", "member", "doc_id")
    return map_rows(rows.select("hub", "doc_id", "member", "text"), lambda b: _confirm(b, width, percent), "a long, b long")


def _agree(batches: Iterator[dict], least: int) -> Iterator[dict]:
    for batch in batches:
        if batch["a"]:
            one, two = (np.frombuffer(b"".join(batch[k]), np.uint8).reshape(-1, BINS) for k in ("bins_a", "bins_b"))
            near = np.flatnonzero((one == two).sum(1) >= least)
            yield {"hub": [batch["a"][k] for k in near], "doc_id": [batch["b"][k] for k in near]}


def _low(bucket: int) -> int:
    """The lower half of a bucket's number, signed."""
    return (bucket + (1 << 31)) % (1 << 32) - (1 << 31)


class _Block:
    """Members of a bucket in numpy: ids, components, bins bin by bin, bands, and the sets one after the other."""

    def __init__(self, batch: dict, lo: int, hi: int):
        bucket = batch["bucket"][lo]
        bands = np.frombuffer(b"".join(batch["bands"][lo:hi]), np.int32).reshape(-1, BANDS)
        # a document of several sets stands in the bucket with one of them
        own = np.flatnonzero((bands == _low(bucket)).any(1))
        self.bands = bands[own]
        self.ids, self.parts = (np.array(batch[k][lo:hi], np.int64)[own] for k in ("doc_id", "component"))
        self.bins = np.ascontiguousarray(np.frombuffer(b"".join(batch["bins"][lo:hi]), np.uint8).reshape(-1, BINS)[own].T)
        self.sets = [np.frombuffer(batch["small"][lo + k], np.uint32) for k in own.tolist()]
        self.sizes = np.array([len(x) for x in self.sets], np.int64)


class _Forest:
    """Components that a task has joined."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        while (y := self.up.get(x, x)) != x:
            self.up[x] = self.up.get(y, y)
            x = y
        return x


def _joins(one: _Block, other: _Block, bucket: int, least: int, percent: int, forest: _Forest) -> Iterator[tuple[int, int]]:
    """Links between two blocks (of a block with itself each once) that join components: of those that others imply none is given."""
    for k in range(len(one.ids)):
        lo = k + 1 if one is other else 0
        agree = (other.bins[:, lo:] == one.bins[:, k : k + 1]).sum(0, dtype=np.uint8)
        near = np.flatnonzero((agree >= least) & (other.parts[lo:] != one.parts[k]))
        if not len(near):
            continue
        # a pair is seen to in the first bucket that both are in
        shared = other.bands[near + lo] == one.bands[k]
        near = near[one.bands[k][shared.argmax(1)] == _low(bucket)]
        near = near[np.argsort(-agree[near].astype(np.int64), kind="stable")] + lo
        own = forest.root(int(one.parts[k]))
        near = np.array([x for x in near.tolist() if forest.root(int(other.parts[x])) != own], np.int64)
        if not len(near):
            continue
        flat = np.concatenate([other.sets[x] for x in near])
        at = np.minimum(np.searchsorted(one.sets[k], flat), one.sizes[k] - 1)
        common = np.add.reduceat(one.sets[k][at] == flat, np.concatenate([[0], np.cumsum(other.sizes[near])[:-1]]), dtype=np.int64)
        alike = 100 * common >= percent * (other.sizes[near] + one.sizes[k] - common)
        for x in near[alike].tolist():
            a, b = forest.root(int(one.parts[k])), forest.root(int(other.parts[x]))
            if a != b:
                forest.up[max(a, b)] = min(a, b)
                yield int(min(one.ids[k], other.ids[x])), int(max(one.ids[k], other.ids[x]))


def _across(batches: Iterator[dict], least: int, percent: int) -> Iterator[dict]:
    """Pairs of blocks (bucket, i, j), each with its strays first; with j 0 the strays meet each other too."""
    at, held, forest = None, [], _Forest()
    for batch in batches:
        found: dict[str, list] = {"hub": [], "doc_id": []}
        keys = list(zip(batch["bucket"], batch["i"], batch["j"], batch["beside"]))
        for key, run in groupby(range(len(keys)), keys.__getitem__):
            run = list(run)
            block = _Block(batch, run[0], run[-1] + 1)
            if key[:3] != at:
                at, held, forest = key[:3], [], _Forest()
            if not key[3]:
                held = [*held, block]
            for other in held if key[3] or key[2] == 0 else ():
                for a, b in _joins(other, block, key[0], least, percent, forest):
                    found["hub"].append(a)
                    found["doc_id"].append(b)
        yield found


def _small_sets(batches: Iterator[dict], width: int) -> Iterator[dict]:
    """Bands, bins and the set itself, of each hash its lower half: enough to tell two sets' likeness but for one pair in some 100,000."""
    for batch in batches:
        out: dict[str, list] = {k: [] for k in ("doc_id", "bands", "bins", "small")}
        for part in _sketch(iter([batch]), width):
            kept = [k for k, b in enumerate(part["bands"]) if b is not None]
            sets = {at: np.unique(shingles(h, width).astype(np.uint32)) for at, h in words(batch["text"], SPACE)}
            for k in kept:
                out["doc_id"].append(part["doc_id"][k])
                out["bands"].append(part["bands"][k].astype(np.int32).tobytes())
                out["bins"].append(part["bins"][k])
                out["small"].append(sets[k].tobytes())
        yield out


def small_sets(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, bands, bins, small (all packed) of each text that has words."""
    rows = docs.select("doc_id", text_bytes().alias("text"))
    return map_rows(rows, lambda b: _small_sets(b, width), "doc_id long, bands binary, bins binary, small binary").distinct()


def across(fuller: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """hub, doc_id: links in a bucket, of which one is a stray, that join different components; those that these imply are left out.

    ``fuller``: bucket, doc_id, component, main. A bucket's strays (not of its
    main component) and its other members are dealt into blocks of about
    ``BLOCK``; each block of strays meets all others, a pair of blocks at a time.
    A task compares bins, then sets, and gives no more links than it has members.
    """
    rows = fuller.withColumn("stray", F.col("component") != F.col("main"))
    blocks = lambda which: F.ceil(F.count_if(which) / BLOCK).cast("int")
    many = rows.groupBy("bucket").agg(
        blocks(F.col("stray")).alias("strays"),
        F.greatest(F.lit(1), blocks(~F.col("stray"))).alias("mains"),
    )
    of_kind = F.when(F.col("stray"), F.col("strays")).otherwise(F.col("mains"))
    rows = rows.join(written(many, "many"), "bucket")
    rows = rows.withColumn("own", F.pmod(F.xxhash64("doc_id"), of_kind).cast("int"))
    own, strays, mains, stray = (F.col(c) for c in ("own", "strays", "mains", "stray"))
    # a stray leads its block against the main ones and the stray ones after it
    leads = F.filter(F.sequence(F.lit(0), mains + strays - 1), lambda j: stray & ((j < mains) | (j - mains > own)))
    meets = F.filter(F.sequence(F.lit(0), strays - 1), lambda i: ~stray | (i < own))
    places = F.concat(
        F.transform(leads, lambda j: F.struct(own.alias("i"), j.alias("j"), F.lit(False).alias("beside"))),
        F.transform(meets, lambda i: F.struct(i.alias("i"), F.when(stray, mains + own).otherwise(own).alias("j"), F.lit(True).alias("beside"))),
    )
    sets = written(small_sets(only(docs, fuller.select("doc_id")), width), "sets")
    member = ("doc_id", "component", "bands", "bins", "small")
    dealt = rows.join(sets, "doc_id").select("bucket", F.explode(places).alias("p"), *member).select("bucket", "p.*", *member)
    dealt = dealt.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "beside", "doc_id")
    return map_rows(dealt, lambda b: _across(b, int(AGREEING * BINS), percent), "hub long, doc_id long")


SET = ("set_a", "set_b", "n_shingles")


def representatives(own: DataFrame) -> DataFrame:
    """Of sketches, the classes: a set, first (its smallest doc_id), bands and bins of one document for each."""
    some = own.where("set_a is not null and doc_id is not null")
    # equal sets have equal bands and bins, so that any row's will do
    return written(some.groupBy(*SET).agg(F.min("doc_id").alias("first"), F.first("bands").alias("bands"), F.first("bins").alias("bins")), "classes")


def bucket_members(chosen: DataFrame) -> tuple[DataFrame, DataFrame]:
    """bucket, doc_id, n of buckets with two members or more; and bucket, hub, n of each.

    The hub of a bucket is the member whose buckets are fullest: the text that
    its copies were made from.
    """
    banded = chosen.select("doc_id", F.explode("bands").alias("bucket"))
    sizes = written(banded.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"), "sizes")
    # a document of several sets may stand in a bucket with more than one of them
    members = written(banded.join(sizes, "bucket").distinct(), "members")
    fullness = members.groupBy("doc_id").agg(F.sum("n").alias("fullness"))
    top = F.max(F.struct("fullness", (-F.col("doc_id")).alias("minus")))
    hubs = members.join(fullness, "doc_id").groupBy("bucket").agg(top.alias("top"), F.first("n").alias("n"))
    hubs = written(hubs.select("bucket", (-F.col("top.minus")).alias("hub"), "n"), "hubs")
    drop_written(sizes)
    return members, hubs


def beyond_hubs(members: DataFrame, hubs: DataFrame, groups: DataFrame) -> DataFrame:
    """bucket, doc_id, n, component, main of the members, hubs left out, of buckets that still hold several components; main is the hub's."""
    named = members.join(groups.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    named = written(named.select("bucket", "doc_id", F.coalesce("component", "doc_id").alias("component")), "named")
    mixed = named.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("bucket")
    of_hub = named.select("bucket", F.col("doc_id").alias("hub"), F.col("component").alias("main"))
    hub_of = written(hubs.join(mixed, "bucket").join(of_hub, ["bucket", "hub"]), "mixed")
    rest = named.join(hub_of, "bucket").where("doc_id <> hub")
    rest = written(rest.select("bucket", "doc_id", "n", "component", "main"), "rest")
    drop_written(named, hub_of)
    return rest


def crossing(rest: DataFrame, chosen: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """hub, doc_id: pairs past the hubs, in one bucket but of different components, that are to be confirmed.

    In buckets of up to ``PAIRED`` members by a join, where bins agree; fuller
    ones, whose work grows with strays times members, a pair of blocks at a time.
    """
    small = rest.where(F.col("n") <= PAIRED)
    strays = small.where("component <> main").select("bucket", F.col("doc_id").alias("a"), F.col("component").alias("of_a"), "main")
    others = small.select("bucket", F.col("doc_id").alias("b"), F.col("component").alias("of_b"))
    # two strays once, a stray and a member of the hub's component once
    once = (F.col("of_b") == F.col("main")) | (F.col("a") < F.col("b"))
    pairs = strays.join(others, "bucket").where((F.col("of_a") != F.col("of_b")) & once).select("a", "b").distinct()
    # a document of several sets has several rows of bins
    bins = written(chosen.select("doc_id", "bins").distinct(), "bins")
    side = lambda k: bins.select(F.col("doc_id").alias(k), F.col("bins").alias(f"bins_{k}"))
    beside = pairs.join(side("a"), "a").join(side("b"), "b")
    near = map_rows(beside, lambda b: _agree(b, int(AGREEING * BINS)), "hub long, doc_id long")
    return written(near.unionByName(across(rest.where(F.col("n") > PAIRED), docs, width, percent)).distinct(), "crossing")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of ``docs`` (doc_id, text).

    Words part at ASCII white space, A-Z count as a-z; a set is the distinct
    ``width``-word shingles, or the whole sequence of fewer words. Sets are
    linked at a similarity of ``percent`` hundredths or more. component_id: the
    smallest doc_id that links reach; kept: whether that is the row's own. Null
    or wordless texts have an empty set and are linked with nothing. Rows that
    share a doc_id count as one document with several sets; rows without a
    doc_id have no component and are not kept. Other columns are ignored.
    """
    return _judged(docs, width, percent)[0]


def _judged(docs: DataFrame, width: int, percent: int) -> tuple[DataFrame, tuple[DataFrame, ...]]:
    """``near_duplicates``, and the written tables that it reads when it is computed."""
    docs = docs.select("doc_id", "text")
    own = written(sketches(docs, width), "sketches")
    classes = representatives(own)
    chosen = classes.select(F.col("first").alias("doc_id"), "set_a", "bands", "bins")
    members, hubs = bucket_members(chosen)
    stars = members.join(hubs.drop("n"), "bucket").where("doc_id <> hub").select("hub", "doc_id").distinct()
    links = written(confirmed(written(stars, "stars"), docs, width, percent), "links")
    # what a hub isn't linked with may be linked with other members, past the hub
    near = crossing(beyond_hubs(members, hubs, components(links)), chosen, docs, width, percent)
    groups = components(links.unionByName(confirmed(near, docs, width, percent)))
    # a set may have most rows: by a hash, then by the set itself
    key = F.xxhash64(*SET).alias("key")
    found = classes.select(*SET, "first").join(groups.select(F.col("node").alias("first"), "component"), "first", "left")
    found = written(found.select(key, *[F.col(c).alias(f"_{c}") for c in SET], F.coalesce("component", "first").alias("component_id")), "found")
    drop_written(classes, members, hubs)
    rows = own.where("doc_id is not null and set_a is not null").select("doc_id", *SET, key)
    same = reduce(Column.__and__, [F.col(c) == F.col(f"_{c}") for c in SET])
    linked = rows.join(found, "key").where(same).select("doc_id", "n_shingles", "component_id")
    alone = own.where("doc_id is null or set_a is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False))), (own, found)


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` (doc_id, text and any others) that stay when of each group of near-duplicates one does.

    The one of the smallest doc_id stays. Rows are told apart by doc_id and
    text: equal ones stay once, of those the first by a hash of their other
    columns. A row without a doc_id, and of a doc_id with several texts all but
    the one of the smallest hash, are documents of their own that come after all
    others. Rows without words are in no group and stay.
    """
    rows = docs.select(F.struct(*docs.columns).alias("_doc"), F.col("doc_id").cast("long").alias("_id"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("_hash", F.xxhash64("text"))
    hashes = rows.where("_id is not null").groupBy("_id").agg(F.min("_hash").alias("_least"), F.max("_hash").alias("_most"))
    clashing = written(hashes.where("_least <> _most").drop("_most"), "clashing")
    own = F.col("_id").isNotNull()
    if not clashing.isEmpty():
        named = rows.where("_id is not null").join(clashing, "_id", "left")
        rows = named.unionByName(rows.where("_id is null"), allowMissingColumns=True)
        own = own & F.coalesce(F.col("_hash") == F.col("_least"), F.lit(True))
    far = F.shiftrightunsigned(F.xxhash64("_id", "text"), 2).bitwiseOR(F.lit(1 << 62))
    rows = rows.select("_doc", "text", F.when(own, F.col("_id")).otherwise(far).alias("_key"))
    judged, read = _judged(rows.select(F.col("_key").alias("doc_id"), "text"), width, percent)
    # keys that go or repeat; the rows of all others stay as they are and aren't shuffled
    judged = judged.groupBy("doc_id").agg(F.max("kept").alias("kept"), F.count("*").alias("n"))
    odd = written(judged.where("not kept or n > 1").select("doc_id", "kept"), "odd")
    drop_written(*read)
    return one_of_each(rows.select(F.col("_key").alias("doc_id"), "_doc"), odd, [c for c in docs.columns if c != "text"]).select("_doc.*")


def one_of_each(rows: DataFrame, odd: DataFrame, columns: list[str]) -> DataFrame:
    """``_doc`` of ``rows`` (doc_id, _doc), one for each doc_id: the first by a hash of ``columns`` of _doc.

    ``odd`` (doc_id, kept) lists all that repeat or aren't kept; the latter are left out.
    """
    others = F.xxhash64(F.to_json(F.struct(*[F.col("_doc")[c].alias(f"c{k}") for k, c in enumerate(columns)])))
    rows = marked(rows, odd.select("doc_id"))
    first = rows.where("_met").groupBy("doc_id").agg(F.min_by("_doc", others).alias("_doc"))
    first = first.join(odd.hint("merge"), "doc_id", "left").where(F.coalesce("kept", F.lit(True)))
    return rows.where("not _met").select("_doc").unionByName(first.select("_doc"))
