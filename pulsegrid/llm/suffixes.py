"""Operator 10: removal of repeated passages, found on Burrows-Wheeler transforms.

Each string of ``least`` bytes is keyed by the smallest hash of the short grams
in it, so that equal strings have one key wherever they stand. Runs of strings
with one key are fragments; those whose key stands once are done. The rest are
sorted key by key: on the Burrows-Wheeler transform of a block of fragments,
intervals are extended backwards breadth first, which gives common prefixes in
increasing length, and the search stops at ``least``: neighbours that are still
not told apart are repeats.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_by_size, map_rows, text_bytes, written
from .hashing import _INVERSE, BASE, LETTER, U, mix, powers

LEAST = 200
GRAM = 32
#: Bytes of fragments that one transform is made of (its arrays fit in a core's cache), and those of one key beyond which its fragments are split.
BLOCK, LARGEST_KEY = 200_000, 4_000_000


def gram_hashes(buf: np.ndarray, gram: int) -> np.ndarray:
    total = np.zeros(len(buf) + 1, U)
    np.cumsum(LETTER[buf] * powers(BASE, len(buf)), out=total[1:])
    return mix((total[gram:] - total[:-gram]) * powers(_INVERSE, len(buf) + 1)[: len(buf) + 1 - gram])


def sliding(values: np.ndarray, width: int, least: bool) -> np.ndarray:
    """Least (or greatest) of each ``width`` neighbours, from running ones over blocks of that width."""
    n = len(values)
    fn, fill = (np.minimum, U(0xFFFFFFFFFFFFFFFF)) if least else (np.maximum, U(0))
    padded = np.full(-(-n // width) * width, fill, U)
    padded[:n] = values
    rows = padded.reshape(-1, width)
    ahead = fn.accumulate(rows, axis=1).ravel()
    behind = fn.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return fn(behind[: n - width + 1], ahead[width - 1 : n])


def string_keys(buf: np.ndarray, least: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each gram, and the key of each string of ``least`` bytes."""
    grams = gram_hashes(buf, gram)
    return grams, sliding(grams, least - gram + 1, True)


def keyed_runs(buf: np.ndarray, least: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last start of each run of strings with one key, and its key."""
    _, key = string_keys(buf, least, gram)
    first = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1])
    return first, np.concatenate([first[1:] - 1, [len(key) - 1]]), key[first]


def keys_by_place(buf: np.ndarray, least: int, gram: int) -> np.ndarray:
    """The keys of all strings, each once for each place of its gram."""
    grams, key = string_keys(buf, least, gram)
    # a gram is the key of some string if it equals the greatest key of those it stands in
    edge = np.zeros(least - gram, U)
    return grams[grams == sliding(np.concatenate([edge, key, edge]), least - gram + 1, False)]


def _pack(batches: Iterator[dict]) -> Iterator[dict]:
    """Texts compressed one by one: what is shuffled is half of what the shuffle's own compression would leave."""
    pack = zstandard.ZstdCompressor(level=1).compress
    for batch in batches:
        yield {k: batch[k] for k in ("row", "doc_id", "mark", "size")} | {"packed": [pack(t) for t in batch["text"]]}


def _unpacked(packed: list[bytes]) -> Iterator[bytes]:
    unpack = zstandard.ZstdDecompressor().decompress
    return (unpack(z) for z in packed)


def _keys(batches: Iterator[dict], least: int, gram: int) -> Iterator[dict]:
    for batch in batches:
        docs, keys = [], []
        for doc, text in zip(batch["doc_id"], batch["text"]):
            if len(text) >= least:
                found = keys_by_place(np.frombuffer(text, np.uint8), least, gram)
                docs.append(np.full(len(found), doc, np.int64))
                keys.append(found.view(np.int64))
        if docs:
            yield {"doc_id": np.concatenate(docs), "key": np.concatenate(keys)}


class _Pool:
    """Distinct fragments of a task, counted before they are shuffled; given out when they fill ``limit`` bytes."""

    def __init__(self, limit: int = 32_000_000):
        self.limit, self.size, self.held = limit, 0, {}

    def add(self, key: int, name: bytes, root: int, data: bytes, n: int) -> bool:
        row = self.held.get((key, name))
        if row:
            row[0] += n
        else:
            self.held[key, name] = [n, root, data]
            self.size += len(data) + 200
        return self.size > self.limit

    def rows(self) -> Iterator[dict]:
        items, self.size, self.held = list(self.held.items()), 0, {}
        for lo in range(0, len(items), 4096):
            some = items[lo : lo + 4096]
            own = {"key": [k for (k, _), _ in some], "name": [x for (_, x), _ in some]}
            own |= {c: [v[k] for _, v in some] for k, c in enumerate(("n", "root", "data"))}
            yield own | {k: [None] * len(some) for k in ("doc_id", "mark", "start", "parent")}


#: Where a fragment stands (in a text, or in the fragment that it is a part of), or a fragment: one or the other is null.
_SCHEMA = "doc_id long, mark long, start long, name binary, parent binary, key long, n long, root long, data binary"


def _name(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def _fragments(batches: Iterator[dict], least: int, gram: int) -> Iterator[dict]:
    """Of each text, the fragments of the given keys: where each stands (by name), and the distinct ones with their bytes."""
    pool = _Pool()
    for batch in batches:
        out: dict[str, list] = {"doc_id": [], "mark": [], "start": [], "name": []}
        for doc, mark, text, keys in zip(batch["doc_id"], batch["mark"], _unpacked(batch["packed"]), batch["keys"]):
            if len(text) < least:
                continue
            first, last, key = keyed_runs(np.frombuffer(text, np.uint8), least, gram)
            wanted = np.flatnonzero(np.isin(key.view(np.int64), np.array(keys, np.int64)))
            for lo, hi, k in zip(first[wanted].tolist(), last[wanted].tolist(), key[wanted].view(np.int64).tolist()):
                data = text[lo : hi + least]
                name = _name(data)
                out["doc_id"].append(doc)
                out["mark"].append(mark)
                out["start"].append(lo)
                out["name"].append(name)
                if pool.add(k, name, k, data, 1):
                    yield from pool.rows()
        none = [None] * len(out["name"])
        yield out | {"key": none, "n": none, "root": none, "data": none, "parent": none}
    yield from pool.rows()


def _split(batches: Iterator[dict], least: int, gram: int, classes: int) -> Iterator[dict]:
    """Fragments in parts by how far into a string its gram first stands, in ``classes`` steps; a part's key hashes all that its class shares."""
    pool, step = _Pool(), -(-(least - gram + 1) // classes)
    for batch in batches:
        out: dict[str, list] = {"start": [], "name": [], "parent": []}
        for root, parent, n, data in zip(batch["root"], batch["name"], batch["n"], batch["data"]):
            grams = gram_hashes(np.frombuffer(data, np.uint8), gram).view(np.int64)
            at = np.flatnonzero(grams == root)
            starts = np.arange(len(data) - least + 1)
            offset = at[np.searchsorted(at, starts)] - starts
            kind = offset // step
            # a new part where the class or the gram's place changes
            cuts = np.concatenate([[0], np.flatnonzero((np.diff(kind) != 0) | (np.diff(offset) != -1)) + 1, [len(starts)]])
            for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                place, c = lo + int(offset[lo]), int(kind[lo])
                near, far = c * step, min((c + 1) * step, least - gram + 1) - 1
                shared = data[place - near : place - far + least]
                key = int.from_bytes(hashlib.blake2b(shared + bytes([c]), digest_size=8, person=b"%d" % classes).digest(), "little", signed=True)
                part = data[lo : hi - 1 + least]
                name = _name(key.to_bytes(8, "little", signed=True) + part)
                out["start"].append(lo)
                out["name"].append(name)
                out["parent"].append(parent)
                if pool.add(key, name, root, part, n):
                    yield from pool.rows()
        none = [None] * len(out["name"])
        yield out | {"doc_id": none, "mark": none, "key": none, "n": none, "root": none, "data": none}
    yield from pool.rows()


def suffix_order(text: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all suffixes, sorted by ``depth`` bytes or more, and their first eight bytes in that order.

    Sorted by eight bytes first, then by twice as many among those still equal.
    """
    n = len(text)
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    head = np.zeros(n, U)
    for k in range(8):
        head = head << U(8) | padded[k : k + n]
    # places in 32 bits: a block is far smaller, and half the memory
    order = np.argsort(head).astype(np.int32)
    head = head[order]
    new = np.concatenate([[True], head[1:] != head[:-1]])
    slots = np.arange(n, dtype=np.int32)
    rank = np.empty(n + 1, np.int32)
    rank[n] = -1
    rank[order] = np.maximum.accumulate(np.where(new, slots, 0))
    done = 8
    while done < depth:
        alone = new & np.concatenate([new[1:], [True]])
        active = np.flatnonzero(~alone)
        if not len(active):
            break
        at = order[active]
        second = rank[np.minimum(at + done, n)]
        resort = np.argsort(rank[at].astype(np.int64) * (n + 1) + second + 1)
        at, second = at[resort], second[resort]
        first = rank[at]
        order[active] = at
        fresh = np.concatenate([[True], (first[1:] != first[:-1]) | (second[1:] != second[:-1])])
        new[active] = fresh
        rank[at] = np.maximum.accumulate(np.where(fresh, active, 0))
        done *= 2
    return order, head


def short_prefixes(head: np.ndarray) -> np.ndarray:
    """For each of the sorted words of eight bytes, the first in the top bits, how many it shares with the one before up to a zero; -1 if all eight."""
    differ = head[1:] ^ head[:-1]
    out = np.full(len(head), -1, np.int32)
    out[0] = 0
    # from the last byte up, so that the first that ends the prefix is what stays
    for k in reversed(range(8)):
        byte = U(0xFF) << U(8 * (7 - k))
        out[1:][((differ & byte) != 0) | ((head[1:] & byte) == 0)] = k
    return out


def alike(text: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffix order of ``text`` (zeros part strings), and for each rank whether its suffix shares ``least`` bytes with the one before.

    Prefixes of under eight bytes are read off the sorted words. From there on
    the transform: the interval of a string, extended backwards by a byte, is
    where that byte's places in the interval lead. An interval whose end is first
    reached at some length sets the common prefix there, and is extended in turn.
    As long as that would touch most places, all undecided ends are looked at
    instead, which finds the same ones.
    """
    n = len(text)
    order, head = suffix_order(text, least)
    prefix = np.append(short_prefixes(head), np.int32(0))
    prefix[:n][prefix[:n] >= least] = -1
    del head
    place = np.empty(n, np.int32)
    place[order] = np.arange(n, dtype=np.int32)
    transform = text[order - 1]
    back = place[order - 1]  # where the suffix that is one byte longer stands
    ahead = place[(order + 1) % n]
    open_ends = np.flatnonzero(prefix == -1)
    length = min(8, least) - 1
    dense = True
    while length < least - 1 and len(open_ends):
        ends = np.cumsum(prefix[:n] >= 0, dtype=np.int32)
        hit = ends[ahead[open_ends]] > ends[ahead[open_ends - 1]]
        length += 1
        found = open_ends[hit]
        prefix[found] = length
        open_ends = open_ends[~hit]
        if 4 * len(found) < len(open_ends):
            bounds = np.flatnonzero(prefix >= 0)
            low = bounds[np.searchsorted(bounds, found) - 1]
            if 3 * int((found - low).sum()) < len(open_ends):
                dense = False
                break
    if not dense:
        high = found
        while length < least - 1 and len(high):
            length += 1
            sizes = high - low
            of = np.repeat(np.arange(len(high)), sizes)
            inside = np.arange(len(of)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + low[of]
            kept = transform[inside] != 0
            to, of, byte = back[inside[kept]], of[kept], transform[inside[kept]]
            by = np.argsort(to, kind="stable")
            to, of, byte = to[by], of[by], byte[by]
            if not len(to):
                break
            cut = np.flatnonzero((of[1:] != of[:-1]) | (byte[1:] != byte[:-1]) | (to[1:] != to[:-1] + 1)) + 1
            low, high = to[np.concatenate([[0], cut])], to[np.concatenate([cut - 1, [len(to) - 1]])] + 1
            fresh = prefix[high] == -1
            low, high = low[fresh], high[fresh]
            prefix[high] = length
    return order, prefix[:n] == -1


def repeated_starts(parts: list[bytes], weights: list[int], least: int) -> list[np.ndarray]:
    """For each part, the starts of its ``least``-byte strings that start anywhere else too, in any part or another copy of it."""
    # zeros part the fragments; a zero in a text is written as a byte that UTF-8 doesn't have
    text = np.frombuffer(b"\0".join([*(p.replace(b"\0", b"\xff") for p in parts), b""]), np.uint8)
    order, same = alike(text, least)
    again = np.zeros(len(text), bool)
    again[order[same]] = True
    again[order[np.flatnonzero(same) - 1]] = True
    out, at = [], 0
    for p, n in zip(parts, weights):
        starts = len(p) - least + 1
        out.append(np.arange(starts) if n > 1 else np.flatnonzero(again[at : at + starts]))
        at += len(p) + 1
    return out


def _repeats(batches: Iterator[dict], least: int, block: int) -> Iterator[dict]:
    """Fragments in order of key and name: for each distinct one the runs of repeated starts in it."""
    parts: list[bytes] = []
    names: list[bytes] = []
    counts: list[int] = []
    size = group = 0
    key = None

    def emit(found: list[np.ndarray], of: list[bytes]) -> dict:
        out: dict[str, list] = {"name": [], "first": [], "last": []}
        for name, starts in zip(of, found):
            if len(starts):
                cut = np.flatnonzero(np.diff(starts) > 1)
                for lo, hi in zip(starts[np.concatenate([[0], cut + 1])].tolist(), starts[np.concatenate([cut, [len(starts) - 1]])].tolist()):
                    out["name"].append(name)
                    out["first"].append(lo)
                    out["last"].append(hi)
        return out

    def close() -> Iterator[dict]:
        """Ends a key's group: one fragment and its exact copies repeat as a whole and need no sorting."""
        nonlocal size
        if group == 1 and counts[-1] > 1:
            yield emit([np.arange(len(parts[-1]) - least + 1)], [names[-1]])
            size -= len(parts.pop())
            names.pop()
            counts.pop()

    for batch in batches:
        for k, name, n, data in zip(batch["key"], batch["name"], batch["n"], batch["data"]):
            if k != key:
                yield from close()
                if size > block:
                    yield emit(repeated_starts(parts, counts, least), names)
                    parts, names, counts, size = [], [], [], 0
                key, group = k, 0
            if group and names[-1] == name:
                counts[-1] += n
                continue
            parts.append(data)
            names.append(name)
            counts.append(n)
            size += len(data)
            group += 1
    yield from close()
    if parts:
        yield emit(repeated_starts(parts, counts, least), names)


def repeated_spans(texts: DataFrame, packed: DataFrame, least: int = LEAST, gram: int = GRAM, block: int = BLOCK, largest_key: int = LARGEST_KEY) -> DataFrame:
    """doc_id, mark (hash of the text), runs (first, last): runs of starts of ``least``-byte strings that start anywhere else too.

    ``texts``: doc_id, text as bytes; ``packed``: doc_id, mark, size, packed.
    """
    keys = written(map_rows(texts.where(F.length("text") >= least).select("doc_id", "text"), lambda b: _keys(b, least, gram), "doc_id long, key long"), "keys")
    # a passage of many texts is many rows of one key
    often = written(keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "often")
    by_doc = join_by_size(keys, often, "key").groupBy("doc_id").agg(F.collect_set("key").alias("keys"))
    long_texts = packed.where(F.col("size") >= least).select("doc_id", "mark", "packed").join(by_doc.hint("merge"), "doc_id")
    found = written(map_rows(long_texts, lambda b: _fragments(b, least, gram), _SCHEMA), "fragments")
    places = found.where("doc_id is not null").select("doc_id", "mark", "start", "name")
    pieces = found.where("data is not null").select("key", "name", "n", "root", "data")
    lineage, classes, small = [], 1, None
    while True:
        large = pieces.groupBy("key").agg(F.sum(F.length("data")).alias("size")).where(F.col("size") > largest_key).select("key")
        if classes > least - gram or not large.take(1):
            break
        large = written(large, "large")
        fit = pieces.join(large, "key", "left_anti")
        small = fit if small is None else small.unionByName(fit)
        classes *= 2
        too_large = pieces.join(large, "key").select("root", "name", "n", "data")
        parted = written(map_rows(too_large, lambda b, c=classes: _split(b, least, gram, c), _SCHEMA), "parted")
        lineage.append(parted.where("parent is not null").select("name", "start", "parent"))
        pieces = parted.where("data is not null").select("key", "name", "n", "root", "data")
    pieces = pieces if small is None else small.unionByName(pieces)
    ordered = pieces.select("key", "name", "n", "data").repartition("key").sortWithinPartitions("key", "name")
    runs = written(map_rows(ordered, lambda b: _repeats(b, least, block), "name binary, first long, last long"), "runs")
    for links in reversed(lineage):
        moved = [(F.col(c) + F.col("start")).alias(c) for c in ("first", "last")]
        up = runs.join(links, "name").select(F.col("parent").alias("name"), *moved)
        runs = runs.unionByName(up)
    # a fragment that is in many texts is one row with its runs, and how often it stands
    standing = runs.groupBy("name").agg(F.collect_list(F.struct("first", "last")).alias("runs"))
    standing = standing.join(places.groupBy("name").agg(F.count("*").alias("n")), "name")
    found = join_by_size(places, written(standing, "standing"), "name")
    at = lambda r, c: (F.col("start") + r[c]).alias(c)
    return found.select("doc_id", "mark", F.transform("runs", lambda r: F.struct(at(r, "first"), at(r, "last"))).alias("runs"))


def _cut(batches: Iterator[dict], least: int, with_text: bool) -> Iterator[dict]:
    for batch in batches:
        out: dict[str, list] = {k: [] for k in ("n_bytes", "n_removed", "n_spans", "kept_sha256", *(("kept_text", "spans") if with_text else ()))}
        for text, runs in zip(_unpacked(batch["packed"]), batch["runs"]):
            spans: list[list[int]] = []
            for lo, hi in sorted((r["first"], r["last"] + least) for r in runs or ()):
                if spans and lo <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], hi)
                else:
                    spans.append([lo, hi])
            left = b"".join(text[a:b] for a, b in zip([0, *(x[1] for x in spans)], [*(x[0] for x in spans), len(text)]))
            out["n_bytes"].append(len(text))
            out["n_removed"].append(len(text) - len(left))
            out["n_spans"].append(len(spans))
            out["kept_sha256"].append(hashlib.sha256(left).hexdigest())
            if with_text:
                out["kept_text"].append(left.decode("utf-8", "ignore"))
                out["spans"].append([{"start": a, "end": b} for a, b in spans])
        yield {"row": batch["row"]} | out


def remove_repeats(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), least: int = LEAST, with_text: bool = True, **limits: int) -> DataFrame:
    """A row for each row of ``docs`` (doc_id: long, text): the columns ``keep``, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, kept_text and spans.

    Removes each UTF-8 byte covered by a string of ``least`` bytes that also
    starts anywhere else, in the same text or another one; overlaps count, and
    strings are judged on the input. n_spans: maximal removed runs. kept_text: what remains,
    without the rest of a character that a span's edge cuts. A null text
    counts as empty, shorter texts keep everything. Rows that share doc_id and
    text are copies of each other; rows without a doc_id take part like others.
    """
    texts = docs.select(F.struct(*keep).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text"))
    texts = texts.withColumn("mark", F.xxhash64("text")).withColumn("size", F.length("text").cast("long"))
    # rows without a doc_id, however many, are told apart by their text
    texts = texts.withColumn("doc_id", F.coalesce("doc_id", "mark"))
    kind = texts.schema["row"].dataType.simpleString()
    packed = map_rows(texts, _pack, f"row {kind}, doc_id long, mark long, size long, packed binary")
    # as sets: copies of a text without a doc_id are one text here, and name the same runs each
    runs = repeated_spans(texts, packed, least, **limits).groupBy("doc_id", "mark").agg(F.flatten(F.collect_set("runs")).alias("runs"))
    found = "n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept_text string, spans array<struct<start long, end long>>" * with_text
    marked = packed.join(runs.hint("merge"), ["doc_id", "mark"], "left").select("row", "packed", "runs")
    cut = map_rows(marked, lambda b: _cut(b, least, with_text), f"row {kind}, {found}")
    return cut.select("row.*", "n_bytes", "n_removed", "n_spans", "kept_sha256", *(("kept_text", "spans") if with_text else ()))
