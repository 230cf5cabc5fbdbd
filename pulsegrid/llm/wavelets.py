"""Operator 4: token ids in wavelet-matrix shards.

Texts are encoded, put in ascending doc_id order and cut into shards. A shard
is one compressed file that holds a directory of its documents and the
bit-planes of its ids, from which tokens are read, counted and located by rank
and select, a block of a plane at a time.
"""

from __future__ import annotations

import array
import re
import struct
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_rows, text_bytes, written

MAGIC = b"WVMX2\0\0\0"
#: Bits of a plane that are compressed together, and blocks that a reader keeps.
BITS, HELD = 1 << 16, 32


class WaveletMatrix:
    """A shard file, read in place: bit-planes from the highest bit down, in which ids with a 0 go before those with a 1, in stable order.

    A plane is cut into blocks of ``BITS`` bits, each compressed alone, with the
    number of ones before each. Rank looks its block up and counts inside; select
    finds its block by search among those numbers. A look-up decompresses one
    block of each plane and nothing else; ``HELD`` blocks are kept. Layout, all
    little-endian: magic; ids, width, documents, bytes of the directory; for each
    plane its zeros; for each block the ones before it; for each block and the
    end its place; the directory (doc_ids, then sizes, then whether the doc_id is
    there); the blocks.
    """

    def __init__(self, data: bytes):
        if data[: len(MAGIC)] != MAGIC:
            raise ValueError("not a wavelet-matrix file")
        self.data = data
        self.length, self.width, self.documents, self._directory = struct.unpack_from("<4Q", data, len(MAGIC))
        self.blocks = -(-self.length // BITS)
        at, cells = len(MAGIC) + 32, self.width * self.blocks
        self.zeros = np.frombuffer(data, "<u8", self.width, at).tolist()
        at += 8 * self.width
        self._before = np.frombuffer(data, "<u8", cells, at).reshape(self.width, self.blocks)
        self._places = np.frombuffer(data, "<u8", cells + 1, at + 8 * cells)
        self._start = at + 16 * cells + 8
        self._kept: dict[tuple[int, int], np.ndarray] = {}
        self._unpack = zstandard.ZstdDecompressor().decompress

    @staticmethod
    def build(ids: np.ndarray, width: int, doc_ids: list[int | None] = (), sizes: list[int] = ()) -> bytes:
        """The file of ``ids``, of which the documents are runs of the given sizes."""
        now = ids.astype(np.uint16 if width <= 16 else np.uint32, copy=False)
        pack = zstandard.ZstdCompressor(level=1).compress
        zeros, before, places, packed, at = [], [], [0], [], 0
        for level in reversed(range(width)):
            # a block at a time, so that it stays in the cache
            halves, ones, bit = ([], []), [], now.dtype.type(1 << level)
            for lo in range(0, len(now), BITS):
                part = now[lo : lo + BITS]
                one = (part & bit).astype(bool)
                packed.append(pack(np.packbits(one, bitorder="little").tobytes()))
                at += len(packed[-1])
                places.append(at)
                halves[1].append(part[np.flatnonzero(one)])
                halves[0].append(part[np.flatnonzero(~one)])
                ones.append(len(halves[1][-1]))
            before.append(np.cumsum(ones) - ones)
            zeros.append(len(now) - sum(ones))
            now = np.concatenate([now[:0], *halves[0], *halves[1]])
        there = np.array([d is not None for d in doc_ids], np.uint8)
        directory = pack(np.array([d or 0 for d in doc_ids], "<i8").tobytes() + np.array(sizes, "<u8").tobytes() + there.tobytes())
        head = struct.pack("<4Q", len(ids), width, len(doc_ids), len(directory))
        tables = [np.array(zeros, "<u8"), np.array(before, "<u8"), np.array(places, "<u8")]
        return b"".join([MAGIC, head, *(t.tobytes() for t in tables), directory, *packed])

    def directory(self) -> tuple[list[int | None], np.ndarray]:
        """The documents' ids, and how many ids of tokens each has, in order."""
        body = self._unpack(self.data[self._start : self._start + self._directory])
        n = self.documents
        doc_ids, there = np.frombuffer(body, "<i8", n), np.frombuffer(body, np.uint8, n, 16 * n)
        return [d if t else None for d, t in zip(doc_ids.tolist(), there.tolist())], np.frombuffer(body, "<u8", n, 8 * n).astype(np.int64)

    def _block(self, plane: int, block: int) -> np.ndarray:
        """The bits of one block, eight a byte."""
        held = self._kept.get((plane, block))
        if held is None:
            if len(self._kept) >= HELD:
                self._kept.pop(next(iter(self._kept)))
            lo, hi = self._places[plane * self.blocks + block : plane * self.blocks + block + 2].tolist()
            at = self._start + self._directory
            held = self._kept[plane, block] = np.frombuffer(self._unpack(self.data[at + lo : at + hi]), np.uint8)
        return held

    def _bits(self, plane: int, block: int) -> np.ndarray:
        return np.unpackbits(self._block(plane, block), count=min(BITS, self.length - block * BITS), bitorder="little")

    def _ones(self, plane: int, upto: int) -> int:
        """Rank: ones of the plane before the place ``upto``."""
        if upto >= self.length:
            return self.length - self.zeros[plane]
        block, inside = divmod(upto, BITS)
        whole, rest = divmod(inside, 8)
        held = self._block(plane, block)
        last = int(held[whole] & ((1 << rest) - 1)).bit_count() if rest else 0
        return int(self._before[plane, block]) + int(np.bitwise_count(held[:whole]).sum()) + last

    def _select(self, plane: int, bit: int, which: np.ndarray) -> np.ndarray:
        """Select: the places of the given ones (or zeros) of the plane, counted from 0, ascending."""
        before = self._before[plane].astype(np.int64)
        if not bit:
            before = np.arange(self.blocks, dtype=np.int64) * BITS - before
        blocks = np.searchsorted(before, which, "right") - 1
        out = np.empty(len(which), np.int64)
        for block in np.unique(blocks).tolist():
            some = blocks == block
            out[some] = block * BITS + np.flatnonzero(self._bits(plane, block) == bit)[which[some] - before[block]]
        return out

    def tokens(self) -> np.ndarray:
        """All ids in order: from the last plane up, each place takes its bit and the value of the place it was sent to."""
        kind = np.uint16 if self.width <= 16 else np.uint32
        value = np.zeros(self.length, kind)
        for plane in reversed(range(self.width)):
            zeros = self.zeros[plane]
            value[zeros:] |= kind(1 << (self.width - 1 - plane))
            back, zero, one = np.empty_like(value), 0, zeros
            for block in range(self.blocks):
                bits = self._bits(plane, block).view(bool)
                part = back[block * BITS : block * BITS + len(bits)]
                at = np.flatnonzero(bits)
                part[at] = value[one : one + len(at)]
                one += len(at)
                at = np.flatnonzero(~bits)
                part[at] = value[zero : zero + len(at)]
                zero += len(at)
            value = back
        return value

    def access(self, at: np.ndarray) -> np.ndarray:
        """The ids at the given places."""
        at = np.array(at, np.int64)
        value = np.zeros(len(at), np.uint32)
        for plane in range(self.width):
            bit, ones = np.empty(len(at), np.int64), np.empty(len(at), np.int64)
            blocks = at // BITS
            for block in np.unique(blocks).tolist():
                some = blocks == block
                bits = self._bits(plane, block)
                inside = at[some] - block * BITS
                bit[some] = bits[inside]
                ones[some] = int(self._before[plane, block]) + np.cumsum(bits, dtype=np.int64)[inside] - bits[inside]
            value = value << 1 | bit.astype(np.uint32)
            at = np.where(bit == 1, self.zeros[plane] + ones, at - ones)
        return value

    def _range(self, token: int, upto: int) -> tuple[int, int]:
        """Where the last plane sends the places of ``token`` before ``upto``."""
        lo, hi = 0, upto
        if token < 0 or token >> self.width:
            return 0, 0
        for plane in range(self.width):
            first, last = self._ones(plane, lo), self._ones(plane, hi)
            one = token >> (self.width - 1 - plane) & 1
            lo, hi = (self.zeros[plane] + first, self.zeros[plane] + last) if one else (lo - first, hi - last)
        return lo, hi

    def rank(self, token: int, upto: int | None = None) -> int:
        """How often the id stands before the place ``upto``."""
        lo, hi = self._range(token, self.length if upto is None else upto)
        return hi - lo

    def occurrences(self, token: int) -> np.ndarray:
        """All places of the id, ascending: select on each plane, from the last one up."""
        lo, hi = self._range(token, self.length)
        at = np.arange(lo, hi)
        for plane in reversed(range(self.width)):
            one = token >> (self.width - 1 - plane) & 1
            at = self._select(plane, one, at - self.zeros[plane] if one else at)
        return at


#: A-Z as a-z.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Punctuation after a letter of ASCII or Latin-1, up to white space.
_TAIL = re.compile(rb"([.,!?;:](?:(?<=[a-z].)|(?<=\xc3[\x80-\x96\x98-\xb6\xb8-\xbf].))[.,!?;:]*)(?=[ \t\n\r\x0b\x0c]|$)")
#: How the tokenizer parts folded words of printable ASCII; its other white space and scripts aren't in such a word.
_PIECES = re.compile(rb"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")
_PRINTED = re.compile(rb"[!-~]+")
#: The character by which a byte-level vocabulary writes each byte: itself if it prints, else the next one from U+0100 on.
_PRINTS = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
_BYTE = {b: b for b in _PRINTS} | {b: 256 + k for k, b in enumerate(sorted(set(range(256)) - set(_PRINTS)))}


class WordCoder(dict):
    """Ids of runs between ASCII white space, without the punctuation after them; each distinct run is encoded once, when it is first met.

    Holds for tokenizers that fold case, never join what white space parts, nor
    letters, digits and punctuation, and write bytes as characters: this one's
    file says so. What is printable ASCII or one word of letters goes piece by
    piece to the library's merges; any other run, and whatever could hold a
    control token, is given to the tokenizer as it stands. Bounded: after
    ``limit`` bytes of runs it starts anew, and of the ones before keeps what is
    met again.
    """

    def __init__(self, tokenizer_file: str, limit: int = 7_000_000):
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(tokenizer_file)
        self.merges = self.model.model.tokenize
        self.limit, self.held, self.former = limit, 0, {}
        probe = "Ab's 12 it'll-x9 --'s <|x|> Éa naïve, end. ßx!? 'tis 3.14%"
        if np.array(self.model.encode(probe, add_special_tokens=False).ids, "<u4").tobytes() != self.encode(probe.encode()):
            raise ValueError("this tokenizer joins what white space parts, or tells case apart")

    def piece(self, some: bytes) -> bytes:
        """Ids of letters, a digit or punctuation alone."""
        return array.array("I", [t.id for t in self.merges(some.decode("latin-1").translate(_BYTE))]).tobytes()

    def fresh(self, run: bytes) -> bytes:
        """Ids of a run that isn't known."""
        if run.isalpha() and run.islower():  # of bytes: ASCII letters alone
            return self.piece(run)
        if _PRINTED.fullmatch(run) and b"<|" not in run:
            return b"".join([self.get(x) or self.piece(x) for x in _PIECES.findall(run)])
        text = run.decode()
        if text.isalpha() and text.islower() and text.lower() == text and unicodedata.is_normalized("NFC", text):
            return self.piece(run)
        return np.array(self.model.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def __missing__(self, run: bytes) -> bytes:
        ids = self[run] = self.former.get(run) or self.fresh(run)
        self.held += len(run)
        return ids

    def encode(self, text: bytes) -> bytes:
        """Ids of a text in UTF-8, little-endian unsigned 32-bit."""
        if self.held > self.limit:
            self.former, self.held = dict(self), 0
            self.clear()
        return b"".join(map(self.__getitem__, _TAIL.sub(rb" \1", text.translate(_FOLD)).split()))


_CODERS: dict[str, WordCoder] = {}


def coder(tokenizer_file: str) -> WordCoder:
    """One for each worker process, so that later tasks know what earlier ones met."""
    if tokenizer_file not in _CODERS:
        _CODERS[tokenizer_file] = WordCoder(tokenizer_file)
    return _CODERS[tokenizer_file]


def _encode(batches: Iterator[dict], tokenizer_file: str, end_id: int) -> Iterator[dict]:
    known, end = coder(tokenizer_file), np.array([end_id], "<u4").tobytes()
    for batch in batches:
        for lo in range(0, len(batch["text"]), 64):
            ids = [np.frombuffer(known.encode(t) + end, "<u4") for t in batch["text"][lo : lo + 64]]
            wide = [bool(x.max() > 0xFFFF) for x in ids]
            # two bytes where all ids fit
            yield {"doc_id": batch["doc_id"][lo : lo + 64], "n_tokens": [len(x) for x in ids], "wide": wide, "ids": [(x if w else x.astype("<u2")).tobytes() for x, w in zip(ids, wide)]}


def _shard(batches: Iterator[dict], tokens_a_shard: int, width: int) -> Iterator[dict]:
    held, docs, sizes, total, seq, before = [], [], [], 0, 0, 0

    def flush():
        ids = np.concatenate(held)
        bits = max(width, int(ids.max()).bit_length())
        return {"part": [part], "seq": [seq], "first": [before], "n_tokens": [total], "data": [WaveletMatrix.build(ids, bits, docs, sizes)]}

    part = 0
    for batch in batches:
        for part, doc, wide, ids in zip(batch["part"], batch["doc_id"], batch["wide"], batch["ids"]):
            held.append(np.frombuffer(ids, "<u4" if wide else "<u2"))
            docs.append(doc)
            sizes.append(len(held[-1]))
            total += sizes[-1]
            if total >= tokens_a_shard:
                yield flush()
                before, seq = before + total, seq + 1
                held, docs, sizes, total = [], [], [], 0
    if docs:
        yield flush()


def write_shards(docs: DataFrame, tokenizer_file: str, end_id: int = 1, tokens_a_shard: int = 1 << 20, width: int = 16) -> DataFrame:
    """Encodes every text of ``docs`` (doc_id, text), and writes the shards; returns them as read back from the shared folder.

    A row is a shard: part and seq (its order), first (tokens of its part before
    it), n_tokens, data (the file, with the directory of its documents).
    Documents stand in ascending doc_id order, null first, rows of one doc_id by
    a hash of their ids, then the ids; equal ones are copies in any order. A
    document is never cut, so that a shard has up to ``tokens_a_shard`` tokens
    and one document. A null text counts as empty: the end id alone.
    """
    rows = docs.select("doc_id", text_bytes().alias("text"))
    coded = map_rows(rows, lambda b: _encode(b, tokenizer_file, end_id), "doc_id long, n_tokens long, wide boolean, ids binary")
    # by the hash too, so that rows without a doc_id, however many, aren't one range; written, so that ranges are cut without reading ids
    coded = written(coded.withColumn("hash", F.xxhash64("ids")), "ids")
    ranged = coded.repartitionByRange("doc_id", "hash").sortWithinPartitions("doc_id", "hash", "ids").withColumn("part", F.spark_partition_id())
    schema = "part int, seq int, first long, n_tokens long, data binary"
    return written(map_rows(ranged.drop("hash"), lambda b: _shard(b, tokens_a_shard, width), schema), "shards")


def shard_starts(shards: DataFrame) -> DataFrame:
    """The shards with ``start``, the number of tokens before each: a running sum over one row for each part."""
    parts = shards.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    starts = parts.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("before"))
    return shards.join(F.broadcast(starts), "part").withColumn("start", F.col("before") + F.col("first")).drop("before")


def _digests(batches: Iterator[dict]) -> Iterator[dict]:
    for batch in batches:
        for start, data in zip(batch["start"], batch["data"]):
            matrix = WaveletMatrix(data)
            docs, sizes = matrix.directory()
            ids, cuts = matrix.tokens().astype("<u4"), np.concatenate([[0], np.cumsum(sizes)])
            yield {"doc_id": docs, "start": (start + cuts[:-1]).tolist(), "n_tokens": sizes, "ids_crc32": [zlib.crc32(ids[a:b]) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]}


def document_digests(shards: DataFrame) -> DataFrame:
    """For each document, read from the shard files: doc_id, start, n_tokens, ids_crc32 (of little-endian unsigned 32-bit ids)."""
    return map_rows(shard_starts(shards).select("start", "data"), _digests, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_occurrences(shards: DataFrame, token: int) -> DataFrame:
    """Places of one id over all shards (``place``: tokens before it), by select on the bit-planes."""

    def find(batches):
        for b in batches:
            for start, data in zip(b["start"], b["data"]):
                yield {"place": (start + WaveletMatrix(data).occurrences(token)).tolist()}

    return map_rows(shard_starts(shards).select("start", "data"), find, "place long")


def token_counts(shards: DataFrame, tokens: list[int]) -> DataFrame:
    """How often each of a few ids stands in all shards, by rank."""

    def count(batches):
        for b in batches:
            for data in b["data"]:
                matrix = WaveletMatrix(data)
                yield {"token": tokens, "n": [matrix.rank(t) for t in tokens]}

    return map_rows(shards.select("data"), count, "token int, n long").groupBy("token").agg(F.sum("n").alias("n"))
