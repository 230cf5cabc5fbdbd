"""Operator 5: encoding and decoding with a SentencePiece model through a table of distinct chunks.

No piece of such a model crosses from a character to a following whitespace
marker, so a text falls into chunks (markers, then other characters) that can
be segmented alone. Each distinct chunk is segmented and decoded once and its
ids are joined back by position.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows

MARK = "▁"
#: A chunk after the marker that parts it from the one before: more markers, then other characters.
_CHUNK = re.compile(rf"(?:^|(?<=[^{MARK}])){MARK}({MARK}*[^{MARK}]*)")


class ChunkTable:
    """Distinct chunks with their ids (little-endian unsigned 32-bit) and their decoded text.

    Bounded: beyond ``limit`` bytes of chunks it starts anew. Refuses a model
    with a piece that crosses into a marker or that strips or folds characters.
    """

    def __init__(self, model_file: str, limit: int = 24_000_000):
        import numpy as np
        import sentencepiece

        self.np, self.limit = np, limit
        self.model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        pieces = (self.model.id_to_piece(i) for i in range(self.model.vocab_size()))
        if any(re.search(f"[^{MARK}]{MARK}", p) for p in pieces) or self.model.encode("  ﬁ  a ") == self.model.encode("fi a"):
            raise ValueError("pieces cross whitespace markers, or the model folds text: chunks can't be segmented alone")
        self.lone = self.model.piece_to_id(MARK)
        self.ids: dict[str, bytes] = {}
        self.texts: dict[str, str] = {}
        self.held = 0

    def chunks(self, text: str) -> list[str]:
        """What stands after each chunk's first marker; that of the first chunk is the one a model puts before a text."""
        if not text:
            return []
        if MARK not in text and "  " not in text and text[0] != " " and text[-1] != " ":
            return text.split(" ")
        return _CHUNK.findall(MARK + text.replace(" ", MARK))

    def learn(self, wanted: set[str]) -> None:
        if self.held > self.limit:
            self.ids, self.texts, self.held = {}, {}, 0
        new = [c for c in wanted if c not in self.ids]
        # the model puts one marker before each; that alone is what an empty text doesn't get
        coded = self.model.encode(new, num_threads=1)
        coded = [x if c else [self.lone] for c, x in zip(new, coded)]
        for c, x, t in zip(new, coded, self.model.decode(coded, num_threads=1) if coded else []):
            self.ids[c] = self.np.array(x, "<u4").tobytes()
            self.texts[c] = t
            self.held += len(c)

    def encode(self, parts: list[str]) -> bytes:
        return b"".join(map(self.ids.__getitem__, parts))

    def decode(self, parts: list[str]) -> str:
        return " ".join(map(self.texts.__getitem__, parts))


def _encode(batches: Iterator[dict], model_file: str, with_ids: bool) -> Iterator[dict]:
    import numpy as np

    held = ChunkTable(model_file)
    ends = [np.array([i], "<u4").tobytes() for i in (held.model.bos_id(), held.model.eos_id())]
    for batch in batches:
        out: dict[str, list] = {k: [] for k in ("n_tokens", "ids_sha256", "decoded_sha256", *(("ids", "decoded") if with_ids else ()))}
        out["row"] = batch["row"]
        # a bounded run of texts at a time, so that their distinct chunks are looked up together
        for lo in range(0, len(batch["text"]), 64):
            split = [held.chunks(t or "") for t in batch["text"][lo : lo + 64]]
            held.learn(set().union(*split))
            for parts in split:
                ids, decoded = ends[0] + held.encode(parts) + ends[1], held.decode(parts)
                out["n_tokens"].append(len(ids) // 4)
                out["ids_sha256"].append(hashlib.sha256(ids).hexdigest())
                out["decoded_sha256"].append(hashlib.sha256(decoded.encode()).hexdigest())
                if with_ids:
                    out["ids"].append(np.frombuffer(ids, "<u4"))
                    out["decoded"].append(decoded)
        yield out


def encode_pieces(docs: DataFrame, model_file: str, keep: tuple[str, ...] = ("doc_id",), text: str = "text", with_ids: bool = True) -> DataFrame:
    """A row for each row of ``docs``: the columns ``keep``, n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids and decoded.

    ids have the begin and end ids; the digests are of the ids as little-endian
    unsigned 32-bit integers and of the decoded text in UTF-8. A null text
    counts as empty: begin and end only, decoded empty. Repeated rows give
    repeated results; other columns are ignored, whatever their names.
    """
    found = "n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<bigint>, decoded string" * with_ids
    rows = docs.select(F.struct(*keep).alias("row"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["row"].dataType.simpleString()
    return map_rows(rows, lambda b: _encode(b, model_file, with_ids), f"row {kind}, {found}").select("row.*", *[c.split()[0] for c in found.split(", ")])
