"""WARC archives: one gzip member a record, equal payloads kept once, and a reader that splits archives anywhere.

Files are opened by ``pyarrow.fs``, so that tasks on any executor reach the
shared folder whatever its scheme.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stored import fresh_path
from .common import HOT, map_rows, text_bytes, written

#: Fixed values of the format: the magic of a gzip member that is deflated, and the profile of a revisit.
MAGIC = b"\x1f\x8b\x08"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Bytes read at once, and the longest record header that is looked for.
STEP, LONGEST_HEADER = 1 << 16, 1 << 20

_NOT_IN_URI = re.compile(r"[\x00-\x20\x7F<>]")


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def digest32(sha1: bytes) -> str:
    return base64.b32encode(sha1).decode()


def record(kind: str, block: bytes, fields: list[tuple[str, str | None]]) -> bytes:
    """A record in one gzip member; fields that are null are left out."""
    named = [("WARC-Type", kind), *fields, ("Content-Length", str(len(block)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in named if v is not None) + "\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(head.encode()) + packer.compress(block) + packer.compress(b"\r\n\r\n") + packer.flush()


def _record_id(page_id: int | None, row: int) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}:{row}>"


def _page_record(page_id, row, url, payload, digest, response_id, response_row, n_bytes, date: str) -> bytes:
    revisit = response_row is not None and response_row != row
    fields = [
        ("WARC-Record-ID", _record_id(page_id, row)), ("WARC-Date", date),
        ("WARC-Target-URI", None if url is None else _NOT_IN_URI.sub(lambda m: f"%{ord(m[0]):02X}", url)),
        ("WARC-Payload-Digest", f"sha1:{digest32(digest)}"), ("Content-Type", "application/http; msgtype=response"),
    ]
    if revisit:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", _record_id(response_id, response_row))]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n_bytes}\r\n\r\n".encode()
    return record("revisit" if revisit else "response", http if revisit else http + payload, fields)


def _archive(batches: Iterator[dict], folder: str, date: str, archive_bytes: int) -> Iterator[dict]:
    """Writes a task's records; a failed attempt's files have names that no table lists."""
    system, inside = opened(folder)
    system.create_dir(inside, recursive=True)
    out, path, size, n = None, None, 0, 0
    for batch in batches:
        for row in zip(*(batch[c] for c in _COLUMNS)):
            if out is None:
                name = f"{uuid.uuid4().hex}.warc.gz"
                path, out = f"{folder}/{name}", system.open_output_stream(f"{inside}/{name}", compression=None)
                size, n = out.write(record("warcinfo", b"format: WARC File Format 1.1\r\n", [("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", date), ("Content-Type", "application/warc-fields")])), 0
            size, n = size + out.write(_page_record(*row, date)), n + 1
            if size >= archive_bytes:
                out.close()
                yield {"path": [path], "size": [size], "n_records": [n]}
                out = None
    if out is not None:
        out.close()
        yield {"path": [path], "size": [size], "n_records": [n]}


_COLUMNS = ("page_id", "row", "url", "payload", "digest", "response_id", "response_row", "n_bytes")


def write_warc(pages: DataFrame, least_bytes: int = 0, date: str = "1970-01-01T00:00:00Z", archive_bytes: int = 1 << 30) -> DataFrame:
    """Writes ``pages`` (page_id, url, html) as archives; returns path, size (bytes) and n_records of each.

    The payload is the html in UTF-8, a null one is empty. Of records with equal
    payloads of ``least_bytes`` or more, that with the largest page_id (null is
    the smallest; of rows with the same page_id any one, for good) is the
    response, and the others are revisits, which hold no payload. Repeated rows
    are records of their own. No pages, no archives.

    Payloads are shuffled once, by digest; rows of digests that more than one row
    in ``HOT`` has meet a broadcast of these, and are spread.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), text_bytes("html").alias("payload"))
    rows = rows.withColumn("digest", F.unhex(F.sha1("payload"))).withColumn("n_bytes", F.length("payload").cast("long")).withColumn("row", F.monotonically_increasing_id())
    rows = written(rows, "payloads")
    alike = rows.where(F.col("n_bytes") >= least_bytes).groupBy("digest", "n_bytes").agg(F.count("*").alias("n"), F.max(F.struct("page_id", "row")).alias("r")).where("n > 1")
    repeats = written(alike.select("digest", "n_bytes", "n", F.col("r.page_id").alias("response_id"), F.col("r.row").alias("response_row")), "repeats")
    heavy = F.col("n") * HOT > rows.count()
    often = F.broadcast(repeats.where(heavy).select("digest", "n_bytes", F.col("response_id").alias("hot_id"), F.col("response_row").alias("hot_row")))
    # a hot digest is decided where the row stands; its rows go on under keys of their own
    key = lambda digest, n_bytes: F.concat(digest, F.unhex(F.lpad(F.hex(n_bytes), 16, "0")))
    dealt = rows.join(often, ["digest", "n_bytes"], "left").withColumn("key", F.when(F.col("hot_row").isNull(), key(F.col("digest"), F.col("n_bytes"))).otherwise(F.unhex(F.lpad(F.hex("row"), 16, "0"))))
    rest = repeats.where(~heavy).select(key(F.col("digest"), F.col("n_bytes")).alias("key"), "response_id", "response_row")
    decided = dealt.join(rest, "key", "left").withColumn("response_id", F.coalesce("hot_id", "response_id")).withColumn("response_row", F.coalesce("hot_row", "response_row"))
    folder = fresh_path(pages.sparkSession, "archives")
    return written(map_rows(decided.select(*_COLUMNS), lambda b: _archive(b, folder, date, archive_bytes), "path string, size long, n_records long"), "archived")


class Bytes:
    """A file from some place on, read on as far as asked for; what is before the last ``drop`` is let go then."""

    def __init__(self, file, at: int, size: int):
        self.file, self.at, self.low, self.size, self.held = file, at, at, size, b""

    def upto(self, end: int) -> None:
        """Makes sure that bytes before ``end`` are held, as far as there are any."""
        have = self.at + len(self.held)
        if end > have and have < self.size:
            self.held = self.held[self.low - self.at :] + self.file.read_at(min(max(end - have, STEP * 16), self.size - have), have)
            self.at = self.low

    def drop(self, at: int) -> None:
        self.low = at


def _fields(head: bytes) -> dict[str, str] | None:
    """The named fields of a record's header, or null if it isn't one."""
    lines = head.split(b"\r\n")
    if not re.fullmatch(rb"WARC/\d+\.\d+", lines[0]):
        return None
    named = [line.partition(b":") for line in lines[1:]]
    found = {k.decode("utf-8", "replace").strip().lower(): v.decode("utf-8", "replace").strip() for k, colon, v in named if colon}
    if not found.get("content-length", "").isdecimal() or not {"warc-type", "warc-record-id"} <= set(found):
        return None
    return found


def member(source: Bytes, start: int) -> tuple[int, dict[str, str], bytes] | None:
    """The record whose gzip member begins at ``start``: its end, header and block; null if none does.

    The header is decoded first, so that most false candidates cost little; then
    the member must be whole, by its check sum and by the lengths named in it.
    """
    unpack, at, out, fields, body = zlib.decompressobj(31), start, bytearray(), None, 0
    try:
        while not unpack.eof:
            source.upto(at + STEP)
            some = source.held[at - source.at : at - source.at + STEP]
            if not some:
                return None
            out += unpack.decompress(some)
            at += len(some)
            if fields is None:
                end = out.find(b"\r\n\r\n")
                if end < 0:
                    if not out.startswith(b"WARC/"[: len(out)]) or len(out) > LONGEST_HEADER:
                        return None
                    continue
                fields, body = _fields(bytes(out[:end])), end + 4
                if fields is None:
                    return None
    except zlib.error:
        return None
    n = int(fields["content-length"]) if fields else -1
    if n < 0 or out[body + n :] != b"\r\n\r\n":
        return None
    return at - len(unpack.unused_data), fields, bytes(out[body : body + n])


def members(source: Bytes, lo: int, hi: int) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """Start, end, header and block of each record that starts in lo..hi-1; what isn't a whole record is passed over."""
    at = lo
    while at < hi:
        source.upto(at + STEP)
        found = source.held.find(MAGIC, at - source.at)
        if found < 0:
            # the magic may stand across the end of what is held
            at = max(at + 1, source.at + len(source.held) - len(MAGIC) + 1)
            if at >= source.size - len(MAGIC) + 1:
                return
            source.drop(at)
            continue
        start = source.at + found
        if start >= hi:
            return
        source.drop(start)
        whole = member(source, start)
        if whole is None:
            at = start + 1
            continue
        yield start, *whole
        at = whole[0]
        source.drop(at)


def _payload(fields: dict[str, str], block: bytes) -> tuple[dict[str, str], bytes]:
    """Fields of the HTTP header and what follows it; of other blocks, all is payload."""
    if not fields.get("content-type", "").startswith("application/http"):
        return {}, block
    head, _, payload = block.partition(b"\r\n\r\n")
    named = [line.partition(b":") for line in head.split(b"\r\n")[1:]]
    return {k.decode("latin-1").strip().lower(): v.decode("latin-1").strip() for k, _, v in named}, payload


def _index(batches: Iterator[dict]) -> Iterator[dict]:
    for batch in batches:
        for path, lo, hi in zip(batch["path"], batch["lo"], batch["hi"]):
            system, inside = opened(path)
            with system.open_input_file(inside) as file:
                rows = []
                for start, end, fields, block in members(Bytes(file, lo, file.size()), lo, hi):
                    http, payload = _payload(fields, block)
                    if fields["warc-type"] == "revisit":
                        n, digest = int(http.get("content-length", 0)), fields.get("warc-payload-digest", "").removeprefix("sha1:")
                    else:
                        n, digest = len(payload), digest32(hashlib.sha1(payload).digest())
                    rows.append((path, start, end, fields["warc-type"], list(fields.items()), n, digest))
                    if len(rows) == 1000:
                        yield dict(zip(_INDEXED, zip(*rows)))
                        rows = []
                if rows:
                    yield dict(zip(_INDEXED, zip(*rows)))


_INDEXED = ("path", "start", "end", "record_type", "fields", "payload_bytes", "payload_digest")


def index_warc(archives: DataFrame, split_bytes: int = 32 << 20) -> DataFrame:
    """A row for each record of ``archives`` (path, size): path, start, end, record_type, fields, payload_bytes, payload_digest.

    An archive is cut into ranges of ``split_bytes``, each read by a task, which
    finds the first record in its range by the gzip magic and a header that can
    be decoded, and owns the records that start inside. Payload sizes and digests
    are computed; of revisits they are what the record says of the full payload.

    A payload may hold a whole archive, whose members can stand in a range as
    they are: what starts inside another record isn't one, which is told from
    starts and ends alone. Damaged members are no records. Empty files have none.
    """
    cuts = archives.where("size > 0").select("path", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(split_bytes).cast("long"))).alias("lo"))
    ranges = cuts.select("path", "lo", F.least(F.col("lo") + split_bytes, F.col("size")).alias("hi"))
    # a range a task: of rows this small, adaptive execution would make one
    dealt = ranges.repartition(max(1, ranges.count()))
    rows = map_rows(dealt, _index, "path string, start long, end long, record_type string, fields map<string,string>, payload_bytes long, payload_digest string")
    before = F.max("end").over(Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("_before", before).where("_before is null or start >= _before").drop("_before")


def _fetch(batches: Iterator[dict]) -> Iterator[dict]:
    for batch in batches:
        for path, start in zip(batch["path"], batch["start"]):
            system, inside = opened(path)
            with system.open_input_file(inside) as file:
                _, fields, block = member(Bytes(file, start, file.size()), start)
            yield {"path": [path], "start": [start], "payload": [_payload(fields, block)[1]]}


def read_payloads(index: DataFrame) -> DataFrame:
    """path, start and payload of records of ``index_warc``, each read where it stands; a revisit's payload is empty."""
    return map_rows(index.select("path", "start"), _fetch, "path string, start long, payload binary")


def page_records(index: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to (page_id of the response) of the pages' records."""
    page = lambda field: F.regexp_extract(F.col("fields").getItem(field), r"^<urn:page:(-?\d+):\d+>$", 1).try_cast("long")
    return index.where("record_type in ('response', 'revisit')").select(page("warc-record-id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("warc-refers-to").alias("refers_to"))
