"""Uncompressed video in open containers, read in ranges: YUV4MPEG2 files, and AVI files whose frames are bitmaps.

``spark.read.format("containers")``: each file is cut by bytes, and a task reads
the file's header or index and then the frames that begin in its range. The
driver lists files and their sizes, and opens none.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, InputPartition, LessThan, LessThanOrEqual

from .recordings import FRAMES, MOST_FRAMES


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    return fs.FileSystem.from_uri(path) if re.match(r"[a-z][a-z0-9+.-]*:", path) else (fs.LocalFileSystem(), path)


@dataclass
class Video:
    """Where a file's frames stand and how their bytes become gray values."""

    height: int
    width: int
    fps: float
    offsets: Sequence[int]
    size: int

    def gray(self, data: bytes) -> bytes:
        raise NotImplementedError


class LumaVideo(Video):
    """The first plane is the gray value."""

    def gray(self, data: bytes) -> bytes:
        return data[: self.height * self.width]


@dataclass
class BitmapVideo(Video):
    """Rows of 1, 3 or 4 bytes a pixel, padded to four, the last row first unless ``downwards``; one byte may be a place in ``palette``."""

    depth: int = 1
    downwards: bool = False
    palette: np.ndarray | None = None

    def gray(self, data: bytes) -> bytes:
        stride = -(-self.width * self.depth // 4) * 4
        rows = np.frombuffer(data, np.uint8, stride * self.height).reshape(self.height, stride)[:, : self.width * self.depth]
        rows = rows if self.downwards else rows[::-1]
        if self.depth == 1:
            return (rows if self.palette is None else self.palette[rows]).tobytes()
        return luma(rows.reshape(self.height, self.width, self.depth)).tobytes()


def luma(colours: np.ndarray) -> np.ndarray:
    """Gray value of blue, green and red, rounded."""
    return np.floor(colours[..., :3] @ np.array([0.114, 0.587, 0.299]) + 0.5).astype(np.uint8)


#: Samples beside the luma plane: width and height of two planes, as parts of the frame's.
CHROMA = {"420": (2, 2), "422": (2, 1), "444": (1, 1), "411": (4, 1)}


def y4m(file, size: int) -> LumaVideo:
    """A YUV4MPEG2 file: a line of parameters, then frames of one size, each behind a line of its own."""
    line = _line(file, 0)
    fields = {p[:1]: p[1:] for p in line.decode("ascii", "replace").split(" ")[1:]}
    w, h = int(fields["W"]), int(fields["H"])
    kind = fields.get("C", "420")
    if re.search(r"p\d+$|mono\d+|alpha", kind):
        raise ValueError(f"no frames of 8 bits without transparency: {kind}")
    planes = 0 if kind.startswith("mono") else next(2 * -(-w // a) * -(-h // b) for k, (a, b) in CHROMA.items() if kind.startswith(k))
    up, _, down = fields.get("F", "").partition(":")
    fps = int(up) / int(down) if up.isdecimal() and down.isdecimal() and int(down) else 0.0
    length, first = w * h + planes, len(line) + 1
    step = len(b"FRAME\n") + length
    n, rest = divmod(size - first, step)
    if not rest and all(file.read_at(6, first + k * step) == b"FRAME\n" for k in {0, n - 1} if 0 <= k < n):
        offsets: Sequence[int] = range(first + 6, first + 6 + n * step, step)
    else:
        # some frames have parameters of their own, or the last one isn't whole
        offsets, at = [], first
        while at < size and (own := _line(file, at)).startswith(b"FRAME"):
            start = at + len(own) + 1
            at = start + length
            if at <= size:
                offsets.append(start)
    return LumaVideo(h, w, fps, offsets, length)


def _line(file, at: int) -> bytes:
    found = file.read_at(1024, at)
    return found[: found.index(b"\n")] if b"\n" in found else found


def _chunks(file, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """Kind, first byte of the content, and length of each chunk in a range."""
    while at + 8 <= end:
        kind, n = struct.unpack("<4sI", file.read_at(8, at))
        yield kind, at + 8, n
        at += 8 + n + n % 2


def avi(file, size: int) -> BitmapVideo:
    """An AVI file of uncompressed bitmaps: by its index, or by walking the chunks of what has none."""
    head, movies, index = b"", [], None
    for kind, at, n in _chunks(file, 0, size):
        if kind != b"RIFF":
            continue
        for inner, start, length in _chunks(file, at + 4, min(at + n, size)):
            what = file.read_at(4, start) if inner == b"LIST" else b""
            if what == b"hdrl":
                head = file.read_at(length, start)
            elif what == b"movi":
                movies.append((start, min(start + length, size)))
            elif inner == b"idx1":
                index = file.read_at(length, start)
    number, fps, video = _stream(head)
    # the index counts from the list's name, or from the file's first byte, and is that of the first list alone
    offsets, sizes = [], set()
    for turn, (start, end) in enumerate(movies):
        if turn == 0 and index:
            rows = np.frombuffer(index, np.dtype([("kind", "S4"), ("flags", "<u4"), ("at", "<u4"), ("n", "<u4")]), len(index) // 16)
            own = rows[np.isin(rows["kind"], [b"%02ddb" % number, b"%02ddc" % number])]
            base = 0 if len(own) and int(own["at"][0]) >= start else start
            offsets += (own["at"].astype(np.int64) + base + 8).tolist()
            sizes |= set(own["n"].tolist())
            continue
        for kind, at, n in _chunks(file, start + 4, end):
            if kind in (b"%02ddb" % number, b"%02ddc" % number):
                offsets.append(at)
                sizes.add(n)
    if sizes - {video["length"]}:
        raise ValueError("the frames aren't uncompressed bitmaps of one size")
    return BitmapVideo(video["height"], video["width"], fps, offsets, video["length"], video["depth"], video["downwards"], video["palette"])


def _stream(head: bytes) -> tuple[int, float, dict]:
    """Number, frame rate and format of the first video stream in a header list."""
    at, number, rate = 4, -1, None
    while at + 8 <= len(head):
        kind, n = struct.unpack_from("<4sI", head, at)
        body = at + 8
        if kind == b"LIST":
            at += 12
            continue
        if kind == b"strh":
            number += 1
            rate = struct.unpack_from("<II", head, body + 20) if head[body : body + 4] == b"vids" else None
        elif kind == b"strf" and rate:
            _, w, h, _, bits, compression = struct.unpack_from("<IiiHHI", head, body)
            if compression not in (0, *(int.from_bytes(k, "little") for k in (b"Y800", b"GREY"))) or bits not in (8, 24, 32):
                raise ValueError("the video is compressed, or not of 8, 24 or 32 bits")
            colours = np.frombuffer(head, np.uint8, max(0, min(n - 40, 1024)) // 4 * 4, body + 40).reshape(-1, 4)
            palette = None
            if bits == 8 and compression == 0 and len(colours):
                palette = np.zeros(256, np.uint8)
                palette[: len(colours)] = luma(colours)
            depth, w, h_ = bits // 8, w, abs(h)
            # gray formats stand upright; bitmaps do where their height is negative
            video = {"height": h_, "width": w, "depth": depth, "downwards": h < 0 or compression != 0, "palette": palette, "length": -(-w * depth // 4) * 4 * h_}
            return number, rate[1] / rate[0] if rate[0] else 0.0, video
        at = body + n + n % 2
    raise ValueError("no video stream")


def video_of(file, size: int) -> Video:
    magic = file.read_at(12, 0)
    if magic.startswith(b"YUV4MPEG2"):
        return y4m(file, size)
    if magic[:4] == b"RIFF" and magic[8:] == b"AVI ":
        return avi(file, size)
    raise ValueError("neither YUV4MPEG2 nor AVI")


@dataclass
class FileRange(InputPartition):
    path: str
    lo: int
    hi: int


class ContainerSource(DataSource):
    """Options: path (comma-separated files or folders), split_bytes, most_frames (of each file, 3000 unless given), push_filters.

    ``push_filters`` hands limits on frame_idx, and a recording_id, to the reader;
    Spark wants spark.sql.python.filterPushdown.enabled for that. Rows are ``FRAMES``; recording_id is the file's path. A frame rate that makes
    no sense is 30. A file without frames, or of another kind, is an error.
    """

    @classmethod
    def name(cls) -> str:
        return "containers"

    def schema(self) -> str:
        return FRAMES

    def reader(self, schema) -> DataSourceReader:
        return (FilteredReader if self.options.get("push_filters", "false") == "true" else ContainerReader)(self.options)


class ContainerReader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = options["path"].split(",")
        self.split, self.most = int(options.get("split_bytes", 64 << 20)), int(options.get("most_frames", MOST_FRAMES))
        self.only: set[str] | None = None

    def partitions(self) -> list[InputPartition]:
        out = []
        for path in self.paths:
            system, inside = opened(path)
            info = system.get_file_info(inside)
            if info.type == fs.FileType.NotFound:
                raise FileNotFoundError(path)
            found = [(path, info.size)] if info.is_file else [(f"{path.rstrip('/')}/{f.base_name}", f.size) for f in system.get_file_info(fs.FileSelector(inside)) if f.is_file]
            out += [FileRange(p, lo, min(lo + self.split, n)) for p, n in sorted(found) if self.only is None or p in self.only for lo in range(0, max(n, 1), self.split)]
        return out

    def read(self, partition: FileRange) -> Iterator[tuple]:
        system, inside = opened(partition.path)
        with system.open_input_file(inside) as file:
            video = video_of(file, file.size())
            if not len(video.offsets):
                raise ValueError(f"no frames in {partition.path}")
            fps = video.fps if 0 < video.fps <= 1000 else 30.0
            offsets = np.asarray(video.offsets[: self.most], np.int64)
            for k in np.flatnonzero((offsets >= partition.lo) & (offsets < partition.hi)).tolist():
                yield partition.path, k, video.height, video.width, video.gray(file.read_at(video.size, int(offsets[k]))), fps


class FilteredReader(ContainerReader):
    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Limits on frame_idx and one recording_id are kept to; all others are left to Spark."""
        for f in filters:
            if isinstance(f, LessThan | LessThanOrEqual) and f.attribute == ("frame_idx",):
                self.most = min(self.most, max(f.value + isinstance(f, LessThanOrEqual), 0))
            elif isinstance(f, EqualTo) and f.attribute == ("recording_id",):
                self.only = {f.value} if self.only is None else self.only & {f.value}
            else:
                yield f
