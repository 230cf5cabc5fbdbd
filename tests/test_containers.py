"""Containers that the tests write themselves: frames come back, in ranges, whatever the layout."""

import struct

import numpy as np
import pytest

from pulsegrid.operators import pixels
from pulsegrid.sources import containers


def y4m_bytes(frames, chroma="420jpeg", rate="F24:1", marks=None):
    n, h, w = frames.shape
    extra = {"mono": 0, "420jpeg": 2 * -(-w // 2) * -(-h // 2), "422": 2 * -(-w // 2) * h, "444": 2 * w * h}[chroma]
    lines = marks or [b"FRAME\n"] * n
    return f"YUV4MPEG2 W{w} H{h} {rate} Ip C{chroma}\n".encode() + b"".join(m + f.tobytes() + b"\x80" * extra for m, f in zip(lines, frames))


def chunk(kind, data):
    return kind + struct.pack("<I", len(data)) + data + b"\0" * (len(data) % 2)


def avi_bytes(frames, depth=1, downwards=False, palette=None, index=None, rate=(1, 25), fourcc=0, sound=False):
    """frames: gray (n, h, w) or colours (n, h, w, 3); index: None, from the list or from the file."""
    n, h, w = frames.shape[:3]
    stride = -(-w * depth // 4) * 4
    packed = np.zeros((n, h, stride), np.uint8)
    packed[:, :, : w * depth] = (frames if depth < 4 else np.concatenate([frames, np.zeros((n, h, w, 1), np.uint8)], -1)).reshape(n, h, -1)
    packed = packed if downwards or fourcc else packed[:, ::-1]
    form = struct.pack("<IiiHHIIiiII", 40, w, -h if downwards else h, 1, 8 * depth, fourcc, 0, 0, 0, 0, 0) + (b"" if palette is None else palette.tobytes())
    stream = lambda kind, body: chunk(b"LIST", b"strl" + chunk(b"strh", kind + b"\0" * 16 + struct.pack("<II", *rate) + b"\0" * 28) + chunk(b"strf", body))
    streams = (stream(b"auds", b"\0" * 18) if sound else b"") + stream(b"vids", form)
    head = chunk(b"LIST", b"hdrl" + chunk(b"avih", b"\0" * 56) + streams)
    number = b"01db" if sound else b"00db"
    parts, entries, at = [], [], 4
    for f in packed:
        for kind, data in ((b"00wb", b"snd"), (number, f.tobytes())) if sound else ((number, f.tobytes()),):
            parts.append(chunk(kind, data))
            entries.append((kind, 16, at, len(data)))
            at += len(parts[-1])
    start = 12 + len(head) + 8
    movie = chunk(b"LIST", b"movi" + b"".join(parts))
    table = b"" if index is None else chunk(b"idx1", b"".join(struct.pack("<4sIII", k, f, a + (start if index == "file" else 0), n) for k, f, a, n in entries))
    body = b"AVI " + head + movie + table
    return b"RIFF" + struct.pack("<I", len(body)) + body


RNG = np.random.default_rng(5)
GRAY = RNG.integers(0, 256, (37, 9, 11), dtype=np.uint8)
COLOUR = RNG.integers(0, 256, (6, 5, 7, 3), dtype=np.uint8)


def read(path, **options):
    reader = containers.ContainerReader({"path": str(path)} | {k: str(v) for k, v in options.items()})
    parts = reader.partitions()
    return parts, sorted((row for p in parts for row in reader.read(p)), key=lambda r: (r[0], r[1]))


def stacked(rows):
    return np.stack([np.frombuffer(r[4], np.uint8).reshape(r[2], r[3]) for r in rows])


@pytest.mark.parametrize("data,fps", [
    (y4m_bytes(GRAY), 24.0), (y4m_bytes(GRAY, "mono", "F30000:1001"), 30000 / 1001), (y4m_bytes(GRAY, "422", "F0:0"), 30.0), (y4m_bytes(GRAY, "444", "X1"), 30.0),
    (y4m_bytes(GRAY, marks=[b"FRAME Ip\n" if k % 3 else b"FRAME\n" for k in range(37)]), 24.0), (y4m_bytes(GRAY) + b"FRAME\nnot whole", 24.0),
    (avi_bytes(GRAY), 25.0), (avi_bytes(GRAY, index="list"), 25.0), (avi_bytes(GRAY, index="file", downwards=True), 25.0), (avi_bytes(GRAY, sound=True, index="list"), 25.0),
    (avi_bytes(GRAY, sound=True, rate=(0, 0)), 30.0), (avi_bytes(GRAY, fourcc=int.from_bytes(b"Y800", "little")), 25.0),
])
@pytest.mark.parametrize("split", [150, 1000, 1 << 26])
def test_gray_frames(tmp_path, data, fps, split):
    (tmp_path / "v").write_bytes(data)
    parts, rows = read(tmp_path / "v", split_bytes=split)
    assert len(parts) == -(-len(data) // split) and [r[1] for r in rows] == list(range(37)) and (stacked(rows) == GRAY).all()
    assert all(abs(r[5] - fps) < 1e-9 and (r[2], r[3]) == (9, 11) for r in rows)


@pytest.mark.parametrize("depth", [3, 4])
def test_colours_and_palettes(tmp_path, depth):
    want = np.floor(COLOUR[..., 0] * 0.114 + COLOUR[..., 1] * 0.587 + COLOUR[..., 2] * 0.299 + 0.5)
    (tmp_path / "v.avi").write_bytes(avi_bytes(COLOUR, depth, index="list"))
    assert np.abs(stacked(read(tmp_path / "v.avi")[1]) - want).max() <= 1
    table = np.zeros((256, 4), np.uint8)
    table[:, :3] = np.arange(256)[::-1, None]
    (tmp_path / "p.avi").write_bytes(avi_bytes(GRAY, palette=table))
    assert (stacked(read(tmp_path / "p.avi")[1]) == 255 - GRAY).all()


def test_what_cannot_be_read(tmp_path):
    for name, data, message in (("none", y4m_bytes(GRAY[:0]), "no frames"), ("deep", y4m_bytes(GRAY).replace(b"C420jpeg", b"C420p10"), "8 bits"), ("other", b"\x1aE\xdf\xa3 matroska", "neither"),
                                ("packed", avi_bytes(GRAY, fourcc=int.from_bytes(b"H264", "little")), "compressed"), ("empty", b"", "neither")):
        (tmp_path / name).write_bytes(data)
        with pytest.raises(ValueError, match=message):
            read(tmp_path / name)
    with pytest.raises(FileNotFoundError):
        read(tmp_path / "absent")


def test_source_in_spark(spark, tmp_path):
    """3,000 frames are many partitions, folders are read whole, and limits reach the reader."""
    long = np.arange(3200 * 12, dtype=np.int64).astype(np.uint8).reshape(3200, 3, 4)
    (tmp_path / "long.y4m").write_bytes(y4m_bytes(long, "mono"))
    (tmp_path / "short.avi").write_bytes(avi_bytes(GRAY, index="list"))
    spark.dataSource.register(containers.ContainerSource)
    frames = spark.read.format("containers").option("path", str(tmp_path)).option("split_bytes", 8000).load()
    assert frames.rdd.getNumPartitions() == -(-(3200 * 18 + 40) // 8000) + 1
    counts = {r.recording_id.rsplit("/")[-1]: r["count"] for r in frames.groupBy("recording_id").count().collect()}
    assert counts == {"long.y4m": 3000, "short.avi": 37}
    signal = pixels.intensity(pixels.decoded(frames)).where("recording_id like '%short%'").orderBy("idx").collect()
    assert np.abs(np.array([r.raw for r in signal]) - GRAY.mean((1, 2))).max() < 1e-9
    reader = containers.FilteredReader({"path": str(tmp_path)})
    kept = list(reader.pushFilters([containers.LessThan(("frame_idx",), 5), containers.EqualTo(("recording_id",), f"{tmp_path}/long.y4m"), containers.EqualTo(("height",), 3)]))
    assert len(kept) == 1 and [r[1] for p in reader.partitions() for r in reader.read(p)] == [0, 1, 2, 3, 4]
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        few = spark.read.format("containers").option("path", str(tmp_path)).option("push_filters", "true").load().where(f"frame_idx < 3 and recording_id = '{tmp_path}/long.y4m'")
        assert few.rdd.getNumPartitions() == 1 and sorted(r.frame_idx for r in few.collect()) == [0, 1, 2]
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
