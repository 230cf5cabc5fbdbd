"""Sources of frames and tables.

``frames`` come from Parquet, from raw uint8 files, or from a registered
decoder: no video codec is installed here, so compressed video needs one that
the caller brings.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.vectorized import vectorized

FRAMES = "recording_id string, frame_idx int, height int, width int, pixels binary, fps double"
MOST_BYTES, MOST_FRAMES = 300 * 1024 * 1024, 3000


def read_raw(spark: SparkSession, path: str, height: int, width: int, fps: float = 30.0, most_frames: int = MOST_FRAMES, most_bytes: int = MOST_BYTES) -> DataFrame:
    """Frames of files that hold uint8 pixels frame after frame, each cut to ``most_frames``; one of over ``most_bytes`` is an error that names it."""
    files = spark.read.format("binaryFile").load(path)
    # listed without their content
    large = [r.path for r in files.where(F.col("length") > most_bytes).select("path").limit(5).collect()]
    if large:
        raise ValueError(f"over {most_bytes} bytes: {', '.join(large)}")
    size = height * width
    n = F.least(F.floor(F.col("length") / size).cast("int"), F.lit(most_frames))
    rows = files.where(F.col("length") >= size).select("path", "content", F.explode(F.sequence(F.lit(0), n - 1)).alias("frame_idx"))
    return rows.select(F.col("path").alias("recording_id"), "frame_idx", F.lit(height).alias("height"), F.lit(width).alias("width"), F.expr(f"substring(content, frame_idx * {size} + 1, {size})").alias("pixels"), F.lit(float(fps)).alias("fps"))


class VideoSource(DataSource):
    """``spark.read.format("recordings")``: options path (comma-separated files), decoder (module:function), most_frames.

    The decoder takes a path and yields frames as 2-D uint8 arrays after first
    yielding the frame rate; each file is a partition.
    """

    @classmethod
    def name(cls) -> str:
        return "recordings"

    def schema(self) -> str:
        return FRAMES

    def reader(self, schema) -> DataSourceReader:
        return _VideoReader(self.options)


class _VideoReader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths, self.decoder, self.most = options["path"].split(","), options["decoder"], int(options.get("most_frames", MOST_FRAMES))

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(p) for p in self.paths]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        from importlib import import_module

        module, name = self.decoder.split(":")
        decode: Callable = getattr(import_module(module), name)
        stream = iter(decode(partition.value))
        rate = next(stream, None)
        rate = float(rate) if rate and 0 < rate <= 1000 else 30.0
        n = 0
        for n, frame in enumerate(stream, 1):
            yield partition.value, n - 1, frame.shape[0], frame.shape[1], np.ascontiguousarray(frame, np.uint8).tobytes(), rate
            if n >= self.most:
                break
        if not n:
            raise ValueError(f"no frames in {partition.value}")


def read_csv(spark: SparkSession, path: str, sep: str = ",", header: bool = True, schema: str | None = None) -> DataFrame:
    reader = spark.read.option("header", header).option("sep", sep)
    return (reader.schema(schema) if schema else reader).csv(path)


def read_trace(spark: SparkSession, path: str) -> DataFrame:
    """A two-column trace (milliseconds, value; tabs, no header) as a signal; fps from the median step."""
    from pyspark.sql import Window

    rows = read_csv(spark, path, "\t", False, "ms double, raw double").withColumn("recording_id", F.input_file_name())
    order = Window.partitionBy("recording_id").orderBy("ms")
    rows = rows.withColumn("idx", F.row_number().over(order) - 1).withColumn("step", F.col("ms") - F.lag("ms").over(order))
    rate = rows.groupBy("recording_id").agg((1000 / F.median("step")).alias("fps"))
    return rows.join(rate, "recording_id").select("recording_id", "idx", "raw", "fps")


@vectorized("binary")
def png(pixels: pd.Series, height: pd.Series, width: pd.Series) -> pd.Series:
    """Grayscale PNG of uint8 pixels."""

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    def encode(p, h, w) -> bytes:
        rows = np.frombuffer(p, np.uint8).reshape(h, w)
        lines = np.concatenate([np.zeros((h, 1), np.uint8), rows], axis=1).tobytes()
        return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")

    return pd.Series([encode(*row) for row in zip(pixels, height, width)])


def first_frames(frames: DataFrame) -> DataFrame:
    """recording_id and its first frame as PNG."""
    return frames.where("frame_idx = 0").select("recording_id", png("pixels", "height", "width").alias("png"))
