"""Frames and the next one of their recording, where all but the ends of a stretch meet where they stand.

Each task sorts its frames; what follows one another there is measured on the
spot. Only the first and the last frame of each stretch without a gap are
shuffled, to meet the stretch before or after. Frames that are stored in order
so cost two frames a file, and scattered ones as much as a join.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stored import written
from .blocks import image_of

#: What is measured on a frame and the next: any number of doubles.
Measure = Callable[[np.ndarray, np.ndarray], np.ndarray]

_COLUMNS = ["recording_id", "pair_idx", "height", "width", "fps", "m", "edge", "pixels"]


def stretches(frames: DataFrame, measure: Measure) -> DataFrame:
    """Pairs within stretches, with ``m``, and the stretches' ends (edge: first or last), with their pixels; written.

    A last frame's pair_idx is its number, a first frame's the number before it.
    """

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        before = None
        for batch in batches:
            for row in batch.itertuples(index=False):
                size = (row.height, row.width, row.fps)
                if before is not None and before.recording_id == row.recording_id and before.frame_idx + 1 == row.frame_idx:
                    yield row.recording_id, before.frame_idx, *size, measure(image_of(before.pixels, *size[:2]), image_of(row.pixels, *size[:2])).tolist(), None, None
                else:
                    if before is not None:
                        yield before.recording_id, before.frame_idx, before.height, before.width, before.fps, None, "last", before.pixels
                    yield row.recording_id, row.frame_idx - 1, *size, None, "first", row.pixels
                before = row
        if before is not None:
            yield before.recording_id, before.frame_idx, before.height, before.width, before.fps, None, "last", before.pixels

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = []
        for row in rows(batches):
            held.append(row)
            if len(held) == 64:
                yield pd.DataFrame(held, columns=_COLUMNS, dtype=object)
                held = []
        yield pd.DataFrame(held, columns=_COLUMNS, dtype=object)

    kind = {c: frames.schema[c].dataType.simpleString() for c in ("recording_id", "pixels")}
    named = frames.select("recording_id", F.col("frame_idx").cast("int").alias("frame_idx"), F.col("height").cast("int").alias("height"), F.col("width").cast("int").alias("width"), F.col("fps").cast("double").alias("fps"), "pixels")
    schema = f"recording_id {kind['recording_id']}, pair_idx int, height int, width int, fps double, m array<double>, edge string, pixels {kind['pixels']}"
    return written(named.sortWithinPartitions("recording_id", "frame_idx").mapInPandas(run, schema), "stretches")


def firsts(found: DataFrame) -> DataFrame:
    """The first frames of the stretches, among them that of each recording: recording_id, frame_idx, height, width, fps, pixels."""
    return found.where("edge = 'first'").select("recording_id", (F.col("pair_idx") + 1).alias("frame_idx"), "height", "width", "fps", "pixels")


def joined(found: DataFrame, measure: Measure) -> DataFrame:
    """All pairs of ``stretches``: those within them, and those whose two frames are ends that meet here."""

    @F.pandas_udf("array<double>")
    def met(a: pd.Series, b: pd.Series, height: pd.Series, width: pd.Series) -> pd.Series:
        return pd.Series([measure(image_of(x, h, w), image_of(y, h, w)).tolist() for x, y, h, w in zip(a, b, height, width)])

    inside = found.where("edge is null").drop("edge", "pixels")
    last, first = found.where("edge = 'last'").drop("edge", "m"), found.where("edge = 'first'").select("recording_id", "pair_idx", F.col("pixels").alias("next"))
    across = last.join(first, ["recording_id", "pair_idx"]).withColumn("m", met("pixels", "next", "height", "width"))
    return inside.unionByName(across.select(*inside.columns))


def with_next(frames: DataFrame, measure: Measure) -> DataFrame:
    """recording_id, pair_idx, height, width, fps, m: what ``measure`` gives for each frame and the one with the next number.

    ``frames``: recording_id, frame_idx (unique in its recording), height, width,
    pixels (numbers or uint8 bytes), fps. Frames without a next one give no row.
    Height, width and fps are those of the first of the two.
    """
    return joined(stretches(frames, measure), measure)
