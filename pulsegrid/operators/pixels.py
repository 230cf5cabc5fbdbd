"""Frame operators: cropping, projections, intensities and differences.

``frames``: recording_id, frame_idx, height, width, pixels (array<double>,
row-major) and fps, one row a frame. Raw uint8 frames go through ``decoded``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectorized import vectorized
from .blocks import image_of
from .neighbours import with_next


@vectorized("array<double>")
def _bytes_to_doubles(pixels: pd.Series) -> pd.Series:
    return pd.Series([np.frombuffer(p, np.uint8).astype(float) for p in pixels])


def decoded(frames: DataFrame) -> DataFrame:
    """Frames whose pixels are uint8 bytes, with pixels as array<double>."""
    return frames.withColumn("pixels", _bytes_to_doubles("pixels"))


def with_fps(frames: DataFrame, override: float | None = None, most_frames: int = 3000) -> DataFrame:
    """The first ``most_frames`` of each recording; fps is the override unless it is null or 0, else its own, else 30 where that makes no sense."""
    own = F.when((F.col("fps") > 0) & (F.col("fps") <= 1000), F.col("fps")).otherwise(F.lit(30.0))
    return frames.where(F.col("frame_idx") < most_frames).withColumn("fps", F.lit(float(override)) if override else own)


def roi_box(x, y, w, h) -> tuple[Column, Column, Column, Column]:
    """Clamped box x0, y0, x1, y1 of a region; the far edge is clamped from the region as asked for."""
    W, H = F.col("width"), F.col("height")
    x0, y0 = F.least(F.greatest(F.lit(x), F.lit(0)), W - 1), F.least(F.greatest(F.lit(y), F.lit(0)), H - 1)
    return x0, y0, F.greatest(x0 + 1, F.least(F.lit(x + w), W)), F.greatest(y0 + 1, F.least(F.lit(y + h), H))


def crop(frames: DataFrame, x=None, y=None, w=None, h=None) -> DataFrame:
    """Frames cut to a region, which becomes their size; as they are if any number is missing."""
    if None in (x, y, w, h):
        return frames
    x0, y0, x1, y1 = roi_box(x, y, w, h)
    boxed = frames.withColumn("_b", F.struct(x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1")))
    rows = F.transform(F.sequence("_b.y0", F.col("_b.y1") - 1), lambda r: F.slice(F.col("pixels"), r * F.col("width") + F.col("_b.x0") + 1, F.col("_b.x1") - F.col("_b.x0")))
    return boxed.withColumn("pixels", F.flatten(rows)).withColumn("width", F.col("_b.x1") - F.col("_b.x0")).withColumn("height", F.col("_b.y1") - F.col("_b.y0")).drop("_b")


def _mean(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, v: a + v) / F.size(values)


def intensity(frames: DataFrame, mask: Column | None = None) -> DataFrame:
    """recording_id, idx, raw, fps: mean pixel of each frame, or of the pixels where the boolean array ``mask`` holds."""
    pixels = F.col("pixels") if mask is None else F.filter("pixels", lambda v, i: F.get(mask, i))
    if mask is not None:
        fits = F.assert_true(F.size(mask) == F.size("pixels"), F.lit("the mask and the frame differ in size"))
        frames = frames.where(fits.isNull())
    return frames.select("recording_id", F.col("frame_idx").alias("idx"), _mean(pixels).alias("raw"), "fps")


def _difference(a, b) -> Column:
    return _mean(F.zip_with(a, b, lambda x, y: F.abs(x - y)))


def consecutive_signal(frames: DataFrame) -> DataFrame:
    """Mean absolute difference of each frame and the next number; idx is the first one's. Only ends of stretches are shuffled, see ``neighbours``."""
    pairs = with_next(frames, lambda a, b: np.array([np.abs(b - a).mean()]))
    return pairs.select("recording_id", F.col("pair_idx").alias("idx"), F.get("m", F.lit(0)).alias("raw"), "fps")


def reference_signal(frames: DataFrame, chosen: DataFrame) -> DataFrame:
    """Mean absolute difference of each frame and its recording's reference (recording_id, reference_index)."""
    base = frames.join(chosen, "recording_id").where("frame_idx = reference_index").select("recording_id", F.col("pixels").alias("base"))
    return frames.join(base, "recording_id").select("recording_id", F.col("frame_idx").cast("int").alias("idx"), _difference("pixels", "base").alias("raw"), "fps")


def _maxima(batches: Iterator[pd.DataFrame], limit: int = 64 << 20) -> Iterator[pd.DataFrame]:
    """A running maximum for each recording and size of frame; given away when too many bytes are held."""
    held: dict[tuple, np.ndarray] = {}

    def given() -> pd.DataFrame:
        out = pd.DataFrame([(*key, v.tolist()) for key, v in held.items()], columns=["recording_id", "height", "width", "pixels"], dtype=object)
        held.clear()
        return out

    for batch in batches:
        for row in batch.itertuples(index=False):
            key, image = (row.recording_id, row.height, row.width), image_of(row.pixels, row.height, row.width).ravel()
            if key in held:
                np.maximum(held[key], image, out=held[key])
                continue
            held[key] = image
            if sum(v.nbytes for v in held.values()) > limit:
                yield given()
    yield given()


def projected(frames: DataFrame) -> DataFrame:
    """One row a recording: height, width and, as pixels, the greatest value of each pixel over its frames.

    A task keeps one running array a recording; only these are shuffled, and the
    second stage merges them as they come. Frames of one recording have one size.
    """
    kind = frames.schema["recording_id"].dataType.simpleString()
    schema = f"recording_id {kind}, height int, width int, pixels array<double>"
    partial = frames.select("recording_id", "height", "width", "pixels").mapInPandas(_maxima, schema)
    # sorted, so that a task holds one recording at a time
    return partial.repartition("recording_id").sortWithinPartitions("recording_id").mapInPandas(_merged, schema)


def _merged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    key, top = None, None
    for batch in batches:
        out = []
        for row in batch.itertuples(index=False):
            image = np.asarray(row.pixels, float)
            if key is None or key[0] != row.recording_id:
                if key is not None:
                    out.append((*key, top.tolist()))
                key, top = (row.recording_id, row.height, row.width), image.copy()
            elif key[1:] != (row.height, row.width):
                raise ValueError(f"frames of {key[0]!r} differ in size")
            else:
                np.maximum(top, image, out=top)
        yield pd.DataFrame(out, columns=["recording_id", "height", "width", "pixels"], dtype=object)
    if key is not None:
        yield pd.DataFrame([(*key, top.tolist())], columns=["recording_id", "height", "width", "pixels"], dtype=object)


def max_projection(frames: DataFrame) -> DataFrame:
    """recording_id, pos, v: greatest value of each pixel over the frames."""
    return projected(frames).select("recording_id", F.posexplode("pixels").alias("pos", "v"))
