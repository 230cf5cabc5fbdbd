"""Objects and texture of projections and volumes.

Objects that aren't parted, and the texture of volumes, are found in blocks, see
``blocks``. Touching objects are parted on one image or volume a task. What is
measured on the labels is aggregated from long rows (one a pixel) by Spark,
except the outline.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stored import written
from ..functions.vectorized import vectorized
from ..functions import kernels
from . import blocks, pairs, pixels


@vectorized("array<int>")
def _segment(image: pd.Series, shape: pd.Series, least: pd.Series, separate: pd.Series, distance: pd.Series) -> pd.Series:
    return pd.Series([kernels.segment(np.asarray(p, float).reshape(s), int(a), bool(b), int(c)).ravel().astype(np.int32) for p, s, a, b, c in zip(image, map(tuple, shape), least, separate, distance)])


def labelled(images: DataFrame, shape: Column, least: int, separate: bool, distance: int) -> DataFrame:
    """``images`` (recording_id, pixels) with labels, as long as the pixels; written, as all that is measured reads them again."""
    return written(images.withColumn("labels", _segment("pixels", shape, F.lit(least), F.lit(separate), F.lit(distance))), "labels")


@vectorized("array<struct<label int, perimeter double>>")
def _outlines(labels: pd.Series, height: pd.Series, width: pd.Series) -> pd.Series:
    out = []
    for values, h, w in zip(labels, height, width):
        grid = np.asarray(values).reshape(h, w)
        out.append([{"label": int(k), "perimeter": kernels.perimeter(grid == k)} for k in np.unique(grid) if k])
    return pd.Series(out)


def objects_2d(images: DataFrame) -> DataFrame:
    """Region properties of each label of ``images`` (recording_id, height, width, pixels, labels), by moments."""
    rows = images.select("recording_id", "width", F.posexplode(F.arrays_zip(F.col("labels").alias("l"), F.col("pixels").alias("p"))).alias("at", "v"))
    # column names of arrays_zip follow its arguments' positions where they are expressions
    rows = rows.toDF("recording_id", "width", "at", "v").selectExpr("recording_id", "v.l as label", "v.p as p", "cast(floor(at / width) as double) as r", "cast(at % width as double) as c").where("label > 0")
    return _regions_2d(rows).join(images.select("recording_id", F.inline(_outlines("labels", "height", "width"))), ["recording_id", "label"])


def _products(*pairs: str) -> list[Column]:
    """Aggregates ``_ab`` for each pair ab of ``pairs``: n * n times the covariance of whole numbers a and b, without rounding.

    A rounded one may turn the sign of an angle of an object that lies straight,
    by the order in which its pixels come.
    """
    whole = lambda c: F.sum(c.cast("decimal(20,0)"))
    one = lambda k: F.col(k).cast("long")
    n = F.count("*").cast("decimal(20,0)")
    return [(n * whole(one(a) * one(b)) - whole(one(a)) * whole(one(b))).alias(f"_{a}{b}") for a, b in pairs]


def _covariance(ab: str) -> Column:
    return F.col(f"_{ab}").cast("double") / (F.col("n").cast("double") * F.col("n"))


def _regions_2d(rows: DataFrame) -> DataFrame:
    """Properties of each label of ``rows`` (recording_id, label, p, r, c), but for the outline."""
    m = rows.groupBy("recording_id", "label").agg(F.count("*").alias("n"), F.avg("p").alias("mean_intensity"), F.avg("r").alias("r"), F.avg("c").alias("c"), *_products("rr", "cc", "rc"))
    rr, cc, rc = _covariance("rr") + 1 / 12, _covariance("cc") + 1 / 12, _covariance("rc")
    apart = (F.col("_rr") - F.col("_cc")).cast("double") / (F.col("n").cast("double") * F.col("n"))
    root = F.sqrt(apart * apart + 4 * rc * rc)
    big, small = (rr + cc + root) / 2, F.greatest((rr + cc - root) / 2, F.lit(0.0))
    # the long axis from the row axis, in -pi/2..pi/2
    angle = F.when((apart == 0) & (rc == 0), F.lit(0.0)).otherwise(0.5 * F.atan2(2 * rc, apart))
    return m.select(
        "recording_id", "label", F.col("n").alias("area"), F.sqrt(F.when(big > 0, 1 - small / big).otherwise(0.0)).alias("eccentricity"), angle.alias("orientation"),
        (4 * F.sqrt(big)).alias("major_axis_length"), (4 * F.sqrt(small)).alias("minor_axis_length"), F.sqrt(4 * F.col("n") / F.pi()).alias("equivalent_diameter_area"),
        "mean_intensity", F.col("r").alias("centroid-0"), F.col("c").alias("centroid-1"), F.degrees(angle).alias("orientation_deg"),
    )


@vectorized("struct<axis_z double, axis_y double, axis_x double>")
def _long_axis(zz: pd.Series, zy: pd.Series, zx: pd.Series, yy: pd.Series, yx: pd.Series, xx: pd.Series) -> pd.DataFrame:
    """The direction of greatest spread, which is that of least inertia; its sign is free."""
    spread = np.stack([zz, zy, zx, zy, yy, yx, zx, yx, xx], 1).astype(float).reshape(-1, 3, 3)
    return pd.DataFrame(np.linalg.eigh(spread)[1][:, :, 2], columns=["axis_z", "axis_y", "axis_x"])


def objects_3d(volumes: DataFrame) -> DataFrame:
    """Volume, diameter, intensity, centroid and long axis of each label of ``volumes`` (recording_id, height, width, pixels, labels)."""
    rows = volumes.select("recording_id", "height", "width", F.posexplode(F.arrays_zip(F.col("labels").alias("l"), F.col("pixels").alias("p"))).alias("at", "v"))
    rows = rows.selectExpr("recording_id", "v.l as label", "v.p as p", "cast(floor(at / (height * width)) as double) as z", "cast(floor(at / width) % height as double) as y", "cast(at % width as double) as x").where("label > 0")
    return _regions_3d(rows)


def _regions_3d(rows: DataFrame) -> DataFrame:
    kinds = ("zz", "zy", "zx", "yy", "yx", "xx")
    m = rows.groupBy("recording_id", "label").agg(F.count("*").alias("n"), F.avg("p").alias("mean_intensity"), *[F.avg(k).alias(k) for k in "zyx"], *_products(*kinds))
    m, axis = m.withColumn("volume_voxels", F.col("n")), _long_axis(*[_covariance(k) for k in kinds])
    return m.withColumn("axis", axis).select(
        "recording_id", "label", "volume_voxels", F.pow(6 * F.col("volume_voxels") / F.pi(), F.lit(1 / 3)).alias("equivalent_diameter_area"), "mean_intensity",
        F.col("z").alias("centroid-0"), F.col("y").alias("centroid-1"), F.col("x").alias("centroid-2"), "axis.axis_z", "axis.axis_y", "axis.axis_x",
    )


def _kept(images: DataFrame, found: DataFrame, zero: dict) -> DataFrame:
    return images.select("recording_id").join(found, "recording_id", "left").na.fill(zero)


def merged_objects_2d(images: DataFrame, least: int, shape: blocks.Shape = blocks.Shape(1, 512, 512, 2)) -> DataFrame:
    """Region properties of objects that aren't parted, of ``images`` (recording_id, height, width, pixels), tile by tile."""
    tiles = blocks.labelled(images.withColumn("frame_idx", F.lit(0)), least, shape, True)
    rows = blocks.label_rows(tiles).select("recording_id", "label", "p", F.col("y").cast("double").alias("r"), F.col("x").cast("double").alias("c"))
    return _regions_2d(rows).join(blocks.outline_lengths(tiles), ["recording_id", "label"])


def merged_objects_3d(frames: DataFrame, least: int, shape: blocks.Shape = blocks.Shape(16, 512, 512, 1)) -> DataFrame:
    """The same of volumes, slab by slab."""
    rows = blocks.label_rows(blocks.labelled(frames, least, shape, False))
    return _regions_3d(rows.withColumns({k: F.col(k).cast("double") for k in "zyx"}))


def morphology_2d(frames: DataFrame, least: int = 30, separate: bool = True, distance: int = 10, texture: bool = False) -> tuple[DataFrame, DataFrame]:
    """Objects and summary of each recording's projection."""
    images = written(pixels.projected(frames), "projected")
    objects = objects_2d(labelled(images, F.array("height", "width"), least, separate, distance)) if separate else merged_objects_2d(images, least)
    found = objects.groupBy("recording_id").agg(F.count("*").alias("n_objects"), F.avg("area").alias("mean_area_px"), F.median("area").alias("median_area_px"), F.avg("eccentricity").alias("mean_eccentricity"), F.sum("area").cast("double").alias("total_covered_area_px"))
    aligned = pairs.circular_alignment(objects.withColumn("weight", F.lit(1.0)), "orientation").drop("n")
    summary = _kept(images, found.join(aligned, "recording_id", "left"), {"n_objects": 0, "total_covered_area_px": 0.0})
    sized = images.select("recording_id", (F.col("height") * F.col("width")).alias("image_area_px"))
    summary = summary.join(sized, "recording_id").withColumn("coverage_fraction", F.col("total_covered_area_px") / F.col("image_area_px"))
    return objects, summary.join(texture_2d(images), "recording_id", "left") if texture else summary


def volumes_of(frames: DataFrame) -> DataFrame:
    """Frames read as slices of a volume, one row a recording: height, width, depth, pixels."""
    rows = frames.groupBy("recording_id").agg(F.max("height").alias("height"), F.max("width").alias("width"), F.count("*").alias("depth"), F.sort_array(F.collect_list(F.struct("frame_idx", "pixels"))).alias("s"))
    return rows.select("recording_id", "height", "width", "depth", F.flatten(F.transform("s", lambda s: s["pixels"])).alias("pixels"))


def morphology_3d(frames: DataFrame, least: int = 100, separate: bool = True, distance: int = 10, texture: bool = False) -> tuple[DataFrame, DataFrame]:
    """Objects and summary of each recording read as a volume, whose frames are numbered from 0 without gaps."""
    sizes = frames.groupBy("recording_id").agg(F.count("*").cast("int").alias("depth"), F.max("height").alias("height"), F.max("width").alias("width"))
    objects = objects_3d(labelled(volumes_of(frames), F.array(F.col("depth").cast("int"), "height", "width"), least, True, distance)) if separate else merged_objects_3d(frames, least)
    found = objects.groupBy("recording_id").agg(F.count("*").alias("n_objects"), F.avg("volume_voxels").alias("mean_volume_voxels"), F.median("volume_voxels").alias("median_volume_voxels"), F.sum("volume_voxels").alias("total_volume_voxels"))
    aligned = pairs.nematic_alignment(objects.select("recording_id", F.col("axis_z").alias("z"), F.col("axis_y").alias("y"), F.col("axis_x").alias("x"), F.lit(1.0).alias("weight"))).drop("n")
    summary = _kept(sizes, found.join(aligned, "recording_id", "left"), {"n_objects": 0, "total_volume_voxels": 0})
    summary = summary.join(sizes.select("recording_id", F.array("depth", "height", "width").alias("stack_shape_zyx")), "recording_id")
    return objects, summary.join(blocks.texture_3d(frames), "recording_id", "left") if texture else summary


@vectorized("struct<c double, s double, w double, n long>")
def _texture_sums(image: pd.Series, height: pd.Series, width: pd.Series) -> pd.DataFrame:
    out = []
    for p, h, w in zip(image, height, width):
        theta, coherence = kernels.orientation_2d(np.asarray(p, float).reshape(h, w))
        out.append(((coherence * np.cos(2 * theta)).sum(), (coherence * np.sin(2 * theta)).sum(), coherence.sum(), coherence.size))
    return pd.DataFrame(out, columns=["c", "s", "w", "n"])


def texture_2d(images: DataFrame) -> DataFrame:
    """texture_alignment_score, texture_mean_orientation_deg, texture_mean_coherence; angles weigh by coherence."""
    t = images.select("recording_id", _texture_sums("pixels", "height", "width").alias("t")).select("recording_id", "t.*")
    score = F.when(F.col("w") > 0, F.sqrt(F.col("c") * F.col("c") + F.col("s") * F.col("s")) / F.col("w"))
    return t.select("recording_id", score.alias("texture_alignment_score"), F.when(F.col("w") > 0, F.degrees(F.atan2("s", "c") / 2)).alias("texture_mean_orientation_deg"), (F.col("w") / F.col("n")).alias("texture_mean_coherence"))


@vectorized("array<struct<hue double, value double>>")
def _hues(image: pd.Series, height: pd.Series, width: pd.Series) -> pd.Series:
    out = []
    for p, h, w in zip(image, height, width):
        theta, coherence = kernels.orientation_2d(np.asarray(p, float).reshape(h, w))
        hue, value = (theta + np.pi / 2) / np.pi, coherence / (coherence.max() + 1e-9)
        out.append([{"hue": a, "value": b} for a, b in zip(hue.ravel().tolist(), value.ravel().tolist())])
    return pd.Series(out)


def orientation_map(images: DataFrame) -> DataFrame:
    """recording_id, y, x, hue (once around for half a turn), value (coherence, of the image's greatest)."""
    rows = images.select("recording_id", "width", F.posexplode(_hues("pixels", "height", "width")).alias("at", "h"))
    return rows.select("recording_id", F.floor(F.col("at") / F.col("width")).cast("int").alias("y"), (F.col("at") % F.col("width")).cast("int").alias("x"), "h.hue", "h.value")


@vectorized("array<int>")
def _outer(labels: pd.Series, height: pd.Series, width: pd.Series) -> pd.Series:
    return pd.Series([np.flatnonzero(kernels.outer_boundaries(np.asarray(v).reshape(h, w))).astype(np.int32) for v, h, w in zip(labels, height, width)])


def outlines(images: DataFrame) -> DataFrame:
    """recording_id, y, x of the pixels just outside the labels of ``images`` (recording_id, height, width, labels), or where two touch."""
    at = images.select("recording_id", "width", F.explode(_outer("labels", "height", "width")).alias("at"))
    return at.select("recording_id", F.floor(F.col("at") / F.col("width")).cast("int").alias("y"), (F.col("at") % F.col("width")).cast("int").alias("x"))
