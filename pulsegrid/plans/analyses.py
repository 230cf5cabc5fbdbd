"""The front door: one call for each analysis, over as many recordings as there are."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import beats, calcium, groups, images, pairs, pixels
from ..sources import recordings

TYPES = ("beating", "calcium", "morphology")


def analyze(frames: DataFrame, analysis_type: str, mode: str = "2d", least: int | None = None, **options) -> tuple[DataFrame, DataFrame]:
    """Events or objects, and one summary row a recording.

    ``least``, the smallest object, is 30 pixels in two dimensions and 100 voxels
    in three unless given; a caller that wants 30 voxels says so.
    """
    if analysis_type == "beating":
        return beats.beating(frames, beats.BeatParams(**options))[1:]
    if analysis_type == "calcium":
        return calcium.calcium(frames, **options)[1:]
    if analysis_type == "morphology":
        if mode == "3d":
            return images.morphology_3d(frames, 100 if least is None else least, **options)
        return images.morphology_2d(frames, 30 if least is None else least, **options)
    raise ValueError(f"unknown analysis {analysis_type!r}; there are {TYPES}")


def batch(frames: DataFrame, analysis_type: str, mode: str = "2d") -> DataFrame:
    """Summaries of many files, the file first, with default parameters."""
    summary = analyze(frames, analysis_type, mode)[1]
    return summary.select(F.col("recording_id").alias("filename"), *[c for c in summary.columns if c != "recording_id"])


def compare(frames: DataFrame, assignments: DataFrame, analysis_type: str, mode: str = "2d") -> DataFrame:
    """Groups of recordings compared metric by metric; ``assignments``: recording_id, group_idx, label, cluster (null without batches)."""
    summary = analyze(frames, analysis_type, mode)[1].join(assignments, "recording_id")
    count = assignments.agg(F.countDistinct("group_idx")).first()[0]
    return groups.compare_groups(groups.unpivoted(summary), count)


def agreement_of_csv(spark: SparkSession, path: str, column_a: str, column_b: str) -> tuple[DataFrame, DataFrame]:
    """Per-pair rows and agreement statistics of two columns of a CSV file."""
    rows = pairs.complete_pairs(recordings.read_csv(spark, path), column_a, column_b).withColumn("pair_id", F.lit(f"{column_a} / {column_b}"))
    return pairs.bland_altman_rows(rows), pairs.agreement(rows)


def colocalize(frames_a: DataFrame, frames_b: DataFrame) -> DataFrame:
    """Overlap of two channels, recording by recording, on their projections."""
    a, b = (pixels.projected(f).withColumnRenamed("recording_id", "image_id") for f in (frames_a, frames_b))
    return pairs.colocalize(a, b)
