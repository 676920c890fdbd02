"""Which frames a step takes, and in what order reports list their rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def first_frames(frames: DataFrame, n: int) -> DataFrame:
    """The first ``n`` frames of each run, all for 0."""
    return frames.filter(F.col("frame_idx") < n) if n > 0 else frames


def strided(frames: DataFrame, stride: int) -> DataFrame:
    return frames.filter(F.col("frame_idx") % max(stride, 1) == 0)


def in_band(frames: DataFrame, start_s: float, end_s: float, every: int) -> DataFrame:
    """Every ``every``-th frame of each run, counted from the first whose time is in the band."""
    place = F.row_number().over(Window.partitionBy("run_id").orderBy("frame_idx")) - 1
    return frames.filter(F.col("t_sec").between(start_s, end_s)).withColumn("_at", place).filter(F.col("_at") % max(every, 1) == 0).drop("_at")


def kept_frames(times: DataFrame, kept: DataFrame, images: DataFrame | None = None) -> DataFrame:
    """True times (run_id, frame_idx, t_sec) of the frames kept (run_id, frame_idx), indices past the end left out.

    ``images`` (run_id, n_images) says how many came out; times beyond that go.
    """
    found = times.join(kept.select("run_id", "frame_idx").distinct(), ["run_id", "frame_idx"], "left_semi")
    if images is None:
        return found
    place = F.row_number().over(Window.partitionBy("run_id").orderBy("frame_idx"))
    return found.withColumn("_at", place).join(images, "run_id").filter(F.col("_at") <= F.col("n_images")).drop("_at", "n_images")


def report_segments(segments: DataFrame) -> DataFrame:
    """Segments with their place in the report, the worst first."""
    return segments.withColumn("place", F.row_number().over(Window.partitionBy("run_id").orderBy("quality_index", "seg_id")))


def report_findings(findings: DataFrame) -> DataFrame:
    """Findings with their place in the report: by severity, then by time."""
    order = Window.partitionBy("run_id").orderBy(F.col("severity").desc(), "t_sec", "finding_id")
    return findings.withColumn("place", F.row_number().over(order))
