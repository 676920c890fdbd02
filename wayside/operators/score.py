"""Route segments and their quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayside.operators.route import asof, chainage, segment_cuts
from wayside.sources.sinks import written

SEGMENT_M = 20.0
# Least index of each colour and grade.
RAMP = ((92, "#22c55e"), (82, "#84cc16"), (70, "#eab308"), (55, "#f59e0b"), (40, "#ea580c"), (25, "#dc2626"))
LOWEST_COLOR = "#b91c1c"
GRADES = ((90, "A"), (75, "B"), (60, "C"), (45, "D"), (30, "E"))


def _ladder(index: Column, steps, otherwise: str) -> Column:
    out = None
    for least, value in steps:
        out = F.when(index >= least, value) if out is None else out.when(index >= least, value)
    return out.otherwise(otherwise)


def color_for(index: Column) -> Column:
    return _ladder(index, RAMP, LOWEST_COLOR)


def grade_for(index: Column) -> Column:
    return _ladder(index, GRADES, "F")


def to_tenth(index: Column) -> Column:
    """``index`` to one decimal, halves up. It is scaled before it is rounded, which takes back the last bit that a sum of decimals is off by."""
    return F.round(index * 10.0, 0) / 10.0


def penalty(weight: Column, severity: Column, confidence: Column) -> Column:
    return F.when(weight <= 0, 0.0).otherwise(weight * severity * F.greatest(F.lit(0.35), confidence))


def build_segments(frames: DataFrame, findings: DataFrame, taxonomy: DataFrame, segment_m: float = SEGMENT_M, along: DataFrame | None = None) -> DataFrame:
    """Segments of each run with the quality of the findings first seen in them.

    A finding belongs to the segment whose time window holds it, the last one being open; those
    before the first frame belong to none. Segments tile a run in time, so membership is an as-of
    join on their starts, kept within the run by its key. ``along`` is the frames' chainage, where it has been written.
    """
    if along is None:
        along = written(chainage(frames).select("run_id", "frame_idx", "t_sec", "lat", "lon", "cum_m"), "chainage")
    at = along.select("run_id", "frame_idx", "t_sec", "lat", "lon", "cum_m").join(segment_cuts(frames, segment_m, along), ["run_id", "frame_idx"], "left_semi")
    w = Window.partitionBy("run_id").orderBy("frame_idx")
    here = F.struct("lat", "lon", "t_sec", "cum_m")
    segments = (
        at.withColumn("a", here).withColumn("b", F.lead(here).over(w)).withColumn("seg_id", (F.row_number().over(w) - 1).cast("int"))
        .withColumn("_next", F.lead(here, 2).over(w)).filter("b is not null")
        .select(
            "run_id", "seg_id", F.struct("a.lat", "a.lon").alias("start"), F.struct("b.lat", "b.lon").alias("end"),
            (F.col("b.cum_m") - F.col("a.cum_m")).alias("raw_m"), F.col("a.t_sec").alias("t_start"), F.col("b.t_sec").alias("t_end"),
            F.col("_next").isNull().alias("open_end"),
        )
    )
    segments = written(segments, "cuts")  # read for what is in them and for themselves
    members = members_of(segments, findings, taxonomy)
    density = F.coalesce("penalty", F.lit(0.0)) / F.greatest(F.col("raw_m") / SEGMENT_M, F.lit(0.5))
    scored = segments.join(members, ["run_id", "seg_id"], "left").withColumn("_i", F.greatest(F.lit(5.0), F.least(F.lit(100.0), 100.0 - density * 2.2)))
    return scored.select(
        "run_id", "seg_id", "start", "end", F.round("raw_m", 2).alias("length_m"), to_tenth(F.col("_i")).alias("quality_index"),
        color_for(F.col("_i")).alias("color"), F.coalesce("finding_ids", F.array().cast("array<string>")).alias("finding_ids"), "t_start", "t_end",
    )


def members_of(segments: DataFrame, findings: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """Sum of penalties and ids (by id) of each segment that has findings."""
    f = findings.join(F.broadcast(taxonomy.select("cls", "weight")), "cls", "left").select(
        "run_id", F.col("t_sec").alias("t"), "finding_id", penalty(F.coalesce("weight", F.lit(1.0)), F.col("severity"), F.col("confidence")).alias("_p")
    )
    held = asof(f, segments.select("run_id", F.col("t_start").alias("t"), "seg_id"), ["seg_id"]).withColumn("seg_id", F.col("before.seg_id")).filter("seg_id is not null")
    # from the least on: a sum in the order of the shuffle may lack a last bit, which decides indexes at a tie
    total = F.aggregate(F.array_sort(F.collect_list("_p")), F.lit(0.0), lambda a, x: a + x)
    return held.groupBy("run_id", "seg_id").agg(total.alias("penalty"), F.array_sort(F.collect_list("finding_id")).alias("finding_ids"))


def summarize(findings: DataFrame, segments: DataFrame) -> DataFrame:
    """Quality index, grade, counts and length of each run; a run without segments has index 100.

    ``raw_length_m`` is the length before it is rounded to a decimal, on which engines differ at ties. Segments have lengths in
    hundredths and indexes in tenths; these are summed as whole numbers, so that no order of rows decides a tie.
    """
    cents, tenths = F.round(F.col("length_m") * 100).try_cast("long"), F.round(F.col("quality_index") * 10).cast("long")
    s = segments.groupBy("run_id").agg(
        F.sum(cents).alias("_len"), F.sum(tenths * cents).alias("_ql"), (F.avg(tenths) / 10).alias("_q"), F.max("length_m").alias("_longest")
    )
    # NaN is the greatest number
    length = F.when(F.isnan("_longest"), F.col("_longest")).otherwise(F.coalesce(F.col("_len") / 100, F.lit(0.0)))
    by_class = findings.groupBy("run_id", "cls").agg(F.count(F.lit(1)).alias("n")).groupBy("run_id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("cls", "n")))).alias("counts"), F.sum("n").alias("total_findings")
    )
    by_severity = findings.groupBy("run_id", F.col("severity").cast("string").alias("s")).agg(F.count(F.lit(1)).alias("n")).groupBy("run_id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("s", "n")))).alias("severity_histogram")
    )
    overall = F.coalesce(F.when(F.isnan("_longest"), F.col("_longest")).when(F.col("_len") > 0, F.col("_ql") / (F.col("_len") * 10)).otherwise(F.col("_q")), F.lit(100.0))
    return s.join(by_class, "run_id", "full_outer").join(by_severity, "run_id", "full_outer").select(
        "run_id", to_tenth(overall).alias("quality_index"), grade_for(overall).alias("grade"), "counts", "severity_histogram",
        F.coalesce("total_findings", F.lit(0)).alias("total_findings"), F.round(length, 1).alias("route_length_m"),
        length.alias("raw_length_m"),
    )
