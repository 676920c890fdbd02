"""The tables of an inspection report: cover, classes, coverage, segments, findings.

Each carries ``provenance``, which names what detected and what verified, so that no table is read without it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayside.functions import text
from wayside.operators.findings import best_sighting
from wayside.operators.score import grade_for


def with_provenance(table: DataFrame, manifests: DataFrame) -> DataFrame:
    """``table`` with what its run's detections come from; ``manifests`` has run_id, backend and verifier."""
    origin = manifests.select("run_id", text.provenance(F.col("backend"), F.col("verifier")).alias("provenance"))
    return table.join(origin, "run_id", "left")


def cover(summary: DataFrame, manifests: DataFrame) -> DataFrame:
    """Headline figures of each run of ``manifests`` (run_id, backend, verifier, duration_sec, n_frames, n_detections, created, origin_lat, origin_lon).

    A run without a summary has an index of 100 over no length; findings for each kilometre are 0 where there is no length.
    """
    km = F.coalesce("route_length_m", F.lit(0.0)) / 1000
    n = F.coalesce("total_findings", F.lit(0)).cast("long")
    index = F.coalesce("quality_index", F.lit(100.0))
    rows = manifests.join(summary.select("run_id", "quality_index", "total_findings", "route_length_m"), "run_id", "left").select(
        "run_id", index.alias("quality_index"), grade_for(index).alias("grade"), n.alias("findings"), "n_detections", "n_frames", "duration_sec",
        F.round(km, 3).alias("route_km"), F.round(F.coalesce(F.try_divide(n, km), F.lit(0.0)), 1).alias("per_km"), "origin_lat", "origin_lon", "created",
    )
    return with_provenance(rows, manifests)


def classes(findings: DataFrame, taxonomy: DataFrame, absences: DataFrame, manifests: DataFrame) -> DataFrame:
    """Findings of each run by class, most first, equal ones by name, with label and colour, and whether they were inferred.

    ``taxonomy`` (cls, label, color) and ``absences`` (absence_key, label, color) are small; a class of neither goes by its name, in grey.
    """
    known = taxonomy.select("cls", "label", "color", F.lit(False).alias("inferred")).unionByName(absences.select(F.col("absence_key").alias("cls"), "label", "color", F.lit(True).alias("inferred")))
    n = findings.groupBy("run_id", "cls").agg(F.count(F.lit(1)).alias("n"), F.max("severity").alias("worst"))
    rank = F.row_number().over(Window.partitionBy("run_id").orderBy(F.col("n").desc(), "cls"))
    rows = n.join(F.broadcast(known), "cls", "left").select("run_id", rank.alias("place"), "cls", F.coalesce("label", "cls").alias("label"), F.coalesce("color", F.lit("#999999")).alias("color"), "n", "worst", F.coalesce("inferred", F.lit(False)).alias("inferred"))
    return with_provenance(rows, manifests)


def coverage(report: DataFrame, manifests: DataFrame) -> DataFrame:
    """``absence.coverage_report`` in words: whether each asset was there at all, and how often or over what length not."""
    there = F.col("found") > 0
    said = F.when(there, F.format_string("%d found, %.1f per km", F.col("found").cast("long"), "per_km")).otherwise(F.format_string("none over %.1f m (threshold %.1f m)", "route_m", F.col("min_gap_m").cast("double")))
    return with_provenance(report.select("run_id", "absence_key", "asset", there.alias("ok"), "found", "gaps", said.alias("finding")), manifests)


def segments(scored: DataFrame, manifests: DataFrame) -> DataFrame:
    """Segments worst first, equal ones in order of the route: the order of dispatch."""
    place = F.row_number().over(Window.partitionBy("run_id").orderBy("quality_index", "seg_id"))
    rows = scored.select("run_id", place.alias("place"), "seg_id", "quality_index", "color", "length_m", F.size("finding_ids").cast("long").alias("findings"), F.col("start.lat").alias("start_lat"), F.col("start.lon").alias("start_lon"))
    return with_provenance(rows, manifests)


def accuracy(method: Column, residual_m: Column, n_rays: Column) -> Column:
    """How well a finding's place is known: a fix has a residual, one projection has none, a camera's place isn't the object's."""
    fixed = (method == "triangulated") & residual_m.isNotNull()
    return F.when(fixed, F.format_string("%.2f m over %d rays", residual_m, n_rays.cast("long"))).when(method == "camera", "place of the camera").otherwise("2 to 4 m, one projection")


def facts(findings: DataFrame, absences: DataFrame, manifests: DataFrame) -> DataFrame:
    """A row for each finding, severest first, then by time: what stands on its page.

    ``findings`` come from ``findings.roll_up`` (absences of the same columns may be among them). The frame, box and range are those of
    the best sighting, null where there is none; ``absences`` (absence_key) are marked as inferred.
    """
    best = best_sighting(F.col("evidence"))
    keys = F.broadcast(absences.select(F.col("absence_key").alias("cls")).distinct().withColumn("_inferred", F.lit(True)))
    place = F.row_number().over(Window.partitionBy("run_id").orderBy(F.col("severity").desc(), "t_sec", "finding_id"))
    rows = findings.withColumn("_b", best).join(keys, "cls", "left").select(
        "run_id", place.alias("place"), "finding_id", "cls", "label", "severity", F.round(F.col("confidence") * 100, 1).alias("sure_percent"), F.size("evidence").cast("long").alias("sightings"),
        F.when(F.col("lat").isNotNull() & F.col("lon").isNotNull(), F.format_string("%.6f, %.6f", "lat", "lon")).otherwise("not placed").alias("position"),
        accuracy(F.col("pos_method"), F.col("pos_residual_m"), F.coalesce("n_rays", F.lit(0))).alias("accuracy"), "t_sec", F.col("_b.frame_id").alias("frame_id"),
        F.when(F.col("_b").isNotNull(), F.when(F.col("_b.range_m").isNotNull(), F.format_string("%.1f m ahead", "_b.range_m")).otherwise("not ranged")).alias("range"),
        F.when(F.col("_b").isNotNull(), F.format_string("[%.1f, %.1f, %.1f, %.1f]", *[F.col(f"_b.box.{c}") for c in ("x1", "y1", "x2", "y2")])).alias("box"),
        F.coalesce("_inferred", F.lit(False)).alias("inferred"),
    )
    return with_provenance(rows, manifests)


def triangulation_stats(findings: DataFrame) -> DataFrame:
    """For each run how many findings are fixed by rays, the rays, and the upper median of what they miss by."""
    fixed = F.col("pos_method") == "triangulated"
    misses = F.array_sort(F.collect_list(F.when(fixed, F.coalesce("pos_residual_m", F.lit(0.0)))))
    return (
        findings.groupBy("run_id").agg(F.count(F.lit(1)).alias("findings"), F.count_if(fixed).alias("triangulated"), F.coalesce(F.sum(F.when(fixed, F.col("n_rays"))), F.lit(0)).cast("long").alias("rays"), misses.alias("_m"))
        .withColumn("median_residual_m", F.get("_m", F.floor(F.size("_m") / 2).cast("int"))).drop("_m")
    )
