"""Findings as CSV, in and out."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayside.functions import text
from wayside.operators.findings import best_sighting
from wayside.operators.route import nearest_in_time

DEFAULT_SEVERITY, DEFAULT_CONFIDENCE = 3, 1.0


def resolve_classes(rows: DataFrame, taxonomy: DataFrame, name: str = "defect_name") -> DataFrame:
    """``rows`` with cls and known: by key, then by label, then by the name as a key; else that slug."""
    keys = taxonomy.select(F.lower("cls").alias("probe"), F.col("cls").alias("hit"), F.lit(0).alias("prio"))
    labels = taxonomy.select(F.lower(F.trim("label")).alias("probe"), F.col("cls").alias("hit"), F.col("ord") + 1)
    names = keys.union(labels).groupBy("probe").agg(F.min_by("hit", "prio").alias("hit"))
    probe = F.lower(F.trim(name))
    first = F.broadcast(names.toDF("_p1", "_h1"))
    second = F.broadcast(names.toDF("_p2", "_h2"))
    both = rows.join(first, probe == F.col("_p1"), "left").join(second, text.slug(F.col(name)) == F.col("_p2"), "left")
    return both.withColumn("cls", F.coalesce("_h1", "_h2", text.slug(F.col(name)))).withColumn("known", F.coalesce("_h1", "_h2").isNotNull()).drop("_p1", "_h1", "_p2", "_h2")


def unique_ids(rows: DataFrame) -> DataFrame:
    """``rows`` (run_id, row_no, ordinal, finding_id) with ids made unique: the first keeps it, later ones get their ordinal."""
    w = Window.partitionBy("run_id", "finding_id").orderBy("row_no")
    again = F.row_number().over(w) > 1
    fresh = F.when(again, F.concat("finding_id", F.lit("-"), F.col("ordinal").cast("string"))).otherwise(F.col("finding_id"))
    once = rows.withColumn("renamed", again).withColumn("finding_id", fresh)
    clash = F.row_number().over(Window.partitionBy("run_id", "finding_id").orderBy("renamed", "row_no")) > 1
    return once.withColumn("finding_id", F.when(clash, F.concat("finding_id", F.lit("-"), F.col("ordinal").cast("string"))).otherwise(F.col("finding_id")))


def parse_rows(rows: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """Rows of text with parsed columns and flags of what was wrong with them; blank rows go."""
    kept = rows.filter(~(text.blank(F.col("object_id")) & text.blank(F.col("defect_name"))))
    named = kept.withColumn("defect_name", F.trim(F.coalesce(F.nullif("defect_name", F.lit("")), F.lit("Unknown"))))
    t, lat, lon = text.parse_time(F.col("time")), text.parse_number(F.col("lat")), text.parse_number(F.col("lon"))
    bad = (~text.blank(F.col("lat")) & lat.isNull()) | (~text.blank(F.col("lon")) & lon.isNull())
    severity = text.parse_severity(F.col("severity"))
    parsed = resolve_classes(named, taxonomy).withColumns({
        "bad_time": t.isNull(), "t": F.coalesce(t, F.lit(0.0)), "bad_coord": bad, "default_severity": severity.isNull(),
    })
    return parsed.withColumns({"lat": lat, "lon": lon, "severity": F.coalesce(severity, F.lit(DEFAULT_SEVERITY)), "confidence": F.coalesce(text.parse_confidence(F.col("confidence")), F.lit(DEFAULT_CONFIDENCE))})


def import_findings(rows: DataFrame, frames: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """Findings from CSV rows (run_id, row_no and the text columns).

    A row goes to the keyframe nearest in time, whose position fills in for a missing one. Without
    frames the row's own position stands.
    """
    parsed = parse_rows(rows, taxonomy)
    order = Window.partitionBy("run_id").orderBy("row_no")
    numbered = parsed.withColumn("ordinal", F.row_number().over(order)).withColumn(
        "finding_id", F.trim(F.when(F.col("object_id").isNull() | (F.col("object_id") == ""), F.col("ordinal").cast("string")).otherwise(F.col("object_id")))
    )
    named = F.coalesce(F.nullif("finding_id", F.lit("")), F.concat(F.lit("row-"), F.col("ordinal").cast("string")))
    nameless = F.col("finding_id") == ""
    numbered = unique_ids(numbered.withColumn("_nameless", nameless).withColumn("finding_id", named))
    numbered = numbered.withColumn("renamed", F.col("renamed") | F.col("_nameless")).drop("_nameless")
    points = frames.select("run_id", F.col("t_sec").alias("t"), "frame_id", F.col("lat").alias("f_lat"), F.col("lon").alias("f_lon"))
    near = nearest_in_time(numbered, points, ["frame_id", "f_lat", "f_lon"])
    own = F.nullif(F.trim("frame"), F.lit("")) if "frame" in rows.columns else F.lit(None).cast("string")
    return near.withColumns({
        "lat": F.coalesce("lat", "near.f_lat"), "lon": F.coalesce("lon", "near.f_lon"),
        "frame_id": F.coalesce("near.frame_id", own, F.concat(F.lit("f_"), F.coalesce("object_id", F.lit("0")))), "t_sec": F.col("t"),
    }).drop("near", "t", "time")


def sparse_frames(imported: DataFrame, frames: DataFrame) -> DataFrame:
    """Keyframes of the runs that have none, one for each imported finding with a place, in order of time."""
    bare = imported.join(frames.select("run_id").distinct(), "run_id", "left_anti").filter("lat is not null and lon is not null")
    at = F.row_number().over(Window.partitionBy("run_id").orderBy("t_sec", "row_no")) - 1
    return bare.select(
        "run_id", at.alias("frame_idx"), "frame_id", "t_sec", "lat", "lon", F.lit(0.0).alias("heading_deg"),
        F.concat(F.lit("frames/"), "frame_id", F.lit(".jpg")).alias("path"), F.lit(1920).alias("width"), F.lit(1080).alias("height"),
    )


def skipped_and_renamed(rows: DataFrame, imported: DataFrame) -> DataFrame:
    """For each run how many rows were blank, and how many ids were changed so that no finding is lost."""
    empty = text.blank(F.col("object_id")) & text.blank(F.col("defect_name"))
    blank = rows.groupBy("run_id").agg(F.count_if(empty).alias("blank"))
    return blank.join(imported.groupBy("run_id").agg(F.count_if(F.col("renamed")).alias("renamed")), "run_id", "left").na.fill(0, ["renamed"])


def import_counters(parsed: DataFrame) -> DataFrame:
    """For each run how many rows had a bad time or place, a default severity, an unknown class."""
    return parsed.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("rows"), *[F.count_if(F.col(c)).alias(c) for c in ("bad_time", "bad_coord", "default_severity")],
        F.count_if(~F.col("known")).alias("unknown"), F.array_sort(F.collect_set(F.when(~F.col("known"), F.col("defect_name")))).alias("unknown_names"),
    )


def export_findings(findings: DataFrame, chainages: DataFrame, base_url: str = "") -> DataFrame:
    """The ten columns of the CSV, in order of time, ids from 1, with the best sighting's frame."""
    best = findings.withColumn("_b", best_sighting(F.col("evidence")))
    at = chainages.select("run_id", "frame_id", F.round(F.col("cum_m") / 1000.0, 3).alias("chainage_km"))
    number = F.row_number().over(Window.partitionBy("run_id").orderBy("t_sec", "finding_id"))
    return best.withColumn("frame", F.col("_b.frame_id")).join(at.withColumnRenamed("frame_id", "frame"), ["run_id", "frame"], "left").select(
        "run_id", number.alias("object_id"), "frame", text.time_text(F.col("t_sec")).alias("time"), F.col("label").alias("defect_name"),
        text.fixed(F.col("lat")).alias("lat"), text.fixed(F.col("lon")).alias("lon"), F.format_string("%.3f", "chainage_km").alias("chainage_km"),
        F.concat(F.lit(base_url), F.lit("frames/"), "frame", F.lit(".jpg")).alias("frame_url"), "severity", "confidence",
    )
