"""Classes of survey domains as tables: the class map, its order, lookups, and what runs show of it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayside.functions import text

# What a class has where its domain doesn't say, and the least radius of an absence.
COLOR, WEIGHT, ABSENCE_RADIUS_M = "#f59e0b", 1.0, 15.0
SPEC = ("label", "geometry", "cluster_radius_m", "weight", "alert", "color", "hint")


def class_map(classes: DataFrame, rules: DataFrame) -> DataFrame:
    """Every class of a domain, those that its absence rules make included: domain, cls, position, is_absence and SPEC.

    A class that the domain writes itself goes before a rule of that name, and keeps its own entry;
    of a class written twice the later entry counts, of a rule the earlier. ``position`` is the
    place in the domain: classes as written, then absences. It holds for one version of a domain, so
    tables keep ``cls`` and never it. ``classes`` has domain, ord, cls and SPEC, ``rules`` domain,
    rule_ord, absence_key, absence_label, min_gap_m, weight, alert, color and note.
    """
    own = classes.select("domain", "cls", F.lit(0).alias("rank"), F.col("ord").cast("long").alias("ord"), *SPEC)
    made = rules.select(
        "domain", F.col("absence_key").alias("cls"), F.lit(1).alias("rank"), F.col("rule_ord").cast("long").alias("ord"), F.col("absence_label").alias("label"),
        F.lit("segment").alias("geometry"), F.greatest("min_gap_m", F.lit(ABSENCE_RADIUS_M)).alias("cluster_radius_m"), "weight", "alert", "color", F.col("note").alias("hint"),
    )
    wins = F.struct("rank", F.when(F.col("rank") == 0, -F.col("ord")).otherwise(F.col("ord")))
    one = own.unionByName(made).groupBy("domain", "cls").agg(
        F.min(F.struct("rank", "ord")).alias("_at"), F.min_by(F.struct(*SPEC), wins).alias("_s"), (F.max("rank") == 1).alias("is_absence"))
    place = F.row_number().over(Window.partitionBy("domain").orderBy("_at")) - 1
    return one.select("domain", "cls", place.alias("position"), "is_absence", "_s.*")


def domains(classes: DataFrame) -> DataFrame:
    """The domains and how many classes each writes itself."""
    return classes.groupBy("domain").agg(F.count(F.lit(1)).alias("n_classes"))


def look_up(rows: DataFrame, known: DataFrame) -> DataFrame:
    """``rows`` (domain, cls, ...) with label, color, weight, is_absence, is_asset, is_known of their class.

    A class that the map ``known`` lacks is called by its own name in capitals. An asset weighs nothing.
    """
    k = known.select("domain", "cls", F.col("label").alias("_l"), F.col("color").alias("_c"), F.col("weight").alias("_w"), F.col("is_absence").alias("_a"))
    weight = F.coalesce("_w", F.lit(WEIGHT))
    return rows.join(k, ["domain", "cls"], "left").select(
        *[c for c in rows.columns if c not in ("label", "color", "weight", "is_absence", "is_asset", "is_known")],
        F.coalesce("_l", text.title(F.col("cls"))).alias("label"), F.coalesce("_c", F.lit(COLOR)).alias("color"), weight.alias("weight"),
        F.coalesce("_a", F.lit(False)).alias("is_absence"), (weight == 0).alias("is_asset"), F.col("_a").isNotNull().alias("is_known"),
    )


def clamp_known(detections: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Detections (domain, cls, severity, confidence, ...) of known classes, their numbers brought into band, and the refused others.

    Without a severity it is 3, without a confidence 0.
    """
    key = known.select("domain", "cls")
    into = lambda c, low, high, missing: F.greatest(low, F.least(high, F.coalesce(c, missing))).alias(c)
    banded = {"severity": into("severity", F.lit(1), F.lit(5), F.lit(3)), "confidence": into("confidence", F.lit(0.0), F.lit(1.0), F.lit(0.0))}
    sound = detections.join(key, ["domain", "cls"], "left_semi").withColumns(banded)
    return sound, detections.join(key, ["domain", "cls"], "left_anti")


def unknown_classes(detections: DataFrame, known: DataFrame) -> DataFrame:
    """Names that a model gave and the run's domain doesn't know (run_id, domain, cls, n): its skipped classes."""
    return detections.join(known.select("domain", "cls"), ["domain", "cls"], "left_anti").groupBy("run_id", "domain", "cls").agg(F.count(F.lit(1)).alias("n"))


def manifests(runs: DataFrame, known: DataFrame, artefacts: DataFrame) -> DataFrame:
    """Runs (run_id, domain, ...) with the classes of their domain in order, and which side files they have.

    ``artefacts`` is (run_id, name). A run of an unknown domain has no classes.
    """
    entry = F.struct("position", "cls", "label", "color", "geometry", "alert", "weight", "is_absence")
    classes = known.groupBy("domain").agg(F.array_sort(F.collect_list(entry)).alias("classes"))
    return with_artefacts(runs.join(classes, "domain", "left").withColumn("classes", F.coalesce("classes", F.array())), artefacts)


def with_artefacts(runs: DataFrame, artefacts: DataFrame) -> DataFrame:
    """Runs with has_pointcloud, has_basemap and has_video."""
    have = lambda name: F.bool_or(F.col("name") == name)
    video = F.bool_or(F.lower("name").rlike(r"\.(mp4|mov|mkv|avi|m4v|webm)$"))
    flags = artefacts.groupBy("run_id").agg(have("cloud.ply").alias("has_pointcloud"), have("basemap.jpg").alias("has_basemap"), video.alias("has_video"))
    return runs.join(flags, "run_id", "left").na.fill(False, ["has_pointcloud", "has_basemap", "has_video"])


def visible(findings: DataFrame, play: DataFrame, chosen: DataFrame, streamed: DataFrame | None = None) -> DataFrame:
    """Findings that a viewer shows: of the run's ``chosen`` classes (all, if it chose none), and already past.

    Past is a time up to ``play_t`` of ``play`` (run_id, play_t); while a run streams it is to be
    among ``streamed`` (run_id, finding_id) instead. ``chosen`` is (run_id, cls).
    """
    picky = chosen.select("run_id").distinct().withColumn("_picky", F.lit(True))
    wanted = chosen.select("run_id", "cls").distinct().withColumn("_wanted", F.lit(True))
    f = findings.join(picky, "run_id", "left").join(wanted, ["run_id", "cls"], "left").filter("_picky is null or _wanted").drop("_picky", "_wanted")
    if streamed is not None:
        return f.join(streamed.select("run_id", "finding_id"), ["run_id", "finding_id"], "left_semi")
    return f.join(play.select("run_id", "play_t"), "run_id").filter(F.col("t_sec") <= F.col("play_t") + 1e-6).drop("play_t")
