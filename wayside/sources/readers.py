"""Scans. Each returns a table with run_id; schemas are given, never inferred."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

POINT = "struct<_lat:double,_lon:double,time:string>"
FRAME = "frame_id string, t_sec double, ts string, lat double, lon double, heading_deg double, path string, width int, height int"
DETECTION = "frame_id string, cls string, box array<double>, severity int, confidence double, evidence string, lat double, lon double, range_m double, anchor string"
FINDING = "finding_id string, cls string, label string, geometry string, lat double, lon double, severity int, confidence double, t_sec double, evidence array<struct<frame_id:string,cls:string,box:array<double>,severity:int,confidence:double>>"

SEGMENT = "seg_id int, start array<double>, end array<double>, length_m double, quality_index double, color string, finding_ids array<string>, t_start double, t_end double"
OBJECT = "cls string, s_m double, lateral_m double, lat double, lon double, severity int"
CLASS = "key:string,label:string,geometry:string,cluster_radius_m:double,weight:double,alert:boolean,hint:string,color:string"
RULE = "key:string,label:string,asset:string,min_gap_m:double,weight:double,severity:int,color:string,alert:boolean,note:string"
# What a class or an absence rule has where its file says nothing.
CLASS_USUAL = {"geometry": "point", "cluster_radius_m": 3.0, "weight": 1.0, "alert": False, "hint": "", "color": "#f59e0b"}
RULE_USUAL = {"min_gap_m": 30.0, "weight": 1.5, "severity": 3, "color": "#78716c", "alert": False, "note": ""}


def run_of(depth: int = 1) -> Column:
    """The run's name: the folder ``depth`` levels above the file."""
    return F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1 - depth)


def read_gpx(spark: SparkSession, path: str) -> DataFrame:
    """Track points (run_id, seq, lat, lon, t, start_ts) of GPX files, one for each run.

    All segments in order; if any point is stamped the others go and t counts from the first, else
    points are a second apart. Files without track points give their way points.
    """
    def points(tag: str, schema: str, array: Column) -> DataFrame:
        raw = spark.read.format("xml").option("rowTag", tag).schema(schema).load(path)
        return raw.select(run_of().alias("run_id"), F.monotonically_increasing_id().alias("_r"), F.posexplode(array).alias("_i", "p"))

    tracked = points("trkseg", f"trkpt array<{POINT}>", F.col("trkpt"))
    single = points("wpt", "_lat double, _lon double, time string", F.array(F.struct("_lat", "_lon", "time")))
    every = tracked.unionByName(single.join(tracked.select("run_id").distinct(), "run_id", "left_anti"))
    run = Window.partitionBy("run_id")
    stamped = every.withColumn("at", F.to_timestamp("p.time")).withColumn("_any", F.max(F.col("at").isNotNull()).over(run)).filter("not _any or at is not null")
    order = run.orderBy("_r", "_i")
    seq = (F.row_number().over(order) - 1).cast("int")
    start = F.first("at").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    t = F.when(F.col("_any"), (F.unix_micros("at") - F.unix_micros(F.col("start_ts"))) / 1e6).otherwise(F.col("seq").cast("double"))
    return stamped.withColumn("seq", seq).withColumn("start_ts", start).select("run_id", "seq", F.col("p._lat").alias("lat"), F.col("p._lon").alias("lon"), t.alias("t"), "start_ts")


def spread_waypoints(points: DataFrame, durations: DataFrame) -> DataFrame:
    """Way points (run_id, seq, lat, lon) evenly over each run's duration; runs of one point have none."""
    n = F.count(F.lit(1)).over(Window.partitionBy("run_id"))
    span = F.coalesce(F.nullif("duration_s", F.lit(0.0)), F.col("n") - 1.0)
    return points.withColumn("n", n).filter("n >= 2").join(durations, "run_id", "left").withColumn("t", F.col("seq") * span / (F.col("n") - 1)).drop("n", "duration_s")


def parse_frame_times(lines: DataFrame) -> DataFrame:
    """Sorted times from (run_id, value) lines of comma or blank separated tokens; unreadable ones go."""
    token = F.explode(F.split("value", r"[,\s]+"))
    times = lines.select("run_id", token.alias("x")).select("run_id", F.col("x").try_cast("double").alias("t_sec")).filter("t_sec is not null")
    return times.withColumn("frame_idx", F.row_number().over(Window.partitionBy("run_id").orderBy("t_sec")) - 1)


def parse_fps(rate: Column) -> Column:
    """``num/den`` or a number; 0 if it can't be read."""
    at = lambda i: F.get(F.split(rate, "/"), F.lit(i)).try_cast("double")
    return F.coalesce(F.when(F.size(F.split(rate, "/")) == 2, F.try_divide(at(0), at(1))).otherwise(rate.try_cast("double")), F.lit(0.0))


def read_findings_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV rows as text with run_id and row_no in file order; a byte-order mark is no part of a name."""
    raw = spark.read.option("header", True).option("multiLine", True).csv(path)
    raw = raw.toDF(*[c.lstrip("﻿") for c in raw.columns])
    order = Window.partitionBy("run_id").orderBy("_m")
    return raw.withColumn("run_id", run_of()).withColumn("_m", F.monotonically_increasing_id()).withColumn("row_no", F.row_number().over(order)).drop("_m")


def read_detections(spark: SparkSession, path: str) -> DataFrame:
    """Detections from lines of JSON with run_id and det_seq, the order in the file."""
    raw = spark.read.schema(DETECTION).json(path).filter("frame_id is not null")
    return raw.withColumn("run_id", run_of()).withColumn("det_seq", F.monotonically_increasing_id())


def read_frames(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.schema(FRAME).option("multiLine", True).json(path).withColumn("run_id", run_of())
    order = Window.partitionBy("run_id").orderBy("t_sec", "frame_id")
    return raw.withColumn("frame_idx", F.row_number().over(order) - 1).withColumn("ts", F.to_timestamp("ts"))


def read_findings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FINDING).option("multiLine", True).json(path).withColumn("run_id", run_of())


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """Manifests, newest first, broken ones left out."""
    schema = "domain string, video string, backend string, created timestamp, duration_sec double, n_findings long, _corrupt_record string"
    raw = spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").json(path)
    return raw.withColumn("run_id", run_of()).filter("_corrupt_record is null").drop("_corrupt_record").orderBy(F.col("created").desc())


def read_images(spark: SparkSession, path: str, first: int = 0) -> DataFrame:
    """Images (run_id, frame_id, path, content) of ``<run>/<folder>/<frame_id>.jpg``; of each run the ``first`` by name, if given."""
    name = F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1)
    files = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -3).alias("run_id"), name.alias("frame_id"), "path", "content")
    if not first:
        return files
    # names only are ranked; contents come by the paths that stay
    place = F.row_number().over(Window.partitionBy("run_id").orderBy("frame_id"))
    kept = files.select("run_id", "frame_id", "path").withColumn("_at", place).filter(F.col("_at") <= first)
    return files.join(kept.select("path"), "path", "left_semi")


def read_artefacts(spark: SparkSession, path: str) -> DataFrame:
    """Names of the files that lie in the runs' folders (run_id, name)."""
    parts = F.split("path", "/")
    return spark.read.format("binaryFile").load(path).select(F.element_at(parts, -2).alias("run_id"), F.element_at(parts, -1).alias("name"))


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SEGMENT).option("multiLine", True).json(path).withColumn("run_id", run_of())


def read_objects(spark: SparkSession, path: str) -> DataFrame:
    """Placed objects of a scene, numbered in file order within their run."""
    raw = spark.read.schema(OBJECT).option("multiLine", True).json(path).withColumn("run_id", run_of()).withColumn("_m", F.monotonically_increasing_id())
    return raw.withColumn("object_id", F.row_number().over(Window.partitionBy("run_id").orderBy("_m")) - 1).drop("_m")


def read_taxonomy(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Classes and absence rules of domains, a JSON file each, named after the domain.

    What a file leaves out has its usual value. A new domain is a new file.
    """
    raw = spark.read.schema(f"classes array<struct<{CLASS}>>, absence array<struct<{RULE}>>").option("multiLine", True).json(path)
    raw = raw.withColumn("domain", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.json$", 1))
    usual = lambda df, values: df.withColumns({k: F.coalesce(k, F.lit(v)) for k, v in values.items()})
    classes = raw.select("domain", F.posexplode("classes").alias("ord", "c")).select("domain", "ord", F.col("c.key").alias("cls"), "c.*").drop("key")
    rules = raw.select("domain", F.posexplode("absence").alias("rule_ord", "c")).select("domain", "rule_ord", F.col("c.key").alias("absence_key"), F.col("c.label").alias("absence_label"), "c.*").drop("key", "label")
    return usual(classes, CLASS_USUAL), usual(rules, RULE_USUAL)


def parse_intrinsics(lines: DataFrame) -> DataFrame:
    """Cameras from ``KEY: v v v`` lines (name, value) with S_rect (size) and P_rect (projection)."""
    part = lines.select("name", F.split("value", ":").alias("kv")).select("name", F.trim(F.get("kv", F.lit(0))).alias("key"), F.split(F.trim(F.get("kv", F.lit(1))), r"\s+").alias("v"))
    number = lambda key, i: F.max(F.when(F.col("key") == key, F.get("v", F.lit(i)).try_cast("double")))
    c = part.groupBy("name").agg(number("S_rect", 0).alias("w"), number("S_rect", 1).alias("h"), number("P_rect", 0).alias("fx"), number("P_rect", 5).alias("fy"), number("P_rect", 6).alias("cy"))
    return c.select("name", F.degrees(2 * F.atan(F.col("h") / 2 / F.col("fy"))).alias("vfov_deg"), F.degrees(2 * F.atan(F.col("w") / 2 / F.col("fx"))).alias("hfov_deg"), ((F.col("cy") - F.col("h") / 2) / F.col("h")).alias("pitch_offset_frac"))


def parse_gps_lines(lines: DataFrame, fps: float) -> DataFrame:
    """Track points from one line for each file (run_id, file, value, stamp), in order of names.

    Stamps are cut from nanoseconds to microseconds; missing ones follow at the frame rate.
    """
    i = F.row_number().over(Window.partitionBy("run_id").orderBy("file")) - 1
    v = F.split("value", r"\s+")
    at = F.unix_micros(F.to_timestamp(F.regexp_replace("stamp", r"(\.\d{6})\d+", "$1"))) / 1e6
    w = Window.partitionBy("run_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = lines.withColumn("seq", i).withColumn("_at", at)
    return rows.select("run_id", "seq", F.get(v, F.lit(0)).try_cast("double").alias("lat"), F.get(v, F.lit(1)).try_cast("double").alias("lon"), F.coalesce(F.col("_at") - F.first("_at", True).over(w), F.col("seq") / fps).alias("t"))


def explode_truth(fixtures: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Truth boxes (run_id, key, cls, box) from maps keyed by time, and those outside 0..1000."""
    rows = fixtures.select("run_id", F.explode("truth").alias("key", "boxes")).select("run_id", "key", F.posexplode("boxes").alias("truth_seq", "b")).select("run_id", "key", "truth_seq", "b.cls", "b.box")
    sound = (F.size("box") == 4) & F.forall("box", lambda x: x.between(0, 1000))
    return rows.filter(sound), rows.filter(~sound)


def point_predictions(points: DataFrame) -> DataFrame:
    """Points under one set of names; colours of a frame within 0..1 become 0..255."""
    have = lambda *names: F.coalesce(*[F.col(n) for n in names if n in points.columns])
    p = points.select("frame", *[have(c, f"p{c}").alias(c) for c in "xyz"], have("conf", "confidence").alias("conf"), *[have(c).alias(c) for c in "rgb"])
    unit = F.max(F.greatest("r", "g", "b")).over(Window.partitionBy("frame")) <= 1.001
    return p.withColumns({c: F.when(unit, F.col(c) * 255).otherwise(F.col(c)) for c in "rgb"})
