"""Rows that maps, reports and panels are made of."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayside.functions import text
from wayside.operators.findings import best_sighting


def worst_findings(findings: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` worst findings of each run."""
    w = Window.partitionBy("run_id").orderBy(F.col("severity").desc(), F.col("confidence").desc(), "finding_id")
    return findings.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def tour_stops(findings: DataFrame, k: int) -> DataFrame:
    """The ``k`` worst findings with a place, in route order, after an opening stop 0."""
    placed = findings.filter("lat is not null")
    w = Window.partitionBy("run_id").orderBy(F.col("severity").desc(), "t_sec", "finding_id")
    top = placed.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k).drop("_r")
    order = Window.partitionBy("run_id").orderBy("t_sec", "finding_id")
    stops = top.select("run_id", F.row_number().over(order).alias("stop"), "finding_id", "lat", "lon")
    opener = stops.filter("stop = 1").withColumn("stop", F.lit(0)).withColumn("finding_id", F.lit(None).cast("string"))
    return stops.unionByName(opener)


def positioned(findings: DataFrame, frames: DataFrame) -> DataFrame:
    """Findings with a place, else that of their best sighting's frame (``approx``); others go."""
    f = findings.withColumn("_f", best_sighting(F.col("evidence"))["frame_id"])
    at = frames.select("run_id", F.col("frame_id").alias("_f"), F.col("lat").alias("_lat"), F.col("lon").alias("_lon"))
    both = f.join(at, ["run_id", "_f"], "left").withColumn("approx", F.col("lat").isNull())
    return both.withColumns({"lat": F.coalesce("lat", "_lat"), "lon": F.coalesce("lon", "_lon")}).filter("lat is not null").drop("_f", "_lat", "_lon")


def placemarks(findings: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """One map placemark text for each finding."""
    t = F.broadcast(taxonomy.select("cls", F.col("label").alias("_label"), "color"))
    n = findings.join(t, "cls", "left")
    return n.select("run_id", "finding_id", F.concat(
        F.lit("<Placemark><name>"), text.xml_escape(F.coalesce("_label", text.title(F.col("cls")))), F.lit("</name><styleUrl>#"), text.map_color(F.col("color")),
        F.lit("</styleUrl><Point><coordinates>"), text.coordinates(F.col("lon"), F.col("lat")), F.lit("</coordinates></Point></Placemark>")).alias("kml"))


def segment_lines(segments: DataFrame) -> DataFrame:
    """Heat-map lines, one for each segment."""
    at = lambda c: text.coordinates(F.col(f"{c}.lon"), F.col(f"{c}.lat"))
    return segments.select("run_id", "seg_id", F.concat_ws(" ", at("start"), at("end")).alias("coordinates"), text.map_color(F.col("color"), "c0").alias("color"))


def worst_of_segment(segments: DataFrame, findings: DataFrame) -> DataFrame:
    """Each segment's worst finding, the first of equal ones."""
    ids = segments.select("run_id", "seg_id", F.posexplode("finding_ids").alias("position", "finding_id"))
    j = ids.join(findings.select("run_id", "finding_id", "severity"), ["run_id", "finding_id"])
    return j.groupBy("run_id", "seg_id").agg(F.max(F.struct("severity", (-F.col("position")).alias("p"), "finding_id"))["finding_id"].alias("finding_id"))


def gap_of_absence(absences: DataFrame, gaps: DataFrame) -> DataFrame:
    """The gap nearest to each absence of its class, in squared degrees."""
    g = gaps.select("run_id", F.col("absence_key").alias("cls"), F.col("lat").alias("g_lat"), F.col("lon").alias("g_lon"), "start_m", "end_m")
    d = (F.col("lat") - F.col("g_lat")) * (F.col("lat") - F.col("g_lat")) + (F.col("lon") - F.col("g_lon")) * (F.col("lon") - F.col("g_lon"))
    best = absences.drop("start_m", "end_m").join(g, ["run_id", "cls"]).groupBy("run_id", "finding_id").agg(F.min(F.struct(d.alias("d"), "start_m", "end_m")).alias("g"))
    return best.select("run_id", "finding_id", "g.start_m", "g.end_m")


def class_counts(findings: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """Findings of each run by class, most first, with label and worst severity."""
    n = findings.groupBy("run_id", "cls").agg(F.count(F.lit(1)).alias("n"), F.max("severity").alias("worst"))
    w = Window.partitionBy("run_id").orderBy(F.col("n").desc(), "cls")
    return n.join(F.broadcast(taxonomy.select("cls", "label")), "cls", "left").withColumn("rank", F.row_number().over(w))


def running_counts(sightings: DataFrame, k: int = 4) -> DataFrame:
    """Sightings so far by class at each frame, the ``k`` most frequent."""
    at = sightings.groupBy("run_id", "frame_idx", "cls").agg(F.count(F.lit(1)).alias("n"))
    frames = at.select("run_id", "frame_idx").distinct()
    grid = frames.join(at.select("run_id", "cls").distinct(), "run_id").join(at, ["run_id", "frame_idx", "cls"], "left")
    w = Window.partitionBy("run_id", "cls").orderBy("frame_idx")
    total = grid.withColumn("total", F.sum(F.coalesce("n", F.lit(0))).over(w)).filter("total > 0")
    rank = F.row_number().over(Window.partitionBy("run_id", "frame_idx").orderBy(F.col("total").desc(), "cls"))
    return total.withColumn("rank", rank).filter(F.col("rank") <= k).select("run_id", "frame_idx", "cls", "total", "rank")


def merge_manifests(old: DataFrame, new: DataFrame) -> DataFrame:
    """Runs with counts from ``new``; domain and video stay, duration is the longer; runs without an origin stay out."""
    j = old.alias("o").join(new.alias("n"), "run_id", "full_outer")
    return j.filter("coalesce(o.origin_lat, n.origin_lat) is not null").select(
        "run_id", F.coalesce("o.domain", "n.domain").alias("domain"), F.coalesce("o.video", "n.video").alias("video"), F.coalesce("n.backend", "o.backend").alias("backend"),
        F.greatest("o.duration_sec", "n.duration_sec").alias("duration_sec"), F.coalesce("n.n_findings", "o.n_findings").alias("n_findings"), F.coalesce("o.origin_lat", "n.origin_lat").alias("origin_lat"),
    )


def preflight(clips: DataFrame, tracks: DataFrame, gaps: DataFrame) -> DataFrame:
    """Check rows (run_id, check, status, detail) on clips and tracks before work begins.

    ``clips`` (run_id, duration_s, fps, camera, pitch_offset_frac, offset_s), ``tracks`` (run_id,
    span_s, length_m), ``gaps`` from frame_gaps.
    """
    j = clips.join(tracks, "run_id", "left").join(gaps.select("run_id", "variable"), "run_id", "left")
    speed = F.try_divide("length_m", "span_s")
    status = lambda bad, warn: F.when(bad, "fail").when(warn, "warn").otherwise("ok")
    no, number = F.lit(False), lambda c: F.format_string("%.1f", c)
    shared = F.least("duration_s", F.col("span_s")) / F.col("duration_s")
    rows = {
        "duration": (status(F.coalesce(F.col("duration_s") <= 0, F.lit(True)), no), number(F.col("duration_s"))),
        "frame_rate": (status(no, F.coalesce("variable", no)), F.format_string("%.1f fps", "fps")),
        "speed": (status(speed.isNull(), (speed < 0.5) | (speed > 40)), number(speed)),
        "track_cover": (status(F.col("span_s").isNull(), shared < 0.5), number(shared * 100)),
        "clock_offset": (status(F.abs("offset_s") > 3600, F.abs("offset_s") >= 1), number(F.col("offset_s"))),
        "camera": (status(no, (F.col("camera") == "default") | (F.col("pitch_offset_frac") == 0)), F.col("camera")),
    }
    each = F.array(*[F.struct(F.lit(k).alias("check"), a.alias("status"), b.alias("detail")) for k, (a, b) in rows.items()])
    return j.select("run_id", F.explode(each).alias("c")).select("run_id", "c.*")
