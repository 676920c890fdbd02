"""Queries over cameras, sources of boxes, roll-ups, report tables, extents and rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayside.fixtures import oracle, view
from wayside.functions import boxes, text
from wayside.operators import absence, cloud, csvio, evaluate, export, findings, localize, perception, report, score, zone
from wayside.operators.route import chainage
from wayside.plans import core
from wayside.sources import readers
from wayside.streaming import live

XYXY = ("x1", "y1", "x2", "y2")
RUNS = "(SELECT DISTINCT run_id FROM fx_frames)"


def runs_of(s, d) -> DataFrame:
    return core.frames(s, d).select("run_id").distinct()


def named(i, *values):
    """One of some values, by a number from 0."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (i + 1).cast("int"))


def cameras(s, d):
    known = s.createDataFrame([("car", 1.5, 40.0, 70.0, 0.01, 50.0), ("bike", 1.1, 60.0, 95.0, -0.02, 30.0)], "name string, height_m double, vfov_deg double, hfov_deg double, pitch_offset_frac double, max_range_m double")
    r = runs_of(s, d).withColumn("camera", named(F.col("run_id") % 3, "car", "bike", "lost"))
    return localize.with_camera(r, known).select("run_id", "camera", "height_m", "vfov_deg", "pitch_offset_frac", "max_range_m")


def intrinsics(s, d):
    p = view(s, d, "fx_classes").groupBy("domain").agg(F.count(F.lit(1)).alias("n"))
    size, fit = F.format_string("S_rect_02: %d %d", (1200 + F.col("n")).cast("long"), (300 + F.col("n")).cast("long")), F.format_string("P_rect: %d 0 600 0 0 %d 170 0 0 0 1 0", (700 + F.col("n")).cast("long"), (710 + F.col("n")).cast("long"))
    lines = p.select(F.col("domain").alias("name"), F.explode(F.array(F.replace(size, F.lit("_02"), F.lit("")), fit, F.lit("noise"))).alias("value"))
    return readers.parse_intrinsics(lines).select("name", *[F.round(c, 9).alias(c) for c in ("vfov_deg", "hfov_deg", "pitch_offset_frac")])


def point_names(s, d):
    p = view(s, d, "fx_points")
    c = lambda k: F.when(F.col("seq_major") % 50 % 2 == 0, (F.col("l_partkey") * k % 256) / 255.0).otherwise((F.col("l_partkey") * k % 256).cast("double"))
    raw = p.select((F.col("seq_major") % 50).alias("frame"), F.col("x").alias("px"), F.col("y").alias("py"), F.col("z").alias("pz"), F.col("conf").alias("confidence"), c(3).alias("r"), c(5).alias("g"), c(7).alias("b"))
    out = readers.point_predictions(raw)
    return out.groupBy("frame").agg(F.count(F.lit(1)).alias("n"), *[F.round(F.sum(k), 4).alias(k) for k in ("x", "y", "z", "conf", "r", "g", "b")])


def clustered(s, d) -> DataFrame:
    """Localized sightings under clusters of up to seven, in order of frames; no mean of their confidences lies on the edge of rounding."""
    seen = core.seen(s, d).withColumns({"cluster": F.col("det_seq") % 7, "part": F.lit(0), "confidence": F.col("confidence") * 0.987654321})
    return seen.select("run_id", "cls", "cluster", "part", "frame_idx", "det_seq", "frame_id", "box", "severity", "confidence", "lat", "lon", "range_m", "t_sec")


def rolled(s, d) -> DataFrame:
    return findings.roll_up(clustered(s, d), view(s, d, "fx_taxonomy"))


def roll_up(s, d):
    r = rolled(s, d)
    return r.select("run_id", "finding_id", "cls", "label", F.round("lat", 9).alias("lat"), F.round("lon", 9).alias("lon"), "severity", "confidence", "t_sec", "n_evidence", "pos_method")


ROLLED = f"""{core.LOCALIZED}, cl AS (SELECT * REPLACE (confidence * 0.987654321e0 AS confidence), det_seq % 7 AS cluster, x2 - x1 AS bw, y2 - y1 AS bh FROM localized WHERE f_lat IS NOT NULL),
g AS (SELECT run_id, cls, cluster, median(lat) AS lat, median(lon) AS lon, round_even(median(severity), 0)::INT AS severity, avg(confidence) AS mc, count(*) AS n_evidence, min(t_sec) AS t_sec, arg_min(t_sec, struct_pack(f := frame_idx, q := det_seq)) AS t_first,
 arg_max(struct_pack(frame := frame_id, r := round(fwd, 2), x1 := x1, y1 := y1, x2 := x2, y2 := y2), struct_pack(a := bw * bh, f := -frame_idx, q := -det_seq)) AS best FROM cl GROUP BY ALL),
rl AS (SELECT g.run_id, 'f-' || lpad((row_number() OVER (PARTITION BY g.run_id ORDER BY t_first, ord, g.cls, cluster) - 1)::VARCHAR, 4, '0') AS finding_id, g.cls, cluster, label, lat, lon, severity, round(greatest(0, least(1, mc * least(1, 0.75e0 + 0.08e0 * (n_evidence - 1)))), 3) AS confidence, t_sec, n_evidence, best FROM g JOIN fx_taxonomy t ON g.cls = t.cls)"""
E5_SQL = f"WITH {ROLLED} SELECT run_id, finding_id, cls, label, round(lat, 9) AS lat, round(lon, 9) AS lon, severity, confidence, t_sec, n_evidence, 'ground_plane' AS pos_method FROM rl"


def best(s, d):
    return rolled(s, d).select("run_id", "finding_id", findings.best_sighting(F.col("evidence"))["frame_id"].alias("frame_id"))


def nested(s, d):
    return findings.unnest_evidence(rolled(s, d)).select("run_id", "finding_id", "position", "det_seq", "frame_id")


def sources(s, d):
    plain = clustered(s, d)
    both = findings.predictions(plain, rolled(s, d), "findings").withColumn("source", F.lit("findings")).unionByName(findings.predictions(plain, rolled(s, d), "detections").withColumn("source", F.lit("detections")))
    return both.groupBy("source", "run_id", "cls").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("box.x1"), 3).alias("x1"), F.round(F.sum("confidence"), 6).alias("confidence"))


def placed(s, d):
    """Findings, some without a place, and of these some whose frame is unknown."""
    f = rolled(s, d).withColumns({"lat": F.when(F.col("n_evidence") % 2 == 0, F.col("lat")), "lon": F.when(F.col("n_evidence") % 2 == 0, F.col("lon"))})
    frames = core.frames(s, d).filter("frame_idx % 5 <> 0")
    return export.positioned(f, frames).select("run_id", "finding_id", F.round("lat", 9).alias("lat"), F.round("lon", 9).alias("lon"), "approx")


def csv_rows(s, d):
    at = chainage(core.frames(s, d)).select("run_id", "frame_id", "cum_m")
    return csvio.export_findings(rolled(s, d), at, "https://host/").select("run_id", "object_id", "frame", "time", "defect_name", "lat", "lon", "chainage_km", "frame_url", "severity", "confidence")


I14_SQL = f"""WITH {core.CUM}, {ROLLED} SELECT rl.run_id, (row_number() OVER (PARTITION BY rl.run_id ORDER BY rl.t_sec, finding_id))::INT AS object_id, best.frame AS frame, floor(rl.t_sec / 60)::BIGINT || ':' || lpad(printf('%.3f', rl.t_sec - floor(rl.t_sec / 60) * 60), 6, '0') AS time, label AS defect_name,
 printf('%.8f', rl.lat) AS lat, printf('%.8f', rl.lon) AS lon, printf('%.3f', round(cum_m / 1000, 3)) AS chainage_km, 'https://host/frames/' || best.frame || '.jpg' AS frame_url, severity, confidence FROM rl JOIN cum ON cum.run_id = rl.run_id AND cum.frame_id = best.frame"""


def manifests(s, d) -> DataFrame:
    r = runs_of(s, d)
    return r.select("run_id", named(F.col("run_id") % 3, "mock", "onnx", "vlm").alias("backend"), F.when(F.col("run_id") % 2 == 0, "judge").alias("verifier"), (F.col("run_id") * 2.5).alias("duration_sec"), (F.col("run_id") + 7).alias("n_frames"), (F.col("run_id") * 3).alias("n_detections"), F.lit("2024-01-01").alias("created"), F.lit(12.9).alias("origin_lat"), F.lit(77.5).alias("origin_lon"))


PROVENANCE = "'detected by ' || ['mock', 'onnx', 'vlm'][{r} % 3 + 1] || CASE WHEN {r} % 2 = 0 THEN '; verified by judge' ELSE '' END || CASE WHEN {r} % 3 = 0 THEN '; synthetic data' ELSE '' END AS provenance"


def absence_kinds(s, d) -> DataFrame:
    return view(s, d, "fx_absence").select("absence_key", F.col("absence_label").alias("label"), F.lit("#78716c").alias("color"))


def cover(s, d):
    f = core.fixture_findings(s, d)
    summary = score.summarize(f, score.build_segments(core.frames(s, d), f, view(s, d, "fx_taxonomy"))).filter("run_id % 7 <> 1")
    return report.cover(summary, manifests(s, d)).select("run_id", "findings", "n_detections", "n_frames", "duration_sec", (F.col("route_km") > 0).alias("has_route"), (F.col("per_km") > 0).alias("has_rate"), "provenance")


B7_COVER_SQL = f"""SELECT r.run_id, CASE WHEN r.run_id % 7 <> 1 THEN n ELSE 0 END AS findings, r.run_id * 3 AS n_detections, r.run_id + 7 AS n_frames, r.run_id * 2.5e0 AS duration_sec, r.run_id % 7 <> 1 AS has_route, r.run_id % 7 <> 1 AS has_rate, {PROVENANCE.format(r='r.run_id')}
FROM {RUNS} r JOIN (SELECT run_id, count(*) AS n FROM fx_findings GROUP BY run_id) f ON f.run_id = r.run_id"""


def classes(s, d):
    f = core.fixture_findings(s, d).select("run_id", "cls", "severity").unionByName(core.fixture_findings(s, d).filter("det_seq % 10 = 0").select("run_id", F.when(F.col("det_seq") % 20 == 0, "streetlight_missing").otherwise("odd").alias("cls"), "severity"))
    return report.classes(f, view(s, d, "fx_taxonomy"), absence_kinds(s, d), manifests(s, d))


B7_CLASSES_SQL = f"""WITH f AS (SELECT run_id, cls, severity FROM fx_findings UNION ALL SELECT run_id, CASE WHEN det_seq % 20 = 0 THEN 'streetlight_missing' ELSE 'odd' END, severity FROM fx_findings WHERE det_seq % 10 = 0),
k AS (SELECT cls, label, color, false AS inferred FROM fx_taxonomy UNION ALL SELECT absence_key, absence_label, '#78716c', true FROM fx_absence), n AS (SELECT run_id, cls, count(*) AS n, max(severity) AS worst FROM f GROUP BY ALL)
SELECT n.run_id, (row_number() OVER (PARTITION BY n.run_id ORDER BY n DESC, n.cls))::INT AS place, n.cls, coalesce(label, n.cls) AS label, coalesce(color, '#999999') AS color, n, worst, coalesce(inferred, false) AS inferred, {PROVENANCE.format(r='n.run_id')} FROM n LEFT JOIN k ON k.cls = n.cls"""


def coverage(s, d):
    f, g = core.fixture_findings(s, d), core.gaps_of(s, d)
    rep = absence.coverage_report(core.frames(s, d), f.filter("run_id % 4 <> 0"), absence.infer_absences(g, core.frames(s, d)), view(s, d, "fx_absence"))
    return report.coverage(rep, manifests(s, d)).select("run_id", "absence_key", "asset", "ok", "found", "gaps", F.regexp_replace("finding", r"\d+\.\d per km|over \d+\.\d m", "#").alias("finding"), "provenance")


B7_COVERAGE_SQL = f"""WITH {core.GAPS}, n AS (SELECT run_id, count(*) FILTER (cls = 'streetlight' AND run_id % 4 <> 0) AS found FROM fx_findings GROUP BY run_id), c AS (SELECT run_id, count(*) AS gaps FROM gaps GROUP BY run_id)
SELECT tl.run_id, 'streetlight_missing' AS absence_key, 'streetlight' AS asset, coalesce(found, 0) > 0 AS ok, coalesce(found, 0) AS found, coalesce(c.gaps, 0) AS gaps, CASE WHEN coalesce(found, 0) > 0 THEN found || ' found, #' ELSE 'none # (threshold 40.0 m)' END AS finding, {PROVENANCE.format(r='tl.run_id')}
FROM tl LEFT JOIN n ON n.run_id = tl.run_id LEFT JOIN c ON c.run_id = tl.run_id"""


def dispatch(s, d):
    f = core.fixture_findings(s, d)
    r = report.segments(score.build_segments(core.frames(s, d), f, view(s, d, "fx_taxonomy")), manifests(s, d))
    return r.select("run_id", "place", "seg_id", "quality_index", "findings", "provenance")


B7_SEGMENTS_SQL = f"WITH RECURSIVE {core.SEGS} SELECT run_id, (row_number() OVER (PARTITION BY run_id ORDER BY round(idx, 1), seg_id))::INT AS place, seg_id, round(idx, 1) AS quality_index, n AS findings, {PROVENANCE.format(r='run_id')} FROM scored"


def fact_rows(s, d):
    r = report.facts(rolled(s, d), absence_kinds(s, d), manifests(s, d))
    return r.select("run_id", "place", "finding_id", "sightings", "accuracy", "frame_id", "box", "inferred", F.col("range").rlike(r"^\d+\.\d m ahead$|^not ranged$").alias("ranged"), "provenance")


B7_FACTS_SQL = f"""WITH {ROLLED} SELECT run_id, (row_number() OVER (PARTITION BY run_id ORDER BY severity DESC, t_sec, finding_id))::INT AS place, finding_id, n_evidence AS sightings, '2 to 4 m, one projection' AS accuracy, best.frame AS frame_id,
 printf('[%.1f, %.1f, %.1f, %.1f]', best.x1, best.y1, best.x2, best.y2) AS box, false AS inferred, true AS ranged, {PROVENANCE.format(r='run_id')} FROM rl"""


def extents(s, d):
    cover_ = cloud.tile_cover(cloud.route_boxes(core.frames(s, d), 60.0), 18)
    r = cloud.tile_extents(cover_, 18, (12.9716, 77.5946))
    return r.select("run_id", "nx", "ny", *[F.round(c, 8).alias(c) for c in ("west", "east", "north", "south")], *[F.round(c, 4).alias(c) for c in ("x_min", "x_max", "z_min", "z_max", "m_per_px")])


E24_SQL = """WITH bx AS (SELECT run_id, min(lat) - 60 / 111320.0e0 AS south, min(lon) - 60 / (111320 * cos(radians(avg(lat)))) AS west, max(lat) + 60 / 111320.0e0 AS north, max(lon) + 60 / (111320 * cos(radians(avg(lat)))) AS east FROM fx_frames GROUP BY run_id),
t AS (SELECT run_id, floor((west + 180) / 360 * 262144)::BIGINT AS x0, floor((east + 180) / 360 * 262144)::BIGINT AS x1, floor((1 - asinh(tan(radians(north))) / pi()) / 2 * 262144)::BIGINT AS y0, floor((1 - asinh(tan(radians(south))) / pi()) / 2 * 262144)::BIGINT AS y1 FROM bx),
e AS (SELECT run_id, x1 - x0 + 1 AS nx, y1 - y0 + 1 AS ny, x0 / 262144.0e0 * 360 - 180 AS west, (x1 + 1) / 262144.0e0 * 360 - 180 AS east, degrees(atan(sinh(pi() * (1 - 2 * y0 / 262144.0e0)))) AS north, degrees(atan(sinh(pi() * (1 - 2 * (y1 + 1) / 262144.0e0)))) AS south FROM t),
m AS (SELECT *, 111320 * cos(radians(12.9716e0)) AS k FROM e)
SELECT run_id, nx, ny, round(west, 8) AS west, round(east, 8) AS east, round(north, 8) AS north, round(south, 8) AS south, round((west - 77.5946e0) * k, 4) AS x_min, round((east - 77.5946e0) * k, 4) AS x_max, round(-(north - 12.9716e0) * 111320, 4) AS z_min, round(-(south - 12.9716e0) * 111320, 4) AS z_max, round((east - west) * k / (nx * 256), 4) AS m_per_px FROM m"""


def views(s, d):
    return cloud.scene_boxes(core.frames(s, d), (12.9716, 77.5946), 300.0).select("run_id", *[F.round(c, 6).alias(c) for c in ("x_mid", "z_mid", "span_m")])


E8_SQL = """WITH p AS (SELECT run_id, (lon - 77.5946e0) * 111320 * cos(radians(12.9716e0)) AS x, -(lat - 12.9716e0) * 111320 AS z FROM fx_frames)
SELECT run_id, round((min(x) + max(x)) / 2, 6) AS x_mid, round((min(z) + max(z)) / 2, 6) AS z_mid, round(greatest(max(x) - min(x), max(z) - min(z), 300), 6) AS span_m FROM p GROUP BY run_id"""


def cloud_extent(s, d):
    p = view(s, d, "fx_points").select((F.col("seq_major") % 20).alias("run_id"), "x", "y", "z")
    return cloud.cloud_boxes(p)


def rules(s, d):
    """Classes with own words, declared or not, and overrides of a few."""
    c = view(s, d, "fx_taxonomy").select("cls", "label", F.when(F.col("cls") == "crack", "on the footpath").otherwise("").alias("hint"), F.lit(False).alias("is_absence"), F.when(F.col("cls") == "garbage", True).alias("carriageway_only"))
    a = absence_kinds(s, d).select(F.col("absence_key").alias("cls"), "label", F.lit("carriageway").alias("hint"), F.lit(True).alias("is_absence"), F.lit(None).cast("boolean").alias("carriageway_only"))
    over = s.createDataFrame([("waterlogging", True), ("nothing", True)], "cls string, carriageway_only boolean")
    r = zone.carriageway_rules(c.unionByName(a), over)
    return view(s, d, "fx_findings").select("run_id", "finding_id", "cls").join(F.broadcast(r), "cls").unionByName(runs_of(s, d).withColumn("finding_id", F.lit("-")).join(F.broadcast(r.filter("source = 'absence'"))).select("cls", "run_id", "finding_id", "carriageway_only", "source", "matched"))


I16_SQL = f"""WITH r AS (SELECT * FROM (VALUES ('pothole', true, 'lexical', 'pothole'), ('crack', false, 'lexical', 'footpath'), ('waterlogging', true, 'override', NULL), ('streetlight', false, 'default', NULL), ('garbage', true, 'declared', NULL)) v(cls, carriageway_only, source, matched))
SELECT f.cls, run_id, finding_id, carriageway_only, source, matched FROM fx_findings f JOIN r ON f.cls = r.cls UNION ALL SELECT 'streetlight_missing', run_id, '-', false, 'absence', NULL FROM {RUNS}"""


def markers(s, d):
    p = view(s, d, "fx_points").select(F.col("seq_major").alias("mount"), F.col("l_partkey").alias("k"), F.lit(1.35).alias("height_m"), F.lit(720).alias("image_h"), F.lit(5.0).alias("near_m"), (500.0 + F.col("l_partkey") % 97).alias("near_v"), F.lit(20.0).alias("far_m"), (400.0 + F.col("l_suppkey") % 53).alias("far_v"))
    r = zone.solve_markers(p.withColumn("mount", F.struct("mount", "k", "near_v", "far_v")))
    return r.select("mount.*", F.round("focal_px", 6).alias("focal_px"), F.round("vfov_deg", 6).alias("vfov_deg"), F.round("pitch_offset_frac", 9).alias("pitch_offset_frac"), "sound")


C32_SQL = """WITH m AS (SELECT seq_major AS mount, l_partkey AS k, 500.0e0 + l_partkey % 97 AS near_v, 400.0e0 + l_suppkey % 53 AS far_v FROM fx_points), f AS (SELECT *, (near_v - far_v) / (1.35e0 * (1 / 5.0e0 - 1 / 20.0e0)) AS f FROM m),
r AS (SELECT *, far_v - f * 1.35e0 / 20 AS row, 2 * degrees(atan(360 / f)) AS fov FROM f)
SELECT mount, k, near_v, far_v, round(f, 6) AS focal_px, round(fov, 6) AS vfov_deg, round((row - 360) / 720, 9) AS pitch_offset_frac, abs(f * 1.35e0 / (near_v - row) - 5) < 0.05 AND fov BETWEEN 10 AND 120 AS sound FROM r"""


def chosen(s, d):
    tries = runs_of(s, d).withColumn("attempt", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)))).select("run_id", "attempt", F.format_string("c%d", "attempt").alias("camera"), ((F.col("run_id") + F.col("attempt")) % 3 == 0).alias("ok"), (F.col("run_id") % 5 % 2).cast("int").alias("warnings"))
    return zone.choose_calibration(tries, runs_of(s, d).withColumn("camera", F.lit("usual")))


I28_SQL = f"SELECT run_id, CASE WHEN run_id % 5 % 2 = 0 THEN 'c' || ((3 - run_id % 3) % 3) ELSE 'usual' END AS camera, CASE WHEN run_id % 5 % 2 = 0 THEN 'calibrated' ELSE 'preset' END AS reason FROM {RUNS}"


def grounded(s, d):
    f = view(s, d, "fx_detections")
    tag = F.format_string("seen <box>%.1f, %.1f %.1f,%.1f</box> and <box>x</box>", *XYXY)
    r = perception.grounded_boxes(f.select("run_id", "frame_id", "cls", F.concat(tag, F.col("det_seq").cast("string")).alias("reply")))
    return r.select("run_id", "frame_id", "cls", "position", *[F.round(f"box.{c}", 1).alias(c) for c in XYXY], "severity", "confidence")


J11_SQL = """SELECT run_id, frame_id, cls, 0 AS position, round(least(1000, x1), 1) AS x1, round(least(1000, y1), 1) AS y1, round(least(1000, x2), 1) AS x2, round(least(1000, y2), 1) AS y2, 3 AS severity, 0.7e0 AS confidence FROM fx_detections WHERE least(1000, x2) - least(1000, x1) >= 2 AND least(1000, y2) - least(1000, y1) >= 2"""


def small_functions(s, d):
    f = view(s, d, "fx_detections")
    w, h = (640 + F.col("det_seq") % 1300).cast("double"), (480 + F.col("det_seq") % 700).cast("double")
    fit = boxes.letterbox(w, h, F.lit(640.0))
    px = boxes.undo_letterbox(F.col("x1"), F.col("y1"), F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"), fit)
    color = F.concat(F.lit("#"), F.lpad(F.lower(F.hex(F.col("det_seq") * 7919 % 16777216)), 6, "0"), F.when(F.col("det_seq") % 9 == 0, "0").otherwise(""))
    method = named(F.col("det_seq") % 3, "triangulated", "camera", "ground_plane")
    shares = text.color_fractions(color)
    return f.select(
        "det_seq", F.round(fit["scale"], 9).alias("scale"), F.round(fit["pad_x"], 3).alias("pad_x"), F.round(px["x1"] * F.pi(), 5).alias("px1"), F.round(px["y2"] * F.pi(), 5).alias("py2"), F.round(boxes.sigmoid((F.col("det_seq") % 90 - 45).cast("double")), 12).alias("chance"),
        F.round(shares["r"], 9).alias("r"), F.round(shares["b"], 9).alias("b"), text.accuracy_label(method, F.when(F.col("det_seq") % 2 == 0, F.lit(1.26) + F.col("det_seq") % 8)).alias("accuracy"), text.provenance(named(F.col("det_seq") % 2, "mock", "vlm"), F.when(F.col("det_seq") % 5 == 0, F.lit("judge"))).alias("provenance"))


SMALL_SQL = """WITH q AS (SELECT *, 640.0e0 + det_seq % 1300 AS w, 480.0e0 + det_seq % 700 AS h, lpad(lower(to_hex(det_seq * 7919 % 16777216)), 6, '0') AS hx FROM fx_detections), l AS (SELECT *, least(640 / w, 640 / h) AS k FROM q)
SELECT det_seq, round(k, 9) AS scale, round((640 - round_even(w * k, 0)) / 2, 3) AS pad_x, round((x1 - (x2 - x1) / 2 - (640 - round_even(w * k, 0)) / 2) / k * pi(), 5) AS px1, round((y1 + (y2 - y1) / 2 - (640 - round_even(h * k, 0)) / 2) / k * pi(), 5) AS py2, round(1 / (1 + exp(-greatest(-30, least(30, det_seq % 90 - 45)))), 12) AS chance,
 CASE WHEN det_seq % 9 <> 0 THEN round(('0x' || substr(hx, 1, 2))::INT / 255, 9) END AS r, CASE WHEN det_seq % 9 <> 0 THEN round(('0x' || substr(hx, 5, 2))::INT / 255, 9) END AS b,
 CASE WHEN det_seq % 3 = 0 AND det_seq % 2 = 0 THEN printf('triangulated, +/-%.1f m', 1.26e0 + det_seq % 8) WHEN det_seq % 3 = 1 THEN 'camera position' ELSE 'ground plane, +/-2-4 m' END AS accuracy,
 'detected by ' || ['mock', 'vlm'][det_seq % 2 + 1] || CASE WHEN det_seq % 5 = 0 THEN '; verified by judge' ELSE '' END || CASE WHEN det_seq % 2 = 0 THEN '; synthetic data' ELSE '' END AS provenance FROM l"""


def merged(s, d):
    run = lambda k: F.struct(F.col("run_id"), named(F.col("run_id") % 2, "road", "kerb").alias("domain"), F.format_string(f"v{k}-%d", "run_id").alias("video"), F.lit(f"b{k}").alias("backend"), (F.col("run_id") % 7 + k * 3.0).alias("duration_sec"), (F.col("run_id") * k).alias("n_findings"), F.when(F.col("run_id") % 5 != 0, 12.0 + k).alias("origin_lat"))
    r = runs_of(s, d)
    return export.merge_manifests(r.filter("run_id % 3 <> 0").select(run(1).alias("m")).select("m.*"), r.filter("run_id % 4 <> 0").select(run(2).alias("m")).select("m.*"))


B3_SQL = f"""WITH r AS (SELECT run_id, run_id % 3 <> 0 AS o, run_id % 4 <> 0 AS n FROM {RUNS} WHERE run_id % 5 <> 0 AND (run_id % 3 <> 0 OR run_id % 4 <> 0))
SELECT run_id, ['road', 'kerb'][run_id % 2 + 1] AS domain, CASE WHEN o THEN 'v1-' ELSE 'v2-' END || run_id AS video, CASE WHEN n THEN 'b2' ELSE 'b1' END AS backend, run_id % 7 + CASE WHEN n THEN 6.0e0 ELSE 3.0e0 END AS duration_sec, CASE WHEN n THEN run_id * 2 ELSE run_id END AS n_findings, CASE WHEN o THEN 13.0e0 ELSE 14.0e0 END AS origin_lat FROM r"""


def compared(s, d):
    m = lambda k: core.fixture_findings(s, d).filter(f"det_seq % {k} = 0").groupBy(F.concat(F.lit("n of "), F.col("run_id").cast("string")).alias("name")).agg(F.count(F.lit(1)).cast("double").alias("value"))
    return evaluate.compare_runs(m(7), m(11))


D24_SQL = """WITH a AS (SELECT 'n of ' || run_id AS name, count(*)::DOUBLE AS a FROM fx_findings WHERE det_seq % 7 = 0 GROUP BY 1), b AS (SELECT 'n of ' || run_id AS name, count(*)::DOUBLE AS b FROM fx_findings WHERE det_seq % 11 = 0 GROUP BY 1)
SELECT coalesce(a.name, b.name) AS name, a, b, b - a AS delta FROM a FULL JOIN b ON a.name = b.name"""


def prompts(s, d):
    c = view(s, d, "fx_classes").filter("domain = 'Brand#11'").select("ord", "cls", "label", F.concat(F.lit(" "), F.replace("hint", F.lit(" "), F.lit("\n  "))).alias("hint"))
    return perception.prompts(c, 4).unionByName(perception.prompts(view(s, d, "fx_taxonomy").select(F.col("ord").cast("long"), "cls", "label"), 2))


E23_SQL = """WITH c AS (SELECT ord, cls, label, ', ' || hint AS hint, ord // 4 AS batch, 1 AS k FROM fx_classes WHERE domain = 'Brand#11' UNION ALL SELECT ord, cls, label, '', ord // 2, 2 FROM fx_taxonomy)
SELECT batch, 'Report what is visible of:' || chr(10) || string_agg('- ' || cls || ': ' || label || hint, chr(10) ORDER BY ord, cls, label) || chr(10) || 'Answer with JSON only.' AS prompt FROM c GROUP BY k, batch"""


def requests(s, d):
    frames = core.frames(s, d).select("run_id", "frame_id", F.concat_ws("/", "run_id", "frame_id").alias("image"))
    asked = perception.prompts(view(s, d, "fx_taxonomy").select(F.col("ord").cast("long"), "cls", "label"), 2)
    every = frames.crossJoin(F.broadcast(asked))
    key = F.sha2(F.concat_ws("|", "image", "prompt", F.lit("m")), 256)
    cache = every.filter((F.col("frame_id").cast("int") + F.col("batch")) % 3 == 0).select(key.alias("key"), F.when(F.col("run_id") % 2 == 0, F.lit("{}")).otherwise("{broken").alias("reply"))
    return perception.prompt_requests(frames, asked, cache, "m").select("run_id", "frame_id", "batch")


def localized_by_run(s, d):
    known = s.createDataFrame([("car", 1.5, 40.0, 70.0, 0.01, 50.0), ("bike", 1.1, 60.0, 95.0, -0.02, 30.0)], "name string, height_m double, vfov_deg double, hfov_deg double, pitch_offset_frac double, max_range_m double")
    mounted = localize.with_camera(runs_of(s, d).withColumn("camera", named(F.col("run_id") % 3, "car", "bike", "lost")), known)
    r = localize.localize(core.detections(s, d), core.frames(s, d), view(s, d, "fx_taxonomy"), mounted)
    return r.select("run_id", "det_seq", F.round("lat", 10).alias("lat"), F.round("lon", 10).alias("lon"), F.col("range_m").isNotNull().alias("ranged"))


BY_RUN = core.LOCALIZED
for _old, _new in (
    ("360 / tan(radians(29.0e0)) AS foc", "360 / tan(radians([40.0e0, 60.0e0, 58.0e0][d.run_id % 3 + 1] / 2)) AS foc, [1.5e0, 1.1e0, 1.4e0][d.run_id % 3 + 1] AS hm, 360 + 720 * [0.01e0, -0.02e0, 0.0e0][d.run_id % 3 + 1] AS hz, [50.0e0, 30.0e0, 60.0e0][d.run_id % 3 + 1] AS far"),
    ("WHEN v - 360 > 1e-6 AND 1.35e0 / tan(atan2(v - 360, foc)) <= 60 THEN 1.35e0 / tan(atan2(v - 360, foc)) END", "WHEN v - hz > 1e-6 AND hm / tan(atan2(v - hz, foc)) <= far THEN hm / tan(atan2(v - hz, foc)) END"),
):
    assert _old in BY_RUN
    BY_RUN = BY_RUN.replace(_old, _new)
D7_SQL = f"WITH {BY_RUN} SELECT run_id, det_seq, round(lat, 10) AS lat, round(lon, 10) AS lon, raw_range IS NOT NULL AS ranged FROM localized"


def ended(s, d):
    f = rolled(s, d)
    e = live.event_payload(f, view(s, d, "fx_taxonomy")).unionByName(live.done_events(f))
    return e.select("run_id", "t_sec", F.get_json_object("event", "$.type").alias("type"), F.get_json_object("event", "$.finding.finding_id").alias("finding_id"), F.get_json_object("event", "$.finding.n_evidence").cast("long").alias("n_evidence"))


K1_SQL = f"WITH {ROLLED} SELECT run_id, t_sec, 'finding' AS type, finding_id, n_evidence FROM rl UNION ALL SELECT run_id, max(t_sec), 'done', NULL, NULL FROM rl GROUP BY run_id"


def fixed(s, d):
    f = core.fixture_findings(s, d).select("run_id", named(F.col("det_seq") % 3, "triangulated", "camera", "ground_plane").alias("pos_method"), F.when(F.col("det_seq") % 4 != 0, F.col("det_seq") % 13 * 0.25).alias("pos_residual_m"), (F.col("det_seq") % 6).alias("n_rays"))
    return report.triangulation_stats(f)


E22_SQL = """WITH f AS (SELECT run_id, det_seq % 3 = 0 AS tri, CASE WHEN det_seq % 4 <> 0 THEN det_seq % 13 * 0.25e0 ELSE 0 END AS res, det_seq % 6 AS rays FROM fx_findings)
SELECT run_id, count(*) AS findings, count(*) FILTER (tri) AS triangulated, coalesce(sum(rays) FILTER (tri), 0)::BIGINT AS rays, list_sort(list(res) FILTER (tri))[count(*) FILTER (tri) // 2 + 1] AS median_residual_m FROM f GROUP BY run_id"""


QUERIES = {
    "a10_cameras": (cameras, f"SELECT run_id, ['car', 'bike', 'lost'][run_id % 3 + 1] AS camera, [1.5e0, 1.1e0, 1.4e0][run_id % 3 + 1] AS height_m, [40.0e0, 60.0e0, 58.0e0][run_id % 3 + 1] AS vfov_deg, [0.01e0, -0.02e0, 0.0e0][run_id % 3 + 1] AS pitch_offset_frac, [50.0e0, 30.0e0, 60.0e0][run_id % 3 + 1] AS max_range_m FROM {RUNS}"),
    "a13_intrinsics": (intrinsics, "SELECT domain AS name, round(2 * degrees(atan((300 + n) / 2 / (710 + n))), 9) AS vfov_deg, round(2 * degrees(atan((1200 + n) / 2 / (700 + n))), 9) AS hfov_deg, round((170 - (300 + n) / 2) / (300 + n), 9) AS pitch_offset_frac FROM (SELECT domain, count(*)::DOUBLE AS n FROM fx_classes GROUP BY domain)"),
    "a17_point_names": (point_names, "SELECT seq_major % 50 AS frame, count(*) AS n, round(sum(x), 4) AS x, round(sum(y), 4) AS y, round(sum(z), 4) AS z, round(sum(conf), 4) AS conf, round(sum(l_partkey * 3 % 256), 4)::DOUBLE AS r, round(sum(l_partkey * 5 % 256), 4)::DOUBLE AS g, round(sum(l_partkey * 7 % 256), 4)::DOUBLE AS b FROM fx_points GROUP BY 1"),
    "a18_two_sources": (sources, f"WITH {ROLLED}, p AS (SELECT run_id, cls, x1, confidence FROM cl) SELECT s AS source, run_id, cls, count(*) AS n, round(sum(x1), 3) AS x1, round(sum(confidence), 6) AS confidence FROM p, (VALUES ('detections'), ('findings')) v(s) GROUP BY ALL"),
    "b3_merged_manifests": (merged, B3_SQL),
    "b7_cover": (cover, B7_COVER_SQL),
    "b7_classes": (classes, B7_CLASSES_SQL),
    "b7_coverage": (coverage, B7_COVERAGE_SQL),
    "b7_segments": (dispatch, B7_SEGMENTS_SQL),
    "b7_facts": (fact_rows, B7_FACTS_SQL),
    "c17_small_functions": (small_functions, SMALL_SQL),
    "c32_markers": (markers, C32_SQL),
    "c36_nested_sightings": (nested, f"WITH {ROLLED} SELECT rl.run_id, finding_id, (row_number() OVER (PARTITION BY rl.run_id, finding_id ORDER BY frame_idx, det_seq) - 1)::INT AS position, det_seq, frame_id FROM rl JOIN cl ON cl.run_id = rl.run_id AND cl.cls = rl.cls AND cl.cluster = rl.cluster"),
    "d7_localized_by_run": (localized_by_run, D7_SQL),
    "e23_requests": (requests, "SELECT run_id, frame_id, b AS batch FROM fx_frames, (VALUES (0), (1), (2)) v(b) WHERE NOT ((frame_id::INT + b) % 3 = 0 AND run_id % 2 = 0)"),
    "d23_positioned": (placed, f"WITH {ROLLED} SELECT rl.run_id, finding_id, round(CASE WHEN n_evidence % 2 = 0 THEN rl.lat ELSE f.lat END, 9) AS lat, round(CASE WHEN n_evidence % 2 = 0 THEN rl.lon ELSE f.lon END, 9) AS lon, n_evidence % 2 <> 0 AS approx FROM rl LEFT JOIN fx_frames f ON f.run_id = rl.run_id AND f.frame_id = best.frame AND f.frame_idx % 5 <> 0 WHERE n_evidence % 2 = 0 OR f.lat IS NOT NULL"),
    "d24_compared_runs": (compared, D24_SQL),
    "e5_roll_up": (roll_up, E5_SQL),
    "e8_scene_boxes": (views, E8_SQL),
    "e8_cloud_boxes": (cloud_extent, "SELECT seq_major % 20 AS run_id, count(*) AS n, min(x) AS x_min, max(x) AS x_max, min(y) AS y_min, max(y) AS y_max, min(z) AS z_min, max(z) AS z_max FROM fx_points GROUP BY 1"),
    "e22_triangulation": (fixed, E22_SQL),
    "e23_prompts": (prompts, E23_SQL),
    "g9_best_sighting": (best, f"WITH {ROLLED} SELECT run_id, finding_id, best.frame AS frame_id FROM rl"),
    "i14_csv_rows": (csv_rows, I14_SQL),
    "i16_rules": (rules, I16_SQL),
    "i24_tile_extents": (extents, E24_SQL),
    "i28_chosen_calibration": (chosen, I28_SQL),
    "j11_grounded": (grounded, J11_SQL),
    "k1_replay_with_end": (ended, K1_SQL),
}
QUERIES = {k: (f, oracle(sql)) for k, (f, sql) in QUERIES.items()}
