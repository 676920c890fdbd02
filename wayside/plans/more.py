"""Queries over model output, masks, CSV rows, evaluation, clouds, exports and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayside.fixtures import oracle, view
from wayside.functions import boxes, text
from wayside.operators import cloud, csvio, evaluate, export, findings, localize, perception, route, score, validate, zone
from wayside.plans import core
from wayside.plans.further import sql_thinned
from wayside.sources.sinks import written
from wayside.streaming import live

XYXY = ("x1", "y1", "x2", "y2")
CAM = core.CAM


def found(s, d) -> DataFrame:
    return view(s, d, "fx_findings")


def boxed(s, d) -> DataFrame:
    """Detections with their frame's number."""
    df = view(s, d, "fx_detections")
    return df.withColumn("box", boxes.make_box(*[F.col(c) for c in XYXY])).drop(*XYXY)


def flat(df: DataFrame) -> DataFrame:
    return df.select(*[c for c in df.columns if c != "box"], *[F.round(f"box.{c}", 6).alias(c) for c in XYXY])


def coerced(s, d):
    p = view(s, d, "fx_points")
    raw = F.array(F.col("x") * 5, F.col("z") * 10, F.col("x") * 5 - F.col("l_suppkey") % 7 * 40, F.col("z") * 10 + F.col("l_partkey") % 300)
    raw = F.when(F.col("l_partkey") % 5 == 0, F.transform(raw, lambda v: v / 2000.0)).otherwise(raw)
    return flat(p.select("seq_major", "l_partkey", "l_suppkey", "l_extendedprice", boxes.coerce_box(raw).alias("box")))


C15_SQL = """WITH r AS (SELECT seq_major, l_partkey, l_suppkey, l_extendedprice, x * 5 AS a, z * 10 AS b, x * 5 - l_suppkey % 7 * 40 AS c, z * 10 + l_partkey % 300 AS e,
 CASE WHEN l_partkey % 5 = 0 THEN 2000.0e0 ELSE 1.0e0 END AS q FROM fx_points),
n AS (SELECT *, CASE WHEN least(a / q, b / q, c / q, e / q) >= 0 AND greatest(a / q, b / q, c / q, e / q) <= 1 THEN 1000 ELSE 1 END / q AS m FROM r),
k AS (SELECT *, greatest(0, least(1000, least(a * m, c * m))) AS x1, greatest(0, least(1000, least(b * m, e * m))) AS y1, greatest(0, least(1000, greatest(a * m, c * m))) AS x2, greatest(0, least(1000, greatest(b * m, e * m))) AS y2 FROM n),
o AS (SELECT *, x2 - x1 >= 2 AND y2 - y1 >= 2 AND NOT (x2 - x1 > 920 AND y2 - y1 > 920) AS ok FROM k)
SELECT seq_major, l_partkey, l_suppkey, l_extendedprice, CASE WHEN ok THEN round(x1, 6) END AS x1, CASE WHEN ok THEN round(y1, 6) END AS y1, CASE WHEN ok THEN round(x2, 6) END AS x2, CASE WHEN ok THEN round(y2, 6) END AS y2 FROM o"""


def severities(s, d):
    b = boxed(s, d)
    crop = boxes.crop_rectangle(F.col("box"), F.lit(1280), F.lit(720), 0.30)
    return b.select("det_seq", boxes.severity_from(F.col("cls"), F.col("confidence"), F.col("box")).alias("graded"), F.round(boxes.area_fraction(F.col("box")), 9).alias("share"), "severity", crop.alias("r")).select("det_seq", "graded", "share", "r.left", "r.top", "r.right", "r.bottom")


C18_SQL = """WITH b AS (SELECT *, (x2 - x1) * (y2 - y1) / 1e6 AS share, x1 * 1.28e0 AS l, x2 * 1.28e0 AS r, y1 * 0.72e0 AS t, y2 * 0.72e0 AS u FROM fx_detections)
SELECT det_seq, greatest(1, least(5, CASE cls WHEN 'pothole' THEN 4 ELSE 3 END + CASE WHEN confidence >= 0.7e0 AND share > 0.02e0 THEN 1 WHEN confidence < 0.4e0 THEN -1 ELSE 0 END))::INT AS graded, round(share, 9) AS share,
 greatest(0, floor(x1 / 1000 * 1280 - (x2 / 1000 * 1280 - x1 / 1000 * 1280) * 0.3e0))::BIGINT AS left, greatest(0, floor(y1 / 1000 * 720 - (y2 / 1000 * 720 - y1 / 1000 * 720) * 0.3e0))::BIGINT AS top,
 least(1280, ceil(x2 / 1000 * 1280 + (x2 / 1000 * 1280 - x1 / 1000 * 1280) * 0.3e0))::BIGINT AS right, least(720, ceil(y2 / 1000 * 720 + (y2 / 1000 * 720 - y1 / 1000 * 720) * 0.3e0))::BIGINT AS bottom FROM b"""


def tile_grid(s, d):
    height = F.col("height") + (F.col("frame_idx") % 3).cast("int") * 200
    return core.frames(s, d).select("run_id", "frame_idx", F.explode(boxes.tiles(F.col("width"), height, 640, 128)).alias("t")).select("run_id", "frame_idx", "t.x", "t.y", "t.w", "t.h")


C35_SQL = """SELECT run_id, frame_idx, i::INT AS x, j::INT AS y, least(640, 1280 - i)::INT AS w, least(640, 720 + frame_idx % 3 * 200 - j)::INT AS h
FROM fx_frames, range(0, 1152, 512) a(i), range(0, 2000, 512) b(j) WHERE j < 720 + frame_idx % 3 * 200 - 128"""


def violations(s, d):
    """Detections with a severity, confidence, box or range out of its band, told from the id."""
    n = F.col("det_seq")
    box = F.when(n % 11 == 0, F.array("x1", "y1", "x2")).when(n % 17 != 0, F.array("x1", "y1", "x2", "y2"))
    rows = view(s, d, "fx_boxes").select(
        "run_id", "det_seq", F.col("severity") + F.when(n % 7 == 0, 4).otherwise(0).alias("severity"),
        (F.col("confidence") + F.when(n % 13 == 0, 1.0).otherwise(0.0)).alias("confidence"), box.alias("box"),
        F.when(n % 5 == 0, (n % 3).cast("double")).alias("range_m"),
    ).toDF("run_id", "det_seq", "severity", "confidence", "box", "range_m")
    sound, rest = validate.split(validate.with_violations(rows, validate.detection_rules()))
    return rest.select("run_id", "det_seq", F.array_join("violations", ",").alias("violations")).unionByName(sound.select("run_id", "det_seq", F.lit("").alias("violations")))


C34_SQL = """SELECT run_id, det_seq, concat_ws(',', CASE WHEN severity + CASE WHEN det_seq % 7 = 0 THEN 4 ELSE 0 END > 5 THEN 'severity' END,
 CASE WHEN confidence + CASE WHEN det_seq % 13 = 0 THEN 1 ELSE 0 END > 1 THEN 'confidence' END,
 CASE WHEN det_seq % 11 = 0 OR det_seq % 17 = 0 THEN 'box' END, CASE WHEN det_seq % 15 = 0 THEN 'range_m' END) AS violations FROM fx_boxes"""


def csv_rows(s, d):
    return view(s, d, "fx_csv")


def imported(s, d):
    r = csvio.import_findings(csv_rows(s, d), core.frames(s, d), view(s, d, "fx_taxonomy"))
    return r.select("run_id", "row_no", "finding_id", "cls", "known", "t_sec", F.round("lat", 9).alias("lat"), F.round("lon", 9).alias("lon"), "severity", "confidence", "frame_id")


PARSED = """pt AS (SELECT *, string_split(time, ':') AS tp FROM fx_csv),
pp AS (SELECT *, CASE len(tp) WHEN 1 THEN try_cast(tp[1] AS DOUBLE) WHEN 2 THEN try_cast(tp[1] AS DOUBLE) * 60 + try_cast(tp[2] AS DOUBLE) END AS tt,
  try_cast(nullif(trim(lat), '') AS DOUBLE) AS plat, try_cast(nullif(trim(lon), '') AS DOUBLE) AS plon,
  CASE WHEN round_even(try_cast(nullif(severity, '') AS DOUBLE), 0) BETWEEN 1 AND 5 THEN round_even(try_cast(nullif(severity, '') AS DOUBLE), 0)::INT END AS sev,
  CASE WHEN try_cast(confidence AS DOUBLE) BETWEEN 0 AND 1 THEN try_cast(confidence AS DOUBLE) END AS conf FROM pt),
pc AS (SELECT p.*, coalesce(a.cls, b.cls, replace(lower(defect_name), ' ', '_')) AS cls, coalesce(a.cls, b.cls) IS NOT NULL AS known FROM pp p
  LEFT JOIN fx_taxonomy a ON lower(p.defect_name) = a.cls LEFT JOIN fx_taxonomy b ON lower(p.defect_name) = lower(b.label))"""
I13_SQL = f"""WITH {PARSED}, oi AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY row_no) AS ordinal, row_number() OVER (PARTITION BY run_id, object_id ORDER BY row_no) AS again FROM pc),
nf AS (SELECT o.run_id, o.row_no, arg_min(struct_pack(f := f.frame_id, la := f.lat, lo := f.lon), struct_pack(d := abs(f.t_sec - coalesce(tt, 0)), i := f.frame_idx)) AS n FROM oi o JOIN fx_frames f ON f.run_id = o.run_id GROUP BY o.run_id, o.row_no)
SELECT o.run_id, o.row_no, CASE WHEN again > 1 THEN object_id || '-' || ordinal ELSE object_id END AS finding_id, cls, known, coalesce(tt, 0) AS t_sec, round(coalesce(plat, n.la), 9) AS lat,
 round(coalesce(plon, n.lo), 9) AS lon, coalesce(sev, 3) AS severity, coalesce(conf, 1) AS confidence, n.f AS frame_id FROM oi o JOIN nf ON o.run_id = nf.run_id AND o.row_no = nf.row_no"""


def counters(s, d):
    r = csvio.import_counters(csvio.parse_rows(csv_rows(s, d), view(s, d, "fx_taxonomy")))
    return r.withColumn("unknown_names", F.array_join("unknown_names", ","))


E21_SQL = f"""WITH {PARSED} SELECT run_id, count(*) AS rows, count(*) FILTER (tt IS NULL) AS bad_time, count(*) FILTER ((trim(lat) <> '' AND plat IS NULL) OR (trim(lon) <> '' AND plon IS NULL)) AS bad_coord,
 count(*) FILTER (sev IS NULL) AS default_severity, count(*) FILTER (NOT known) AS unknown, coalesce(string_agg(DISTINCT defect_name, ',' ORDER BY defect_name) FILTER (NOT known), '') AS unknown_names FROM pc GROUP BY run_id"""


def exported(s, d):
    along = written(route.chainage(core.frames(s, d)), "frames")
    placed = localize.localize(core.detections(s, d), along, view(s, d, "fx_taxonomy"), core.CAM)
    r = findings.cluster_detections(placed, along, view(s, d, "fx_taxonomy"))
    return csvio.export_findings(r, along, "https://example.org/")


def masks(s, d):
    return view(s, d, "fx_runs")


def spans(s, d):
    return zone.row_spans(masks(s, d))


F9_SQL = "SELECT frame, row_no, a1 AS left_px, b2 AS right_px, b2 - a1 + 1 AS span_px, greatest(b1 - a1 + 1, b2 - a2 + 1) AS free_px, b1 - a1 + 1 + b2 - a2 + 1 AS pixels FROM fx_masks"


def six(value):
    """The leading digits of a value of any size, times pi: no simple fraction then lies on the edge of rounding."""
    turned = value * F.pi()
    return F.when(F.abs(turned) < 1e-6, 0.0).otherwise(F.round(turned / F.pow(F.lit(10.0), F.floor(F.log10(F.abs(turned)))), 5))


def horizons(s, d):
    r = zone.horizon_fit(spans(s, d), 2000, 3)
    return r.select("frame", F.round("slope", 6).alias("slope"), six(F.col("horizon")).alias("horizon_pi"), F.round("r2", 6).alias("r2"))


E10_SQL = f"""WITH sp AS ({F9_SQL}), ft AS (SELECT frame, regr_slope(span_px, row_no) AS m, regr_intercept(span_px, row_no) AS b, regr_r2(span_px, row_no) AS r2, count(*) AS n FROM sp WHERE left_px > 0 AND right_px < 1999 GROUP BY frame)
SELECT frame, round(m, 6) AS slope, CASE WHEN abs(b / m * pi()) < 1e-6 THEN 0 ELSE round(-b / m * pi() / pow(10, floor(log10(abs(b / m * pi())))), 5) END AS horizon_pi, round(r2, 6) AS r2 FROM ft WHERE n >= 3 AND m > 1e-6"""


def road_share(s, d):
    return zone.coverage(masks(s, d), 1280, 720).select("frame", F.round("coverage", 9).alias("coverage"))


def small_masks(s, d):
    return masks(s, d).withColumn("row_no", F.col("row_no") * 40 + 400)


def widths(s, d):
    w = zone.carriageway_width(small_masks(s, d), 1280, 720, CAM, (5.0, 10.0, 16.9, 200.0))
    return w.select("frame", "range_m", "row_no", F.round("span_m", 6).alias("span_m"), F.round("free_m", 6).alias("free_m"), "reason")


I18_SQL = """WITH sp AS (SELECT frame, row_no * 40 + 400 AS row_no, a1, b2, b2 - a1 + 1 AS span, greatest(b1 - a1 + 1, b2 - a2 + 1) AS free FROM fx_masks), foc AS (SELECT 360 / tan(radians(29.0e0)) AS f),
w AS (SELECT DISTINCT frame, r AS range_m, round_even(360 + f * 1.35e0 / r, 0)::BIGINT AS row_no, f FROM sp, foc, (VALUES (5.0e0), (10.0e0), (16.9e0), (200.0e0)) v(r)),
g AS (SELECT *, CASE WHEN row_no > 360 AND 1.35e0 * f / (row_no - 360) <= 60 AND row_no < 720 THEN 1.35e0 * f / (row_no - 360) END AS actual FROM w),
j AS (SELECT g.*, span * actual / f AS span_m, free * actual / f AS free_m, a1, b2 FROM g LEFT JOIN sp ON g.frame = sp.frame AND g.row_no = sp.row_no)
SELECT frame, range_m, row_no, round(span_m, 6) AS span_m, round(free_m, 6) AS free_m, CASE WHEN actual IS NULL THEN 'no_row' WHEN a1 IS NULL THEN 'no_road' WHEN a1 = 0 OR b2 >= 1279 THEN 'clipped' WHEN span_m NOT BETWEEN 1.5 AND 40 THEN 'implausible' ELSE 'ok' END AS reason FROM j"""


def width_totals(s, d):
    r = zone.width_summary(zone.carriageway_width(small_masks(s, d), 1280, 720, CAM, (5.0, 10.0, 16.9, 200.0)))
    return r.select("n_samples", "n_ok", "n_clipped", "n_no_road", "n_no_row", "n_implausible", F.round("median_span_m", 6).alias("median_span_m"), F.round("max_span_m", 6).alias("max_span_m"))


E15_SQL = f"""SELECT count(*) AS n_samples, count(*) FILTER (reason = 'ok') AS n_ok, count(*) FILTER (reason = 'clipped') AS n_clipped, count(*) FILTER (reason = 'no_road') AS n_no_road, count(*) FILTER (reason = 'no_row') AS n_no_row,
 count(*) FILTER (reason = 'implausible') AS n_implausible, round(median(span_m) FILTER (reason = 'ok'), 6) AS median_span_m, round(max(span_m) FILTER (reason = 'ok'), 6) AS max_span_m FROM ({I18_SQL.replace('round(span_m, 6) AS span_m, round(free_m, 6) AS free_m', 'span_m, free_m')})"""


def component(s, d):
    return zone.largest_component(masks(s, d))


def on_mask(s, d):
    p = masks(s, d).select("frame", "row_no", (F.col("col_end") + F.col("frame") % 4).alias("col")).distinct()
    return zone.in_mask(p, masks(s, d))


D10_SQL = "WITH p AS (SELECT DISTINCT frame, row_no, col_end + frame % 4 AS col FROM fx_runs) SELECT p.*, EXISTS (SELECT 1 FROM fx_runs r WHERE r.frame = p.frame AND r.row_no = p.row_no AND p.col BETWEEN col_start AND col_end) AS on_mask FROM p"


def gated(s, d):
    corner = lambda x, y: F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y"))
    polygons = core.frames(s, d).filter("frame_idx % 3 <> 0").select("run_id", "frame_id", F.array(corner(300, 300), corner(900, 300), corner(900, 540), corner(300, 540)).alias("polygon"))
    rules = view(s, d, "fx_taxonomy").select("cls", F.col("cls").isin("pothole", "crack", "waterlogging").alias("carriageway_only"))
    b = boxed(s, d).join(F.broadcast(view(s, d, "fx_taxonomy").select("cls", "geometry")), "cls")
    return zone.gate(b, rules, polygons, 1280, 720).select("run_id", "det_seq", "on_carriageway")


D9_SQL = """SELECT d.run_id, det_seq, CASE WHEN d.cls IN ('pothole', 'crack', 'waterlogging') AND frame_idx % 3 <> 0 THEN (x1 + x2) / 2000 * 1280 BETWEEN 300 AND 900 AND CASE WHEN geometry = 'point' THEN y2 ELSE (y1 + y2) / 2 END / 1000 * 720 BETWEEN 300 AND 540 END AS on_carriageway
FROM fx_detections d JOIN fx_taxonomy t ON d.cls = t.cls"""


def majority(s, d):
    cells = view(s, d, "fx_boxes").select("run_id", "frame_idx", (F.col("det_seq") % 3).alias("cell")).distinct()
    return zone.temporal_majority(cells, core.frames(s, d))


F7_SQL = """WITH c AS (SELECT DISTINCT run_id, frame_idx, det_seq % 3 AS cell FROM fx_boxes),
f AS (SELECT run_id, frame_idx, min(frame_idx) OVER (PARTITION BY run_id) AS first FROM (SELECT DISTINCT run_id, frame_idx FROM fx_frames))
SELECT f.run_id, f.frame_idx, c.cell FROM f JOIN c ON c.run_id = f.run_id AND c.frame_idx BETWEEN f.frame_idx - 4 AND f.frame_idx
GROUP BY f.run_id, f.frame_idx, f.first, c.cell HAVING count(*) > 0.5 * least(5, f.frame_idx - f.first + 1)"""


def marks(s, d):
    p = view(s, d, "fx_points")
    return p.select((F.lit(420.0) + F.col("l_partkey") % 200).alias("v1"), (F.lit(430.0) + F.col("l_partkey") % 200 + F.col("z")).alias("v2"), (F.col("l_suppkey") % 40 * 0.05 + F.col("z") * 0.1).alias("dist"))


def calibration(s, d):
    r = zone.fit_calibration(marks(s, d), [300.0, 330.0, 360.0, 390.0])
    return r.select("row", F.round("product", 3).alias("product"), F.round("rms_m", 6).alias("rms_m"), "n")


E12_SQL = """WITH o AS (SELECT 420.0e0 + l_partkey % 200 AS v1, 430.0e0 + l_partkey % 200 + z AS v2, l_suppkey % 40 * 0.05e0 + z * 0.1e0 AS dist FROM fx_points),
k AS (SELECT r AS row, dist, 1 / (v1 - r) - 1 / (v2 - r) AS k FROM o, (VALUES (300.0e0), (330.0e0), (360.0e0), (390.0e0)) g(r)),
f AS (SELECT row, sum(k * dist) / sum(k * k) AS p, count(*) AS n FROM k GROUP BY row)
SELECT k.row, round(any_value(p), 3) AS product, round(sqrt(avg(pow(dist - p * k, 2))), 6) AS rms_m, count(*) AS n FROM k JOIN f ON k.row = f.row GROUP BY k.row"""


def best_row(s, d):
    r = zone.best_calibration(marks(s, d), [300.0, 330.0, 360.0, 390.0])
    return r.select("row", F.round("product", 3).alias("product"), F.round("rms_m", 6).alias("rms_m"))


def crops(s, d):
    e = s.read.parquet(f"{d}/embeddings.parquet")
    c = e.filter("vec_id >= 10").select(F.col("vec_id").alias("crop_id"), F.col("embedding").alias("vec"))
    p = e.filter("vec_id < 10").select(F.col("vec_id").alias("owner"), (F.col("vec_id") % 2 == 0).alias("is_positive"), F.col("embedding").alias("p_vec"))
    return perception.prompt_scores(c, p, 10.0).select("crop_id", "owner", "is_positive", F.round("score", 6).alias("score"))


I26_SQL = """WITH l AS (SELECT c.vec_id AS crop_id, p.vec_id AS owner, p.vec_id % 2 = 0 AS is_positive, 10 * list_dot_product(c.embedding::DOUBLE[], p.embedding::DOUBLE[]) AS x FROM embeddings c, embeddings p WHERE c.vec_id >= 10 AND p.vec_id < 10),
e AS (SELECT *, exp(x - max(x) OVER (PARTITION BY crop_id)) AS e FROM l) SELECT crop_id, owner, is_positive, round(e / sum(e) OVER (PARTITION BY crop_id), 6) AS score FROM e"""


def repeats(s, d):
    twice = boxed(s, d).withColumn("det_seq", F.col("det_seq") * 2)
    shaken = twice.withColumn("det_seq", F.col("det_seq") + 1).withColumn("box", boxes.make_box(*[F.col(f"box.{c}") + F.when(F.col("det_seq") % 3 == 0, 0.4).otherwise(0.6) for c in XYXY]))
    return perception.drop_repeats(twice.unionByName(shaken)).select("run_id", "det_seq")


G8_SQL = """WITH u AS (SELECT run_id, frame_id, cls, det_seq * 2 AS q, x1, y1, x2, y2 FROM fx_detections UNION ALL SELECT run_id, frame_id, cls, det_seq * 2 + 1, x1 + s, y1 + s, x2 + s, y2 + s FROM (SELECT *, CASE WHEN (det_seq * 2 + 1) % 3 = 0 THEN 0.4e0 ELSE 0.6e0 END AS s FROM fx_detections))
SELECT run_id, q AS det_seq FROM u QUALIFY row_number() OVER (PARTITION BY run_id, frame_id, cls, round_even(x1, 0), round_even(y1, 0), round_even(x2, 0), round_even(y2, 0) ORDER BY q) = 1"""


def suppressed(s, d):
    return perception.suppress(boxed(s, d), 0.1).select("run_id", "det_seq")


def ensemble(s, d):
    b = boxed(s, d)
    moved = b.withColumn("box", boxes.make_box(*[F.col(f"box.{c}") + F.col("det_seq") % 30 for c in XYXY]))
    return perception.ensemble_merge(b, moved)


def anchors(s, d):
    e = s.read.parquet(f"{d}/embeddings.parquet")
    part = F.transform(F.slice("embedding", 1, 5), lambda x: F.abs(x.cast("double")) * 2)
    a = e.select((F.col("vec_id") % 7).cast("long").alias("run_id"), F.lpad((F.col("vec_id") % 9).cast("string"), 5, "0").alias("frame_id"), F.col("vec_id").alias("anchor_id"), (F.col("vec_id") * 37 % 600 + 20.0).alias("cx"), (F.col("vec_id") * 53 % 300 + 160.0).alias("cy"), F.lit(80.0).alias("w"), F.lit(60.0).alias("h"), part.alias("scores"))
    return flat(perception.decode_anchors(a, ["pothole", "crack", "rutting", "patching", "bleeding"], 1280, 720).select("run_id", "anchor_id", "cls", F.round("confidence", 6).alias("confidence"), "severity", "box"))


def replies(s, d):
    e = s.read.parquet(f"{d}/events.parquet")
    body = F.format_string('{"cls": "%s", "box": [%d, %d, %d, %d], "severity": %d, "evidence": %s}', F.lit("pothole"), F.col("event_id") % 500, F.lit(300), F.col("event_id") % 500 + 100, F.lit(400), F.col("event_id") % 7, F.to_json(F.struct("props")))
    kind = F.col("event_id") % 4
    reply = F.when(kind == 0, F.concat(F.lit('```json\n{"detections": ['), body, F.lit("]}\n```"))).when(kind == 1, F.concat(F.lit("<think>{}</think>["), body, F.lit("]"))).when(kind == 2, F.concat(F.lit('{"detections": ['), body, F.lit("]}"))).otherwise(F.lit("nothing to see {"))
    r = e.select(F.col("user_id").alias("run_id"), F.col("event_id").cast("string").alias("frame_id"), reply.alias("reply"))
    return flat(perception.parse_replies(r, view(s, d, "fx_taxonomy")).select("run_id", "frame_id", "cls", "severity", "confidence", "box"))


I11_SQL = """SELECT user_id AS run_id, event_id::VARCHAR AS frame_id, 'pothole' AS cls, greatest(1, least(5, event_id % 7))::INT AS severity, 0.6e0 AS confidence, (event_id % 500)::DOUBLE AS x1, 300.0e0 AS y1, (event_id % 500 + 100)::DOUBLE AS x2, 400.0e0 AS y2 FROM events WHERE event_id % 4 <> 3"""


def verified(s, d):
    f = found(s, d).withColumn("n_evidence", F.lit(1))
    v = perception.needs_check(f, []).select("run_id", "finding_id", F.when(F.col("det_seq") % 5 == 0, "reject").when(F.col("det_seq") % 5 == 1, "confirm").otherwise("unsure").alias("verdict"))
    return perception.apply_verdicts(f, v).select("run_id", "finding_id", "confidence")


I12_SQL = """SELECT run_id, finding_id, CASE WHEN confidence >= 0.85e0 THEN confidence WHEN det_seq % 5 = 1 THEN least(1, round(confidence * 1.15e0, 3)) ELSE greatest(0.05e0, round(confidence * 0.75e0, 3)) END AS confidence
FROM fx_findings WHERE confidence >= 0.85e0 OR det_seq % 5 <> 0"""


def verdict_stats(s, d):
    v = found(s, d).select("run_id", F.when(F.col("det_seq") % 5 == 0, "reject").when(F.col("det_seq") % 5 == 1, "confirm").otherwise("unsure").alias("verdict"))
    return perception.verification_stats(v)


def cache_misses(s, d):
    r = found(s, d).select("run_id", "finding_id", F.col("frame_id").alias("image"), F.col("cls").alias("prompt"))
    key = F.sha2(F.concat_ws("|", "image", "prompt", F.lit("m1")), 256)
    c = r.filter("run_id % 3 = 0").select(key.alias("key"), F.when(F.col("run_id") % 2 == 0, '{"a": 1}').otherwise('{"a": ').alias("reply")).dropDuplicates(["key", "reply"])
    return perception.uncached(r, c, "m1").select("run_id", "finding_id", "key")


D17_SQL = """WITH r AS (SELECT run_id, finding_id, sha256(frame_id || '|' || cls || '|m1') AS key FROM fx_findings) SELECT run_id, finding_id, key FROM r WHERE key NOT IN (SELECT key FROM r WHERE run_id % 6 = 0)"""


def matched(s, d):
    r = evaluate.match_findings(found(s, d), view(s, d, "fx_objects"))
    return r.select("run_id", "cls", "object_id", "finding_id", F.round("distance_m", 6).alias("distance_m"))


def matched_any(s, d):
    r = evaluate.match_findings(found(s, d), view(s, d, "fx_objects"), None)
    return r.select("run_id", "cls", "object_id", "finding_id", F.round("distance_m", 6).alias("distance_m"))


def quality(s, d):
    f, o = found(s, d), view(s, d, "fx_objects")
    r = evaluate.score_matches(written(evaluate.match_findings(f, o), "matches"), f, o).withColumn("median_m", F.round("median_m", 6))
    return r.withColumns({c: F.array_join(c, ",") for c in ("fp_classes", "fn_classes")})


def truth_and_predictions(s, d):
    b = boxed(s, d).withColumn("image", F.concat_ws("/", "run_id", "frame_id"))
    t = b.select("image", "cls", F.col("det_seq").alias("truth_id"), "box")
    p = b.filter("det_seq % 4 <> 0").select("image", F.when(F.col("det_seq") % 9 == 0, "crack").otherwise(F.col("cls")).alias("cls"), F.col("det_seq").alias("pred_id"), "confidence", boxes.make_box(*[F.col(f"box.{c}") + F.col("det_seq") % 20 for c in XYXY]).alias("box"))
    return t, p


def precision_of_boxes(s, d):
    t, p = truth_and_predictions(s, d)
    parts = [evaluate.average_precision(evaluate.pair_boxes(t, p, iou), t).withColumn("iou", F.lit(iou)) for iou in (0.5, 0.75)]
    return parts[0].unionByName(parts[1]).withColumn("ap", F.round("ap", 6))


def confused(s, d):
    t, p = truth_and_predictions(s, d)
    return evaluate.confusion(t, p, 0.5, 0.4)


def truth_by_time(s, d):
    t = found(s, d).select("run_id", F.format_string("%.2f", F.col("t_sec") + 0.001).alias("key"), "finding_id")
    return evaluate.join_on_time(core.frames(s, d), t).select("run_id", "frame_idx", "finding_id")


def tracked_boxes(s, d):
    k = boxed(s, d).filter("frame_idx % 5 = 0").groupBy("run_id", "cls", "frame_idx").agg(F.min_by("box", "det_seq").alias("box")).select("run_id", F.col("cls").alias("obj"), F.col("frame_idx").cast("double").alias("t"), "box")
    return flat(evaluate.box_track(k, core.frames(s, d)))


D14_SQL = """WITH k AS (SELECT run_id, cls AS obj, frame_idx * 1.0e0 AS t, arg_min(x1, det_seq) AS x1, arg_min(y1, det_seq) AS y1, arg_min(x2, det_seq) AS x2, arg_min(y2, det_seq) AS y2 FROM fx_detections WHERE frame_idx % 5 = 0 GROUP BY run_id, cls, frame_idx),
l AS (SELECT *, lead(t) OVER w AS t2, lead(x1) OVER w AS p1, lead(y1) OVER w AS q1, lead(x2) OVER w AS p2, lead(y2) OVER w AS q2 FROM k WINDOW w AS (PARTITION BY run_id, obj ORDER BY t)),
j AS (SELECT l.*, f.frame_idx, (f.t_sec - t) / (t2 - t) AS w FROM l JOIN fx_frames f ON f.run_id = l.run_id AND f.t_sec BETWEEN t AND t2 QUALIFY row_number() OVER (PARTITION BY l.run_id, obj, f.frame_idx ORDER BY t) = 1)
SELECT run_id, obj, frame_idx, round(x1 + (p1 - x1) * w, 6) AS x1, round(y1 + (q1 - y1) * w, 6) AS y1, round(x2 + (p2 - x2) * w, 6) AS x2, round(y2 + (q2 - y2) * w, 6) AS y2 FROM j WHERE x2 + (p2 - x2) * w > x1 + (p1 - x1) * w AND y2 + (q2 - y2) * w > y1 + (q1 - y1) * w"""


def unmatched(s, d):
    objects = view(s, d, "fx_objects")
    return evaluate.unmatched_objects(evaluate.match_findings(found(s, d), objects), objects).select("run_id", "object_id")


def cloud_points(s, d):
    p = view(s, d, "fx_points")
    return cloud.clean_points(p.withColumn("seq", F.struct("seq_major", "l_partkey", "l_suppkey", "l_extendedprice")), 2.0)


def voxels(s, d):
    v = cloud.voxel_cells(cloud_points(s, d), 12.5)
    return v.select(F.col("seq.seq_major").alias("seq_major"), F.col("seq.l_partkey").alias("l_partkey"), "x", "y", "z")


E14_SQL = """WITH p AS (SELECT * FROM fx_points WHERE conf >= 2), lo AS (SELECT min(x) AS x0, min(y) AS y0, min(z) AS z0 FROM p)
SELECT seq_major, l_partkey, x, y, z FROM p, lo QUALIFY row_number() OVER (PARTITION BY floor((x - x0) / 12.5), floor((y - y0) / 12.5), floor((z - z0) / 12.5) ORDER BY seq_major, l_partkey, l_suppkey, l_extendedprice, x, y, z) = 1"""


def thinned(s, d):
    v = cloud.voxel_downsample(cloud_points(s, d), 2000)
    return v.select(F.col("seq.seq_major").alias("seq_major"), "x", "y", "z")


E14_BUDGET_SQL = f"""WITH src AS (SELECT 0 AS run_id, seq_major, l_partkey, l_suppkey, l_extendedprice, x, y, z FROM fx_points WHERE conf >= 2), {sql_thinned('src', 2000)}
SELECT seq_major, x, y, z FROM cell WHERE n <= 2000 UNION ALL SELECT seq_major, x, y, z FROM cell c JOIN size s ON c.run_id = s.run_id WHERE n > 2000
QUALIFY row_number() OVER (PARTITION BY i // m, j // m, k // m ORDER BY seq_major, l_partkey, l_suppkey, l_extendedprice, x, y, z) = 1"""


def similarity(s, d):
    p = view(s, d, "fx_points").select(F.col("x").alias("sx"), F.col("y").alias("sy"), (F.col("x") * 1.2 - F.col("y") * 0.5 + F.col("z") * 0.01 + 40).alias("dx"), (F.col("x") * 0.5 + F.col("y") * 1.2 - 7).alias("dy"))
    return cloud.fit_similarity(p).select(*[F.round(c, 6).alias(c) for c in ("scale", "yaw", "tx", "ty")])


E13_SQL = """WITH p AS (SELECT x AS sx, y AS sy, x * 1.2e0 - y * 0.5e0 + z * 0.01e0 + 40 AS dx, x * 0.5e0 + y * 1.2e0 - 7 AS dy FROM fx_points), m AS (SELECT avg(sx) AS a, avg(sy) AS b, avg(dx) AS c, avg(dy) AS e FROM p),
f AS (SELECT any_value(a) AS a, any_value(b) AS b, any_value(c) AS c, any_value(e) AS e, sqrt(sum(pow(dx - c, 2) + pow(dy - e, 2)) / sum(pow(sx - a, 2) + pow(sy - b, 2))) AS k, atan2(sum((sx - a) * (dy - e) - (sy - b) * (dx - c)), sum((sx - a) * (dx - c) + (sy - b) * (dy - e))) AS w FROM p, m)
SELECT round(k, 6) AS scale, round(w, 6) AS yaw, round(c - k * (cos(w) * a - sin(w) * b), 6) AS tx, round(e - k * (cos(w) * b + sin(w) * a), 6) AS ty FROM f"""


def placed_cloud(s, d):
    p = cloud_points(s, d)
    fit = s.range(1).select(F.lit(1.5).alias("scale"), F.lit(0.25).alias("yaw"), F.lit(10.0).alias("tx"), F.lit(-4.0).alias("ty"))
    return cloud.georeference(p, fit).select(F.col("seq.seq_major").alias("q"), F.col("seq.l_partkey").alias("k"), *[F.round(c, 6).alias(c) for c in "xyz"])


C31_SQL = """SELECT seq_major AS q, l_partkey AS k, round(1.5e0 * (cos(0.25e0) * x - sin(0.25e0) * y) + 10, 6) AS x, round(1.5e0 * z, 6) AS y, round(-(1.5e0 * (sin(0.25e0) * x + cos(0.25e0) * y) - 4), 6) AS z FROM fx_points WHERE conf >= 2"""


def depth_fit(s, d):
    p = view(s, d, "fx_points").select((F.col("seq_major") % 50).alias("frame"), F.col("x").alias("d"), (F.col("y") + 1).alias("ground_m"))
    r = cloud.fit_depth_scale(p)
    return r.select("frame", F.round("a", 8).alias("a"), F.round("b", 8).alias("b"), "n")


E9_SQL = "SELECT seq_major % 50 AS frame, round(regr_slope(1 / (y + 1), x), 8) AS a, round(regr_intercept(1 / (y + 1), x), 8) AS b, regr_count(y, x)::BIGINT AS n FROM fx_points GROUP BY 1 HAVING count(*) >= 40"


def depth_points(s, d):
    p = view(s, d, "fx_points").select((F.col("seq_major") % 50).alias("frame"), F.col("l_partkey").alias("k"), F.col("x").alias("d"))
    fits = view(s, d, "fx_points").select((F.col("seq_major") % 50).alias("frame")).distinct().select("frame", F.lit(0.002).alias("a"), F.lit(0.01).alias("b"))
    return cloud.back_project(p, fits, 2.0, 20.0).select("frame", "k", "d", F.round("z_m", 6).alias("z_m"))


C30_SQL = "SELECT seq_major % 50 AS frame, l_partkey AS k, x AS d, round(1 / (0.002e0 * x + 0.01e0), 6) AS z_m FROM fx_points WHERE 1 / (0.002e0 * x + 0.01e0) BETWEEN 2 AND 20"


def tiles_of_runs(s, d):
    return cloud.tile_cover(cloud.route_boxes(core.frames(s, d), 60.0), 18)


BOXES_SQL = """bx AS (SELECT run_id, min(lat) - 60 / 111320.0e0 AS south, min(lon) - 60 / (111320 * cos(radians(avg(lat)))) AS west, max(lat) + 60 / 111320.0e0 AS north, max(lon) + 60 / (111320 * cos(radians(avg(lat)))) AS east FROM fx_frames GROUP BY run_id)"""
I24_SQL = f"""WITH {BOXES_SQL}, t AS (SELECT run_id, floor((west + 180) / 360 * 262144)::BIGINT AS x0, floor((east + 180) / 360 * 262144)::BIGINT AS x1, floor((1 - asinh(tan(radians(north))) / pi()) / 2 * 262144)::BIGINT AS y0, floor((1 - asinh(tan(radians(south))) / pi()) / 2 * 262144)::BIGINT AS y1 FROM bx)
SELECT run_id, x, y, (x1 - x0 + 1) * (y1 - y0 + 1) > 256 AS over FROM (SELECT *, unnest(range(x0, x1 + 1)) AS x FROM t), LATERAL (SELECT unnest(range(y0, y1 + 1)) AS y)"""


def run_boxes(s, d):
    return cloud.route_boxes(core.frames(s, d), 60.0).select("run_id", *[F.round(c, 9).alias(c) for c in ("south", "west", "north", "east")])


def twin(s, d):
    """Surroundings made of orders: a square for each, some buildings, some roads."""
    p = view(s, d, "fx_points")
    at = lambda i, j: F.struct((12.97 + F.col("l_partkey") * 0.0001 + i * 0.0001).alias("lat"), (77.593 + F.col("l_suppkey") * 0.0003 + j * 0.0001).alias("lon"))
    tags = F.when(F.col("seq_major") % 3 == 0, F.create_map(F.lit("building"), F.lit("yes"), F.lit("building:levels"), (F.col("l_partkey") % 6).cast("string"))).otherwise(F.create_map(F.lit("highway"), F.lit("residential")))
    e = p.select(F.lit("way").alias("type"), F.xxhash64("seq_major", "l_partkey", "l_suppkey", "l_extendedprice").alias("id"), tags.alias("tags"), F.array(at(0, 0), at(0, 1), at(1, 1), at(1, 0)).alias("geometry"))
    r = cloud.surroundings(e, cloud.route_boxes(core.frames(s, d), 60.0))
    return r.groupBy("run_id", "kind").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("height_m"), 3).alias("height_sum"))


def worst(s, d):
    return export.worst_findings(found(s, d)).select("run_id", "rank", "finding_id")


def tour(s, d):
    return export.tour_stops(found(s, d), 8).select("run_id", "stop", "finding_id")


G2_SQL = """WITH t AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY severity DESC, t_sec, finding_id) AS r FROM fx_findings), o AS (SELECT run_id, finding_id, row_number() OVER (PARTITION BY run_id ORDER BY t_sec, finding_id) AS stop FROM t WHERE r <= 8)
SELECT run_id, stop::INT AS stop, finding_id FROM o UNION ALL SELECT DISTINCT run_id, 0, NULL FROM o"""


def by_class(s, d):
    return export.class_counts(found(s, d), view(s, d, "fx_taxonomy"))


def marks_text(s, d):
    return export.placemarks(found(s, d), view(s, d, "fx_taxonomy"))


B6_SQL = """SELECT run_id, finding_id, '<Placemark><name>' || label || '</name><styleUrl>#ff' || substr(color, 6, 2) || substr(color, 4, 2) || substr(color, 2, 2) || '</styleUrl><Point><coordinates>' || printf('%.8f,%.8f,0', f.lon, f.lat) || '</coordinates></Point></Placemark>' AS kml FROM fx_findings f JOIN fx_taxonomy t ON f.cls = t.cls"""


def texts(s, d):
    f = found(s, d)
    t = F.col("det_seq") * 1.237
    return f.select("det_seq", text.time_text(t).alias("time"), F.round(text.parse_time(text.time_text(t)), 3).alias("back"), text.slug(F.concat(F.lit("Big "), "cls")).alias("slug"), text.title(F.concat("cls", F.lit("_x"))).alias("title"),
                    text.drive_id(F.concat(F.lit("https://host/file/d/"), "finding_id", F.lit("/view"))).alias("drive"), text.building_height(F.concat((F.col("det_seq") % 40).cast("string"), F.lit(" m")), F.lit(None)).alias("height"), text.xml_escape(F.concat("cls", F.lit("<&>"))).alias("xml"))


J_SQL = """SELECT det_seq, floor(det_seq * 1.237e0 / 60)::BIGINT || ':' || lpad(printf('%.3f', det_seq * 1.237e0 - floor(det_seq * 1.237e0 / 60) * 60), 6, '0') AS time, round(det_seq * 1.237e0, 3) AS back, 'big_' || cls AS slug,
 upper(substr(cls, 1, 1)) || substr(cls, 2) || ' X' AS title, finding_id AS drive, greatest(2.0e0, det_seq % 40) AS height, cls || '&lt;&amp;&gt;' AS xml FROM fx_findings"""


def running(s, d):
    return export.running_counts(view(s, d, "fx_detections"))


F8_SQL = """WITH a AS (SELECT run_id, frame_idx, cls, count(*) AS n FROM fx_detections GROUP BY ALL), g AS (SELECT f.run_id, f.frame_idx, c.cls FROM (SELECT DISTINCT run_id, frame_idx FROM a) f JOIN (SELECT DISTINCT run_id, cls FROM a) c ON f.run_id = c.run_id),
t AS (SELECT g.*, sum(coalesce(n, 0)) OVER (PARTITION BY g.run_id, g.cls ORDER BY g.frame_idx)::BIGINT AS total FROM g LEFT JOIN a ON g.run_id = a.run_id AND g.frame_idx = a.frame_idx AND g.cls = a.cls),
r AS (SELECT *, row_number() OVER (PARTITION BY run_id, frame_idx ORDER BY total DESC, cls) AS rank FROM t WHERE total > 0) SELECT run_id, frame_idx, cls, total, rank::INT AS rank FROM r WHERE rank <= 4"""


def segment_worst(s, d):
    f = found(s, d)
    return export.worst_of_segment(score.build_segments(core.frames(s, d), f, view(s, d, "fx_taxonomy")), f)


D21_SQL = f"""WITH RECURSIVE {core.SEGS}, x AS (SELECT run_id, seg_id, unnest(string_split(ids, ',')) AS finding_id FROM scored WHERE n > 0)
SELECT x.run_id, x.seg_id::INT AS seg_id, x.finding_id FROM x JOIN fx_findings f ON x.run_id = f.run_id AND x.finding_id = f.finding_id QUALIFY row_number() OVER (PARTITION BY x.run_id, x.seg_id ORDER BY f.severity DESC, x.finding_id) = 1"""


def absence_gap(s, d):
    from wayside.operators import absence

    g = core.gaps_of(s, d)
    return export.gap_of_absence(absence.infer_absences(g, core.frames(s, d)), g).select("run_id", "finding_id", F.round("start_m", 6).alias("start_m"), F.round("end_m", 6).alias("end_m"))


D20_SQL = f"WITH {core.GAPS} SELECT run_id, 'a-' || lpad((row_number() OVER (PARTITION BY run_id ORDER BY s) - 1)::VARCHAR, 4, '0') AS finding_id, round(s, 6) AS start_m, round(e, 6) AS end_m FROM gaps"


def checks(s, d):
    t = view(s, d, "fx_track")
    span = t.groupBy("run_id").agg((F.max("t") - F.min("t")).alias("span_s")).join(route.route_length(core.frames(s, d)), "run_id")
    clips = span.select("run_id", (F.col("span_s") * (1 + F.col("run_id") % 3)).alias("duration_s"), F.lit(30.0).alias("fps"), F.when(F.col("run_id") % 2 == 0, "default").otherwise("car").alias("camera"), (F.col("run_id") % 4 * 0.1).alias("pitch_offset_frac"), (F.col("run_id") % 5 * 0.5).alias("offset_s"))
    return export.preflight(clips, span, core.vfr(s, d)).select("run_id", "check", "status")


I15_SQL = f"""WITH {core.CUM}, sp AS (SELECT t.run_id, max(t) - min(t) AS span FROM fx_track t GROUP BY t.run_id), ln AS (SELECT run_id, max(cum_m) AS m FROM cum GROUP BY run_id),
vf AS (SELECT run_id, coalesce(max(g) - min(g) > 0.5, false) AS v FROM (SELECT run_id, t - lag(t) OVER (PARTITION BY run_id ORDER BY seq) AS g FROM fx_track) GROUP BY run_id)
SELECT sp.run_id, c AS check, CASE c WHEN 'duration' THEN CASE WHEN span > 0 THEN 'ok' ELSE 'fail' END WHEN 'frame_rate' THEN CASE WHEN v THEN 'warn' ELSE 'ok' END
 WHEN 'speed' THEN CASE WHEN span = 0 THEN 'fail' WHEN m / span < 0.5 OR m / span > 40 THEN 'warn' ELSE 'ok' END WHEN 'track_cover' THEN CASE WHEN sp.run_id % 3 = 2 THEN 'warn' ELSE 'ok' END
 WHEN 'clock_offset' THEN CASE WHEN sp.run_id % 5 >= 2 THEN 'warn' ELSE 'ok' END ELSE CASE WHEN sp.run_id % 2 = 0 OR sp.run_id % 4 = 0 THEN 'warn' ELSE 'ok' END END AS status
FROM sp JOIN ln ON sp.run_id = ln.run_id JOIN vf ON vf.run_id = sp.run_id, (VALUES ('duration'), ('frame_rate'), ('speed'), ('track_cover'), ('clock_offset'), ('camera')) k(c)"""


def events_stream(s, d) -> DataFrame:
    table = s.read.parquet(f"{d}/events.parquet")
    stream = s.readStream.schema(table.schema).option("pathGlobFilter", "events.parquet").parquet(d)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def as_findings(e: DataFrame) -> DataFrame:
    kinds = F.create_map(*[F.lit(x) for x in ("error", "pothole", "click", "crack", "view", "streetlight", "signup", "waterlogging", "purchase", "garbage")])
    return e.select(F.col("user_id").alias("run_id"), F.concat(F.lit("f-"), F.col("event_id").cast("string")).alias("finding_id"), F.element_at(kinds, F.col("event_type")).alias("cls"), F.lit(12.97).alias("lat"), F.lit(77.59).alias("lon"), (F.col("event_id") % 5 + 1).cast("int").alias("severity"), F.lit(0.5).alias("confidence"), F.col("event_id").cast("double").alias("t_sec"))


def name(prefix: str) -> str:
    return f"{prefix}_{uuid.uuid4().hex}"


def replay(s, d):
    r = live.drain(live.event_payload(as_findings(events_stream(s, d)), view(s, d, "fx_taxonomy")), name("replay"))
    return r.select("run_id", "t_sec", "alert", F.get_json_object("event", "$.finding.cls").alias("cls"))


K1_SQL = """SELECT user_id AS run_id, event_id::DOUBLE AS t_sec, event_type IN ('error', 'signup') AS alert, CASE event_type WHEN 'error' THEN 'pothole' WHEN 'click' THEN 'crack' WHEN 'view' THEN 'streetlight' WHEN 'signup' THEN 'waterlogging' ELSE 'garbage' END AS cls FROM events"""


def window_counts(s, d):
    """Counts of closed windows; a last sign of life lets the watermark pass them all."""
    beats, run = f"{live.scratch(s)}/{name('beats')}", name("windows")
    beat = s.range(1).select(F.timestamp_seconds(F.lit(10**10)).alias("ts"), F.lit("beat").alias("event_type"))
    beat.limit(0).write.parquet(beats)
    for rows in (None, beat):
        if rows:
            rows.write.mode("append").parquet(beats)
        events = events_stream(s, d).select("ts", "event_type").unionByName(s.readStream.schema(beat.schema).parquet(beats))
        r = live.drain(live.alert_windows(events, "1 hour", "1 hour"), run)
    return r.select(F.unix_seconds("start").alias("start_s"), "event_type", "n")


def stream_repeats(s, d):
    e = events_stream(s, d)
    twice = e.unionByName(e)
    seen = twice.select(F.col("user_id").alias("run_id"), "ts", F.col("event_id").alias("frame_idx"), F.col("event_type").alias("cls"), *[F.lit(1.0).alias(c) for c in XYXY])
    return live.drain(live.without_repeats(seen, "1 hour"), name("repeats")).select("run_id", "frame_idx", "cls")


def stream_tracks(s, d):
    """Tracks of the detections when they come as a stream of files."""
    sent = f"{live.scratch(s)}/{name('sent')}"
    core.seen(s, d).select("run_id", "cls", "frame_idx", "det_seq", *[F.col(f"box.{c}").alias(c) for c in XYXY]).write.parquet(sent)
    stream = s.readStream.schema(s.read.parquet(sent).schema).parquet(sent)
    live.keep_state_in_rocksdb(s)
    return live.drain(live.live_tracks(stream), name("tracks"))


def stream_alerts(s, d):
    """The latest six alerts of each run when findings come as a stream."""
    live.keep_state_in_rocksdb(s)
    events = live.event_payload(as_findings(events_stream(s, d)), view(s, d, "fx_taxonomy"))
    return live.last_turns(live.drain(live.latest_alerts(events), name("alerts"))).select("run_id", "t_sec")


K2_SQL = """SELECT run_id, t_sec FROM (SELECT user_id AS run_id, event_id::DOUBLE AS t_sec, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events WHERE event_type IN ('error', 'signup')) WHERE r <= 6"""


QUERIES = {
    "k2_latest_alerts": (stream_alerts, K2_SQL),
    "k4_live_tracks": (stream_tracks, None),
    "c15_coerce_box": (coerced, C15_SQL),
    "c18_severity_and_crop": (severities, C18_SQL),
    "c30_depth_points": (depth_points, C30_SQL),
    "c31_georeference": (placed_cloud, C31_SQL),
    "c34_validation": (violations, C34_SQL),
    "c35_tiles": (tile_grid, C35_SQL),
    "d9_carriageway_gate": (gated, D9_SQL),
    "d10_point_in_mask": (on_mask, D10_SQL),
    "d11_match_findings": (matched, None),
    "d12_match_without_ceiling": (matched_any, None),
    "d13_truth_by_time": (truth_by_time, "SELECT f.run_id, f.frame_idx, t.finding_id FROM fx_frames f JOIN fx_findings t ON f.run_id = t.run_id AND f.t_sec = t.t_sec"),
    "d14_box_track": (tracked_boxes, D14_SQL),
    "d17_cache_misses": (cache_misses, D17_SQL),
    "d20_gap_of_absence": (absence_gap, D20_SQL),
    "d21_segment_worst": (segment_worst, D21_SQL),
    "e8_route_boxes": (run_boxes, f"WITH {BOXES_SQL} SELECT run_id, round(south, 9) AS south, round(west, 9) AS west, round(north, 9) AS north, round(east, 9) AS east FROM bx"),
    "e9_depth_scale": (depth_fit, E9_SQL),
    "e10_horizon_fit": (horizons, E10_SQL),
    "e12_calibration_fit": (calibration, E12_SQL),
    "e12_best_calibration": (best_row, None),
    "e13_similarity_fit": (similarity, E13_SQL),
    "e14_voxel_cells": (voxels, E14_SQL),
    "e14_voxel_budget": (thinned, E14_BUDGET_SQL),
    "e15_width_summary": (width_totals, E15_SQL),
    "e16_road_coverage": (road_share, "SELECT frame, round(sum(b1 - a1 + 1 + b2 - a2 + 1) / (1280 * 720), 9) AS coverage FROM fx_masks GROUP BY frame"),
    "e17_match_quality": (quality, None),
    "e18_average_precision": (precision_of_boxes, None),
    "e19_confusion": (confused, None),
    "e20_verdict_stats": (verdict_stats, "SELECT run_id, count(*) FILTER (det_seq % 5 = 1) AS confirmed, count(*) FILTER (det_seq % 5 = 0) AS rejected, count(*) FILTER (det_seq % 5 > 1) AS unsure FROM fx_findings GROUP BY run_id"),
    "e21_import_counters": (counters, E21_SQL),
    "f7_temporal_majority": (majority, F7_SQL),
    "f8_running_counts": (running, F8_SQL),
    "f9_row_spans": (spans, F9_SQL),
    "g1_worst_findings": (worst, "SELECT run_id, rank, finding_id FROM (SELECT *, (row_number() OVER (PARTITION BY run_id ORDER BY severity DESC, confidence DESC, finding_id))::INT AS rank FROM fx_findings) WHERE rank <= 5"),
    "g2_tour_stops": (tour, G2_SQL),
    "g4_class_counts": (by_class, "SELECT n.run_id, n.cls, n, worst, label, (row_number() OVER (PARTITION BY run_id ORDER BY n DESC, n.cls))::INT AS rank FROM (SELECT run_id, cls, count(*) AS n, max(severity) AS worst FROM fx_findings GROUP BY ALL) n JOIN fx_taxonomy t ON n.cls = t.cls"),
    "g7_suppress": (suppressed, None),
    "g8_drop_repeats": (repeats, G8_SQL),
    "g11_largest_component": (component, None),
    "h4_unmatched_objects": (unmatched, None),
    "i9_ensemble_merge": (ensemble, None),
    "i10_decode_anchors": (anchors, None),
    "i11_parse_replies": (replies, I11_SQL),
    "i12_verify": (verified, I12_SQL),
    "i13_import_csv": (imported, I13_SQL),
    "i14_export_csv": (exported, None),
    "i15_preflight": (checks, I15_SQL),
    "i18_carriageway_width": (widths, I18_SQL),
    "i23_surroundings": (twin, None),
    "i24_tile_cover": (tiles_of_runs, I24_SQL),
    "i26_prompt_scores": (crops, I26_SQL),
    "j_texts": (texts, J_SQL),
    "b6_placemarks": (marks_text, B6_SQL),
    "k1_replay": (replay, K1_SQL),
    "k5_stream_repeats": (stream_repeats, "SELECT user_id AS run_id, event_id AS frame_idx, event_type AS cls FROM events"),
    "k_alert_windows": (window_counts, "SELECT epoch(date_trunc('hour', ts))::BIGINT AS start_s, event_type, count(*) AS n FROM events GROUP BY ALL"),
}
QUERIES = {k: (f, sql and (oracle(sql) if "fx_" in sql else sql)) for k, (f, sql) in QUERIES.items()}
