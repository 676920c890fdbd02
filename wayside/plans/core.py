"""Queries over runs derived from the driver's tables: geometry, time, route, tracks, absences, score.

Each is (function of spark and folder, SQL that DuckDB must agree with, or None).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayside.fixtures import oracle, view
from wayside.functions import boxes, geo
from wayside.operators import absence, findings, localize, route, score
from wayside.operators import chain as chain_

CAM = localize.DASHCAM


# SQL fragments for the oracles, written from the formulas and not from the operators.
def hav(a, b, c, d):
    h = f"(pow(sin(radians(({c}) - ({a})) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin(radians(({d}) - ({b})) / 2), 2))"
    return f"(2 * 6371000.0e0 * asin(sqrt({h})))"


def bearing(a, b, c, d):
    y = f"sin(radians(({d}) - ({b}))) * cos(radians({c}))"
    x = f"cos(radians({a})) * sin(radians({c})) - sin(radians({a})) * cos(radians({c})) * cos(radians(({d}) - ({b})))"
    return f"fmod(degrees(atan2({y}, {x})) + 360.0e0, 360.0e0)"


def sql_iou(a, b):
    w = f"greatest(0.0e0, least({a}.x2, {b}.x2) - greatest({a}.x1, {b}.x1))"
    h = f"greatest(0.0e0, least({a}.y2, {b}.y2) - greatest({a}.y1, {b}.y1))"
    size = lambda r: f"(({r}.x2 - {r}.x1) * ({r}.y2 - {r}.y1))"
    return f"({w} * {h} / ({size(a)} + {size(b)} - {w} * {h}))"


CUM = """cum AS (SELECT run_id, frame_idx, frame_id, t_sec, lat, lon,
  sum(coalesce(step, 0)) OVER (PARTITION BY run_id ORDER BY frame_idx) AS cum_m FROM (
  SELECT *, """ + hav("lag(lat) OVER w", "lag(lon) OVER w", "lat", "lon") + """ AS step FROM fx_frames
  WINDOW w AS (PARTITION BY run_id ORDER BY frame_idx)))"""
#: Cuts of segments by a fold over frames: ``done`` is the path since the last cut.
CUTS = """steps AS (SELECT run_id, frame_idx, cum_m - lag(cum_m, 1, 0) OVER (PARTITION BY run_id ORDER BY frame_idx) AS step FROM cum),
fold AS (
  SELECT run_id, frame_idx, true AS is_cut, 0.0e0 AS done FROM steps WHERE frame_idx = 0
  UNION ALL
  SELECT s.run_id, s.frame_idx, f.done + s.step >= 20, CASE WHEN f.done + s.step >= 20 THEN 0 ELSE f.done + s.step END
  FROM fold f JOIN steps s ON s.run_id = f.run_id AND s.frame_idx = f.frame_idx + 1),
cuts AS (SELECT run_id, frame_idx FROM fold f WHERE is_cut OR frame_idx = (SELECT max(frame_idx) FROM fold g WHERE g.run_id = f.run_id))"""
LOCALIZED = """placed AS (SELECT d.*, f.lat AS f_lat, f.lon AS f_lon, f.heading_deg, f.t_sec,
  (d.x1 + d.x2) / 2 / 1000 * 1280 AS u, CASE WHEN t.geometry = 'point' THEN d.y2 ELSE (d.y1 + d.y2) / 2 END / 1000 * 720 AS v,
  360 / tan(radians(29.0e0)) AS foc, CASE WHEN t.geometry = 'point' THEN 'bottom' ELSE 'centre' END AS anchor
  FROM fx_detections d LEFT JOIN fx_frames f ON d.run_id = f.run_id AND d.frame_id = f.frame_id LEFT JOIN fx_taxonomy t ON d.cls = t.cls),
ranged AS (SELECT *, CASE WHEN v - 360 > 1e-6 AND 1.35e0 / tan(atan2(v - 360, foc)) <= 60 THEN 1.35e0 / tan(atan2(v - 360, foc)) END AS fwd FROM placed),
located AS (SELECT *, (u - 640) * fwd / foc AS side FROM ranged),
localized AS (SELECT *, CASE WHEN fwd IS NULL THEN f_lat ELSE f_lat + (-side * sin(radians(heading_deg)) + fwd * cos(radians(heading_deg))) / 111320 END AS lat,
  CASE WHEN fwd IS NULL THEN f_lon ELSE f_lon + (side * cos(radians(heading_deg)) + fwd * sin(radians(heading_deg))) / (111320 * cos(radians(f_lat))) END AS lon,
  fwd AS raw_range FROM located)"""


def frames(s, d) -> DataFrame:
    return view(s, d, "fx_frames")


def detections(s, d) -> DataFrame:
    df = view(s, d, "fx_detections")
    return df.withColumn("box", boxes.make_box(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"))).drop("x1", "y1", "x2", "y2", "frame_idx")


def localized(s, d) -> DataFrame:
    return localize.localize(detections(s, d), frames(s, d), view(s, d, "fx_taxonomy"), CAM)


def seen(s, d) -> DataFrame:
    return localized(s, d).join(frames(s, d).select("run_id", "frame_id", "frame_idx", "t_sec"), ["run_id", "frame_id"])


def geo_functions(s, d):
    lat, lon = F.col("lat"), F.col("lon")
    a, b = F.lit(12.98), F.lit(77.6)
    return frames(s, d).select(
        "run_id", "frame_idx", F.round(geo.m_per_deg_lon(lat), 6).alias("m_per_deg"), F.round(geo.haversine_m(lat, lon, a, b), 6).alias("far_m"),
        F.round(geo.bearing_deg(lat, lon, a, b), 6).alias("bearing"), F.round(geo.local_east(lon, a, b), 6).alias("east"),
        F.round(geo.local_north(lat, a), 6).alias("north"), F.round(geo.tile_x(lon, F.lit(16)), 6).alias("tx"), F.round(geo.tile_y(lat, F.lit(16)), 6).alias("ty"),
        F.round(geo.tile_lat(F.floor(geo.tile_y(lat, F.lit(16))), F.lit(16)), 8).alias("top_lat"), F.round(geo.angle_between(F.col("frame_idx") * 37.0, F.lit(350.0)), 6).alias("turn"),
        F.round(geo.offset_lat(lat, F.lit(7.5)), 9).alias("up"), F.round(geo.offset_lon(lat, lon, F.lit(7.5)), 9).alias("right"),
        F.round(geo.ray_forward_m(lat, lon, F.lit(30.0), a, b), 6).alias("ahead_m"),
    )


GEO_SQL = f"""SELECT run_id, frame_idx, round(111320 * cos(radians(lat)), 6) AS m_per_deg, round({hav('lat', 'lon', '12.98e0', '77.6e0')}, 6) AS far_m,
 round({bearing('lat', 'lon', '12.98e0', '77.6e0')}, 6) AS bearing, round((lon - 77.6e0) * 111320 * cos(radians(12.98e0)), 6) AS east,
 round((lat - 12.98e0) * 111320, 6) AS north, round((lon + 180) / 360 * 65536, 6) AS tx, round((1 - asinh(tan(radians(lat))) / pi()) / 2 * 65536, 6) AS ty,
 round(degrees(atan(sinh(pi() * (1 - 2 * floor((1 - asinh(tan(radians(lat))) / pi()) / 2 * 65536) / 65536)))), 8) AS top_lat,
 abs(fmod(fmod(frame_idx * 37.0e0 - 350 + 180, 360) + 360, 360) - 180) AS turn, round(lat + 7.5e0 / 111320, 9) AS up,
 round(lon + 7.5e0 / (111320 * cos(radians(lat))), 9) AS right,
 round((77.6e0 - lon) * 111320 * cos(radians(lat)) * sin(radians(30.0e0)) + (12.98e0 - lat) * 111320 * cos(radians(30.0e0)), 6) AS ahead_m FROM fx_frames"""


def localize_query(s, d):
    r = localized(s, d)
    return r.select("run_id", "det_seq", F.round("lat", 10).alias("lat"), F.round("lon", 10).alias("lon"), F.col("range_m").isNotNull().alias("ranged"), "anchor")


def links(s, d):
    return findings.link_candidates(seen(s, d)).select("run_id", "cls", "from_seq", "to_seq", F.round("score", 9).alias("score"))


LINKS_SQL = f"""WITH pairs AS (SELECT a.run_id, a.cls, a.det_seq AS from_seq, b.det_seq AS to_seq, {sql_iou('a', 'b')} AS ov,
  abs((b.x1 + b.x2) / 2 - (a.x1 + a.x2) / 2) / greatest(a.x2 - a.x1, 40) AS dx, (b.y1 + b.y2) / 2 - (a.y1 + a.y2) / 2 AS down
  FROM fx_detections a JOIN fx_detections b ON a.run_id = b.run_id AND a.cls = b.cls AND b.frame_idx - a.frame_idx IN (1, 2))
SELECT run_id, cls, from_seq, to_seq, round(ov + greatest(0.0e0, 1 - dx / 2.5e0), 9) AS score FROM pairs
WHERE down >= -60 AND dx <= 2.5e0 AND NOT (ov < 0.1e0 AND dx > 1) AND ov + greatest(0.0e0, 1 - dx / 2.5e0) > 0"""

ASOF = """lt AS (SELECT *, lead(t) OVER w AS t2, lead(lat) OVER w AS lat2, lead(lon) OVER w AS lon2 FROM fx_track WINDOW w AS (PARTITION BY run_id ORDER BY t)),
firsts AS (SELECT run_id, arg_min(lat, t) AS lat0, arg_min(lon, t) AS lon0 FROM fx_track GROUP BY run_id),
held AS (SELECT q.run_id, q.j, q.t, p.t AS t1, p.seq, p.lat AS lat1, p.lon AS lon1, t2, lat2, lon2 FROM fx_query_times q ASOF LEFT JOIN lt p ON q.run_id = p.run_id AND q.t >= p.t)"""
D1_SQL = f"""WITH {ASOF} SELECT h.run_id, j,
  round(CASE WHEN t1 IS NULL THEN lat0 WHEN t2 IS NULL THEN lat1 ELSE lat1 + (lat2 - lat1) * ((t - t1) / (t2 - t1)) END, 10) AS lat,
  round(CASE WHEN t1 IS NULL THEN lon0 WHEN t2 IS NULL THEN lon1 ELSE lon1 + (lon2 - lon1) * ((t - t1) / (t2 - t1)) END, 10) AS lon
FROM held h JOIN firsts f ON h.run_id = f.run_id"""


def asof_position(s, d):
    r = route.interpolate(view(s, d, "fx_query_times"), view(s, d, "fx_track"))
    return r.select("run_id", "j", F.round("lat", 10).alias("lat"), F.round("lon", 10).alias("lon"))


def nearest_time(s, d):
    r = route.nearest_in_time(view(s, d, "fx_query_times"), view(s, d, "fx_track"), ["seq"])
    return r.select("run_id", "j", F.col("near.seq").alias("seq"))


D3_SQL = """SELECT q.run_id, q.j, arg_min(p.seq, struct_pack(d := abs(p.t - q.t), s := p.seq)) AS seq
FROM fx_query_times q JOIN fx_track p ON q.run_id = p.run_id GROUP BY q.run_id, q.j"""


def pose(s, d):
    r = route.pose_at(view(s, d, "fx_query_times"), frames(s, d))
    return r.select("run_id", "j", "frame_idx", F.round("lat", 10).alias("lat"), F.round("lon", 10).alias("lon"), "heading_deg")


D2_SQL = """WITH lf AS (SELECT *, lead(t_sec) OVER w AS t2, lead(lat) OVER w AS lat2, lead(lon) OVER w AS lon2 FROM fx_frames WINDOW w AS (PARTITION BY run_id ORDER BY frame_idx))
SELECT q.run_id, q.j, coalesce(p.frame_idx, z.frame_idx) AS frame_idx,
  round(CASE WHEN p.t_sec IS NULL THEN z.lat WHEN p.t2 IS NULL THEN p.lat ELSE p.lat + (p.lat2 - p.lat) * (q.t - p.t_sec) / (p.t2 - p.t_sec) END, 10) AS lat,
  round(CASE WHEN p.t_sec IS NULL THEN z.lon WHEN p.t2 IS NULL THEN p.lon ELSE p.lon + (p.lon2 - p.lon) * (q.t - p.t_sec) / (p.t2 - p.t_sec) END, 10) AS lon, 90.0e0 AS heading_deg
FROM fx_query_times q ASOF LEFT JOIN lf p ON q.run_id = p.run_id AND q.t >= p.t_sec JOIN fx_frames z ON z.run_id = q.run_id AND z.frame_idx = 0"""


def nearest_space(s, d):
    f = view(s, d, "fx_findings").select("run_id", "finding_id", "lat", "lon")
    return absence.nearest_frame(f, frames(s, d), ["finding_id"]).select("run_id", "finding_id", "frame_idx", F.round("distance_m", 6).alias("distance_m"))


D4_SQL = f"""SELECT a.run_id, a.finding_id, arg_min(f.frame_idx, struct_pack(d := {hav('f.lat', 'f.lon', 'a.lat', 'a.lon')}, i := f.frame_idx)) AS frame_idx,
 round(min({hav('f.lat', 'f.lon', 'a.lat', 'a.lon')}), 6) AS distance_m FROM fx_findings a JOIN fx_frames f ON a.run_id = f.run_id GROUP BY a.run_id, a.finding_id"""


def along_route(s, d):
    t = frames(s, d).select("run_id", F.col("frame_idx").alias("k"), (F.col("frame_idx") * 6.1 - 3).alias("target_m"))
    r = absence.at_distance(t, frames(s, d))
    return r.select("run_id", "k", F.round("lat", 10).alias("lat"), F.round("lon", 10).alias("lon"), "frame_idx")


D5_SQL = f"""WITH {CUM}, legs AS (SELECT *, lag(cum_m) OVER w AS c0, lag(lat) OVER w AS lat0, lag(lon) OVER w AS lon0, lag(frame_idx) OVER w AS f0,
  max(cum_m) OVER (PARTITION BY run_id) AS total FROM cum WINDOW w AS (PARTITION BY run_id ORDER BY frame_idx)),
t AS (SELECT run_id, frame_idx AS k, frame_idx * 6.1e0 - 3 AS x FROM fx_frames)
SELECT t.run_id, t.k, round(CASE WHEN x <= 0 OR x >= l.total THEN l.lat ELSE lat0 + (l.lat - lat0) * ((x - c0) / (cum_m - c0)) END, 10) AS lat,
  round(CASE WHEN x <= 0 OR x >= l.total THEN l.lon ELSE lon0 + (l.lon - lon0) * ((x - c0) / (cum_m - c0)) END, 10) AS lon,
  CASE WHEN x <= 0 OR x >= l.total THEN l.frame_idx WHEN (x - c0) / (cum_m - c0) < 0.5 THEN f0 ELSE l.frame_idx END AS frame_idx
FROM t JOIN legs l ON t.run_id = l.run_id AND CASE WHEN x <= 0 THEN l.frame_idx = 0 WHEN x >= l.total THEN l.cum_m = l.total ELSE c0 < x AND x <= cum_m END"""


def chain(s, d):
    return route.chainage(frames(s, d)).select("run_id", "frame_idx", F.round("cum_m", 6).alias("cum_m"))


def heading_query(s, d):
    return route.headings(frames(s, d), 2, 30.0, 4).select("run_id", "frame_idx", F.round("heading", 6).alias("heading"))


F3_SQL = f"""WITH n AS (SELECT run_id, count(*) AS n FROM fx_frames GROUP BY run_id),
tries AS (SELECT f.run_id, f.frame_idx, n, w, greatest(0, f.frame_idx - w) AS a, least(n - 1, f.frame_idx + w) AS b FROM fx_frames f JOIN n ON f.run_id = n.run_id, range(2, 100) r(w) WHERE w <= greatest(n, 2)),
ends AS (SELECT t.*, {hav('p.lat', 'p.lon', 'q.lat', 'q.lon')} AS far, {bearing('p.lat', 'p.lon', 'q.lat', 'q.lon')} AS brg FROM tries t
  JOIN fx_frames p ON p.run_id = t.run_id AND p.frame_idx = t.a JOIN fx_frames q ON q.run_id = t.run_id AND q.frame_idx = t.b)
SELECT run_id, frame_idx, round(CASE WHEN any_value(n) < 2 THEN 0 ELSE arg_min(brg, w) FILTER (far >= 30 OR (a = 0 AND b = n - 1)) END, 6) AS heading FROM ends GROUP BY run_id, frame_idx"""


def spacing(s, d):
    return route.sample_by_spacing(frames(s, d), 8.0).select("run_id", "frame_idx", F.round("moved_m", 6).alias("moved_m"))


F4_SQL = f"""WITH RECURSIVE fold AS (
  SELECT run_id, frame_idx, lat, lon, true AS kept, NULL::DOUBLE AS moved FROM fx_frames WHERE frame_idx = 0
  UNION ALL SELECT run_id, frame_idx, CASE WHEN m >= 8 THEN nlat ELSE lat END, CASE WHEN m >= 8 THEN nlon ELSE lon END, m >= 8, CASE WHEN m >= 8 THEN m END
  FROM (SELECT f.run_id, n.frame_idx, f.lat, f.lon, n.lat AS nlat, n.lon AS nlon, {hav('f.lat', 'f.lon', 'n.lat', 'n.lon')} AS m
        FROM fold f JOIN fx_frames n ON n.run_id = f.run_id AND n.frame_idx = f.frame_idx + 1))
SELECT run_id, frame_idx, round(moved, 6) AS moved_m FROM fold f WHERE kept OR frame_idx = (SELECT max(frame_idx) FROM fx_frames g WHERE g.run_id = f.run_id)"""


def spacing_summary(s, d):
    r = route.spacing_stats(route.sample_by_spacing(frames(s, d), 8.0), frames(s, d), 8.0)
    return r.select("run_id", "kept", "source_frames", F.round("achieved_median_m", 6).alias("achieved_median_m"), "source_limited")


E24_SQL = F4_SQL.replace("SELECT run_id, frame_idx, round(moved, 6) AS moved_m FROM fold f WHERE", "SELECT run_id, count(*) AS kept, max(frame_idx) + 1 AS source_frames, round(list_sort(list(moved) FILTER (moved IS NOT NULL))[(count(moved) // 2) + 1], 6) AS achieved_median_m, coalesce(list_sort(list(moved) FILTER (moved IS NOT NULL))[(count(moved) // 2) + 1] > 12, false) AS source_limited FROM fold f WHERE") + " GROUP BY run_id"


def cuts(s, d):
    return route.segment_cuts(frames(s, d), 20.0)


def fixture_findings(s, d):
    return view(s, d, "fx_findings")


def segments(s, d):
    r = score.build_segments(frames(s, d), fixture_findings(s, d), view(s, d, "fx_taxonomy"))
    return r.select("run_id", "seg_id", "length_m", "quality_index", "color", F.size("finding_ids").cast("long").alias("n"), "t_start", "t_end", F.round(F.col("start.lat"), 9).alias("lat0"), F.array_join("finding_ids", ",").alias("ids"))


SEGS = f"""{CUM}, {CUTS},
pairs AS (SELECT c.run_id, row_number() OVER w - 1 AS seg_id, c.frame_idx AS a, lead(c.frame_idx) OVER w AS b, lead(c.frame_idx, 2) OVER w IS NULL AS open_end FROM cuts c WINDOW w AS (PARTITION BY c.run_id ORDER BY c.frame_idx)),
segs AS (SELECT p.run_id, p.seg_id, y.cum_m - x.cum_m AS len, x.t_sec AS t_start, y.t_sec AS t_end, x.lat AS lat0, open_end FROM pairs p JOIN cum x ON x.run_id = p.run_id AND x.frame_idx = p.a JOIN cum y ON y.run_id = p.run_id AND y.frame_idx = p.b),
pen AS (SELECT f.run_id, finding_id, t_sec, CASE WHEN weight <= 0 THEN 0 ELSE weight * severity * greatest(0.35e0, confidence) END AS p FROM fx_findings f JOIN fx_taxonomy t ON f.cls = t.cls),
scored AS (SELECT s.run_id, s.seg_id, any_value(len) AS len, any_value(t_start) AS t_start, any_value(t_end) AS t_end, any_value(lat0) AS lat0, count(finding_id) AS n,
  coalesce(string_agg(finding_id, ',' ORDER BY finding_id), '') AS ids,
  greatest(5.0e0, least(100.0e0, 100 - coalesce(sum(p), 0) / greatest(any_value(len) / 20, 0.5e0) * 2.2e0)) AS idx
  FROM segs s LEFT JOIN pen f ON s.run_id = f.run_id AND f.t_sec >= s.t_start AND (f.t_sec < s.t_end OR open_end) GROUP BY s.run_id, s.seg_id)"""
COLOR_SQL = "CASE WHEN idx >= 92 THEN '#22c55e' WHEN idx >= 82 THEN '#84cc16' WHEN idx >= 70 THEN '#eab308' WHEN idx >= 55 THEN '#f59e0b' WHEN idx >= 40 THEN '#ea580c' WHEN idx >= 25 THEN '#dc2626' ELSE '#b91c1c' END"
I7_SQL = f"WITH RECURSIVE {SEGS} SELECT run_id, seg_id, round(len, 2) AS length_m, round(idx, 1) AS quality_index, {COLOR_SQL} AS color, n, t_start, t_end, round(lat0, 9) AS lat0, ids FROM scored"


def score_summary(s, d):
    f = fixture_findings(s, d)
    r = score.summarize(f, score.build_segments(frames(s, d), f, view(s, d, "fx_taxonomy")))
    flat = lambda m: F.array_join(F.transform(F.map_entries(m), lambda e: F.concat_ws("=", e["key"], e["value"])), ",")
    return r.select("run_id", "quality_index", "grade", flat("counts").alias("counts"), flat("severity_histogram").alias("severities"), "total_findings", F.round("raw_length_m", 3).alias("route_length_m"))


SUMMARY_SQL = f"""WITH RECURSIVE {SEGS},
tot AS (SELECT run_id, sum(round(len, 2)) AS l, sum(round(idx, 1) * round(len, 2)) / sum(round(len, 2)) AS q FROM scored GROUP BY run_id),
cc AS (SELECT run_id, string_agg(cls || '=' || n, ',' ORDER BY cls) AS counts, sum(n)::BIGINT AS total_findings FROM (SELECT run_id, cls, count(*) AS n FROM fx_findings GROUP BY ALL) GROUP BY run_id),
ss AS (SELECT run_id, string_agg(severity || '=' || n, ',' ORDER BY severity) AS severities FROM (SELECT run_id, severity, count(*) AS n FROM fx_findings GROUP BY ALL) GROUP BY run_id)
SELECT tot.run_id, round(q, 1) AS quality_index, CASE WHEN q >= 90 THEN 'A' WHEN q >= 75 THEN 'B' WHEN q >= 60 THEN 'C' WHEN q >= 45 THEN 'D' WHEN q >= 30 THEN 'E' ELSE 'F' END AS grade,
 counts, severities, total_findings, round(l, 3) AS route_length_m FROM tot JOIN cc ON tot.run_id = cc.run_id JOIN ss ON tot.run_id = ss.run_id"""


def length(s, d):
    return route.route_length(frames(s, d)).select("run_id", F.round("length_m", 6).alias("length_m"))


def gaps_of(s, d):
    return absence.absence_gaps(frames(s, d), fixture_findings(s, d), view(s, d, "fx_absence"))


GAPS = f"""{CUM}, ast AS (SELECT a.run_id, a.finding_id, arg_min(f.frame_idx, struct_pack(d := {hav('f.lat', 'f.lon', 'a.lat', 'a.lon')}, i := f.frame_idx)) AS fi
  FROM fx_findings a JOIN fx_frames f ON a.run_id = f.run_id WHERE a.cls = 'streetlight' GROUP BY a.run_id, a.finding_id),
tl AS (SELECT run_id, max(cum_m) AS total FROM cum GROUP BY run_id HAVING count(*) > 1),
marks AS (SELECT a.run_id, c.cum_m AS at_, 1 AS real_ FROM ast a JOIN cum c ON a.run_id = c.run_id AND a.fi = c.frame_idx UNION ALL SELECT run_id, 0, 0 FROM tl UNION ALL SELECT run_id, total, 0 FROM tl),
spans AS (SELECT run_id, lag(at_) OVER (PARTITION BY run_id ORDER BY at_, real_) AS s, at_ AS e, max(real_) OVER (PARTITION BY run_id) = 1 AS any_asset FROM marks),
gaps AS (SELECT * FROM spans WHERE e - s >= 40)"""


def gaps(s, d):
    return gaps_of(s, d).select("run_id", F.round("start_m", 6).alias("start_m"), F.round("end_m", 6).alias("end_m"), "any_asset")


def absences(s, d):
    r = absence.infer_absences(gaps_of(s, d), frames(s, d))
    return r.select("run_id", "finding_id", "cls", "severity", "confidence", "evidence_text")


I5_SQL = f"""WITH {GAPS} SELECT run_id, 'a-' || lpad((row_number() OVER (PARTITION BY run_id ORDER BY s) - 1)::VARCHAR, 4, '0') AS finding_id, 'streetlight_missing' AS cls, 3 AS severity,
 round(least(0.9e0, 0.45e0 + 0.15e0 * ((e - s) / 40 - 1)), 3) AS confidence,
 'No streetlight seen over ' || CASE WHEN any_asset THEN printf('%.0f m', e - s) ELSE 'the entire surveyed route' END || ' (threshold 40 m); inferred, not observed.' AS evidence_text FROM gaps"""


def coverage(s, d):
    g = absence.infer_absences(gaps_of(s, d), frames(s, d))
    return absence.coverage_report(frames(s, d), fixture_findings(s, d), g, view(s, d, "fx_absence"))


E7_SQL = f"""WITH {GAPS} SELECT tl.run_id, 'streetlight' AS asset, 'streetlight_missing' AS absence_key, 'Lighting Gap' AS absence_label,
 (SELECT count(*) FROM fx_findings f WHERE f.run_id = tl.run_id AND cls = 'streetlight') AS found, (SELECT count(*) FROM gaps g WHERE g.run_id = tl.run_id) AS gaps,
 round(total, 1) AS route_m, 40.0e0 AS min_gap_m, round((SELECT count(*) FROM fx_findings f WHERE f.run_id = tl.run_id AND cls = 'streetlight') / (total / 1000), 1) AS per_km FROM tl"""


def polyline(s, d):
    r = absence.gap_polyline(gaps_of(s, d), frames(s, d))
    return r.select("run_id", F.round("start_m", 6).alias("start_m"), "step", F.round("target_m", 6).alias("target_m"), F.round("lat", 9).alias("lat"))


F14_SQL = f"""WITH {GAPS}, pts AS (SELECT run_id, s, e, i AS step, s + (e - s) * i / 12 AS x FROM gaps, range(0, 13) r(i)),
legs AS (SELECT *, lag(cum_m) OVER w AS c0, lag(lat) OVER w AS lat0, max(cum_m) OVER (PARTITION BY run_id) AS total FROM cum WINDOW w AS (PARTITION BY run_id ORDER BY frame_idx))
SELECT p.run_id, round(s, 6) AS start_m, step::INT AS step, round(x, 6) AS target_m, round(CASE WHEN x <= 0 OR x >= total THEN l.lat ELSE lat0 + (l.lat - lat0) * ((x - c0) / (cum_m - c0)) END, 9) AS lat
FROM pts p JOIN legs l ON p.run_id = l.run_id AND CASE WHEN x <= 0 THEN l.frame_idx = 0 WHEN x >= total THEN l.cum_m = total ELSE c0 < x AND x <= cum_m END"""


def rays(s, d):
    one = seen(s, d).groupBy("run_id", "cls", "frame_idx").agg(F.min_by("box", "det_seq").alias("box"))
    t = one.join(frames(s, d).select("run_id", "frame_idx", F.col("lat").alias("f_lat"), F.col("lon").alias("f_lon"), "heading_deg", "width", "height"), ["run_id", "frame_idx"])
    b = geo.bearing_to_box(F.col("box"), F.col("width"), F.col("height"), F.lit(58.0), F.col("heading_deg"))
    t = t.withColumn("g", F.floor(F.col("frame_idx") / 4)).select("run_id", "cls", "g", F.col("f_lat").alias("lat"), F.col("f_lon").alias("lon"), b.alias("bearing"))
    r = findings.triangulate(t, ["run_id", "cls", "g"])
    return r.select("run_id", "cls", "g", "n_rays", F.round("t_lat", 8).alias("t_lat"), F.round("t_lon", 8).alias("t_lon"), F.round("residual_m", 4).alias("residual_m"), F.round("parallax_deg", 6).alias("parallax_deg"))


E6_SQL = """WITH r AS (SELECT d.run_id, d.cls, d.frame_idx // 4 AS g, f.lat, f.lon, fmod(90 + degrees(atan2((d.x1 + d.x2) / 2000 * 1280 - 640, 360 / tan(radians(29.0e0)))) + 360, 360) AS brg
  FROM (SELECT run_id, cls, frame_idx, arg_min(x1, det_seq) AS x1, arg_min(x2, det_seq) AS x2 FROM fx_detections GROUP BY ALL) d JOIN fx_frames f ON d.run_id = f.run_id AND d.frame_idx = f.frame_idx),
c AS (SELECT *, avg(lat) OVER w AS lat0, avg(lon) OVER w AS lon0 FROM r WINDOW w AS (PARTITION BY run_id, cls, g)),
e AS (SELECT *, (lon - lon0) * 111320 * cos(radians(lat0)) AS e, (lat - lat0) * 111320 AS n, cos(radians(brg)) AS ne, -sin(radians(brg)) AS nn FROM c),
s AS (SELECT run_id, cls, g, count(*) AS n_rays, any_value(lat0) AS lat0, any_value(lon0) AS lon0, sum(ne * ne) AS aa, sum(ne * nn) AS ab, sum(nn * nn) AS bb, sum(ne * (ne * e + nn * n)) AS ac, sum(nn * (ne * e + nn * n)) AS bc FROM e GROUP BY run_id, cls, g),
x AS (SELECT *, (ac * bb - bc * ab) / (aa * bb - ab * ab) AS east, (bc * aa - ac * ab) / (aa * bb - ab * ab) AS north FROM s WHERE n_rays >= 2 AND abs(aa * bb - ab * ab) >= 1e-9),
p AS (SELECT x.*, lat0 + north / 111320 AS t_lat, lon0 + east / (111320 * cos(radians(lat0))) AS t_lon FROM x),
q AS (SELECT p.run_id, p.cls, p.g, sqrt(avg(pow(ne * (east - e) + nn * (north - n), 2))) AS res, min((t_lon - lon) * 111320 * cos(radians(lat)) * sin(radians(brg)) + (t_lat - lat) * 111320 * cos(radians(brg))) AS ahead,
  max(m.par) AS par
  FROM p JOIN e ON p.run_id = e.run_id AND p.cls = e.cls AND p.g = e.g
  JOIN (SELECT i.run_id, i.cls, i.g, max(abs(fmod(i.brg - o.brg + 540, 360) - 180)) AS par FROM e i JOIN e o ON o.run_id = i.run_id AND o.cls = i.cls AND o.g = i.g GROUP BY ALL) m ON m.run_id = p.run_id AND m.cls = p.cls AND m.g = p.g GROUP BY p.run_id, p.cls, p.g)
SELECT s.run_id, s.cls, s.g, s.n_rays, CASE WHEN ahead >= 0 THEN round(t_lat, 8) END AS t_lat, CASE WHEN ahead >= 0 THEN round(t_lon, 8) END AS t_lon,
 CASE WHEN ahead >= 0 THEN round(res, 4) END AS residual_m, CASE WHEN ahead >= 0 THEN round(par, 6) END AS parallax_deg
FROM s LEFT JOIN p ON s.run_id = p.run_id AND s.cls = p.cls AND s.g = p.g LEFT JOIN q ON s.run_id = q.run_id AND s.cls = q.cls AND s.g = q.g"""


def tracks(s, d):
    return findings.build_tracks(seen(s, d)).select("run_id", "det_seq", "track")


def clusters(s, d):
    r = findings.cluster_detections(localized(s, d), frames(s, d), view(s, d, "fx_taxonomy"), CAM)
    return r.select("run_id", "finding_id", "cls", F.round("lat", 9).alias("lat"), F.round("lon", 9).alias("lon"), "severity", "confidence", "t_sec", "n_evidence", "pos_method")


def evidence(s, d):
    r = findings.cluster_detections(localized(s, d), frames(s, d), view(s, d, "fx_taxonomy"))
    return findings.unnest_evidence(r).select("run_id", "finding_id", "cls", "position", "det_seq", "frame_id")


def ranges(s, d):
    r = localize.range_stats(localized(s, d))
    return r.select("run_id", "min_m", "median_m", "max_m", "ranged")


E22_SQL = f"""WITH {LOCALIZED} SELECT run_id, min(round(raw_range, 2)) AS min_m, list_sort(list(round(raw_range, 2)) FILTER (raw_range IS NOT NULL))[count(raw_range) // 2 + 1] AS median_m,
 max(round(raw_range, 2)) AS max_m, count(raw_range) AS ranged FROM localized GROUP BY run_id"""


def nth(s, d):
    return route.every_nth(frames(s, d), 30.0, 7.0).select("run_id", "frame_idx", "t_sec")


def vfr(s, d):
    t = view(s, d, "fx_track").select("run_id", F.col("seq").alias("frame_idx"), F.col("t").alias("t_sec"))
    return route.frame_gaps(t, 1.0)


def speed(s, d):
    return route.speeds(view(s, d, "fx_track")).select("run_id", "seq", F.round("speed_mps", 6).alias("speed_mps"))


F10_SQL = f"""WITH n AS (SELECT *, coalesce(lag(t) OVER w, t) AS ta, coalesce(lag(lat) OVER w, lat) AS la, coalesce(lag(lon) OVER w, lon) AS oa,
 coalesce(lead(t) OVER w, t) AS tb, coalesce(lead(lat) OVER w, lat) AS lb, coalesce(lead(lon) OVER w, lon) AS ob FROM fx_track WINDOW w AS (PARTITION BY run_id ORDER BY seq))
SELECT run_id, seq, CASE WHEN tb > ta THEN round({hav('la', 'oa', 'lb', 'ob')} / (tb - ta), 6) ELSE 0 END AS speed_mps FROM n"""


def built_frames(s, d):
    t = frames(s, d).select("run_id", "frame_idx", "t_sec", F.lit("2024-01-01 00:00:00").cast("timestamp").alias("start_ts"))
    r = route.build_frames(t, view(s, d, "fx_track"), 0.25)
    return r.select("run_id", "frame_idx", "frame_id", "t_sec", F.unix_micros("ts").alias("ts_us"), F.round("lat", 10).alias("lat"))


I1_SQL = f"""WITH q AS (SELECT run_id, frame_idx, frame_id, t_sec, t_sec + 0.25e0 AS t FROM fx_frames), {ASOF.split("held AS")[0].strip().rstrip(",")}
SELECT q.run_id, q.frame_idx, q.frame_id, q.t_sec, 1704067200000000 + (q.t * 1000000)::BIGINT AS ts_us,
 round(CASE WHEN p.t IS NULL THEN lat0 WHEN t2 IS NULL THEN p.lat ELSE p.lat + (lat2 - p.lat) * ((q.t - p.t) / (t2 - p.t)) END, 10) AS lat
FROM q ASOF LEFT JOIN lt p ON q.run_id = p.run_id AND q.t >= p.t JOIN firsts f ON f.run_id = q.run_id"""


def run_pipeline(s, d):
    """The whole chain for all runs at once: localize, link, merge, absences, score."""
    r = chain_.summarize_runs(detections(s, d), frames(s, d), view(s, d, "fx_taxonomy"), view(s, d, "fx_absence"), CAM)["summary"]
    return r.select("run_id", "quality_index", "grade", "total_findings", "route_length_m")


QUERIES = {
    "c1_geo_functions": (geo_functions, GEO_SQL),
    "i2_localize": (localize_query, f"WITH {LOCALIZED} SELECT run_id, det_seq, round(lat, 10) AS lat, round(lon, 10) AS lon, raw_range IS NOT NULL AS ranged, anchor FROM localized"),
    "e22_range_stats": (ranges, E22_SQL),
    "d1_asof_position": (asof_position, D1_SQL),
    "d2_asof_pose": (pose, D2_SQL),
    "d3_nearest_in_time": (nearest_time, D3_SQL),
    "d4_nearest_in_space": (nearest_space, D4_SQL),
    "d5_along_route": (along_route, D5_SQL),
    "d8_link_candidates": (links, LINKS_SQL),
    "e1_route_length": (length, f"WITH {CUM} SELECT run_id, round(max(cum_m), 6) AS length_m FROM cum GROUP BY run_id"),
    "e6_triangulate": (rays, E6_SQL),
    "e7_coverage": (coverage, E7_SQL),
    "e24_spacing_stats": (spacing_summary, E24_SQL),
    "f1_every_nth": (nth, "SELECT run_id, frame_idx, t_sec FROM fx_frames WHERE frame_idx % 4 = 0"),
    "f2_chainage": (chain, f"WITH {CUM} SELECT run_id, frame_idx, round(cum_m, 6) AS cum_m FROM cum"),
    "f3_heading": (heading_query, F3_SQL),
    "f4_spacing_sampler": (spacing, F4_SQL),
    "f5_segment_cuts": (cuts, f"WITH RECURSIVE {CUM}, {CUTS} SELECT run_id, frame_idx FROM cuts"),
    "f6_absence_gaps": (gaps, f"WITH {GAPS} SELECT run_id, round(s, 6) AS start_m, round(e, 6) AS end_m, any_asset FROM gaps"),
    "f10_speed": (speed, F10_SQL),
    "f11_frame_gaps": (vfr, "SELECT run_id, min(g) AS min_gap_s, max(g) AS max_gap_s, coalesce(max(g) - min(g) > 0.5, false) AS variable FROM (SELECT run_id, t - lag(t) OVER (PARTITION BY run_id ORDER BY seq) AS g FROM fx_track) GROUP BY run_id"),
    "f14_gap_polyline": (polyline, F14_SQL),
    "i1_build_frames": (built_frames, I1_SQL),
    "i3_tracks": (tracks, None),
    "i4_clusters": (clusters, None),
    "c36_unnest_evidence": (evidence, None),
    "i5_absences": (absences, I5_SQL),
    "i7_segments": (segments, I7_SQL),
    "i7_score_summary": (score_summary, SUMMARY_SQL),
    "i27_run_pipeline": (run_pipeline, None),
}
QUERIES = {k: (f, sql and oracle(sql)) for k, (f, sql) in QUERIES.items()}
