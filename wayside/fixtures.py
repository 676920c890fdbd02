"""Survey tables derived from the driver's tables, in SQL that Spark and DuckDB both read.

Only integer arithmetic and constants; ``e0`` keeps constants double in both.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("events", "lineitem", "embeddings", "part")

#: Definitions by name; each may use those above it.
VIEWS = {
    "fx_ordered": """
      SELECT event_id, user_id, event_type, ts,
             CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS BIGINT) AS k FROM events""",
    "fx_track": """
      SELECT user_id AS run_id, k AS seq, k * 1.0e0 + (event_id % 4) * 0.125e0 AS t,
             12.9716e0 + (user_id % 10) * 0.01e0 + k * 0.00001e0 + (event_id % 7) * 0.000002e0 AS lat,
             77.5946e0 + k * 0.00005e0 + (event_id % 5) * 0.000003e0 AS lon
      FROM fx_ordered""",
    "fx_query_times": """
      SELECT run_id, CAST(2 * seq + h AS BIGINT) AS j, (2 * seq + h) * 0.5e0 - 0.25e0 AS t
      FROM fx_track CROSS JOIN (SELECT 0 AS h UNION ALL SELECT 1 AS h) halves""",
    "fx_frames": """
      SELECT run_id, seq AS frame_idx, lpad(CAST(seq + 1 AS STRING), 5, '0') AS frame_id, seq * 1.0e0 AS t_sec,
             lat, lon, 90.0e0 AS heading_deg, 1280 AS width, 720 AS height
      FROM fx_track""",
    "fx_boxes": """
      SELECT user_id AS run_id, event_id AS det_seq, k - (k % 2) * (event_id % 2) AS frame_idx,
             CASE event_type WHEN 'error' THEN 'pothole' WHEN 'click' THEN 'crack' WHEN 'view' THEN 'streetlight'
                  WHEN 'signup' THEN 'waterlogging' ELSE 'garbage' END AS cls,
             CAST(100 + (event_id * 37) % 700 AS DOUBLE) AS x1, CAST(450 + (event_id * 53) % 350 AS DOUBLE) AS y1,
             CAST(100 + (event_id * 37) % 700 + 60 + event_id % 90 AS DOUBLE) AS x2,
             CAST(450 + (event_id * 53) % 350 + 40 + event_id % 60 AS DOUBLE) AS y2,
             CAST(1 + event_id % 5 AS INT) AS severity, (30 + (event_id * 13) % 70) / 100.0e0 AS confidence
      FROM fx_ordered""",
    "fx_detections": """
      SELECT b.*, lpad(CAST(frame_idx + 1 AS STRING), 5, '0') AS frame_id FROM fx_boxes b""",
    "fx_findings": """
      SELECT d.run_id, concat('f-', CAST(d.det_seq AS STRING)) AS finding_id, d.det_seq, d.cls, d.severity, d.confidence,
             f.t_sec, f.lat + (d.det_seq % 9) * 0.00001e0 AS lat, f.lon AS lon, f.frame_id, f.frame_idx
      FROM fx_detections d JOIN fx_frames f ON d.run_id = f.run_id AND d.frame_idx = f.frame_idx""",
    "fx_objects": """
      SELECT run_id, det_seq AS object_id, cls, lat + (det_seq % 12) * 0.00001e0 AS lat, lon, severity
      FROM fx_findings WHERE det_seq % 3 = 0""",
    "fx_csv": """
      SELECT run_id, det_seq AS row_no,
             CASE WHEN det_seq % 23 = 0 THEN concat('o', CAST(det_seq - 1 AS STRING)) ELSE concat('o', CAST(det_seq AS STRING)) END AS object_id,
             CASE WHEN det_seq % 19 = 0 THEN 'x' WHEN det_seq % 2 = 0 THEN concat(CAST(CAST(floor(t_sec / 60) AS BIGINT) AS STRING), ':', lpad(CAST(CAST(t_sec AS BIGINT) % 60 AS STRING), 2, '0'))
                  ELSE CAST(CAST(t_sec AS BIGINT) AS STRING) END AS time,
             CASE WHEN det_seq % 5 = 0 THEN 'Surface Cracking' WHEN det_seq % 7 = 0 THEN 'Oil Spill' ELSE cls END AS defect_name,
             CASE WHEN det_seq % 17 = 0 THEN 'N/A' WHEN det_seq % 11 = 0 THEN '' ELSE CAST(CAST(det_seq % 90 AS BIGINT) AS STRING) END AS lat,
             CASE WHEN det_seq % 11 = 0 THEN '' ELSE CAST(CAST(det_seq % 170 AS BIGINT) AS STRING) END AS lon,
             CASE WHEN det_seq % 13 = 0 THEN '9' WHEN det_seq % 3 = 0 THEN '' ELSE concat(CAST(severity AS STRING), '.5') END AS severity,
             CASE WHEN det_seq % 13 = 1 THEN 'bogus' ELSE concat('0.', CAST(10 + det_seq % 80 AS STRING)) END AS confidence
      FROM fx_findings""",
    "fx_masks": """
      SELECT l_orderkey AS frame, l_linenumber AS row_no, min(l_partkey) % 500 AS a1, min(l_partkey) % 500 + CAST(min(l_quantity) AS BIGINT) AS b1,
             min(l_partkey) % 500 + CAST(min(l_quantity) AS BIGINT) + 3 + count(*) AS a2,
             min(l_partkey) % 500 + CAST(min(l_quantity) AS BIGINT) + 3 + count(*) + CAST(max(l_quantity) AS BIGINT) AS b2
      FROM lineitem GROUP BY l_orderkey, l_linenumber""",
    "fx_runs": """
      SELECT frame, row_no, a1 AS col_start, b1 AS col_end FROM fx_masks
      UNION ALL SELECT frame, row_no, a2 AS col_start, b2 AS col_end FROM fx_masks""",
    "fx_points": """
      SELECT l_orderkey * 8 + l_linenumber AS seq_major, l_partkey, l_suppkey, l_extendedprice, (l_partkey % 1000) * 0.25e0 AS x, l_suppkey * 0.5e0 AS y,
             l_quantity * 1.0e0 AS z, l_discount * 100.0e0 AS conf FROM lineitem""",
    "fx_taxonomy": """
      SELECT * FROM (VALUES (0, 'pothole', 'Pothole', 'point', 3.0e0, 3.0e0, true, '#dc2626'), (1, 'crack', 'Surface Cracking', 'point', 4.0e0, 1.5e0, false, '#f97316'),
        (2, 'waterlogging', 'Waterlogging', 'area', 6.0e0, 2.5e0, true, '#0ea5e9'), (3, 'streetlight', 'Streetlight', 'point', 6.0e0, 0.0e0, false, '#fde047'),
        (4, 'garbage', 'Garbage Accumulation', 'point', 5.0e0, 1.0e0, false, '#84cc16')) AS v(ord, cls, label, geometry, cluster_radius_m, weight, alert, color)""",
    "fx_classes": """
      SELECT p_brand AS domain, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY min(p_partkey)) - 1 AS BIGINT) AS ord, concat(lower(p_type), '_', CAST(p_size % 7 AS STRING)) AS cls,
             concat(p_type, ' ', CAST(min(p_size) AS STRING)) AS label, 'point' AS geometry, min(p_size) * 0.5e0 AS cluster_radius_m, (min(p_partkey) % 4) * 1.0e0 AS weight,
             min(p_partkey) % 3 = 0 AS alert, concat('#', lpad(CAST(min(p_partkey) % 900000 AS STRING), 6, '0')) AS color, min(p_name) AS hint
      FROM part GROUP BY p_brand, p_type, p_size % 7""",
    "fx_rules": """
      SELECT p_brand AS domain, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY min(p_partkey)) - 1 AS BIGINT) AS rule_ord, concat(lower(p_type), '_', CAST(p_size % 11 AS STRING)) AS absence_key,
             concat('No ', p_type) AS absence_label, max(p_size) * 1.0e0 AS min_gap_m, 1.5e0 AS weight, false AS alert, '#78716c' AS color, 'none seen' AS note
      FROM part WHERE p_partkey % 4 = 0 GROUP BY p_brand, p_type, p_size % 11""",
    "fx_named": """
      SELECT user_id AS run_id, concat('Brand#', CAST(1 + user_id % 27 AS STRING)) AS domain, event_id AS det_seq,
             concat(CASE event_type WHEN 'error' THEN 'economy' WHEN 'click' THEN 'small' WHEN 'view' THEN 'standard' ELSE 'promo' END, '_', CAST(event_id % 13 AS STRING)) AS cls,
             CAST(event_id % 8 AS INT) AS severity, (event_id % 15) * 0.1e0 AS confidence
      FROM events""",
    "fx_absence": """
      SELECT * FROM (VALUES (0, 'streetlight_missing', 'Lighting Gap', 'streetlight', 40.0e0, 3)) AS v(rule_ord, absence_key, absence_label, asset, min_gap_m, severity)""",
}


def ctes(*names: str) -> str:
    """``WITH`` text that defines these views and whatever they use."""
    wanted: set[str] = set()

    def want(name: str) -> None:
        for other in VIEWS:
            if other != name and re.search(rf"\b{other}\b", VIEWS[name]):
                want(other)
        wanted.add(name)

    for name in names:
        want(name)
    return "WITH " + ",\n".join(f"{n} AS ({VIEWS[n]})" for n in VIEWS if n in wanted)


def oracle(sql: str) -> str:
    """A complete statement from one that uses views by name."""
    names = [n for n in VIEWS if re.search(rf"\b{n}\b", sql)]
    head = ctes(*names)
    if re.match(r"\s*WITH RECURSIVE\b", sql):
        return head.replace("WITH ", "WITH RECURSIVE ", 1) + ",\n" + re.sub(r"^\s*WITH RECURSIVE\b", "", sql)
    return head + (",\n" + re.sub(r"^\s*WITH\b", "", sql) if re.match(r"\s*WITH\b", sql) else "\n" + sql)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the survey tables over the tables in ``sf_dir``."""
    text = ctes(name) + f"\nSELECT * FROM {name}"
    used = [t for t in TABLES if re.search(rf"\b{t}\b", text)]
    for t in used:
        text = re.sub(rf"\b(FROM|JOIN) {t}\b", rf"\1 {{{t}}}", text)
    return spark.sql(text, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in used})
