import json

from pyspark.sql import functions as F

from wayside.sources import readers, sinks

GPX = """<?xml version="1.0"?><gpx><trk><trkseg>{}</trkseg></trk></gpx>"""


def write(path, body, mode="w"):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(body) if mode == "w" else path.write_bytes(body)
    return str(path)


def test_gpx(spark, tmp_path):
    stamped = "".join(f'<trkpt lat="{12.97 + i * 1e-4:.4f}" lon="77.59"><time>2024-01-01T00:00:0{i}.5Z</time></trkpt>' for i in range(3))
    write(tmp_path / "g" / "a" / "track.gpx", GPX.format(stamped + '<trkpt lat="1.0" lon="2.0"></trkpt>'))
    write(tmp_path / "g" / "b" / "track.gpx", GPX.format('<trkpt lat="1.0" lon="2.0"></trkpt><trkpt lat="1.5" lon="2.5"></trkpt>'))
    got = {}
    for r in readers.read_gpx(spark, str(tmp_path / "g" / "*" / "*.gpx")).orderBy("run_id", "seq").collect():
        got.setdefault(r.run_id, []).append((r.lat, r.lon, r.t))
    assert got == {"a": [(12.97, 77.59, 0.0), (12.9701, 77.59, 1.0), (12.9702, 77.59, 2.0)], "b": [(1.0, 2.0, 0.0), (1.5, 2.5, 1.0)]}


def test_csv_with_mark_and_extra_columns(spark, tmp_path):
    body = "﻿object_id,time,defect_name,note\no1,0:01,Pothole,x\no2,0:02,Crack,y\n".encode()
    path = write(tmp_path / "run1" / "findings.csv", body, "b")
    rows = readers.read_findings_csv(spark, path).orderBy("row_no").collect()
    assert [(r.run_id, r.object_id, r.row_no) for r in rows] == [("run1", "o1", 1), ("run1", "o2", 2)]


def test_json_scans(spark, tmp_path):
    frames = [{"frame_id": f"0000{i}", "t_sec": float(i), "lat": 1.0, "lon": 2.0, "heading_deg": 0.0, "width": 10, "height": 10} for i in (1, 0)]
    write(tmp_path / "r" / "frames.json", json.dumps(frames))
    write(tmp_path / "r" / "detections.ndjson", '{"frame_id": "00001", "cls": "a", "box": [1, 2, 3, 4]}\n\n{"frame_id": "00000", "cls": "b"}\n')
    write(tmp_path / "m" / "x" / "manifest.json", '{"domain": "road", "created": "2024-01-02T00:00:00Z"}')
    write(tmp_path / "m" / "y" / "manifest.json", "{broken")
    assert [(r.frame_idx, r.frame_id) for r in readers.read_frames(spark, str(tmp_path / "r" / "frames.json")).orderBy("frame_idx").collect()] == [(0, "00000"), (1, "00001")]
    assert [r.cls for r in readers.read_detections(spark, str(tmp_path / "r" / "detections.ndjson")).orderBy("det_seq").collect()] == ["a", "b"]
    assert [r.run_id for r in readers.read_runs(spark, str(tmp_path / "m" / "*" / "manifest.json")).collect()] == ["x"]


def test_parsers(spark):
    lines = spark.createDataFrame([(1, "0.5, 0.1 N/A"), (1, "0.3")], "run_id long, value string")
    assert [r.t_sec for r in readers.parse_frame_times(lines).orderBy("frame_idx").collect()] == [0.1, 0.3, 0.5]
    rates = spark.createDataFrame([("30000/1001", 29.97), ("25", 25.0), ("x", 0.0), ("1/0", 0.0)], "r string, want double")
    assert all(abs(r[0] - r[1]) < 0.01 for r in rates.select(readers.parse_fps(F.col("r")), "want").collect())
    calib = spark.createDataFrame([("c", "S_rect: 1242 375"), ("c", "P_rect: 721.5 0 609.5 0 0 721.5 172.8 0")], "name string, value string")
    c = readers.parse_intrinsics(calib).first()
    assert abs(c.vfov_deg - 29.13) < 0.05 and abs(c.hfov_deg - 81.43) < 0.05 and abs(c.pitch_offset_frac + 0.0392) < 0.001
    points = spark.createDataFrame([(1, 0, 0.0, 0.0), (1, 1, 2.0, 2.0)], "run_id long, seq int, lat double, lon double")
    d = spark.createDataFrame([(1, 10.0)], "run_id long, duration_s double")
    assert [r.t for r in readers.spread_waypoints(points, d).orderBy("seq").collect()] == [0.0, 10.0]
    truth = spark.createDataFrame([(1, {"0.50": [("a", [0.0, 0.0, 10.0, 10.0]), ("b", [0.0, 0.0, 1280.0, 10.0])]})], "run_id long, truth map<string,array<struct<cls:string,box:array<double>>>>")
    good, bad = readers.explode_truth(truth)
    assert [r.cls for r in good.collect()] == ["a"] and [r.cls for r in bad.collect()] == ["b"]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, 2, "b"), (1, 1, "a"), (2, 1, "c")], "run_id long, seq long, cls string")
    got = {r.run_id: r.json for r in sinks.as_json(df, ["seq"]).collect()}
    assert json.loads(got[1]) == [{"seq": 1, "cls": "a"}, {"seq": 2, "cls": "b"}]
    path = str(tmp_path / "t")
    sinks.write_table(df, path)
    sinks.write_table(df.filter("run_id = 2").withColumn("cls", F.lit("new")), path)
    assert sorted((r.run_id, r.cls) for r in spark.read.parquet(path).collect()) == [(1, "a"), (1, "b"), (2, "new")]
    sinks.write_detections(df, str(tmp_path / "d"))
    sinks.write_detections(df, str(tmp_path / "d"))
    assert spark.read.json(str(tmp_path / "d")).count() == 6
    track = spark.createDataFrame([(1, 0, 1.5, 2.5, "2024-01-01 00:00:00")], "run_id long, seq int, lat double, lon double, ts string").withColumn("ts", F.to_timestamp("ts"))
    sinks.write_gpx(track, str(tmp_path / "g"))
    back = spark.read.format("xml").option("rowTag", "trkpt").load(str(tmp_path / "g")).first()
    assert back["_lat"] == 1.5 and str(back["time"]).startswith("2024-01-01")
