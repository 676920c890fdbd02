"""Live tracks, budgets of clouds, gates, checks, map documents, looks: against literal versions on small fixtures."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayside.functions import boxes
from wayside.operators import absence, checks, depth, evaluate, findings, mapdoc, motion, roadgate, route, tiles, voxel
from wayside.sources import mapdata
from wayside.streaming import live, tracks

SIGHTING = "run_id long, cls string, frame_idx long, det_seq long, x1 double, y1 double, x2 double, y2 double"


def test_closed_tracks_equal_those_of_the_table(spark, tmp_path):
    """Three micro-batches, rows out of order and late ones; then a sign of life that lets everything close."""
    live.keep_state_in_rocksdb(spark)
    rnd = random.Random(3)
    rows = [(run, cls, f, f * 10 + k, 100.0 + f * 3 + k * 300, 200.0 + f * 2, 180.0 + f * 3 + k * 300, 260.0 + f * 2)
            for run in (1, 2) for cls in ("a", "b") for f in range(1, 60) for k in range(2) if rnd.random() < 0.6]
    rows = [(*r[:3], i, *r[4:]) for i, r in enumerate(rows)]
    step = {r[3]: 1 if r[2] < 20 else 2 if r[2] < 40 else 3 for r in rows}
    step |= {r[3]: 2 for r in rows if 16 <= r[2] < 20 and r[3] % 3 == 0}  # out of order, within the delay
    late = {r[3] for r in rows if r[2] < 10 and r[3] % 7 == 0}
    step |= dict.fromkeys(late, 3)
    folder = str(tmp_path)
    for batch in (1, 2, 3, 4):
        own = [r for r in rows if step[r[3]] == batch]
        df = spark.createDataFrame(own, SIGHTING).withColumn("ts", F.timestamp_seconds("frame_idx"))
        beat = spark.createDataFrame([(None,) * 8], SIGHTING).withColumn("ts", F.timestamp_seconds(F.lit(5000)))
        (df if own else beat).write.mode("append").parquet(f"{folder}/in")
        stream = tracks.closed_tracks(spark.readStream.schema(beat.schema).parquet(f"{folder}/in"), "8 seconds", "5 seconds")
        query = tracks.split_late(stream, f"{folder}/out", f"{folder}/log")
        query.awaitTermination()
    assert sum(s["numRowsTotal"] for s in query.lastProgress["stateOperators"]) == 0
    out = tracks.read_split(spark, f"{folder}/out")
    assert {x for r in out.filter("late").collect() for x in r.det_seqs} == late
    got = {(r.track, tuple(sorted(r.det_seqs))) for r in out.filter("not late").collect()}
    timely = spark.createDataFrame([r for r in rows if r[3] not in late], SIGHTING).withColumn("box", boxes.make_box(*[F.col(c) for c in ("x1", "y1", "x2", "y2")]))
    linked = {}
    for r in findings.build_tracks(timely).collect():
        linked.setdefault(r.track, []).append(r.det_seq)
    assert got == {(t, tuple(sorted(s))) for t, s in linked.items()}
    assert len(got) > 20


def literal_size(p, budget):
    """The size that ``thin_to_budget`` describes, cell by cell."""
    side = (p.max(0) - p.min(0)).max()
    cells = np.minimum(np.floor((p - p.min(0)) / (side / 65536)), 65535).astype(np.int64)
    taken = lambda m: len(np.unique(cells // m, axis=0))
    level = next(k for k in range(17) if taken(1 << k) <= budget)
    if not level:
        return cells, 1
    low = 1 << (level - 1)
    return cells, next(m for m in (low + math.ceil(low * t / 32) for t in range(1, 33)) if taken(m) <= budget)


@pytest.mark.parametrize("kind", ["surface", "line", "volume"])
def test_budget_of_clouds(spark, kind):
    rnd = np.random.default_rng(4)
    p = rnd.random((4000, 3)) * {"surface": (50, 30, 0.0), "line": (80, 0.0, 0.0), "volume": (10, 10, 10)}[kind]
    few = rnd.random((40, 3))
    rows = [(run, i, *map(float, x), "kept") for run, own in ((1, p), (2, few), (3, np.ones((5, 3)))) for i, x in enumerate(own)]
    cloud = spark.createDataFrame(rows, "run_id long, seq long, x double, y double, z double, _size string").repartition(3)
    got = [r for r in voxel.thin_to_budget(cloud.withColumnRenamed("_size", "colour"), 600).collect()]
    assert {r.colour for r in got} == {"kept"}
    assert sorted(r.seq for r in got if r.run_id == 2) == list(range(40))
    assert len([r for r in got if r.run_id == 3]) == 5
    cells, m = literal_size(p, 600)
    first = {}
    for i, c in enumerate(map(tuple, cells // m)):
        first.setdefault(c, i)
    mine = sorted(r.seq for r in got if r.run_id == 1)
    assert mine == sorted(first.values())
    assert 0.85 * 600 <= len(mine) <= 600


def test_budget_of_an_empty_cloud_and_of_one_place(spark):
    kinds = "run_id long, seq long, x double, y double, z double"
    assert voxel.thin_to_budget(spark.createDataFrame([], kinds), 3).collect() == []
    one = spark.createDataFrame([(1, i, 2.0, 2.0, 2.0) for i in range(9)], kinds)
    assert [r.seq for r in voxel.thin_to_budget(one, 3).collect()] == [0]
    with pytest.raises(ValueError, match="run_id"):
        voxel.thin_to_budget(one.drop("run_id"), 3)


def test_interleaved_bits(spark):
    rnd = random.Random(1)
    rows = [tuple(rnd.randrange(1 << 16) for _ in range(3)) for _ in range(50)] + [(0, 0, 0), (65535, 65535, 65535)]
    got = [r[0] for r in spark.createDataFrame(rows, "x long, y long, z long").coalesce(1).select(voxel.interleaved(F.col("x"), F.col("y"), F.col("z"))).collect()]
    assert got == [sum((v >> b & 1) << (3 * b + axis) for axis, v in enumerate(r) for b in range(16)) for r in rows]


def test_frame_points_lie_ahead(spark):
    """A depth of ten metres straight ahead, heading east, is ten metres east at the camera's height."""
    cam = {"height_m": 1.5, "vfov_deg": 60.0, "hfov_deg": 90.0, "pitch_offset_frac": 0.0, "max_range_m": 60.0}
    maps = spark.createDataFrame([(1, "f", 0, 0, 3.0)], "run_id long, frame_id string, y long, x long, d double")
    fits = spark.createDataFrame([(1, "f", 0.03, 0.01)], "run_id long, frame_id string, a double, b double")
    frames = spark.createDataFrame([(1, "f", 10.0, 20.0, 90.0)], "run_id long, frame_id string, lat double, lon double, heading_deg double")
    got = depth.frame_points(maps, fits, frames, (10.0, 20.0), 1, 1, 100, 100, cam, stride=50).collect()
    ahead = next(r for r in got if (r.u, r.v) == (50, 50))
    assert (round(ahead.x, 9), round(ahead.y, 9), round(ahead.z, 9)) == (10.0, 1.5, 0.0)
    left = next(r for r in got if (r.u, r.v) == (0, 50))
    assert left.z < -1  # to the left of east is north


def test_gate_without_zone_mask_or_class(spark):
    box = boxes.make_box(*[F.col(c) for c in ("x1", "y1", "x2", "y2")])
    kinds = "run_id long, frame_id string, det_seq long, cls string, geometry string, x1 double, y1 double, x2 double, y2 double"
    rows = [(1, "f", 0, "pothole", "point", 400, 400, 420, 500), (1, "f", 1, "pothole", None, 0, 0, 20, 100), (1, "f", 2, None, None, 0, 0, 20, 100), (1, "g", 3, "pothole", "area", 400, 400, 420, 500), (1, "f", 4, "pothole", "point", 600, 400, 620, 500)]
    d = spark.createDataFrame([(*r[:5], *map(float, r[5:])) for r in rows], kinds).withColumn("box", box)
    corner = lambda x, y: F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y"))
    polygons = spark.range(1).select(F.lit(1).cast("long").alias("run_id"), F.lit("f").alias("frame_id"), F.array(corner(300, 300), corner(700, 300), corner(700, 700), corner(300, 700)).alias("polygon"))
    masks = spark.createDataFrame([(1, "f", 500, 300, 500), (1, "f", 500, 450, 520)], "run_id long, frame_id string, row_no long, col_start long, col_end long")
    rules = spark.createDataFrame([("pothole", True)], "cls string, carriageway_only boolean")
    got = roadgate.verdicts(d, rules, polygons, masks, 1000, 1000)
    assert sorted((r.det_seq, r.on_carriageway, r.on_mask, r.state) for r in got.collect()) == [(0, True, True, "inside"), (1, False, False, "outside"), (2, None, False, "anywhere"), (3, None, None, "no_zone"), (4, True, False, "slack")]
    assert sorted(r.det_seq for r in roadgate.keep(got).collect()) == [0, 2, 3, 4]
    assert roadgate.gate_counts(got.limit(0)).collect() == []


def test_clock_without_times(spark):
    clips = spark.createDataFrame([(1, 10.0, None), (2, None, "2024-01-01 00:00:00"), (3, 10.0, "2024-01-01 00:00:00")], "run_id long, duration_s double, created string").withColumn("created", F.to_timestamp("created"))
    none = spark.createDataFrame([], "run_id long, start timestamp, span_s double, length_m double")
    assert {r.status for r in checks.clock_readings(clips, none).collect()} == {"unknown"}


def test_a_stop_does_not_shift_the_fit(spark):
    """Ten metres a second, a stop of twenty seconds, then on: only pairs in motion, each with its own way."""
    m = 1 / 111320.0
    at = lambda t: 10 * min(t, 20) + 10 * max(0, t - 40)
    track = spark.createDataFrame([(1, i, float(i), 50 + at(i) * m, 8.0) for i in range(60)], "run_id long, seq long, t double, lat double, lon double")
    marks = spark.createDataFrame([(1, t + 0.1, 500.0, 510.0) for t in range(1, 58)] + [(2, 5.0, 1.0, 2.0)], "run_id long, t double, v1 double, v2 double")
    got = motion.pairs_at_speed(marks, track, 0.3, 8.0).collect()
    assert {r.run_id for r in got} == {1}
    assert sorted(r.t for r in got) == [t + 0.1 for t in (*range(1, 20), *range(41, 58))]
    assert all(abs(r.dist - 3) < 0.01 for r in got)


def test_models_see_what_they_can(spark):
    runs = spark.createDataFrame([(1, "few"), (2, "all"), (3, None)], "run_id long, model string")
    rules = spark.createDataFrame([("no_light", "light"), ("no_sign", "sign")], "absence_key string, asset string")
    models = spark.createDataFrame([("few", "sign"), ("few", "sign"), ("other", "light")], "model string, cls string")
    by_run = checks.rules_by_run(runs, rules, models)
    assert sorted((r.run_id, r.asset) for r in by_run.filter("detectable").collect()) == [(1, "sign"), (2, "light"), (2, "sign"), (3, "light"), (3, "sign")]
    assert [tuple(r) for r in checks.skipped_rules(by_run).collect()] == [(1, "few", "no_light", "light")]


def test_map_documents_are_whole(spark, tmp_path):
    """Written by several tasks, the files of a run are one sound document, its parts in order."""
    import xml.etree.ElementTree as ET

    frames = spark.range(40).select((F.col("id") % 2 + 1).alias("run_id"), F.floor(F.col("id") / 2).alias("frame_idx"), (F.col("id") * 0.001).alias("lat"), F.lit(8.0).alias("lon"), F.when(F.col("id") < 30, F.timestamp_seconds("id")).alias("ts"))
    found = spark.createDataFrame([(1, "a", "x<y", 1.0, 2.0, 3, 0.5), (1, "b", "pothole", None, None, 5, 1.0)], "run_id long, finding_id string, cls string, lat double, lon double, severity int, t_sec double")
    taxonomy = spark.createDataFrame([("pothole", "Pot & hole", "#dc2626")], "cls string, label string, color string")
    absences = spark.createDataFrame([("no_light", "#78716c")], "absence_key string, color string")
    stretches = spark.createDataFrame([(2, 0, "no_light", "Dark", 5.0, 55.0, k, 1.0, 2.0 + k) for k in range(3)], "run_id long, rule_ord int, absence_key string, label string, start_m double, end_m double, step int, lat double, lon double")
    segments = spark.createDataFrame([(1, 0, 93.5, "#22c55e", (1.0, 2.0), (3.0, 4.0))], "run_id long, seg_id int, quality_index double, color string, start struct<lat:double,lon:double>, end struct<lat:double,lon:double>")
    mapdoc.write_documents(mapdoc.document_lines(frames, found, segments, stretches, taxonomy, absences), str(tmp_path / "docs"))
    for run, folders in ((1, ["Findings", "Heat map", "Route"]), (2, ["Missing assets", "Route"])):
        text = "".join(f.read_text() for f in sorted((tmp_path / "docs" / f"run_id={run}").glob("part-*")))
        doc = ET.fromstring(text)[0]
        space = "{http://www.opengis.net/kml/2.2}"
        assert [f.find(f"{space}name").text for f in doc.iter(f"{space}Folder")] == folders
        assert len(list(doc.iter(f"{space}Style"))) == 3 + (run == 1)
        route = next(p for p in doc.iter(f"{space}Placemark") if p.find(f"{space}name").text == "Route")
        assert len(route.find(f"{space}LineString/{space}coordinates").text.split()) == 20
        drive = next(doc.iter("{http://www.google.com/kml/ext/2.2}Track"))
        assert len(list(drive.iter(f"{space}when"))) == len(list(drive.iter("{http://www.google.com/kml/ext/2.2}coord"))) == 15


def literal_looks(frame, anchors, looks, classes, known, threshold, iou, keep):
    """One anchor after the other, in pixels of the frame."""
    w0, h0 = frame
    seen = []
    for look, n, cx, cy, w, h, scores in anchors:
        x, y, lw, lh = looks[look]
        best = max(scores)
        if best < threshold:
            continue
        scale = min(640 / lw, 640 / lh)
        pad = [(640 - round(v * scale)) / 2 for v in (lw, lh)]
        box = [(cx - w / 2 - pad[0]) / scale + x, (cy - h / 2 - pad[1]) / scale + y, (cx + w / 2 - pad[0]) / scale + x, (cy + h / 2 - pad[1]) / scale + y]
        seen.append((look, n, classes[scores.index(best)], best, [box[0] / w0 * 1000, box[1] / h0 * 1000, box[2] / w0 * 1000, box[3] / h0 * 1000]))
    kept = []
    for s in sorted(seen, key=lambda s: (-s[3], s[0], s[1])):
        def overlap(a, b):
            i = max(0, min(a[2], b[2]) - max(a[0], b[0])) * max(0, min(a[3], b[3]) - max(a[1], b[1]))
            return i / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - i)
        if all(k[2] != s[2] or overlap(k[4], s[4]) <= iou for k in kept):
            kept.append(s)
    out = []
    for look, n, cls, best, box in kept[:keep]:
        box = [min(1000, max(0, v)) for v in box]
        if box[2] - box[0] >= 2 and box[3] - box[1] >= 2 and cls in known:
            out.append((look << 32 | n, cls, round(best, 3), *[round(v, 6) for v in box]))
    return sorted(out)


def test_looks_are_merged_in_the_frame(spark):
    rnd = random.Random(8)
    frames = spark.createDataFrame([(1, "f", 1280, 720), (2, "f", 600, 500)], "run_id long, frame_id string, width int, height int")
    seen = tiles.looks(frames, 640, 128)
    looks = {run: {r.look: (r.x, r.y, r.w, r.h) for r in seen.filter(f"run_id = {run}").collect()} for run in (1, 2)}
    assert looks[2] == {0: (0, 0, 600, 500)} and looks[1][0] == (0, 0, 1280, 720) and len(looks[1]) > 4
    classes = ["pothole", "crack", "oil"]
    anchors = {run: [(look, n, rnd.uniform(0, 640), rnd.uniform(0, 640), rnd.uniform(1, 300), rnd.uniform(1, 300), [rnd.choice([0.1, 0.5, 0.7, rnd.random()]) for _ in classes]) for look in looks[run] for n in range(25)] for run in (1, 2)}
    rows = [(run, "f", *a) for run, own in anchors.items() for a in own] + [(1, "f", 99, 0, 1.0, 1.0, 5.0, 5.0, [0.9, 0.9, 0.9]), (1, "f", 0, 77, 1.0, 1.0, 5.0, 5.0, None)]
    df = spark.createDataFrame(rows, "run_id long, frame_id string, look int, anchor_id long, cx double, cy double, w double, h double, scores array<double>")
    known = spark.createDataFrame([("pothole", "Pothole"), ("crack", "Crack")], "cls string, label string")
    got = tiles.merge_looks(df, seen, classes, known, threshold=0.4, keep=30).collect()
    for run, frame in ((1, (1280, 720)), (2, (600, 500))):
        mine = sorted((r.det_seq, r.cls, r.confidence, *[round(r.box[c], 6) for c in ("x1", "y1", "x2", "y2")]) for r in got if r.run_id == run)
        assert mine == literal_looks(frame, anchors[run], looks[run], classes, {"pothole", "crack"}, 0.4, 0.45, 30)
    seam = [(1, "f", 0, 0, 320.0, 320.0, 40.0, 40.0, [0.9, 0.0, 0.0]), (1, "f", 1, 0, 520.0 + 120, 300.0, 80.0, 80.0, [0.8, 0.0, 0.0]), (1, "f", 2, 0, 640.0 - 512, 300.0, 80.0, 80.0, [0.8, 0.0, 0.0])]
    one = tiles.merge_looks(spark.createDataFrame(seam, df.schema), seen, classes, known).collect()
    assert len(one) == 2  # the two tiles' halves of one object are one box


def test_map_features_of_a_file(spark, tmp_path):
    (tmp_path / "a.json").write_text("""{"version": 0.6,
      "elements": [
        {"type": "way", "id": 1, "tags": {"building": "yes", "height": "12 m", "source": "x"}, "geometry": [{"lat": 1, "lon": 1}, {"lat": 1, "lon": 2}, {"lat": 2, "lon": 2}, {"lat": 2, "lon": 1}]},
        {"type": "way", "id": 2, "tags": {"building": "yes", "highway": "residential"}, "geometry": [{"lat": 1, "lon": 1}, {"lat": 1, "lon": 2}]},
        {"type": "way", "id": 3, "tags": {"highway": "service"}, "geometry": [{"lat": 1, "lon": 1}, {"lat": 1, "lon": 2}]},
        {"type": "way", "id": 4, "tags": {"highway": "primary", "name": "High"}, "geometry": [{"lat": 1, "lon": 1}, {"lat": null, "lon": 2}, {"lat": 3, "lon": 2}]},
        {"type": "node", "id": 5}, {"type": "way", "id": 6}]}""")
    (tmp_path / "b.json").write_text('{"elements": null}')
    got = {r.osm_id: r for r in mapdata.map_features(mapdata.read_map_elements(spark, str(tmp_path))).collect()}
    assert sorted(got) == [1, 4]
    assert (got[1].kind, got[1].height_m, got[1].tags) == ("building", 12.0, {"building": "yes", "height": "12 m"})
    assert (got[4].kind, got[4].highway, got[4].name, len(got[4].path)) == ("road", "primary", "High", 2)
    assert 3 in {r.osm_id for r in mapdata.map_features(mapdata.read_map_elements(spark, str(tmp_path)), None).collect()}


def literal_heading(p, i, window, least):
    """The first half-width whose ends are far enough apart, place by place."""
    def far(a, b):
        h = math.sin(math.radians(b[0] - a[0]) / 2) ** 2 + math.cos(math.radians(a[0])) * math.cos(math.radians(b[0])) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
        return 2 * 6_371_000.0 * math.asin(math.sqrt(h))

    n = len(p)
    if n < 2:
        return 0.0
    for w in range(window, n + window):
        a, b = max(0, i - w), min(n - 1, i + w)
        if far(p[a], p[b]) >= least or (a == 0 and b == n - 1):
            dl = math.radians(p[b][1] - p[a][1])
            y = math.sin(dl) * math.cos(math.radians(p[b][0]))
            x = math.cos(math.radians(p[a][0])) * math.sin(math.radians(p[b][0])) - math.sin(math.radians(p[a][0])) * math.cos(math.radians(p[b][0])) * math.cos(dl)
            return math.fmod(math.degrees(math.atan2(y, x)) + 360, 360)


def test_headings_across_pieces_and_stops(spark, monkeypatch):
    """Runs that stop for longer than the halo, go back, or have one place; pieces of seven frames."""
    monkeypatch.setattr(route, "FRAME_BUCKET", 7)
    rnd = random.Random(2)
    runs = {1: [(50 + i * 1e-5, 8.0) for i in range(40)], 2: [(50.0, 8 + i * 1e-5) for i in range(10)] + [(50.0, 8 + 9e-5)] * 30 + [(50 - i * 1e-5, 8 + 9e-5) for i in range(12)], 3: [(1.0, 1.0)], 4: [(50.0, 8.0)] * 5, 5: [(50 + rnd.random() * 1e-4, 8 + rnd.random() * 1e-4) for _ in range(50)]}
    rows = [(run, 3 * i, *q, "kept") for run, own in runs.items() for i, q in enumerate(own)]
    frames = spark.createDataFrame(rows, "run_id long, frame_idx long, lat double, lon double, note string").repartition(4)
    for halo in (3, 64):
        got = {(r.run_id, r.frame_idx): r.heading for r in route.headings(frames, 2, 8.0, halo).filter("note = 'kept'").collect()}
        assert {k: round(v, 6) for k, v in got.items()} == {(run, 3 * i): round(literal_heading(own, i, 2, 8.0), 6) for run, own in runs.items() for i in range(len(own))}


def test_nearest_frame_of_distant_places(spark):
    rnd = random.Random(6)
    frames = [(run, i, 10 + i * 2e-4 + rnd.random() * 1e-4, 20 + run + math.sin(i / 9) * 0.01) for run in (1, 2) for i in range(300)]
    places = [(run, k, 10 + rnd.uniform(-1, 1) * far, 20 + run + rnd.uniform(-1, 1) * far) for run in (1, 2) for k, far in enumerate([1e-4, 1e-3, 0.01, 0.1, 1, 9] * 6)] + [(3, 0, 1.0, 1.0)]
    got = absence.nearest_frame(spark.createDataFrame(places, "run_id long, k long, lat double, lon double"), spark.createDataFrame(frames, "run_id long, frame_idx long, lat double, lon double"), ["k"])
    def d(a, b):
        h = math.sin(math.radians(b[0] - a[0]) / 2) ** 2 + math.cos(math.radians(a[0])) * math.cos(math.radians(b[0])) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
        return math.asin(math.sqrt(h))
    want = {(run, k): min((d((lat, lon), f[2:]), f[1]) for f in frames if f[0] == run)[1] for run, k, lat, lon in places if run < 3}
    assert {(r.run_id, r.k): r.frame_idx for r in got.collect()} == want


def literal_match(objects, found):
    """Each object in order takes the nearest free finding of its run and class."""
    def d(a, b):
        h = math.sin(math.radians(b[0] - a[0]) / 2) ** 2 + math.cos(math.radians(a[0])) * math.cos(math.radians(b[0])) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
        return math.asin(math.sqrt(h))

    free, out = list(found), {}
    for o in sorted(objects, key=lambda o: o[2]):
        near = [(d(o[3:], f[3:]), f[2], f) for f in free if f[:2] == o[:2] and f[3] is not None and o[3] is not None]
        if near:
            _, name, f = min(near)
            free.remove(f)
            out[o[:3]] = name
    return out


@pytest.mark.parametrize("spread", [1e-4, 0.02])
def test_matching_at_any_distance(spark, spread):
    """Crowded and thin runs, more objects than findings, and classes without any."""
    rnd = random.Random(9)
    at = lambda: (50 + rnd.random() * spread, 8 + rnd.random() * spread)
    found = [(run, cls, f"f{i:03}", *at()) for run in (1, 2) for cls in "ab" for i in range(25)] + [(3, "a", "f000", *at()), (1, "a", "none", None, None)]
    objects = [(run, cls, k * 10 + run, *at()) for run, n in ((1, 20), (2, 40), (3, 3)) for cls in ("a", "b") for k in range(n)] + [(4, "a", 1, 1.0, 1.0), (1, "a", 999, None, None)]
    objects = [(r, c, i * 2 + (c == "b"), *p) for r, c, i, *p in objects]
    got = evaluate.match_findings(spark.createDataFrame(found, "run_id long, cls string, finding_id string, lat double, lon double"), spark.createDataFrame(objects, "run_id long, cls string, object_id long, lat double, lon double"), None)
    assert {(r.run_id, r.cls, r.object_id): r.finding_id for r in got.collect()} == literal_match(objects, found)


def test_report_tables_without_rows_and_without_runs(spark):
    """A run that has no summary, no findings and no segments still has its cover; nothing else has rows."""
    from wayside.operators import report

    manifests = spark.createDataFrame([(1, "mock", None, 10.0, 5, 0, "2024", 1.0, 2.0)], "run_id long, backend string, verifier string, duration_sec double, n_frames long, n_detections long, created string, origin_lat double, origin_lon double")
    summary = spark.createDataFrame([], "run_id long, quality_index double, total_findings long, route_length_m double")
    row = report.cover(summary, manifests).first()
    assert (row.quality_index, row.grade, row.findings, row.per_km) == (100.0, "A", 0, 0.0)
    assert row.provenance == "detected by mock; synthetic data"
    none = spark.createDataFrame([], "run_id long, cls string, severity int")
    kinds = spark.createDataFrame([], "cls string, label string, color string")
    absences = spark.createDataFrame([], "absence_key string, label string, color string")
    assert report.classes(none, kinds, absences, manifests).collect() == []


def test_accuracy_in_words(spark):
    from wayside.operators import report

    rows = [("triangulated", 0.5, 3), ("triangulated", None, 3), ("camera", None, None), (None, None, None)]
    got = [r[0] for r in spark.createDataFrame(rows, "m string, r double, n int").coalesce(1).select(report.accuracy(F.col("m"), F.col("r"), F.col("n"))).collect()]
    assert got == ["0.50 m over 3 rays", "2 to 4 m, one projection", "place of the camera", "2 to 4 m, one projection"]


def test_evidence_of_merged_boxes(spark):
    from wayside.operators import perception

    box = "box struct<x1:double,y1:double,x2:double,y2:double>"
    kinds = f"run_id long, frame_id string, cls string, det_seq long, confidence double, severity int, evidence string, {box}"
    one = spark.createDataFrame([(1, "f", "a", 1, 0.5, 2, "hole", (0.0, 0.0, 100.0, 100.0))], kinds)
    two = spark.createDataFrame([(1, "f", "a", 2, 0.5, 4, "pit", (0.0, 0.0, 100.0, 100.0)), (1, "f", "a", 3, 0.9, 1, "all over", (0.0, 0.0, 900.0, 900.0))], kinds)
    got = {r.origin: (r.evidence, r.severity) for r in perception.ensemble_merge(one, two).collect()}
    assert got == {"merged": ("hole; also: pit", 4), "wide": ("all over (an area, no place: 81% of the image)", 1)}


def test_rules_of_the_carriageway_by_table_and_declaration(spark):
    from wayside.operators import zone

    rows = [("a", "Crack", "", False, None), ("b", "Crack", "", False, False), ("c", "Bin", "", True, True), ("d", "Bin", "", False, None)]
    classes = spark.createDataFrame(rows, "cls string, label string, hint string, is_absence boolean, carriageway_only boolean")
    over = spark.createDataFrame([("d", False), ("d", True)], "cls string, carriageway_only boolean")
    got = {r.cls: (r.carriageway_only, r.source) for r in zone.carriageway_rules(classes, over).collect()}
    assert got == {"a": (True, "lexical"), "b": (False, "declared"), "c": (True, "declared"), "d": (True, "override")}


def test_cloud_files(spark, tmp_path):
    from wayside.sources import sinks

    cloud = spark.createDataFrame([(1, 1.0, 2.0, 3.0)], "run_id long, x double, y double, z double")
    sinks.write_cloud(cloud, str(tmp_path / "cloud"), "from depth")
    assert [r.provenance for r in spark.read.parquet(str(tmp_path / "cloud")).collect()] == ["from depth"]


def test_unmatched_objects_by_hand(spark):
    rnd = random.Random(12)
    place = lambda: (50 + rnd.random() * 4e-4, 8.0)
    found = [(1, "a", f"f{i}", *place()) for i in range(6)]
    objects = [(1, "a", i, *place()) for i in range(12)] + [(2, "b", 1, 1.0, 1.0)]
    f = spark.createDataFrame(found, "run_id long, cls string, finding_id string, lat double, lon double")
    o = spark.createDataFrame(objects, "run_id long, cls string, object_id long, lat double, lon double")
    free, left = list(found), []
    for x in objects:
        near = sorted((abs(x[3] - y[3]) * 111194.9, y) for y in free if y[:2] == x[:2])
        if near and near[0][0] <= 8:
            free.remove(near[0][1])
        else:
            left.append((x[0], x[2]))
    got = evaluate.unmatched_objects(evaluate.match_findings(f, o), o)
    assert sorted((r.run_id, r.object_id) for r in got.collect()) == sorted(left) and 0 < len(left) < 13


def test_decoded_anchors_equal_the_literal_steps(spark):
    """Best class, letterbox undone, clamped, suppressed within class, the surest kept."""
    from wayside.operators import perception

    rnd = random.Random(4)
    classes = ["pothole", "crack"]
    rows = [(1, "f", i, rnd.uniform(0, 640), rnd.uniform(0, 640), rnd.uniform(20, 200), rnd.uniform(20, 200), [rnd.random() * 0.6, rnd.random()]) for i in range(80)]
    df = spark.createDataFrame(rows, "run_id long, frame_id string, anchor_id long, cx double, cy double, w double, h double, scores array<double>")
    scale, pads = min(640 / 1280, 640 / 720), [(640 - round(v * min(640 / 1280, 640 / 720))) / 2 for v in (1280, 720)]
    seen = []
    for _, _, i, cx, cy, w, h, s in rows:
        if max(s) >= 0.25:
            px = [(cx - w / 2 - pads[0]) / scale / 1.28, (cy - h / 2 - pads[1]) / scale / 0.72, (cx + w / 2 - pads[0]) / scale / 1.28, (cy + h / 2 - pads[1]) / scale / 0.72]
            seen.append((max(s), i, classes[s.index(max(s))], [min(1000, max(0, v)) for v in px]))
    kept = []
    for s in sorted(seen, key=lambda s: (-s[0], s[1])):
        def overlap(a, b):
            both = max(0, min(a[2], b[2]) - max(a[0], b[0])) * max(0, min(a[3], b[3]) - max(a[1], b[1]))
            joint = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - both
            return both / joint if both > 0 and joint > 0 else 0
        if all(k[2] != s[2] or overlap(k[3], s[3]) <= 0.45 for k in kept):
            kept.append(s)
    got = perception.decode_anchors(df, classes, 1280, 720).collect()
    assert sorted((r.det_seq, r.cls, *[round(r.box[c], 6) for c in ("x1", "y1", "x2", "y2")]) for r in got) == sorted((i, c, *[round(v, 6) for v in b]) for _, i, c, b in kept[:20])


def test_the_chain_gives_what_its_steps_give(spark):
    """All tables of ``summarize_runs`` on a small survey: parts agree with one another."""
    from wayside.operators import chain
    from wayside.plans import core
    from wayside.fixtures import view

    sf = "/root/testdata/sf0.001"
    rules = view(spark, sf, "fx_absence")
    frames = core.frames(spark, sf)
    out = chain.summarize_runs(core.detections(spark, sf), frames, view(spark, sf, "fx_taxonomy"), rules, core.CAM)
    n = {r.run_id: 0 for r in out["summary"].collect()}
    for part in ("findings", "absences"):
        for r in out[part].collect():
            n[r.run_id] += 1
    assert {r.run_id: r.total_findings for r in out["summary"].collect()} == n and sum(n.values()) > 50
    held = sum(len(r.finding_ids) for r in out["segments"].collect())
    assert 0 < held <= sum(n.values())
    gaps = {(r.run_id, r.absence_key): r.gaps for r in out["coverage"].collect()}
    made = {}
    for r in out["absences"].collect():
        made[r.run_id, r.cls] = made.get((r.run_id, r.cls), 0) + 1
    assert {k: v for k, v in gaps.items() if v} == made


def test_clouds_of_depth_are_thinned_without_a_shuffle_of_points(spark, monkeypatch):
    """Clouds thinned in tasks, by a shuffle and by both have the same points; repeated depths and frames of one name count."""
    cam = {"height_m": 1.35, "vfov_deg": 58.0, "hfov_deg": 90.0, "pitch_offset_frac": 0.02, "max_range_m": 60.0}
    image = {"across": 16, "down": 9, "width": 1280, "height": 720, "cam": cam}
    frames = spark.sql("SELECT r AS run_id, lpad(f, 3, '0') AS frame_id, 12.97 + f * 1e-5 AS lat, 77.59 + r * 1e-5 + f * 5e-5 AS lon, 80.0D + f AS heading_deg FROM (SELECT explode(sequence(1L, 4L)) AS r) CROSS JOIN (SELECT explode(sequence(1L, 9L)) AS f) WHERE f <= r * 3")
    frames = frames.unionByName(frames.filter("run_id = 2 AND frame_id = '002'").withColumn("lat", F.col("lat") + 1e-4))
    cells = spark.range(144).select(F.floor(F.col("id") / 16).alias("y"), (F.col("id") % 16).alias("x"))
    maps = frames.dropDuplicates(["run_id", "frame_id"]).crossJoin(cells).select("run_id", "frame_id", "y", "x", ((F.col("y") * 2 + 1) * 0.01 + (F.col("x") * 3 + F.col("run_id")) % 11 * 0.001).alias("d"))
    maps = maps.unionByName(maps.filter("run_id = 3 AND y = 7").withColumn("d", F.col("d") + 0.003)).unionByName(maps.filter("y = 6").withColumn("d", F.lit(None).cast("double")))
    rows = lambda **k: sorted(map(tuple, depth.depth_cloud(maps, frames, (12.97, 77.59), **image, stride=40, budget=700).select("run_id", "frame_id", "u", "v", "x", "y", "z").collect()))
    in_tasks = depth.depth_cloud(maps, frames, (12.97, 77.59), **image, stride=40, budget=700)
    assert "rangepartitioning" not in in_tasks._jdf.queryExecution().toString()
    got = sorted(map(tuple, in_tasks.collect()))
    counts = Counter(r[0] for r in got)
    assert set(counts) == {1, 2, 3, 4} and max(counts.values()) <= 700
    for held in (0, 2500):
        monkeypatch.setattr(depth, "HELD", held)
        assert rows() == got
    fits = depth.depth_scales(maps, **image)
    points = depth.frame_points(maps, fits, frames, (12.97, 77.59), **image, stride=40)
    few = depth.depth_cloud(maps, frames, (12.97, 77.59), **image, stride=40, budget=10**6)
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, points.collect()))
