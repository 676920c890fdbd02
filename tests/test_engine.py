"""Kernels whose result depends on order against the literal loops, and the queries against SQL."""

import math
import random

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from wayside.functions import boxes, geo, text
from wayside.operators import cloud, csvio, evaluate, findings, localize, perception, route, zone
from wayside.plans import core, more, registry

SF = "/root/testdata/sf0.001"


def haversine(a, b, c, d):
    p, q = math.radians(a), math.radians(c)
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(d - b) / 2) ** 2
    return 2 * 6_371_000 * math.asin(math.sqrt(h))


def sightings(seed, n=120):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        x, y = rnd.randint(0, 300), rnd.randint(300, 600)
        rows.append((1, i, rnd.randint(0, 60), rnd.choice("ab"), (float(x), float(y), x + 90.0, y + 60.0), 12.97 + rnd.randint(0, 60) * 1e-5, 77.59 + rnd.randint(0, 3) * 1e-5))
    return rows


def literal_tracks(rows):
    out = {}
    for cls in {r[3] for r in rows}:
        tracks = []
        for r in sorted((r for r in rows if r[3] == cls), key=lambda r: (r[2], r[1])):
            best, score = None, 0.0
            for t in tracks:
                if 1 <= r[2] - t[-1][2] <= 2:
                    s = findings._association(t[-1][4], r[4])
                    if s > score:
                        best, score = t, s
            if best is None:
                tracks.append([r])
            else:
                best.append(r)
        for t in tracks:
            for r in t:
                out[r[1]] = t[0][1]
    return out


def literal_merge(rows, tracks, radius):
    def median(v):
        v, m = sorted(v), len(v) // 2
        return v[m] if len(v) % 2 else (v[m - 1] + v[m]) / 2

    out = {}
    for cls in {r[3] for r in rows}:
        groups = {}
        for r in sorted((r for r in rows if r[3] == cls), key=lambda r: (r[2], r[1])):
            groups.setdefault(tracks[r[1]], []).append(r)
        clusters = sorted(groups.values(), key=lambda c: (c[0][2], tracks[c[0][1]]))
        merged = True
        while merged:
            merged = False
            for i in range(len(clusters)):
                for j in range(i + 1, len(clusters)):
                    a, b = ((median([r[5] for r in c]), median([r[6] for r in c])) for c in (clusters[i], clusters[j]))
                    if haversine(*a, *b) <= radius:
                        clusters[i] += clusters.pop(j)
                        merged = True
                        break
                if merged:
                    break
        for c in clusters:
            for r in c:
                out[r[1]] = tracks[c[0][1]]
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_tracks_and_clusters_equal_the_literal_loop(spark, seed):
    rows = sightings(seed)
    df = spark.createDataFrame(
        [(r[0], r[1], r[2], r[3], float(r[2]), *r[4], r[5], r[6]) for r in rows],
        "run_id long, det_seq long, frame_idx long, cls string, t_sec double, x1 double, y1 double, x2 double, y2 double, lat double, lon double",
    ).withColumn("box", F.struct("x1", "y1", "x2", "y2"))
    tracked = findings.build_tracks(df)
    want = literal_tracks(rows)
    assert {r.det_seq: r.track for r in tracked.collect()} == want
    taxonomy = spark.createDataFrame([("a", 3.0), ("b", 3.0)], "cls string, cluster_radius_m double")
    merged = findings.merge_tracks(tracked, taxonomy)
    assert {r.det_seq: r.cluster for r in merged.collect()} == literal_merge(rows, want, 3.0)


def test_partitions_do_not_matter(spark):
    rows = sightings(5)
    schema = "run_id long, det_seq long, frame_idx long, cls string, x1 double, y1 double, x2 double, y2 double"
    df = spark.createDataFrame([(*r[:4], *r[4]) for r in rows], schema).withColumn("box", F.struct("x1", "y1", "x2", "y2"))
    one = sorted(map(tuple, findings.build_tracks(df.coalesce(1)).select("det_seq", "track").collect()))
    many = sorted(map(tuple, findings.build_tracks(df.repartition(16)).select("det_seq", "track").collect()))
    assert one == many


@pytest.mark.parametrize("ceiling", [8.0, None])
def test_matching_equals_the_literal_loop(spark, ceiling):
    rnd = random.Random(9)
    place = lambda: (12.97 + rnd.randint(0, 40) * 1.1e-5, 77.59 + rnd.randint(0, 4) * 1.3e-5)
    f = [(1, f"f{i:03d}", rnd.choice("ab"), *place()) for i in range(60)]
    o = [(1, i, rnd.choice("ab"), *place()) for i in range(40)]
    got = evaluate.match_findings(
        spark.createDataFrame(f, "run_id long, finding_id string, cls string, lat double, lon double"),
        spark.createDataFrame(o, "run_id long, object_id long, cls string, lat double, lon double"), ceiling,
    )
    free, want = sorted(f, key=lambda r: r[1]), {}
    for x in o:
        near = [(haversine(x[3], x[4], y[3], y[4]), i) for i, y in enumerate(free) if y[2] == x[2]]
        if near and (ceiling is None or min(near)[0] <= ceiling):
            want[x[1]] = free.pop(min(near)[1])[1]
    assert {r.object_id: r.finding_id for r in got.collect()} == want


def test_rays(spark):
    rays = [("far", 12.97, 77.59, 0.0), ("far", 12.97, 77.59 + 6 / (111320 * math.cos(math.radians(12.97))), 329.04), ("parallel", 12.97, 77.59, 10.0), ("parallel", 12.98, 77.59, 10.0), ("one", 12.97, 77.59, 5.0),
            ("behind", 12.97, 77.59, 180.0), ("behind", 12.97, 77.59 + 6 / (111320 * math.cos(math.radians(12.97))), 149.04)]
    got = {r.k: r for r in findings.triangulate(spark.createDataFrame(rays, "k string, lat double, lon double, bearing double"), ["k"]).collect()}
    assert abs((got["far"].t_lat - 12.97) * 111320 - 10) < 0.1 and got["far"].residual_m < 0.01
    assert got["parallel"].t_lat is None and got["one"].t_lat is None


def test_ground_projection_inverts_the_pinhole(spark):
    cam = localize.camera_columns(localize.DASHCAM)
    f = 360 / math.tan(math.radians(29))
    rows = [(z, x, 640 + f * x / z, 360 + f * 1.35 / z) for z in (4.0, 10.0, 30.0) for x in (-2.0, 0.0, 3.0)] + [(None, None, 640.0, 360.0), (None, None, 640.0, 200.0), (None, None, 640.0, 361.0)]
    df = spark.createDataFrame(rows, "z double, x double, u double, v double")
    for r in df.select("z", "x", geo.ground_range(F.col("u"), F.col("v"), F.lit(1280.0), F.lit(720.0), cam).alias("g")).collect():
        assert (r.g is None) if r.z is None else (abs(r.g.forward - r.z) < 1e-6 and abs(r.g.lateral - r.x) < 1e-6)


def test_null_places_have_null_distances(spark):
    df = spark.createDataFrame([(None, 1.0)], "a double, b double")
    assert df.select(geo.haversine_m(F.col("a"), F.col("b"), F.col("b"), F.col("b"))).first()[0] is None


def test_times_and_cells(spark):
    rows = [("1:30", 90.0), ("1:00:05.5", 3605.5), ("12", 12.0), ("x", None), ("", None), (None, None), ("0:60.000", 60.0)]
    df = spark.createDataFrame(rows, "t string, want double")
    assert all(r[0] == r[1] for r in df.select(text.parse_time(F.col("t")), "want").collect())
    cells = spark.createDataFrame([("2.5", 2), ("3.5", 4), ("0", None), ("6", None), ("x", None)], "s string, want int")
    assert all(r[0] == r[1] for r in cells.select(text.parse_severity(F.col("s")), "want").collect())


def test_csv_import(spark):
    tax = spark.createDataFrame([(0, "pothole", "Pothole"), (1, "hazard", "Danger Element")], "ord int, cls string, label string")
    rows = [(1, 1, "a", "0:02", "Pothole", "12.5", "77.5", "3.0", "0.5"), (1, 2, "a", "x", "danger element", "bad", "", "", ""), (1, 3, "", "4", "hazard", "", "", "9", "2"), (1, 4, None, None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "run_id long, row_no long, object_id string, time string, defect_name string, lat string, lon string, severity string, confidence string")
    frames = spark.createDataFrame([(1, 0, "00001", 0.0, 1.0, 2.0), (1, 1, "00002", 5.0, 3.0, 4.0)], "run_id long, frame_idx long, frame_id string, t_sec double, lat double, lon double")
    got = {r.row_no: r for r in csvio.import_findings(df, frames, tax).collect()}
    assert [got[i].finding_id for i in (1, 2, 3)] == ["a", "a-2", "3"] and set(got) == {1, 2, 3}
    assert [got[i].cls for i in (1, 2, 3)] == ["pothole", "hazard", "hazard"]
    assert (got[2].lat, got[2].lon, got[2].t_sec, got[2].severity, got[2].confidence) == (1.0, 2.0, 0.0, 3, 1.0)
    assert (got[3].frame_id, got[3].severity, got[3].confidence) == ("00002", 3, 1.0)


def test_carriageway_rules(spark):
    rows = [("pothole", "Pothole", "hole in the road surface", False), ("footpath_damaged", "Footpath", "paving beside the carriageway", False), ("gap", "Gap", "carriageway", True), ("hazard", "Danger", "anything", False)]
    got = {r.cls: (r.carriageway_only, r.source) for r in zone.carriageway_rules(spark.createDataFrame(rows, "cls string, label string, hint string, is_absence boolean"), {"hazard": True}).collect()}
    assert got == {"pothole": (True, "lexical"), "footpath_damaged": (False, "lexical"), "gap": (False, "absence"), "hazard": (True, "override")}


def test_box_scores_by_hand(spark):
    box = lambda x: (x, 0.0, x + 100.0, 100.0)
    s = "image string, cls string, truth_id long, box struct<x1:double,y1:double,x2:double,y2:double>"
    truth = spark.createDataFrame([("i", "a", 1, box(0.0)), ("i", "a", 2, box(300.0))], s)
    p = "image string, cls string, pred_id long, confidence double, box struct<x1:double,y1:double,x2:double,y2:double>"
    pred = spark.createDataFrame([("i", "a", 1, 0.9, box(5.0)), ("i", "a", 2, 0.8, box(10.0)), ("i", "b", 3, 0.7, box(300.0))], p)
    assert abs(evaluate.average_precision(evaluate.pair_boxes(truth, pred, 0.5), truth).first().ap - 51 / 101) < 1e-9
    got = {(r.true, r.predicted): r.n for r in evaluate.confusion(truth, pred, 0.5, 0.5).collect()}
    assert got == {("a", "a"): 1, ("nothing", "a"): 1, ("a", "b"): 1}


def test_suppression_and_boxes(spark):
    box = lambda x: (x, 0.0, x + 100.0, 100.0)
    d = spark.createDataFrame([(1, "f", "a", i, c, box(x)) for i, (c, x) in enumerate([(0.9, 0.0), (0.8, 10.0), (0.7, 200.0)])], "run_id long, frame_id string, cls string, det_seq long, confidence double, box struct<x1:double,y1:double,x2:double,y2:double>")
    assert sorted(r.det_seq for r in perception.suppress(d, 0.45).collect()) == [0, 2]
    raw = spark.createDataFrame([([0.1, 0.2, 0.5, 0.6],), ([500.0, 20.0, 100.0, 10.0],), ([0.0, 0.0, 1000.0, 1000.0],), ([1.0, 2.0],), ([1.0, None, 2.0, 3.0],)], "b array<double>")
    got = [r[0] and tuple(r[0]) for r in raw.select(boxes.coerce_box(F.col("b"))).collect()]
    assert got == [(100.0, 200.0, 500.0, 600.0), (100.0, 10.0, 500.0, 20.0), None, None, None]


def test_spacing_of_a_short_run(spark):
    df = spark.createDataFrame([(1, 0, 12.97, 77.59)], "run_id long, frame_idx long, lat double, lon double")
    assert [tuple(r) for r in route.sample_by_spacing(df, 2.0).collect()] == [(1, 0, None)]
    assert route.headings(df).first().heading == 0.0


def same(v):
    return round(v, 9) if isinstance(v, float) else v


@pytest.mark.parametrize("name", ["d1_asof_position", "f3_heading", "f4_spacing_sampler", "i2_localize", "i7_segments", "i7_score_summary", "i13_import_csv", "e6_triangulate"])
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for t in ("events", "lineitem", "embeddings"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = registry.QUERIES[name](spark, SF)
    want = con.sql(registry.ORACLE_SQL[name])
    columns = sorted(df.columns)
    assert sorted(want.columns) == columns
    got = sorted((tuple(same(r[c]) for c in columns) for r in df.collect()), key=repr)
    rows = sorted((tuple(same(r[want.columns.index(c)]) for c in columns) for r in want.fetchall()), key=repr)
    assert got == rows


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_streamed_tracks_equal_the_table(spark):
    from wayside.operators import findings as f
    from wayside.plans import core, more

    want = {r.det_seq: r.track for r in f.build_tracks(core.seen(spark, SF)).collect()}
    assert {r.det_seq: r.track for r in more.stream_tracks(spark, SF).collect()} == want


def test_largest_component_equals_flood_fill(spark):
    rnd = random.Random(4)
    rows = []
    for frame in range(6):
        for r in range(12):
            at = 0
            while at < 30:
                a = at + rnd.randint(0, 6)
                b = a + rnd.randint(0, 4)
                rows.append((frame, r, a, b))
                at = b + 2
    got = {}
    for r in zone.largest_component(spark.createDataFrame(rows, "frame long, row_no long, col_start long, col_end long")).collect():
        got.setdefault(r.frame, set()).update((r.row_no, c) for c in range(r.col_start, r.col_end + 1))
    for frame in range(6):
        left = {(r, c) for f, r, a, b in rows if f == frame for c in range(a, b + 1)}
        best = 0
        sizes = []
        while left:
            todo, part = [left.pop()], set()
            while todo:
                y, x = todo.pop()
                part.add((y, x))
                for n in [(y + i, x + j) for i in (-1, 0, 1) for j in (-1, 0, 1)]:
                    if n in left:
                        left.remove(n)
                        todo.append(n)
            sizes.append(part)
            best = max(best, len(part))
        assert len(got[frame]) == best and got[frame] in sizes


def test_ensemble_by_hand(spark):
    box = lambda x, w=100.0: (x, 0.0, x + w, 100.0)
    s = "run_id long, frame_id string, cls string, det_seq long, confidence double, severity int, box struct<x1:double,y1:double,x2:double,y2:double>"
    one = spark.createDataFrame([(1, "f", "a", 1, 0.5, 2, box(0.0))], s)
    two = spark.createDataFrame([(1, "f", "a", 2, 0.5, 4, box(5.0)), (1, "f", "a", 3, 0.9, 1, (0.0, 0.0, 900.0, 900.0)), (1, "f", "a", 4, 0.7, 1, box(500.0)), (1, "f", "a", 5, 0.6, 5, box(505.0))], s)
    got = sorted((r.det_seq, r.origin, r.confidence, r.severity) for r in perception.ensemble_merge(one, two).collect())
    # the last box merges into the one before it, which the reader itself had added
    assert got == [(1, "merged", 0.75, 4), (3, "wide", 0.45, 1), (4, "merged", 0.88, 5)]


def test_calibration_recovers_a_camera(spark):
    product, horizon = 900.0, 340.0
    rows = [(v, v + g, product * (1 / (v - horizon) - 1 / (v + g - horizon))) for v in range(400, 600, 7) for g in (10.0, 25.0)] + [(450.0, 470.0, 50.0)] * 5
    df = spark.createDataFrame([(float(a), float(b), c) for a, b, c in rows], "v1 double, v2 double, dist double")
    got = zone.best_calibration(df, [320.0, 330.0, 340.0, 350.0]).first()
    assert got.row == 340.0 and abs(got.product - product) < 1e-6


def test_tiles_of_a_large_box_are_all_there(spark):
    boxes = spark.createDataFrame([(1, 12.9, 77.5, 12.95, 77.55), (2, 12.9, 77.5, 12.9001, 77.5001)], "run_id long, south double, west double, north double, east double")
    got = cloud.tile_cover(boxes, 18).collect()
    column = lambda lon: math.floor((lon + 180) / 360 * 2**18)
    row = lambda lat: math.floor((1 - math.asinh(math.tan(math.radians(lat))) / math.pi) / 2 * 2**18)
    for run, south, west, north, east in boxes.collect():
        want = {(x, y) for x in range(column(west), column(east) + 1) for y in range(row(north), row(south) + 1)}
        own = [r for r in got if r.run_id == run]
        assert len(own) == len(want) and {(r.x, r.y) for r in own} == want
        assert all(r.over == (len(want) > 256) for r in own)
    assert {r.over for r in got} == {True, False}


def test_matching_without_ceiling_takes_from_all_findings(spark):
    placed = [r for r in more.view(spark, SF, "fx_objects").collect() if r.lat is not None and r.lon is not None]
    free = {}
    for r in more.found(spark, SF).orderBy("finding_id").collect():
        if r.lat is not None and r.lon is not None:
            free.setdefault((r.run_id, r.cls), []).append(r)
    want = []
    for x in sorted(placed, key=lambda r: r.object_id):
        own = free.get((x.run_id, x.cls))
        if own:
            i = min(range(len(own)), key=lambda i: haversine(x.lat, x.lon, own[i].lat, own[i].lon))
            want.append((x.run_id, x.cls, x.object_id, own.pop(i).finding_id))
    got = registry.QUERIES["d12_match_without_ceiling"](spark, SF).collect()
    assert sorted((r.run_id, r.cls, r.object_id, r.finding_id) for r in got) == sorted(want)


def test_surroundings_of_all_points_equal_brute_force(spark):
    points = {(r.seq_major, r.l_partkey, r.l_suppkey, r.l_extendedprice) for r in more.view(spark, SF, "fx_points").collect()}
    want = {}
    for b in cloud.route_boxes(core.frames(spark, SF), 60.0).collect():
        for major, part, supplier, _ in points:
            south, west = 12.97 + part * 0.0001, 77.593 + supplier * 0.0003
            if south <= b.north and south + 0.0001 >= b.south and west <= b.east and west + 0.0001 >= b.west:
                key = (b.run_id, "building" if major % 3 == 0 else "road")
                want[key] = want.get(key, 0) + 1
    got = {(r.run_id, r.kind): r.n for r in registry.QUERIES["i23_surroundings"](spark, SF).collect()}
    assert want and got == want


def test_validation_names_every_broken_rule(spark):
    from wayside.operators import validate

    box, nan = [1.0, 2.0, 3.0, 4.0], float("nan")
    rows = [(1, 3, 0.5, box, None), (2, 9, 1.5, box, 2.0), (3, None, None, None, -1.0), (4, 1, 1.0, [1.0, nan, 3.0, 4.0], 1.0), (5, 5, 0.0, [1.0, 2.0, 3.0], 0.0), (6, 1, 0.1, [], 1.0)]
    df = spark.createDataFrame(rows, "id int, severity int, confidence double, box array<double>, range_m double")
    checked = validate.with_violations(df, validate.detection_rules())
    assert {r.id: r.violations for r in checked.collect()} == {
        1: [], 2: ["severity", "confidence"], 3: ["severity", "confidence", "box", "range_m"], 4: ["box"], 5: ["box", "range_m"], 6: ["box"],
    }
    sound, rest = validate.split(checked)
    assert [r.id for r in sound.collect()] == [1] and sound.columns == df.columns and rest.count() == 5
    assert validate.with_violations(df.limit(0), validate.detection_rules()).collect() == []


def test_latest_alerts_over_several_batches(spark, tmp_path):
    from wayside.streaming import live

    live.keep_state_in_rocksdb(spark)
    order = [7, 3, 9, 1, 8, 2, 6, 5, 4, 0]  # times arrive out of order, three to a file
    for i in range(0, 10, 3):
        rows = [(run, float(t), f"e{t}", t != 8) for run in (1, 2) for t in order[i : i + 3]]
        spark.createDataFrame(rows, "run_id long, t_sec double, event string, alert boolean").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("run_id long, t_sec double, event string, alert boolean").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = live.last_turns(live.drain(live.latest_alerts(stream), f"alerts-{tmp_path.name}")).collect()
    assert sorted((r.run_id, r.t_sec, r.event) for r in got) == [(run, float(t), f"e{t}") for run in (1, 2) for t in (3, 4, 5, 6, 7, 9)]
