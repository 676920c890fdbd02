"""Taxonomies, catalogues, readers and box metrics against literal versions, and their queries against SQL."""

import json

import duckdb
import numpy as np
import pytest

from wayside.fixtures import view
from wayside.operators import cloud, csvio, evaluate, perception, slices, taxonomy, zone
from wayside.plans import catalogue, core, more, registry
from wayside.sources import readers, sinks

SF = "/root/testdata/sf0.001"


def same(v):
    return round(v, 7) + 0.0 if isinstance(v, float) else v


@pytest.mark.parametrize("name", [n for n, (_, sql) in catalogue.QUERIES.items() if sql])
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for t in ("events", "lineitem", "embeddings", "part"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = registry.QUERIES[name](spark, SF)
    want = con.sql(registry.ORACLE_SQL[name])
    columns = sorted(df.columns)
    assert sorted(want.columns) == columns
    got = sorted((tuple(same(r[c]) for c in columns) for r in df.collect()), key=repr)
    assert got and got == sorted((tuple(same(r[want.columns.index(c)]) for c in columns) for r in want.fetchall()), key=repr)


CLASS = "domain string, ord int, cls string, label string, geometry string, cluster_radius_m double, weight double, alert boolean, color string, hint string"
RULE = "domain string, rule_ord int, absence_key string, absence_label string, min_gap_m double, weight double, alert boolean, color string, note string"


def test_class_map_by_hand(spark):
    classes = spark.createDataFrame([("d", 0, "b", "B", "point", 3.0, 1.0, False, "#1", ""), ("d", 1, "a", "A", "area", 2.0, 0.0, True, "#2", ""), ("d", 2, "b", "B again", "point", 9.0, 2.0, False, "#3", "")], CLASS)
    rules = spark.createDataFrame([("d", 0, "a", "no A", 40.0, 1.5, False, "#4", ""), ("d", 1, "gap", "Gap", 4.0, 1.5, False, "#5", "n"), ("d", 2, "gap", "Gap again", 90.0, 1.5, False, "#6", "n"), ("e", 0, "far", "Far", 40.0, 1.5, False, "#7", "n")], RULE)
    got = {(r.domain, r.cls): r for r in taxonomy.class_map(classes, rules).collect()}
    assert {k: (r.position, r.label, r.cluster_radius_m, r.is_absence) for k, r in got.items()} == {
        ("d", "b"): (0, "B again", 9.0, False), ("d", "a"): (1, "A", 2.0, True), ("d", "gap"): (2, "Gap", 15.0, True), ("e", "far"): (0, "Far", 40.0, True),
    }
    rows = spark.createDataFrame([(1, "d", "a"), (2, "d", "odd_one"), (3, None, "a")], "id int, domain string, cls string")
    assert {r.id: (r.label, r.is_asset, r.is_known, r.color) for r in taxonomy.look_up(rows, taxonomy.class_map(classes, rules)).collect()} == {
        1: ("A", True, True, "#2"), 2: ("Odd One", False, False, "#f59e0b"), 3: ("A", False, False, "#f59e0b"),
    }
    assert taxonomy.class_map(classes.limit(0), rules.limit(0)).collect() == []


def test_taxonomy_and_catalogue_files(spark, tmp_path):
    (tmp_path / "road.json").write_text(json.dumps({"label": "Road", "classes": [{"key": "hole", "label": "Hole"}, {"key": "lamp", "label": "Lamp", "weight": 0.0}], "absence": [{"key": "dark", "label": "Dark", "asset": "lamp"}]}))
    (tmp_path / "rail.json").write_text(json.dumps({"classes": [{"key": "gap", "label": "Gap"}]}))
    classes, rules = readers.read_taxonomy(spark, str(tmp_path / "*.json"))
    assert {(r.domain, r.n_classes) for r in taxonomy.domains(classes).collect()} == {("road", 2), ("rail", 1)}
    assert [(r.absence_key, r.asset, r.min_gap_m, r.severity) for r in rules.collect()] == [("dark", "lamp", 30.0, 3)]
    assert [(r.cls, r.weight, r.cluster_radius_m) for r in taxonomy.class_map(classes, rules).filter("domain = 'road'").orderBy("position").collect()] == [("hole", 1.0, 3.0), ("lamp", 0.0, 3.0), ("dark", 1.5, 30.0)]

    for run, files in {"r1": ["cloud.ply", "a.mp4"], "r2": ["basemap.jpg"], "r3": ["frames.json"]}.items():
        (tmp_path / "runs" / run / "frames").mkdir(parents=True)
        for f in files:
            (tmp_path / "runs" / run / f).write_bytes(b"x")
        for i in range(3):
            (tmp_path / "runs" / run / "frames" / f"0000{i}.jpg").write_bytes(bytes([i]))
    runs = spark.createDataFrame([("r1",), ("r2",), ("r3",), ("r4",)], "run_id string")
    flags = taxonomy.with_artefacts(runs, readers.read_artefacts(spark, str(tmp_path / "runs" / "*" / "*.*")))
    assert {r.run_id: tuple(r)[1:] for r in flags.collect()} == {"r1": (True, False, True), "r2": (False, True, False), "r3": (False, False, False), "r4": (False, False, False)}
    images = readers.read_images(spark, str(tmp_path / "runs" / "*" / "frames" / "*.jpg"), 2)
    assert sorted((r.run_id, r.frame_id, bytes(r.content)) for r in images.collect()) == [(f"r{k}", f"0000{i}", bytes([i])) for k in (1, 2, 3) for i in (0, 1)]


def test_segments_and_objects(spark, tmp_path):
    (tmp_path / "r").mkdir()
    (tmp_path / "r" / "segments.json").write_text(json.dumps([{"seg_id": 0, "start": [1.0, 2.0], "end": [3.0, 4.0], "length_m": 5.0, "quality_index": 60.0, "color": "#1", "finding_ids": ["f"]}]))
    (tmp_path / "r" / "objects.json").write_text(json.dumps([{"cls": "b", "lat": 1.0, "lon": 2.0, "severity": 1}, {"cls": "a", "lat": 1.0, "lon": 2.0, "severity": 2}]))
    seg = readers.read_segments(spark, str(tmp_path / "r" / "segments.json")).first()
    assert (seg.run_id, seg.seg_id, seg.start, seg.finding_ids) == ("r", 0, [1.0, 2.0], ["f"])
    assert [(r.object_id, r.cls) for r in readers.read_objects(spark, str(tmp_path / "r" / "objects.json")).orderBy("object_id").collect()] == [(0, "b"), (1, "a")]
    worst = spark.createDataFrame([(1, 0, 50.0), (1, 1, 20.0), (1, 2, 50.0)], "run_id long, seg_id int, quality_index double")
    assert [r.seg_id for r in slices.report_segments(worst).orderBy("place").collect()] == [1, 0, 2]


def test_verdicts_without_image_and_dry(spark):
    f = spark.createDataFrame([(1, f"f{i}", "x", 0.5) for i in range(5)], "run_id long, finding_id string, frame_id string, confidence double")
    v = spark.createDataFrame([(1, "f0", "reject"), (1, "f1", "CONFIRM"), (1, "f2", "perhaps")], "run_id long, finding_id string, verdict string")
    there = spark.createDataFrame([(1, "x")], "run_id long, frame_id string")
    settle = lambda images, dry=False: {r.finding_id: (r.confidence, r.evidence_note) for r in perception.settle_verdicts(f, v, images, "m", dry).collect()}
    assert settle(there) == {"f1": (0.575, "verified by m: confirm"), "f2": (0.375, "verified by m: unsure"), "f3": (0.5, None), "f4": (0.5, None)}
    assert settle(there, True) == {"f0": (0.5, "verified by m: reject"), "f1": (0.5, "verified by m: confirm"), "f2": (0.5, "verified by m: unsure"), "f3": (0.5, None), "f4": (0.5, None)}
    assert settle(there.limit(0)) == {**{f"f{i}": (0.5, "not verified: image missing") for i in range(3)}, "f3": (0.5, None), "f4": (0.5, None)}


def test_tallies_of_an_ensemble(spark):
    box = lambda x, w=100.0: (x, 0.0, x + w, 100.0)
    s = "run_id long, frame_id string, cls string, det_seq long, confidence double, severity int, box struct<x1:double,y1:double,x2:double,y2:double>"
    one = spark.createDataFrame([(1, "f", "a", 1, 0.5, 2, box(0.0)), (2, "f", "a", 1, 0.5, 2, box(0.0))], s)
    two = spark.createDataFrame([(1, "f", "a", 2, 0.5, 4, box(5.0)), (1, "f", "a", 3, 0.9, 1, (0.0, 0.0, 900.0, 900.0)), (1, "f", "a", 4, 0.7, 1, box(500.0)), (1, "f", "a", 5, 0.6, 5, box(505.0)), (3, "f", "a", 5, 0.6, 5, box(505.0))], s)
    got = perception.ensemble_tallies(one, two, perception.ensemble_merge(one, two)).collect()
    assert {r.run_id: tuple(r)[1:] for r in got} == {1: (1, 2, 2, 1), 2: (1, 0, 0, 0), 3: (0, 0, 1, 0)}
    with pytest.raises(ValueError, match="stand_in"):
        perception.perceive(core.frames(spark, SF), catalogue.STAND_IN, "other")


def test_frames_of_two_runs_keep_apart(spark):
    rows = [(1, 0, r, 10, 20) for r in range(3)] + [(2, 0, r, 15, 40) for r in range(1, 4)] + [(2, 0, 9, 0, 1)]
    masks = spark.createDataFrame(rows, "run_id long, frame long, row_no long, col_start long, col_end long")
    assert {(r.run_id, r.row_no): r.span_px for r in zone.row_spans(masks).collect()} == {**{(1, i): 11 for i in range(3)}, **{(2, i): 26 for i in range(1, 4)}, (2, 9): 2}
    assert {(r.run_id, r.row_no) for r in zone.largest_component(masks).collect()} == {(1, 0), (1, 1), (1, 2), (2, 1), (2, 2), (2, 3)}
    points = masks.select("run_id", "frame", "row_no").distinct().selectExpr("run_id", "frame", "row_no", "30 as col")
    assert {(r.run_id, r.row_no): r.on_mask for r in zone.in_mask(points, masks).collect()} == {**{(1, i): False for i in range(3)}, **{(2, i): True for i in range(1, 4)}, (2, 9): False}


def test_width_of_the_largest_component(spark):
    # a patch beside the road, in the row measured, widens the mask but not the road
    rows = [(1, 0, r, 500, 700) for r in range(400, 700)] + [(1, 0, r, 900, 1000) for r in range(405, 440)]
    masks = spark.createDataFrame(rows, "run_id long, frame long, row_no long, col_start long, col_end long")
    span = lambda **kw: {round(r.range_m, 1): r.span_m for r in zone.carriageway_width(masks, 1280, 720, core.CAM, (12.5, 5.0), **kw).collect()}
    whole, road = span(), span(least_share=0.0)
    assert whole[5.0] == road[5.0] and road[12.5] < whole[12.5] and abs(road[12.5] / whole[12.5] - 201 / 501) < 1e-9
    assert set(span(least_share=0.9).values()) == {None}


def test_horizon_of_few_or_bad_frames(spark):
    fits = spark.createDataFrame([(1, i, 340.0 + i, 1.0, 0.9) for i in range(5)] + [(1, 9, 5000.0, 1.0, 0.99), (1, 10, 100.0, 1.0, 0.5)] + [(2, i, 340.0, 1.0, 0.9) for i in range(4)], "run_id long, frame long, horizon double, slope double, r2 double")
    got = zone.estimate_horizon(fits, 720).collect()
    assert [(r.run_id, r.n, r.horizon, r.spread) for r in got] == [(1, 5, 342.0, 4.0)]
    alone = zone.estimate_horizon(fits.filter("run_id = 1").drop("run_id"), 720).first()
    assert (alone.n, alone.horizon) == (5, 342.0)


def test_cameras_are_added(spark, tmp_path):
    cams = spark.createDataFrame([(1, 1.35)], "run_id long, height_m double")
    sinks.append_cameras(cams, str(tmp_path / "c"))
    sinks.append_cameras(cams, str(tmp_path / "c"))
    assert spark.read.parquet(str(tmp_path / "c")).count() == 2


def literal_map(truth, predicted, iou, size, pixels):
    """Average precision of each class by the public definition, one prediction at a time."""
    area = lambda b: (b[2] - b[0]) * (b[3] - b[1])
    of = lambda b: "small" if area(b) * pixels < 1024 else "medium" if area(b) * pixels < 9216 else "large"

    def overlap(a, b):
        both = max(0, min(a[2], b[2]) - max(a[0], b[0])) * max(0, min(a[3], b[3]) - max(a[1], b[1]))
        return both / (area(a) + area(b) - both)

    out = {}
    for cls in sorted({t[1] for t in truth}):
        own = [t for t in truth if t[1] == cls and (size == "all" or of(t[3]) == size)]
        if not own:
            continue
        taken, marks = set(), []
        for p in sorted((p for p in predicted if p[1] == cls), key=lambda p: (-p[3], p[0], p[2])):
            best = None
            for group in (True, False):
                fits = [(-overlap(p[4], t[3]), t[2]) for t in truth if t[0] == p[0] and t[1] == cls and t[2] not in taken and (t in own) == group and overlap(p[4], t[3]) >= iou]
                if fits:
                    best = (min(fits)[1], group)
                    break
            if best:
                taken.add(best[0])
                marks += [1] if best[1] else []
            elif size == "all" or of(p[4]) == size:
                marks.append(0)
        tp = np.cumsum(marks)
        precision, recall = tp / np.arange(1, len(marks) + 1), tp / len(own)
        out[cls] = sum(max((p for p, r in zip(precision, recall, strict=True) if r >= i / 100 - 1e-11), default=0.0) for i in range(101)) / 101
    return out


def test_mean_precision_equals_the_literal_definition(spark):
    rng = np.random.default_rng(3)
    box = lambda: (lambda x, y, w, h: (x, y, x + w, y + h))(*rng.uniform(0, 60, 2), *rng.uniform(10, 140, 2))
    truth = [(f"i{n % 4}", "ab"[n % 2], n, tuple(map(float, box()))) for n in range(40)]
    shifted = [(i, c, n, round(float(rng.uniform(0, 1)), 3), tuple(float(v + rng.normal(0, 4)) for v in b)) for i, c, n, b in truth for _ in range(2)]
    predicted = [(i, c, k, s, b) for k, (i, c, _, s, b) in enumerate(shifted) if b[2] > b[0] and b[3] > b[1]]
    kind = "box struct<x1:double,y1:double,x2:double,y2:double>"
    t = spark.createDataFrame(truth, f"image string, cls string, truth_id long, {kind}")
    p = spark.createDataFrame(predicted, f"image string, cls string, pred_id long, confidence double, {kind}")
    got = evaluate.mean_precision(t, p, 1280, 720).first()
    mean = lambda size, ious: [v for iou in ious for v in literal_map(truth, predicted, iou, size, 1280 * 720 / 1e6).values()]
    for name, values in {"map50": mean("all", [0.5]), "map75": mean("all", [0.75]), "map50_95": mean("all", evaluate.OVERLAPS), **{s: mean(s, evaluate.OVERLAPS) for s in ("small", "medium", "large")}}.items():
        assert (got[name] is None) == (not values) and (not values or abs(got[name] - np.mean(values)) < 1e-9), name
    assert all(v is None for v in evaluate.mean_precision(t.limit(0), p.limit(0), 1280, 720).first())
    assert evaluate.mean_precision(t, p.limit(0), 1280, 720).first().map50 == 0.0


def test_class_report_by_hand(spark):
    c = spark.createDataFrame([("a", "a", 5), ("a", "b", 2), ("a", "nothing", 1), ("nothing", "b", 4), ("c", "nothing", 3)], "true string, predicted string, n long")
    got = {r.cls: tuple(r)[1:] for r in evaluate.class_report(c).collect()}
    assert got == {"a": (8, 5, 5, 0, 3, 1, 0), "b": (0, 6, 0, 6, 0, 0, 4), "c": (3, 0, 0, 0, 3, 3, 0)}
    totals = evaluate.box_totals(evaluate.class_report(c)).first()
    assert (totals.tp, totals.fp, totals.fn) == (5, 6, 6) and abs(totals.f1 - 5 / 11) < 1e-12
    assert tuple(evaluate.box_totals(evaluate.class_report(c.limit(0))).first()) == (0, 0, 0, 0.0, 0.0, 0.0)


def test_match_scores_by_hand(spark):
    m = spark.createDataFrame([(1, 0, "f0", 1.0), (1, 1, "f1", 3.0)], "run_id long, object_id long, finding_id string, distance_m double")
    f = spark.createDataFrame([(1, f"f{i}", "ab"[i % 2]) for i in range(4)] + [(2, "g", "z")], "run_id long, finding_id string, cls string")
    o = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (1, 2, "c")], "run_id long, object_id long, cls string")
    got = {r.run_id: r for r in evaluate.score_matches(m, f, o).collect()}
    assert (got[1].median_m, got[1].fp_classes, got[1].fn_classes, got[1].precision) == (3.0, ["a", "b"], ["c"], 50.0)
    assert (got[2].median_m, got[2].fp_classes, got[2].fn_classes, got[2].tp) == (None, ["z"], [], 0)


def test_ground_samples_reach_only_the_road_ahead(spark):
    depth = spark.createDataFrame([(0, y, x, float(y)) for y in range(72) for x in range(128)], "frame int, y int, x int, d double")
    rows = cloud.ground_samples(depth, 128, 72, 1280, 720, core.CAM).collect()
    assert 900 < len(rows) <= 60 * 18 and all(0 < r.ground_m <= 60 and r.d >= 36 for r in rows)
    assert more.found(spark, SF).count() == view(spark, SF, "fx_findings").count()


def test_import_without_frames(spark):
    tax = spark.createDataFrame([(0, "pothole", "Pothole")], "ord int, cls string, label string")
    rows = [(1, 1, "a", "0:09", "Pothole", "12.5", "77.5", "", "", " x "), (1, 2, "a", "2", "Pothole", "12.6", "77.6", "", "", ""), (1, 3, "  ", "3", "Pothole", "", "", "", "", None), (1, 4, "", "", "", "", "", "", "", ""), (2, 1, "b", "1", "Pothole", "", "", "", "", "")]
    df = spark.createDataFrame(rows, "run_id long, row_no long, object_id string, time string, defect_name string, lat string, lon string, severity string, confidence string, frame string")
    frames = spark.createDataFrame([(2, 0, "00001", 0.0, 1.0, 2.0)], "run_id long, frame_idx long, frame_id string, t_sec double, lat double, lon double")
    got = csvio.import_findings(df, frames, tax)
    assert sorted((r.run_id, r.row_no, r.finding_id, r.frame_id, r.lat) for r in got.collect()) == [(1, 1, "a", "x", 12.5), (1, 2, "a-2", "f_a", 12.6), (1, 3, "row-3", "f_  ", None), (2, 1, "b", "00001", 1.0)]
    assert [(r.run_id, r.frame_idx, r.frame_id, r.t_sec) for r in csvio.sparse_frames(got, frames).orderBy("frame_idx").collect()] == [(1, 0, "f_a", 2.0), (1, 1, "x", 9.0)]
    assert {r.run_id: (r.blank, r.renamed) for r in csvio.skipped_and_renamed(df, got).collect()} == {1: (1, 2), 2: (0, 0)}


def test_building_heights_by_any_tag(spark):
    square = [(0.0, 0.0), (0.0, 1e-4), (1e-4, 1e-4), (1e-4, 0.0)]
    tags = [{"height": "9 m"}, {"building:height": "7"}, {"height": "", "levels": "2;3"}, {"building:levels": "x"}, {"height": "tall", "levels": "10"}]
    e = spark.createDataFrame([("way", i, {"building": "yes", **t}, square) for i, t in enumerate(tags)], "type string, id long, tags map<string,string>, geometry array<struct<lat:double,lon:double>>")
    box = spark.createDataFrame([(1, -1.0, -1.0, 1.0, 1.0)], "run_id long, south double, west double, north double, east double")
    assert {r.osm_id: round(r.height_m, 6) for r in cloud.surroundings(e, box).collect()} == {0: 9.0, 1: 7.0, 2: 6.4, 3: 8.0, 4: 32.0}
