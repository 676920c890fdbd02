"""What keeps queries within bounds on large tables, told from plans and from small tables."""

import pytest
from pyspark.sql import functions as F

from wayside.operators import evaluate, perception, roadgate, zone
from wayside.operators.grouped import in_groups
from wayside.plans import registry

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().toString()


def test_groups_go_on_over_batches(spark):
    """A group is one call of the kernel, however its rows lie in batches; empty tables give none."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        df = spark.range(40).select((F.col("id") % 4).alias("g"), F.col("id").alias("v"))
        count = lambda rows: [(rows[0][0], len(rows), sum(r[1] for r in rows))]
        got = in_groups(df, ["g"], count, "g long, n long, total long")
        assert sorted(map(tuple, got.collect())) == [(g, 10, sum(range(g, 40, 4))) for g in range(4)]
        assert in_groups(df.limit(0), ["g"], count, "g long, n long, total long").collect() == []
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.mark.parametrize("query", ["g7_suppress", "i9_ensemble_merge", "d11_match_findings", "e18_average_precision", "e19_confusion", "e18_mean_precision", "g11_largest_component"])
def test_small_groups_cost_no_call_each(spark, query):
    assert "FlatMapGroupsInArrow" not in plan(registry.QUERIES[query](spark, SF))


def test_recalls_are_spread_after_the_best_of_each(spark):
    """The curve is cut to one row for each recall before it is spread over those below."""
    truth = spark.createDataFrame([("i", "a", n) for n in range(3)], "image string, cls string, truth_id long")
    pairs = spark.createDataFrame([("i", "a", 1, 0.9, 0), ("i", "a", 2, 0.8, None), ("i", "a", 3, 0.7, 2)], "image string, cls string, pred_id long, confidence double, truth_id long")
    ap = evaluate.average_precision(pairs, truth)
    assert abs(ap.first().ap - (34 * 1.0 + 33 * 2 / 3) / 101) < 1e-12
    text = ap._jdf.queryExecution().optimizedPlan().toString()
    assert text.index("Generate explode(sequence") < text.index("max(precision", text.index("Generate explode(sequence"))


def test_exploded_masks_are_not_broadcast(spark):
    """Runs of masks have many more rows than the size of what they are exploded from tells."""
    masks = spark.range(3).select(F.lit(1).cast("long").alias("run_id"), F.col("id").cast("string").alias("frame_id"), F.explode(F.expr("sequence(0L, 200L)")).alias("row_no"), F.lit(0).cast("long").alias("col_start"), F.lit(9).cast("long").alias("col_end"))
    d = spark.sql("SELECT 1L AS run_id, '1' AS frame_id, 5L AS det_seq, 'a' AS cls, 'point' AS geometry, named_struct('x1', 1D, 'y1', 1D, 'x2', 2D, 'y2', 20D) AS box")
    rules, zones = spark.sql("SELECT 'a' AS cls, true AS carriageway_only"), spark.sql("SELECT 1L AS run_id, '2' AS frame_id, array(named_struct('x', 0D, 'y', 0D)) AS polygon")
    r = roadgate.verdicts(d, rules, zones, masks, 1280, 720)
    assert r.first().on_mask is True
    assert r._jdf.queryExecution().optimizedPlan().toString().count("Hint=(strategy=merge)") >= 3
    spans = masks.select("run_id", F.col("frame_id").alias("frame"), "row_no", F.lit(0).alias("left_px"), F.lit(5).alias("pixels"))
    assert "BroadcastHashJoin" not in plan(zone.fit_rows(spans))


def test_indexes_at_a_tie_go_up(spark):
    """100 - 4.4 * 10.375 is 54.35, of which a sum of doubles may lack the last bit; the index is 54.4 all the same."""
    from wayside.operators import score

    got = spark.createDataFrame([(54.349999999999994,), (60.949999999999996,), (29.049999999999997,), (54.34,), (5.0,)], "v double").select(score.to_tenth(F.col("v")).alias("r"))
    assert [r.r for r in got.collect()] == [54.4, 61.0, 29.1, 54.3, 5.0]


def test_map_documents_grow_in_number(spark, tmp_path):
    """More orders make more documents, none of them larger."""
    from wayside.plans import further

    before = further.scratch
    further.scratch = lambda s: str(tmp_path)
    try:
        further.features(spark, "/root/testdata/sf0.01")
    finally:
        further.scratch = before
    orders = spark.read.parquet("/root/testdata/sf0.01/lineitem.parquet").agg(F.max("l_orderkey")).first()[0]
    assert len(list(tmp_path.glob("map-*/part=*"))) == orders // 4096 + 1
    lines = max(sum(1 for _ in spark.read.text(str(p)).toLocalIterator()) for p in list(tmp_path.glob("map-*/part=*"))[:1])
    assert 4096 < lines < 40000


def test_decimals_follow_the_exact_value(spark):
    """Doubles whose text ends in a 5 after the last place lie above or below the tie; exact ties go to the even digit."""
    from wayside.functions import text

    values = [round(12.9 + i * 0.0137, 8) + 5e-9 for i in range(400)] + [0.001953125, -77.001953125, -0.5, 0.0, 3e-9, 12.999999996, 77.5946, -1e-9]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", text.fixed(F.col("v")).alias("t")).collect()
    assert [r.t for r in rows] == ["%.8f" % r.v for r in rows]


def test_nearest_frames_are_looked_for_in_the_own_cell_first(spark):
    """Only places whose nearest frame may lie beyond their cell's edge are spread over the cells around; all get their nearest."""
    from wayside.operators import absence

    frames = spark.createDataFrame([(1, 0, 0.0005, 0.0005), (1, 1, 0.0011, 0.0005), (1, 2, 0.02, 0.02)], "run_id long, frame_idx long, lat double, lon double")
    places = spark.createDataFrame([(1, "inside", 0.0005, 0.0006), (1, "edge", 0.00099, 0.0005), (1, "far", 0.05, 0.05), (1, "none", None, None)], "run_id long, finding_id string, lat double, lon double")
    r = absence.nearest_frame(places, frames, ["finding_id"])
    assert {x.finding_id: x.frame_idx for x in r.collect()} == {"inside": 0, "edge": 1, "far": 2}
    assert any("own_cell-" in p for p in r.inputFiles())


def test_runs_of_appended_detections_share_folders(spark, tmp_path):
    """A thousand runs are no more folders than ``FOLDERS``, and a run's lines lie in its own."""
    from wayside.plans.catalogue import STAND_IN
    from wayside.streaming import live

    sent, out = str(tmp_path / "frames"), str(tmp_path / "out")
    spark.range(1000).select(F.col("id").alias("run_id"), F.lit("00001").alias("frame_id"), F.lit(0).cast("long").alias("frame_idx")).coalesce(1).write.parquet(sent)
    stream = spark.readStream.schema(spark.read.parquet(sent).schema).parquet(sent)
    live.append_detections(stream, STAND_IN["stand_in"], out, out + "-log").awaitTermination()
    assert len(list((tmp_path / "out").glob("*=*"))) == live.FOLDERS
    got = spark.read.json(out)
    assert sorted(r.run_id for r in got.collect()) == list(range(1000))
    assert got.filter(F.col("folder") != live.folder_of(F.col("run_id"))).count() == 0


def test_rows_of_masks_are_sorted_once(spark):
    """Rows of masks have their spans from one sort and no table of all rows; as counted pixel by pixel."""
    import random

    rnd = random.Random(5)
    runs = [(f, r, a, a + rnd.randrange(9)) for f in range(6) for r in range(20) for a in (rnd.randrange(60) for _ in range(rnd.randrange(1, 7)))]
    got = zone.row_spans(spark.createDataFrame(runs, "frame long, row_no long, col_start long, col_end long"))
    executed = got._jdf.queryExecution().sparkPlan().toString()
    assert "Aggregate" not in executed
    want = {}
    for f, r, a, b in runs:
        want.setdefault((f, r), set()).update(range(a, b + 1))
    literal = []
    for (f, r), px in want.items():
        longest = max(next(n for n in range(1, 99) if p + n not in px) for p in px)
        literal.append((f, r, min(px), max(px), max(px) - min(px) + 1, longest, len(px)))
    assert sorted(map(tuple, got.collect())) == sorted(literal)


def test_tracks_pass_through_the_kernel_and_are_not_joined_back(spark):
    from wayside.operators.findings import build_tracks

    seen = [(1, "pothole", f, s, (10.0, 500.0, 90.0, 560.0), "x") for f, s in ((0, 5), (1, 6), (1, 6), (9, 7))]
    df = spark.createDataFrame(seen, "run_id long, cls string, frame_idx long, det_seq long, box struct<x1:double,y1:double,x2:double,y2:double>, more string")
    tracks = build_tracks(df)
    assert sorted((r.det_seq, r.more) for r in tracks.collect()) == [(5, "x"), (6, "x"), (6, "x"), (7, "x")]
    assert "Join" not in plan(tracks)


def test_folds_go_through_runs_in_a_task(spark):
    from wayside.operators.route import segment_cuts

    along = spark.range(3000).selectExpr("id % 500 AS run_id", "id div 500 AS frame_idx", "(id div 500) * 12.0D AS cum_m")
    cuts = segment_cuts(along, 20.0, along)
    assert "FlatMapGroups" not in plan(cuts)
    rows = {(r.run_id, r.frame_idx) for r in cuts.collect()}
    assert rows == {(run, frame) for run in range(500) for frame in (0, 2, 4, 5)}


def test_confidence_is_summed_in_order_of_the_evidence(spark):
    from wayside.operators.findings import roll_up

    conf = [0.1, 0.7, 1e16, -1e16, 0.2]
    rows = [(1, "crack", 0, 0, i, i, f"{i:05}", None, 3, conf[i], 1.0, 2.0, None, float(i)) for i in (3, 1, 4, 0, 2)]
    kinds = "run_id long, cls string, cluster long, part int, frame_idx long, det_seq long, frame_id string, box struct<x1:double,y1:double,x2:double,y2:double>, severity int, confidence double, lat double, lon double, range_m double, t_sec double"
    names = spark.createDataFrame([("crack", "Crack", "point", 0)], "cls string, label string, geometry string, ord int")
    mean = (((0.1 + 0.7) + 1e16) - 1e16 + 0.2) / 5
    found = roll_up(spark.createDataFrame(rows, kinds), names).collect()
    assert [r.confidence for r in found] == [round(mean, 3)]
    assert [e.frame_idx for e in found[0].evidence] == [0, 1, 2, 3, 4]


def test_tours_find_their_stops_once(spark):
    from wayside.operators import mapdoc

    frames = spark.createDataFrame([(1, i, 1.0 + i, 2.0) for i in (2, 0, 1)], "run_id long, frame_idx long, lat double, lon double")
    found = spark.createDataFrame([(1, f"f-{i}", i, float(i), 1.0, 2.0) for i in range(4)], "run_id long, finding_id string, severity int, t_sec double, lat double, lon double")
    lines = mapdoc.tour_lines(found, frames, 2)
    assert "Window" not in plan(lines) and "SortAggregate" not in plan(lines)
    rows = sorted((r.item, r.step, r.line) for r in lines.collect())
    assert [r[:2] for r in rows] == [(0, 0), (1, 0), (1, 1), (1, 2), (3, 0)]
    assert "<latitude>1.00000000</latitude>" in rows[1][2]


def test_no_order_of_rows_decides_an_index_at_a_tie(spark):
    """42.9 over 22.21 m, 89 over 19.18 m and 44.5 over 21.29 m have a mean of 57.55, of which the sum in one of the two orders lacks the last bit."""
    from wayside.operators import score

    rows = [(1, 42.9, 22.21), (1, 89.0, 19.18), (1, 44.5, 21.29)]
    none = spark.createDataFrame([], "run_id long, cls string, severity int")
    for r in (rows, rows[::-1]):
        segments = spark.createDataFrame(r, "run_id long, quality_index double, length_m double").coalesce(1)
        got = score.summarize(none, segments).first()
        assert (got.quality_index, got.route_length_m, got.raw_length_m) == (57.6, 62.7, 62.68)


def test_penalties_have_one_sum_in_any_order(spark):
    from itertools import permutations

    from wayside.operators import score

    names = spark.createDataFrame([("a", 3.0), ("b", 2.5), ("c", 1.0)], "cls string, weight double")
    found = [("a", 3, 0.39), ("b", 3, 0.79), ("c", 1, 0.44)]
    orders = list(enumerate(permutations(found)))
    f = spark.createDataFrame([(run, f"f-{t}", float(t), *x) for run, order in orders for t, x in enumerate(order)], "run_id long, finding_id string, t_sec double, cls string, severity int, confidence double")
    segments = spark.createDataFrame([(run, 0.0, 0) for run, _ in orders], "run_id long, t_start double, seg_id int")
    got = score.members_of(segments, f, names).collect()
    assert len(got) == 6 and {r.penalty for r in got} == {(1.0 * 0.44 + 9.0 * 0.39) + 7.5 * 0.79}


def test_masks_in_a_row_are_fitted_where_they_lie(spark):
    """Whole masks give the fits of their runs, and none of their rows is shuffled; the horizons rest on one shuffle of fits."""
    import random

    from wayside.plans import catalogue

    rnd = random.Random(11)
    rows = []
    for f in range(40):
        top, rate = rnd.randrange(50), rnd.uniform(0.2, 3.0)
        for r in range(top, top + rnd.randrange(20, 130)):
            half = int((r - top + 5) * rate) + rnd.randrange(4)
            for _ in range(rnd.randrange(1, 4)):
                rows.append((7, f, r, 300 - half + rnd.randrange(half + 1), 300 + half - rnd.randrange(half + 1)))
    rnd.shuffle(rows)
    runs = spark.createDataFrame(rows, "run_id long, frame long, row_no long, col_start long, col_end long")
    masks = runs.groupBy("run_id", "frame").agg(F.collect_list(F.struct("row_no", "col_start", "col_end")).alias("mask"))
    none = spark.createDataFrame([(7, 90, None), (7, 91, []), (7, 92, [(None, 1, 2), (3, None, 5)])], "run_id long, frame long, mask array<struct<row_no:long,col_start:long,col_end:long>>")
    want = zone.horizon_fit(zone.fit_rows(zone.row_spans(runs), 30, 0.3, 60), 600).collect()
    got = {r.frame: r for r in zone.mask_fits(masks.unionByName(none), 600, 30, 0.3, 60).collect()}
    assert len(want) == len(got) > 10 and any(r.frame not in got for r in runs.select("frame").distinct().collect())
    for r in want:
        assert all(abs(r[c] - got[r.frame][c]) < 1e-9 * max(1, abs(r[c])) for c in ("horizon", "slope", "r2"))
    assert "Exchange" not in plan(zone.mask_fits(none.limit(0), 600))
    text = plan(catalogue.horizons(spark, SF)).split("== Physical Plan ==")[-1]
    assert "Join" not in text and "Generate" not in text and text.count("Exchange") == 2


def test_frames_are_suppressed_without_joins(spark):
    """Rows keep their columns through the kernel, however frames lie in batches and whatever their sizes; one shuffle at most."""
    import random

    rnd = random.Random(3)
    rows = []
    for run, frame, n in [(1, "a", 1), (1, "b", 40), (2, "a", 7), (2, "b", 3), (2, "c", 90)]:
        for seq in range(n):
            x, y = rnd.randrange(60), rnd.randrange(60)
            rows.append((run, frame, rnd.choice(["p", "q", None]), seq, rnd.choice([0.5, 0.7, rnd.random()]), (float(x), float(y), x + 30.0, y + 30.0), f"{run}{frame}{seq}"))
    literal = []
    for run, frame in {r[:2] for r in rows}:
        kept = []
        for r in sorted((r for r in rows if r[:2] == (run, frame)), key=lambda r: (-r[4], r[3])):
            if all(k[2] != r[2] or perception._iou(k[5], r[5]) <= 0.3 for k in kept):
                kept.append(r)
        literal += kept[:12]
    rnd.shuffle(rows)
    df = spark.createDataFrame([*rows, (None, "a", "p", 1, 0.9, (0.0, 0.0, 9.0, 9.0), "")], "run_id long, frame_id string, cls string, det_seq long, confidence double, box struct<x1:double,y1:double,x2:double,y2:double>, more string")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        got = perception.suppress(df, 0.3, 12)
        assert sorted(r.more for r in got.collect()) == sorted(r[6] for r in literal)
        assert perception.suppress(df.limit(0)).collect() == []
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    text = plan(perception.suppress(df, 0.3, 12)).split("== Physical Plan ==")[-1]
    assert "Join" not in text and "Window" not in text and text.count("Exchange") == 1


def test_whole_looks_are_merged_where_they_lie(spark):
    """Frames with their looks and anchors in a row give what the rows of both give; the query shuffles only its frames' events."""
    from wayside.operators import tiles
    from wayside.plans import further

    frames = spark.createDataFrame([(1, "f", 1280, 720), (2, "f", 600, 500), (3, "f", 1920, 1080)], "run_id long, frame_id string, width int, height int")
    n = lambda look, k, i, top: (F.pmod(F.xxhash64("run_id", look, k, F.lit(i)), F.lit(top * 10)) / 10.0)
    sides = lambda look, k: [n(look, k, i, top).alias(c) for i, (c, top) in enumerate([("cx", 640), ("cy", 640), ("w", 200), ("h", 200)])]
    scores = lambda look, k: F.when(k == 7, F.lit(None)).otherwise(F.array(n(look, k, 8, 1), n(look, k, 9, 1), F.lit(0.5))).alias("scores")
    packed = tiles.whole_looks(frames).withColumn("looks", F.transform("looks", lambda t: t.withField("anchors", F.transform(
        F.sequence(F.lit(0).cast("long"), F.lit(15).cast("long")), lambda k: F.struct(k.alias("anchor_id"), *sides(t["look"], k), scores(t["look"], k))))))
    hollow = packed.withColumn("run_id", F.col("run_id") + 9).withColumn("looks", F.when(F.col("run_id") == 10, F.slice("looks", 1, 0)).when(F.col("run_id") == 11, F.transform("looks", lambda t: t.withField("anchors", F.slice(t["anchors"], 1, 0)))))
    known, classes = spark.createDataFrame([("a", "A"), ("c", "C")], "cls string, label string"), ["a", "b", "c"]
    seen = tiles.looks(frames)
    anchors = packed.select("run_id", "frame_id", F.explode("looks").alias("t")).select("run_id", "frame_id", "t.look", F.explode("t.anchors").alias("a")).select("run_id", "frame_id", "look", "a.*")
    want = tiles.merge_looks(anchors, seen, classes, known, threshold=0.4).collect()
    got = tiles.merge_whole_looks(packed.unionByName(hollow), classes, known, threshold=0.4)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want)) and len(want) > 20
    assert "Exchange" not in plan(tiles.merge_whole_looks(packed, classes)).split("== Physical Plan ==")[-1]
    text = plan(further.merged_looks(spark, SF)).split("== Physical Plan ==")[-1]
    assert "SortMergeJoin" not in text and text.count("Exchange hashpartitioning") == 1
