"""Findings and boxes against truth."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayside.functions import boxes, geo
from wayside.operators.findings import SPHERE_M_PER_DEG
from wayside.operators.grouped import in_groups
from wayside.sources.sinks import written


def match_findings(findings: DataFrame, objects: DataFrame, max_m: float | None = 8.0) -> DataFrame:
    """Each object of a class takes the nearest free finding, in order of objects; distance or null.

    With a ceiling, a finding that lies farther is not taken and stays free; then objects and
    findings whose latitudes part by more than the ceiling are separate groups. Without one the
    nearest is always taken, however far; see ``match_at_any_distance``.
    """
    if max_m is None:
        return match_at_any_distance(findings, objects)
    f = findings.select("run_id", "cls", F.lit(1).alias("kind"), F.col("finding_id").alias("name"), F.lit(0).cast("long").alias("ord"), "lat", "lon")
    o = objects.select("run_id", "cls", F.lit(0).alias("kind"), F.col("object_id").cast("string").alias("name"), F.col("object_id").cast("long").alias("ord"), "lat", "lon")
    both = f.unionByName(o).filter("lat is not null and lon is not null")
    w = Window.partitionBy("run_id", "cls").orderBy("lat", "kind", "name")
    gap = (F.col("lat") - F.lag("lat").over(w)) * SPHERE_M_PER_DEG
    apart = F.coalesce(gap > max_m, F.lit(False))
    split = both.withColumn("_new", apart.cast("int")).withColumn("island", F.sum("_new").over(w)).drop("_new")

    def kernel(rows: list[tuple]) -> list[tuple]:
        free = sorted((r for r in rows if r[2] == 1), key=lambda r: r[3])
        out = []
        for run, cls, _, _, ord_, lat, lon, _ in sorted((r for r in rows if r[2] == 0), key=lambda r: r[4]) if free else ():
            best, far = None, math.inf
            for y in free:
                p, q = math.radians(lat), math.radians(y[5])
                h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(y[6] - lon) / 2) ** 2
                d = 2 * geo.EARTH_RADIUS_M * math.asin(math.sqrt(h))
                if d < far:
                    best, far = y, d
            if best is not None and far <= max_m:
                free.remove(best)
                out.append((run, cls, ord_, best[3], far))
        return out

    return in_groups(split, ["run_id", "cls", "island"], kernel, "run_id long, cls string, object_id long, finding_id string, distance_m double")


#: Degrees of a cell of findings, one of which stands for all when the nearest is looked for.
MATCH_CELL_DEG = 0.001
FREE = (1 << 63) - 1


def match_at_any_distance(findings: DataFrame, objects: DataFrame, near_m: float = 8.0) -> DataFrame:
    """``match_findings`` without a ceiling, in rounds over all runs and classes together.

    That each object takes the nearest free finding in order of objects is the one stable matching in which findings
    prefer earlier objects. So objects may ask in any order: a finding keeps the earliest that asks, and who is refused or loses
    it asks the nearest that is free or held by a later object. Pairs within ``near_m`` are matched first, in groups that
    don't touch; then each round lets all objects that wait ask at once. One finding of each cell, the one that is easiest to
    get, bounds how far the nearest can be, so a run's findings are never compared one by one, and no group holds a run.
    """
    first = match_findings(findings, objects, near_m)
    keys = ["run_id", "cls"]
    place = lambda df: df.filter("lat is not null and lon is not null")
    asking = place(objects).select(*keys, F.col("object_id").cast("long").alias("ord"), F.col("lat").alias("o_lat"), F.col("lon").alias("o_lon"))
    cell = lambda c: F.floor(F.col(c) / MATCH_CELL_DEG)
    held = place(findings).select(*keys, "finding_id", "lat", "lon", cell("lat").alias("cy"), cell("lon").alias("cx"))
    held = held.join(first.select(*keys, "finding_id", F.col("object_id").alias("holder"), "distance_m"), [*keys, "finding_id"], "left")
    held = written(held.withColumn("holder", F.coalesce("holder", F.lit(FREE))), "held")
    waiting = written(asking.join(first.select(*keys, F.col("object_id").alias("ord")), [*keys, "ord"], "left_anti"), "waiting")
    far = geo.haversine_m(F.col("lat"), F.col("lon"), F.col("o_lat"), F.col("o_lon"))
    diagonal = MATCH_CELL_DEG * SPHERE_M_PER_DEG * 1.41422
    while not waiting.isEmpty():
        easiest = held.groupBy(*keys, "cy", "cx").agg(F.max(F.struct("holder", "lat", "lon")).alias("_e")).select(*keys, "cy", "cx", "_e.*")
        cells = waiting.join(easiest, keys).filter(F.col("holder") > F.col("ord")).withColumn("_d", far)
        least = F.min("_d").over(Window.partitionBy(*keys, "ord"))
        cells = cells.withColumn("_least", least).filter(F.col("_d") <= F.col("_least") + diagonal).drop("holder", "lat", "lon", "_d", "_least")
        within = cells.join(held, [*keys, "cy", "cx"]).filter(F.col("holder") > F.col("ord"))
        asked = within.groupBy(*keys, "ord", "o_lat", "o_lon").agg(F.min(F.struct(far.alias("d"), "finding_id")).alias("f"))
        asked = written(asked.select(*keys, "ord", "o_lat", "o_lon", "f.d", "f.finding_id"), "asked")
        won = asked.groupBy(*keys, "finding_id").agg(F.min(F.struct("ord", "d")).alias("w")).select(*keys, "finding_id", F.col("w.ord").alias("_new"), F.col("w.d").alias("_d"))
        both = held.join(won, [*keys, "finding_id"], "left")
        lost = both.filter(F.col("_new").isNotNull() & (F.col("holder") != FREE)).select(*keys, F.col("holder").alias("ord"))
        refused = asked.join(won.select(*keys, F.col("_new").alias("ord")), [*keys, "ord"], "left_anti").select(*keys, "ord")
        again = asking.join(lost.unionByName(refused), [*keys, "ord"], "left_semi")
        waiting = written(again, "waiting")
        taken = both.withColumns({"holder": F.coalesce("_new", "holder"), "distance_m": F.coalesce("_d", "distance_m")})
        held = written(taken.drop("_new", "_d"), "held")
    return held.filter(F.col("holder") != FREE).select(*keys, F.col("holder").alias("object_id"), "finding_id", "distance_m")


def unmatched_objects(matches: DataFrame, objects: DataFrame) -> DataFrame:
    """Objects (run_id, object_id, ...) that no finding was matched with."""
    return objects.join(matches.select("run_id", "object_id"), ["run_id", "object_id"], "left_anti")


def score_matches(matches: DataFrame, findings: DataFrame, objects: DataFrame) -> DataFrame:
    """Precision, recall, F1 (percent), upper median error, and the classes of false and missed ones of each run."""
    n = lambda df, name: df.groupBy("run_id").agg(F.count(F.lit(1)).alias(name))
    left = lambda df, key, name: df.join(matches.select("run_id", key), ["run_id", key], "left_anti").groupBy("run_id").agg(F.array_sort(F.collect_set("cls")).alias(name))
    m = matches.groupBy("run_id").agg(F.count(F.lit(1)).alias("tp"), F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY distance_m DESC)").alias("median_m"))
    every = n(findings, "found").join(n(objects, "placed"), "run_id", "full_outer").join(m, "run_id", "left").na.fill(0, ["found", "placed", "tp"])
    every = every.join(left(findings, "finding_id", "fp_classes"), "run_id", "left").join(left(objects, "object_id", "fn_classes"), "run_id", "left")
    p, r = F.coalesce(F.try_divide("tp", "found"), F.lit(0.0)), F.coalesce(F.try_divide("tp", "placed"), F.lit(0.0))
    return every.select(
        "run_id", "tp", "found", "placed", F.round(100 * p, 1).alias("precision"), F.round(100 * r, 1).alias("recall"),
        F.round(F.coalesce(F.try_divide(200 * p * r, p + r), F.lit(0.0)), 1).alias("f1"), "median_m",
        *[F.coalesce(c, F.array().cast("array<string>")).alias(c) for c in ("fp_classes", "fn_classes")],
    )


def _area(b) -> float:
    return max(0.0, b[2] - b[0]) * max(0.0, b[3] - b[1])


def _overlap(a, b) -> float | None:
    """Shared area over joint area of two boxes; null where both are flat."""
    both = max(0.0, min(a[2], b[2]) - max(a[0], b[0])) * max(0.0, min(a[3], b[3]) - max(a[1], b[1]))
    joint = _area(a) + _area(b) - both
    return both / joint if joint > 0 else None


def pair_boxes(truth: DataFrame, predicted: DataFrame, iou: float) -> DataFrame:
    """Within frame and class each prediction, surest first, takes the free truth it overlaps most.

    ``truth`` (image, cls, truth_id, box), ``predicted`` (image, cls, pred_id, confidence, box).
    Returns every prediction with the truth_id it takes, or null. A group is one image and class.
    """
    corners = [F.col(f"box.{c}").alias(c) for c in ("x1", "y1", "x2", "y2")]
    t = truth.select("image", "cls", F.lit(0).alias("kind"), F.col("truth_id").alias("ident"), F.lit(0.0).alias("confidence"), *corners)
    p = predicted.select("image", "cls", F.lit(1).alias("kind"), F.col("pred_id").alias("ident"), "confidence", *corners)

    def kernel(rows: list[tuple]) -> list[tuple]:
        free = sorted((r for r in rows if r[2] == 0), key=lambda r: r[3])
        out = []
        for r in sorted((r for r in rows if r[2] == 1), key=lambda r: (-r[4], r[3])):
            best, score = None, iou
            for q in free:
                over = _overlap(r[5:], q[5:])
                if over is not None and over >= score and (best is None or over > score):
                    best, score = q, over
            if best is not None:
                free.remove(best)
            out.append((r[0], r[1], r[3], r[4], best and best[3]))
        return out

    return in_groups(t.unionByName(p), ["image", "cls"], kernel, "image string, cls string, pred_id long, confidence double, truth_id long")


#: Bands of confidence in which predictions of a class are ordered apart.
BANDS = 1000


def average_precision(pairs: DataFrame, truth: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Average precision of each class, the mean of the best precision at 101 recalls (COCO's definition).

    A class without predictions has 0, one without truth none. Columns ``by`` of ``pairs`` part the
    predictions; ``truth`` may have some of them, and holds for all values of the others.
    """
    key = ["cls", *by]
    n = truth.groupBy([c for c in key if c in truth.columns]).agg(F.count(F.lit(1)).alias("n_truth"))
    shared = [c for c in key if c in n.columns]
    # hits and predictions above each band of confidence first, then those within the band, so that no task orders a class
    banded = pairs.withColumn("hit", F.col("truth_id").isNotNull().cast("int")).withColumn("band", F.floor(F.col("confidence") * BANDS))
    above = Window.partitionBy(*key).orderBy(F.col("band").desc()).rowsBetween(Window.unboundedPreceding, -1)
    bands = banded.groupBy(*key, "band").agg(F.sum("hit").alias("hits"), F.count(F.lit(1)).alias("rows")).select(
        *key, "band", F.coalesce(F.sum("hits").over(above), F.lit(0)).alias("tp_above"), F.coalesce(F.sum("rows").over(above), F.lit(0)).alias("k_above")
    )
    w = Window.partitionBy(*key, "band").orderBy(F.col("confidence").desc(), "image", "pred_id")
    curve = banded.withColumn("tp", F.sum("hit").over(w)).withColumn("k", F.row_number().over(w)).join(bands, [*key, "band"]).join(n, shared)
    curve = curve.withColumns({"tp": F.col("tp") + F.col("tp_above"), "k": F.col("k") + F.col("k_above")})
    curve = curve.select(*key, (F.col("tp") / F.col("n_truth")).alias("recall"), (F.col("tp") / F.col("k")).alias("precision"))
    # the best precision at each recall reached first, so that a prediction isn't one row for each recall below its own
    reached = curve.groupBy(*key, F.floor(F.col("recall") * 100 + 1e-9).cast("int").alias("to")).agg(F.max("precision").alias("precision"))
    points = reached.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("to"))))
    best = points.groupBy(*key, "i").agg(F.max("precision").alias("p")).groupBy(*key).agg((F.sum("p") / 101).alias("ap"))
    if shared == key:
        return n.join(best, key, "left").select(*key, F.coalesce("ap", F.lit(0.0)).alias("ap"))
    return best


# Fixed values of the public definition: overlaps from 0.50 to 0.95, and bounds of the area of small and medium boxes in pixels.
OVERLAPS = [round(0.5 + 0.05 * i, 2) for i in range(10)]
SMALL, MEDIUM = 32 * 32, 96 * 96
SIZES = ("all", "small", "medium", "large")


def pair_boxes_by_size(truth: DataFrame, predicted: DataFrame, width: int, height: int, overlaps: list[float] | None = None) -> DataFrame:
    """``pair_boxes`` at each overlap and for the truth of each size: image, cls, pred_id, confidence, iou, size, truth_id.

    Sizes are areas in pixels of a frame of ``width`` x ``height``. For one size the truth of
    others is taken only where none of its own will do; a prediction that takes such truth, or takes
    none and is of another size itself, counts neither way and is left out.
    """
    overlaps = overlaps or OVERLAPS
    corners = [F.col(f"box.{c}").alias(c) for c in ("x1", "y1", "x2", "y2")]
    t = truth.select("image", "cls", F.lit(0).alias("kind"), F.col("truth_id").alias("ident"), F.lit(0.0).alias("confidence"), *corners)
    p = predicted.select("image", "cls", F.lit(1).alias("kind"), F.col("pred_id").alias("ident"), "confidence", *corners)
    pixels = width * height / 1e6

    def kernel(rows: list[tuple]) -> list[tuple]:
        there = sorted((r for r in rows if r[2] == 0), key=lambda r: r[3])
        given = sorted((r for r in rows if r[2] == 1), key=lambda r: (-r[4], r[3]))
        size = lambda r: (lambda a: 1 + (a >= SMALL) + (a >= MEDIUM))(_area(r[5:]) * pixels)
        sizes = [size(r) for r in there]
        # of each prediction the truth that it overlaps, most first, the earlier of equal ones
        near = [sorted(((o, i) for i, q in enumerate(there) if (o := _overlap(r[5:], q[5:]))), key=lambda x: (-x[0], x[1])) for r in given]
        out = []
        for least in overlaps:
            for s, name in enumerate(SIZES):
                taken: set[int] = set()
                for r, ranked in zip(given, near, strict=True):
                    able = [i for o, i in ranked if o >= least and i not in taken]
                    best = next((i for i in able if s in (0, sizes[i])), able[0] if able else -1)
                    if best >= 0:
                        taken.add(best)
                        if s in (0, sizes[best]):
                            out.append((r[0], r[1], r[3], r[4], least, name, there[best][3]))
                    elif s == 0 or s == size(r):
                        out.append((r[0], r[1], r[3], r[4], least, name, None))
        return out

    kinds = "image string, cls string, pred_id long, confidence double, iou double, size string, truth_id long"
    return in_groups(t.unionByName(p), ["image", "cls"], kernel, kinds)


def mean_precision(truth: DataFrame, predicted: DataFrame, width: int, height: int) -> DataFrame:
    """One row: mean average precision over classes at 0.50, at 0.75, over OVERLAPS, and over them for each size.

    Null where there is no truth of that kind: nothing was asked, so nothing failed.
    """
    pixels = (F.col("box.x2") - F.col("box.x1")) * (F.col("box.y2") - F.col("box.y1")) * (width * height / 1e6)
    named = F.when(pixels < SMALL, "small").when(pixels < MEDIUM, "medium").otherwise("large")
    sized = truth.select("cls", F.explode(F.array(F.lit("all"), named)).alias("size"), F.explode(F.array(*map(F.lit, OVERLAPS))).alias("iou"))
    ap = average_precision(pair_boxes_by_size(truth, predicted, width, height), sized, ("size", "iou"))
    mean = lambda condition, name: F.avg(F.when(condition, F.col("ap"))).alias(name)
    whole = F.col("size") == "all"
    return ap.agg(
        mean(whole & (F.col("iou") == 0.5), "map50"), mean(whole & (F.col("iou") == 0.75), "map75"), mean(whole, "map50_95"),
        *[mean(F.col("size") == s, s) for s in SIZES[1:]],
    )


def class_report(confused: DataFrame) -> DataFrame:
    """For each class of a confusion (true, predicted, n) its truth and predictions, right, false and lacking ones.

    ``missed`` is truth that nothing overlapped, ``invented`` predictions that overlapped nothing;
    what is left of fn and fp took another class. Classes that occur on neither side aren't listed.
    """
    each = confused.withColumn("cls", F.explode(F.array_distinct(F.array("true", "predicted")))).filter("cls <> 'nothing'")
    total = lambda condition: F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0))
    truth, given = (lambda c: F.col("true") == c), (lambda c: F.col("predicted") == c)
    own = F.col("cls")
    gt, pred, tp = total(truth(own)), total(given(own)), total(truth(own) & given(own))
    return each.groupBy("cls").agg(
        gt.alias("gt"), pred.alias("pred"), tp.alias("tp"), (pred - tp).alias("fp"), (gt - tp).alias("fn"),
        total(truth(own) & given("nothing")).alias("missed"), total(given(own) & truth("nothing")).alias("invented"),
    )


def box_totals(report: DataFrame) -> DataFrame:
    """One row: right, false and lacking boxes of all classes, with precision, recall and F1 (0 where undefined)."""
    r = report.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tp", "fp", "fn")])
    over = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    p, q = over(F.col("tp"), F.col("tp") + F.col("fp")), over(F.col("tp"), F.col("tp") + F.col("fn"))
    return r.select("*", p.alias("precision"), q.alias("recall"), over(2 * p * q, p + q).alias("f1"))


def confusion(truth: DataFrame, predicted: DataFrame, iou: float, confidence: float) -> DataFrame:
    """Counts of (true class, predicted class) at an overlap and a confidence; ``nothing`` on either side."""
    sure = predicted.filter(F.col("confidence") >= confidence)
    pairs = pair_boxes(truth.withColumn("_c", F.col("cls")).withColumn("cls", F.lit("any")), sure.withColumn("cls", F.lit("any")), iou)
    named = pairs.join(sure.select("image", "pred_id", F.col("cls").alias("predicted")), ["image", "pred_id"]).select("image", "truth_id", "predicted")
    every = named.filter("truth_id is not null").join(truth.select("image", "truth_id", F.col("cls").alias("true")), ["image", "truth_id"], "full_outer")
    ghosts = named.filter("truth_id is null").select(F.lit("nothing").alias("true"), "predicted")
    return (
        every.select(F.coalesce("true", F.lit("nothing")).alias("true"), F.coalesce("predicted", F.lit("nothing")).alias("predicted")).unionByName(ghosts)
        .groupBy("true", "predicted").agg(F.count(F.lit(1)).alias("n"))
    )


def join_on_time(frames: DataFrame, truth: DataFrame) -> DataFrame:
    """Truth (run_id, key, ...) on frames by their time to two places; frames without a key stay out."""
    return frames.withColumn("key", F.format_string("%.2f", "t_sec")).join(truth, ["run_id", "key"])


def on_legs(keypoints: DataFrame, frames: DataFrame, lone: bool = False, bucket_s: float = 10.0) -> DataFrame:
    """Boxes (run_id, obj, frame_idx, box) on frames between hand-marked ones, linear in time, clamped, as they come out.

    ``lone`` marks count on a frame at their very time. Frames meet legs in buckets of time, not by run alone.
    """
    w = Window.partitionBy("run_id", "obj").orderBy("t")
    follows = F.lead("t").over(w)
    end = F.when(follows.isNull() & F.lag("t").over(w).isNull(), F.col("t")).otherwise(follows) if lone else follows
    legs = keypoints.withColumns({"t2": end, "box2": F.coalesce(F.lead("box").over(w), "box")}).filter("t2 is not null").withColumn("leg", F.row_number().over(w))
    bucket = lambda c: F.floor(F.col(c) / bucket_s)
    legs = legs.withColumn("_b", F.explode(F.sequence(bucket("t"), bucket("t2"))))
    f = F.coalesce(F.try_divide(F.col("t_sec") - F.col("t"), F.col("t2") - F.col("t")), F.lit(0.0))
    at = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1000.0), F.col(f"box.{c}") + (F.col(f"box2.{c}") - F.col(f"box.{c}")) * f))
    hit = frames.select("run_id", "frame_idx", "t_sec", bucket("t_sec").alias("_b")).join(legs, ["run_id", "_b"]).filter(F.col("t_sec").between(F.col("t"), F.col("t2")))
    once = hit.withColumn("_n", F.row_number().over(Window.partitionBy("run_id", "obj", "frame_idx").orderBy("leg"))).filter("_n = 1")
    return once.select("run_id", "obj", "frame_idx", boxes.make_box(at("x1"), at("y1"), at("x2"), at("y2")).alias("box"))


def box_track(keypoints: DataFrame, frames: DataFrame) -> DataFrame:
    """Boxes on frames between hand-marked ones (run_id, obj, t, box), linear in time, none outside."""
    return on_legs(keypoints, frames).filter("box.x2 > box.x1 and box.y2 > box.y1")


def compare_runs(a: DataFrame, b: DataFrame) -> DataFrame:
    """Metric rows (name, value) of two runs side by side with their difference."""
    return a.toDF("name", "a").join(b.toDF("name", "b"), "name", "full_outer").withColumn("delta", F.col("b") - F.col("a"))
