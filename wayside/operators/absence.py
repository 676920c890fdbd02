"""Stretches of route on which a required asset was never seen."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayside.functions import geo
from wayside.operators.route import chainage
from wayside.sources.sinks import written

#: Metres of a bucket in which a place along a route is looked up.
CHAINAGE_BUCKET_M = 100.0
#: Degrees of a grid cell in which the nearest frame is looked for first.
CELL_DEG = 0.001
#: No two places of a cell are farther apart: the diagonal of its sides by great circle, and a little.
DIAGONAL_M = CELL_DEG * geo.EARTH_RADIUS_M * 3.14159266 / 180 * 1.41422


def nearest_frame(places: DataFrame, frames: DataFrame, key: list[str]) -> DataFrame:
    """``places`` (run_id, key, lat, lon) with frame_idx of the nearest frame, the lowest of equal ones.

    Frames in a place's own cell are compared first; a result nearer than the cell's edge is final. For other places frames
    in the cells around are compared; a result nearer than the rim of those cells is final. For
    other places one frame stands for each cell: only cells whose frame lies at most a cell's diagonal farther than the
    nearest of these can hold the nearest frame, so only their frames are compared.
    """
    cell = lambda c: F.floor(F.col(c) / CELL_DEG)
    f = frames.select("run_id", "frame_idx", F.col("lat").alias("f_lat"), F.col("lon").alias("f_lon"), cell("lat").alias("cy"), cell("lon").alias("cx"))
    around = F.explode(F.flatten(F.transform(F.sequence(F.lit(-1), F.lit(1)), lambda dy: F.transform(F.sequence(F.lit(-1), F.lit(1)), lambda dx: F.struct((cell("lat") + dy).alias("cy"), (cell("lon") + dx).alias("cx"))))))
    far = geo.haversine_m(F.col("f_lat"), F.col("f_lon"), F.col("lat"), F.col("lon"))
    best = F.min(F.struct(far.alias("d"), "frame_idx")).alias("best")
    keys = ["run_id", *key]
    rim = F.least(geo.M_PER_DEG_LAT * F.lit(CELL_DEG), geo.m_per_deg_lon(F.col("lat")) * CELL_DEG) * 0.99
    # metres to the nearest edge of the place's own cell
    edge = lambda c, m: F.least(F.col(c) - cell(c) * CELL_DEG, (cell(c) + 1) * CELL_DEG - F.col(c)) * m * 0.99
    rim_own = F.least(edge("lat", geo.M_PER_DEG_LAT), edge("lon", geo.m_per_deg_lon(F.col("lat"))))
    own = places.withColumns({"cy": cell("lat"), "cx": cell("lon")}).join(f, ["run_id", "cy", "cx"], "left").groupBy(*keys, "lat", "lon").agg(best)
    own = written(own.withColumn("_final", F.coalesce(F.col("best.d") <= rim_own, F.lit(False))), "own_cell")  # read for what is final and for what is not
    final, places = own.filter("_final").drop("_final"), own.filter("not _final").drop("_final", "best")
    close = written(places.withColumn("_c", around).select("*", "_c.*").join(f, ["run_id", "cy", "cx"]).groupBy(*keys, "lat", "lon").agg(best).filter(F.col("best.d") <= rim), "close")
    rest = places.join(close.select(*keys), keys, "left_anti")
    one = f.groupBy("run_id", "cy", "cx").agg(F.min(F.struct("frame_idx", "f_lat", "f_lon")).alias("_f")).select("run_id", "cy", "cx", "_f.f_lat", "_f.f_lon")
    reach = Window.partitionBy(*keys)
    cells = rest.join(one, "run_id").withColumn("_d", far).withColumn("_least", F.min("_d").over(reach)).filter(F.col("_d") <= F.col("_least") + DIAGONAL_M)
    distant = cells.drop("f_lat", "f_lon").join(f, ["run_id", "cy", "cx"]).groupBy(*keys, "lat", "lon").agg(best)
    return final.unionByName(close).unionByName(distant).select(*keys, F.col("best.frame_idx").alias("frame_idx"), F.col("best.d").alias("distance_m"))


def at_distance(targets: DataFrame, frames: DataFrame, along: DataFrame | None = None) -> DataFrame:
    """``targets`` (run_id, target_m, ...) with the place that far along the run and its frame.

    Clamped to the ends. Frames' stretches are cut into buckets of 100 m, so the range join has an
    equal key besides the run. ``along`` is the frames' chainage, where it is known.
    """
    w = Window.partitionBy("run_id").orderBy("frame_idx")
    c = (chainage(frames) if along is None else along).select("run_id", "frame_idx", "lat", "lon", "cum_m")
    here = F.struct("frame_idx", "lat", "lon", "cum_m")
    legs = c.withColumn("hi", here).withColumn("lo", F.lag(here).over(w)).filter("lo is not null").select("run_id", "lo", "hi")
    bucket = lambda x: F.floor(x / CHAINAGE_BUCKET_M)
    spread = legs.withColumn("_b", F.explode(F.sequence(bucket(F.col("lo.cum_m")), bucket(F.col("hi.cum_m")))))
    # numbers by themselves are summed up in a hash table, structs would have to be sorted
    end = lambda idx, by, name: F.struct(idx("frame_idx").alias("frame_idx"), *[by(n, "frame_idx").alias(n) for n in ("lat", "lon", "cum_m")]).alias(name)
    ends = c.groupBy("run_id").agg(end(F.min, F.min_by, "first"), end(F.max, F.max_by, "last"))
    t = targets.join(ends, "run_id").withColumn("_b", bucket(F.col("target_m")))
    hit = t.join(spread.withColumnRenamed("run_id", "_run"), (F.col("run_id") == F.col("_run")) & (t["_b"] == spread["_b"]) & (F.col("target_m") > F.col("lo.cum_m")) & (F.col("target_m") <= F.col("hi.cum_m")), "left")
    f = (F.col("target_m") - F.col("lo.cum_m")) / (F.col("hi.cum_m") - F.col("lo.cum_m"))
    before, after = F.col("target_m") <= 0, F.col("target_m") >= F.col("last.cum_m")
    lerp = lambda n: F.when(before, F.col(f"first.{n}")).when(after, F.col(f"last.{n}")).otherwise(F.col(f"lo.{n}") + (F.col(f"hi.{n}") - F.col(f"lo.{n}")) * f)
    frame = F.when(before, F.col("first.frame_idx")).when(after, F.col("last.frame_idx")).when(f < 0.5, F.col("lo.frame_idx")).otherwise(F.col("hi.frame_idx"))
    return hit.select(*targets.columns, lerp("lat").alias("lat"), lerp("lon").alias("lon"), frame.alias("frame_idx"))


def absence_gaps(frames: DataFrame, findings: DataFrame, rules: DataFrame, detectable: list[str] | None = None, by_run: DataFrame | None = None, along: DataFrame | None = None) -> DataFrame:
    """Gaps of at least min_gap_m between sightings of each rule's asset along each run.

    The run's two ends stand as sightings; without any other the whole run is one gap. Runs of one
    frame have none. ``detectable`` leaves out rules whose asset no run's model can see; ``by_run`` (run_id, absence_key,
    detectable; see ``checks.rules_by_run``) leaves out those that a run's own model can't. ``along`` is the frames' chainage, where it is known.
    """
    if detectable is not None:
        rules = rules.filter(F.col("asset").isin(detectable))
    c = (chainage(frames) if along is None else along).select("run_id", "frame_idx", "cum_m")
    total = c.groupBy("run_id").agg(F.max("cum_m").alias("total_m"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    every = total.crossJoin(F.broadcast(rules))
    if by_run is not None:
        every = every.join(by_run.filter("detectable").select("run_id", "absence_key"), ["run_id", "absence_key"], "left_semi")
    assets = findings.filter("lat is not null and lon is not null").join(F.broadcast(rules.select("asset")), F.col("cls") == F.col("asset"), "left_semi")
    near = nearest_frame(assets.select("run_id", "finding_id", "cls", "lat", "lon"), frames, ["finding_id", "cls"])
    at = near.join(c, ["run_id", "frame_idx"]).select("run_id", F.col("cls").alias("asset"), F.col("cum_m").alias("at"))
    seen = every.join(at, ["run_id", "asset"]).withColumn("_real", F.lit(1))
    ends = every.withColumn("at", F.explode(F.array(F.lit(0.0), F.col("total_m")))).withColumn("_real", F.lit(0))
    w = Window.partitionBy("run_id", "rule_ord").orderBy("at", "_real")
    gaps = (
        seen.unionByName(ends).withColumn("start_m", F.lag("at").over(w)).withColumn("any_asset", F.max("_real").over(Window.partitionBy("run_id", "rule_ord")) == 1)
        .filter("at - start_m >= min_gap_m").withColumnRenamed("at", "end_m").drop("_real")
    )
    return at_distance(gaps.withColumn("target_m", (F.col("start_m") + F.col("end_m")) / 2), frames, along)


def infer_absences(gaps: DataFrame, frames: DataFrame) -> DataFrame:
    """A finding for each gap, at its middle, less sure the shorter it is."""
    ratio = (F.col("end_m") - F.col("start_m")) / F.greatest("min_gap_m", F.lit(1e-6))
    rank = F.row_number().over(Window.partitionBy("run_id").orderBy("rule_ord", "start_m")) - 1
    covered = F.when(F.col("any_asset"), F.format_string("%.0f m", F.col("end_m") - F.col("start_m"))).otherwise("the entire surveyed route")
    t = frames.select("run_id", "frame_idx", "frame_id", "t_sec")
    return gaps.join(t, ["run_id", "frame_idx"]).select(
        "run_id", F.concat(F.lit("a-"), F.lpad(rank.cast("string"), 4, "0")).alias("finding_id"), F.col("absence_key").alias("cls"),
        F.col("absence_label").alias("label"), F.lit("segment").alias("geometry"), "lat", "lon", "severity",
        F.round(F.least(F.lit(0.90), 0.45 + 0.15 * (ratio - 1.0)), 3).alias("confidence"), "t_sec", "frame_id", "start_m", "end_m",
        F.format_string("No %s seen over %s (threshold %.0f m); inferred, not observed.", "asset", covered, "min_gap_m").alias("evidence_text"),
    )


def coverage_report(frames: DataFrame, findings: DataFrame, absences: DataFrame, rules: DataFrame, along: DataFrame | None = None) -> DataFrame:
    """For each run and rule: assets found, gaps, route length, assets for each km. ``along`` is the frames' chainage, where it is known."""
    route = (chainage(frames) if along is None else along).groupBy("run_id").agg(F.max("cum_m").alias("_m"), F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    every = route.crossJoin(F.broadcast(rules))
    count = lambda df, name: df.groupBy("run_id", "cls").agg(F.count(F.lit(1)).alias(name))
    a, g = count(findings, "found").withColumnRenamed("cls", "asset"), count(absences, "gaps").withColumnRenamed("cls", "absence_key")
    found = F.coalesce("found", F.lit(0))
    return every.join(a, ["run_id", "asset"], "left").join(g, ["run_id", "absence_key"], "left").select(
        "run_id", "asset", "absence_key", "absence_label", found.alias("found"), F.coalesce("gaps", F.lit(0)).alias("gaps"),
        F.round("_m", 1).alias("route_m"), "min_gap_m", F.when(F.col("_m") > 0, F.round(found / (F.col("_m") / 1000.0), 1)).otherwise(0.0).alias("per_km"),
    )


def gap_polyline(gaps: DataFrame, frames: DataFrame, steps: int = 12, along: DataFrame | None = None) -> DataFrame:
    """``steps`` + 1 places along each gap (run_id, rule_ord, start_m, step). ``along`` is the frames' chainage, where it is known."""
    points = gaps.select("run_id", "rule_ord", "start_m", "end_m", F.explode(F.sequence(F.lit(0), F.lit(steps))).alias("step"))
    target = F.col("start_m") + (F.col("end_m") - F.col("start_m")) * F.col("step") / steps
    return at_distance(points.withColumn("target_m", target), frames, along)
