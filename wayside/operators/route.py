"""Positions in time and along a route. Every table carries run_id; order is by t or frame_idx."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayside.functions import geo
from wayside.operators.grouped import BATCH
from wayside.sources.sinks import written

#: Seconds of a bucket of the as-of join, frames of a bucket of running sums: a long run is many
#: groups, none of which has to hold it whole.
ASOF_BUCKET_S, FRAME_BUCKET = 512.0, 4096


def asof(queries: DataFrame, points: DataFrame, payload: list[str], bucket_s: float = ASOF_BUCKET_S) -> DataFrame:
    """``queries`` (run_id, t, ...) with ``before`` and ``after``, structs of t and ``payload``.

    ``before`` is the last point with time <= t, ``after`` the first with time > t; null where there
    is none. Both sides are laid in one order within buckets of time; what a bucket needs from its
    neighbours comes from one row for each bucket, so a run is never sorted in one task.
    """
    fields = F.struct(F.col("t"), *[F.col(c) for c in payload])
    q = queries.withColumn("_q", F.struct(*[F.col(c) for c in queries.columns])).select("run_id", "t", "_q", F.lit(None).alias("_p"))
    p = points.select("run_id", "t", F.lit(None).alias("_q"), fields.alias("_p"))
    q = q.withColumn("_p", F.col("_p").cast(p.schema["_p"].dataType))
    p = p.withColumn("_q", F.col("_q").cast(q.schema["_q"].dataType))
    both = p.unionByName(q).withColumn("_b", F.floor(F.col("t") / bucket_s))
    ends = both.groupBy("run_id", "_b").agg(F.max("_p").alias("last"), F.min("_p").alias("first"))
    over = Window.partitionBy("run_id").orderBy("_b")
    ends = ends.select(
        "run_id", "_b",
        F.last("last", ignorenulls=True).over(over.rowsBetween(Window.unboundedPreceding, -1)).alias("_earlier"),
        F.first("first", ignorenulls=True).over(over.rowsBetween(1, Window.unboundedFollowing)).alias("_later"),
    )
    order = Window.partitionBy("run_id", "_b").orderBy("t", F.col("_q").isNotNull())
    return (
        both.withColumn("before", F.last("_p", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("after", F.first("_p", ignorenulls=True).over(order.rowsBetween(1, Window.unboundedFollowing)))
        .filter("_q is not null")
        .join(ends, ["run_id", "_b"])
        .select("_q.*", F.coalesce("before", "_earlier").alias("before"), F.coalesce("after", "_later").alias("after"))
    )


def _lerp(name: str) -> Column:
    a, b, t = F.col("before"), F.col("after"), F.col("t")
    span = b["t"] - a["t"]
    f = F.when(span > 0, (t - a["t"]) / span).otherwise(0.0)
    return F.when(a.isNull(), b[name]).when(b.isNull(), a[name]).otherwise(a[name] + (b[name] - a[name]) * f)


def interpolate(queries: DataFrame, track: DataFrame) -> DataFrame:
    """Position of each run at the queried times, linear between points, clamped to the ends."""
    found = asof(queries, track, ["lat", "lon"])
    return found.select(*queries.columns, _lerp("lat").alias("lat"), _lerp("lon").alias("lon"))


def pose_at(queries: DataFrame, frames: DataFrame) -> DataFrame:
    """As ``interpolate`` over frames; heading and frame_idx are the earlier frame's."""
    points = frames.select("run_id", F.col("t_sec").alias("t"), "lat", "lon", "heading_deg", "frame_idx")
    found = asof(queries, points, ["frame_idx", "lat", "lon", "heading_deg"])
    held = lambda c: F.coalesce(F.col("before")[c], F.col("after")[c]).alias(c)
    return found.select(*queries.columns, held("frame_idx"), _lerp("lat").alias("lat"), _lerp("lon").alias("lon"), held("heading_deg"))


def nearest_in_time(queries: DataFrame, points: DataFrame, payload: list[str]) -> DataFrame:
    """The point with the least time difference, the earlier of two equal ones, as struct ``near``."""
    found = asof(queries, points, payload)
    a, b = F.col("before"), F.col("after")
    later = a.isNull() | (b["t"] - F.col("t") < F.col("t") - a["t"])
    return found.select(*queries.columns, F.when(b.isNotNull() & later, b).otherwise(a).alias("near"))


def with_previous(frames: DataFrame, columns: list[str], order: str = "frame_idx") -> DataFrame:
    """``frames`` with ``prev``, a struct of the row before in the run, null for the first."""
    fields = F.struct(*[F.col(c) for c in columns])
    return frames.withColumn("prev", F.lag(fields).over(Window.partitionBy("run_id").orderBy(order)))


def step_m() -> Column:
    """Metres from the previous row, 0 for the first."""
    p = F.col("prev")
    return F.coalesce(geo.haversine_m(p["lat"], p["lon"], F.col("lat"), F.col("lon")), F.lit(0.0))


def chainage(frames: DataFrame) -> DataFrame:
    """``frames`` with cum_m, metres travelled along the run up to each."""
    stepped = with_previous(frames, ["lat", "lon"]).withColumn("_step", step_m()).drop("prev")
    stepped = stepped.withColumn("_b", F.floor(F.col("frame_idx") / FRAME_BUCKET))
    within = Window.partitionBy("run_id", "_b").orderBy("frame_idx")
    sums = stepped.groupBy("run_id", "_b").agg(F.sum("_step").alias("_sum"))
    before = Window.partitionBy("run_id").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("run_id", "_b", F.coalesce(F.sum("_sum").over(before), F.lit(0.0)).alias("_base"))
    return (
        stepped.withColumn("_run", F.sum("_step").over(within.rowsBetween(Window.unboundedPreceding, 0)))
        .join(sums, ["run_id", "_b"])
        .withColumn("cum_m", F.col("_base") + F.col("_run"))
        .drop("_b", "_step", "_run", "_base")
    )


def route_length(frames: DataFrame) -> DataFrame:
    return with_previous(frames, ["lat", "lon"]).groupBy("run_id").agg(F.sum(step_m()).alias("length_m"))


def headings(frames: DataFrame, window: int = 2, min_baseline_m: float = 8.0, halo: int = 64) -> DataFrame:
    """``frames`` with heading from the narrowest baseline around each that is long enough.

    For half-widths w from ``window`` on, the ends are i - w and i + w within the run; the first w
    whose ends are ``min_baseline_m`` apart gives the bearing, the whole run if none is. A run is looked at in
    pieces, each with ``halo`` frames on both sides; only runs in which a frame needs more than that, as in a long
    stop, are then looked at whole, and only for those frames.
    """
    run = Window.partitionBy("run_id")
    here = frames.withColumn("_n", F.count(F.lit(1)).over(run)).withColumn("_i", F.row_number().over(run.orderBy("frame_idx")) - 1)
    piece = F.floor(F.col("_i") / FRAME_BUCKET)
    pieces = F.sequence(F.floor(F.greatest(F.col("_i") - halo, F.lit(0)) / FRAME_BUCKET), F.floor((F.col("_i") + halo) / FRAME_BUCKET))
    spread = here.withColumn("_own", piece).withColumn("_piece", F.explode(pieces))
    schema = T.StructType([*frames.schema, T.StructField("_n", T.LongType()), T.StructField("_i", T.IntegerType()), T.StructField("heading", T.DoubleType())])

    def look(t: pa.Table) -> pa.Table:
        t = t.sort_by("_i")
        own = t["_own"].to_numpy() == t["_piece"].to_numpy()
        found = _first_bearings(t["_i"].to_numpy(), t["_n"][0].as_py(), t["lat"].to_numpy(), t["lon"].to_numpy(), np.flatnonzero(own), window, min_baseline_m, halo)
        return t.drop_columns(["_own", "_piece"]).append_column("heading", pa.array(found, from_pandas=True)).filter(pa.array(own))

    near = written(spread.groupBy("run_id", "_piece").applyInArrow(look, schema), "headings")
    open_ = near.filter("heading is null").select("run_id", "frame_idx")
    if open_.isEmpty():
        return near.drop("_n", "_i")

    def look_again(t: pa.Table) -> pa.Table:
        t = t.sort_by("_i")
        rest = np.flatnonzero(t["heading"].is_null().to_numpy())
        found = _first_bearings(t["_i"].to_numpy(), len(t), t["lat"].to_numpy(), t["lon"].to_numpy(), rest, window, min_baseline_m, len(t))
        return pa.table({"run_id": t["run_id"].take(rest), "frame_idx": t["frame_idx"].take(rest), "_later": pa.array(found[rest], from_pandas=True)})

    whole = near.select("run_id", "frame_idx", "lat", "lon", "_i", "heading").join(open_.select("run_id").distinct(), "run_id", "left_semi")
    kinds = ", ".join(f"{c} {frames.schema[c].dataType.simpleString()}" for c in ("run_id", "frame_idx"))
    later = whole.groupBy("run_id").applyInArrow(look_again, f"{kinds}, _later double")
    both = near.join(later, ["run_id", "frame_idx"], "left")
    return both.withColumn("heading", F.coalesce("heading", "_later")).select(*frames.columns, "heading")


def _first_bearings(i: np.ndarray, n: int, lat: np.ndarray, lon: np.ndarray, rows: np.ndarray, window: int, least_m: float, most: int) -> np.ndarray:
    """Bearings at ``rows`` of places ``i`` (consecutive, of ``n``), with half-widths up to ``most``; nan where none will do."""
    out = np.full(len(i), np.nan)
    if n < 2:
        out[rows] = 0.0
        return out
    for w in range(window, max(most, window) + 1):
        if not len(rows):
            break
        a, b = np.maximum(i[rows] - w, 0) - i[0], np.minimum(i[rows] + w, n - 1) - i[0]
        known = (a >= 0) & (b < len(i))
        a, b = np.where(known, a, 0), np.where(known, b, 0)
        whole = (i[rows] <= w) & (i[rows] + w >= n - 1)
        good = known & (whole | (_distances(lat[a], lon[a], lat[b], lon[b]) >= least_m))
        p, q, dl = np.radians(lat[a[good]]), np.radians(lat[b[good]]), np.radians(lon[b[good]] - lon[a[good]])
        y, x = np.sin(dl) * np.cos(q), np.cos(p) * np.sin(q) - np.sin(p) * np.cos(q) * np.cos(dl)
        out[rows[good]] = np.mod(np.degrees(np.arctan2(y, x)) + 360.0, 360.0)
        rows = rows[~good]
    return out


def _fold(df: DataFrame, schema: str, kernel) -> DataFrame:
    """Apply an order-dependent kernel to each run, sorted by frame_idx.

    Runs follow each other in a task, which holds one of them: a call of Spark's for each would cost more than its work.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, own, done = [], None, []
        for batch in batches:
            for start, stop in pairwise([0, *pc.run_end_encode(batch.column("run_id")).run_ends.to_pylist()]):
                if held and batch.column("run_id")[start].as_py() != own:
                    done.append(kernel(pa.Table.from_batches(held)))
                    held = []
                    if sum(t.num_rows for t in done) >= BATCH:
                        yield from pa.concat_tables(done).combine_chunks().to_batches()
                        done = []
                own = batch.column("run_id")[start].as_py()
                held.append(batch.slice(start, stop - start))
        if held:
            done.append(kernel(pa.Table.from_batches(held)))
        if done:
            yield from pa.concat_tables(done).combine_chunks().to_batches()

    return df.repartition("run_id").sortWithinPartitions("run_id", "frame_idx").mapInArrow(run, schema)


def _distances(lat1, lon1, lat2, lon2):
    p1, p2 = np.radians(lat1), np.radians(lat2)
    h = np.sin((p2 - p1) / 2) ** 2 + np.cos(p1) * np.cos(p2) * np.sin(np.radians(lon2 - lon1) / 2) ** 2
    return 2 * geo.EARTH_RADIUS_M * np.arcsin(np.sqrt(h))


def sample_by_spacing(frames: DataFrame, spacing_m: float) -> DataFrame:
    """Frames (run_id, frame_idx, moved_m) kept about ``spacing_m`` apart.

    A frame is kept when it lies so far, in a straight line, from the last one kept; the first and
    the last of a run always are. ``moved_m`` is null for those two. Each decision rests on the one
    before it, so a run is one ordered pass; its table holds numbers only.
    """

    def kernel(t: pa.Table) -> pa.Table:
        lat, lon = t.column("lat").to_numpy(), t.column("lon").to_numpy()
        keep, moved, last = [0], [None], 0
        i = 1
        while i < len(lat):
            # look at growing stretches ahead for the first frame that is far enough
            width = 64
            while i < len(lat):
                far = _distances(lat[last], lon[last], lat[i : i + width], lon[i : i + width])
                hit = np.flatnonzero(far >= spacing_m)
                if len(hit):
                    last = i + int(hit[0])
                    keep.append(last)
                    moved.append(float(far[hit[0]]))
                    i = last + 1
                    break
                i += width
                width *= 2
        if keep[-1] != len(lat) - 1:
            keep.append(len(lat) - 1)
            moved.append(None)
        rows = t.take(keep)
        return pa.table({"run_id": rows.column("run_id"), "frame_idx": rows.column("frame_idx"), "moved_m": pa.array(moved, pa.float64())})

    return _fold(frames.select("run_id", "frame_idx", "lat", "lon"), "run_id long, frame_idx long, moved_m double", kernel)


def spacing_stats(kept: DataFrame, frames: DataFrame, spacing_m: float) -> DataFrame:
    """Kept and source frames of each run, the upper median of what was achieved, and whether the source falls short."""
    moved = F.array_sort(F.collect_list("moved_m"))
    k = kept.groupBy("run_id").agg(F.count(F.lit(1)).alias("kept"), moved.alias("_m"))
    n = frames.groupBy("run_id").agg(F.count(F.lit(1)).alias("source_frames"))
    median = F.get("_m", F.floor(F.size("_m") / 2).cast("int"))
    return (
        k.join(n, "run_id").withColumn("achieved_median_m", median)
        .withColumn("source_limited", F.coalesce(F.col("achieved_median_m") > spacing_m * 1.5, F.lit(False))).drop("_m")
    )


def segment_cuts(frames: DataFrame, segment_m: float, along: DataFrame | None = None) -> DataFrame:
    """Boundaries (run_id, frame_idx) of segments of ``segment_m``. ``along`` is the frames' chainage, where it is known.

    The path since the last cut is summed and starts from 0 after each, so what goes over a cut is
    lost, which no division of the running total gives. The first and the last frame are cuts.
    """

    def kernel(t: pa.Table) -> pa.Table:
        cum = t.column("cum_m").to_numpy()
        cuts, n = [0], len(cum)
        while True:
            nxt = int(np.searchsorted(cum, cum[cuts[-1]] + segment_m - 1e-9))
            while nxt < n and cum[nxt] - cum[cuts[-1]] < segment_m:
                nxt += 1
            if nxt >= n:
                break
            cuts.append(nxt)
        if cuts[-1] != n - 1:
            cuts.append(n - 1)
        rows = t.take(cuts)
        return rows.select(["run_id", "frame_idx"])

    along = chainage(frames) if along is None else along
    return _fold(along.select("run_id", "frame_idx", "cum_m"), "run_id long, frame_idx long", kernel)


def every_nth(frames: DataFrame, source_fps: float, fps: float) -> DataFrame:
    """Every N-th frame, N the rounded ratio of the rates; missing times are those of the source rate."""
    n = max(1, int(round(source_fps / fps))) if source_fps > 0 and fps > 0 else 1
    at = F.col("frame_idx") / (source_fps if source_fps > 0 else fps)
    return frames.filter(F.pmod("frame_idx", F.lit(n)) == 0).withColumn("t_sec", F.coalesce("t_sec", at))


def frame_gaps(frames: DataFrame, nominal_s: float) -> DataFrame:
    """Least and greatest time between frames of a run, and whether they vary by over half the nominal."""
    gap = F.col("t_sec") - F.lag("t_sec").over(Window.partitionBy("run_id").orderBy("frame_idx"))
    return (
        frames.withColumn("gap", gap).groupBy("run_id").agg(F.min("gap").alias("min_gap_s"), F.max("gap").alias("max_gap_s"))
        .withColumn("variable", F.coalesce(F.col("max_gap_s") - F.col("min_gap_s") > nominal_s / 2, F.lit(False)))
    )


def speeds(track: DataFrame) -> DataFrame:
    """Speed at each track point from the points on both sides of it."""
    w = Window.partitionBy("run_id").orderBy("seq")
    here = F.struct("t", "lat", "lon")
    a, b = F.coalesce(F.lag(here).over(w), here), F.coalesce(F.lead(here).over(w), here)
    both = track.withColumn("_a", a).withColumn("_b", b)
    span = F.col("_b")["t"] - F.col("_a")["t"]
    far = geo.haversine_m(F.col("_a")["lat"], F.col("_a")["lon"], F.col("_b")["lat"], F.col("_b")["lon"])
    return both.withColumn("speed_mps", F.when(span > 0, far / span).otherwise(0.0)).drop("_a", "_b")


def build_frames(times: DataFrame, track: DataFrame, offset_s: float = 0.0, min_baseline_m: float = 8.0) -> DataFrame:
    """Keyframes with position and heading.

    ``times`` has (run_id, frame_idx, t_sec, start_ts). Positions are looked up at t_sec + offset,
    GPS time; t_sec stays video time. ``ts`` is GPS time on the clock. A run's first position and
    last position hold beyond its track.
    """
    at = times.withColumn("t", F.col("t_sec") + offset_s)
    placed = headings(interpolate(at, track), 2, min_baseline_m)
    micros = F.round(F.col("t") * 1_000_000).cast("long")
    return placed.select(
        "run_id", "frame_idx", F.lpad((F.col("frame_idx") + 1).cast("string"), 5, "0").alias("frame_id"),
        F.round("t_sec", 3).alias("t_sec"), F.timestamp_micros(F.unix_micros("start_ts") + micros).alias("ts"),
        "lat", "lon", F.round("heading", 2).alias("heading_deg"),
    )

