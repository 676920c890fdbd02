"""Road masks, zones, widths, and camera calibration.

Masks are runs (run_id, frame, row_no, col_start, col_end); without a run_id all frames are of one run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayside.functions import geo
from wayside.operators.grouped import in_groups

# Words that place a class off or on the carriageway, in this order.
OFF_ROAD = ("footpath", "footway", "sidewalk", "walkway", "pedestrian", "verge", "kerb", "curb", "roadside", "median", "central reserve")
ON_ROAD = ("carriageway", "crack", "pothole", "rut", "wheel path", "wheel track", "asphalt", "bitumen", "tarmac", "chipseal", "aggregate", "surface")
MIN_WIDTH_M, MAX_WIDTH_M = 1.5, 40.0
#: Masks that are fitted at once in a task.
FITTED = 512


def frame_key(df: DataFrame) -> list[str]:
    return [c for c in ("run_id", "frame") if c in df.columns]


def carriageway_rules(classes: DataFrame, overrides: DataFrame | dict[str, bool] | None = None) -> DataFrame:
    """For each class (cls, label, hint, is_absence) whether it only makes sense on the carriageway, and why.

    A row of ``overrides`` (cls, carriageway_only), or an entry of a mapping, wins; then what the class declares itself in a column ``carriageway_only``, if
    there is one and it isn't null; absences never are; then the first off-road word, then the first road word
    of its own description decides; else it is not. Of several overrides of a class one that is true counts.
    """
    words = F.lower(F.concat_ws(" ", "cls", "label", "hint"))
    first = lambda terms: F.coalesce(*[F.when(words.rlike(rf"\b{t}"), F.lit(t)) for t in terms])
    own = F.col("carriageway_only") if "carriageway_only" in classes.columns else F.lit(None).cast("boolean")
    rows = classes.withColumn("_own", own)
    if isinstance(overrides, dict):
        overrides = classes.sparkSession.createDataFrame(list(overrides.items()), "cls string, carriageway_only boolean")
    if overrides is None:
        rows = rows.withColumn("_over", F.lit(None).cast("boolean"))
    else:
        rows = rows.join(F.broadcast(overrides.groupBy("cls").agg(F.bool_or("carriageway_only").alias("_over"))), "cls", "left")
    over, off, on = F.col("_over"), first(OFF_ROAD), first(ON_ROAD)
    said = over.isNotNull() | F.col("_own").isNotNull()
    return rows.select(
        "cls",
        F.when(said, F.coalesce(over, "_own")).when(F.col("is_absence"), False).when(off.isNotNull(), False).otherwise(on.isNotNull()).alias("carriageway_only"),
        F.when(over.isNotNull(), "override").when(F.col("_own").isNotNull(), "declared").when(F.col("is_absence"), "absence").when(off.isNotNull() | on.isNotNull(), "lexical").otherwise("default").alias("source"),
        F.when(~said & ~F.col("is_absence"), F.coalesce(off, on)).alias("matched"),
    )


def in_polygon(x: Column, y: Column, polygon: Column) -> Column:
    """Whether a point lies in a polygon (array of struct x, y) or on its edge, by crossings."""
    n = F.size(polygon)
    edges = F.transform(polygon, lambda p, i: F.struct(p.alias("a"), F.get(polygon, (i + 1) % n).alias("b")))
    crosses = lambda e: ((e["a"]["y"] > y) != (e["b"]["y"] > y)) & (x < e["a"]["x"] + F.try_divide((y - e["a"]["y"]) * (e["b"]["x"] - e["a"]["x"]), e["b"]["y"] - e["a"]["y"]))
    side = lambda e: (e["b"]["x"] - e["a"]["x"]) * (y - e["a"]["y"]) - (e["b"]["y"] - e["a"]["y"]) * (x - e["a"]["x"])
    between = lambda e: x.between(F.least(e["a"]["x"], e["b"]["x"]), F.greatest(e["a"]["x"], e["b"]["x"])) & y.between(F.least(e["a"]["y"], e["b"]["y"]), F.greatest(e["a"]["y"], e["b"]["y"]))
    odd = F.size(F.filter(edges, crosses)) % 2 == 1
    return F.when(n >= 3, odd | F.exists(edges, lambda e: (side(e) == 0) & between(e)))


def in_mask(points: DataFrame, runs: DataFrame) -> DataFrame:
    """Points (run_id, frame, row_no, col) with on_mask."""
    row = [*frame_key(points), "row_no"]
    hit = points.join(runs, row).filter(F.col("col").between(F.col("col_start"), F.col("col_end"))).select(*row, "col").distinct()
    return points.join(hit.withColumn("on_mask", F.lit(True)), [*row, "col"], "left").withColumn("on_mask", F.coalesce("on_mask", F.lit(False)))


def gate(detections: DataFrame, rules: DataFrame, polygons: DataFrame, width: int, height: int) -> DataFrame:
    """Detections with on_carriageway: null where the class may be anywhere or there is no zone."""
    joined = detections.join(F.broadcast(rules.select("cls", "carriageway_only")), "cls", "left").join(polygons, ["run_id", "frame_id"], "left")
    u = geo.anchor_u(F.col("box"), F.lit(float(width)))
    v = geo.anchor_v(F.col("box"), F.lit(float(height)), F.coalesce("geometry", F.lit("point")))
    inside = in_polygon(u, v, F.col("polygon"))
    return joined.withColumn("on_carriageway", F.when(F.col("carriageway_only"), inside)).drop("polygon", "carriageway_only")


def row_spans(runs: DataFrame) -> DataFrame:
    """For each row of a mask its extent, longest free run and pixels. Runs that touch count as one.

    Runs are sorted once by row and column, and all else follows from what is before each: a task holds the sort, which may
    spill, and a row of a mask, but no table of all rows. A run without both ends adds no pixels.
    """
    row = [*frame_key(runs), "row_no"]
    w = Window.partitionBy(*row).orderBy("col_start", "col_end")
    now = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    reached = runs.withColumn("_reach", F.max("col_end").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    new = F.coalesce(F.col("col_start") > F.col("_reach") + 1, F.lit(True))
    added = F.when(new, F.col("col_end") - F.col("col_start") + 1).otherwise(F.greatest(F.lit(0), F.col("col_end") - F.col("_reach")))
    summed = reached.select(
        *row, F.greatest("_reach", "col_end").alias("_end"), "col_start", "col_end", F.last(F.when(new, F.col("col_start")), ignorenulls=True).over(now).alias("_start"),
        F.min("col_start").over(now).alias("left_px"), F.max("col_end").over(now).alias("right_px"), F.sum(added).over(now).alias("pixels"), F.lead(F.lit(1)).over(w).isNull().alias("_last"),
    )
    free = F.max(F.col("_end") - F.col("_start") + 1).over(now)
    return summed.withColumn("free_px", free).filter("_last").select(*row, "left_px", "right_px", (F.col("right_px") - F.col("left_px") + 1).alias("span_px"), "free_px", "pixels")


def coverage(runs: DataFrame, width: int, height: int) -> DataFrame:
    return row_spans(runs).groupBy(*frame_key(runs)).agg((F.sum("pixels") / (width * height)).alias("coverage"))


def coverage_summary(covered: DataFrame) -> DataFrame:
    """For each run the frames in which there is road, and the upper median of their coverage."""
    return covered.filter("coverage > 0").groupBy("run_id").agg(
        F.count(F.lit(1)).alias("n_with_road"), F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY coverage DESC)").alias("coverage_median"))


def carriageway_width(runs: DataFrame, width: int, height: int, cam: dict, ranges_m=(5.0, 7.5, 10.0, 12.5, 15.0), least_share: float | None = None) -> DataFrame:
    """Width of the road at some ranges ahead in each frame, with what is wrong with it.

    With ``least_share`` only the largest component of a frame's mask counts, if it is at least that
    share of the frame; a frame without one has no road.

    A row whose mask reaches the frame's edge bounds the width from below only; widths outside
    1.5 to 40 m speak against the calibration. Neither is ``ok``.
    """
    c = {k: F.lit(float(v)) for k, v in cam.items()}
    h = F.lit(float(height))
    key = frame_key(runs)
    frames = runs.select(*key).distinct().withColumn("range_m", F.explode(F.array(*[F.lit(r) for r in ranges_m])))
    wanted = frames.withColumn("row_no", F.bround(geo.row_for_range(F.col("range_m"), h, c), 0).cast("long"))
    ground = geo.ground_range(F.lit(width / 2.0), F.col("row_no").cast("double"), F.lit(float(width)), h, c)
    wanted = wanted.withColumn("range_actual_m", F.when(F.col("row_no").between(0, height - 1), ground["forward"]))
    road = runs if least_share is None else largest_component(runs, least_share * width * height)
    joined = wanted.join(row_spans(road), [*key, "row_no"], "left")
    scale = F.col("range_actual_m") / geo.focal_px(h, c["vfov_deg"])
    clipped = (F.col("left_px") == 0) | (F.col("right_px") >= width - 1)
    span = F.col("span_px") * scale
    reason = (
        F.when(F.col("range_actual_m").isNull(), "no_row").when(F.col("span_px").isNull(), "no_road").when(clipped, "clipped")
        .when(~span.between(MIN_WIDTH_M, MAX_WIDTH_M), "implausible").otherwise("ok")
    )
    return joined.select(*key, "range_m", "row_no", "range_actual_m", span.alias("span_m"), (F.col("free_px") * scale).alias("free_m"), reason.alias("reason"))


def width_summary(samples: DataFrame) -> DataFrame:
    ok = F.col("reason") == "ok"
    when = lambda c: F.when(ok, F.col(c))
    count = lambda r: F.count_if(F.col("reason") == r).alias(f"n_{r}")
    return samples.agg(
        F.count(F.lit(1)).alias("n_samples"), *[count(r) for r in ("ok", "clipped", "no_road", "no_row", "implausible")],
        F.median(when("span_m")).alias("median_span_m"), F.median(when("free_m")).alias("median_free_m"), F.min(when("span_m")).alias("min_span_m"),
        F.min(F.when(ok, F.struct("span_m", "frame", "range_m")))["frame"].alias("min_at_frame"), F.max(when("span_m")).alias("max_span_m"),
    )


def temporal_majority(cells: DataFrame, frames: DataFrame, memory: int = 5) -> DataFrame:
    """Cells (run_id, frame_idx, cell) on which more than half of the run's last ``memory`` frames are road."""
    seen = frames.select("run_id", "frame_idx").distinct()
    spread = cells.select("run_id", "cell", F.explode(F.sequence(F.col("frame_idx"), F.col("frame_idx") + memory - 1)).alias("frame_idx"))
    votes = spread.groupBy("run_id", "frame_idx", "cell").agg(F.count(F.lit(1)).alias("votes"))
    first = seen.groupBy("run_id").agg(F.min("frame_idx").alias("first"))
    held = F.least(F.lit(memory), F.col("frame_idx") - F.col("first") + 1)
    return votes.join(seen, ["run_id", "frame_idx"]).join(first, "run_id").filter(F.col("votes") > 0.5 * held).select("run_id", "frame_idx", "cell")


def largest_component(runs: DataFrame, least: float = 0.0) -> DataFrame:
    """Runs of the largest 8-connected component of each frame's mask, if it has ``least`` pixels."""
    key = frame_key(runs)

    def kernel(group: list[tuple]) -> list[tuple]:
        rows = sorted(r[-3:] for r in group)
        parent = list(range(len(rows)))

        def find(i):
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        by_row: dict = {}
        for i, (r, _, _) in enumerate(rows):
            by_row.setdefault(r, []).append(i)
        for r, own in by_row.items():
            for above in (by_row.get(r - 1, []), own):
                k = 0  # both lists go from left to right
                for i in own:
                    while k < len(above) and rows[above[k]][2] < rows[i][1] - 1:
                        k += 1
                    j = k
                    while j < len(above) and rows[above[j]][1] <= rows[i][2] + 1:
                        parent[find(i)] = find(above[j])
                        j += 1
        size: dict = {}
        for i, (_, a, b) in enumerate(rows):
            size[find(i)] = size.get(find(i), 0) + b - a + 1
        best = max(size, key=lambda k: (size[k], -k)) if size else None
        return [(*group[0][:-3], *x) for i, x in enumerate(rows) if find(i) == best and size[best] >= least]

    kinds = ", ".join(f"{c} {runs.schema[c].dataType.simpleString()}" for c in key)
    return in_groups(runs.select(*key, "row_no", "col_start", "col_end"), key, kernel, f"{kinds}, row_no long, col_start long, col_end long")


def fit_rows(spans: DataFrame, n: int = 40, top: float = 0.30, least: int = 80) -> DataFrame:
    """The rows of each mask that its horizon is fitted on: ``n`` of them evenly below the upper ``top`` of the road.

    Masks of under ``least`` rows go, and so do rows of a single pixel.
    """
    key = frame_key(spans)
    extent = spans.groupBy(*key).agg(F.min("row_no").alias("_lo"), F.max("row_no").alias("_hi"), F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= least)
    start = F.col("_lo") + top * (F.col("_hi") - F.col("_lo"))
    at = F.transform(F.sequence(F.lit(0), F.lit(n - 2)), lambda i: F.floor(start + i * ((F.col("_hi") - start) / (n - 1))))
    rows = extent.select(*key, F.explode(F.array_distinct(F.concat(at, F.array(F.col("_hi").cast("long"))))).alias("row_no"))
    # far more rows than their size before the explode tells, so never broadcast
    return spans.hint("merge").join(rows.hint("merge"), [*key, "row_no"]).filter("pixels >= 2")


def horizon_fit(spans: DataFrame, width: int, min_rows: int = 10) -> DataFrame:
    """For each frame the row at which the road's width would vanish, by regression of width on row."""
    inner = spans.filter((F.col("left_px") > 0) & (F.col("right_px") < width - 1))
    key = frame_key(spans)
    fit = inner.groupBy(*key).agg(
        F.regr_slope("span_px", "row_no").alias("slope"), F.regr_intercept("span_px", "row_no").alias("intercept"),
        F.regr_r2("span_px", "row_no").alias("r2"), F.count(F.lit(1)).alias("rows"),
    )
    return fit.filter((F.col("rows") >= min_rows) & (F.col("slope") > 1e-6)).select(*key, (-F.col("intercept") / F.col("slope")).alias("horizon"), "slope", "r2")


def mask_fits(masks: DataFrame, width: int, n: int = 40, top: float = 0.30, least: int = 80, min_rows: int = 10) -> DataFrame:
    """The fits of ``horizon_fit`` over the rows of ``fit_rows``, from masks that lie whole in a row.

    ``masks`` is (run_id, frame, mask), ``mask`` an array of struct (row_no, col_start, col_end) in any order, and a frame is one
    row. Each gives its fit where it lies, so no row of a mask is shuffled, sorted by Spark or joined. Runs that lack a value are left out.
    """
    key = frame_key(masks)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, FITTED):
                part = batch.slice(at, FITTED)
                own, *fits = _mask_fits(part.column("mask"), width, n, top, least, min_rows)
                yield pa.RecordBatch.from_arrays([*[part.column(c).take(pa.array(own)) for c in key], *map(pa.array, fits)], [*key, "horizon", "slope", "r2"])

    kinds = ", ".join(f"{c} {masks.schema[c].dataType.simpleString()}" for c in key)
    return masks.select(*key, "mask").mapInArrow(kernel, f"{kinds}, horizon double, slope double, r2 double")


def _mask_fits(masks: pa.Array, width: int, n: int, top: float, least: int, min_rows: int) -> tuple[np.ndarray, ...]:
    """Places of the masks that have a fit, their horizons, slopes and r2. Sums are of whole numbers."""
    flat = masks.flatten()
    columns = [pc.struct_field(flat, c) for c in ("row_no", "col_start", "col_end")]
    known = np.logical_and.reduce([c.is_valid().to_numpy(zero_copy_only=False) for c in columns])
    own = np.repeat(np.arange(len(masks)), pc.list_value_length(masks).fill_null(0).to_numpy(zero_copy_only=False))[known]
    row, start, end = (c.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)[known] for c in columns)
    order = np.lexsort((end, start, row, own))
    row, start, end = row[order], start[order], end[order]
    # rows of masks: extent and pixels, run by run from the left
    first = np.flatnonzero(np.r_[True, (own[1:] != own[:-1]) | (row[1:] != row[:-1])][: len(own)])
    count = np.diff(np.r_[first, len(own)])
    own, row, left, right, pixels = own[first], row[first], start[first], end[first], (end - start)[first] + 1
    for k in range(1, count.max(initial=0)):
        g = np.flatnonzero(count > k)
        a, b = start[first[g] + k], end[first[g] + k]
        pixels[g] += np.where(a > right[g] + 1, b - a + 1, np.maximum(0, b - right[g]))
        right[g] = np.maximum(right[g], b)
    # masks with enough rows, and the rows they are fitted on
    head = np.flatnonzero(np.r_[True, own[1:] != own[:-1]][: len(own)])
    size = np.diff(np.r_[head, len(own)])
    enough = size >= least
    held = np.flatnonzero(np.repeat(enough, size))
    head, size = head[enough], size[enough]
    rank = np.repeat(np.arange(len(head)), size)
    lo, hi = row[head], row[head + size - 1]
    begin = lo + top * (hi - lo)
    want = np.floor(begin[:, None] + np.arange(n - 1) * ((hi - begin) / (n - 1))[:, None]).astype(np.int64)
    want = np.c_[want, hi] - lo[:, None]
    once = np.c_[np.ones(len(head), bool), want[:, 1:] != want[:, :-1]]
    tall = (hi - lo).max(initial=0) + 1
    places, sought = rank * tall + row[held] - lo[rank], np.arange(len(head))[:, None] * tall + want
    at = np.minimum(np.searchsorted(places, sought), max(len(places) - 1, 0))
    g = held[at]
    used = once & (places[at] == sought) & (pixels[g] >= 2) & (left[g] > 0) & (right[g] < width - 1)
    x, y, m = want * used, (right[g] - left[g] + 1) * used, used.sum(1)
    sx, sy = x.sum(1), y.sum(1)
    vx, vy, both = (m * (x * x).sum(1) - sx * sx).astype(float), (m * (y * y).sum(1) - sy * sy).astype(float), (m * (x * y).sum(1) - sx * sy).astype(float)
    sound = np.flatnonzero((m >= min_rows) & (vx > 0) & (both > 1e-6 * vx))
    slope, r2 = both[sound] / vx[sound], both[sound] / vx[sound] * both[sound] / vy[sound]
    return own[head[sound]], lo[sound] + (sx[sound] - sy[sound] / slope) / m[sound], slope, r2


def estimate_horizon(fits: DataFrame, height: int, camera_height_m: float = 1.35, min_r2: float = 0.80, least: int = 5) -> DataFrame:
    """For each run the median horizon of its good fits, where there are ``least`` of them, and how far it can be trusted.

    Good is a sound fit whose horizon lies where one can, from half a frame above the frame down to
    0.95 of it. ``spread`` is between the tenth and the ninetieth percent of the fits in order.
    """
    key = [c for c in ("run_id",) if c in fits.columns]
    good = fits.filter((F.col("r2") >= min_r2) & F.col("horizon").between(-0.5 * height, 0.95 * height))
    own = Window.partitionBy(*key)
    placed = good.select(*key, F.col("horizon").alias("h"), F.count(F.lit(1)).over(own).alias("n"), (F.row_number().over(own.orderBy("horizon")) - 1).alias("_at"))
    at = lambda place: F.max(F.when(F.col("_at") == F.floor(place), F.col("h")))
    middle = (at((F.col("n") - 1) / 2) + at(F.col("n") / 2)) / 2
    rows = placed.groupBy(*key, "n").agg(middle.alias("horizon"), (at(F.col("n") * 0.9) - at(F.col("n") * 0.1)).alias("spread"))
    bottom = height - 1.0
    return rows.filter(F.col("n") >= least).select(
        *key, "n", "horizon", "spread", ((F.col("horizon") - height / 2.0) / height).alias("pitch_offset_frac"),
        F.when(F.col("horizon") < bottom, camera_height_m / (bottom - F.col("horizon"))).alias("m_per_px_at_bottom"),
    )


def _moved(observations: DataFrame) -> DataFrame:
    return observations.filter("v1 > row and v2 > row").withColumn("k", 1 / (F.col("v1") - F.col("row")) - 1 / (F.col("v2") - F.col("row")))


def fit_calibration(observations: DataFrame, rows: list[float], by: tuple[str, ...] = ()) -> DataFrame:
    """Focal length times height for each candidate horizon row, and how well it fits.

    ``observations`` (v1, v2, dist): a mark moved from row v1 to v2 while the camera went dist. For
    a horizon row c, dist = product * k with k = 1/(v1-c) - 1/(v2-c); candidates are few. Columns
    ``by`` part the observations, such as run_id.
    """
    grid = F.explode(F.array(*[F.lit(float(r)) for r in rows])).alias("row")
    fit = _moved(observations.select(*by, "v1", "v2", "dist", grid)).groupBy(*by, "row").agg(
        F.try_divide(F.sum(F.col("k") * F.col("dist")), F.sum(F.col("k") * F.col("k"))).alias("product"),
        F.sum(F.col("dist") * F.col("dist")).alias("dd"), F.sum(F.col("k") * F.col("dist")).alias("kd"), F.count(F.lit(1)).alias("n"),
    )
    rms = F.sqrt(F.greatest(F.lit(0.0), F.col("dd") - F.col("product") * F.col("kd")) / F.col("n"))
    return fit.select(*by, "row", "product", rms.alias("rms_m"), "n")


def best_calibration(observations: DataFrame, rows: list[float], keep: float = 0.8, by: tuple[str, ...] = ()) -> DataFrame:
    """The best row, after the worst fifth of the observations under a first fit are left out."""
    best = lambda df: fit_calibration(df, rows, by).groupBy(*by).agg(F.min(F.struct("rms_m", "row", "product", "n")).alias("f"))
    beside = lambda df, one: df.join(one, list(by)) if by else df.join(F.broadcast(one))
    errors = _moved(beside(observations, best(observations).select(*by, "f.row", "f.product"))).withColumn("err", F.abs(F.col("dist") - F.col("product") * F.col("k")))
    cut = errors.groupBy(*by).agg(F.percentile("err", keep).alias("cut"))
    good = beside(errors, cut).filter("err <= cut").select(*by, "v1", "v2", "dist")
    return best(good).select(*by, "f.row", "f.product", "f.rms_m", "f.n")


def camera_rows(fits: DataFrame, cameras: DataFrame, rows: list[float]) -> DataFrame:
    """Cameras that calibrations (run_id, row, product, rms_m, n) come to, ready to be stored, and what speaks against each.

    ``cameras`` is (run_id, height_m, width, height, max_range_m): what the fit can't tell.
    """
    c = fits.join(cameras, "run_id")
    focal = F.col("product") / F.col("height_m")
    fov = lambda side: 2 * F.degrees(F.atan(F.col(side) / 2 / focal))
    warn = F.array_compact(F.array(
        F.when((F.col("row") - min(rows) < 1) | (max(rows) - F.col("row") < 1), F.lit("horizon on the edge of the search")),
        F.when(~((fov("height") > 20) & (fov("height") < 140)), F.lit("field of view implausible")), F.when(F.col("rms_m") > 1, F.lit("residual high"))))
    return c.select(
        "run_id", "height_m", F.round(fov("height"), 2).alias("vfov_deg"), F.round(fov("width"), 2).alias("hfov_deg"),
        F.round((F.col("row") - F.col("height") / 2) / F.col("height"), 4).alias("pitch_offset_frac"), "max_range_m",
        F.round("product", 1).alias("product"), F.round("row", 1).alias("horizon_row"), F.round("rms_m", 2).alias("residual_m"), F.col("n").alias("inliers"), warn.alias("warnings"),
    )


def solve_markers(markers: DataFrame) -> DataFrame:
    """Focal length and horizon of a mount from two ground markers at known ranges.

    (mount, height_m, image_h, near_m, near_v, far_m, far_v). ``sound`` says whether the near
    marker comes back within 5 cm and the values are plausible.
    """
    f = (F.col("near_v") - F.col("far_v")) / (F.col("height_m") * (1 / F.col("near_m") - 1 / F.col("far_m")))
    row = F.col("far_v") - f * F.col("height_m") / F.col("far_m")
    vfov = 2 * F.degrees(F.atan(F.col("image_h") / 2 / f))
    back = F.try_divide(f * F.col("height_m"), F.col("near_v") - row)
    return markers.select(
        "mount", f.alias("focal_px"), vfov.alias("vfov_deg"), ((row - F.col("image_h") / 2) / F.col("image_h")).alias("pitch_offset_frac"),
        ((F.abs(back - F.col("near_m")) < 0.05) & vfov.between(10, 120)).alias("sound"),
    )


def choose_calibration(attempts: DataFrame, presets: DataFrame) -> DataFrame:
    """For each run the first attempt that is ok without warnings, else the preset."""
    good = attempts.filter("ok and warnings = 0").groupBy("run_id").agg(F.min(F.struct("attempt", "camera"))["camera"].alias("_c"))
    return presets.join(good, "run_id", "left").select("run_id", F.coalesce("_c", "camera").alias("camera"), F.when(F.col("_c").isNull(), "preset").otherwise("calibrated").alias("reason"))
