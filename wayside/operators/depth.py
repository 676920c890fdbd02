"""Whole clouds: from depth maps of frames, and from reconstructed points and camera paths."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayside.functions import geo
from wayside.operators import cloud
from wayside.operators.localize import camera_columns
from wayside.operators.voxel import first_of_cells, thin_to_budget
from wayside.sources.sinks import written

KEY = ["run_id", "frame_id"]
#: Points of a run that a task may hold; the clouds of larger runs are thinned by a shuffle of their points.
HELD = 1_000_000


def depth_scales(depth: DataFrame, across: int, down: int, width: int, height: int, cam: dict, least: int = 40) -> DataFrame:
    """a and b of 1 / metres = a * d + b for each run and frame of ``depth`` (run_id, frame_id, y, x, d) with ``least`` samples of ground."""
    keyed = depth.withColumn("frame", F.struct(*KEY))
    fits = cloud.fit_depth_scale(cloud.ground_samples(keyed, across, down, width, height, cam), least)
    return fits.select("frame.*", "a", "b", "n")


def pixel_grid(spark, across: int, down: int, width: int, height: int, stride: int) -> DataFrame:
    """Every ``stride``-th pixel (u, v) of a frame with the cell (y, x) of ``across`` by ``down`` that it falls in."""
    w, h = F.lit(float(width)), F.lit(float(height))
    columns, rows = -(-width // stride), -(-height // stride)
    grid = spark.range(columns * rows).select(((F.col("id") % columns) * stride).alias("u"), (F.floor(F.col("id") / columns) * stride).alias("v"))
    cell = lambda at, side, n: F.least(F.lit(n - 1), F.floor(F.col(at) / side * n)).cast("long")
    return grid.select("u", "v", cell("v", h, down).alias("y"), cell("u", w, across).alias("x"))


def frame_points(depth: DataFrame, fits: DataFrame, frames: DataFrame, origin: tuple[float, float], across: int, down: int, width: int, height: int, cam: dict, stride: int = 6, near_m: float = 1.5, far_m: float = 30.0) -> DataFrame:
    """Every ``stride``-th pixel of each frame as a point in metres: x east and z south of ``origin``, y up from the ground.

    ``depth`` (run_id, frame_id, y, x, d) has ``across`` by ``down`` cells; pixels take the cell they fall in. The
    pixel's ray is scaled by its depth under the frame's fit, turned by the heading, and set down at the frame's
    place, ``cam``'s height above the ground. Depths outside ``near_m`` to ``far_m`` and frames without fit or place go.
    The grid of pixels is broadcast: its size follows the image and the stride alone.
    """
    c = camera_columns(cam)
    w, h = F.lit(float(width)), F.lit(float(height))
    grid = pixel_grid(depth.sparkSession, across, down, width, height, stride)
    place = frames.select(*KEY, "lat", "lon", "heading_deg").join(fits.select(*KEY, "a", "b"), KEY)
    seen = depth.select(*KEY, "y", "x", "d").join(place, KEY).join(F.broadcast(grid), ["y", "x"])
    inverse = F.col("a") * F.col("d") + F.col("b")
    f, row = geo.focal_px(h, c["vfov_deg"]), geo.horizon_row(h, c["pitch_offset_frac"])
    ahead = seen.withColumn("ahead", F.when(inverse > 1e-6, 1 / inverse)).filter(F.col("ahead").between(near_m, far_m))
    right = (F.col("u") - w / 2) * F.col("ahead") / f
    psi = F.radians("heading_deg")
    east = right * F.cos(psi) + F.col("ahead") * F.sin(psi) + geo.local_east(F.col("lon"), F.lit(origin[0]), F.lit(origin[1]))
    north = -right * F.sin(psi) + F.col("ahead") * F.cos(psi) + geo.local_north(F.col("lat"), F.lit(origin[0]))
    up = c["height_m"] - (F.col("v") - row) * F.col("ahead") / f
    return ahead.select(*KEY, "u", "v", east.alias("x"), up.alias("y"), (-north).alias("z"))


def thinned_in_tasks(depth: DataFrame, fits: DataFrame, frames: DataFrame, origin: tuple[float, float], across: int, down: int, width: int, height: int, cam: dict, stride: int, budget: int, near_m: float, far_m: float) -> DataFrame:
    """What ``thin_to_budget`` leaves of ``frame_points``, for runs whose points a task can hold.

    A frame's depths are one row when they are shuffled by run; its points are made in the task that thins them, so no
    point is shuffled. Runs follow each other in a task, which holds one at a time.
    """
    c = camera_columns(cam)
    h, psi = F.lit(float(height)), F.radians("heading_deg")
    inside = F.col("d").isNotNull() & F.col("y").between(0, down - 1) & F.col("x").between(0, across - 1)
    wanted = F.broadcast(pixel_grid(depth.sparkSession, across, down, width, height, stride).select("y", "x").distinct())
    packed = depth.filter(inside).join(wanted, ["y", "x"], "left_semi").groupBy(*KEY).agg(F.collect_list((F.col("y") * across + F.col("x")).cast("int")).alias("cells"), F.collect_list(F.col("d").cast("double")).alias("depths"))
    # what turns and sets down a frame's points comes from Spark, so that they agree with frame_points to the last bit
    numbers = {"a": F.col("a"), "b": F.col("b"), "cos": F.cos(psi), "sin": F.sin(psi), "east": geo.local_east(F.col("lon"), F.lit(origin[0]), F.lit(origin[1])), "north": geo.local_north(F.col("lat"), F.lit(origin[0])),
               "f": geo.focal_px(h, c["vfov_deg"]), "row": geo.horizon_row(h, c["pitch_offset_frac"])}
    place = frames.select(*KEY, "lat", "lon", "heading_deg").filter("lat is not null and lon is not null and heading_deg is not null").join(fits.select(*KEY, "a", "b"), KEY)
    place = place.select(*KEY, F.array(*numbers.values()).alias("numbers"))
    by = int(depth.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # few bytes make many points, so tasks are not joined by size
    dealt = packed.join(place, KEY).repartition(by, "run_id").sortWithinPartitions(*KEY)
    columns, up_m, middle, wide = -(-width // stride), float(cam["height_m"]), float(width) / 2, len(numbers)
    kinds = T.StructType([*[dealt.schema[k] for k in KEY], T.StructField("u", T.LongType()), T.StructField("v", T.LongType()), *[T.StructField(n, T.DoubleType()) for n in "xyz"]])

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n_pixels = columns * -(-height // stride)
        pu, pv = np.arange(n_pixels) % columns * stride, np.arange(n_pixels) // columns * stride
        side = lambda at, size, n: np.minimum(n - 1, np.floor(at / float(size) * n)).astype(np.int64)
        own = side(pv, height, down) * across + side(pu, width, across)
        by_cell, per_cell = np.argsort(own, kind="stable"), np.bincount(own, minlength=across * down)
        start = np.cumsum(per_cell) - per_cell

        def cloud_of(frame: np.ndarray, cells: np.ndarray, depths: np.ndarray, n: np.ndarray) -> tuple:
            """Points of a run in order of frames and pixels; ``frame`` is a depth's row of ``n``."""
            with np.errstate(all="ignore"):
                inverse = n[frame, 0] * depths + n[frame, 1]
                ahead = 1 / inverse
                seen = (inverse > 1e-6) & (ahead >= near_m) & (ahead <= far_m)
            frame, cells, ahead = frame[seen], cells[seen], ahead[seen]
            times = per_cell[cells]
            at = np.repeat(np.arange(len(cells)), times)
            pixel = by_cell[np.repeat(start[cells] - np.cumsum(times) + times, times) + np.arange(len(at))]
            order = np.argsort(frame[at] * n_pixels + pixel, kind="stable")
            at, pixel = at[order], pixel[order]
            frame, ahead, u, v = frame[at], ahead[at], pu[pixel], pv[pixel]
            cos, sin, east, north, f, row = n[frame, 2:].T
            right = (u - middle) * ahead / f
            return frame, u, v, right * cos + ahead * sin + east, up_m - (v - row) * ahead / f, -(-right * sin + ahead * cos + north)

        def finish(pieces: list) -> pa.RecordBatch:
            runs, ids, sizes, cells, depths, n = (pa.concat_arrays([p[i] for p in pieces]) if i < 2 else np.concatenate([p[i] for p in pieces]) for i in range(6))
            frame, u, v, x, y, z = cloud_of(np.repeat(np.arange(len(ids)), sizes), cells, depths, n)
            # frames of one name are one: their points and repeated ones follow the pixel, then the place
            name = np.asarray(numbered(ids), dtype=np.int64)[frame] if len(ids) else frame
            same = name * n_pixels + v // stride * columns + u // stride
            if np.any(same[1:] <= same[:-1]):
                order = np.lexsort((z, y, x, same))
                frame, u, v, x, y, z = (c[order] for c in (frame, u, v, x, y, z))
            if len(x) > budget:
                kept = first_of_cells(x, y, z, budget)
                frame, u, v, x, y, z = (c[kept] for c in (frame, u, v, x, y, z))
            at = pa.array(frame)
            return pa.RecordBatch.from_arrays([runs.take(at), ids.take(at), *[pa.array(c) for c in (u, v, x, y, z)]], kinds.names)

        def numbered(ids: pa.Array) -> list[int]:
            """The number of each row's frame, in the order in which frames come."""
            known: dict = {}
            return [known.setdefault(i, len(known)) for i in ids.to_pylist()]

        held: list = []
        for batch in batches:
            if not batch.num_rows:
                continue
            runs, ids = batch["run_id"], batch["frame_id"]
            sizes = np.diff(batch["cells"].offsets.to_numpy())
            ends = np.cumsum(sizes)
            cells, depths = batch["cells"].flatten().to_numpy(), batch["depths"].flatten().to_numpy()
            n = batch["numbers"].flatten().to_numpy(zero_copy_only=False).reshape(-1, wide)
            names = runs.to_pylist()
            cuts = [0, *[i for i in range(1, len(names)) if names[i] != names[i - 1]], len(names)]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if held and held[0][0][0].as_py() != names[lo]:
                    yield finish(held)
                    held = []
                part = slice(ends[lo] - sizes[lo], ends[hi - 1])
                held.append((runs[lo:hi], ids[lo:hi], sizes[lo:hi], cells[part], depths[part], n[lo:hi]))
        if held:
            yield finish(held)

    return dealt.select(*KEY, "cells", "depths", "numbers").mapInArrow(kernel, kinds)


def depth_cloud(depth: DataFrame, frames: DataFrame, origin: tuple[float, float], across: int, down: int, width: int, height: int, cam: dict, stride: int = 6, budget: int = 500_000, near_m: float = 1.5, far_m: float = 30.0) -> DataFrame:
    """One cloud for each run from its frames' depth maps, at most ``budget`` points, each with its frame and pixel.

    Frames whose scale can't be fitted are left out; of points in one cell the first by frame and pixel stays. Runs of up to
    ``HELD`` points are thinned in tasks, others by ``thin_to_budget``, with the same result.
    """
    fits = depth_scales(depth, across, down, width, height, cam)
    most = (-(-width // stride // across) + 1) * (-(-height // stride // down) + 1)  # pixels of a cell, at most
    sizes = depth.groupBy("run_id").agg((F.count(F.lit(1)) * most).alias("_n"))
    large = written(sizes.filter(F.col("_n") > HELD).select("run_id"), "large")  # at most one for each HELD points
    rest = thinned_in_tasks(depth.join(F.broadcast(large), "run_id", "left_anti"), fits, frames, origin, across, down, width, height, cam, stride, budget, near_m, far_m)
    if large.isEmpty():
        return rest
    points = frame_points(depth.join(F.broadcast(large), "run_id", "left_semi"), fits, frames, origin, across, down, width, height, cam, stride, near_m, far_m)
    return rest.unionByName(thin_to_budget(points.withColumn("seq", F.struct("frame_id", "v", "u")), budget).drop("seq"))


def path_pairs(cameras: DataFrame, frames: DataFrame, origin: tuple[float, float]) -> DataFrame:
    """Each camera of a run's reconstruction (run_id, k, x, y, z; k from 0) beside the frame at the same share of the run.

    The n cameras are spread evenly over the run's frames, halves to the even number.
    """
    n = cameras.groupBy("run_id").agg(F.count(F.lit(1)).alias("n"))
    order = F.row_number().over(Window.partitionBy("run_id").orderBy("frame_idx")) - 1
    track = frames.select("run_id", order.alias("at"), geo.local_east(F.col("lon"), F.lit(origin[0]), F.lit(origin[1])).alias("dx"), geo.local_north(F.col("lat"), F.lit(origin[0])).alias("dy"))
    size = track.groupBy("run_id").agg((F.max("at") + 1).alias("m"))
    at = F.when(F.col("n") > 1, F.bround(F.col("k") * ((F.col("m") - 1) / (F.col("n") - 1)), 0)).otherwise(0).cast("int")
    spread = cameras.join(n, "run_id").join(size, "run_id").filter("n >= 2 and m >= 2")
    return spread.select("run_id", F.col("x").alias("sx"), F.col("z").alias("sy"), at.alias("at")).join(track, ["run_id", "at"]).drop("at")


def fit_similarities(pairs: DataFrame) -> DataFrame:
    """For each run the scale, turn and shift that carry (sx, sy) to (dx, dy); the scale is 1 where the source is one place."""
    names = ("sx", "sy", "dx", "dy")
    c = pairs.groupBy("run_id").agg(*[F.avg(n).alias(f"m_{n}") for n in names])
    centred = pairs.join(c, "run_id").select("run_id", *[(F.col(n) - F.col(f"m_{n}")).alias(n) for n in names], *[f"m_{n}" for n in names])
    total = lambda e: F.sum(F.expr(e))
    s = centred.groupBy("run_id", *[f"m_{n}" for n in names]).agg(
        total("sx * dx + sy * dy").alias("dot"), total("sx * dy - sy * dx").alias("cross"), total("sx * sx + sy * sy").alias("ss"), total("dx * dx + dy * dy").alias("dd"))
    s = s.withColumns({"scale": F.when(F.sqrt("ss") > 1e-9, F.sqrt(F.try_divide("dd", "ss"))).otherwise(1.0), "yaw": F.atan2("cross", "dot")})
    cos, sin = F.col("scale") * F.cos("yaw"), F.col("scale") * F.sin("yaw")
    return s.select("run_id", "scale", "yaw", (F.col("m_dx") - cos * F.col("m_sx") + sin * F.col("m_sy")).alias("tx"), (F.col("m_dy") - sin * F.col("m_sx") - cos * F.col("m_sy")).alias("ty"))


def point_cloud(points: DataFrame, cameras: DataFrame, frames: DataFrame, origin: tuple[float, float], budget: int = 400_000, threshold: float = 1.5) -> DataFrame:
    """One cloud for each run: sure and finite points of its reconstruction, set down on its track, at most ``budget``.

    ``points`` (run_id, seq, x, y, z, conf, ...), ``cameras`` (run_id, k, x, y, z). The path of the cameras is laid on
    the frames by scale, turn about the vertical and shift; runs of fewer than two cameras or frames stay as they are.
    """
    sure = cloud.clean_points(points, threshold)
    fit = F.broadcast(fit_similarities(path_pairs(cameras, frames, origin)))  # a row of five numbers for each run
    cos, sin = F.col("scale") * F.cos("yaw"), F.col("scale") * F.sin("yaw")
    laid = sure.join(fit, "run_id", "left").withColumns({
        "_x": F.when(F.col("scale").isNull(), F.col("x")).otherwise(cos * F.col("x") - sin * F.col("z") + F.col("tx")),
        "_y": F.coalesce(F.col("scale"), F.lit(1.0)) * F.col("y"),
        "_z": F.when(F.col("scale").isNull(), F.col("z")).otherwise(-(sin * F.col("x") + cos * F.col("z") + F.col("ty"))),
    })
    named = laid.drop("x", "y", "z", "scale", "yaw", "tx", "ty").withColumnsRenamed({"_x": "x", "_y": "y", "_z": "z"})
    return thin_to_budget(named.select(points.columns), budget)
