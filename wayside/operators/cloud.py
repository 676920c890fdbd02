"""Point clouds, map tiles and surroundings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayside.functions import geo, text
from wayside.operators.voxel import thin_to_budget


def clean_points(points: DataFrame, threshold: float) -> DataFrame:
    """Points of enough confidence with finite places."""
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < float("inf"))
    return points.filter((F.col("conf") >= threshold) & finite("x") & finite("y") & finite("z"))


def voxel_cells(points: DataFrame, size: float) -> DataFrame:
    """The first point, by ``seq``, of each cell of ``size``."""
    lo = points.agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.min("z").alias("z0"))
    cell = [F.floor((F.col(c) - F.col(f"{c}0")) / size).alias(f"c{c}") for c in "xyz"]
    keyed = points.join(F.broadcast(lo)).select("seq", "x", "y", "z", *cell)
    return keyed.groupBy("cx", "cy", "cz").agg(F.min(F.struct("seq", "x", "y", "z")).alias("p")).select("p.*")


def voxel_downsample(points: DataFrame, budget: int) -> DataFrame:
    """One cloud's points (seq, x, y, z) thinned to at most ``budget``; see ``voxel.thin_to_budget``, which does it for many."""
    own = points.select(F.lit(0).cast("long").alias("run_id"), "seq", "x", "y", "z")
    return thin_to_budget(own, budget).drop("run_id")


def fit_depth_scale(samples: DataFrame, least: int = 40) -> DataFrame:
    """For each frame a and b so that 1/depth = a * d + b fits the ground, where there are samples enough.

    ``samples`` (frame, d, ground_m).
    """
    fit = samples.filter("ground_m > 0").groupBy("frame").agg(
        F.regr_slope(1 / F.col("ground_m"), F.col("d")).alias("a"), F.regr_intercept(1 / F.col("ground_m"), F.col("d")).alias("b"), F.regr_count(F.col("ground_m"), F.col("d")).alias("n"))
    return fit.filter(F.col("n") >= least)


def ground_samples(depth: DataFrame, across: int, down: int, width: int, height: int, cam: dict, rows: int = 60, cols: int = 18) -> DataFrame:
    """Samples (frame, d, ground_m) of depth maps (frame, y, x, d) of ``across`` x ``down`` cells, on a grid over the road ahead.

    The grid spans the frame from 12 rows below the horizon to 2 above the bottom and the middle
    three fifths of the columns; points that the camera can't range are left out.
    """
    h = F.lit(float(height))
    c = {k: F.lit(float(v)) for k, v in cam.items()}
    top = geo.horizon_row(h, c["pitch_offset_frac"]) + 12
    steps = depth.sparkSession.range(rows * cols).select((F.col("id") / cols).cast("long").alias("i"), (F.col("id") % cols).alias("j"))
    v = top + F.col("i") * ((h - 2 - top) / (rows - 1))
    u = width * 0.2 + F.col("j") * (width * 0.6 / (cols - 1))
    z = c["height_m"] * geo.focal_px(h, c["vfov_deg"]) / (v - geo.horizon_row(h, c["pitch_offset_frac"]))
    cell = lambda at, side, n: F.greatest(F.lit(0), F.least(F.lit(n - 1), F.floor(at / side * n))).cast("long")
    grid = steps.select(cell(v, height, down).alias("y"), cell(u, width, across).alias("x"), z.alias("ground_m"), (v > geo.horizon_row(h, c["pitch_offset_frac"])).alias("_below")).filter((F.col("ground_m") > 0) & F.col("_below") & (F.col("ground_m") <= c["max_range_m"]))
    return depth.join(F.broadcast(grid), ["y", "x"]).select("frame", "d", "ground_m")


def back_project(samples: DataFrame, fits: DataFrame, near_m: float, far_m: float) -> DataFrame:
    """Samples with their distance, those within the band."""
    z = F.try_divide(F.lit(1.0), F.col("a") * F.col("d") + F.col("b"))
    return samples.join(fits.select("frame", "a", "b"), "frame").withColumn("z_m", z).filter(F.col("z_m").between(near_m, far_m)).drop("a", "b")


def fit_similarity(pairs: DataFrame) -> DataFrame:
    """Scale, yaw and shift that carry (sx, sy) to (dx, dy) best; one row."""
    c = pairs.agg(*[F.avg(n).alias(f"m_{n}") for n in ("sx", "sy", "dx", "dy")])
    centred = pairs.join(F.broadcast(c)).select(*[(F.col(n) - F.col(f"m_{n}")).alias(n) for n in ("sx", "sy", "dx", "dy")], *[f"m_{n}" for n in ("sx", "sy", "dx", "dy")])
    s = centred.groupBy("m_sx", "m_sy", "m_dx", "m_dy").agg(
        F.sum(F.col("sx") * F.col("dx") + F.col("sy") * F.col("dy")).alias("dot"), F.sum(F.col("sx") * F.col("dy") - F.col("sy") * F.col("dx")).alias("cross"),
        F.sum(F.col("sx") * F.col("sx") + F.col("sy") * F.col("sy")).alias("ss"), F.sum(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")).alias("dd"),
    )
    fit = s.withColumn("scale", F.sqrt(F.try_divide("dd", "ss"))).withColumn("yaw", F.atan2("cross", "dot"))
    turned = lambda a, b, sign: F.col("scale") * (F.cos("yaw") * F.col(a) + sign * F.sin("yaw") * F.col(b))
    return fit.select("scale", "yaw", (F.col("m_dx") - turned("m_sx", "m_sy", -1)).alias("tx"), (F.col("m_dy") - turned("m_sy", "m_sx", 1)).alias("ty"))


def georeference(points: DataFrame, fit: DataFrame) -> DataFrame:
    """Cloud points carried to east and south of the origin by a fitted similarity."""
    c, s = F.cos("yaw") * F.col("scale"), F.sin("yaw") * F.col("scale")
    return points.join(F.broadcast(fit)).select("seq", (c * F.col("x") - s * F.col("y") + F.col("tx")).alias("x"), (F.col("z") * F.col("scale")).alias("y"), (-(s * F.col("x") + c * F.col("y") + F.col("ty"))).alias("z"))


def route_boxes(frames: DataFrame, margin_m: float) -> DataFrame:
    """The box around each run's frames, widened on all sides."""
    b = frames.groupBy("run_id").agg(F.min("lat").alias("s"), F.max("lat").alias("n"), F.min("lon").alias("w"), F.max("lon").alias("e"), F.avg("lat").alias("mid"))
    dy, dx = margin_m / geo.M_PER_DEG_LAT, margin_m / geo.m_per_deg_lon(F.col("mid"))
    return b.select("run_id", (F.col("s") - dy).alias("south"), (F.col("w") - dx).alias("west"), (F.col("n") + dy).alias("north"), (F.col("e") + dx).alias("east"))


def tile_cover(boxes: DataFrame, zoom: int, most: int = 256) -> DataFrame:
    """All tiles that cover each box; ``over`` says that a run needs more than ``most``."""
    z = F.lit(zoom)
    whole = lambda c: F.floor(c).cast("long")
    ends = boxes.select("run_id", whole(geo.tile_x(F.col("west"), z)).alias("x0"), whole(geo.tile_x(F.col("east"), z)).alias("x1"), whole(geo.tile_y(F.col("north"), z)).alias("y0"), whole(geo.tile_y(F.col("south"), z)).alias("y1"))
    over = (F.col("x1") - F.col("x0") + 1) * (F.col("y1") - F.col("y0") + 1) > most
    columns = ends.select("run_id", F.explode(F.sequence("x0", "x1")).alias("x"), "y0", "y1", over.alias("over"))
    return columns.select("run_id", "x", F.explode(F.sequence("y0", "y1")).alias("y"), "over")


def tile_extents(cover: DataFrame, zoom: int, origin: tuple[float, float], tile_px: int = 256) -> DataFrame:
    """Where the stitched tiles of each run (run_id, x, y) lie: their own edges, in degrees and in metres of the scene, and metres for each pixel."""
    z = F.lit(zoom)
    t = cover.groupBy("run_id").agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    n = 2.0**zoom
    lon = lambda x: x / n * 360 - 180
    edges = t.select(
        "run_id", (F.col("x1") - F.col("x0") + 1).alias("nx"), (F.col("y1") - F.col("y0") + 1).alias("ny"), lon(F.col("x0")).alias("west"), lon(F.col("x1") + 1).alias("east"),
        geo.tile_lat(F.col("y0"), z).alias("north"), geo.tile_lat(F.col("y1") + 1, z).alias("south"),
    )
    east = lambda c: geo.local_east(F.col(c), F.lit(origin[0]), F.lit(origin[1]))
    south = lambda c: -geo.local_north(F.col(c), F.lit(origin[0]))
    placed = edges.withColumns({"x_min": east("west"), "x_max": east("east"), "z_min": south("north"), "z_max": south("south")})
    return placed.withColumn("m_per_px", (F.col("x_max") - F.col("x_min")) / (F.col("nx") * tile_px))


def scene_boxes(frames: DataFrame, origin: tuple[float, float], least_m: float = 40.0) -> DataFrame:
    """The middle of each run in metres of the scene (x to the east, z to the south), and the span that a view of it has to hold."""
    at = frames.withColumn("_p", geo.scene_xz(F.col("lat"), F.col("lon"), F.lit(origin[0]), F.lit(origin[1])))
    b = at.groupBy("run_id").agg(*[f(f"_p.{c}").alias(f"{c}_{n}") for c in "xz" for n, f in (("min", F.min), ("max", F.max))])
    middle = lambda c: (F.col(f"{c}_min") + F.col(f"{c}_max")) / 2
    return b.select("*", middle("x").alias("x_mid"), middle("z").alias("z_mid"), F.greatest(F.col("x_max") - F.col("x_min"), F.col("z_max") - F.col("z_min"), F.lit(least_m)).alias("span_m"))


def cloud_boxes(points: DataFrame) -> DataFrame:
    """The box around each run's cloud (run_id, x, y, z), and how many points it holds."""
    return points.groupBy("run_id").agg(F.count(F.lit(1)).alias("n"), *[f(c).alias(f"{c}_{n}") for c in "xyz" for n, f in (("min", F.min), ("max", F.max))])


def surroundings(elements: DataFrame, boxes: DataFrame) -> DataFrame:
    """Buildings and roads (osm_id, kind, ...) of map elements that overlap each run's box.

    ``elements`` (type, id, tags map, geometry array of lat, lon): ways with four places and a
    building tag, else two and a highway tag.
    """
    tag = lambda *names: F.coalesce(*[F.nullif(F.col("tags")[n], F.lit("")) for n in names])
    g = F.filter("geometry", lambda p: p["lat"].isNotNull() & p["lon"].isNotNull())
    ways = elements.filter("type = 'way'").withColumn("path", g)
    kind = F.when(F.col("tags")["building"].isNotNull() & (F.size("path") >= 4), "building").when(F.col("tags")["highway"].isNotNull() & (F.size("path") >= 2), "road")
    lats, lons = F.transform("path", lambda p: p["lat"]), F.transform("path", lambda p: p["lon"])
    found = ways.withColumn("kind", kind).filter("kind is not null").select(
        F.col("id").alias("osm_id"), "kind", F.when(kind == "building", text.building_height(tag("height", "building:height"), tag("building:levels", "levels"))).alias("height_m"),
        F.col("tags")["name"].alias("name"), "path", F.array_min(lats).alias("s"), F.array_max(lats).alias("n"), F.array_min(lons).alias("w"), F.array_max(lons).alias("e"),
    )
    # both sides are spread over map tiles, so the overlap test has an equal key
    span = lambda a, b: F.sequence(F.floor(a).cast("long"), F.floor(b).cast("long"))
    z = F.lit(14)
    spread = lambda df, s_, n_, w_, e_: df.withColumn("tx", F.explode(span(geo.tile_x(F.col(w_), z), geo.tile_x(F.col(e_), z)))).withColumn("ty", F.explode(span(geo.tile_y(F.col(n_), z), geo.tile_y(F.col(s_), z))))
    boxes, found = spread(boxes, "south", "north", "west", "east"), spread(found, "s", "n", "w", "e")
    overlap = (F.col("s") <= F.col("north")) & (F.col("n") >= F.col("south")) & (F.col("w") <= F.col("east")) & (F.col("e") >= F.col("west"))
    hit = boxes.join(found, ["tx", "ty"]).filter(overlap)
    return hit.drop("tx", "ty", "s", "n", "w", "e", "south", "north", "west", "east").dropDuplicates(["run_id", "osm_id"])
