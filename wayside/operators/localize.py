"""Detections placed on the ground."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayside.functions import geo

# The camera taken where none is known, and the cameras that are.
DEFAULT_CAMERA = {"height_m": 1.4, "vfov_deg": 58.0, "hfov_deg": 90.0, "pitch_offset_frac": 0.0, "max_range_m": 60.0}
DASHCAM = {"height_m": 1.35, "vfov_deg": 58.0, "hfov_deg": 90.0, "pitch_offset_frac": 0.0, "max_range_m": 60.0}


def camera_columns(camera: dict[str, float]) -> dict:
    return {k: F.lit(float(v)) for k, v in camera.items()}


def with_camera(runs: DataFrame, cameras: DataFrame, name: str = "camera") -> DataFrame:
    """Runs with the calibration of their camera, the default's where it is unknown. Cameras are few."""
    known = runs.join(F.broadcast(cameras.withColumnRenamed("name", name)), name, "left")
    return known.withColumns({k: F.coalesce(k, F.lit(v)) for k, v in DEFAULT_CAMERA.items()})


def localize(detections: DataFrame, frames: DataFrame, taxonomy: DataFrame, camera: dict[str, float] | DataFrame) -> DataFrame:
    """Detections with lat, lon, range_m and anchor.

    The anchor is the lower edge for point classes and unknown ones, the centre for others. Above
    the horizon or out of range the camera's place is taken and range_m is null. Detections of
    unknown frames keep null positions. The taxonomy is a small dimension.
    ``camera`` is one for all runs, or a table with each run's (run_id and the columns that ``with_camera`` gives); a run that isn't
    in it has the default's.
    """
    place = frames.select("run_id", "frame_id", F.col("lat").alias("f_lat"), F.col("lon").alias("f_lon"), "heading_deg", "width", "height")
    cam = {k: F.col(f"_{k}") for k in DEFAULT_CAMERA}
    if isinstance(camera, dict):
        cam = camera_columns(camera)
    else:
        own = camera.select("run_id", *[F.col(k).alias(f"_{k}") for k in DEFAULT_CAMERA if k in camera.columns])
        place = place.join(own, "run_id", "left")
        place = place.withColumns({f"_{k}": F.coalesce(f"_{k}", F.lit(v)) if k in camera.columns else F.lit(v) for k, v in DEFAULT_CAMERA.items()})
    known = detections.join(place, ["run_id", "frame_id"], "left").join(
        F.broadcast(taxonomy.select("cls", "geometry")), "cls", "left"
    )
    geometry = F.coalesce("geometry", F.lit("point"))
    ground = geo.ground_range(
        geo.anchor_u(F.col("box"), F.col("width")), geo.anchor_v(F.col("box"), F.col("height"), geometry),
        F.col("width"), F.col("height"), cam,
    )
    g = F.col("_g")
    here = (F.col("f_lat"), F.col("heading_deg"))
    return known.withColumn("_g", ground).select(
        *detections.columns,
        F.when(g.isNull(), F.col("f_lat")).otherwise(geo.ground_lat(g["forward"], g["lateral"], *here)).alias("lat"),
        F.when(g.isNull(), F.col("f_lon")).otherwise(geo.ground_lon(g["forward"], g["lateral"], F.col("f_lat"), F.col("f_lon"), F.col("heading_deg"))).alias("lon"),
        F.round(g["forward"], 2).alias("range_m"),
        F.when(F.col("width").isNotNull(), F.when(geometry == "point", "bottom").otherwise("centre")).alias("anchor"),
    )


def range_stats(localized: DataFrame) -> DataFrame:
    """Least, upper median and greatest range of each run."""
    ranges = F.array_sort(F.collect_list("range_m"))
    return (
        localized.groupBy("run_id").agg(F.min("range_m").alias("min_m"), F.max("range_m").alias("max_m"), F.count("range_m").alias("ranged"), ranges.alias("_r"))
        .withColumn("median_m", F.get("_r", F.floor(F.size("_r") / 2).cast("int"))).drop("_r")
    )
