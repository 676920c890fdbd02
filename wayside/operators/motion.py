"""Observations of moving marks for calibration, with the way that the camera went meanwhile."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayside.functions import geo
from wayside.operators.route import nearest_in_time


def speeds(track: DataFrame) -> DataFrame:
    """``track`` (run_id, seq, t, lat, lon) with the speed over the legs before and behind each point, 0 where no time passes."""
    w = Window.partitionBy("run_id").orderBy("seq")
    leg = geo.haversine_m(F.lag("lat").over(w), F.lag("lon").over(w), F.col("lat"), F.col("lon"))
    legs = track.withColumn("_leg", leg)
    way = F.coalesce("_leg", F.lit(0.0)) + F.coalesce(F.lead("_leg").over(w), F.lit(0.0))
    passed = F.coalesce(F.lead("t").over(w), "t") - F.coalesce(F.lag("t").over(w), "t")
    return legs.withColumn("speed", F.when(passed > 0, way / passed).otherwise(0.0)).drop("_leg")


def pairs_at_speed(marks: DataFrame, track: DataFrame, dt: float, least: float = 3.0, offset_s: float = 0.0) -> DataFrame:
    """Marks (run_id, t, v1, v2, ...) with ``speed`` and ``dist``, the way in the ``dt`` seconds from ``t``; slow ones go.

    The speed is that of the track at the point nearest in time (the earlier of two) to ``t`` and ``offset_s``. Below ``least`` a mark
    hardly moves, so a stop would only add noise. Runs without a track have no pairs.
    """
    at = nearest_in_time(marks.withColumnRenamed("t", "_t").withColumn("t", F.col("_t") + offset_s), speeds(track), ["seq", "speed"])
    moving = at.withColumn("speed", F.col("near.speed")).filter(F.col("speed") >= least)
    return moving.drop("t", "near", "before", "after").withColumnRenamed("_t", "t").withColumn("dist", F.col("speed") * dt)
