"""Writers."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def scratch(spark) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or the warehouse where that is unset."""
    return spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again, for what several later steps start from."""
    path = f"{scratch(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_detections(detections: DataFrame, path: str) -> None:
    """Append lines of JSON, a folder for each run; what is written stays when a later batch fails."""
    detections.write.mode("append").partitionBy("run_id").json(path)


def write_table(df: DataFrame, path: str) -> None:
    """Parquet by run; only the runs in ``df`` are replaced."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(path)


def as_json(df: DataFrame, order: list[str]) -> DataFrame:
    """One JSON array of each run's rows, in order."""
    body = F.struct(*[F.col(c) for c in df.columns if c != "run_id"])
    rows = df.withColumn("_row", F.struct(*order, F.to_json(body).alias("_json"))).groupBy("run_id").agg(F.array_sort(F.collect_list("_row")).alias("rows"))
    return rows.select("run_id", F.concat(F.lit("["), F.array_join(F.transform("rows", lambda r: r["_json"]), ","), F.lit("]")).alias("json"))


def write_gpx(track: DataFrame, path: str) -> None:
    points = track.orderBy("run_id", "seq").select(F.col("lat").alias("_lat"), F.col("lon").alias("_lon"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("time"))
    points.write.mode("overwrite").format("xml").option("rootTag", "trkseg").option("rowTag", "trkpt").save(path)


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).partitionBy("run_id").csv(path)


def write_lines(lines: DataFrame, path: str) -> None:
    lines.select("run_id", F.col(lines.columns[-1]).alias("value")).write.mode("overwrite").partitionBy("run_id").text(path)


def write_cloud(points: DataFrame, path: str, provenance: str) -> None:
    points.withColumn("provenance", F.lit(provenance)).write.mode("overwrite").parquet(path)


def append_cameras(cameras: DataFrame, path: str) -> None:
    """Add calibrated cameras to the table of cameras; earlier ones of a run stay."""
    cameras.write.mode("append").parquet(path)
