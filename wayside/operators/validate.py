"""What is wrong with rows of survey tables, and the split into sound rows and the rest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_violations(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """``rows`` with ``violations``, the names of the rules that they break, in the order given.

    A rule that comes to null is broken, so a rule on a column that may be null says so itself.
    """
    broken = F.array(*[F.when(~F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items()])
    return rows.withColumn("violations", F.array_compact(broken))


def split(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sound rows without ``violations``, and the others with them."""
    sound = F.size("violations") == 0
    return checked.filter(sound).drop("violations"), checked.filter(~sound)


def detection_rules() -> dict[str, Column]:
    """Of detections whose box is an array: bands of severity and confidence, four finite corners, a positive range if any."""
    return {
        "severity": F.col("severity").between(1, 5),
        "confidence": F.col("confidence").between(0.0, 1.0),
        "box": (F.size("box") == 4) & F.forall("box", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))),
        "range_m": F.col("range_m").isNull() | (F.col("range_m") > 0),
    }


def frame_rules() -> dict[str, Column]:
    return {
        "size": (F.col("width") > 0) & (F.col("height") > 0),
        "place": F.col("lat").between(-90.0, 90.0) & F.col("lon").between(-180.0, 180.0),
        "time": F.col("t_sec") >= 0,
    }


def segment_rules() -> dict[str, Column]:
    return {"quality_index": F.col("quality_index").between(0.0, 100.0), "length_m": F.col("length_m") >= 0}


def zone_rules() -> dict[str, Column]:
    return {"polygon": F.size("polygon") >= 3}


def mask_rules() -> dict[str, Column]:
    """Of runs of a mask: none is empty or starts left of the frame."""
    return {"run": (F.col("col_start") >= 0) & (F.col("col_end") >= F.col("col_start"))}
