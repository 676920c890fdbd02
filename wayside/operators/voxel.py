"""Thinning point clouds to a budget: one point for each cell, the cell's size found from one pass.

Places become numbers of cells of the finest grid, 2^16 to a side of a run's cloud, interleaved to one
key. In order of keys, the highest bit in which neighbours differ tells for every doubling of the cell at
once how many cells are taken; only sizes between two doublings are counted one by one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayside.sources.sinks import written

#: Doublings of the cell from the finest grid to the whole cloud, and sizes tried within one doubling.
LEVELS, STEPS = 16, 32


def interleaved(x: Column, y: Column, z: Column) -> Column:
    """One number of 48 bits from three of 16, their bits by turns."""

    def spread(v: Column) -> Column:
        for shift, mask in ((16, 0x0000FF0000FF), (8, 0x00F00F00F00F), (4, 0x0C30C30C30C3), (2, 0x249249249249)):
            v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask).cast("long"))
        return v

    return spread(x).bitwiseOR(F.shiftleft(spread(y), 1)).bitwiseOR(F.shiftleft(spread(z), 2))


def finest_cells(points: DataFrame) -> DataFrame:
    """``points`` (run_id, seq, x, y, z, ...) with the numbers _ix, _iy, _iz of their cells in the finest grid of their run."""
    box = points.groupBy("run_id").agg(
        *[F.min(c).alias(f"_{c}0") for c in "xyz"], F.greatest(*[F.max(c) - F.min(c) for c in "xyz"]).alias("_side"), F.count(F.lit(1)).alias("_n"),
    )
    cell = lambda c: F.coalesce(F.least(F.floor((F.col(c) - F.col(f"_{c}0")) / (F.col("_side") / 2**LEVELS)), F.lit(2**LEVELS - 1)), F.lit(0)).cast("long")
    return points.join(box, "run_id").withColumns({f"_i{c}": F.when(F.col("_side") > 0, cell(c)).otherwise(F.lit(0)).cast("long") for c in "xyz"}).drop("_x0", "_y0", "_z0", "_side")


def first_of_cells(x: np.ndarray, y: np.ndarray, z: np.ndarray, budget: int) -> np.ndarray:
    """Which of one cloud's points, in order, ``thin_to_budget`` keeps where there are more than ``budget``."""
    side = max(c.max() - c.min() for c in (x, y, z))
    if not side > 0:
        return np.array([0])
    fine = [np.minimum(np.floor((c - c.min()) / (side / 2**LEVELS)), 2**LEVELS - 1).astype(np.int64) for c in (x, y, z)]

    def cells(m: int) -> np.ndarray:
        i, j, k = (c // m for c in fine)
        return (i << 2 * LEVELS) | (j << LEVELS) | k

    def within(m: int) -> bool:
        n = (2**LEVELS - 1) // m + 1
        if n**3 > 8 * len(x):
            return len(np.unique(cells(m))) <= budget
        taken = np.zeros(n**3, bool)
        i, j, k = (c // m for c in fine)
        taken[(i * n + j) * n + k] = True
        return np.count_nonzero(taken) <= budget

    # a doubling joins cells, so the count falls from one to the next
    low, high = 0, LEVELS
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if within(1 << middle) else (middle + 1, high)
    half = (1 << low) // 2
    sizes = [half - (-half * t // STEPS) for t in range(1, STEPS + 1)] if half else [1]
    return np.sort(np.unique(cells(next(m for m in sizes if within(m))), return_index=True)[1])


def thin_to_budget(points: DataFrame, budget: int) -> DataFrame:
    """At most ``budget`` points of each run: the first by ``seq`` of each cubic cell of one size.

    ``points`` (run_id, seq, x, y, z, and any other columns, which stay) have finite places. Sizes are whole
    multiples of the finest cell. The smallest power of two that keeps within the budget is taken, then of
    32 sizes down to half of that the smallest that keeps within it: so where size decides the count
    smoothly, a surface is left with 93 % of the budget or more. Runs within the budget keep all their points, runs of
    one place one of them. Repeated rows count; an empty table gives an empty one.

    The cloud is shuffled once, in order of keys, for all doublings; the sizes between two of them are counted from
    cells, not points, in one more aggregation.
    """
    if not {"run_id", "seq", "x", "y", "z"} <= set(points.columns):
        raise ValueError("points need run_id, seq, x, y and z")
    placed = finest_cells(points)
    crowded = placed.filter(F.col("_n") > budget).withColumn("_key", interleaved(*[F.col(f"_i{c}") for c in "xyz"]))
    by = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = crowded.drop("_n").repartitionByRange(by, "run_id", "_key", "seq").sortWithinPartitions("run_id", "_key", "seq")

    def firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The first point of each cell, with how many doublings join it with the one before it in this task."""
        run, key = None, -1
        for batch in batches:
            if not batch.num_rows:
                continue
            runs, keys = batch["run_id"].to_numpy(zero_copy_only=False), batch["_key"].to_numpy()
            before = np.append([key if runs[0] == run else -1], np.where(runs[1:] == runs[:-1], keys[:-1], -1)).astype(np.int64)
            run, key = runs[-1], keys[-1]
            # exponents of doubles are exact for numbers of 48 bits
            bit = np.frexp((keys ^ before).astype(np.float64))[1] - 1
            joined = np.where(before < 0, -1, bit // 3)
            new = (keys != before) | (before < 0)
            yield pa.RecordBatch.from_arrays([*[c for c in batch.columns], pa.array(joined, pa.int32())], [*batch.schema.names, "_joined"]).filter(pa.array(new))

    cells = ordered.mapInArrow(firsts, T.StructType([*ordered.schema, T.StructField("_joined", T.IntegerType())]))
    cells = written(cells.withColumn("_part", F.spark_partition_id()), "cells")
    # a task's first cell of a run meets the last one of the task before; equal keys across tasks are one cell
    edges = cells.groupBy("run_id", "_part").agg(F.min("_key").alias("first"), F.max("_key").alias("last"))
    across = F.col("first").bitwiseXOR(F.lag("last").over(Window.partitionBy("run_id").orderBy("_part")))
    at = F.when(across == 0, F.lit(-2)).otherwise(F.floor(F.log2(across.cast("double")) / 3))
    heads = edges.withColumn("at", F.coalesce(at, F.lit(-1))).select("run_id", "at")
    joins = cells.filter("_joined >= 0").groupBy("run_id", F.col("_joined").cast("long").alias("at")).agg(F.count(F.lit(1)).alias("n")).unionByName(heads.groupBy("run_id", F.col("at").cast("long")).agg(F.count(F.lit(1)).alias("n")))
    level = F.explode(F.sequence(F.lit(0), F.lit(LEVELS))).alias("level")
    taken = joins.select("run_id", "at", "n", level).groupBy("run_id", "level").agg(F.sum(F.when((F.col("at") == -1) | (F.col("at") >= F.col("level")), F.col("n")).otherwise(0)).alias("cells"))
    coarse = taken.filter(F.col("cells") <= budget).groupBy("run_id").agg(F.min("level").alias("level"))
    low = F.pow(F.lit(2), F.col("level") - 1).cast("long")
    sizes = F.when(F.col("level") == 0, F.array(F.lit(1).cast("long"))).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(1), F.lit(STEPS)), lambda t: low + F.ceil(low * t / STEPS))))
    tried = cells.join(F.broadcast(coarse.withColumn("_size", sizes)), "run_id").select("run_id", F.explode("_size").alias("_m"), "_ix", "_iy", "_iz")
    multiple = [F.floor(F.col(f"_i{c}") / F.col("_m")).alias(f"_i{c}") for c in "xyz"]
    counted = tried.select("run_id", "_m", *multiple).distinct().groupBy("run_id", "_m").agg(F.count(F.lit(1)).alias("cells"))
    size = written(counted.filter(F.col("cells") <= budget).groupBy("run_id").agg(F.min("_m").alias("_m")), "size")
    sized = cells.drop("_key", "_joined", "_part").join(size, "run_id").select("*", *[F.floor(F.col(f"_i{c}") / F.col("_m")).alias(f"_c{c}") for c in "xyz"])
    one = sized.groupBy("run_id", "_cx", "_cy", "_cz").agg(F.min_by(F.struct(*points.columns), F.struct("seq", "x", "y", "z")).alias("p")).select("p.*")
    return placed.filter(F.col("_n") <= budget).select(points.columns).unionByName(one)
