"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words, as bytes: blank and tab to carriage return. ``bytes.split()``
#: without arguments splits on exactly these.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Only where that is unset and Spark runs in this very process (tests) a temporary folder is made and set;
    on a cluster no folder of one machine would do, so there ValueError is raised.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="wayside-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    This cuts the lineage: an executor lost later costs a reread, not a recomputation. Shuffle files
    of jobs that are over go when the JVM collects their handles, hence the hint.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    spark.sparkContext._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)


def discard(*frames: DataFrame) -> None:
    """Delete materialised tables that no later plan reads."""
    for df in frames:
        spark = df.sparkSession
        for file in df.inputFiles()[:1]:
            path = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


SUMMARY = "slot long, summary binary"


def merge_summaries(
    parts: DataFrame, merge: Callable[[list[bytes]], bytes], fan_in: int = 16
) -> bytes | None:
    """Merge one binary summary per task into one, ``fan_in`` at a time.

    ``parts`` has a row (slot, summary) per task with slots from ``monotonically numbered`` tasks.
    Each level groups ``fan_in`` neighbours, so no task or driver step ever holds more than
    ``fan_in`` summaries, however many tasks there were.
    """

    def level(key: tuple, rows: pa.Table) -> pa.Table:
        merged = merge(rows.column("summary").to_pylist())
        return pa.table({"slot": pa.array([key[0].as_py()], pa.int64()), "summary": pa.array([merged], pa.binary())})

    while True:
        parts = materialise(parts, "summaries")
        # slots are task numbers: the highest says how many levels are left
        top = parts.agg(F.max("slot")).first()[0]
        if top is None:
            return None
        if top < fan_in:
            return merge([r[0] for r in parts.orderBy("slot").select("summary").collect()])
        parts = (
            parts.withColumn("g", F.expr(f"slot div {fan_in}"))
            .groupBy("g")
            .applyInArrow(level, SUMMARY)
        )


def emit_summary(data: bytes | None) -> Iterator[pa.RecordBatch]:
    """The one summary row of this task, under its task number."""
    from pyspark import TaskContext

    if data is not None:
        yield pa.RecordBatch.from_pydict(
            {"slot": pa.array([TaskContext.get().partitionId()], pa.int64()), "summary": pa.array([data], pa.binary())}
        )


def texts(column: pa.Array | pa.ChunkedArray) -> Iterator[str | None]:
    """The strings of an Arrow column, one at a time, whatever its string type."""
    for x in column:
        yield x.as_py()


def bundles(column: pa.Array, size: int) -> Iterator[pa.Array]:
    """Slices of a column of strings, each of about ``size`` bytes or one row."""
    before = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False))
    start = 0
    while start < len(column):
        stop = max(start + 1, int(np.searchsorted(before, (before[start - 1] if start else 0) + size, "right")))
        yield column.slice(start, stop - start)
        start = stop


#: A key with more than one in HOT of all rows is hot; there are fewer than HOT such keys.
HOT = 1000


def join_keyed(rows: DataFrame, side: DataFrame, key: str, n: str = "n", how: str = "inner") -> DataFrame:
    """``rows`` beside the row of ``side`` that has their ``key``, no key's rows meeting in one task.

    ``side`` has one row for each key and in ``n`` how many of ``rows`` hold it (which goes from
    the result). The fewer than HOT rows of hot keys are broadcast; rows of other keys are dealt by
    key. ``how`` is inner or left; null keys match nothing.
    """
    side = materialise(side, "side")
    total = side.agg(F.sum(n)).first()[0] or 0
    hot = side.filter(F.col(n) * HOT > total).drop(n)
    keys = F.broadcast(hot.select(key))
    rest = rows.join(keys, key, "left_anti").join(side.filter(F.col(n) * HOT <= total).drop(n), key, how)
    return rest.unionByName(rows.join(F.broadcast(hot), key))
