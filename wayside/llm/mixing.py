"""Mixing sources to target weights by capped water-filling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayside.llm.common import WORD_PATTERN, materialise

#: Hexadecimal digits of the shuffle key that form a bucket: 4096 buckets for each source.
BUCKET_DIGITS = 3
#: Sources whose plan is broadcast; beyond that, rows and plan are dealt by source and salt.
BROADCAST_SOURCES, SALTS = 1 << 16, 64


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def shuffle_key(doc_id: Column, seed: int) -> Column:
    """A seeded key in [0, 16**32) that depends on nothing but the id."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))))


def water_fill(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = 3) -> DataFrame:
    """Targets of sources: the total size shared by weight, no source above ``max_epochs`` times its size.

    ``sizes`` has (source, source_size); sources in code point order, null last, get ``weights`` in
    turn. Clamping the fullest source and sharing what is over by weight until none is above ends
    in one level: sources ordered by the level at which they fill up are clamped while the level
    that the rest would then have still reaches them. Adds weight and target (double). The windows
    run over one row for each source, in one task: some millions of sources at most.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    filled = Window.orderBy("full_at", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    rank = F.row_number().over(order) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (rank % len(weights) + 1).cast("int"))
    ranked = sizes.withColumn("weight", weight.cast("long")).withColumn("cap", F.col("source_size") * max_epochs)
    ranked = ranked.select(
        "*",
        (F.col("cap") / F.col("weight")).alias("full_at"),
        F.sum("source_size").over(every).alias("total"),
        F.sum("weight").over(every).alias("weights"),
    )
    level = (F.col("total") - F.coalesce(F.sum("cap").over(filled), F.lit(0))) / (
        F.col("weights") - F.coalesce(F.sum("weight").over(filled), F.lit(0))
    )
    ranked = ranked.withColumn("clamped", F.col("full_at") <= level)
    left = F.col("total") - F.sum(F.when(F.col("clamped"), F.col("cap")).otherwise(0)).over(every)
    open_weight = F.sum(F.when(F.col("clamped"), 0).otherwise(F.col("weight"))).over(every)
    target = F.when(F.col("clamped"), F.col("cap").cast("double")).otherwise(F.col("weight") * left / open_weight)
    return ranked.select("source", "source_size", "weight", target.alias("target"))


def plan_sources(sized: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = 3) -> DataFrame:
    """For each source its target, whole repetitions of every document, and ``cut``.

    Documents whose shuffle key is at most ``cut`` are repeated once more. Within a source, ordered
    by key, these are the ones whose middle word falls within the fractional rest of the target.
    The cut is found in two steps, sums of buckets of the key first and then the rows of one bucket
    (1/4096 of the source), so that no task orders a whole source.
    """
    bucket = F.substring("key", 1, BUCKET_DIGITS)
    by_bucket = sized.groupBy("source", bucket.alias("bucket")).agg(F.sum("size").alias("bucket_size"))
    sizes = by_bucket.groupBy("source").agg(F.sum("bucket_size").alias("source_size"))
    targets = water_fill(sizes, weights, max_epochs)
    whole = F.coalesce(F.floor(F.try_divide(F.col("target"), F.col("source_size"))), F.lit(0)).cast("long")
    targets = targets.withColumn("whole", whole).withColumn(
        "rest", F.col("target") - F.col("whole") * F.col("source_size")
    )
    before = F.coalesce(
        F.sum("bucket_size").over(
            Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        ),
        F.lit(0),
    )
    t = targets.select(F.col("source").alias("t_source"), "rest")
    edge = (
        by_bucket.withColumn("before", before)
        .join(t, F.col("source").eqNullSafe(F.col("t_source")))
        .filter((F.col("before") < F.col("rest")) & (F.col("rest") <= F.col("before") + F.col("bucket_size")))
        .select("t_source", "rest", "before", "bucket")
    )
    by_key = (
        sized.join(edge, F.col("source").eqNullSafe(F.col("t_source")) & (bucket == F.col("bucket")))
        .groupBy("t_source", "bucket", "rest", "before", "key")
        .agg(F.sum("size").alias("key_size"))
    )
    start = F.col("before") + F.coalesce(
        F.sum("key_size").over(
            Window.partitionBy("t_source", "bucket").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
        ),
        F.lit(0),
    )
    cuts = (
        by_key.withColumn("start", start)
        .groupBy("t_source", "bucket")
        .agg(
            F.max(
                F.when(
                    (F.col("start") < F.col("rest")) & (2 * F.col("start") + F.col("key_size") <= 2 * F.col("rest")),
                    F.col("key"),
                )
            ).alias("last")
        )
        .select("t_source", F.coalesce("last", "bucket").alias("cut"))
    )
    return targets.join(cuts, F.col("source").eqNullSafe(F.col("t_source")), "left").drop("t_source")


def with_plan(rows: DataFrame, plan: DataFrame, salt: Column) -> DataFrame:
    """Each row beside its source's row of ``plan`` (whose source is ``p_source``).

    The plan is counted first. Up to BROADCAST_SOURCES it goes to the rows, which stay where they
    are; a larger one is repeated under every salt, so that no source's rows meet in one task.
    """
    plan = materialise(plan.withColumnRenamed("source", "p_source"), "plan")
    same = rows["source"].eqNullSafe(plan["p_source"])
    if plan.count() <= BROADCAST_SOURCES:
        return rows.join(F.broadcast(plan), same)
    plan = plan.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = rows.withColumn("_row_salt", F.pmod(F.xxhash64(salt), F.lit(SALTS)).cast("int"))
    return rows.join(plan, same & (F.col("_row_salt") == F.col("_salt"))).drop("_salt", "_row_salt")


def sized_documents(docs: DataFrame, seed: int) -> DataFrame:
    return docs.select(
        "doc_id", "source", word_count(F.col("text")).alias("size"), shuffle_key(F.col("doc_id"), seed).alias("key")
    )


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = 3, seed: int = 17) -> DataFrame:
    """What a mix takes of each document.

    Returns doc_id, source, size (words), source_size, target, repeats and taken (= size * repeats).
    Null text has size 0; null is a source of its own; a source without words has target 0 and takes
    each document 0 times. Rows that share a doc_id are repeated alike. An empty table gives no rows.
    Other columns are not read. Reruns agree: only the ids and the seed decide.
    """
    sized = materialise(sized_documents(docs, seed), "mix")
    plan = plan_sources(sized, weights, max_epochs)
    repeats = F.col("whole") + F.when(F.col("key") <= F.col("cut"), 1).otherwise(0)
    return (
        with_plan(sized, plan, F.col("key"))
        .withColumn("repeats", repeats.cast("long"))
        .select(
            "doc_id", "source", "size", "source_size", "target", "repeats",
            (F.col("size") * F.col("repeats")).alias("taken"),
        )
    )


def mix_documents(
    docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = 3, seed: int = 17
) -> DataFrame:
    """The mixed documents themselves: each row of ``docs`` as many times as the mix repeats it.

    The plan holds a row for each source and is broadcast, so the texts stay where they lie. Null
    texts have size 0 and are repeated like others of their source. An empty table gives no rows;
    all columns stay as they are.
    """
    columns = docs.columns
    sized = materialise(sized_documents(docs, seed), "mix")
    plan = plan_sources(sized, weights, max_epochs).select(
        "source", F.struct("whole", "cut").alias("_plan")
    )
    key = shuffle_key(docs["doc_id"], seed)
    repeats = F.col("_plan.whole") + F.when(key <= F.col("_plan.cut"), 1).otherwise(0)
    mixed = with_plan(docs, plan, key).withColumn("_copy", F.explode(F.array_repeat(F.lit(0), repeats.cast("int"))))
    return mixed.select(*[docs[c] for c in columns])


def op5_mix(spark, sf_dir):
    from wayside.llm.common import table

    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('17:' || coalesce(doc_id::VARCHAR, 'null')) AS key
  FROM documents),
src AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
ranked AS (
  SELECT *, 1 + (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 AS weight, source_size * 3 AS cap,
         (sum(source_size) OVER ())::BIGINT AS total FROM src),
leveled AS (
  SELECT *, (sum(weight) OVER ())::BIGINT AS weights, cap::DOUBLE / weight AS full_at FROM ranked),
flagged AS (
  SELECT *, full_at <= (total - coalesce(sum(cap) OVER w, 0))::DOUBLE / (weights - coalesce(sum(weight) OVER w, 0)) AS clamped
  FROM leveled
  WINDOW w AS (ORDER BY full_at, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (
  SELECT source, source_size,
         CASE WHEN clamped THEN cap::DOUBLE ELSE
           weight * (total - sum(CASE WHEN clamped THEN cap ELSE 0 END) OVER ())::DOUBLE
             / (sum(CASE WHEN clamped THEN 0 ELSE weight END) OVER ())::DOUBLE END AS target
  FROM flagged),
keyed AS (
  SELECT source, key, sum(size)::BIGINT AS key_size FROM sized GROUP BY source, key),
started AS (
  SELECT *, coalesce(sum(key_size) OVER (PARTITION BY source ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM keyed),
plan AS (
  SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE floor(target / source_size) END::BIGINT AS whole FROM targets),
taken AS (
  SELECT s.source, s.key, p.source_size, p.target, p.whole +
         CASE WHEN s.start < p.target - p.whole * p.source_size
               AND 2 * s.start + s.key_size <= 2 * (p.target - p.whole * p.source_size) THEN 1 ELSE 0 END AS repeats
  FROM started s JOIN plan p ON s.source IS NOT DISTINCT FROM p.source)
SELECT d.doc_id, d.size, t.source_size, t.target, (d.size * t.repeats)::BIGINT AS taken
FROM sized d JOIN taken t ON d.key = t.key AND d.source IS NOT DISTINCT FROM t.source
"""
