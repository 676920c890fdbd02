"""Approximate nearest neighbours by inner product through a forest of hash prefixes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayside.llm.common import materialise, table

#: Trees, and bits of a hash string.
TREES, BITS = 64, 24
#: Vectors of one forest, queries that search it together.
BLOCK, BUNDLE = 4096, 1024
#: A query ascends until its trees together offer so many entries for each vector of the block.
BREADTH = 0.3


class Forest:
    """For each tree the hash strings of all vectors in order: a path from the root is a prefix.

    Hashes are signs of projections. For inner products, vectors get a coordinate that brings them
    all to the length of the longest, and queries a zero, so that angles order as products do.
    """

    def __init__(self, vectors: np.ndarray, longest: float, seed: int = 5):
        self.vectors = vectors
        self.planes = np.random.default_rng(seed).standard_normal((vectors.shape[1] + 1, TREES * BITS)).astype(np.float32)
        squares = (vectors * vectors).sum(axis=1)
        rest = np.sqrt(np.maximum(0.0, longest * longest - squares))
        keys = self.hashes(np.column_stack([vectors, rest]))
        self.order = np.argsort(keys, axis=1, kind="stable")
        self.keys = np.take_along_axis(keys, self.order, axis=1)

    def hashes(self, augmented: np.ndarray) -> np.ndarray:
        scale = np.abs(augmented).max(axis=1, keepdims=True)
        bits = (augmented / np.where(scale > 0, scale, 1)).astype(np.float32) @ self.planes > 0
        weights = 1 << np.arange(BITS - 1, -1, -1, dtype=np.int64)
        return (bits.reshape(-1, TREES, BITS) @ weights).T.copy()

    def candidates(self, queries: np.ndarray, least: int) -> list[np.ndarray]:
        """Vectors that share with each query, in some tree, a prefix of the length at which the
        trees together offer at least ``least`` entries: all trees ascend from the longest match."""
        keys = self.hashes(np.column_stack([queries, np.zeros(len(queries))]))
        n = self.keys.shape[1]
        longest = np.zeros(len(queries), np.int64)
        for tree in range(TREES):
            at = np.searchsorted(self.keys[tree], keys[tree])
            for near in (np.maximum(at - 1, 0), np.minimum(at, n - 1)):
                differ = np.frexp((self.keys[tree][near] ^ keys[tree]).astype(np.float64))[1]
                longest = np.maximum(longest, BITS - differ)
        found: list = [None] * len(queries)
        for level in range(int(longest.max(initial=0)), -1, -1):
            active = np.array([i for i in range(len(queries)) if found[i] is None and longest[i] >= level], np.int64)
            if not len(active):
                continue
            shift = BITS - level
            prefix = keys[:, active] >> shift
            low = np.stack([np.searchsorted(self.keys[t], prefix[t] << shift) for t in range(TREES)])
            high = np.stack([np.searchsorted(self.keys[t], (prefix[t] + 1) << shift) for t in range(TREES)])
            enough = (high - low).sum(axis=0) >= least
            for j in np.flatnonzero(enough) if level else range(len(active)):
                mask = np.zeros(n, bool)
                for t in range(TREES):
                    mask[self.order[t, low[t, j] : high[t, j]]] = True
                found[active[j]] = np.flatnonzero(mask)
        return found


RESULT = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("vec_id", T.LongType()), T.StructField("score", T.DoubleType())])
ARROW_RESULT = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    values = column.combine_chunks()
    return values.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(values), -1)


def _search(k: int, breadth: float):
    def search(key: tuple, block: pa.Table, bundle: pa.Table) -> pa.Table:
        out = {"query_id": [], "vec_id": [], "score": []}
        if not block.num_rows or not bundle.num_rows:
            return pa.table({n: pa.array([], t) for n, t in zip(ARROW_RESULT.names, ARROW_RESULT.types, strict=True)})
        ids, vectors = block.column("vec_id").to_numpy(), _matrix(block.column("embedding"))
        own, queries = bundle.column("q_id").to_numpy(), _matrix(bundle.column("q_embedding"))
        forest = Forest(vectors, float(block.column("longest")[0].as_py()))
        least = max(4 * TREES * (k + 1), int(breadth * len(ids)))
        for query, vec_id, near in zip(queries, own, forest.candidates(queries, least), strict=True):
            near = near[ids[near] != vec_id]
            scores = vectors[near] @ query
            if len(near) > k:
                cut = np.partition(scores, len(near) - k)[len(near) - k]
                near = near[scores >= cut - 1e-9 * max(1.0, abs(cut))]
            # row by row in one order, so that equal vectors have equal products
            scores = (vectors[near] * query).sum(axis=1)
            best = np.lexsort((ids[near], -scores))[:k]
            out["query_id"].append(np.full(len(best), vec_id))
            out["vec_id"].append(ids[near][best])
            out["score"].append(scores[best])
        return pa.table({n: pa.array(np.concatenate(v)) for n, v in out.items()}).cast(ARROW_RESULT)

    return search


def sound_vectors(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding) of the rows that take part: not null or zero, all components finite numbers.

    Of rows that share an id the least vector counts.
    """
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return (
        vectors.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & fine)
        .filter(F.exists("embedding", lambda x: x != 0))
        .groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    )


def nearest(vectors: DataFrame, is_query, k: int = 20, breadth: float = BREADTH) -> DataFrame:
    """The ``k`` nearest found of each query, by largest inner product: query_id, rank, vec_id, score.

    ``is_query`` is a condition on vec_id. All rows that take part (``sound_vectors``) are indexed,
    in blocks of about BLOCK vectors that each have a forest; every block is searched by every
    bundle of queries, and the best of the blocks are merged. A query's own row is no candidate;
    if there are fewer than ``k`` others, all come. Ties go to the smaller id. Vectors of another
    length than a query aren't compared with it. An empty table gives no rows.
    """
    sound = sound_vectors(vectors).withColumn("dim", F.size("embedding"))
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    sound = materialise(sound.withColumn("norm", norm), "vectors")
    sizes = sound.groupBy("dim").agg(
        F.max("norm").alias("longest"),
        F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"),
        F.ceil(F.greatest(F.lit(1), F.sum(F.when(is_query, 1).otherwise(0))) / BUNDLE).cast("int").alias("bundles"),
    )
    placed = sound.drop("norm").join(sizes, "dim").withColumn("h", F.xxhash64("vec_id"))
    block, bundle = F.expr("cast(pmod(h, blocks) as int)"), F.expr("cast(pmod(h, bundles) as int)")
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    data = placed.select("dim", "vec_id", "embedding", "longest", block.alias("block"), upto("bundles").alias("bundle"))
    queries = placed.filter(is_query).select("dim", "vec_id", "embedding", bundle.alias("bundle"), upto("blocks").alias("block"))
    queries = queries.toDF("q_dim", "q_id", "q_embedding", "q_bundle", "q_block")
    keys = ["dim", "block", "bundle"]
    found = data.groupBy(*keys).cogroup(queries.groupBy("q_dim", "q_block", "q_bundle")).applyInArrow(_search(k, breadth), RESULT)
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7_nearest(spark, sf_dir):
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
