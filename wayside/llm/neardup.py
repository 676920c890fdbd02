"""Near-duplicate documents by min-max hashing of word shingles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayside.llm.common import discard, join_keyed, materialise, table, texts

SHINGLE = 5
#: 64 permutations give 128 values, in 32 bands of 4: a pair at similarity 0.75 misses every band
#: with probability (1 - 0.75 ** 4) ** 32, five in a million, and less above.
PERMUTATIONS, ROWS = 64, 4
_SEEDS = np.random.default_rng(20240501).integers(0, 1 << 63, (4, PERMUTATIONS), np.uint64)
FACTORS, SHIFTS = (_SEEDS[0] << np.uint64(1)) | np.uint64(1), _SEEDS[1]
PLACES = (_SEEDS[2][:SHINGLE] << np.uint64(1)) | np.uint64(1)
BAND_FACTORS = (_SEEDS[3] << np.uint64(1)) | np.uint64(1)
#: Shingles that are hashed under all permutations at once.
PIECE = 1 << 14
#: Word hashes that a worker holds before it starts anew.
CACHE = 200_000


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > CACHE:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def shingles(words: list[bytes], hashes: WordHashes) -> np.ndarray:
    """The distinct shingles as sorted 64-bit hashes; fewer than five words are one shingle."""
    if not words:
        return np.empty(0, np.uint64)
    codes = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    n = max(1, len(codes) - SHINGLE + 1)
    total = np.full(n, min(len(codes), SHINGLE), np.uint64)
    for i in range(min(len(codes), SHINGLE)):
        total += codes[i : i + n] * PLACES[i]
        total ^= total >> np.uint64(29)
    return np.unique(mixed(total))


def signature(sh: np.ndarray) -> np.ndarray:
    """Least and greatest value of the set under each permutation: 2 * PERMUTATIONS values."""
    low = high = None
    for at in range(0, len(sh), PIECE):
        values = FACTORS[:, None] * sh[None, at : at + PIECE] + SHIFTS[:, None]
        a, b = values.min(axis=1), values.max(axis=1)
        low, high = (a, b) if low is None else (np.minimum(low, a), np.maximum(high, b))
    return np.concatenate([low, high])


def bands(sig: np.ndarray) -> np.ndarray:
    """One hash for each band. Minima and maxima of a permutation lie in different bands."""
    rows = sig.reshape(-1, ROWS)
    total = np.arange(len(rows), dtype=np.uint64)
    for i in range(ROWS):
        total = mixed(total * BAND_FACTORS[i] + rows[:, i])
    return total.view(np.int64)


FEATURES = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("n_shingles", T.LongType()), T.StructField("content", T.BinaryType()), T.StructField("bands", T.ArrayType(T.LongType()))]
)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    for batch in batches:
        counts, contents, rows = [], [], []
        for text in texts(batch.column("text")):
            words = words_of(text)
            sh = shingles(words, hashes)
            counts.append(len(sh))
            contents.append(xxhash.xxh3_128_digest(b" ".join(words)) if words else None)
            rows.append(bands(signature(sh)) if len(sh) else np.empty(0, np.int64))
        ends = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(contents, pa.binary()),
                pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, np.int64), *rows]))),
            ],
            names=["doc_id", "n_shingles", "content", "bands"],
        )


PAIR = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (a, b, text_a, text_b) the pairs whose full shingle sets are similar enough."""
    hashes, last, last_set = WordHashes(), None, None
    for batch in batches:
        a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
        keep = []
        for i, (x, y) in enumerate(zip(texts(batch.column("text_a")), texts(batch.column("text_b")), strict=True)):
            if b[i] != last:
                last, last_set = b[i], shingles(words_of(y), hashes)
            mine = shingles(words_of(x), hashes)
            both = len(np.intersect1d(mine, last_set, assume_unique=True))
            keep.append(100 * both >= 75 * (len(mine) + len(last_set) - both))
        yield pa.RecordBatch.from_pydict(
            {"a": pa.array([v for v, k in zip(a, keep, strict=True) if k], pa.int64()), "b": pa.array([v for v, k in zip(b, keep, strict=True) if k], pa.int64())}
        )


def confirmed(pairs: DataFrame, candidates: DataFrame) -> DataFrame:
    """The links among ``pairs`` (a, b), tested on whole texts. Texts travel once for each pair."""
    one = candidates.select(F.col("rep").alias("a"), F.col("text").alias("text_a"))
    two = candidates.select(F.col("rep").alias("b"), F.col("text").alias("text_b"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "text_a", "text_b").mapInArrow(_confirm, PAIR)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges`` (a, b): (rep, component), the component its least node.

    Large-star and small-star steps in turn: every node links its greater neighbours, then its
    lesser ones, to the least node it knows. The edges end as stars. Each step is written in the
    shared folder; the driver sees two numbers for each round.
    """

    def linked(df: DataFrame) -> DataFrame:
        return df.filter("a <> b").distinct()

    now, before = materialise(linked(edges), "edges"), None
    while True:
        state = now.agg(F.count(F.lit(1)), F.sum(F.hash("a", "b").cast("decimal(38,0)"))).first()
        if before == state:
            return now.select(F.col("a").alias("rep"), F.col("b").alias("component"))
        before = state
        both = now.union(now.select(F.col("b"), F.col("a"))).toDF("u", "v")
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).withColumn("m", F.least("u", "m"))
        large = join_keyed(both.filter("v > u"), least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        large = materialise(linked(large), "edges")
        down = large.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select("u", "m"))
        old, now = now, materialise(linked(small), "edges")
        discard(old, large)


def similar_enough(n: str, m: str):
    """Sizes of sets that may reach the similarity; others can't whatever they hold."""
    return 4 * F.least(n, m) >= 3 * F.greatest(n, m)


ROW = T.StructType([T.StructField("rep", T.LongType()), T.StructField("shingle", T.LongType())])


def _shingle_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    for batch in batches:
        for rep, text in zip(batch.column("rep").to_pylist(), texts(batch.column("text")), strict=True):
            sh = shingles(words_of(text), hashes).view(np.int64)
            yield pa.RecordBatch.from_pydict({"rep": pa.array(np.full(len(sh), rep)), "shingle": pa.array(sh)})


#: Buckets with more members are crowded; shingles in at most SCARCE of their texts are scarce.
CROWD, SCARCE = 16, 16


def find_links(reps: DataFrame, docs: DataFrame) -> DataFrame:
    """Components (rep, component) of the texts in ``reps`` (rep, n_shingles, bands); singles are left out.

    Texts that share a bucket of a band are candidates. Pairs within buckets are never all made.

    1. Each text is tested against the least of one of its buckets.
    2. In buckets that still hold several components, each text is tested against the one with the
       largest part of shingles that are common there, which of a family of copies is the nearest
       to them all.
    3. What is left between components is made pair by pair, each once: where a bucket is not
       crowded all of its pairs. In crowded ones, two texts either share a scarce shingle, by which
       they are joined, or have at most the lesser number of common shingles in common, which
       must then be enough. No link fails both.

    Pairs within one component need no test, for they can't change it.
    """
    rows = reps.select("rep", "n_shingles", F.explode("bands").alias("bucket"))
    leads = (
        rows.groupBy("bucket")
        .agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("rep", "n_shingles")).alias("lead"))
        .filter("n > 1")
        .select("bucket", "n", F.col("lead.rep").alias("lead"), F.col("lead.n_shingles").alias("lead_n"))
    )
    members = materialise(join_keyed(rows, leads, "bucket"), "members")
    candidates = materialise(
        docs.select(F.col("doc_id").alias("rep"), "text").join(members.select("rep").distinct(), "rep").dropDuplicates(["rep"]),
        "candidates",
    )
    first = (
        members.filter((F.col("rep") != F.col("lead")) & similar_enough("n_shingles", "lead_n"))
        .groupBy("rep", "lead").agg(F.count(F.lit(1)).alias("n"))
        .groupBy("rep").agg(F.min(F.struct(-F.col("n"), "lead")).alias("best"))
        .select(F.col("rep").alias("a"), F.col("best.lead").alias("b"))
    )
    tested = materialise(first, "pairs")
    known = components(materialise(confirmed(tested, candidates), "links"))

    def unsettled(df: DataFrame) -> DataFrame:
        df = df.join(known, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
        open_ = (
            df.groupBy("bucket").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count(F.lit(1)).alias("m"))
            .filter("x <> y").select("bucket", "m", (F.col("m") > CROWD).alias("crowded"))
        )
        return materialise(join_keyed(df, open_, "bucket", "m"), "members")

    def tested_links(pairs: DataFrame) -> DataFrame:
        links = materialise(confirmed(pairs, candidates), "links")
        return components(known.select(F.col("rep").alias("a"), F.col("component").alias("b")).union(links))

    here = unsettled(members.drop("lead", "lead_n"))
    crowd = here.filter("crowded").select("rep").distinct()
    held = materialise(candidates.join(crowd, "rep").mapInArrow(_shingle_rows, ROW), "shingles")
    counts = held.groupBy("shingle").agg(F.count(F.lit(1)).alias("df")).filter(F.col("df") <= SCARCE)
    scarce = materialise(held.join(counts, "shingle"), "scarce")
    few = scarce.groupBy("rep").agg(F.count(F.lit(1)).alias("scarce"))
    here = materialise(here.join(few, "rep", "left").withColumn("common", F.col("n_shingles") - F.coalesce("scarce", F.lit(0))).drop("scarce"), "members")

    part = F.when(F.col("crowded"), F.col("common") / F.col("n_shingles")).otherwise(F.lit(1.0))
    middle = here.groupBy("bucket").agg(F.max(F.struct(part, (-F.col("rep")).alias("r"), "rep", "component", "n_shingles")).alias("lead"), F.count(F.lit(1)).alias("n"))
    second = (
        join_keyed(here, middle, "bucket")
        .filter((F.col("component") != F.col("lead.component")) & similar_enough("n_shingles", "lead.n_shingles"))
        .select(F.greatest("rep", "lead.rep").alias("a"), F.least("rep", "lead.rep").alias("b")).distinct()
        .join(tested, ["a", "b"], "left_anti")
    )
    second = materialise(second, "pairs")
    tested = tested.union(second)
    known = tested_links(second)

    here = unsettled(here.drop("component", "crowded"))
    sizes = here.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("n"))
    main = sizes.groupBy("bucket").agg(F.max(F.struct("n", "component"))["component"].alias("main"), F.sum("n").alias("n"))
    # a text is in one bucket of each band at most, so its list of buckets is short
    lists = here.groupBy("rep").agg(F.collect_set("bucket").alias("buckets"))
    # of two texts that common shingles alone could link, each has them for three quarters of its own
    alone = ~F.col("crowded") | (4 * F.col("common") >= 3 * F.col("n_shingles"))
    flagged = join_keyed(here.filter(alone), main, "bucket").join(lists, "rep")
    sides = ("rep", "component", "n_shingles", "common", "buckets")
    x = flagged.filter("component <> main").select("bucket", "main", "crowded", *[F.col(c).alias(f"x_{c}") for c in sides])
    y = flagged.select("bucket", *[F.col(c).alias(f"y_{c}") for c in sides])
    may = (
        (F.col("x_component") != F.col("y_component"))
        & ((F.col("y_component") == F.col("main")) | (F.col("x_rep") > F.col("y_rep")))
        & similar_enough("x_n_shingles", "y_n_shingles")
        & (~F.col("crowded") | (7 * F.least("x_common", "y_common") >= 3 * (F.col("x_n_shingles") + F.col("y_n_shingles"))))
        & (x["bucket"] == F.array_min(F.array_intersect("x_buckets", "y_buckets")))
    )
    by_bucket = x.join(y, (x["bucket"] == y["bucket"]) & may).select(F.col("x_rep").alias("a"), F.col("y_rep").alias("b"))
    at = here.select("rep", "n_shingles", "component").distinct()
    shared = scarce.filter("df > 1").select("shingle", "rep").join(at, "rep")
    one = shared.toDF("x_rep", "shingle", "x_n", "x_component")
    two = shared.toDF("y_rep", "shingle", "y_n", "y_component")
    by_shingle = (
        one.join(two, (one["shingle"] == two["shingle"]) & (F.col("x_rep") > F.col("y_rep")) & (F.col("x_component") != F.col("y_component")) & similar_enough("x_n", "y_n"))
        .select(F.col("x_rep").alias("a"), F.col("y_rep").alias("b")).distinct()
    )
    third = by_bucket.union(by_shingle).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    third = materialise(third.join(tested, ["a", "b"], "left_anti"), "pairs")
    known = tested_links(third)
    discard(members, candidates, held)
    return known


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Classes of near-duplicate documents: doc_id, n_shingles, component_id, kept.

    A document is the set of its five-word shingles, A-Z lower-cased; two are linked if their sets
    have three quarters or more of their union in common. ``component_id`` is the least doc_id that
    links reach, and that document is kept. Documents without words have no shingles and are their
    own component. Exact copies are told by their words before anything is compared, so a group of
    them costs one comparison whatever its size. Repeated rows get the same component. A null
    doc_id isn't linked and has a null component. An empty table gives an empty one. Other columns are not read.
    """
    features = materialise(docs.select("doc_id", "text").mapInArrow(_features, FEATURES), "features")
    reps = (
        features.filter("content is not null and doc_id is not null")
        .groupBy("content")
        .agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands"))
    )
    reps = materialise(reps, "reps")
    known = find_links(reps.select("rep", "n_shingles", "bands"), docs)
    classes = reps.select("content", "rep", "n").join(known, "rep", "left").select("content", "n", F.coalesce("component", "rep").alias("c"))
    return join_keyed(features, classes, "content", how="left").select(
        "doc_id", "n_shingles",
        F.when(F.col("doc_id").isNotNull(), F.coalesce("c", "doc_id")).alias("component_id"),
    ).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose document stands for its component; of repeated rows all stay.

    Texts that are null or without words, and null doc_ids, stay. An empty table stays empty, all columns as they are.
    """
    gone = near_duplicates(docs).filter("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def op8_near_duplicates(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"))
