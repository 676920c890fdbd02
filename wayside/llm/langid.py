"""Language of texts by multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayside.llm.common import table, texts

#: n-grams of one to ORDERS characters share 2**BITS hash buckets.
ORDERS, BITS = 3, 16
#: Characters that are hashed at once; longer texts go through in pieces.
PIECE = 1 << 18
GAP = np.full(ORDERS - 1, 32, np.uint32)
NOT_LETTERS = np.array([not chr(i).isalpha() for i in range(128)] + [False])
MULTIPLIERS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)


def codes_of(text: str) -> np.ndarray:
    """Code points in lower case. ASCII that isn't a letter counts as a blank."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(NOT_LETTERS[np.minimum(codes, 128)], np.uint32(32), codes)


def hashed(codes: np.ndarray) -> list[np.ndarray]:
    """For each order the buckets of the n-grams, by where they begin."""
    n = len(codes)
    out, run = [], np.zeros(n, np.uint32)
    for order in range(min(ORDERS, n)):
        run = (run[: n - order] ^ codes[order:]) * MULTIPLIERS[order % len(MULTIPLIERS)]
        run ^= run >> np.uint32(15)
        out.append(((run + np.uint32(order)) * np.uint32(0x27D4EB2F)) >> np.uint32(32 - BITS))
    return out


def pieces(text: str) -> Iterator[tuple[np.ndarray, int]]:
    """The text's codes in stretches of PIECE, and how many codes before its own each begins with.

    A stretch's n-grams are those that end among its own codes, so each n-gram of the text is in
    one stretch.
    """
    codes = codes_of(text)
    for i in range(0, len(codes), PIECE):
        before = min(i, ORDERS - 1)
        yield codes[i - before : i + PIECE], before


COUNTS = T.StructType([T.StructField("lang", T.StringType()), T.StructField("bucket", T.IntegerType()), T.StructField("n", T.LongType())])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """n-gram counts of a task by language, one row for each bucket that occurs."""
    held: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang, text in zip(texts(batch.column("lang")), texts(batch.column("text")), strict=True):
            counts = held.setdefault(lang, np.zeros(1 << BITS, np.int64))
            for piece, before in pieces(text):
                for order, buckets in enumerate(hashed(piece)):
                    buckets = buckets[max(0, before - order) :]
                    if len(buckets) > 2000:
                        counts += np.bincount(buckets, minlength=1 << BITS)
                    else:
                        np.add.at(counts, buckets, 1)
    for lang, counts in held.items():
        found = np.flatnonzero(counts)
        yield pa.RecordBatch.from_pydict(
            {"lang": pa.array([lang] * len(found), pa.string()), "bucket": pa.array(found, pa.int32()), "n": pa.array(counts[found], pa.int64())}
        )


def fit(labelled: DataFrame, smoothing: float = 0.5) -> tuple[list[str], np.ndarray]:
    """Languages and the log-probability matrix (buckets x languages) from all of (text, lang).

    Counts are summed on the executors; what comes to the driver is the model, at most 2**BITS rows
    for each language, however many texts there are. Every language has the same prior.
    """
    counts = labelled.select("text", "lang").mapInArrow(_count, COUNTS).groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    found = counts.toArrow()
    langs = sorted(set(found.column("lang").to_pylist()))
    matrix = np.full((1 << BITS, len(langs)), smoothing)
    column = {lang: i for i, lang in enumerate(langs)}
    which = np.array([column[x] for x in found.column("lang").to_pylist()], np.int64)
    matrix[found.column("bucket").to_numpy(), which] += found.column("n").to_numpy()
    return langs, np.log(matrix / matrix.sum(axis=0)).astype(np.float32)


def score_batch(batch: list[tuple[np.ndarray, int]], matrix: np.ndarray) -> np.ndarray:
    """Summed log-probabilities (stretches x languages) of stretches that are scored together."""
    codes = np.concatenate([x for piece, _ in batch for x in (piece, GAP)])
    lengths = np.array([len(piece) for piece, _ in batch])
    before = np.array([n for _, n in batch])
    starts = np.cumsum(lengths + len(GAP)) - lengths - len(GAP)
    total = np.zeros((len(batch), matrix.shape[1]))
    for order, buckets in enumerate(hashed(codes)):
        values = np.concatenate([matrix[buckets].astype(np.float64), np.zeros((1, matrix.shape[1]))])
        first, stop = starts + np.maximum(0, before - order), starts + lengths - order
        edges = np.stack([first, np.maximum(first, stop)], axis=1).ravel()  # of each stretch, and of what is between
        total += np.add.reduceat(values, np.minimum(edges, len(buckets)), axis=0)[::2] * (stop > first)[:, None]
    return total


def predictor(spark, langs: list[str], matrix: np.ndarray):
    """A column function from text to struct(lang_pred, score) that holds the model as a broadcast."""
    model = spark.sparkContext.broadcast((langs, matrix))
    kind = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    @F.arrow_udf(kind)
    def predict(text: pa.Array) -> pa.Array:
        names, logs = model.value
        rows: list[tuple[str, float]] = [("und", 0.0)] * len(text)
        held: list[tuple[int, tuple[np.ndarray, int]]] = []

        def flush():
            if not held:
                return
            totals = score_batch([t for _, t in held], logs)
            sums: dict[int, np.ndarray] = {}
            for (i, _), row in zip(held, totals, strict=True):
                sums[i] = sums.get(i, 0) + row
            for i, row in sums.items():
                p = np.exp(row - row.max())
                best = int(row.argmax())
                rows[i] = (names[best], float(p[best] / p.sum()))
            held.clear()

        size = 0
        for i, t in enumerate(texts(text)):
            if t is None or not names or not any(map(str.isalpha, t)):
                continue
            if size > PIECE:
                flush()
                size = 0
            held.extend((i, p) for p in pieces(t))
            size += len(t)
        flush()
        return pa.array([{"lang_pred": a, "score": b} for a, b in rows], pa.struct([("lang_pred", pa.string()), ("score", pa.float64())]))

    return predict


def held_out(doc_id):
    """Whether crc32 of the id as text leaves 1 by 3. A null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def identify(docs: DataFrame, labelled: DataFrame, smoothing: float = 0.5) -> DataFrame:
    """Fit on ``labelled`` (text, lang) and predict the language of every row of ``docs``.

    Texts that are null or have no letter get ``und`` with score 0, and so does everything if there
    is nothing to learn from. The score is the posterior probability of the prediction among the
    learned languages. Empty tables give no rows; repeated rows are predicted alike; columns other
    than text are kept and not used, but columns named lang_pred or score are replaced.
    """
    langs, matrix = fit(labelled.filter("text is not null and lang is not null"), smoothing)
    predict = predictor(docs.sparkSession, langs, matrix)
    others = [docs[c] for c in docs.columns if c not in ("lang_pred", "score")]
    return docs.withColumn("_p", predict(docs["text"])).select(*others, "_p.lang_pred", "_p.score")


def op3_language(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    learn = docs.filter(F.crc32(F.col("doc_id").cast("string")) % 3 != 1).select("text", "lang")
    found = identify(docs.select("doc_id", "text"), learn)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
