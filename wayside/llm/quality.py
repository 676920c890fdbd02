"""Quality rules of documents, and verdicts on their hosts by shrunken failure rates."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayside.llm.common import materialise, table, texts

WINDOW = 5
FIGURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
STATS = T.StructType([T.StructField(n, T.LongType()) for n in FIGURES])


def repeated_words(words: list) -> int:
    """Words that lie in a window of five words that the text has twice or more."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    number: dict = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    # Windows get dense numbers two words at a time, so equal numbers mean equal words.
    pairs = np.unique(ids[:-1] * len(number) + ids[1:], return_inverse=True)[1]
    fours = np.unique(pairs[:-2] * len(words) + pairs[2:], return_inverse=True)[1]
    windows = fours[:n] * len(number) + ids[WINDOW - 1 :]
    _, which, counts = np.unique(windows, return_inverse=True, return_counts=True)
    starts = np.flatnonzero(counts[which] > 1)
    if not len(starts):
        return 0
    step = np.zeros(len(words) + 1, np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, starts + WINDOW, -1)
    return int(np.count_nonzero(np.cumsum(step[:-1])))


def text_stats(text: str | None) -> dict:
    if text is None:
        return dict(n_words=0, word_chars=0, n_symbols=0, n_dup_lines=0, n_repeat_words=0)
    words = text.encode().split()
    lines = Counter(line for line in text.split("\n") if line.encode().split())
    spaces = sum(map(text.count, " \t\n\v\f\r"))
    return dict(
        n_words=len(words),
        word_chars=len(text) - spaces,
        n_symbols=sum(map(text.count, "#*$%&|<>")),
        n_dup_lines=lines.total() - len(lines),
        n_repeat_words=repeated_words(words),
    )


@F.arrow_udf(STATS)
def stats_of(text: pa.Array) -> pa.Array:
    rows = [text_stats(t) for t in texts(text)]
    return pa.array(rows, pa.struct([(n, pa.int64()) for n in FIGURES]))


def base_failed(n_words, n_repeat_words):
    return (n_words < 10) | (100 * n_repeat_words > 20 * n_words)


def host_verdicts(flags: DataFrame, threshold: float = 0.5, z: float = 1.645, least: float = 2.0, most: float = 200.0) -> DataFrame:
    """Hosts whose documents mostly fail.

    ``flags`` has (host, failed boolean), a row for each document. The prior is a beta distribution
    fitted to the hosts' failure rates by their moments; a host is rejected if the lower bound of
    its posterior, mean minus ``z`` standard deviations, is above ``threshold``. Null is a host of
    its own. Returns host, n_docs, n_failed, posterior, lower_bound, rejected. Rows are counted
    before the shuffle.
    """
    hosts = flags.groupBy("host").agg(
        F.count(F.lit(1)).alias("n_docs"), F.sum(F.col("failed").cast("long")).alias("n_failed")
    )
    s = hosts.agg(
        F.sum("n_docs").cast("double").alias("n"), F.sum("n_failed").cast("double").alias("k"),
        F.count(F.lit(1)).alias("groups"), F.sum(F.col("n_docs") * F.col("n_docs")).cast("double").alias("squares"),
        F.sum(F.col("n_failed") * F.col("n_failed") / F.col("n_docs")).alias("within"),
    )
    p = F.col("k") / F.col("n")
    between = F.col("within") - F.col("k") * F.col("k") / F.col("n") - p * (1 - p) * (F.col("groups") - 1)
    scale = p * (1 - p) * (F.col("n") - F.col("squares") / F.col("n") - (F.col("groups") - 1))
    rho = F.when(scale > 0, between / scale)
    strength = F.when(rho > 0, F.greatest(F.lit(least), F.least(F.lit(most), 1 / rho - 1))).otherwise(F.lit(most))
    prior = s.select(strength.alias("strength"), ((F.col("k") + 1) / (F.col("n") + 2)).alias("mean"))
    a = F.col("n_failed") + F.col("strength") * F.col("mean")
    b = F.col("n_docs") - F.col("n_failed") + F.col("strength") * (1 - F.col("mean"))
    return (
        hosts.join(F.broadcast(prior))
        .select("host", "n_docs", "n_failed", a.alias("a"), b.alias("b"))
        .withColumn("posterior", F.col("a") / (F.col("a") + F.col("b")))
        .withColumn(
            "lower_bound",
            F.col("posterior")
            - z * F.sqrt(F.col("a") * F.col("b") / ((F.col("a") + F.col("b")) * (F.col("a") + F.col("b")) * (F.col("a") + F.col("b") + 1))),
        )
        .withColumn("rejected", F.col("lower_bound") > threshold)
        .drop("a", "b")
    )


def judge_documents(docs: DataFrame, threshold: float = 0.5, z: float = 1.645) -> DataFrame:
    """Rule figures of every document and whether it is kept.

    A document is kept if it passes the base rules (10 words, at most a fifth of them in repeated
    windows) and its host, here its ``source``, isn't rejected. Null and empty texts have no words
    and fail. Rows with the same doc_id are judged one by one. An empty table gives no rows; other
    columns are not read. Returns doc_id, the five figures, base_failed, kept and lower_bound.
    """
    flat = docs.select("doc_id", "source", stats_of("text").alias("s")).select("doc_id", "source", "s.*")
    flat = materialise(flat.withColumn("base_failed", base_failed(F.col("n_words"), F.col("n_repeat_words"))), "quality")
    hosts = host_verdicts(flat.select(F.col("source").alias("host"), F.col("base_failed").alias("failed")), threshold, z)
    return flat.join(hosts, F.col("source").eqNullSafe(F.col("host")), "left").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & ~F.col("rejected")).alias("kept"), F.round("lower_bound", 6).alias("lower_bound"),
    )


def keep_documents(docs: DataFrame, threshold: float = 0.5, z: float = 1.645) -> DataFrame:
    """The rows of ``docs`` that ``judge_documents`` keeps, with their columns.

    Null and empty texts fail for want of words. Repeated rows are judged one by one, rows of a null source by their own figures
    and those of the null host. An empty table stays empty.
    """
    s = F.col("_stats")
    failed = base_failed(s["n_words"], s["n_repeat_words"])
    judged = docs.withColumn("_stats", stats_of(docs["text"])).withColumn("_failed", failed).drop("_stats")
    # written once, without the texts that go anyway, so that the figures are made once
    judged = materialise(judged.withColumn("text", F.when(~F.col("_failed"), F.col("text"))), "judged")
    hosts = materialise(host_verdicts(judged.select(F.col("source").alias("host"), F.col("_failed").alias("failed")), threshold, z), "hosts")
    bad = hosts.filter("rejected").select("host")
    passed = judged.filter(~F.col("_failed")).select(*docs.columns)
    return passed.join(bad, passed["source"].eqNullSafe(bad["host"]), "left_anti")


def op6_host_rules(spark, sf_dir):
    return judge_documents(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH words AS (
  SELECT doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
wins AS (
  SELECT doc_id, unnest(range(1, len(w) - 3)) AS i,
         unnest(list_transform(range(1, len(w) - 3), lambda j: array_to_string(list_slice(w, j, j + 4), ' '))) AS win
  FROM words WHERE len(w) > 5),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS n FROM wins) WHERE n > 1),
repeats AS (SELECT doc_id, count(DISTINCT i + k)::BIGINT AS n_repeat_words FROM twice, range(0, 5) t(k) GROUP BY doc_id),
lines AS (
  SELECT doc_id, (count(*) - count(DISTINCT line))::BIGINT AS n_dup_lines
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM words)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
stats AS (
  SELECT doc_id, source, len(w)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
         (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM words LEFT JOIN lines USING (doc_id) LEFT JOIN repeats USING (doc_id)),
flags AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM stats),
hosts AS (SELECT source, count(*) AS n_docs, sum(base_failed::INT)::BIGINT AS n_failed FROM flags GROUP BY source),
moments AS (
  SELECT sum(n_docs)::DOUBLE AS n, sum(n_failed)::DOUBLE AS k, count(*) AS g, sum(n_docs * n_docs)::DOUBLE AS squares,
         sum((n_failed * n_failed)::DOUBLE / n_docs) AS within FROM hosts),
prior AS (
  SELECT (k + 1) / (n + 2) AS mean, CASE WHEN scale > 0 AND between_ / scale > 0
         THEN greatest(2.0e0, least(200.0e0, 1 / (between_ / scale) - 1)) ELSE 200.0e0 END AS strength
  FROM (SELECT n, k, within - k * k / n - (k / n) * (1 - k / n) * (g - 1) AS between_,
               (k / n) * (1 - k / n) * (n - squares / n - (g - 1)) AS scale FROM moments)),
bounds AS (
  SELECT source, a / (a + b) - 1.645e0 * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) AS lower_bound
  FROM (SELECT source, n_failed + strength * mean AS a, n_docs - n_failed + strength * (1 - mean) AS b FROM hosts, prior))
SELECT f.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT (lower_bound > 0.5) AS kept, round(lower_bound, 6) AS lower_bound
FROM flags f JOIN bounds b ON f.source IS NOT DISTINCT FROM b.source
"""
