"""Runs of words that repeat with a period: maximal pairs in the tree of LCP intervals of each text.

Two places of a text whose words agree as far as they can, to the right and to the left, are a maximal
pair. Where they agree over several times their distance, the stretch from the first place to the end of
the agreement has that distance as a period and no neighbour extends it: it is a run, as it stands.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayside.llm.common import WORD_PATTERN, bundles, table

#: Bytes of texts that are searched together, one text at least.
BUNDLE = 2 << 20


def suffix_ranks(words: np.ndarray, text: np.ndarray, end: np.ndarray, seed: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Ranks of all suffixes by their first 1, 2, 4, ... words, and those not alone with their first ``seed`` words.

    ``text`` is the number of each word's text and ``end`` where that ends: suffixes of different texts
    never share a rank. Each array has one place more, which equals nothing. The last ranks are all distinct.
    """
    n = len(words)
    kinds = int(words.max()) + 1
    first = text * kinds + words
    ranks = [np.append(first, -1)]
    key = first * (kinds + 1) + np.where(np.arange(n) + 1 < end, np.append(words[1:], 0) + 1, 0)
    active, rank, h = np.arange(n), np.zeros(n + 1, np.int64), 1
    rank[n] = -1
    repeated = active
    while True:
        # what shared a rank is put in order by the ranks of what follows
        order = np.argsort(key, kind="stable")
        own, active = key[order], active[order]
        new = np.append(True, own[1:] != own[:-1])
        group = rank[active]
        outer = np.append(True, group[1:] != group[:-1])
        at = np.arange(len(active))
        base = at[outer][np.cumsum(outer) - 1]
        starts = at[new][np.cumsum(new) - 1]
        rank = rank.copy()
        rank[active] = group + starts - base
        ranks.append(rank)
        h *= 2
        single = new & np.append(new[1:], True)
        active = active[~single]
        if h == seed:
            repeated = active
        if not len(active):
            return ranks, repeated if h >= seed else active
        after = active + h
        key = rank[active] * (n + 1) + np.where(after < end[active], rank[np.minimum(after, n)] + 1, 0)


def agreement(ranks: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many words the suffixes at ``a`` and ``b`` have in common at their start."""
    far = np.zeros(len(a), np.int64)
    for k in range(len(ranks) - 1, -1, -1):
        far += np.where(ranks[k][a + far] == ranks[k][b + far], 1 << k, 0)
    return far


def near_suffixes(words: np.ndarray, text: np.ndarray, end: np.ndarray, floor: int, ratio: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in order, with the words each has in common with the one before, of those that can be in a pair.

    A pair that agrees over l >= ``floor`` words lies at most l / ``ratio`` apart. A suffix has no partner if
    none that shares its first few words lies that near, for the greatest l that the suffix has at all.
    """
    seed = 1 << (floor.bit_length() - 1)
    ranks, found = suffix_ranks(words, text, end, seed)
    if len(found) < 2:
        return found[:0], found[:0]
    found = found[np.argsort(ranks[-1][found])]
    common = np.append(0, agreement(ranks, found[:-1], found[1:]))
    most = np.maximum(common, np.append(common[1:], 0))
    alike = ranks[seed.bit_length() - 1][found]
    by_place = np.lexsort((found, alike))
    gap = np.diff(found[by_place]).astype(np.float64)
    gap[np.diff(alike[by_place]) != 0] = np.inf
    nearest = np.empty(len(found))
    nearest[by_place] = np.minimum(np.append(np.inf, gap), np.append(gap, np.inf))
    kept = np.flatnonzero((most >= floor) & (nearest * ratio <= most))
    if not len(kept):
        return found[:0], found[:0]
    # between two that are kept counts the least that lies between them
    least = np.minimum.reduceat(common, np.append(0, kept[:-1] + 1))
    return found[kept], least


def maximal_pairs(suffixes: list[int], common: list[int], left: list[int], floor: int, ratio: int) -> Iterator[tuple[int, int, int]]:
    """Pairs (i, j, l), i < j, that agree over exactly l >= ``floor`` words, at most l / ``ratio`` apart, with different words before them.

    Bottom-up over the tree of LCP intervals, each node with the list of its places, every place in the
    class of the word to its left. A list is merged into a longer one by looking up what lies near each of
    its places. There all places are a multiple of one period apart, and but for the first of such a chain
    all are of one class; so the class of the nearest place to the right, or of the farthest to the left, says
    which pairs there are, and nothing is visited that isn't reported.
    """
    stack: list[tuple[int, list[int]]] = []
    for place, depth in zip([*suffixes, -1], [*common[1:], 0, 0], strict=True) if suffixes else ():
        if place >= 0:
            stack.append((1 << 60, [place]))
        if depth < floor:
            depth = 0
        while stack and stack[-1][0] > depth:
            _, own = stack.pop()
            above = stack[-1][0] if stack else 0
            if above <= depth and (above < depth or not depth):
                if depth:
                    stack.append((depth, own))
                break
            _, other = stack.pop()
            if len(own) > len(other):
                own, other = other, own
            reach = above // ratio
            for e in own:
                k = bisect_left(other, e)
                if k and (x := other[bisect_left(other, e - reach, 0, k)] if other[k - 1] >= e - reach else e) < e and left[x] != left[e]:
                    yield x, e, above
                if k < len(other) and other[k] <= e + reach and left[other[k]] != left[e]:
                    for y in other[k : bisect_right(other, e + reach, k)]:
                        yield e, y, above
            if own[0] > other[-1]:
                other += own
            elif len(own) == 1:
                insort(other, own[0])
            else:
                other += own
                other.sort()
            stack.append((above, other))


def runs_of(texts: list[list[bytes]], least: int, exponent: int) -> list[np.ndarray]:
    """For each text, given as its words, rows (start, length, period) by start and period of its runs."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(sizes)
    codes: dict[bytes, int] = {}
    words = np.fromiter((codes.setdefault(w, len(codes)) for t in texts for w in t), np.int64, ends[-1] if len(ends) else 0)
    out = np.empty((0, 3), np.int64)
    if len(words):
        ratio = exponent - 1
        text = np.repeat(np.arange(len(texts)), sizes)
        floor = max(1, -(-least * ratio // exponent))
        suffixes, common = near_suffixes(words, text, np.repeat(ends, sizes), floor, ratio)
        left = np.append(-1, words[:-1])
        left[(ends - sizes)[sizes > 0]] = -1 - np.flatnonzero(sizes > 0)  # before a text's first word is no word
        pairs = np.array(list(maximal_pairs(suffixes.tolist(), common.tolist(), left.tolist(), floor, ratio)), np.int64).reshape(-1, 3)
        start, period = pairs[:, 0], pairs[:, 1] - pairs[:, 0]
        length = pairs[:, 2] + period
        order = np.lexsort((period, length, start))
        out = np.stack([start, length, period], 1)[order]
        # of the periods of one stretch, the smallest counts: the others are its multiples
        out = out[np.append(True, (np.diff(out[:, 0]) != 0) | (np.diff(out[:, 1]) != 0))[: len(out)] & (out[:, 1] >= least)]
        out = out[np.lexsort((out[:, 2], out[:, 0]))]
    cut = np.searchsorted(out[:, 0], ends)
    return [part - [offset, 0, 0] for part, offset in zip(np.split(out, cut[:-1]), (ends - sizes).tolist(), strict=True)] if len(texts) else []


def collapse(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words joined by blanks, without those that a run repeats after its first period."""
    if len(runs):
        change = np.zeros(len(words) + 1, np.int64)
        np.add.at(change, runs[:, 0] + runs[:, 2], 1)
        np.add.at(change, runs[:, 0] + runs[:, 1], -1)
        words = [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()]
    return b" ".join(words)


def periodic_runs(docs: DataFrame, least: int = 6, exponent: int = 4) -> DataFrame:
    """doc_id, n_words, runs and collapsed of every whole text.

    ``runs`` is an array of (start, length, period) by start and period: stretches of words (split at blanks
    and tab to carriage return) whose smallest period is ``period``, of at least ``least`` words and
    ``exponent`` >= 3 periods, that no neighbouring word extends. ``collapsed`` joins by single blanks the words
    that no run holds after its first period. Null and empty texts have no words, no runs and an empty
    ``collapsed``. Repeated rows and null doc_ids stay rows of their own, an empty table gives an empty one, other
    columns are not read. Nothing is shuffled; memory follows ``BUNDLE``, or the longest text if that is longer.
    """
    if exponent < 3:
        raise ValueError("runs of fewer than three periods aren't found by pairs alone")
    docs = docs.select("doc_id", "text")
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for some in bundles(batch["text"].cast(pa.large_binary()).fill_null(b""), BUNDLE):
                words = [t.as_py().split() for t in some]
                runs = runs_of(words, least, exponent)
                edges = np.append(0, np.cumsum([len(r) for r in runs])).astype(np.int32)
                flat = np.concatenate([*runs, np.empty((0, 3), np.int64)])
                parts = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(flat[:, i])) for i in range(3)], ["start", "length", "period"])
                yield pa.RecordBatch.from_pydict({
                    "doc_id": batch["doc_id"].slice(at, len(some)), "n_words": pa.array(list(map(len, words)), pa.int64()),
                    "runs": pa.ListArray.from_arrays(pa.array(edges), parts).cast(kind),
                    "collapsed": pa.array(list(map(collapse, words, runs)), pa.binary()).cast(pa.string()),
                })
                at += len(some)

    doc_id = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(search, f"doc_id {doc_id}, n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string")


def digests(docs: DataFrame, least: int = 6, exponent: int = 4) -> DataFrame:
    """Of ``periodic_runs`` the number of runs, the longest one, and digests of all runs and of the collapsed text."""
    # the greatest length, then the smallest start, then the smallest period
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"], (-r["start"]).alias("back"), (-r["period"]).alias("often"))))
    found = periodic_runs(docs, least, exponent).withColumn("best", best)
    lines = F.transform("runs", lambda r: F.concat_ws(",", *(r[c].cast("string") for c in ("start", "length", "period"))))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.back")).alias("start"), F.col("best.length").alias("length"), (-F.col("best.often")).alias("period"),
        F.expr("best.length * 1000 div -best.often").alias("exponent_milli"),
        F.sha2(F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, F.lit("\n")).otherwise(F.lit(""))), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """doc_id and text; in a tenth of the texts, by a checksum of doc_id, a stretch repeats up to the end.

    Texts of null doc_ids and texts without words stay as they are.
    """
    h: Column = F.crc32(F.col("doc_id").cast("string"))
    words = F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(f"({WORD_PATTERN})"), F.lit(1)))
    rows = docs.select("doc_id", "text", words.alias("w"), F.floor(h / 10).cast("long").alias("g"))
    rows = rows.withColumn("n", F.size("w")).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")).cast("int"))
    rows = rows.withColumn("p", F.expr("cast(1 + (n - a) div (3 + g % 8) AS int)"))
    planted = F.expr("array_join(slice(concat(slice(w, 1, a), flatten(array_repeat(slice(w, a + 1, p), cast(ceil((n - a) / p) AS int)))), 1, n), ' ')")
    return rows.select("doc_id", F.when(F.col("n") > 0, planted).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark, sf_dir):
    return digests(with_planted_runs(table(spark, sf_dir, "documents")))
