"""The most frequent words of a corpus from one small summary for each task."""

from __future__ import annotations

import pickle
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from wayside.llm.common import emit_summary, merge_summaries, texts

SUMMARY = T.StructType([T.StructField("slot", T.LongType()), T.StructField("summary", T.BinaryType())])


def shrink(counts: Counter, keep: int) -> Counter:
    """The ``keep`` most frequent entries, each less by the first count that goes (Misra-Gries).

    What a merged summary then says of a word is too low by at most N / keep; words more frequent
    than that are never lost.
    """
    if len(counts) <= keep:
        return counts
    values = np.fromiter(counts.values(), np.int64, len(counts))
    least = int(np.partition(values, len(values) - keep - 1)[len(values) - keep - 1])
    return Counter({w: n - least for w, n in counts.items() if n > least})


def frequent_words(docs: DataFrame, split: Callable[[str], list], keep: int, longest: int = 64) -> list:
    """Up to ``keep`` of the most frequent words of all texts, most frequent first.

    ``split`` cuts a text into words; those over ``longest`` are passed over. Every text is read,
    but no word is shuffled: each task sends one summary of at most 2 * ``keep`` words, and these are
    merged a few at a time. Null texts count for nothing.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for text in texts(batch.column(0)):
                if text:
                    counts.update(split(text))
                    if len(counts) > 4 * keep:
                        counts = shrink(counts, 2 * keep)
        counts = Counter({w: n for w, n in counts.items() if len(w) <= longest})
        yield from emit_summary(pickle.dumps(dict(shrink(counts, 2 * keep))))

    def merge(blobs: list[bytes]) -> bytes:
        total: Counter = Counter()
        for blob in blobs:
            total.update(pickle.loads(blob))
        return pickle.dumps(dict(shrink(total, 2 * keep)))

    found = merge_summaries(docs.select("text").mapInArrow(count, SUMMARY), merge)
    counts = pickle.loads(found) if found else {}
    return [w for w, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:keep]]
