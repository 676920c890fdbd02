"""Kernels over many small groups that follow each other in a task."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame

KINDS = {"long": pa.int64(), "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string()}
#: Rows that are given out at once, at least.
BATCH = 8192


def in_groups(df: DataFrame, keys: list[str], kernel: Callable[[list[tuple]], list[tuple]], schema: str) -> DataFrame:
    """``kernel`` over the rows of each group of ``keys``: tuples in the order of ``df``'s columns in, tuples of ``schema`` out.

    A call of Spark's for each group costs a millisecond or more, far more than the work on a few rows. So rows are
    sorted by group, and a task goes through its groups one after the other; it holds one group and a batch of results.
    """
    names, kinds = zip(*[c.split() for c in schema.split(", ")], strict=True)
    own = itemgetter(*[df.columns.index(k) for k in keys])

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows, strict=True) if rows else [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, KINDS[k]) for c, k in zip(columns, kinds, strict=True)], list(names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for b in batches for row in zip(*[c.to_pylist() for c in b.columns], strict=True))
        held: list[tuple] = []
        for _, group in groupby(rows, own):
            held += kernel(list(group))
            if len(held) >= BATCH:
                yield packed(held)
                held = []
        yield packed(held)

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)
