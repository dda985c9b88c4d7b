"""Buckets of candidates: large ones in pairs of blocks, so that a task holds two blocks at most.

Two members of a bucket are compared where the bucket is not split, so a block is as large as a task's memory allows: a bucket
in one block costs no copy of a row.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = 1024


def in_blocks(rows: DataFrame, member: str, blocks: Column) -> DataFrame:
    """rows (bucket long, ...): adds own, low, high. A bucket of one block is one task (0, 0); another is cut into its number of
    blocks by a hash of `member`, and its tasks are the pairs of blocks low <= high."""
    n = F.greatest(blocks.cast("int"), F.lit(1))
    rows = rows.withColumn("own", F.pmod(F.xxhash64(member, F.lit(1)), n).cast("int"))
    rows = rows.withColumn("_other", F.explode(F.sequence(F.lit(0), n - 1)))
    return rows.withColumns({"low": F.least("own", "_other"), "high": F.greatest("own", "_other")}).drop("_other")


def dealt(rows: DataFrame) -> DataFrame:
    """The rows of a task together in one partition, one after the other."""
    return rows.repartition("bucket", "low", "high").sortWithinPartitions("bucket", "low", "high")


def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list]]:
    """The columns of each task's rows, from what dealt() gives."""
    key, held = None, None
    for b in batches:
        cols = {c: b.column(c).to_pylist() for c in b.schema.names}
        keys = list(zip(cols["bucket"], cols["low"], cols["high"], strict=True))
        start = 0
        for i in range(1, len(keys) + 1):
            if i < len(keys) and keys[i] == keys[start]:
                continue
            if keys and keys[start] == key:
                for c in held:
                    held[c] += cols[c][start:i]
            elif keys:
                if held is not None:
                    yield held
                key, held = keys[start], {c: v[start:i] for c, v in cols.items()}
            start = i
    if held is not None:
        yield held


class Union:
    """Union-find over 0..n-1."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        self.up[max(i, j)] = min(i, j)
        return i != j
