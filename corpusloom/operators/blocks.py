"""Sentences in blocks of tokens: what is asked of a sentence's neighbours is found on arrays, in the task that has the block.

Tokens do not become rows. A block's distinct tokens meet their features by a shuffle of (block, token), which has a row for many
tokens; the block's sentences and these rows then come together by a cogroup, and no relation of all tokens is written or sorted.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from corpusloom.functions.text import tokens
from corpusloom.sources.writers import saved

#: Tokens of a block, which is in memory at once, and of a part of it, whose arrays are.
BLOCK, PART = 1_000_000, 200_000


class Sentences:
    """Tokens of consecutive sentences: code (of each token, in the block's distinct ones), at (its index), start and end (of its
    sentence), sentence, i (its place in the sentence). Indices of tokens that do not exist are -1."""

    def __init__(self, code: np.ndarray, sizes: np.ndarray):
        self.code, self.n = code, len(code)
        ends = np.cumsum(sizes)
        self.sentence = np.repeat(np.arange(len(sizes)), sizes)
        self.start, self.end, self.sizes = (ends - sizes)[self.sentence], ends[self.sentence], sizes
        self.at = np.arange(self.n)
        self.i = self.at - self.start

    def shifted(self, by: int) -> np.ndarray:
        """Index of the token `by` places behind (before, if negative)."""
        to = self.at + by
        return np.where((to >= self.start) & (to < self.end), to, -1)

    def last(self, where: np.ndarray, before: int = 1) -> np.ndarray:
        """Index of the last token that fits, `before` places before a token or more."""
        seen = np.maximum.accumulate(np.where(where, self.at, -1)) if self.n else self.at
        to = self.shifted(-before)
        found = np.where(to >= 0, seen[to], -1)
        return np.where(found >= self.start, found, -1)

    def next(self, where: np.ndarray) -> np.ndarray:
        """Index of the first token behind a token that fits."""
        seen = np.minimum.accumulate(np.where(where, self.at, self.n)[::-1])[::-1] if self.n else self.at
        to = self.shifted(1)
        found = np.where(to >= 0, seen[to], self.n)
        return np.where(found < self.end, found, -1)

    def running(self, what: np.ndarray) -> np.ndarray:
        """Sum of `what` from the sentence's first token to each."""
        sums = np.concatenate([[0], np.cumsum(what, dtype=np.int64)])
        return sums[self.at + 1] - sums[self.start]

    def total(self, what: np.ndarray) -> np.ndarray:
        """Sum of `what` by sentence."""
        return np.bincount(self.sentence, weights=what, minlength=len(self.sizes)).astype(np.int64)


def _take(values: np.ndarray, at: np.ndarray, none) -> np.ndarray:
    """values at indices, of which -1 gives `none`."""
    return np.where(at >= 0, values[at], none) if len(values) else np.full(len(at), none)


def in_blocks(sentences: DataFrame, text: str, *key: str, features: Callable[[DataFrame], DataFrame], run: Callable, schema: StructType) -> DataFrame:
    """What run() makes of parts of blocks.

    features: token and f (a string, of which there are few different) of distinct tokens. run(keys, block, sentences) gets the part's
    keys (a table), what a function of the block's distinct tokens and their f gives once a block (run.prepare), and the part's Sentences;
    it gives a table of `schema`, with columns in that order.
    """
    rows = sentences.select(*key, tokens(F.coalesce(F.col(text), F.lit(""))).alias("_t"))
    kept = StructType([*(rows.schema[k] for k in key), StructField("_t", ArrayType(StringType())), StructField("_block", LongType())])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        so_far, first = 0, TaskContext.get().partitionId() << 32
        for batch in batches:
            sizes = np.cumsum(pc.list_value_length(batch.column("_t")).to_numpy(zero_copy_only=False)) + so_far
            so_far = int(sizes[-1]) if len(sizes) else so_far
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(first + sizes // BLOCK, pa.int64())], names=[*batch.schema.names, "_block"])

    rows = saved(rows.mapInArrow(deal, kept))
    pairs = saved(rows.select("_block", F.explode("_t").alias("token")).distinct())
    known = pairs.join(saved(features(pairs.select("token").distinct()).select("token", "f")), "token").select("_block", "token", "f")

    names, arrow = list(key), schema.names

    def block(left: pa.Table, right: pa.Table) -> pa.Table:
        words = right.column("token").combine_chunks()
        prepared = run.prepare(words.to_pylist(), right.column("f").to_pylist())
        lists = left.column("_t").combine_chunks()
        sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = lists.flatten()
        flat = flat.cast(words.type) if flat.type != words.type else flat
        code = pc.index_in(flat, value_set=words).to_numpy(zero_copy_only=False) if len(words) else np.zeros(0, np.int32)
        ends = np.cumsum(sizes)
        cuts = [0, *(np.flatnonzero(np.diff(ends // PART)) + 1).tolist(), len(sizes)]
        out = []
        for a, b in zip(cuts, cuts[1:]):
            if a < b:
                begin = int(ends[a] - sizes[a])
                out.append(run(left.slice(a, b - a).select(names), prepared, Sentences(code[begin : int(ends[b - 1])], sizes[a:b])).select(arrow))
        return pa.concat_tables(out)

    return rows.groupBy("_block").cogroup(known.groupBy("_block")).applyInArrow(block, schema)
