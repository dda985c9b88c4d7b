"""Mixture-controlled packing: deficit round-robin over source queues.

In every round, queue s is credited q_s = window x its target proportion in tokens. It sends its documents in grains of a fixed
number of tokens and carries what is less than a grain, its deficit, to the next round; an empty queue is passed over. What
queue s has sent before round w is therefore A_s(w) = min(P_s, grain x floor(q_s x w / grain)) (P_s: its tokens), for any w, so
that every task can place its own documents: deficits carry across windows and partitions without a sequential pass. The
rounds follow each other as one stream, cut into sequences of the window's length; what is left at the end is cut into
sequences of powers of two, so that nothing is padded.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import pieces, scratch, text_or_empty
from corpusloom.llm.tokens import as_binary, public_encoder, with_end, word_chunks

WINDOW, END, GRAIN = 4096, 2, 256
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string, ids binary"


def tokenize_queues(docs: DataFrame, tokenizer: str, source: Column, end: int = END) -> DataFrame:
    """doc_id, source, block (input partition), at (tokens of the source before it in the block), n, ids (little-endian uint32)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block, sent, encode = TaskContext.get().partitionId(), {}, public_encoder(tokenizer, word_chunks)
        for b in pieces(batches):
            ids, starts = with_end(*encode(b.column("text")), end)
            n, at = np.diff(starts).tolist(), []
            for s, k in zip(b.column("source").to_pylist(), n, strict=True):
                at.append(sent.get(s, 0))
                sent[s] = at[-1] + k
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("source"), pa.array([block] * len(n), pa.int64()), pa.array(at, pa.int64()), pa.array(n, pa.int64()), as_binary(ids, starts)], ["doc_id", "source", "block", "at", "n", "ids"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), source.alias("source"), text_or_empty().alias("text"))
    return rows.mapInArrow(run, "doc_id long, source string, block long, at long, n long, ids binary")


def credits(names: list[str], sizes: list[int], targets: dict[str, float] | None, window: int) -> list[float]:
    """Tokens a round of each queue. Queues without a target share what the others leave, and a token at least, by their sizes."""
    targets = {f"s{k}": v for k, v in (targets or {}).items()}
    if sum(targets.values()) > 1 + 1e-9 or any(v <= 0 for v in targets.values()):
        raise ValueError("targets are positive and sum to 1 at most")
    rest = max(1 - sum(targets.values()), 1 / window)
    others = sum(p for q, p in zip(names, sizes, strict=True) if q not in targets)
    return [window * (targets[q] if q in targets else rest * p / others) for q, p in zip(names, sizes, strict=True)]


class Rounds:
    """Where the tokens of each queue go."""

    def __init__(self, sizes: list[int], credit: list[float], window: int = WINDOW, grain: int = GRAIN):
        self.sizes, self.credit, self.window, self.grain = np.array(sizes, dtype=np.int64), np.array(credit, dtype=np.float64), window, grain
        self.total, self.known = int(self.sizes.sum()), {}

    def _sent(self, w: int) -> np.ndarray:
        return np.minimum(self.sizes, self.grain * np.floor(self.credit * w / self.grain).astype(np.int64))

    def _round(self, w: int) -> tuple[np.ndarray, np.ndarray]:
        """What each queue has sent after round w, and where in the stream its first token would stand if it sent all in this round."""
        if (found := self.known.pop(w, None)) is None:
            here, then = self._sent(w), self._sent(w + 1)
            found = then, int(here.sum()) + np.cumsum(then - here) - then
            if len(self.known) >= 256:
                del self.known[next(iter(self.known))]
        self.known[w] = found
        return found

    def _when(self, i: int, pos: int) -> int:
        """The round in which queue i sends its token number pos."""
        units, credit, size = pos // self.grain + 1, float(self.credit[i]), int(self.sizes[i])

        def sent(w: int) -> int:
            return min(size, self.grain * math.floor(credit * w / self.grain))

        w = math.ceil(units * self.grain / credit)
        while sent(w) <= pos:
            w += 1
        while sent(w - 1) > pos:
            w -= 1
        return w - 1

    def place(self, i: int, first: int, count: int) -> Iterator[tuple[int, int, int, int]]:
        """(start, length, sequence, offset) of count tokens of queue i from its token first on; start counts from 0."""
        pos, last, full = first, first + count, self.total // self.window
        while pos < last:
            then, base = self._round(self._when(i, pos))
            take, stream = min(last, int(then[i])) - pos, int(base[i]) + pos
            while take:
                seq, offset = divmod(stream, self.window)
                room = self.window - offset
                if seq == full:  # the rest, in powers of two
                    left = self.total - full * self.window
                    while (part := 1 << (left.bit_length() - 1)) <= offset:
                        seq, offset, left = seq + 1, offset - part, left - part
                    room = part - offset
                k = min(take, room)
                yield pos - first, k, seq, offset
                pos, stream, take = pos + k, stream + k, take - k


def pack(docs: DataFrame, tokenizer: str, queue: str | Column = "source", window: int = WINDOW, end: int = END, targets: dict[str, float] | None = None, grain: int = GRAIN) -> DataFrame:
    """Pieces of documents in sequences, with their ids: see PIECES (ids: little-endian uint32).

    targets: token proportions of sources, for as long as these have tokens; sources without one, and all by default, have
    their natural share of the rest. Null and empty texts are the end token alone. A null source is a queue of its own.
    Sources with less than one token a window have common queues, by hash; at most 2 x window + len(targets) queues are
    left so. Null or repeated ids are packed row by row. An empty table gives no rows. Of other columns only the queue's is
    read.
    """
    source = F.col(queue) if isinstance(queue, str) else queue
    key = F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit("n"))
    tokens = scratch(tokenize_queues(docs, tokenizer, key, end), "packing-ids")
    blocks = scratch(tokens.groupBy("source", "block").agg(F.sum("n").alias("n")), "packing-sizes")
    total = blocks.agg(F.sum("n")).first()[0] or 0
    own = (F.col("all") * window >= total) | F.col("source").isin([f"s{t}" for t in targets or {}])
    common = F.concat(F.lit("h"), F.pmod(F.xxhash64("source"), F.lit(window)).cast("string"))
    queues = blocks.groupBy("source").agg(F.sum("n").alias("all")).select("source", F.when(own, F.col("source")).otherwise(common).alias("queue"))
    before = Window.partitionBy("queue").orderBy("block", "source").rowsBetween(Window.unboundedPreceding, -1)
    blocks = scratch(blocks.join(queues, "source").select("source", "queue", "block", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")), "packing-blocks")
    found = blocks.groupBy("queue").agg(F.sum("n")).collect()  # bounded: see above
    names, sizes = map(list, zip(*sorted(map(tuple, found)), strict=True)) if found else ([], [])
    index, credit = {q: i for i, q in enumerate(names)}, credits(names, sizes, targets, window)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rounds = Rounds(sizes, credit, window, grain)
        for b in batches:
            cols: list[list] = [[] for _ in range(9)]
            for doc, s, q, first, n, ids in zip(*(b.column(c).to_pylist() for c in ("doc_id", "source", "queue", "first", "n", "ids")), strict=True):
                for start, length, seq, offset in rounds.place(index[q], first, n):
                    own = ids[4 * start : 4 * (start + length)]
                    for c, v in zip(cols, (doc, start, length, zlib.crc32(own), n, seq, offset, s[1:] if s[0] == "s" else None, own), strict=True):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.int64()] * 7 + [pa.string(), pa.binary()], strict=True)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "source", "ids"])

    placed = tokens.join(blocks.select("source", "queue", "block", "base"), ["source", "block"]).select("doc_id", "source", "queue", (F.col("base") + F.col("at")).alias("first"), "n", "ids")
    return placed.mapInArrow(cut, PIECES)
