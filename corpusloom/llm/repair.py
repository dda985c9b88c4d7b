"""Token ids as Re-Pair grammars: frequent id pairs become nonterminals, per block of consecutive documents.

File format: Parquet rows (shard, block, first_doc, n_docs, n_ids, payload). A payload is a header of eight little-endian
uint32 (magic, version, terminals, rules, symbols, documents, 0, 0) and the arrays: rules (left, right: 2 x uint32 each),
expansion length of each rule (uint32), doc ids (int64), a null mark of each id (uint8), first symbol of each document
(uint32, one more at the end), ids before each document in the block (int64, one more at the end), symbols (uint32).
No symbol spans two documents, so any document, and by the expansion lengths any position in it, is decoded on its own.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import pieces, scratch, text_or_empty
from corpusloom.llm.tokens import public_encoder, space_chunks, with_end

END, MAGIC, VERSION = 2, 0x31525052, 1
BLOCK_IDS, RULES_A_ROUND, LEAST_COUNT = 1_000_000, 8192, 4
#: Slots of the table of pair hashes (a power of two), and places above which pairs are first counted by their slots.
SLOT_BITS, MANY = 20, 1 << 19


def _slots(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return (left * np.uint32(0x9E3779B1) + right * np.uint32(0x85EBCA77)) >> np.uint32(32 - SLOT_BITS)


def compress(ids: np.ndarray, last: np.ndarray, terminals: int, rules_a_round: int = RULES_A_ROUND, least: int = LEAST_COUNT) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, their last marks, rules, expansion lengths). last: marks the last id of each document; no pair crosses it.

    Each round counts pairs exactly and replaces the rules_a_round most frequent ones (more where counts tie), left to right,
    until no pair occurs `least` times. A pair that occurs less often never occurs more often later, so a round looks only at
    places whose pair was frequent, and at those that the round before changed.
    """
    seq, last, rules, lengths = ids.astype(np.uint32), last.copy(), [], []
    size = np.ones(terminals, dtype=np.int64)
    live = np.flatnonzero(~last[:-1]).astype(np.int32)
    while len(live):
        left, right = seq[live], seq[live + 1]
        slot = _slots(left, right)
        if len(live) > MANY:  # a slot's count is an upper bound of its pairs' counts
            stay = (np.bincount(slot, minlength=1 << SLOT_BITS) >= least)[slot]
            live, left, right, slot = live[stay], left[stay], right[stay], slot[stay]
        code = (left.astype(np.uint64) << np.uint64(32)) | right
        ordered = np.sort(code)
        starts = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(ordered) else np.zeros(0, dtype=np.int64)
        n = np.diff(starts, append=len(ordered))
        kinds, n = ordered[starts[n >= least]], n[n >= least]
        if not len(kinds):
            break
        first, second = (kinds >> np.uint64(32)).astype(np.uint32), kinds.astype(np.uint32)
        table, own = np.zeros(1 << SLOT_BITS, dtype=np.int32), _slots(first, second)
        table[own] = np.arange(len(kinds), dtype=np.int32)
        which = table[slot]
        stay = kinds[which] == code
        if len(lost := np.flatnonzero(table[own] != np.arange(len(kinds)))):  # pairs that share their slot with another
            other = np.flatnonzero(~stay)
            at = np.minimum(np.searchsorted(kinds[lost], code[other]), len(lost) - 1)
            hit = kinds[lost][at] == code[other]
            which[other[hit]], stay[other[hit]] = lost[at[hit]], True
        live, which = live[stay], which[stay]
        floor = least if len(n) <= rules_a_round else int(np.partition(n, -rules_a_round)[-rules_a_round])
        chosen = np.flatnonzero(n >= floor)
        number = np.full(len(kinds), -1, dtype=np.int64)
        number[chosen] = len(size) + np.arange(len(chosen))
        name = number[which]
        pos, name = live[name >= 0], name[name >= 0]
        runs = np.flatnonzero(np.diff(pos, prepend=-2) != 1)  # of overlapping pairs: every other one is replaced
        even = (np.arange(len(pos)) - np.repeat(runs, np.diff(runs, append=len(pos)))) % 2 == 0
        pos, name = pos[even], name[even]
        rules.append(np.stack([first[chosen], second[chosen]], axis=1).astype(np.int64))
        lengths.append(size[rules[-1][:, 0]] + size[rules[-1][:, 1]])
        size = np.concatenate([size, lengths[-1]])
        seq[pos], last[pos] = name, last[pos + 1]
        keep, alive = np.ones(len(seq), dtype=bool), np.zeros(len(seq), dtype=bool)
        keep[pos + 1], alive[live], alive[pos] = False, True, True
        seq, last, alive = seq[keep], last[keep], alive[keep]
        alive[np.maximum(pos - np.arange(len(pos)) - 1, 0)] = True  # the pairs that end in a new symbol
        live = np.flatnonzero(alive & ~last).astype(np.int32)
    rules_ = np.concatenate(rules) if rules else np.zeros((0, 2), dtype=np.int64)
    return seq.astype(np.int64), last, rules_, np.concatenate(lengths) if lengths else np.zeros(0, dtype=np.int64)


def to_payload(doc_ids: list[int | None], ids: list[np.ndarray], terminals: int) -> bytes:
    flat = np.concatenate(ids)
    ends = np.cumsum([len(x) for x in ids])
    last = np.zeros(len(flat), dtype=bool)
    last[ends - 1] = True
    symbols, last, rules, lengths = compress(flat, last, terminals)
    first = np.concatenate([[0], np.flatnonzero(last) + 1])
    parts = [(np.array([MAGIC, VERSION, terminals, len(rules), len(symbols), len(ids), 0, 0]), "<u4"), (rules, "<u4"), (lengths, "<u4"), (np.array([d or 0 for d in doc_ids], dtype=np.int64), "<i8"), (np.array([d is None for d in doc_ids]), "u1"), (first, "<u4"), (np.concatenate([[0], ends]), "<i8"), (symbols, "<u4")]
    return b"".join(np.ascontiguousarray(a).astype(t).tobytes() for a, t in parts)


class Payload:
    """Random access to the documents of a block."""

    def __init__(self, data: bytes):
        head = np.frombuffer(data, "<u4", 8)
        if head[0] != MAGIC or head[1] != VERSION:
            raise ValueError("not a payload of this format")
        self.terminals, n_rules, n_symbols, self.n_docs = map(int, head[2:6])
        at = 32
        for name, kind, n in (("rules", "<u4", 2 * n_rules), ("lengths", "<u4", n_rules), ("doc_ids", "<i8", self.n_docs), ("null", "u1", self.n_docs), ("first", "<u4", self.n_docs + 1), ("before", "<i8", self.n_docs + 1), ("symbols", "<u4", n_symbols)):
            setattr(self, name, np.frombuffer(data, kind, n, at))
            at += self.__dict__[name].nbytes
        self.rules = self.rules.reshape(-1, 2)

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        symbols = symbols.astype(np.int64)
        while len(at := np.flatnonzero(symbols >= self.terminals)):
            n = np.ones(len(symbols), dtype=np.int64)
            n[at] = 2
            out, where = np.repeat(symbols, n), np.cumsum(n) - n
            pair = self.rules[symbols[at] - self.terminals]
            out[where[at]], out[where[at] + 1] = pair[:, 0], pair[:, 1]
            symbols = out
        return symbols.astype("<u4")

    def document(self, k: int) -> np.ndarray:
        return self.expand(self.symbols[self.first[k] : self.first[k + 1]])

    def at(self, k: int, i: int) -> int:
        """Id number i of document k: skips symbols and descends rules by their expansion lengths alone."""
        own = self.symbols[self.first[k] : self.first[k + 1]].astype(np.int64)
        size = np.where(own < self.terminals, 1, self.lengths[np.maximum(own - self.terminals, 0)] if len(self.lengths) else 1)
        ends = np.cumsum(size)
        j = int(np.searchsorted(ends, i, side="right"))
        i, s = i - int(ends[j] - size[j]), int(own[j])
        while s >= self.terminals:
            left, right = map(int, self.rules[s - self.terminals])
            n = 1 if left < self.terminals else int(self.lengths[left - self.terminals])
            s, i = (left, i) if i < n else (right, i - n)
        return s


def write_grammars(docs: DataFrame, tokenizer: str, terminals: int, end: int = END, block_ids: int = BLOCK_IDS, name: str = "repair") -> DataFrame:
    """Encodes and compresses documents in ascending doc_id order; returns the written files as a DataFrame.

    Shards are ranges of doc_id, of which one that repeats is cut further by its texts and by place. A task holds one block:
    block_ids ids, or one longer document.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, encode = TaskContext.get().partitionId(), public_encoder(tokenizer, space_chunks)
        block, docs_, ids, n = 0, [], [], 0

        def row() -> pa.RecordBatch:
            values = [shard, block, docs_[0], len(docs_), n, to_payload(docs_, ids, terminals)]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, [pa.int64()] * 5 + [pa.binary()], strict=True)], ["shard", "block", "first_doc", "n_docs", "n_ids", "payload"])

        for b in pieces(batches):
            flat, at = with_end(*encode(b.column("text")), end)
            for d, start, then in zip(b.column("doc_id").to_pylist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
                docs_.append(d)
                ids.append(flat[start:then])
                n += then - start
                if n >= block_ids:
                    yield row()
                    block, docs_, ids, n = block + 1, [], [], 0
        if docs_:
            yield row()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    rows = rows.withColumns({"_hash": F.xxhash64("text"), "_place": F.monotonically_increasing_id()})
    rows = rows.repartitionByRange("doc_id", "_hash", "_place").sortWithinPartitions("doc_id", "_hash", "_place").drop("_hash", "_place")
    return scratch(rows.mapInArrow(run, "shard long, block long, first_doc long, n_docs long, n_ids long, payload binary"), name)


def read_grammars(files: DataFrame, with_ids: bool = False) -> DataFrame:
    """Documents of written files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32, and ids if asked for.

    Null texts count as empty (the end id alone), null doc_ids come first, rows that repeat a doc_id follow each other in a
    fixed order; an empty table gives no rows.
    """
    sizes = files.groupBy("shard").agg(F.sum("n_ids").alias("n"))  # a row a shard
    shards = sizes.select("shard", F.coalesce(F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    earlier = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = files.select("shard", "block", F.coalesce(F.sum("n_ids").over(earlier), F.lit(0)).alias("within")).join(shards, "shard")
    starts = blocks.select("shard", "block", (F.col("before") + F.col("within")).alias("base"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for base, payload in zip(b.column("base").to_pylist(), b.column("payload"), strict=True):
                p = Payload(payload.as_py())
                flat = p.expand(p.symbols)
                own = [flat[p.before[k] : p.before[k + 1]] for k in range(p.n_docs)]
                cols = [pa.array(p.doc_ids, mask=p.null.astype(bool)), pa.array(p.before[:-1] + base), pa.array(np.diff(p.before)), pa.array([zlib.crc32(x) for x in own], pa.int64())]
                cols += [pa.array([x.tobytes() for x in own], pa.binary())] * with_ids
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids)

    rows = files.select("shard", "block", "payload").join(starts, ["shard", "block"]).select("base", "payload")
    return rows.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids)
