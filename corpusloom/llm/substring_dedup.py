"""Substring deduplication: passages of `window` words that start anywhere else are removed, by suffix automata.

1. Winnowing: each window is assigned to its least GRAM-word hash, its anchor. Equal windows have equal anchors, at the same
   place in them. Neighbouring windows with one anchor are a region.
2. Anchors that occur once are dropped after a count (combined before the shuffle). What stays are the reference regions.
3. Regions are dealt to reference shards by anchor, so that all occurrences of a window meet in one shard. Each shard, of
   bounded size, becomes a generalized suffix automaton with occurrence counts; its regions stream through it, and matching
   statistics of `window` words in a state that occurs twice mark repeated windows. The automata go to their regions and
   not to all tasks: broadcasting every shard to every document would cost shards x documents.
4. Marked windows return to their documents, and the words that they cover go.

Regions of an anchor that occurs very often are cut into single windows and dealt by anchor and content, so no anchor fills
a task; identical regions are counted where they are found and sent on once a batch.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import pieces, scratch
from corpusloom.llm.words import grams, hashes, split, text_bytes

WINDOW, GRAM = 35, 20
HOT_ANCHOR, SHARD_WORDS = 2_000, 20_000


class SuffixAutomaton:
    """Of several sequences, with the number of occurrences of what each state stands for."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.length, self.count = [-1], [0], [0]

    def _state(self, length: int, link: int, then: dict) -> int:
        self.next.append(then)
        self.link.append(link)
        self.length.append(length)
        self.count.append(0)
        return len(self.link) - 1

    def _clone(self, p: int, x: int, q: int) -> int:
        c = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = c
        while p >= 0 and self.next[p].get(x) == q:
            self.next[p][x] = c
            p = self.link[p]
        return c

    def add(self, sequence: list, times: int) -> None:
        last = 0
        for x in sequence:
            q = self.next[last].get(x)
            if q is not None:
                last = q if self.length[q] == self.length[last] + 1 else self._clone(last, x, q)
            else:
                new, p = self._state(self.length[last] + 1, 0, {}), last
                while p >= 0 and x not in self.next[p]:
                    self.next[p][x] = new
                    p = self.link[p]
                if p >= 0:
                    q = self.next[p][x]
                    self.link[new] = q if self.length[q] == self.length[p] + 1 else self._clone(p, x, q)
                last = new
            self.count[last] += times

    def finish(self) -> None:
        for s in sorted(range(1, len(self.link)), key=self.length.__getitem__, reverse=True):
            self.count[self.link[s]] += self.count[s]

    def statistics(self, sequence: list, window: int) -> Iterator[int]:
        """For each end of a window in sequence: how often the window occurs (0 where the match is shorter)."""
        state = matched = 0
        for i, x in enumerate(sequence, 1):
            while state and x not in self.next[state]:
                state = self.link[state]
                matched = self.length[state]
            if x in self.next[state]:
                state, matched = self.next[state][x], matched + 1
            while state and self.length[self.link[state]] >= window:
                state = self.link[state]
                matched = self.length[state]
            if i >= window:
                yield self.count[state] if matched >= window else 0


def regions(h: np.ndarray, at: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text number, first window, number of windows, anchor) of the regions of all texts; h and at as of words.hashes()."""
    none = np.zeros(0, dtype=np.int64)
    value = grams(h, gram)
    if len(value) < window - gram + 1:
        return none, none, none, none.view(np.uint64)
    pos, span, left = np.arange(len(value)), 1, window - gram + 1
    least, where = value, pos
    while span < left:  # least of `left` neighbours, the leftmost of equals, by doubling
        step = min(span, left - span)
        keep = least[:-step] <= least[step:]
        least, where, span = np.where(keep, least[:-step], least[step:]), np.where(keep, where[:-step], where[step:]), span + step
    text = np.repeat(np.arange(len(at) - 1), np.diff(at))[: len(where)]
    valid = np.arange(len(where)) + window <= at[text + 1]
    start = np.flatnonzero(valid)
    if not len(start):
        return none, none, none, none.view(np.uint64)
    own, of = where[start], text[start]
    new = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]) | (of[1:] != of[:-1])]))
    first = start[new]
    return of[new], first - at[of[new]], np.diff(np.append(new, len(start))), value[own[new]]


def find_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """One row per row of docs: id_col, n_words, n_removed, kept_sha256, kept: the words left, joined by one space, where words
    were removed (else null), and row_key: a hash of id and text.

    Null texts have no words; texts of fewer words than a window lose none. Rows are told apart by id and text: rows that
    repeat both are documents of their own whose windows repeat each other, so they lose them, and each is reported. Null
    ids are allowed. An empty table gives no rows; other columns are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("row"), text_bytes(text_col).alias("text"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            words = split(b.column("text"))
            h, at = hashes(words)
            of, first, n, anchor = regions(h, at, window, gram)
            row, m, d = b.column("row"), len(of), len(words)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.concat_arrays([row.take(pa.array(of)), row]), pa.array(np.concatenate([anchor.view(np.int64), np.zeros(d, np.int64)]), mask=np.arange(m + d) >= m),
                    pa.array(np.concatenate([first, np.diff(at)]), pa.int32()), pa.array(np.concatenate([n, np.zeros(d, np.int64)]), pa.int32()),
                    pa.concat_arrays([pa.nulls(m, pa.int64()), b.column("doc_id")]), pa.array([None] * m + [hashlib.sha256(b" ".join(w)).hexdigest() for w in words], pa.string()),
                ],
                ["row", "anchor", "first", "n", "doc_id", "sha"],
            )

    # A row a region, and a row a document (anchor null, first: its words): texts are read and split once for both.
    scanned = scratch(rows.mapInArrow(scan, "row long, anchor long, first int, n int, doc_id long, sha string"), "substring-scan")
    found = scanned.where("anchor is not null").select("row", "anchor", "first", "n")
    often = scratch(found.groupBy("anchor").agg(F.count("*").alias("times")).where("times > 1"), "substring-anchors")
    hits = found.join(often, "anchor").groupBy("row").agg(F.collect_set(F.struct("anchor", "first", "n", "times")).alias("hits"))  # bounded by the text

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            h, at = hashes(split(b.column("text")))
            out: list[list] = [[], [], [], []]
            payloads: dict[bytes, list] = {}
            for k, (row, marks) in enumerate(zip(b.column("row").to_pylist(), b.column("hits").to_pylist(), strict=True)):
                own = h[at[k] : at[k + 1]]
                for x in marks:
                    parts = [(x["first"], x["n"])] if x["times"] < HOT_ANCHOR else [(i, 1) for i in range(x["first"], x["first"] + x["n"])]
                    for first, n in parts:
                        data = own[first : first + n + window - 1].tobytes()
                        name = xxhash.xxh3_128_digest(data)
                        key = x["anchor"] if x["times"] < HOT_ANCHOR else int.from_bytes(name[:8], "little", signed=True)
                        payloads.setdefault(name, [key, data, 0])[2] += 1
                        for c, v in zip(out, (row, name, first, n), strict=True):
                            c.append(v)
            m, p = len(out[0]), list(payloads.values())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(out[0] + [None] * len(p), pa.int64()), pa.array(out[1] + list(payloads), pa.binary()), pa.array(out[2] + [0] * len(p), pa.int32()), pa.array(out[3] + [0] * len(p), pa.int32()),
                    pa.array([None] * m + [x[0] for x in p], pa.int64()), pa.array([None] * m + [x[1] for x in p], pa.binary()), pa.array([0] * m + [x[2] for x in p], pa.int64()),
                ],
                ["row", "region", "first", "n", "key", "words", "times"],
            )

    with_text = scratch(rows.join(hits, "row").select("doc_id", "row", "text", "hits"), "substring-texts")
    gathered = scratch(with_text.mapInArrow(gather, "row long, region binary, first int, n int, key long, words binary, times long"), "substring-regions")

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, dict[bytes, list]] = {}  # by key: distinct regions with their counts
        size = 0

        def shard() -> pa.RecordBatch:
            names, masks = [], []
            sam = None
            for group in held.values():
                if len(group) > 1:
                    sam = sam or SuffixAutomaton()
                    for words, times in group.values():
                        sam.add(words, times)
            if sam:
                sam.finish()
            for group in held.values():
                for name, (words, times) in group.items():
                    n = len(words) - window + 1
                    mask = [times > 1] * n if len(group) == 1 else [c > 1 for c in sam.statistics(words, window)]
                    if any(mask):
                        names.append(name)
                        masks.append(bytes(mask))
            return pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(masks, pa.binary())], ["region", "mask"])

        for b in batches:
            for key, name, data, times in zip(*(b.column(c).to_pylist() for c in ("key", "region", "words", "times")), strict=True):
                if key not in held and size >= SHARD_WORDS:
                    yield shard()
                    held, size = {}, 0
                group = held.setdefault(key, {})
                if name in group:
                    group[name][1] += times
                else:
                    group[name] = [np.frombuffer(data, dtype=np.uint64).tolist(), times]
                    size += len(data) // 8
        if held:
            yield shard()

    sent = gathered.where("key is not null").select("key", "region", "words", "times")
    sent = sent.repartition("key").sortWithinPartitions("key")
    marked = scratch(sent.mapInArrow(match, "region binary, mask binary"), "substring-marked")
    spans = gathered.where("key is null").select("row", "region", "first").join(marked, "region").groupBy("row").agg(F.collect_set(F.struct("first", "mask")).alias("spans"))

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            out: list[list] = [[], [], []]
            for words, spans_ in zip(split(b.column("text")), b.column("spans").to_pylist(), strict=True):
                change = np.zeros(len(words) + 1, dtype=np.int64)
                for s in spans_:
                    start = s["first"] + np.flatnonzero(np.frombuffer(s["mask"], dtype=bool))
                    np.add.at(change, start, 1)
                    np.add.at(change, start + window, -1)
                gone = np.cumsum(change[:-1]) > 0
                kept = b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g])
                for c, v in zip(out, (int(gone.sum()), hashlib.sha256(kept).hexdigest(), kept.decode()), strict=True):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("doc_id"), pa.array(out[0], pa.int64()), pa.array(out[1]), pa.array(out[2])], ["row", "id", "n_removed", "kept_sha256", "kept"])

    changed = with_text.select("row", "doc_id", "text").join(spans, "row").mapInArrow(remove, "row long, id long, n_removed long, kept_sha256 string, kept string").dropDuplicates(["row", "id"])
    every = scanned.where("anchor is null").select("row", "doc_id", F.col("first").cast("long").alias("n_words"), "sha")
    out = every.join(changed, (every.row == changed.row) & every.doc_id.eqNullSafe(changed.id), "left")
    return out.select(F.col("doc_id").alias(id_col), "n_words", F.coalesce("n_removed", F.lit(0)).alias("n_removed"), F.coalesce("kept_sha256", "sha").alias("kept_sha256"), "kept", every.row.alias("row_key"))
