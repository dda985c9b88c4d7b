"""Line deduplication by a segment-partition edit join.

Lines that differ by at most `threshold` edits are linked: of threshold + 1 segments of the one, at least one occurs unchanged
in the other, at nearly the same place. Each line's segments are index keys (segment number, line length, content); each line
also probes, for each length down to its own less the threshold, the few substrings that can match (multi-match-aware
selection). Keys that an index and another line share are buckets; their pairs are verified on the whole lines with a banded
bit-parallel edit distance, unless they are connected already. Of each component of lines the first occurrence stays.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.buckets import BLOCK, Union, dealt, in_blocks, tasks
from corpusloom.llm import caches
from corpusloom.llm.common import bitmap, components, in_bitmap, pieces, scratch, text_or_empty
from corpusloom.llm.words import mix

THRESHOLD, LEAST_LENGTH = 2, 20
_M = 0x9E3779B97F4A7C15
_INVERSE = pow(_M, -1, 1 << 64)


def segments(length: int, threshold: int) -> list[tuple[int, int]]:
    """(start, length) of the threshold + 1 segments of lines of a length; the longer ones come last."""
    k = threshold + 1
    base, longer = divmod(length, k)
    out, at = [], 0
    for i in range(k):
        n = base + (i >= k - longer)
        out.append((at, n))
        at += n
    return out


def probes(length: int, target: int, threshold: int) -> list[tuple[int, int, int]]:
    """(segment number, start, length) of the substrings of a line that can equal a segment of a line of `target` characters."""
    out, delta = [], length - target
    for i, (p, n) in enumerate(segments(target, threshold)):
        low = max(0, p - i, p + delta - (threshold - i))
        high = min(length - n, p + i, p + delta + (threshold - i))
        out += [(i, s, n) for s in range(low, high + 1)]
    return out


def within(a: str, b: str, threshold: int) -> bool:
    """Whether the edit distance is at most threshold: bit-parallel, in a band of 2 x threshold + 1 diagonals."""
    if abs(len(a) - len(b)) > threshold:
        return False
    start, ends = 0, min(len(a), len(b))
    while start < ends:  # common prefix, by galloping
        step = 1
        while start + step <= ends and a[start : start + step] == b[start : start + step]:
            start, step = start + step, 2 * step
        if step == 1:
            break
    a, b = a[start:], b[start:]
    ends, tail = min(len(a), len(b)), 0
    while tail < ends and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    if not a or not b:
        return True
    if threshold == 0:
        return False
    m, n, k = len(a), len(b), threshold
    width = 2 * k + 2
    full, top = (1 << width) - 1, 1 << (width - 1)  # bit width - 1: row column + k
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    vp, vn, bottom = full ^ ((1 << (width - k - 1)) - 1), 0, k
    most = 2 * k + n - m
    for j, c in enumerate(b):
        shift = j + k + 1 - width  # row of the band's first bit, from 0
        eq = places.get(c, 0)
        eq = (eq >> shift if shift >= 0 else eq << -shift) & full
        x = eq | vn
        d0 = ((((x & vp) + vp) ^ vp) | x) & full
        hp, hn = (vn | ~(d0 | vp)) & full, d0 & vp
        bottom += not d0 & top
        if bottom > most:
            return False
        d0 >>= 1
        vp, vn = (hn | ~(d0 | hp)) & full, d0 & hp
    beyond = n + k - m  # rows of the band below the last one of a
    mask = ((1 << beyond) - 1) << (width - 1 - beyond)
    return bottom - (vp & mask).bit_count() + (vn & mask).bit_count() <= k


def _lines(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all lines of all texts, line starts and line lengths; a text is split at line feeds."""
    points = np.frombuffer("\n".join(texts).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    ends = np.append(np.flatnonzero(points == 10), len(points))
    starts = np.concatenate([[0], ends[:-1] + 1])
    return points, starts, ends - starts


def signatures(docs: DataFrame, threshold: int, least_length: int) -> DataFrame:
    """key, line (hash of its content), indexed: the keys of each line of at least least_length characters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        caches.only("")
        for b in pieces(batches, 1_000_000):
            texts = b.column("text").to_pylist()
            points, starts, lengths = _lines(texts)
            lines = [x for t in texts for x in t.split("\n")]
            use = np.flatnonzero(lengths >= least_length)
            names = np.array([xxhash.xxh3_128_intdigest(lines[i].encode()) & 0xFFFFFFFFFFFFFFFF for i in use.tolist()], dtype=np.uint64)
            names, first = np.unique(names, return_index=True)
            use = use[first]
            starts, lengths = starts[use], lengths[use]
            powers = np.cumprod(np.full(len(points) + 1, _M, dtype=np.uint64))
            sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum((points.astype(np.uint64) + np.uint64(1)) * powers[:-1])])
            back = np.cumprod(np.full(len(points) + 1, _INVERSE, dtype=np.uint64))
            keys, own, indexed = [], [], []
            for length in np.unique(lengths).tolist():
                at = np.flatnonzero(lengths == length)
                for target in range(max(least_length, length - threshold), length + 1):
                    parts = segments(target, threshold)
                    for i, s, n in probes(length, target, threshold):
                        begin = starts[at] + s
                        content = (sums[begin + n] - sums[begin]) * back[begin]
                        keys.append(mix(content + np.uint64((i + 1) * 0x632BE59BD9B4E019 + target * 0xD1342543DE82EF95 & 0xFFFFFFFFFFFFFFFF)))
                        own.append(at)
                        indexed.append(np.full(len(at), target == length and s == parts[i][0]))
            if keys:
                own_ = np.concatenate(own)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(names[own_].view(np.int64)), pa.array(np.concatenate(indexed))], ["key", "line", "indexed"])

    return docs.select(text_or_empty("text").alias("text")).mapInArrow(run, "key long, line long, indexed boolean")


def occurrences(docs: DataFrame) -> DataFrame:
    """row, doc_id, place, line (as of signatures()), digest of each line that is not blank."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            of, place, digest = [], [], []
            for k, t in enumerate(b.column("text").to_pylist()):
                for i, x in enumerate(t.split("\n")):
                    if x and not x.isspace():
                        of.append(k)
                        place.append(i)
                        digest.append(xxhash.xxh3_128_digest(x.encode()))
            line = [int.from_bytes(d[8:], "big", signed=True) for d in digest]
            yield pa.RecordBatch.from_arrays([b.column("row").take(pa.array(of, pa.int64())), b.column("doc_id").take(pa.array(of, pa.int64())), pa.array(place, pa.int32()), pa.array(line, pa.int64()), pa.array(digest, pa.binary())], ["row", "doc_id", "place", "line", "digest"])

    return docs.select("row", "doc_id", "text").mapInArrow(run, "row long, doc_id long, place int, line long, digest binary")


def near_lines(docs: DataFrame, threshold: int, least_length: int, block: int) -> DataFrame:
    """id, root: lines (hashes) that edits connect. Texts are read again for the lines that share a bucket, and only those move."""
    by_key = Window.partitionBy("key")
    rows = signatures(docs, threshold, least_length)
    rows = rows.withColumns({"low": F.min("line").over(by_key), "high": F.max("line").over(by_key), "any": F.max("indexed").over(by_key)})
    shared = scratch(rows.where("low <> high and any").groupBy(F.col("key").alias("bucket"), "line").agg(F.max("indexed").alias("indexed")), "lines-buckets")
    sizes = scratch(shared.groupBy("bucket").agg(F.count("*").alias("n")), "lines-sizes")
    wanted = scratch(shared.select("line").distinct(), "lines-wanted")
    marks = bitmap(wanted, "line")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            texts = list({x for t in b.column("text").to_pylist() for x in t.split("\n") if len(x) >= least_length})
            names = np.array([xxhash.xxh3_128_intdigest(x.encode()) & 0xFFFFFFFFFFFFFFFF for x in texts], dtype=np.uint64).view(np.int64)
            use = np.flatnonzero(in_bitmap(marks.value, names))
            yield pa.RecordBatch.from_arrays([pa.array(names[use]), pa.array([texts[i] for i in use.tolist()], pa.string())], ["line", "content"])

    content = docs.select("text").mapInArrow(read, "line long, content string").join(wanted, "line", "left_semi")
    content = scratch(content.dropDuplicates(["line"]), "lines-content")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in tasks(batches):
            line, text, indexed, own, n = t["line"], t["content"], t["indexed"], t["own"], len(t["line"])
            cross, union = t["low"][0] != t["high"][0], Union(n)
            order = sorted(range(n), key=lambda i: (len(text[i]), text[i]))  # lines that are alike meet early
            for p, i in enumerate(order):
                for j in order[p + 1 :]:
                    if len(text[j]) - len(text[i]) > threshold:
                        break
                    if (indexed[i] or indexed[j]) and (not cross or own[i] != own[j]) and union.root(i) != union.root(j) and within(text[i], text[j], threshold):
                        union.join(i, j)
            edges = [(line[i], line[union.root(i)]) for i in range(n) if union.root(i) != i]
            if edges:
                yield pa.RecordBatch.from_arrays([pa.array([e[0] for e in edges], pa.int64()), pa.array([e[1] for e in edges], pa.int64())], ["a", "b"])

    rows = in_blocks(shared.join(sizes, "bucket"), "line", F.ceil(F.col("n") / block)).join(content, "line")
    edges = scratch(dealt(rows).mapInArrow(check, "a long, b long"), "lines-verified")
    return components(edges, "lines-edges")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = THRESHOLD, least_length: int = LEAST_LENGTH, block: int = BLOCK) -> DataFrame:
    """One row per row of docs: id_col, n_lines, n_removed, kept_sha256, kept: the text that is left where lines were removed
    (else null), and row_key: a hash of id and text.

    A line goes if an equal one, or one connected with it by steps of at most `threshold` edits (lines of at least
    least_length characters), occurs at a smaller (id, line number); null ids come first. Blank lines stay. A null text counts
    as empty: one blank line. Rows are told apart by id and text; rows that repeat both keep the same lines. An empty table
    gives no rows; other columns are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("row"), text_or_empty(text_col).alias("text"))
    found = scratch(occurrences(rows), "lines-found")
    near = scratch(near_lines(rows, threshold, least_length, block), "lines-near")
    named = found.join(near, found["line"] == near["id"], "left").select("row", "doc_id", "place", F.when(F.col("root").isNotNull(), F.unhex(F.hex("root"))).otherwise(F.col("digest")).alias("line"))
    named = scratch(named, "lines-named")
    first = named.groupBy("line").agg(F.min(F.struct("doc_id", "place")).alias("first"), F.count("*").alias("n")).where("n > 1").select("line", "first")
    first = scratch(first, "lines-first")
    gone = named.join(first, "line").where(~F.struct("doc_id", "place").eqNullSafe(F.col("first")))
    gone = gone.groupBy("row").agg(F.collect_set("place").alias("gone"))  # bounded by the text

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            out: list[list] = [[], [], [], []]
            for t, g in zip(b.column("text").to_pylist(), b.column("gone").to_pylist(), strict=True):
                lines, drop = t.split("\n"), set(g or ())
                kept = "\n".join([x for i, x in enumerate(lines) if i not in drop]) if drop else t
                for c, v in zip(out, (len(lines), len(drop), hashlib.sha256(kept.encode()).hexdigest(), kept if drop else None), strict=True):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2]), pa.array(out[3], pa.string()), b.column("row")], [id_col, "n_lines", "n_removed", "kept_sha256", "kept", "row_key"])

    return rows.join(gone, "row", "left").select("row", "doc_id", "text", "gone").mapInArrow(cut, f"`{id_col}` long, n_lines long, n_removed long, kept_sha256 string, kept string, row_key long")
