"""Jaccard join of documents on word shingles by chosen paths.

Documents with the same set of shingles are one class. Each run splits all classes on one sampled token, their least shingle
under the run's hash, which two sets share with their Jaccard similarity as probability. A bucket that is too large for brute
force is split again, on FAN further sampled tokens at once, up to DEPTH times; a bucket most of which shares such a token is
dense, and is compared in pairs of blocks. The number of runs follows from the target recall. Each pair is verified on its
whole sets, and is counted in the first bucket that its two classes share, so no pair of rows is written for it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.buckets import Union, dealt, in_blocks, tasks
from corpusloom.llm.common import bitmap, components, in_bitmap, pieces, scratch
from corpusloom.llm.words import grams, hashes, mix, split, text_bytes

SHINGLE, THRESHOLD, RECALL = 5, 0.8, 0.99999
FAN, DEPTH, SPARE, DENSE = 4, 3, 24, 0.5
#: Classes above which a bucket is split again; classes and shingles that a block of a bucket holds at most, on average.
LIMIT, BLOCK, BLOCK_SHINGLES = 256, 4096, 1 << 21


def runs_for(threshold: float, recall: float) -> int:
    """Runs after which a pair at the threshold has met with probability `recall`, even if each of its buckets is split DEPTH times."""
    meets = threshold * (1 - (1 - threshold) ** FAN) ** DEPTH
    return math.ceil(math.log(1 - recall) / math.log(1 - meets))


def shingle_sets(words: list[list[bytes]], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, in a row, and where each begins. Texts of 1 to k - 1 words have one shingle: all
    of them."""
    h, at = hashes(words)
    g = grams(h, k)
    sets = [np.unique(g[a : b - k + 1]) if b - a >= k else grams(h[a:b], b - a) + np.uint64(b - a) if b > a else h[:0] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
    return np.concatenate(sets) if sets else h, np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int64)


def _class(s: np.ndarray) -> int:
    return int.from_bytes(xxhash.xxh3_128_digest(s.tobytes())[:8], "little", signed=True)


def sketches(docs: DataFrame, id_col: str, text_col: str, k: int, n: int) -> DataFrame:
    """row (hash of id and text), doc_id, class (of equal sets; null: no words), size (of the set), least: n tokens, one for each of
    n hashes."""
    seeds = mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, 2_000_000):
            flat, at = shingle_sets(split(b.column("text")), k)
            full = np.flatnonzero(np.diff(at))
            least = np.zeros((len(at) - 1, n), dtype=np.uint64)
            if len(full):
                for j, seed in enumerate(seeds):
                    x = (flat ^ seed) * np.uint64(0xD6E8FEB86659FD93)
                    least[full, j] = np.minimum.reduceat(x ^ (x >> np.uint64(32)), at[full])
            names = [_class(flat[a:z]) if z > a else None for a, z in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            values = pa.ListArray.from_arrays(pa.array(np.arange(len(at)) * n, pa.int32()), pa.array(least.view(np.int64).ravel()))
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("doc_id"), pa.array(names, pa.int64()), pa.array(np.diff(at)), values], ["row", "doc_id", "class", "size", "least"])

    rows = docs.select(F.xxhash64(F.col(id_col), F.col(text_col)).alias("row"), F.col(id_col).cast("long").alias("doc_id"), text_bytes(text_col).alias("text"))
    return rows.mapInArrow(run, "row long, doc_id long, class long, size long, least array<long>")


def choose_paths(classes: DataFrame, runs: int, limit: int = LIMIT, depth: int = DEPTH) -> DataFrame:
    """classes (class, size, least): the leaves: bucket, class, size, n (classes in the bucket, 2 or more)."""

    def counted(rows: DataFrame, name: str) -> DataFrame:
        sizes = scratch(rows.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"), name + "-sizes")
        return scratch(rows.join(sizes, "bucket"), name)

    tokens = classes.select("class", "size", F.posexplode(F.slice("least", 1, runs)).alias("run", "token"))
    level = counted(tokens.select(F.xxhash64("run", "token").alias("bucket"), "class", "size").distinct(), "paths-0")
    leaves = [level.where(F.col("n") <= limit)]
    for d in range(depth):
        large = level.where(F.col("n") > limit)
        if large.isEmpty():
            break
        step = F.expr(f"transform(sequence(0, {FAN - 1}), i -> cast({runs} + pmod(xxhash64(bucket, {d}) + i, {SPARE}) as int))")
        split_ = large.join(classes.select("class", "least"), "class").select("bucket", "class", "size", "n", "least", F.explode(step).alias("j"))
        split_ = split_.select(F.col("bucket").alias("parent"), "class", "size", F.col("n").alias("whole"), "j", F.expr("element_at(least, j + 1)").alias("token"))
        split_ = scratch(split_.withColumn("bucket", F.xxhash64("parent", "j", "token")), f"paths-{d + 1}-split")
        sizes = scratch(split_.groupBy("parent", "bucket").agg(F.count("*").alias("n"), F.max("whole").alias("whole")), f"paths-{d + 1}-sizes")
        dense = scratch(sizes.groupBy("parent").agg((F.max(F.col("n") / F.col("whole")) >= DENSE).alias("dense")).where("dense"), f"paths-{d + 1}-dense").select(F.col("parent").alias("bucket"))
        leaves.append(large.join(dense, "bucket", "left_semi"))
        children = scratch(sizes.where("n > 1").join(dense.withColumnRenamed("bucket", "parent"), "parent", "left_anti").select("bucket", "n"), f"paths-{d + 1}-children")
        level = scratch(split_.select("bucket", "class", "size").join(children, "bucket"), f"paths-{d + 1}")
        leaves.append(level if d == depth - 1 else level.where(F.col("n") <= limit))
    out = leaves[0]
    for more in leaves[1:]:
        out = out.unionByName(more)
    return out


def distinct_buckets(leaves: DataFrame) -> DataFrame:
    """leaves without buckets that have the same classes as another one: the copies of a pair meet in most runs, once is enough. Adds
    shingles: those of all classes of the bucket."""
    members = leaves.groupBy("bucket").agg(F.count("*").alias("n"), F.expr("bit_xor(xxhash64(class, 1))").alias("x"), F.expr("bit_xor(xxhash64(class, 2))").alias("y"), F.sum("size").alias("shingles"))
    one = scratch(members.groupBy("n", "x", "y").agg(F.min("bucket").alias("bucket"), F.max("shingles").alias("shingles")).select("bucket", "shingles"), "paths-distinct")
    return scratch(leaves.join(one, "bucket"), "paths-leaves")


def _overlaps(rows: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray]]:
    """For each row i: how many values it shares with each later row. Values that many rows have are bits of a row (a column is as
    wide as 64 mean rows at most); the others are counted by their sorted postings."""
    n = len(rows)
    _, which, times = np.unique(np.concatenate(rows), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(n, dtype=np.int32), [len(r) for r in rows])
    common, rare = times * 64 >= n, times * 64 < n
    common[times < 2] = rare[times < 2] = False
    column, use = np.cumsum(common) - 1, common[which]
    bits = np.zeros((n, (int(common.sum()) + 63) // 64 * 8), dtype=np.uint8)
    own, col = owner[use], column[which[use]]
    np.bitwise_or.at(bits, (own, col >> 3), (1 << (col & 7)).astype(np.uint8))
    words = bits.view(np.uint64)
    use = rare[which]
    own, col = owner[use], which[use]
    by = np.argsort(col, kind="stable")  # postings: of each value, its rows in rising order
    postings, place = own[by], np.empty(len(by), dtype=np.int64)
    place[by] = np.arange(len(by))
    left = np.searchsorted(col[by], col, side="right") - place - 1  # later rows in the posting of each occurrence
    at = np.searchsorted(own, np.arange(n + 1))
    for i in range(n - 1):
        found = np.bitwise_count(words[i] & words[i + 1 :]).sum(axis=1, dtype=np.int64)
        a, z = at[i], at[i + 1]
        if many := int(left[a:z].sum()):
            begin = np.repeat(place[a:z] + 1 - (np.cumsum(left[a:z]) - left[a:z]), left[a:z])
            found += np.bincount(postings[begin + np.arange(many)], minlength=n)[i + 1 :]
        yield i, found


def verify(task: dict[str, list], threshold: float) -> tuple[list, list, list]:
    """(class, linked documents counted here) and edges (class, class) of a task of dealt()."""
    sets = [np.frombuffer(s, dtype=np.uint64) for s in task["set"]]
    names, own, copies, cross, here = task["class"], np.array(task["own"]), np.array(task["copies"]), task["low"][0] != task["high"][0], task["bucket"][0]
    n = np.array([len(s) for s in sets])
    links, union = np.zeros(len(sets), dtype=np.int64), Union(len(sets))
    earlier = [np.array([x for x in b if x < here], dtype=np.int64).view(np.uint64) for b in task["buckets"]]
    met = _overlaps(earlier) if any(map(len, earlier)) else ((i, np.zeros(len(sets) - 1 - i, dtype=np.int64)) for i in range(len(sets) - 1))
    for (i, inter), (_, before) in zip(_overlaps(sets), met, strict=True):
        linked = inter >= threshold * (n[i] + n[i + 1 :] - inter) - 1e-9
        if cross:
            linked &= own[i + 1 :] != own[i]
        for j in (i + 1 + np.flatnonzero(linked)).tolist():
            union.join(i, j)
        first = i + 1 + np.flatnonzero(linked & (before == 0))
        links[first] += copies[i]
        links[i] += copies[first].sum()
    a = [k for k in range(len(sets)) if links[k]]
    e = [k for k in range(len(sets)) if union.root(k) != k]
    return [names[k] for k in a], links[a].tolist(), [(names[k], names[union.root(k)]) for k in e]


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE, threshold: float = THRESHOLD, recall: float = RECALL, limit: int = LIMIT, block: int = BLOCK, shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """One row per row of docs: id_col, class_id (least id of the documents reachable by links, itself included), n_links (other
    rows with Jaccard similarity of at least threshold), kept (id_col = class_id), row_key (a hash of id and text).

    Words are runs of bytes other than ASCII white space, unchanged. Texts of 1 to k - 1 words have one shingle. Null and
    empty texts, or texts without words, link with nothing. Null ids are least only among null ids; a class of them only is
    kept. Rows that repeat an id and text are linked with each other, and both are kept if that id is the least. An empty
    table gives no rows; other columns are not read.
    """
    runs = runs_for(threshold, recall)
    sketched = scratch(sketches(docs, id_col, text_col, k, runs + SPARE), "paths-sketches")
    classes = sketched.where("class is not null")
    # One row a class; its members have the same set, so the same sketch.
    single = scratch(classes.groupBy("class").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first"), F.max("size").alias("size"), F.any_value("least").alias("least")), "paths-classes")
    copies = single.select("class", "copies", "first")
    leaves = distinct_buckets(scratch(choose_paths(single.select("class", "size", "least"), runs, limit), "paths-all"))
    paths = leaves.groupBy("class").agg(F.collect_set("bucket").alias("buckets"))  # bounded by runs x FAN ^ DEPTH
    wanted = scratch(paths.join(copies, "class"), "paths-wanted")

    marks = bitmap(wanted, "first")
    any_null = not wanted.where("first is null").isEmpty()

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            ids = b.column("doc_id")
            may = in_bitmap(marks.value, ids.fill_null(0).to_numpy(zero_copy_only=False))
            nulls = ids.is_null().to_numpy(zero_copy_only=False)
            b = b.filter(pa.array(np.where(nulls, any_null, may)))
            flat, at = shingle_sets(split(b.column("text")), k)
            rows = [flat[a:z] for a, z in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            full = [s for s in rows if len(s)]
            yield pa.RecordBatch.from_arrays([pa.array([_class(s) for s in full], pa.int64()), pa.array([s.tobytes() for s in full], pa.binary())], ["class", "set"])

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_bytes(text_col).alias("text"))
    found = texts.mapInArrow(sets, "class long, set binary").join(wanted.select("class"), "class", "left_semi")
    found = scratch(found.dropDuplicates(["class"]), "paths-sets")
    blocks = F.greatest(F.ceil(F.col("n") / block), F.ceil(F.col("shingles") / shingles))
    rows = in_blocks(leaves, "class", blocks).drop("size", "n", "shingles").join(wanted.select("class", "buckets", "copies"), "class").join(found, "class")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for task in tasks(batches):
            if len(task["class"]) < 2:
                continue
            a, links, edges = verify(task, threshold)
            if a or edges:
                n, e = len(a), len(edges)
                yield pa.RecordBatch.from_arrays([pa.array(a + [x for x, _ in edges], pa.int64()), pa.array([None] * n + [y for _, y in edges], pa.int64()), pa.array(links + [None] * e, pa.int64())], ["a", "b", "links"])

    verified = scratch(dealt(rows).mapInArrow(check, "a long, b long, links long"), "paths-verified")
    links = verified.where("links is not null").groupBy(F.col("a").alias("class")).agg(F.sum("links").alias("links"))
    roots = scratch(components(verified.where("b is not null").select("a", "b"), "paths-edges"), "paths-roots")
    linked = copies.join(links, "class", "left").join(roots, copies["class"] == roots["id"], "left")
    linked = scratch(linked.select("class", "copies", "first", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "class").alias("root")), "paths-linked")
    least = scratch(linked.groupBy("root").agg(F.min("first").alias("class_id")), "paths-least")
    of = scratch(linked.join(least, "root").select("class", "class_id", (F.col("links") + F.col("copies") - 1).alias("n_links")), "paths-of")
    some = classes.select("row", "doc_id", "class").join(of, "class").select("row", "doc_id", "class_id", "n_links")
    none = sketched.where("class is null").select("row", "doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    out = some.unionByName(none)
    return out.select(F.col("doc_id").alias(id_col), "class_id", "n_links", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("kept"), F.col("row").alias("row_key"))
