"""Near-duplicate vectors by hierarchical navigable small-world graphs.

Equal vectors are one class. Classes are dealt to shards by hash; each shard builds a graph. Every class queries every shard,
in blocks: a beam search goes down the layers and is widened for each query until the beam holds something below the
threshold. The first width is the least at which audit queries, compared with all vectors by brute force, reach the target
recall; where none does, every block is compared with every shard exactly. Audit queries are drawn until true links are among
them. Pairs that the graphs propose are verified by cosine in double precision; linked classes make up components.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import components, scratch

THRESHOLD, RECALL, AUDITS = 0.95, 0.99, 512
#: Shards at least, rows of a shard and of a block of queries at most (on average).
SHARDS, SHARD_ROWS, BLOCK_ROWS = 6, 50_000, 65_536
#: Blocks of queries at least. A graph goes to every block, so that few large blocks move less than many small ones.
BLOCKS = 4
LINKS, BUILD_BEAM, BATCH = 16, 64, 128
WIDTHS = (32, 64, 128, 256, 512)
#: The widest beam: queries that need more are compared with the whole shard, in pieces of a fixed size.
WIDEST = 4096
#: Times as many vectors are audited where those audited have no link. Similarities that an exact comparison holds at once.
MORE_AUDITS, HELD = 8, 4_000_000


class Graph:
    """HNSW over unit vectors (rows). Built in batches: a batch searches the graph so far, and its own rows directly."""

    def __init__(self, vectors: np.ndarray, seed: int = 1):
        self.v = vectors.astype(np.float32)
        n = len(vectors)
        level = np.minimum((-np.log(1 - np.random.default_rng(seed).random(n)) / math.log(LINKS)).astype(int), 4)
        self.top, self.entry = -1, 0
        self.cap = [4 * LINKS] + [2 * LINKS] * 4
        self.near = [np.full((n, c), -1, dtype=np.int32) if l == 0 or (level >= l).any() else None for l, c in enumerate(self.cap)]
        self.used = [np.zeros(n, dtype=np.int32) for _ in self.cap]
        done = 0
        while done < n:
            size = min(BATCH, max(1, done // 4), n - done)
            self._insert(np.arange(done, done + size), level)
            done += size

    def __getstate__(self) -> dict:
        """What a search needs, small: the vectors are set again from those sent beside it, upper layers keep the rows that they have."""
        layers = [None if n is None else (rows := np.flatnonzero(n[:, 0] >= 0), n[rows]) for n in self.near]
        return {"n": len(self.v), "top": self.top, "entry": self.entry, "layers": layers}

    def __setstate__(self, state: dict) -> None:
        self.top, self.entry, self.near = state["top"], state["entry"], []
        for layer in state["layers"]:
            near = None
            if layer is not None:
                near = np.full((state["n"], layer[1].shape[1]), -1, dtype=np.int32)
                near[layer[0]] = layer[1]
            self.near.append(near)

    def _insert(self, new: np.ndarray, level: np.ndarray) -> None:
        q = self.v[new]
        within = q @ q.T
        at = np.full(len(new), self.entry)
        for l in range(max(self.top, int(level[new].max())), -1, -1):
            own = level[new] >= l
            ids, sims = self._beam(q, at, 1 if not own.any() else BUILD_BEAM, l) if l <= self.top else (np.full((len(new), 1), -1), np.full((len(new), 1), -np.inf, dtype=np.float32))
            if l <= self.top:
                at = ids[:, 0]
            for k in np.flatnonzero(own):
                mates = np.flatnonzero(own[:k])
                c, s = np.concatenate([ids[k][ids[k] >= 0], new[mates]]), np.concatenate([sims[k][ids[k] >= 0], within[k, mates]])
                for other in (chosen := self._choose(c, s, LINKS)):
                    self._link(l, other, new[k])
                self.near[l][new[k], : len(chosen)] = chosen
                self.used[l][new[k]] = len(chosen)
        best = int(new[np.argmax(level[new])])
        if level[best] > self.top:
            self.top, self.entry = int(level[best]), best

    def _choose(self, ids: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
        """Neighbours in different directions: one is taken unless a nearer one that was taken is nearer to it."""
        by = np.argsort(-sims, kind="stable")[: 4 * LINKS]
        ids, sims = ids[by], sims[by]
        x = self.v[ids]
        between = x @ x.T
        taken: list[int] = []
        worst = np.full(len(ids), -np.inf, dtype=np.float32)
        for i in range(len(ids)):
            if worst[i] < sims[i]:
                taken.append(i)
                if len(taken) == most:
                    break
                np.maximum(worst, between[i], out=worst)
        if len(taken) < most:  # the nearest of the others fill up
            taken += [i for i in range(len(ids)) if i not in set(taken)][: most - len(taken)]
        return ids[sorted(taken)]

    def _link(self, l: int, a: int, b: int) -> None:
        near, used = self.near[l], self.used[l]
        if used[a] == near.shape[1]:
            c = near[a]
            kept = self._choose(c, self.v[c] @ self.v[a], near.shape[1] // 2)
            near[a] = -1
            near[a, : len(kept)] = kept
            used[a] = len(kept)
        near[a, used[a]] = b
        used[a] += 1

    def _beam(self, q: np.ndarray, at: np.ndarray, width: int, l: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, similarities) of the best `width` rows found for each query, best first; -1 where there are fewer."""
        m, near, rows = len(q), self.near[l], np.arange(len(q))
        seen = np.zeros((m, len(self.v)), dtype=bool)
        ids, sims, open_ = np.full((m, width), -1), np.full((m, width), -np.inf, dtype=np.float32), np.zeros((m, width), dtype=bool)
        ids[:, 0], sims[:, 0], open_[:, 0] = at, np.einsum("qd,qd->q", q, self.v[at]), True
        seen[rows, at] = True
        while True:
            score = np.where(open_, sims, -np.inf)
            best = score.argmax(axis=1)
            act = np.flatnonzero(score[rows, best] > -np.inf)
            if not len(act):
                break
            open_[act, best[act]] = False
            c = near[ids[act, best[act]]]
            c = c[:, : max(1, int((c >= 0).sum(axis=1).max()))]
            fresh = (c >= 0) & ~seen[act[:, None], c]
            seen[act[:, None], c] |= fresh
            s = np.where(fresh, np.einsum("qd,qkd->qk", q[act], self.v[c]), -np.inf)
            all_s, all_i, all_o = np.concatenate([sims[act], s], axis=1), np.concatenate([ids[act], c], axis=1), np.concatenate([open_[act], fresh], axis=1)
            top = np.argpartition(-all_s, width - 1, axis=1)[:, :width]
            sims[act], ids[act], open_[act] = np.take_along_axis(all_s, top, 1), np.take_along_axis(all_i, top, 1), np.take_along_axis(all_o, top, 1)
        by = np.argsort(-sims, axis=1, kind="stable")
        sims, ids = np.take_along_axis(sims, by, 1), np.take_along_axis(ids, by, 1)
        return np.where(sims > -np.inf, ids, -1), sims

    def search(self, q: np.ndarray, threshold: float, width: int) -> Iterator[tuple[int, np.ndarray]]:
        """For each query, its number and the rows that may be at least threshold similar: the beam is widened until it holds less similar ones."""
        q = q.astype(np.float32)
        for start in range(0, len(q), BATCH):
            todo = np.arange(start, min(start + BATCH, len(q)))
            at = np.full(len(todo), self.entry)
            for l in range(self.top, 0, -1):
                at = self._beam(q[todo], at, 1, l)[0][:, 0]
            w = width
            while len(todo):
                if w > WIDEST:
                    for k, found in exact(self.v, q[todo], threshold):
                        yield int(todo[k]), found
                    break
                ids, sims = self._beam(q[todo], at, w, 0)
                full = (sims[:, -1] >= threshold - 1e-4) & (w < len(self.v))
                for k in np.flatnonzero(~full):
                    yield int(todo[k]), ids[k][(ids[k] >= 0) & (sims[k] >= threshold - 1e-4)]
                todo, at, w = todo[full], ids[full, 0], 2 * w


def exact(units: np.ndarray, q: np.ndarray, threshold: float) -> Iterator[tuple[int, np.ndarray]]:
    """As Graph.search(), without a graph: for each query, its number and all rows that may be at least threshold similar."""
    step = max(1, HELD // len(units))
    for start in range(0, len(q), step):
        near = q[start : start + step] @ units.T >= threshold - 1e-4
        for k in range(len(near)):
            yield start + k, np.flatnonzero(near[k])


def _units(b: pa.RecordBatch) -> tuple[list, list, list]:
    """class, unit vector (doubles) and dimension of each row; nulls for vectors that link with nothing."""
    names, data, dims = [], [], []
    for v in b.column("v").to_pylist():
        x = None
        if v and all(e is not None and math.isfinite(e) for e in v) and any(v):
            x = np.array(v, dtype=np.float64)
            x = x / np.abs(x).max()
            x = (x / np.linalg.norm(x)).tobytes()
        names.append(None if x is None else int.from_bytes(xxhash.xxh3_128_digest(x)[:8], "little", signed=True))
        data.append(x)
        dims.append(None if x is None else len(x) // 8)
    return names, data, dims


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD, recall: float = RECALL, shards: int = SHARDS) -> DataFrame:
    """One row per row of vectors: id_col, n_links (other rows with cosine of at least threshold), component_id (least id
    reachable by links, itself included), kept (id_col = component_id).

    Vectors that are null, empty or zero, or hold null, NaN or infinite components, link with nothing; neither do vectors of
    different dimensions with each other. Rows that repeat an id are rows of their own. Null ids are least only among null
    ids. An empty table gives no rows; other columns are not read.
    """

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, data, dims = _units(b)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(names, pa.int64()), pa.array(data, pa.binary()), pa.array(dims, pa.int32())], ["id", "class", "unit", "dim"])

    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = scratch(rows.mapInArrow(clean, "id long, class long, unit binary, dim int"), "vectors")
    valid = rows.where("class is not null")
    copies = scratch(valid.groupBy("class").agg(F.count("*").alias("copies"), F.min("id").alias("first")), "vectors-copies")
    classes = scratch(valid.select("class", "unit", "dim").dropDuplicates(["class"]).join(copies.select("class", "copies"), "class"), "vectors-classes")
    n = classes.count()
    shards = max(shards, -(-n // SHARD_ROWS))

    def build(key: tuple, t: pa.Table) -> pa.Table:
        units = np.frombuffer(b"".join(t.column("unit").to_pylist()), dtype=np.float64).reshape(t.num_rows, -1)
        data = pickle.dumps((Graph(units), units, t.column("class").to_numpy(), t.column("copies").to_numpy()), protocol=5)
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int64()), "graph": pa.array([data], pa.large_binary()).cast(pa.binary())})

    sharded = classes.withColumn("shard", F.col("dim") * F.lit(shards).cast("long") + F.pmod("class", F.lit(shards)))
    graphs = scratch(sharded.groupBy("shard").applyInArrow(build, "shard long, graph binary"), "vectors-graphs")

    def queried(asking: DataFrame, width: int | None, rows: int, least: int = 1) -> DataFrame:
        """a, b, copies_a, copies_b of verified links, in both directions as they were found; width None: of all links. rows: about
        how many ask, in blocks, of which there are `least` at least."""
        blocks = max(least, -(-rows // BLOCK_ROWS))

        def look(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
            out: list[list] = [[], [], [], []]
            if left.num_rows and right.num_rows:
                graph, units, names, copies = pickle.loads(right.column("graph")[0].as_py())
                graph.v = units.astype(np.float32)
                q = np.frombuffer(b"".join(left.column("unit").to_pylist()), dtype=np.float64).reshape(left.num_rows, -1)
                own, own_copies = left.column("class").to_numpy(), left.column("copies").to_numpy()
                for k, found in exact(units, q, threshold) if width is None else graph.search(q, threshold, width):
                    found = found[(units[found] @ q[k] >= threshold) & (names[found] != own[k])]
                    for c, v in zip(out, (np.full(len(found), own[k]), names[found], np.full(len(found), own_copies[k]), copies[found]), strict=True):
                        c.append(v)
            return pa.table({c: pa.array(np.concatenate(v) if v else [], pa.int64()) for c, v in zip(("a", "b", "copies_a", "copies_b"), out, strict=True)})

        at = asking.withColumn("block", F.pmod(F.xxhash64("class"), F.lit(blocks)))
        at = at.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).withColumn("shard", F.col("dim") * F.lit(shards).cast("long") + F.col("shard"))
        to = graphs.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
        return at.groupBy("shard", "block").cogroup(to.groupBy("shard", "block")).applyInArrow(look, "a long, b long, copies_a long, copies_b long")

    audits = scratch(classes.orderBy(F.xxhash64("class", F.lit(7))).limit(AUDITS), "vectors-audits")  # bounded
    probes = [(r["class"], r["dim"], bytes(r["unit"])) for r in audits.select("class", "dim", "unit").collect()]

    def brute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_dim = {d: ([c for c, e, _ in probes if e == d], np.array([np.frombuffer(u) for _, e, u in probes if e == d])) for d in {d for _, d, _ in probes}}
        for b in batches:
            a, o = [], []
            names, dims, units = b.column("class").to_pylist(), b.column("dim").to_pylist(), b.column("unit").to_pylist()
            for d in by_dim.keys() & set(dims):
                use = [i for i, e in enumerate(dims) if e == d]
                x, y = np.nonzero(by_dim[d][1] @ np.array([np.frombuffer(units[i]) for i in use]).T >= threshold)
                for i, j in zip(x.tolist(), y.tolist(), strict=True):
                    if by_dim[d][0][i] != names[use[j]]:
                        a.append(by_dim[d][0][i])
                        o.append(names[use[j]])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(o, pa.int64())], ["a", "b"])

    true = scratch(classes.select("class", "dim", "unit").mapInArrow(brute, "a long, b long"), "vectors-true")
    n_true, drawn = true.count(), min(AUDITS, n)
    while not n_true and drawn < n:  # at the end all vectors are drawn: then nothing links
        drawn = min(MORE_AUDITS * drawn, n)
        audits = classes.where(F.pmod(F.xxhash64("class", F.lit(7)), F.lit(1 << 30)) < -(-(drawn << 30) // n))
        true = scratch(queried(audits, None, drawn, BLOCKS).select("a", "b").distinct(), "vectors-true")
        n_true = true.count()
    width: int | None = None
    for w in WIDTHS:
        if not n_true or queried(audits, w, drawn).select("a", "b").distinct().join(true, ["a", "b"], "left_semi").count() >= recall * n_true:
            width = w
            break

    found = queried(classes, width, n, BLOCKS)
    found = found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.when(F.col("a") < F.col("b"), F.col("copies_a")).otherwise(F.col("copies_b")).alias("copies_a"), F.when(F.col("a") < F.col("b"), F.col("copies_b")).otherwise(F.col("copies_a")).alias("copies_b"))
    pairs = scratch(found.distinct(), "vectors-pairs")
    links = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("class"), F.col("copies_b").alias("n")), F.struct(F.col("b").alias("class"), F.col("copies_a").alias("n")))).alias("x")).groupBy("x.class").agg(F.sum("x.n").alias("links"))
    roots = scratch(components(pairs.select("a", "b"), "vectors-edges"), "vectors-roots")
    linked = copies.join(links, "class", "left").join(roots, copies["class"] == roots["id"], "left")
    linked = scratch(linked.select("class", "copies", "first", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "class").alias("root")), "vectors-linked")
    least = scratch(linked.groupBy("root").agg(F.min("first").alias("component_id")), "vectors-least")
    of = scratch(linked.join(least, "root").select("class", "component_id", (F.col("links") + F.col("copies") - 1).alias("n_links")), "vectors-of")
    some = valid.select("id", "class").join(of, "class").select("id", "n_links", "component_id")
    none = rows.where("class is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = some.unionByName(none)
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
