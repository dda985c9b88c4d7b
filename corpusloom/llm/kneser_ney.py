"""Quality classifier: an interpolated modified Kneser-Ney n-gram model of characters, trained on trusted text.

Counts: every task counts the n-grams of its trusted texts; the sums, the continuation counts of all lower orders and the
context totals are aggregations sharded by n-gram. Probabilities: all distinct n-grams of all documents are joined, order by
order, with the count shards. Perplexity: documents sum the log probabilities of their n-grams. The most frequent ones, a fixed
number, are broadcast; the others are joined with the shards. A document is rejected if its perplexity is outside limits set, for each language, from quantiles
of trusted documents that were held out of the training.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import caches
from corpusloom.llm.common import pieces, scratch, text_or_empty
from corpusloom.llm.words import mix

ORDER, START = 5, "\x01"
#: N-grams of the broadcast table at most, and trusted ids above which they are shuffled and not broadcast.
TABLE_ROWS, BROADCAST_IDS = 1_000_000, 4_000_000
#: Of 16 hash classes of trusted documents, those that set the limits and are not trained on.
HELD_OUT = 4
#: Held-out documents at least for limits; and from how many on the quantiles lie inside their range, so that they are the limits as
#: they are: those of n fewer documents are widened by (1 - n / ENOUGH_HELD) of their distance from the median.
LEAST_HELD, ENOUGH_HELD = 20, 500
#: Quantiles of the held-out documents' log perplexity that are the limits.
LOW, HIGH = 0.002, 0.998
#: Bytes of text that are worked on at once: each character takes about 100 bytes.
PIECE = 500_000
_ODD, _BITS = np.uint64(0x9E3779B97F4A7C15), np.uint64(21)


class _Grams:
    """Of texts, each after order - 1 start marks: for the n-gram that ends at each character, its code points in two words of 21
    bits each (3 in low, the others in high) and their hash; and where the texts' n-grams begin (one more at the end)."""

    def __init__(self, texts: list[str], order: int):
        pad = START * (order - 1)
        points = np.frombuffer("".join([pad + t for t in texts]).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
        n = np.array([len(t) for t in texts], dtype=np.int64)
        self.at = np.concatenate([[0], np.cumsum(n)])
        first = np.repeat(np.arange(len(texts)) * (order - 1), n) + np.arange(int(self.at[-1]))
        high, low = np.zeros(max(len(points) - order + 1, 0), dtype=np.uint64), np.zeros(max(len(points) - order + 1, 0), dtype=np.uint64)
        for i in range(order):
            part = points[i : i + len(high)]
            if i < order - 3:
                high = high << _BITS | part
            else:
                low = low << _BITS | part
        self.high, self.low = high[first], low[first]
        self.hash = mix(self.high * _ODD ^ mix(self.low))


def _names(high: np.ndarray, low: np.ndarray, order: int) -> pa.Array:
    points = [(low if i < 3 else high) >> np.uint64(21 * (i if i < 3 else i - 3)) & np.uint64((1 << 21) - 1) for i in range(order)]
    text = np.stack(points[::-1], axis=1).astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
    return pa.array([text[i : i + order] for i in range(0, len(text), order)], pa.string())


class _Counts:
    """Counts of n-grams as sorted arrays: 32 bytes each."""

    def __init__(self, most: int):
        self.most, self.parts, self.size = most, [], 0

    def add(self, g: _Grams) -> bool:
        """Whether to take them: more than half of `most` are left when equal ones are merged."""
        h, first, n = np.unique(g.hash, return_index=True, return_counts=True)
        self.parts.append((h, n, g.high[first], g.low[first]))
        self.size += len(h)
        if self.size <= self.most:
            return False
        self._merge()
        return self.size > self.most // 2

    def _merge(self) -> None:
        h, n, high, low = (np.concatenate(c) for c in zip(*self.parts, strict=True))
        by = np.argsort(h, kind="stable")
        first = np.flatnonzero(np.diff(h[by], prepend=h[by[:1]] + np.uint64(1)))
        self.parts = [(h[by[first]], np.add.reduceat(n[by], first), high[by[first]], low[by[first]])] if len(by) else []
        self.size = len(first)

    def take(self, order: int) -> pa.RecordBatch | None:
        if not self.size:
            return None
        self._merge()
        _, n, high, low = self.parts[0]
        self.parts, self.size = [], 0
        return pa.RecordBatch.from_arrays([_names(high, low, order), pa.array(n, pa.int64())], ["gram", "n"])


def count_grams(texts: DataFrame, order: int, held: int = 1_000_000) -> DataFrame:
    """gram, n: counts of the n-grams of column text, combined in each task (at most `held` of them at a time)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        caches.only("")
        counts = _Counts(held)
        for b in pieces(batches, PIECE):
            if counts.add(_Grams(b.column("text").to_pylist(), order)):
                yield counts.take(order)
        if (rest := counts.take(order)) is not None:
            yield rest

    return texts.select(text_or_empty("text").alias("text")).mapInArrow(run, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def discounts(counts: DataFrame) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts of counts 1, 2 and 3 or more, from the counts of counts 1 to 4."""
    n1, n2, n3, n4 = (float(x or 0) for x in counts.agg(*(F.count_if(F.col("n") == i) for i in range(1, 5))).first())
    if not n1 or not n2:
        return 0.5, 0.5, 0.5
    y = n1 / (n1 + 2 * n2)
    d = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.5)
    return tuple(min(max(x, 0.1), k - 0.05) for x, k in zip(d, (1, 2, 3), strict=True))


def probabilities(counts: DataFrame, wanted: DataFrame, order: int) -> DataFrame:
    """gram, times, p: interpolated probability of the last character of each wanted gram (gram, times) after the others. counts:
    gram, n of trusted text."""
    by_order = {order: counts}
    for n in range(order - 1, 0, -1):  # continuation counts: how many characters precede the n-gram
        by_order[n] = scratch(by_order[n + 1].groupBy(F.expr(f"right(gram, {n})").alias("gram")).agg(F.count("*").alias("n")), f"lm-counts-{n}")
    letters = by_order[1].count() + 1
    p = None
    for n in range(1, order + 1):
        t = by_order[n]
        d1, d2, d3 = discounts(t)
        off = F.when(F.col("n") == 1, d1).when(F.col("n") == 2, d2).otherwise(d3)
        context = t.groupBy(F.expr(f"left(gram, {n - 1})").alias("context")).agg(F.sum("n").alias("total"), F.sum(off).alias("rest"))
        q = wanted.select(F.expr(f"right(gram, {n})").alias("gram")).distinct() if n < order else wanted
        q = q.withColumns({"context": F.expr(f"left(gram, {n - 1})"), "shorter": F.expr(f"right(gram, {n - 1})")})
        q = q.join(t.select("gram", F.greatest(F.col("n") - off, F.lit(0.0)).alias("own")), "gram", "left").join(context, "context", "left")
        lower = F.lit(1.0 / letters) if p is None else F.col("p")
        if p is not None:
            q = q.join(p.withColumnRenamed("gram", "shorter"), "shorter")
        times = [] if n < order else ["times"]
        p = q.select("gram", *times, F.when(F.col("total").isNull(), lower).otherwise((F.coalesce("own", F.lit(0.0)) + F.col("rest") * lower) / F.col("total")).alias("p"))
        p = scratch(p, f"lm-p-{n}")
    return p


class _Table:
    """Log probabilities by n-gram hash: one probe, then binary search for the few that share a slot."""

    def __init__(self, grams: list[str], logs: np.ndarray, order: int):
        h = np.zeros(0, dtype=np.uint64)
        if grams:
            points = np.frombuffer("".join(grams).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64).reshape(-1, order)
            high, low = np.zeros(len(points), dtype=np.uint64), np.zeros(len(points), dtype=np.uint64)
            for i in range(order):
                if i < order - 3:
                    high = high << _BITS | points[:, i]
                else:
                    low = low << _BITS | points[:, i]
            h = mix(high * _ODD ^ mix(low))
        by = np.argsort(h)
        self.keys, self.logs = h[by], logs[by].astype(np.float64)
        self.bits = max(4, int(len(h)).bit_length() + 2)

    def slots(self) -> None:
        if not hasattr(self, "slot"):
            self.slot = np.zeros(1 << self.bits, dtype=np.int32)
            self.slot[(self.keys >> np.uint64(64 - self.bits)).astype(np.int64)] = np.arange(len(self.keys), dtype=np.int32)

    def look_up(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The log probabilities, and which of them are known."""
        if not len(self.keys):
            return np.zeros(len(h)), np.zeros(len(h), dtype=bool)
        self.slots()
        i = self.slot[(h >> np.uint64(64 - self.bits)).astype(np.int64)]
        miss = np.flatnonzero(self.keys[i] != h)
        if len(miss):
            i[miss] = np.minimum(np.searchsorted(self.keys, h[miss]), len(self.keys) - 1)
        known = self.keys[i] == h
        return np.where(known, self.logs[i], 0.0), known


def score(docs: DataFrame, p: DataFrame, order: int, table_rows: int = TABLE_ROWS) -> DataFrame:
    """docs (row, doc_id, lang, text): row, doc_id, lang, n (characters), log (sum of the log probabilities); one row per row.

    The most frequent n-grams, at most table_rows of them however large the model is, are broadcast. Each document's other
    n-grams, counted in it, are joined with the shards of p, and their logarithms are summed by document. Documents are told
    apart by a number that the one pass over them gives, so that repeated rows don't fall together.
    """
    level = F.floor(F.log2("times") * 8).cast("int")
    least, rows = None, 0
    for r in sorted(p.groupBy(level.alias("level")).count().collect(), reverse=True):  # some 500 rows
        rows += r["count"]
        if rows > table_rows:
            break
        least = r["level"]
    often = level >= least if least is not None else F.lit(False)
    own = p.where(often).select("gram", "p").toArrow()  # at most table_rows rows
    table = docs.sparkSession.sparkContext.broadcast(_Table(own.column("gram").to_pylist(), np.log(own.column("p").to_numpy()), order))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        caches.only("")
        uid = TaskContext.get().partitionId() << 40
        for b in pieces(batches, PIECE):
            g = _Grams(b.column("text").to_pylist(), order)
            logs, known = table.value.look_up(g.hash)
            sums, d = np.concatenate([[0.0], np.cumsum(logs)]), len(g.at) - 1
            rare = np.flatnonzero(~known)
            own = np.searchsorted(g.at, rare, side="right") - 1
            by = np.lexsort((g.low[rare], g.high[rare], own))
            rare, own = rare[by], own[by]
            new = np.ones(len(rare), dtype=bool)
            new[1:] = (own[1:] != own[:-1]) | (g.high[rare[1:]] != g.high[rare[:-1]]) | (g.low[rare[1:]] != g.low[rare[:-1]])
            first = np.flatnonzero(new)
            times, k = np.diff(first, append=len(rare)), len(first)
            names = _names(g.high[rare[first]], g.low[rare[first]], order) if k else pa.array([], pa.string())
            nothing = pa.nulls(k, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(uid + np.concatenate([np.arange(d), own[first]])), pa.concat_arrays([b.column("row"), nothing]), pa.concat_arrays([b.column("doc_id"), nothing]), pa.concat_arrays([b.column("lang"), pa.nulls(k, pa.string())]),
                    pa.array(np.concatenate([np.diff(g.at), times])), pa.concat_arrays([pa.array(sums[g.at[1:]] - sums[g.at[:-1]]), pa.nulls(k, pa.float64())]), pa.concat_arrays([pa.nulls(d, pa.string()), names]),
                ],
                ["uid", "row", "doc_id", "lang", "n", "log", "gram"],
            )
            uid += d

    found = scratch(docs.mapInArrow(run, "uid long, row long, doc_id long, lang string, n long, log double, gram string"), "lm-found")
    rest = found.where("gram is not null").select("uid", "gram", "n").join(p.where(~often).select("gram", "p"), "gram")
    rest = rest.groupBy("uid").agg(F.sum(F.col("n") * F.log("p")).alias("more"))
    scored = found.where("gram is null").join(rest, "uid", "left")
    return scored.select("row", "doc_id", "lang", "n", (F.col("log") + F.coalesce("more", F.lit(0.0))).alias("log"))


def judge(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", order: int = ORDER, low: float = LOW, high: float = HIGH, table_rows: int = TABLE_ROWS) -> DataFrame:
    """One row per row of docs: id_col, lang, n_chars, perplexity, low_limit, high_limit, kept. trusted: doc_id of trusted documents.

    Limits are the quantiles `low` and `high` of the held-out trusted documents of the document's language. Where fewer than
    LEAST_HELD of its documents were held out, they are those of all languages, widened to the language's own where these reach
    further; with fewer than LEAST_HELD in all, there are none and all are kept. A null language has the limits of all.
    Documents without text have perplexity null and are kept. U+0001 in a text counts as a start mark. Repeated rows are judged
    alike. Null ids are not trusted. An empty table gives no rows; other columns are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("row"), F.col(lang_col).cast("string").alias("lang"), text_or_empty(text_col).alias("text"))
    trusted = scratch(trusted.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct(), "lm-trusted")
    held: Column = F.pmod(F.xxhash64("doc_id"), F.lit(16)) < HELD_OUT
    few = trusted.count() <= BROADCAST_IDS
    training = rows.join(F.broadcast(trusted.where(~held)) if few else trusted.where(~held), "doc_id", "left_semi")
    counts = scratch(count_grams(training, order), "lm-counts")
    wanted = scratch(count_grams(rows, order).withColumnRenamed("n", "times"), "lm-wanted")
    scores = scratch(score(rows, probabilities(counts, wanted, order), order, table_rows), "lm-scores")
    scores = scores.withColumn("log_ppl", F.when(F.col("n") > 0, -F.col("log") / F.col("n")))
    known = scores.join(trusted.where(held), "doc_id", "left_semi").where("log_ppl is not null")

    def limits(by: list[str]) -> DataFrame:
        q = known.groupBy(*by).agg(F.percentile_approx("log_ppl", [low, 0.5, high], 10_000).alias("q"), F.count("*").alias("held"))
        lo, mid, hi = (F.col("q")[i] for i in range(3))
        wider = F.greatest(1 - F.col("held") / ENOUGH_HELD, F.lit(0.0))
        return q.select(*by, "held", (lo - wider * (mid - lo)).alias("lo"), (hi + wider * (hi - mid)).alias("hi"))

    every = limits([]).first()  # one row
    lo, hi = (every.lo, every.hi) if every.held >= LEAST_HELD else (-math.inf, math.inf)
    found = scores.join(limits(["lang"]), "lang", "left")
    own = F.coalesce("held", F.lit(0)) >= LEAST_HELD
    found = found.withColumns({"lo": F.when(own, F.col("lo")).otherwise(F.least("lo", F.lit(lo))), "hi": F.when(own, F.col("hi")).otherwise(F.greatest("hi", F.lit(hi)))})
    kept = F.col("log_ppl").isNull() | F.col("log_ppl").between(F.col("lo"), F.col("hi"))
    return found.select(F.col("doc_id").alias(id_col), F.col("lang"), F.col("n").alias("n_chars"), F.exp("log_ppl").alias("perplexity"), F.exp("lo").alias("low_limit"), F.exp("hi").alias("high_limit"), kept.alias("kept"), F.col("row").alias("row_key"))
