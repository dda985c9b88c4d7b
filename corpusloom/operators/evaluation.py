"""Scores of corrections: edits, F0.5, M2, GLEU, error rates, agreement of raters, bootstrap intervals."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate, groupby
from os.path import commonprefix
from re import finditer

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.sources.writers import saved

SPAN = "array<struct<start:int,end:int,src:string,tgt:string,type:string>>"


def f_beta(p: Column, r: Column, beta: float = 0.5) -> Column:
    b = beta * beta
    return F.when(p + r == 0, 0.0).otherwise((1 + b) * p * r / (b * p + r))


def prf(tp: Column, fp: Column, fn: Column) -> list[Column]:
    p, r = F.when(tp + fp > 0, tp / (tp + fp)).otherwise(0.0), F.when(tp + fn > 0, tp / (tp + fn)).otherwise(0.0)
    return [p.alias("precision"), r.alias("recall"), f_beta(p, r).alias("f05")]


def edit_kind(a: str, b: str) -> str:
    """Of a changed word: morphological if half of the shorter word is a common prefix or suffix."""
    if not a or not b:
        return "insertion" if not a else "deletion"
    n = min(len(a), len(b))
    prefix = next((i for i in range(n) if a[i] != b[i]), n)
    suffix = next((i for i in range(n) if a[-1 - i] != b[-1 - i]), n)
    return "morphological" if max(prefix, suffix) / n >= 0.5 else "substitution"


#: Cells of operations()' table on either side of its diagonal, at first.
BAND = 8


def _letters(a: list[str], b: list[str], stems: bool, width: int) -> tuple[list[list[str]], list[int]] | None:
    """The letters of the cells at most `width` from the diagonal, row by row, and each row's first column; None where the way back may
    depend on cells outside.

    What is inserted or deleted up to a cell never grows on the way back, and grows by one at most to a neighbour it is compared with.
    Ways with up to `width` insertions and deletions stay in the band, so these cells are right if the last one has fewer.
    """
    whole = width >= max(len(a), len(b))
    if not whole and abs(len(a) - len(b)) > width:
        return None
    first, lengths, letters, least = 0, [0] * (min(len(b), width) + 1), [], []
    for i, x in enumerate(a, 1):
        low, high = max(1, i - width), min(len(b), i + width)
        # lengths[j - first] is the row above at column j; what lies outside counts as none at all.
        row, steps = [0 if low == 1 else -1], []
        for j in range(low, high + 1):
            y, left = b[j - 1], row[-1]
            before = lengths[j - 1 - first]
            above = lengths[j - first] if j - first < len(lengths) else -1
            if x == y:
                steps.append("K")
            elif stems and share_stem(x, y):
                steps.append("M")
            elif not stems and before >= above and before >= left:
                steps.append("S")
            else:
                steps.append("I" if left >= above else "D")
            row.append(before + 1 if x == y else max(above, left))
        first, lengths = low - 1, row
        letters.append(steps)
        least.append(low - 1)
    if not whole and len(a) + len(b) - 2 * lengths[len(b) - first] >= width:
        return None
    return letters, least


def operations(a: list[str], b: list[str], stems: bool = False) -> str:
    """How a becomes b, one letter a step: K keeps a word, S changes one, I inserts, D deletes; with stems, M is a change between words
    that share a stem, and there is no S.

    Each cell of the table of longest common subsequences has the letter by which it is left on the way back from the end. Of
    equal ways a change goes before an insertion (if the cell before both words is as good as both neighbours), an insertion
    before a deletion.
    """
    end = 0  # words that both end with are kept whatever is before them
    while end < min(len(a), len(b)) and a[-1 - end] == b[-1 - end]:
        end += 1
    a, b = a[: len(a) - end], b[: len(b) - end]
    width = BAND
    while (found := _letters(a, b, stems, width)) is None:
        width *= 4
    letters, least = found
    i, j, back = len(a), len(b), []
    while i and j:
        step = letters[i - 1][j - 1 - least[i - 1]]
        back.append(step)
        i, j = i - (step != "I"), j - (step != "D")
    return "I" * j + "D" * i + "".join(reversed(back)) + "K" * end


def _places(ops: str) -> tuple[list[int], list[int]]:
    """Words of the source and of the target before each step, and at the end."""
    return list(accumulate((o != "I" for o in ops), initial=0)), list(accumulate((o != "D" for o in ops), initial=0))


def share_stem(a: str, b: str) -> bool:
    n = min(len(a), len(b))
    return n > 0 and len(commonprefix((a, b))) >= n * 0.5


def span_edits(a: list[str], b: list[str], merge: bool = True) -> list[tuple[int, int, str, str, str]]:
    """(start, end, source words, target words, kind) of the steps that are no K; runs of one kind are one edit if merge."""
    ops = operations(a, b)
    src, tgt = _places(ops)
    kinds = ["" if o == "K" else edit_kind(a[src[k]] if o != "I" else "", b[tgt[k]] if o != "D" else "") for k, o in enumerate(ops)]
    out, at = [], 0
    for kind, run in groupby(kinds):
        n = len(list(run))
        for k, then in ([(at, at + n)] if merge else [(x, x + 1) for x in range(at, at + n)]) if kind else ():
            out.append((src[k], src[then], " ".join(a[src[k] : src[then]]), " ".join(b[tgt[k] : tgt[then]]), kind))
        at += n
    return out


def m2_edits(a: list[str], b: list[str], fixed: bool = False) -> set[tuple[int, int, str]]:
    """(start, end, correction): changes between words that share a stem, and each run of insertions and deletions.

    A run that begins with an insertion starts, and one without a deletion ends, where the last edited source word before it
    ends, or at 0, as scorers of this kind do; fixed=True places it where it is.
    """
    ops, out, edited = operations(a, b, stems=True), set(), 0
    src, tgt = _places(ops)
    for run in finditer("M|[ID]+", ops):
        k, then = run.span()
        start, stop = src[k], src[then]
        if not fixed and run[0] != "M":
            deleted = src[k + run[0].rfind("D") + 1] if "D" in run[0] else None
            start, stop = start if run[0][0] == "D" else edited, edited if deleted is None else deleted
        out.add((start, stop, " ".join(b[tgt[k] : tgt[then]])))
        edited = stop if run[0] != "I" * (then - k) else edited
    return out


def _by_pair(function, empty, *columns: pd.Series) -> list:
    """function of each row's token lists; equal rows are computed once, rows whose texts are equal are empty."""
    known: dict = {}
    out = []
    for texts in zip(*(c.fillna("") for c in columns), strict=True):
        if texts not in known:
            known[texts] = empty if len(set(texts)) == 1 else function(*(t.split() for t in texts))
        out.append(known[texts])
    return out


def _span_edits(source: pd.Series, target: pd.Series) -> pd.Series:
    return pd.Series(_by_pair(span_edits, [], source, target))


def _m2_edits(source: pd.Series, target: pd.Series) -> pd.Series:
    return pd.Series(_by_pair(lambda a, b: sorted(m2_edits(a, b)), [], source, target))


def _word_edits(a: list[str], b: list[str]) -> Counter:
    return Counter((e[2], e[3]) for e in span_edits(a, b, merge=False))


def _edit_counts(source: pd.Series, hypothesis: pd.Series, reference: pd.Series) -> pd.DataFrame:
    """Edits matched as multisets of (source word, target word)."""

    def counts(s: list[str], h: list[str], r: list[str]) -> tuple[int, int, int]:
        own, wanted = _word_edits(s, h), _word_edits(s, r)
        tp = (own & wanted).total()
        return tp, own.total() - tp, wanted.total() - tp

    return pd.DataFrame(_by_pair(counts, (0, 0, 0), source, hypothesis, reference), columns=["tp", "fp", "fn"])


def span_counts(s: list[str], h: list[str], r: list[str]) -> list[tuple[str, int, int, int]]:
    """(kind, tp, fp, fn): spans match on place and correction, copies one by one; hits and false ones count under the hypothesis'
    kind, misses under the reference's."""
    own, wanted, sums = ({}, {}, {})
    for where, edits in ((own, span_edits(s, h)), (wanted, span_edits(s, r))):
        for start, end, _, words, kind in edits:
            where.setdefault((start, end, words), []).append(kind)
    for place in own.keys() | wanted.keys():
        mine, theirs = own.get(place, []), wanted.get(place, [])
        hits = min(len(mine), len(theirs))
        for k, kinds in enumerate((mine[:hits], mine[hits:], theirs[hits:])):
            for kind in kinds:
                sums.setdefault(kind, [0, 0, 0])[k] += 1
    return [(kind, *n) for kind, n in sorted(sums.items())]


def typed_counts(source: list[str], hypothesis: list[str], reference: list[tuple[int, int, str, str]]) -> list[tuple[str, int, int, int]]:
    """(type, tp, fp, fn) of M2 edits against reference edits (start, end, correction, type). A false one counts under the type of the
    reference edit that is nearest by the distances of start and end, the first of equals; without one it is spurious."""
    own, kinds, sums = m2_edits(source, hypothesis), {}, Counter()
    for start, end, words, kind in reference:
        kinds.setdefault((start, end, words), kind)
    for e in own | kinds.keys():
        if e in kinds:
            sums[kinds[e], "tp" if e in own else "fn"] += 1
        else:
            near = min(reference, key=lambda x: abs(x[0] - e[0]) + abs(x[1] - e[1]), default=(0, 0, "", "spurious"))
            sums[near[3], "fp"] += 1
    return [(t, *(sums[t, c] for c in ("tp", "fp", "fn"))) for t in sorted({t for t, _ in sums})]


def span_edits_udf(*columns: str) -> Column:
    return F.pandas_udf(_span_edits, SPAN)(*columns)


def m2_edits_udf(*columns: str) -> Column:
    return F.pandas_udf(_m2_edits, "array<struct<start:int,end:int,correction:string>>")(*columns)


def edit_counts_udf(*columns: str) -> Column:
    return F.pandas_udf(_edit_counts, "struct<tp:int,fp:int,fn:int>")(*columns)


def edit_scores(pairs: DataFrame, *by: str) -> DataFrame:
    """tp, fp, fn, precision, recall, f05 of columns source, hypothesis, reference, in groups if asked for."""
    counts = pairs.select(*by, edit_counts_udf("source", "hypothesis", "reference").alias("c"))
    sums = counts.groupBy(*by).agg(*(F.coalesce(F.sum(f"c.{x}"), F.lit(0)).alias(x) for x in ("tp", "fp", "fn")))
    return sums.select(*by, "tp", "fp", "fn", *prf(F.col("tp"), F.col("fp"), F.col("fn")))


def m2_scores(pairs: DataFrame, *by: str) -> DataFrame:
    e = pairs.select(*by, m2_edits_udf("source", "hypothesis").alias("h"), m2_edits_udf("source", "reference").alias("r"))
    sums = e.groupBy(*by).agg(F.sum(F.size(F.array_intersect("h", "r"))).alias("tp"), F.sum(F.size(F.array_except("h", "r"))).alias("fp"), F.sum(F.size(F.array_except("r", "h"))).alias("fn"))
    return sums.select(*by, "tp", "fp", "fn", *prf(F.col("tp"), F.col("fp"), F.col("fn")))


_TYPED = "array<struct<type:string,tp:int,fp:int,fn:int>>"


def _summed(rows: DataFrame, column: Column) -> DataFrame:
    """type, tp, fp, fn and scores of arrays of typed counts."""
    sums = rows.select(F.inline(column)).groupBy("type").agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn")))
    return sums.select("type", "tp", "fp", "fn", *prf(F.col("tp"), F.col("fp"), F.col("fn")))


def span_scores(pairs: DataFrame) -> DataFrame:
    """type, tp, fp, fn and scores by kind of edit: see span_counts()."""

    def run(source: pd.Series, hypothesis: pd.Series, reference: pd.Series) -> pd.Series:
        return pd.Series(_by_pair(span_counts, [], source, hypothesis, reference))

    return _summed(pairs, F.pandas_udf(run, _TYPED)("source", "hypothesis", "reference"))


def m2_type_scores(pairs: DataFrame) -> DataFrame:
    """type, tp, fp, fn and scores of columns source, hypothesis, edits (as of parse_m2()) by the reference edits' types."""

    def run(source: pd.Series, hypothesis: pd.Series, edits: pd.Series) -> pd.Series:
        refs = [[(e["start"], e["end"], e["correction"], e["error_type"]) for e in x] for x in edits]
        return pd.Series([typed_counts((s or "").split(), (h or "").split(), r) for s, h, r in zip(source, hypothesis, refs, strict=True)])

    return _summed(pairs, F.pandas_udf(run, _TYPED)("source", "hypothesis", "edits"))


def m2_sentences(pairs: DataFrame, sent_id: Column, errors: str | None = None) -> DataFrame:
    """sent_id, source, edits of changed, non-blank pairs (source, target), all edits of the type of the first of column errors, or
    M:OTHER without one."""
    kind = F.coalesce(F.get(F.col(f"{errors}.type"), F.lit(0)) if errors else F.lit(None), F.lit("M:OTHER"))
    rows = pairs.where("trim(source) <> '' and trim(target) <> '' and source <> target").select(sent_id.alias("sent_id"), "source", kind.alias("_kind"), m2_edits_udf("source", "target").alias("_e"))
    edit = lambda kind: lambda e: F.struct(e["start"].alias("start"), e["end"].alias("end"), kind.alias("error_type"), e["correction"].alias("correction"), F.lit(0).alias("annotator"))
    return rows.select("sent_id", "source", F.transform("_e", edit(F.col("_kind"))).alias("edits"))


def sentence_scores(pairs: DataFrame, *key: str) -> DataFrame:
    """key, tp, fp, fn, precision, recall, f05 of each row."""
    counts = pairs.select(*key, edit_counts_udf("source", "hypothesis", "reference").alias("c")).select(*key, "c.*")
    return counts.select(*key, "tp", "fp", "fn", *prf(F.col("tp"), F.col("fp"), F.col("fn")))


def score_distribution(scores: DataFrame) -> DataFrame:
    """n, mean, least, most, zero, perfect of column f05."""
    return scores.agg(F.count("*").alias("n"), F.avg("f05").alias("mean"), F.min("f05").alias("least"), F.max("f05").alias("most"), F.count_if(F.col("f05") == 0).alias("zero"), F.count_if(F.col("f05") >= 1).alias("perfect"))


def hardest(scores: DataFrame, *order: str, n: int = 10) -> DataFrame:
    return scores.orderBy("f05", *order).limit(n)


def rater_pairs(ratings: DataFrame) -> DataFrame:
    """rater_a, rater_b, n, agreement, kappa (four digits) of all pairs of raters on what both rated. Of a rater's repeated ratings the
    last (column line_no) counts. One aggregation by pair of labels; marginals come from its few rows."""
    item = ["source", "corrected"]
    one = ratings.groupBy("rater_id", *item).agg(F.max_by("rating", "line_no").alias("rating"))
    a, b = one.withColumnsRenamed({"rater_id": "rater_a", "rating": "x"}), one.withColumnsRenamed({"rater_id": "rater_b", "rating": "y"})
    cells = a.join(b, item).where("rater_a < rater_b").groupBy("rater_a", "rater_b", "x", "y").agg(F.count("*").alias("c"))
    by = ["rater_a", "rater_b"]
    marginal = lambda k: F.sum("c").over(Window.partitionBy(*by, k))
    cells = cells.withColumns({"mx": marginal("x"), "my": marginal("y"), "n": F.sum("c").over(Window.partitionBy(*by))})
    rows, columns = cells.select(*by, F.col("x").alias("k"), "mx", "n").distinct(), cells.select(*by, F.col("y").alias("k"), "my").distinct()
    chance = rows.join(columns, [*by, "k"]).groupBy(*by).agg((F.sum(F.col("mx").cast("double") * F.col("my")) / F.first(F.col("n").cast("double") * F.col("n"))).alias("pe"))
    same = cells.groupBy(*by).agg(F.sum("c").alias("n"), (F.sum(F.when(F.col("x") == F.col("y"), F.col("c")).otherwise(0)) / F.sum("c")).alias("po"))
    out = same.join(chance, by, "left").withColumn("pe", F.coalesce("pe", F.lit(0.0)))
    return out.select(*by, "n", F.round("po", 4).alias("agreement"), F.round(F.when(F.col("pe") > 1 - 1e-10, 0.0).otherwise((F.col("po") - F.col("pe")) / (1 - F.col("pe"))), 4).alias("kappa"))


def _ends(a: list, b: list) -> tuple[int, int]:
    """How many items a and b begin with in common, and how many of the others they end with."""
    most = min(len(a), len(b))
    if a == b:
        return most, 0
    first = last = 0
    while first < most and a[first] == b[first]:
        first += 1
    while last < most - first and a[-1 - last] == b[-1 - last]:
        last += 1
    return first, last


def _grams(t: list, n: int, first: int, last: int) -> list[tuple]:
    """The n-grams of t that are not wholly in its first or in its last items."""
    return [tuple(t[i : i + n]) for i in range(max(first - n + 1, 0), min(len(t) - last, len(t) - n + 1))]


def _shared(a: list, b: list) -> int:
    """How many items two lists have in common, each as often as in both."""
    return (Counter(a) & Counter(b)).total() if a and b else 0


def _gleu(sources: pd.Series, hypotheses: pd.Series, references: pd.Series, most: int) -> pd.Series:
    """GLEU of each row's tokens. N-grams in what two texts begin and end with count the same in both, so only those around
    their differences are counted one by one."""
    out = []
    for s, h, r in zip(sources, hypotheses, references, strict=True):
        if h is None or r is None or not len(h) or not len(r):
            out.append(0.0)
            continue
        s, h, r = list(() if s is None else s), list(h), list(r)
        first, last = _ends(h, r)
        same = h == s
        if same and h == r:
            out.append(1.0)
            continue
        begin, end = (first, last) if same else _ends(s, r)
        logs, known = [], None if same else set(h)
        for n in range(1, min(most, len(h)) + 1):
            own = _grams(h, n, first, last)
            both = _shared(own, _grams(r, n, first, last)) if own else 0
            right = max(first - n + 1, 0) + max(last - n + 1, 0) + both
            if same:  # all that the source has beyond the reference
                wrong = len(own) - both
            else:
                lost = _grams(s, n, begin, end)
                wrong = 0
                if any(map(known.issuperset, lost)):
                    wrong = ((Counter(lost) - Counter(_grams(r, n, begin, end))) & Counter(_grams(h, n, 0, 0))).total()
            logs.append(math.log(min((max(right - wrong, 0) + 1) / (len(h) - n + 2), (right + 1) / (max(len(r) - n + 1, 0) + 1))))
        out.append((math.exp(1 - len(r) / len(h)) if len(h) < len(r) else 1.0) * math.exp(sum(logs) / len(logs)))
    return pd.Series(out, dtype="float64")


def sentence_gleu(df: DataFrame, *key: str, most: int = 4) -> DataFrame:
    """key, gleu of columns source, hypothesis, reference (arrays of tokens). N-grams are counted row by row, on Arrow batches, so nothing
    is shuffled; an empty or null hypothesis or reference gives 0."""

    def score(sources: pd.Series, hypotheses: pd.Series, references: pd.Series) -> pd.Series:
        return _gleu(sources, hypotheses, references, most)

    return df.select(*key, F.pandas_udf(score, "double")("source", "hypothesis", "reference").alias("gleu"))


#: Characters of texts whose distance a whole table gives; of longer ones, each so many allow an edit before the table is used.
SHORT, EDIT_EACH = 256, 32


def distance_within(a: str, b: str, bound: int) -> int:
    """Edit distance of a and b, -1 if it is above bound: how far each diagonal gets with so many edits, so equal stretches are compared as
    slices, not letter by letter."""
    m, n = len(a), len(b)

    def equal(i: int, j: int) -> int:
        at, size, most = 0, 32, min(m - i, n - j)
        while at < most and a[i + at : i + min(at + size, most)] == b[j + at : j + min(at + size, most)]:
            at, size = min(at + size, most), 2 * size
        while size > 1 and at < most:
            size //= 2
            if at + size <= most and a[i + at : i + at + size] == b[j + at : j + at + size]:
                at += size
        return at

    far = {0: equal(0, 0)}
    for edits in range(bound + 1):
        if far.get(n - m, -1) >= m:
            return edits
        reached = {}
        for k in range(max(-edits - 1, -m), min(edits + 1, n) + 1):
            i = min(max(far.get(k, -2) + 1, far.get(k - 1, -2), far.get(k + 1, -2) + 1), m, n - k)
            if i >= 0 and i + k >= 0:
                reached[k] = i + equal(i, i + k)
        far = reached
    return -1


def _near(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else distance_within(x, y, max(len(x), len(y)) // EDIT_EACH) for x, y in zip(a, b, strict=True)], dtype="Int64")


def edit_distance(a: Column, b: Column) -> Column:
    """As levenshtein(a, b); the time for a long text grows with its length and the square of its distance, where that is small."""
    long = F.greatest(F.length(a), F.length(b)) > SHORT
    near = F.pandas_udf(_near, "int")(F.when(long & (a != b), a), F.when(long & (a != b), b))
    return F.when(a == b, 0).when(long & (near >= 0), near).otherwise(F.levenshtein(a, b))


def char_error_rate(df: DataFrame) -> DataFrame:
    """cer (all edits / all reference characters), mean_cer (mean of sentences; an empty reference counts 0 or 1)."""
    d, n = edit_distance(F.col("hypothesis"), F.col("reference")), F.length("reference")
    each = F.when(n == 0, (F.length("hypothesis") > 0).cast("double")).otherwise(d / n)
    return df.agg((F.sum(d) / F.sum(F.greatest(n, F.lit(1)))).alias("cer"), F.avg(each).alias("mean_cer"))


def kappa(df: DataFrame, a: str, b: str) -> DataFrame:
    """n, agreement, kappa of two columns of labels; kappa is 0 without rows or where chance agreement is 1."""
    cells = df.groupBy(F.col(a).cast("string").alias("a"), F.col(b).cast("string").alias("b")).agg(F.count("*").alias("n"))
    rows, cols = cells.groupBy(F.col("a").alias("k")).agg(F.sum("n").alias("x")), cells.groupBy(F.col("b").alias("k")).agg(F.sum("n").alias("y"))
    chance = rows.join(cols, "k").agg(F.coalesce(F.sum(F.col("x").cast("double") * F.col("y")), F.lit(0.0)).alias("c"))
    total = cells.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.when(F.col("a") == F.col("b"), F.col("n"))), F.lit(0)).alias("same"))
    po, pe = F.col("same") / F.col("n"), F.col("c") / (F.col("n") * F.col("n").cast("double"))
    out = total.crossJoin(chance)  # one row each
    return out.select("n", F.when(F.col("n") > 0, po).otherwise(0.0).alias("agreement"), F.when((F.col("n") == 0) | (pe > 1 - 1e-10), 0.0).otherwise((po - pe) / (1 - pe)).alias("kappa"))


def bootstrap(counts: DataFrame, draws: int = 1000, seed: int = 42) -> DataFrame:
    """low, high: 95 % interval of F0.5 by resampling rows (i from 0 without gaps, tp, fp, fn), drawn by md5 of resample and draw."""
    counts = saved(counts)
    n = counts.count()
    draw = lambda at: F.expr(f"cast(id {at} {max(n, 1)} as long)")
    picks = counts.sparkSession.range(draws * n).select(draw("div").alias("b"), draw("%").alias("k"))
    hashed = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), "b", "k")), 1, 8), 16, 10).cast("long")
    # Rows are few bytes in files and many in a hash table, so they are not broadcast.
    drawn = picks.select("b", (hashed % n).alias("i")).hint("merge").join(counts.hint("merge"), "i")
    sums = drawn.groupBy("b").agg(*(F.sum(x).alias(x) for x in ("tp", "fp", "fn")))
    scores = sums.select(*prf(F.col("tp"), F.col("fp"), F.col("fn"))).select("f05", F.row_number().over(Window.orderBy("f05")).alias("rn"))
    return scores.agg(F.max(F.when(F.col("rn") == int(0.025 * draws) + 1, F.col("f05"))).alias("low"), F.max(F.when(F.col("rn") == int(0.975 * draws) + 1, F.col("f05"))).alias("high"))


def resampled(counts: DataFrame, columns: list[str], key: str, draws: int = 1000, seed: int = 42) -> DataFrame:
    """b, sums of columns: `draws` resamples of all rows. Each row is in a resample as often as a Poisson draw says, which depends on
    its key alone, so a task adds its rows to `draws` sums and no row is copied or shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((draws, len(columns)))
        bits = np.random.Philox(key=[seed, 0])
        generator, fresh = np.random.Generator(bits), bits.state
        for batch in batches:
            values = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in columns], axis=1).astype(float)
            some = values.any(axis=1)
            keys, values = batch.column(key).filter(pa.array(some)).to_pylist(), values[some]
            for at in range(0, len(keys), 256):
                part = keys[at : at + 256]
                weights = np.empty((len(part), draws))
                for row, k in zip(weights, part, strict=True):
                    # One generator begins anew for each key, as a list of both numbers makes it begin.
                    fresh["state"]["key"][:] = np.array([seed, k & 0xFFFFFFFFFFFFFFFF]).astype(np.uint64)
                    bits.state = fresh
                    row[:] = generator.poisson(1.0, draws)
                sums += weights.T @ values[at : at + 256]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(draws)), *(pa.array(x) for x in sums.T)], ["b", *columns])

    rows = counts.select(F.col(key).cast("long").alias(key), *columns).mapInArrow(run, "b long, " + ", ".join(f"{c} double" for c in columns))
    return rows.groupBy("b").agg(*(F.sum(c).alias(c) for c in columns))


def interval(counts: DataFrame, key: str, draws: int = 1000, seed: int = 42) -> DataFrame:
    """low, high: 95 % interval of F0.5 of rows key, tp, fp, fn, the sorted resamples' places 2.5 % and 97.5 %."""
    sums = resampled(counts, ["tp", "fp", "fn"], key, draws, seed)
    scores = sums.select(*prf(F.col("tp"), F.col("fp"), F.col("fn"))).select("f05", F.row_number().over(Window.orderBy("f05")).alias("rn"))  # one row a resample
    return scores.agg(F.max(F.when(F.col("rn") == int(0.025 * draws) + 1, F.col("f05"))).alias("low"), F.max(F.when(F.col("rn") == int(0.975 * draws) + 1, F.col("f05"))).alias("high"))


def paired_bootstrap(counts: DataFrame, key: str, draws: int = 1000, seed: int = 42) -> DataFrame:
    """delta (F0.5 of a less that of b), p: share of resamples in which a is not better. counts: key, a_tp, a_fp, a_fn, b_tp, ..."""
    names = [f"{x}_{c}" for x in "ab" for c in ("tp", "fp", "fn")]
    counts = saved(counts.select(key, *names))  # read for the sums and for the resamples

    def delta(rows: DataFrame) -> Column:
        a, b = (prf(*(F.col(f"{x}_{c}") for c in ("tp", "fp", "fn")))[2] for x in "ab")
        return (a - b).alias("delta")

    p = resampled(counts, names, key, draws, seed).select(delta(counts)).agg(F.avg((F.col("delta") <= 0).cast("double")).alias("p"))
    return counts.agg(*(F.sum(c).alias(c) for c in names)).select(delta(counts)).crossJoin(p)  # one row each


def majority_vote(df: DataFrame, key: str, candidate: str, pos: str) -> DataFrame:
    """key, winner: the most frequent candidate; of equals, the one that comes first."""
    counts = df.groupBy(key, candidate).agg(F.count("*").alias("n"), F.min(pos).alias("first"))
    return counts.groupBy(key).agg(F.max_by(candidate, F.struct("n", (-F.col("first")).alias("f"))).alias("winner"))


def best_score(df: DataFrame, key: str, candidate: str, score: str, pos: str) -> DataFrame:
    """key, best: the candidate of the highest score, of equals the first; where no score is above 0, the first of all. A null score is 0."""
    value = F.coalesce(F.col(score).cast("double"), F.lit(0.0))
    best = F.max_by(candidate, F.struct(value.alias("s"), (-F.col(pos)).alias("p")))
    return df.groupBy(key).agg(F.when(F.max(value) > 0, best).otherwise(F.min_by(candidate, pos)).alias("best"))
