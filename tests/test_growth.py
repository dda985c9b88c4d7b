"""Work that grows with the input: long sentences, far-off edits, many parameters."""

import math
import random
import re
import time
from collections import Counter

import pandas as pd
import pytest
from pyspark.sql import functions as F

from corpusloom.functions import profile as P
from corpusloom.functions.filters import detect
from corpusloom.operators import errors, noun_errors, sentence_errors
from corpusloom.operators import evaluation as E
from corpusloom.operators import generation as G
from corpusloom.operators import morphology as M
from corpusloom.operators import statistics as S
from corpusloom.operators.sampling import oversample
from corpusloom.sources import writers


def plain_distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def test_edit_distance_of_any_size(spark):
    r = random.Random(5)
    word = lambda n: "".join(r.choices("abc", k=n))
    pairs = [(word(r.randint(0, 40)), word(r.randint(0, 40))) for _ in range(200)] + [((w := word(300)), w[3:150] + word(20) + w[150:]) for _ in range(5)] + [("", ""), ("", "a"), (word(400), word(30)), (None, "a")]
    rows = spark.createDataFrame(pairs, "a string, b string").select("a", "b", E.edit_distance(F.col("a"), F.col("b")).alias("d")).collect()
    assert all(x.d == (None if x.a is None else plain_distance(x.a, x.b)) for x in rows)


def test_edit_distance_of_long_sentences(spark):
    text = "word " * 40_000  # 200,000 characters: a whole table has 4e10 cells
    row = spark.createDataFrame([("x" + text, text + "end")], "hypothesis string, reference string")
    began = time.time()
    assert E.char_error_rate(row).first().cer == pytest.approx(4 / (len(text) + 3))
    assert time.time() - began < 30


def whole_table(a: list, b: list, stems: bool) -> str:
    """Definition: letters of the whole table of longest common subsequences."""
    n = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            n[i][j] = n[i - 1][j - 1] + 1 if x == y else max(n[i - 1][j], n[i][j - 1])
    i, j, out = len(a), len(b), ""
    while i and j:
        x, y = a[i - 1], b[j - 1]
        change = E.share_stem(x, y) if stems else n[i - 1][j - 1] >= max(n[i - 1][j], n[i][j - 1])
        step = "K" if x == y else ("M" if stems else "S") if change else "I" if n[i][j - 1] >= n[i - 1][j] else "D"
        out += step
        i, j = i - (step != "I"), j - (step != "D")
    return "I" * j + "D" * i + out[::-1]


@pytest.mark.parametrize("band", [1, 2, 8])
def test_operations_do_not_depend_on_the_band(monkeypatch, band):
    monkeypatch.setattr(E, "BAND", band)
    r = random.Random(band)
    for _ in range(3000):
        words = r.choice(["a b", "a b c d", "ab abc abcd x y"]).split()
        a = r.choices(words, k=r.randint(0, 14))
        b = r.choices(words, k=r.randint(0, 14)) if r.random() < 0.5 else [w for w in a if r.random() < 0.85] + r.choices(words, k=2)
        for stems in (False, True):
            assert E.operations(a, b, stems) == whole_table(a, b, stems)


def test_operations_of_long_sentences():
    a = [f"w{i % 977}" for i in range(20_000)]
    began = time.time()
    assert E.operations(a, ["x", *a[1:-1]]) == "S" + "K" * 19_998 + "D"
    assert time.time() - began < 10


def test_grid_is_one_task(spark):
    assert S.grid(spark, {"a": [1, 2], "b": [0.1], "c": ["x", "y"], "d": [1]}).rdd.getNumPartitions() == 1


def test_long_sentences_change_their_order(spark):
    words = [f"w{i}" for i in range(20_000)]
    rows = spark.createDataFrame([(str(k), " ".join(words)) for k in range(3)], "key string, s string")
    for x in rows.select(sentence_errors.word_order(F.col("s"), F.col("key"), 1.0).alias("e")).collect():
        (e,) = x.e.errors
        at = int(e.original.split(" ")[0][1:])
        assert x.e.corrupted.split(" ") == [*words[:at], f"w{at + 1}", f"w{at}", *words[at + 2 :]]
        assert e.start == len(" ".join(words[:at])) + 1


@pytest.mark.parametrize("make", [lambda s, k: errors.inject(s, k, "orthography", 1.0), lambda s, k: sentence_errors.whitespace(s, k, 1.0), lambda s, k: noun_errors.noun_adjective(s, k, 1.0), lambda s, k: noun_errors.clitic_form(s, k, 1.0)])
def test_errors_of_long_sentences_in_their_places(spark, make):
    text = " ".join(["کتێبی باش", "کوڕەکە هات", "ئەم پیاوە", "کتێبمان", "حغع"] * 500)
    began = time.time()
    e = spark.createDataFrame([("1", text)], "key string, s string").select(make(F.col("s"), F.col("key")).alias("e")).first().e
    assert len(e.errors) > 1000
    assert all(text[x.start : x.end] == x.original for x in e.errors)
    assert time.time() - began < 40


def test_next_of_in_one_long_sentence(spark):
    rows = spark.range(150_000).select(F.lit(1).alias("k"), F.col("id").cast("int").alias("i"))
    began = time.time()
    found = rows.select("i", M.next_of(F.when(F.col("i") % 100_000 == 99_999, F.col("i")), "k").alias("n"))
    assert [tuple(x) for x in found.groupBy("n").agg(F.count("*").alias("c")).orderBy("n").collect()] == [(None, 50_001), (99_999, 99_999)]
    assert time.time() - began < 20


def test_large_tables_are_not_broadcast_for_their_small_files(spark):
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    rows = spark.range(writers.BROADCAST_ROWS + 1).selectExpr("id", "'ABCD' as x")
    large, small = writers.saved(rows), writers.saved(rows.limit(10))
    assert "Broadcast" in plan(rows.join(small, "id")) and "Broadcast" not in plan(rows.repartition(3).join(large, "id"))
    made = large.where("id >= 0").groupBy("id").agg(F.max("x").alias("y"))
    assert "Broadcast" not in plan(large.join(made, "id", "left")) and "Broadcast" in plan(large.join(F.broadcast(made), "id"))
    assert large.join(made, "id").count() == writers.BROADCAST_ROWS + 1 and writers.saved(rows.where("id < 0")).count() == 0


def gleu_by_definition(s: list, h: list, r: list, most: int = 4) -> float:
    logs = []
    for n in range(1, min(most, len(h)) + 1):
        gs, gh, gr = (Counter(zip(*(t[k:] for k in range(n)))) for t in (s, h, r))
        right = sum(min(c, gr[g]) for g, c in gh.items())
        wrong = sum(min(c, max(gs[g] - gr[g], 0)) for g, c in gh.items())
        logs.append(math.log(min((max(right - wrong, 0) + 1) / (len(h) - n + 2), (right + 1) / (max(len(r) - n + 1, 0) + 1))))
    return (math.exp(1 - len(r) / len(h)) if len(h) < len(r) else 1.0) * math.exp(sum(logs) / len(logs))


def test_gleu_counts_around_differences_only(monkeypatch):
    r, rows = random.Random(3), []
    text = lambda n: r.choices("abc", k=n)
    for _ in range(4000):
        a = text(r.randint(1, 9))
        b = [*a[: (k := r.randint(0, len(a)))], *text(r.randint(0, 2)), *a[k + r.randint(0, 2) :]]
        rows.append((r.choice([a, b, text(3), []]), r.choice([a, b]) or ["a"], a))
    got = E._gleu(*(pd.Series(list(c)) for c in zip(*rows, strict=True)), 4)
    assert got.tolist() == [gleu_by_definition(*x) for x in rows]
    counted = []
    monkeypatch.setattr(E, "_grams", lambda t, n, first, last, f=E._grams: counted.append(len(x := f(t, n, first, last))) or x)
    long = [str(i) for i in range(1000)]
    E._gleu(pd.Series([["x", *long]]), pd.Series([["x", *long]]), pd.Series([long]), 4)
    assert sum(counted) < 50


def test_rules_look_at_a_frequent_word_once(monkeypatch):
    seen = []
    rule = G._by_word(lambda w: seen.append(w) or {w + "x": 1.0})
    assert [s.start for s in rule("ab  cd ab\nab")] == [0, 4, 7, 10] and seen == ["ab", "cd"]
    calls = []
    monkeypatch.setattr(G, "_spans", lambda t, f=G._spans: calls.append(t) or f(t))
    monkeypatch.setitem(G.RULES, "punctuation", G._punctuation)
    monkeypatch.setattr(G, "_KINDS", ["punctuation"])
    monkeypatch.setattr(G, "_WEIGHTS", [1.0])
    assert G.corrupt("a . b . c .", "k", 1.0)[1] and not calls  # a rule on marks alone, and none behind it: no words


def test_words_have_their_places():
    for text in ("", " ", "a", "  ab a\tab b\n", "a‍b  b\x1cc"):
        assert G._spans(text) == [(m.start(), m.end(), m[0].replace("‍", "")) for m in re.finditer(r"\S+", text)]


def test_oversample_reads_once(spark):
    """Rows that are not among the first `target` are neither numbered nor computed again."""
    read = spark.sparkContext.accumulator(0)

    def seen(ids: pd.Series) -> pd.Series:
        read.add(len(ids))
        return ids

    rows = spark.range(5000).select(F.pandas_udf(seen, "long")("id").alias("id"))
    assert [(r.id, r.copy) for r in oversample(rows, 10, "id").orderBy("id").collect()] == [(i, 0) for i in range(10)]
    assert read.value == 5000


def test_language_of_long_words(spark):
    """A word is looked at once, not once for each of its letters."""
    row = spark.createDataFrame([("ا" * 300_000 + " دەچم",)], "s string")
    began = time.time()
    got = row.select(detect(F.col("s")).alias("d")).first().d
    assert got.morphology_score == 0.25 and time.time() - began < 20


def test_language_of_odd_texts(spark):
    """Against the same by regular expressions of Python, word for word."""
    r = random.Random(4)
    words = ["دەچم", "بی", "بیر", "ەکان", "کتێبەکان", "ێک", "کتێبێکی", "EZ", "hûn", "في", "را", "ڕۆژ", "\u200d", "بە\u200dx", "x"]
    texts = ["", " ", "\x1c", "\x85a\u3000"] + ["".join(r.choice(words) + r.choice([" ", "  ", "\n", "\u3000", "\x85", "\x1f", ""]) for _ in range(r.randint(1, 12))) for _ in range(300)]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, s string").select("i", detect(F.col("s")).alias("d")).collect()
    for i, d in got:
        t = texts[i].strip(P.WHITE)
        verbs = len(re.findall(r"(?:^|(?<=[ \t\n\x0b\f\r]))(?:دە|ئە|نا|بی?)[^ \t\n\x0b\f\r]{2,}", t))
        ends = lambda e: bool(re.search(rf"[^ \t\n\x0b\f\r](?:{e})(?=[ \t\n\x0b\f\r]|\Z)", t))  # noqa: B023, E731
        schwa = t.count("ە") / (len(t) - t.count(" ")) > 0.06 if t else False
        assert d.morphology_score == round(min(1, (0.4 if verbs > 1 else 0.25 * verbs) + 0.3 * ends("ەکە|ەکان") + 0.15 * ends("ێک|ێکی") + 0.15 * schwa), 4), t


def test_share_of_frequent_words(spark):
    """Frequent words, known or not, are judged in place: of 20,000 rows of them next to nothing is shuffled by word."""
    rows = spark.range(20_000).selectExpr("id", "case when id % 1000 = 0 then 'rare' || id when id = 7 then '' else 'often never often' end as s")
    known = spark.createDataFrame([("often",), ("rare3000",), ("often",)], "word string")
    got = S.invalid_share(rows, "s", known, "id")
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "INSET" in plan or " IN (" in plan or "= often" in plan
    by_id = {r.id: r.share for r in got.collect()}
    assert len(by_id) == 20_000 and by_id[1] == pytest.approx(1 / 3) and by_id[7] == 0 and by_id[3000] == 0 and by_id[2000] == 1


def test_bootstrap_broadcasts_no_rows(spark):
    """Resampled rows are merged: as a hash table they take far more memory in the driver than in files. Draws are not lists of all rows."""
    from corpusloom.operators import evaluation as E

    counts = spark.range(300).selectExpr("id as i", "cast(id % 3 = 0 as int) as tp", "0 as fp", "cast(id % 3 = 1 as int) as fn")
    out = E.bootstrap(counts, 20)
    (r,) = out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and "sequence(" not in plan and 0 < r.low < r.high < 1
    (none,) = E.bootstrap(counts.where("i < 0"), 20).collect()
    assert none.low is None and none.high is None


def test_paired_bootstrap_counts_edits_once(spark):
    """Counts are made once for the sums and the resamples; each key's draws are those of its own generator."""
    import numpy as np

    from corpusloom.operators import evaluation as E

    made = spark.sparkContext.accumulator(0)

    def count(k: int) -> int:
        made.add(1)
        return abs(k) % 3

    keys = [-5, -(2**63), 2**62 + 3, 7, 2**63 - 9, *range(100, 140)]
    counts = spark.createDataFrame([(k,) for k in keys], "k long").select("k", F.udf(count, "int")("k").alias("a_tp"), *(F.lit(n).alias(c) for n, c in enumerate(("a_fp", "a_fn", "b_tp", "b_fp", "b_fn"))))
    (r,) = E.paired_bootstrap(counts, "k", draws=50).collect()
    assert made.value == len(keys)
    w = np.array([np.random.Generator(np.random.Philox(key=[42, k & 0xFFFFFFFFFFFFFFFF])).poisson(1.0, 50) for k in keys])
    v = np.array([[abs(k) % 3, 0, 1, 2, 3, 4] for k in keys])
    f = lambda tp, fp, fn: 0.0 if not tp else 1.25 * (tp / (tp + fp)) * (tp / (tp + fn)) / (0.25 * tp / (tp + fp) + tp / (tp + fn))
    deltas = [f(*x[:3]) - f(*x[3:]) for x in (w.T @ v).tolist()]
    assert r.p == sum(d <= 0 for d in deltas) / 50
