"""Normalization, tokens and filters on fixed examples."""

import random

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import filters as S
from corpusloom.functions import text as T
from corpusloom.operators import dedup as D
from corpusloom.operators.evaluation import edit_kind, m2_edits, span_edits


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "s string").select(f(F.col("s")).alias("x")).first().x


@pytest.mark.parametrize(("f", "text", "want"), [
    (T.normalize, "کوردستان   زۆر   جوانە", "کوردستان زۆر جوانە"), (T.map_chars, "2026", "۲۰۲۶"), (T.map_chars, "٢٠٢٦", "۲۰۲۶"), (T.fold_heh, "هه هه", "هە هە"), (T.fold_heh, "ههه", "هەە"),
    (T.tokens, "وئەو", ["و", "ئەو"]), (T.words, "سڵاو، چۆنی؟", ["سڵاو،", "چۆنی؟"]), (T.words, "", []), (T.sentences, "ئەمە وشەیەکە. ئەمەش وشەیەکی تر. سێیەمیش ئەمەیە.", ["ئەمە وشەیەکە.", "ئەمەش وشەیەکی تر.", "سێیەمیش ئەمەیە."]),
    (T.strip_parentheticals, "a (b)(c). d", "a . d"), (T.punctuation, "سڵاو ,جیهان...", "سڵاو، جیهان…"), (S.repetition, "ههههههههههههه", True), (S.non_prose, "123 456 789 012 345 678", True), (S.formula, "ڕستە ← ڕستەی هەواڵیی", True),
    (S.script_ratio_passes, "This is English text with no Kurdish", False), (S.script_ratio_passes, "", False), (S.length_passes, "دوو وشە", False), (S.ocr_phrases, "Let's look at the ڕ and ڵ again", True),
    (S.infer_category, "morphology_thesis.txt", "linguistics"), (S.infer_category, "historical_kurdistan.txt", "history"), (S.infer_category, "random_file_12345.txt", "general"), (T.trigrams, "abcabc", ["abc", "bca", "cab"]),
])
def test_examples(spark, f, text, want):
    assert one(spark, text, f) == want


def test_join_tokens(spark):
    assert one(spark, "سڵاو ، جیهان", lambda s: T.join_tokens(T.words(s))) == "سڵاو، جیهان"


def test_edits():
    assert [(e[0], e[4]) for e in span_edits("من دەچین".split(), "من دەچم".split())] == [(1, "morphological")]
    assert edit_kind("کتێب", "قوتابخانە") == "substitution"
    assert m2_edits("من دەچم".split(), "من دەچین".split()) == {(1, 2, "دەچین")}
    assert m2_edits(["a"], ["a", "b"]) == {(0, 0, "b")} and m2_edits(["a"], ["a", "b"], fixed=True) == {(1, 1, "b")}


def test_near_pairs_and_greedy(spark):
    texts = ["the quick brown fox jumps over the lazy dog again and again today", "the quick brown fox jumps over the lazy dog again and again todax", "something else entirely that shares little with the rest", ""]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, s string")
    pairs = D.near_pairs(df, "id", "s")
    grams = [{t[i : i + 3] for i in range(len(t) - 2)} for t in texts]
    want = {(a, b) for a in range(4) for b in range(a + 1, 4) if grams[a] | grams[b] and len(grams[a] & grams[b]) >= 0.9 * len(grams[a] | grams[b])}
    assert {(r.a, r.b) for r in pairs.collect()} == want == {(0, 1)}
    assert {r.id for r in D.greedy_kept(df, "id", pairs).collect()} == {0, 2, 3}


@pytest.mark.parametrize("threshold", [0.5, 0.8, 0.9])
def test_near_pairs_are_all_pairs(spark, monkeypatch, threshold):
    """Sketches and few known frequent members lose no pair, and sets travel as longs."""
    monkeypatch.setattr(D, "FREQUENT_GRAMS", 5)
    r = random.Random(2)
    base = ["".join(r.choice("abcدە😀 ") for _ in range(r.randint(3, 120))) for _ in range(25)]
    texts = base + [t[:k] + "x" + t[k + 1 :] for t in base for k in (1, len(t) // 2)] + ["", "ab", None]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, s string")
    sets = [{t[i : i + 3] for t in [" ".join((x or "").split())] for i in range(len(t) - 2)} for x in texts]
    want = {(i, j) for j, y in enumerate(sets) for i, x in enumerate(sets[:j]) if x and y and len(x & y) / len(x | y) >= threshold}
    pairs = D.near_pairs(df, "id", "s", threshold)
    assert {(p.a, p.b) for p in pairs.collect()} == want and len(want) > 10
    assert "bit_count" in pairs._jdf.queryExecution().optimizedPlan().toString()
