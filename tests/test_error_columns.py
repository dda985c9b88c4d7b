"""Generators as column functions against the rules that the generation of corpora uses, on the same words and sentences."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import errors as E
from corpusloom.operators import generation as G
from corpusloom.operators.sentence_errors import whitespace

LETTERS = "احهعئغخوۆلڵرڕتطدضزژیێڤفەبک"


@pytest.fixture(scope="module")
def words():
    r = random.Random(8)
    return ["".join(r.choices(LETTERS, k=r.randint(1, 9))) for _ in range(400)] + ["وو", "ئی", "ی", "ههە", "ووۆ"]


@pytest.mark.parametrize(("kind", "scale"), [("orthography", 1), ("spelling_confusion", 2)])
def test_forms_and_weights(spark, words, kind, scale):
    rows = spark.createDataFrame([(w,) for w in words], "w string").select("w", E.GENERATORS[kind](F.col("w")).alias("f")).collect()
    rule = G._orthography if kind == "orthography" else G._spelling
    for r in rows:
        assert Counter(r.f) == {k: scale * v for k, v in rule(r.w).items()}, r.w


def _run(spark, texts, column):
    rows = spark.createDataFrame(list(enumerate(texts)), "i long, s string")
    return [r.e for r in rows.withColumn("e", column(F.col("s"), F.col("i").cast("string"))).orderBy("i").collect()]


@pytest.mark.parametrize("rate", [0.0, 0.4, 1.0])
def test_whitespace(spark, words, rate):
    """Errors are where they say, do not overlap, and give the text; at rate 1 no site is left that could be used."""
    r = random.Random(1)
    texts = ["", " ", "a", "  ab  cd ", *(" ".join(r.choices(words, k=r.randint(1, 12))) for _ in range(100))]
    for text, e in zip(texts, _run(spark, texts, lambda s, k: whitespace(s, k, rate)), strict=True):
        out, end = "", 0
        for x in e.errors:
            assert text[x.start : x.end] == x.original and x.start >= end
            assert x.error.replace(" ", "") == x.original.replace(" ", "") and (x.error.count(" ") == 1 or " " not in x.error)
            out, end = out + text[end : x.start] + x.error, x.end
        assert e.corrupted == (" ".join((out + text[end:]).split()) if e.errors else text)
        if rate == 1.0:
            taken = [False] * len(text)
            for x in e.errors:
                taken[x.start : x.end] = [True] * (x.end - x.start)
            left = [s for s in G.RULES["whitespace"](text) if s.forms and not any(taken[s.start : s.end])]
            assert not left
    assert rate or not any(e.errors for e in _run(spark, texts, lambda s, k: whitespace(s, k, 0.0)))


def test_marks(spark):
    texts = ["ئەو، بوو.", "a,b;c", "...", "", "no marks", "x ؟ y"]
    for text, e in zip(texts, _run(spark, texts, lambda s, k: E.inject(s, k, "punctuation", 1.0)), strict=True):
        sites = {s.start: set(s.forms) for s in G.RULES["punctuation"](text)}
        assert {x.start for x in e.errors} == set(sites) and all(x.error in sites[x.start] and text[x.start : x.end] == x.original for x in e.errors)
        assert e.errors or e.corrupted == text


def test_null_text(spark):
    rows = spark.createDataFrame([(None,)], "s string")
    for kind in E.GENERATORS:
        e = rows.select(E.inject(F.col("s"), F.lit("k"), kind).alias("e")).first().e
        assert e is None or not e.errors
    assert not rows.select(whitespace(F.col("s"), F.lit("k")).alias("e")).first().e.errors
