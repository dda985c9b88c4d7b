"""Scores, swaps, and sentences of files, on small golden examples."""

from collections import Counter

from pyspark.sql import functions as F

from corpusloom.operators import augment
from corpusloom.operators import evaluation as E
from corpusloom.operators import flow as W
from corpusloom.sources import readers as R

GOOD = "ئەم ڕستەیە بۆ تاقیکردنەوەی پڕۆگرامەکەی من دەچێت ژمارە یەک."


def test_best_score(spark):
    rows = [(1, 0, "a", 0.5), (1, 1, "b", 0.9), (1, 2, "c", 0.9), (2, 1, "y", -1.0), (2, 0, "x", -2.0), (3, 0, "p", None), (3, 1, "q", 0.0), (4, 0, "m", None), (4, 1, "n", 0.1)]
    df = spark.createDataFrame(rows, "k long, p int, c string, s double")
    assert {r.k: r.best for r in E.best_score(df, "k", "c", "s", "p").collect()} == {1: "b", 2: "x", 3: "p", 4: "n"}


def test_swaps(spark):
    texts = ["a b c d e f", "a b", "a", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, s string")
    for n in (0, 1, 2, 5):
        got = {r.i: r.o for r in df.select("i", augment.random_swap(F.col("s"), F.col("i").cast("string"), swaps=n).alias("o")).collect()}
        assert Counter(got[0].split()) == Counter("abcdef") and got[2] == "a" and got[3] == "" and got[1] == ("b a" if n % 2 else "a b")
        moved = sum(x != y for x, y in zip(got[0].split(), "abcdef"))
        assert moved == {0: 0, 1: 2}.get(n, moved) and moved <= 2 * n


def test_language_counts(spark):
    df = spark.createDataFrame([(GOOD,), (GOOD * 20,), ("short",), (None,), ("This is English text of some length.",)], "s string")
    assert {r.reason: r.n for r in W.drop_reasons(W.language_filtered(df, "s")).collect()} == {"kept": 1, "length": 3, "not_sorani": 1}


def test_sentences_of_files(spark, tmp_path):
    (tmp_path / "law").mkdir()
    (tmp_path / "law" / "a.txt").write_text("One. Two!\nThree", encoding="utf-8")
    (tmp_path / "law" / "b.txt").write_text("", encoding="utf-8")
    assert sorted((r.category, r.pos, r.sentence) for r in R.read_sentences(spark, str(tmp_path)).collect()) == [("law", 0, "One."), ("law", 1, "Two!"), ("law", 2, "Three")]
    page = f"<page><title>T</title><revision><text>[[{GOOD}]] Short. {'x ' * 30}.</text></revision></page>"
    (tmp_path / "dump.xml").write_text(f"<mediawiki>{page}</mediawiki>", encoding="utf-8")
    assert [(r.title, r.pos, r.sentence) for r in R.wiki_sentences(spark, f"{tmp_path}/dump.xml").collect()] == [("T", 0, GOOD)]
    assert R.wiki_sentences(spark, f"{tmp_path}/dump.xml", language=False).count() == 2
