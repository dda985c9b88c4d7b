"""Errors of word order and connectors, by hand and by their annotations."""

import pytest
from pyspark.sql import functions as F

from corpusloom.operators.errors import GENERATORS
from corpusloom.operators.sentence_errors import CLOSERS, OPENERS, connectors, word_order

ORDER = ["من نان دەخۆم", "من  نان دەخۆم", "ئەو زۆر جوان هات", "یەک دوو", "", None, "a  b c d e"]
LINKS = ["ئەگەرچی هات کەچی ڕۆیشت", "هات بەڵام ڕۆیشت", "لەگەڵ ئەوەشدا هات", "بەڵام بەڵام", "هاتبەڵام", "", None]


def run(spark, texts, f, rate):
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, s string")
    got = rows.withColumn("e", f(F.col("s"), F.col("k").cast("string"), rate)).select("k", "e.*").orderBy("k").collect()
    return [(r.corrupted, r.errors) for r in got]


def applied(text, errors):
    for e in sorted(errors, key=lambda e: -e.start):
        assert text[e.start : e.end] == e.original
        text = text[: e.start] + e.error + text[e.end :]
    return text


@pytest.mark.parametrize(("f", "texts"), [(word_order, ORDER), (connectors, LINKS)])
def test_annotations_give_the_text(spark, f, texts):
    for rate in (0.0, 0.5, 1.0):
        for text, (corrupted, errors) in zip(texts, run(spark, texts, f, rate), strict=True):
            if not text:
                assert corrupted == text and not errors
            elif rate == 0.0 and not (f is connectors and text == LINKS[0]):
                assert corrupted == text and not errors
            else:
                assert " ".join(applied(text, errors).split()) == " ".join(corrupted.split())


def test_word_order(spark):
    got = [c for c, _ in run(spark, ORDER, word_order, 1.0)]
    assert got[:2] == ["من دەخۆم نان"] * 2
    assert got[2] in {"زۆر ئەو جوان هات", "ئەو جوان زۆر هات"} and got[3] == "یەک دوو"
    assert got[6] in {"b a c d e", "a  c b d e", "a  b d c e"}


def test_connectors(spark):
    got = run(spark, LINKS, connectors, 1.0)
    assert [len(e or []) for _, e in got] == [2, 1, 1, 2, 0, 0, 0]
    for _, errors in got:
        assert all(e.error == "" or (e.error in CLOSERS) == (e.original in OPENERS) for e in errors or [])


@pytest.mark.parametrize(("word", "want"), [
    ("نادەچم", ["دەناچم"]), ("نەبوو", ["بنەوو"]), ("دەچمەوە", ["دەەوەچم", "دەوەچم"]), ("کردنەوە", ["کردەوەن"]), ("ئاوەوە", []), ("ەوە", []), ("کتێب", []), ("", []),
])
def test_morpheme_order(spark, word, want):
    rows = spark.createDataFrame([(word,)], "w string")
    assert rows.select(GENERATORS["morpheme_order"](F.col("w")).alias("f")).first().f == want
