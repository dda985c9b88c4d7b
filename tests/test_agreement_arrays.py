"""Checks from arrays of blocks against those of relations."""

import random

import pytest
from test_agreement import CASES

from corpusloom.operators import agreement as A
from corpusloom.operators import agreement_arrays as B
from corpusloom.plans import agreement_queries as Q

WORDS = sorted({w for case in CASES for w in case.split()})


@pytest.fixture(scope="module")
def rows(spark):
    r = random.Random(5)
    long = [" ".join(r.choices(WORDS, k=r.randint(0, 30))) for _ in range(1500)] + [" ".join(r.choices(WORDS, k=3000)), ""]
    return spark.createDataFrame([*enumerate([*CASES, *long]), (99_999, None)], "id long, s string").repartition(3)


def test_checks(rows):
    got = {r.id: {c: r[c] for c in A.CHECKS if r[c]} for r in B.check_sentences(rows, "s", "id").collect()}
    assert {s: got[i] for i, s in enumerate(CASES)} == CASES and got[99_999] == {}


def test_checks_are_those_of_relations(spark, rows):
    known = spark.createDataFrame([(w,) for w in WORDS[::2]], "word string")
    listed = lambda df: {r.id: tuple(r[c] for c in A.CHECKS) for r in df.select("id", *A.CHECKS).collect()}
    made, relations = listed(B.check_sentences(rows, "s", "id", known=known)), listed(A.check_sentences(rows, "s", "id", known=known))
    assert made.keys() == relations.keys() and {k: (v, relations[k]) for k, v in made.items() if v != relations[k]} == {}
    assert all(any(v[n] for v in made.values()) for n in range(len(A.CHECKS)) if A.CHECKS[n] != "orthography")


def test_floor_counts_the_edits_of_long_sentences(spark, tmp_path):
    """A sentence of 200,000 letters takes no table of 200,000 x 200,000 edits."""
    docs = spark.createDataFrame([(1, "en", "web", "ab " * 70_000), (2, "en", "web", "x")], "doc_id long, lang string, source string, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    (r,) = Q.agreement_with_floor(spark, str(tmp_path)).collect()
    checked = {x.doc_id: sum(x[c] for c in A.CHECKS) == 0 for x in B.check_sentences(Q._rows(spark, str(tmp_path)), "s", *Q.KEY).collect()}
    assert r.accuracy == (checked[1]) / 2  # the phrase of the second is longer than half of it
