"""Agreement checks on golden sentences."""

import pytest

from corpusloom.operators import agreement as A

CASES = {
    "من دەچم": {}, "من دەچن": {"subject_verb": 1}, "ئەوان دەچێت": {"subject_verb": 1}, "من و ئەو دەچین": {"subject_verb": 1}, "ئەو دەچێت و ئێمە دەچین": {}, "من باش ، دەچن": {}, "ئەو ناچن": {"subject_verb": 1},
    "هیچ دەزانم": {"negative_concord": 1, "quantifier_noun": 1}, "هیچ نازانم": {"quantifier_noun": 1}, "هەرگیز دەچم": {"negative_concord": 1}, "هەرگیز ناچم": {},
    "ئەگەر دەچم دەبێت": {"conditional": 1}, "ئەگەر بچم دەبێت": {"conditional": 1}, "ئەگەر بچم ، دەبێت": {}, "ئەگەر دەچم ئەگەر دەبێت": {"conditional": 2},
    "هەموو منداڵ دەچێت": {"quantifier_noun": 1}, "هەموو منداڵ دەچن": {}, "ئەو کە دەچن": {"relative_clause": 1, "subject_verb": 1}, "پیاوەکان کە دەچم": {"relative_clause": 2}, "پیاوەکان کە دەچن": {}, "شت کە دەچم": {},
    "ئەی منداڵەکان بنووسە": {"vocative_imperative": 1, "ezafe": 1}, "ئەی منداڵەکان بنووسن": {"ezafe": 1}, "ئەی منداڵەکە بنووسن": {"vocative_imperative": 1, "ezafe": 1}, "منداڵەکان بنووسە": {},
    "دوێنێ دەچم": {"adverb_verb_tense": 1}, "دوێنێ کردم": {}, "ئێستا کردم": {"adverb_verb_tense": 1}, "ئێستا شت": {}, "من و تۆ دەچن": {"compound_subject": 1, "subject_verb": 2}, "من و تۆ دەچین": {"subject_verb": 2},
    "منداڵ دەچم": {"bare_noun": 1}, "ئەو منداڵ دەچم": {"subject_verb": 1}, "منداڵ و دەچم": {}, "منداڵ دەچێت": {}, "ئەو دەچێت و ئەو کردی": {}, "دەچێت زۆر و نامە بکرد و شت بەخشی": {}, "دەچێت زۆر و ناسی": {"tense_consistency": 1}, "دەچێت و ناسی": {}, "دەچێت زۆر و دەکات": {}, "": {}, "...": {},
    "ئەم کتێبەکە باشە": {"ezafe": 1}, "ئەم باشە": {}, "ئەم گەورە جوان کتێبێک": {"ezafe": 1}, "ئەم گەورە جوان باش کتێبێک": {}, "ئەم ، کتێبێک": {}, "ئەم کتێب ئەوە پیاوەکان": {"ezafe": 1}, "مامۆستای باش": {"ezafe": 1}, "کوڕی باش": {}, "ڕێی باش": {"ezafe": 1}, "ڕێی دەچم": {}, "ڕێی": {}, "دەریایی باش": {},
    "کتێبم قەڵەمت": {}, "چووم": {}, "چووم و بووم": {"clitic_consistency": 1}, "کتێبم باش": {}, "کتێبم دەچم": {}, "کتێبم خوێندم": {}, "کتێبەکەم قەڵەمەکەم": {}, "کتێبەکان بینیم": {"object_verb_ergative": 1}, "کتێبەکان بینین": {"object_verb_ergative": 1}, "کتێبەکە بینین": {"object_verb_ergative": 1},
    "من شت بینیم": {}, "من ، بینین": {}, "من تۆ بینیم": {"object_verb_ergative": 1}, "شت بینیم": {}, "کتێبەکان نەبینیم": {"object_verb_ergative": 1},
}


@pytest.fixture(scope="module")
def checked(spark):
    rows = spark.createDataFrame([(i, s) for i, s in enumerate([*CASES, None])], "id long, s string")
    return A.check_sentences(rows, "s", "id").cache()


def test_checks(checked):
    got = {r.id: {c: r[c] for c in A.CHECKS if r[c]} for r in checked.collect()}
    assert {s: got[i] for i, s in enumerate(CASES)} == CASES and got[len(CASES)] == {}


def test_sums(checked):
    checks = {r.check: r for r in A.by_check(checked).collect()}
    assert set(checks) == set(A.CHECKS) and checks["negative_concord"].correct == len(CASES) + 1 - 2
    laws = {r.law: r.total for r in A.by_law(A.by_check(checked)).collect()}
    assert laws == {"Law 1": len(CASES) + 1, "Law 2": len(CASES) + 1}
    (r,) = A.accuracy(checked).collect()
    assert r.n == len(CASES) + 1 and r.accuracy == pytest.approx((sum(not v for v in CASES.values()) + 1) / r.n)
    assert r.checks == 14


def test_spelling_needs_known_words(spark):
    """A token is misspelt if one letter that is confused makes it a known word."""
    rows = spark.createDataFrame([(0, "گەڵ ڕۆژ حەوت"), (1, "گەل ڕۆژ"), (2, "xyz"), (3, None)], "id long, s string")
    known = spark.createDataFrame([("گەل",), ("ڕۆژ",), ("هەوت",), ("هەوت",)], "word string")
    got = {r.id: r.orthography for r in A.check_sentences(rows, "s", "id", known=known).collect()}
    assert got == {0: 2, 1: 0, 2: 0, 3: 0}
    assert {r.orthography for r in A.check_sentences(rows, "s", "id").collect()} == {0}


def test_one_check_alone(spark, checked):
    """A check that is asked for alone counts as among all; those of words alone neither cut clauses nor look at distinct tokens."""
    rows = spark.createDataFrame([(i, s) for i, s in enumerate([*CASES, None])], "id long, s string")
    for check in ("ezafe", "clitic_consistency", "negative_concord", "tense_consistency"):
        alone = A.check_sentences(rows, "s", "id", checks=(check,))
        assert alone.columns == ["id", check]
        assert {r.id: r[check] for r in alone.collect()} == {r.id: r[check] for r in checked.collect()}
    plan = A.check_sentences(rows, "s", "id", checks=("ezafe",))._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "aggregate(" not in plan
    laws = A.check_sentences(rows, "s", "id", checks=tuple(A.LAWS))
    assert {(r.law, r.correct) for r in A.by_law(A.by_check(laws)).collect()} == {(r.law, r.correct) for r in A.by_law(A.by_check(checked)).collect()}
