"""Errors of noun phrases and clitics on golden phrases: what can become of each, and where."""

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import noun_errors as N

CASES = {
    "کتێبی باش": [(0, 9, {"کتێب باش", "کتێبەکەی باش", "کتێبیی باش", "کتێبی باشان"})], "کوڕی مامۆستا": [(0, 12, {"کوڕ مامۆستا", "کوڕەکەی مامۆستا", "کوڕیی مامۆستا"})], "ماڵی تۆ": [], "کتێبەکە": [(0, 7, {"کتێبەکان"})], "پیاوەکان هات": [(0, 8, {"پیاوەکە"})],
    "ئاوەکان": [], "ئاوەکە": [(0, 6, {"ئاوەکان"})], "ئەم کتێبە": [(0, 9, {"ئەم کتێبەکە", "ئەم کتێبێک", "ئەم کتێبیەکە"})], "ئەو پیاوەکە": [(4, 11, {"پیاوەکان"})], "قوتابییان": [(0, 9, {"قوتابیان"})], "ئاو": [(0, 3, {"ئاوان", "ئاوەکان"})],
    "هەولێر": [(0, 6, {f"هەولێر{x}" for x in N.NOT_PROPER})], "کتێبی کوڕی گەورە": [(0, 10, {"کتێب کوڕی", "کتێبەکەی کوڕی", "کتێبیی کوڕی"})], "ی باش": [], "باش": [], "": [], "کتێبی": [],
}


@pytest.mark.parametrize("rate", [1.0, 0.0])
def test_phrases(spark, rate):
    rows = spark.createDataFrame([(i, s, k) for i, s in enumerate(CASES) for k in range(40)], "i long, s string, k int")
    seen = {}
    for r in rows.select("i", "s", N.noun_adjective(F.col("s"), F.concat_ws(":", "i", "k"), rate).alias("e")).collect():
        assert len(r.e.errors) == (len(CASES[r.s]) if rate else 0), r.s
        assert rate or r.e.corrupted == r.s
        for e in r.e.errors:
            assert r.s[e.start : e.end] == e.original and e.type == N.KIND and r.e.corrupted == (r.s[: e.start] + e.error + r.s[e.end :]).strip()
            seen.setdefault((r.s, e.start, e.end), set()).add(e.error)
    if rate:
        assert seen == {(s, a, b): forms for s, sites in CASES.items() for a, b, forms in sites}


CLITICS = {
    "کتێبمان": [(0, 7, {"کتێبتان", "کتێبیان", "کتێبم"})], "کتێبم باش": [(0, 5, {"کتێبت", "کتێبی", "کتێبمان"})], "کتێبی جوان": [], "کتێبی دەکە": [(0, 5, {"کتێبم", "کتێبت", "کتێبیان"})], "کتێبی": [(0, 5, {"کتێبم", "کتێبت", "کتێبیان"})], "کتێبەکەی باش": [(0, 8, {"کتێبەکەم", "کتێبەکەت", "کتێبەکەیان"})],
    "کتێبی ، باش": [(0, 5, {"کتێبم", "کتێبت", "کتێبیان"})], "خۆمان": [], "یەکتر": [], "امان": [], "من": [], "(کتێبت": [(1, 6, {"کتێبم", "کتێبی", "کتێبتان"})], "کتێبم.": [], "نووسیڕای": [(0, 8, {"نووسیڕاێت"})], "نووسیڕام": [(0, 8, {"نووسیڕات", "نووسیڕای", "نووسیڕامان"})], "": [],
}


def test_clitics(spark):
    rows = spark.createDataFrame([(i, s, k) for i, s in enumerate(CLITICS) for k in range(60)], "i long, s string, k int")
    seen = {}
    for r in rows.select("s", N.clitic_form(F.col("s"), F.concat_ws(":", "i", "k"), 1.0).alias("e")).collect():
        assert len(r.e.errors) == len(CLITICS[r.s]), r.s
        for e in r.e.errors:
            assert r.s[e.start : e.end] == e.original and e.type == N.CLITIC_KIND
            seen.setdefault((r.s, e.start, e.end), set()).add(e.error)
    assert seen == {(s, a, b): forms for s, sites in CLITICS.items() for a, b, forms in sites}


@pytest.mark.parametrize("errors", [N.noun_adjective, N.clitic_form])
def test_null(spark, errors):
    e = spark.createDataFrame([(None,)], "s string").select(errors(F.col("s"), F.lit("k")).alias("e")).first().e
    assert e is None or not e.errors
