"""Rules for errors and the generation of corpora, on small golden examples."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import verb_profile as V
from corpusloom.operators import generation as G

FORMS = [
    ("subject_verb_number", "من دەچم", {(3, 7): {"دەچین"}}), ("subject_verb_number", "ئەو دەکات", {(4, 9): {"دەکن", "دەکەن"}}), ("subject_verb_number", "من نووسیم", {(3, 9): {"نووسیمان"}}),
    ("tense_agreement", "نەکرد", {(0, 5): {"نەکردم", "نەکردیت", "نەکردێت", "نەکردین", "نەکردن"}}), ("tense_agreement", "خوێندن", {}), ("tense_agreement", "دەچوو", {}),
    ("relative_clause_ezafe", "کتێبی کە", {(0, 8): {"کتێب", "کتێب کە"}}), ("relative_clause_ezafe", "پیاوەکەی دەچێت", {(0, 14): {"پیاوەکەی کە"}}),
    ("negative_concord", "هیچ کەس ناچێت", {(0, 3): {""}, (8, 13): {"دەچێت"}}), ("negative_concord", "هیچ ، ناچێت", {(0, 3): {""}}), ("negative_concord", "ئەو ناچێت", {}),
    ("vocative_imperative", "کوڕۆ بنووسە", {(5, 11): {"بنووسن"}}), ("vocative_imperative", "کوڕۆ بنووسن", {}), ("vocative_imperative", "کوڕینۆ بنووسن", {(7, 13): {"بنووسە"}}),
    ("conditional_agreement", "ئەگەر بچیت دەبینیت", {(6, 10): {"دەچیت"}}), ("conditional_agreement", "ئەگەر دەچیت، بچم", {(6, 11): {"بچیت"}}),
    ("adverb_verb_tense", "دوێنێ کردم", {(6, 10): {"دەکردم"}}), ("adverb_verb_tense", "ئێستا دەچم", {(6, 10): {"چم"}}), ("adverb_verb_tense", "کردم", {}),
    ("quantifier_agreement", "زۆر کەس هاتین", {(8, 13): {"هاتم"}}), ("quantifier_agreement", "کەس هاتین", {}),
    ("polite_imperative", "تکایە بنووسە", {(0, 6): {"", "فەرموو ", "بێ زەحمەت "}}), ("polite_imperative", "تکایە دەچم", {}),
    ("cross_clause_agreement", "هات و دەچێت", {(6, 11): {"چێت"}}), ("cross_clause_agreement", "چوو و کردی", {(6, 10): {"دەکردی"}}),
    ("orthography", "حوح", {(0, 3): {"هوه", "حووح", "حۆح"}}), ("orthography", "ئاو", {(0, 3): {"ئاوو", "یاو", "ئاۆ"}}), ("whitespace", "من تۆ", {(0, 5): {"منتۆ"}}), ("whitespace", "کتێبە", {(0, 5): {"کت ێبە", "کتێ بە"}}),
    ("punctuation", "ئەو، بوو.", {(3, 4): {",", ""}, (8, 9): {"،", ""}}), ("spelling_confusion", "لار", {(0, 3): {"ڵار", "لاڕ"}}), ("possessive_clitic", "کتێبمان", {(0, 7): {"کتێبتان", "کتێبیان", "کتێبم"}}),
]


@pytest.mark.parametrize(("kind", "text", "want"), FORMS)
def test_sites(kind, text, want):
    assert {(s.start, s.end): set(s.forms) for s in G.RULES[kind](text) if s.forms} == want


def test_rules_have_weights():
    assert set(G.RULES) <= set(V.GENERATOR_WEIGHTS) and set(V.GENERATOR_WEIGHTS) - set(G.RULES) == {"noun_adjective_agreement", "clitic_form"}


def test_errors_stand_where_they_say():
    for kind, text, _ in FORMS:
        for seed in range(5):
            out, errors = G.apply_rule(text, kind, random.Random(seed), 1.0)
            assert all(text[s:e] == original and k == kind for k, original, _, s, e in errors) and bool(errors) == (out != text)
            spans = sorted((s, e) for *_, s, e in errors)
            assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:], strict=False))


def test_skip_and_both_connectors():
    assert G.apply_rule("من دەچم", "subject_verb_number", random.Random(1), 1.0, [(3, 7)]) == ("من دەچم", [])
    out, errors = G.apply_rule("ئەگەرچی هات بەڵام نەما", "missing_adversative_connector", random.Random(3), 0.0)
    assert len(errors) == 2 and out != "ئەگەرچی هات بەڵام نەما"


def test_at_most_two_kinds():
    for i in range(200):
        out, errors = G.corrupt("من دەچم بۆ قوتابخانە و کتێبی کە کڕیم، ئەو زۆر باشە.", str(i), 0.5)
        assert len({e[0] for e in errors}) <= 2
        assert (out, errors) == G.corrupt("من دەچم بۆ قوتابخانە و کتێبی کە کڕیم، ئەو زۆر باشە.", str(i), 0.5)


@pytest.fixture(scope="module")
def sentences(spark):
    return spark.createDataFrame([(i, f"من دەچم بۆ ماڵی {i} و کتێبی کە کڕیم.", i % 3) for i in range(40)], "id long, s string, category int")


@pytest.mark.parametrize(("target", "ratio"), [(25, 0.6), (100, 0.7)])
def test_corpus(sentences, target, ratio):
    """Quotas are exact, also where sentences are repeated; other columns and the source go with each pair."""
    got = G.generate_corpus(sentences, "s", "id", target=target, ratio=ratio, rate=0.5).collect()
    own = {r.id: r for r in sentences.collect()}
    assert len(got) == target and sum(bool(r.errors) for r in got) == int(target * ratio)
    assert all(r.original == own[r.id].s and r.category == own[r.id].category and r.source_id.split(":")[0] == str(r.id) for r in got)
    assert all((r.corrupted != r.original) == bool(r.errors) for r in got)


def test_few_to_corrupt(spark):
    """A quota is filled from the one sentence that can be corrupted, and by repeating pairs where its errors are used up."""
    rows = spark.createDataFrame([(i, "x") for i in range(50)] + [(50, "من دەچم")], "id long, s string")
    got = G.generate_corpus(rows, "s", "id", target=1000, ratio=0.7).collect()
    assert Counter(bool(r.errors) for r in got) == {True: 700, False: 300} and {r.id for r in got if r.errors} == {50}
    assert all((r.corrupted != r.original) == bool(r.errors) for r in got)
    # All forms but one are known words: only pairs with that one count, and known words alone leave none.
    forms = {r.corrupted for r in got if r.errors}
    words = sorted({w for f in forms for w in f.split()})
    known = spark.createDataFrame([(w,) for w in words], "word string")
    none = G.generate_corpus(rows, "s", "id", target=20, ratio=0.5, known=known.where(f"word <> '{words[-1]}'")).collect()
    assert len(none) in (10, 20) and all(words[-1] in r.corrupted for r in none if r.errors)


def test_nothing_to_corrupt(spark):
    rows = spark.createDataFrame([(i, "x") for i in range(5)], "id long, s string")
    got = G.generate_corpus(rows, "s", "id", target=10, ratio=0.5).collect()
    assert len(got) == 5 and not any(r.errors for r in got)
    assert G.generate_corpus(rows.limit(0), "s", "id", target=10).count() == 0


def test_validation(spark):
    pairs = spark.createDataFrame([(1, "a b", "a c"), (2, "a b", "a d"), (3, "a b", "a c d"), (4, "a b", "b a")], "id long, o string, c string")
    known = spark.createDataFrame([("c",), ("c",)], "word string")
    assert {r.id for r in G.with_invalid_words(pairs, known, "o", "c", "id").collect()} == {2, 3, 4}


def test_statistics(sentences):
    got = G.generate_corpus(sentences, "s", "id", target=30, ratio=0.5, rate=0.5)
    counts = {r.type: r.n for r in G.generation_statistics(got).collect()}
    types = Counter(e.type for r in got.collect() for e in r.errors)
    assert counts == {**types, "corrupted": 15, "clean_pairs": 15}


def test_byte_labels():
    assert G.byte_labels("aéx", [(1, 2)]) == [0, 1, 1, 0] and G.byte_labels("", []) == [] and G.byte_labels("ab", [(1, 9)]) == [0, 1]


def test_rules_in_spark(spark):
    rows = spark.createDataFrame([(1, "زۆر کەس هاتین"), (2, None), (3, "")], "id long, s string")
    got = {r.id: r.e for r in rows.select("id", G.inject_rule("s", F.col("id").cast("string"), "quantifier_agreement", 1.0).alias("e")).collect()}
    assert got[1].corrupted == "زۆر کەس هاتم" and got[1].errors[0].start == 8 and got[2].corrupted == "" and got[3].errors == []
