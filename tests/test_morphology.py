"""Morphological features of golden tokens, and of tokens in sentences."""

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import morph_profile as P
from corpusloom.operators import morphology as M

GOLDEN = {
    "کتێبەکە": {"definiteness": "def", "pos": "NOUN", "number": "sg", "lemma": "کتێب"}, "کتێبەکان": {"definiteness": "def", "number": "pl", "pos": "NOUN"}, "کتێبێک": {"definiteness": "indef", "pos": "NOUN"}, "پارەکەمان": {"is_clitic": True, "clitic_person": "1", "clitic_number": "pl"},
    "دەچم": {"tense": "present", "person": "1", "number": "sg", "pos": "VERB", "aspect": "habitual"}, "ناچم": {"negated": True, "pos": "VERB", "person": "1"}, "بردوویتی": {"person": "3", "number": "sg", "transitivity": "trans"}, "بتێ": {"pos": "NOUN"},
    "بکشێ": {"pos": "VERB", "tense": "imperative"}, "بنووسە": {"pos": "VERB"}, "بخوێنم": {"pos": "VERB"}, "کردم": {"tense": "past", "aspect": "perfective"}, "چووم": {"aspect": "perfect"}, "کردن": {"pos": "VERB", "tense": "infinitive", "lemma": "کردن"},
    "بردن": {"pos": "VERB", "tense": "infinitive"}, "نووسین": {"pos": "VERB", "tense": "infinitive"}, "کوشتن": {"tense": "infinitive"}, "من": {"pos": "PRON", "person": "1", "number": "sg"}, "خۆمان": {"pos": "PRON", "lemma": "خۆ", "person": "1", "number": "pl"},
    "ئەو": {"pos": "PRON", "person": "3"}, "ئەم": {"pos": "DET", "number": "sg"}, "لە": {"pos": "ADP"}, "و": {"pos": "CCONJ"}, "کە": {"pos": "SCONJ"}, "ئایا": {"pos": "PART"}, "دوو": {"pos": "NUM"}, "زۆر": {"pos": "DET"}, "زوو": {"pos": "ADV"}, "چۆن": {"pos": "ADV"},
    "بەجوانی": {"pos": "ADV", "lemma": "جوانی"}, "گەورە": {"pos": "ADJ"}, "گەورەترین": {"pos": "ADJ", "lemma": "گەورە"}, "جوانتر": {"pos": "ADJ", "lemma": "جوان"}, "هەرەباش": {"pos": "ADJ", "lemma": "باش"}, "لەم": {"pos": "DET"}, "دووەم": {"pos": "NUM", "lemma": "دوو"},
    "١٢": {"pos": "NUM"}, "؟": {"pos": "PUNCT"}, "نیوە": {"pos": "NUM"}, "نییە": {"pos": "VERB", "tense": "present", "negated": True}, "کوڕی": {"pos": "NOUN", "case": "ez", "is_clitic": False}, "وەردەگرم": {"compound_prefix": "وەر", "tense": "present"}, "کوژرا": {"pos": "NOUN"},
    "سووتاند": {"voice": "causative", "pos": "VERB"}, "": {"pos": "NOUN", "lemma": ""},
}
RAW = {
    "ئەبێتەوە": {"has_epenthetic_t": "true"}, "دەسوڕێتەوە": {"has_epenthetic_t": "true"}, "ئەکاتە": {"has_epenthetic_t": "true"}, "دەوێم": {"is_wistin_exception": "true"}, "لەرزان": {}, "نەچوو": {"negation_morpheme": "نە"}, "بردوویتی": {"is_portmanteau_perfect": "true"},
    "دووەمین": {"ordinal_form": "long"}, "دووەم": {"ordinal_form": "short"}, "نیوە": {"niwe_type": "concrete"}, "نیو": {}, "گەڕان": {"has_doublet_variant": "true"}, "پشکنینم": {"missing_obligatory_preverb": "پشکنین"}, "نیە": {"habun_negation": "possession"},
}


@pytest.fixture(scope="module")
def features(spark):
    tokens = [*GOLDEN, *RAW, "پەروەویست", "x" * 5000, "دە", "ب", "ی"]
    rows = spark.createDataFrame([(t,) for t in dict.fromkeys(tokens)], "token string")
    return {r.token: r for r in M.token_features(rows).collect()}


def test_golden_tokens(features):
    for token, want in GOLDEN.items():
        got = features[token].asDict()
        assert {k: got[k] for k in want} == want, token
    for token, want in RAW.items():
        assert want.items() <= features[token].raw.items(), token
    assert "is_wistin_exception" not in features["پەروەویست"].raw and "niwe_type" not in features["نیو"].raw


def test_every_token_has_one_row(features):
    assert all(r.pos and r.lemma is not None and set(r.asDict()) == {"token", "raw", *M.TEXT, *M.FLAGS} for r in features.values())
    assert len(features) == len(set([*GOLDEN, *RAW, "پەروەویست", "x" * 5000, "دە", "ب", "ی"]))


def test_first_rule_counts(spark):
    """A word of several lists has the class of the first one."""
    words = spark.createDataFrame([(w,) for w in ("ئەو", "دوو", "چەند", "بۆ", "یا", "نیو", "هەرچەندە", "بە", "تر")], "token string")
    assert {r.token: r.pos for r in M.closed_classes(words).collect()} == {"ئەو": "PRON", "دوو": "NUM", "چەند": "DET", "بۆ": "ADP", "یا": "CCONJ", "نیو": "NUM", "هەرچەندە": "ADV", "بە": "ADP"}


def test_context(spark):
    rows = spark.createDataFrame([(1, "چوو بۆ قوتابخانە"), (2, "دوو کتێبەکان"), (3, None), (4, ""), (5, "کتێبەکان بۆ"), (6, "لە من و لە کوڕی")], "id long, s string")
    got = {(r.id, r.token): r for r in M.analyzed(rows, "s", "id").collect()}
    assert got[1, "قوتابخانە"].case == "obl" and got[2, "کتێبەکان"].number == "sg" and got[2, "کتێبەکان"].raw["cardinal_forced_sg"] == "true"
    assert got[5, "کتێبەکان"].number == "pl" and got[6, "من"].case == "obl" and got[6, "کوڕی"].case == "ez" and {k[0] for k in got} == {1, 2, 5, 6}


def test_frequent_and_other_tokens(spark):
    """The features of tokens are the same whether they are broadcast or joined."""
    rows = spark.createDataFrame([(i, "و" if i % 3 else f"دەچم{'ا' * (i % 50)}") for i in range(600)], "id long, token string")
    old, M.FREQUENT = M.FREQUENT, 5
    try:
        got = M.with_features(rows).select("id", "token", "pos", "tense").collect()
    finally:
        M.FREQUENT = old
    assert len(got) == 600 and sorted(got) == sorted(M.with_features(rows).select("id", "token", "pos", "tense").collect())
    assert M.with_features(rows.where("false")).count() == 0


def test_vectors(spark):
    known = M.vocabulary()
    assert (known["PAD"], known["UNK"]) == (0, 1) and list(known.values()) == list(range(len(known))) and len(known) == 2 + sum(len(v) + 1 for v in P.FEATURES.values())
    rows = spark.createDataFrame([("دەچم",)], "token string")
    (r,) = M.token_features(rows).select(M.vector().alias("v")).collect()
    names = {i: n for n, i in known.items()}
    assert [names[i] for i in r.v] == ["person:1", "number:sg", "tense:present", "aspect:habitual", "case:UNK", "definiteness:UNK", "transitivity:UNK", "clitic_person:1", "clitic_number:sg"]
    odd = rows.select(*(F.lit("?").alias(f) for f in P.FEATURES))
    assert odd.select(M.vector().alias("v")).first().v == [0] * len(P.FEATURES)
