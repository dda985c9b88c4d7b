"""Queries on rules for whole sentences and on the generation of corpora, on all sentences in Arabic script."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from corpusloom.functions import verb_profile as V
from corpusloom.operators import generation as G
from corpusloom.operators.errors import PREPOSITIONS
from corpusloom.plans.tables import AR, script_sentences, table
from corpusloom.sources.writers import saved

Q: dict = {}
SQL: dict[str, str] = {}
KEY = ("doc_id", "pos")

#: What sentences follow, so that a rule has something to change: one phrase or word for each, in turn.
PHRASES = {
    "subject_verb_number": ("من دەچم", "ئەوان نەدەچن", "بنووسە", "من نامەکە نووسیم", "ئەو دەکات"), "tense_agreement": ("من ئەوم دیت", "نەکرد", "ئەوان هاتن"), "relative_clause_ezafe": ("کتێبی کە من کڕیم", "پەرداخەکەی کە شکا", "پیاوەکەی دەچێت"),
    "negative_concord": ("هیچ کەس ناچێت", "هیچ شت نەما"), "vocative_imperative": ("کوڕۆ بنووسە", "کوڕینۆ بنووسن", "ئەی کوڕ بچۆ"), "conditional_agreement": ("ئەگەر بچیت دەبینیت ،", "ئەگەر دەچیت، باشە"), "adverb_verb_tense": ("دوێنێ چوو بۆ ماڵ", "ئێستا دەچم"),
    "polite_imperative": ("تکایە بنووسە", "فەرموو بخۆن"),
}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _after(spark, sf, phrases):
    pick = F.element_at(F.array(*map(F.lit, phrases)), (F.pmod("doc_id", F.lit(len(phrases))) + 1).cast("int"))
    return script_sentences(spark, sf).select(*KEY, F.concat_ws(" ", pick, F.regexp_replace("s", r"\s+", " ")).alias("s"))


def _changed(rows, kind, rate=1.0):
    out = rows.withColumn("e", G.inject_rule("s", F.concat_ws(":", *KEY), kind, rate))
    return out.select(*KEY, F.col("e.corrupted").alias("corrupted"), F.size("e.errors").cast("long").alias("n_errors"))


def _rule_query(kind):
    def run(spark, sf):
        return _changed(_after(spark, sf, PHRASES[kind]), kind)

    run.__name__ = f"inject_{kind}"
    return run


for _kind in PHRASES:
    Q[f"inject_{_kind}"] = _rule_query(_kind)

_WORDS = r"{}, t as (select doc_id, pos, list_filter(string_split('{} ' || regexp_replace(s, '[\s\x0B]+', ' ', 'g'), ' '), lambda w: w <> '') as ws from ar)"
#: As the rules tidy a sentence that they changed.
_TIDY = "regexp_replace({}, ' ([,.،؛])', '\\1', 'g')"
_LIKE = " or ".join(f"starts_with(x, '{p}')" for p in V.VERB_LIKE)


def _plural(w: str) -> str:
    cases = []
    for end, other in V.PLURAL_TO_SINGULAR.items():
        stem = f"left({w}, length({w}) - {len(end)})"
        cases.append(f"when ends_with({w}, '{end}') and length({w}) >= {len(end) + 2} and (length({w}) >= {len(end) + 3} or {_LIKE.replace('x', stem)}) then {stem} || '{other}'")
    return f"case {' '.join(cases)} end"


@query(
    f"""with {_WORDS.format(AR, 'زۆر')}, f as (select *, list_transform(range(1, len(ws) + 1), lambda i: case when i > 1 then {_plural('ws[i]')} end) as forms from t)
    select doc_id, pos, case when len(list_filter(forms, lambda x: x is not null)) > 0 then {_TIDY.format("array_to_string(list_transform(range(1, len(ws) + 1), lambda i: coalesce(forms[i], ws[i])), ' ')")} else array_to_string(ws, ' ') end as corrupted,
      len(list_filter(forms, lambda x: x is not null)) as n_errors from f"""
)
def inject_quantifier_agreement(spark, sf):
    """Each sentence follows a quantifier."""
    return _changed(_after(spark, sf, ("زۆر",)), "quantifier_agreement")


_FORM = "case when starts_with({0}, 'دە') then case when length({0}) > 3 then substr({0}, 3) end when length({0}) < 3 or (starts_with({0}, 'نە') and not starts_with({0}, 'نەدە')) then null else 'دە' || {0} end"
_CONJ = "('" + "', '".join(V.CONJUNCTIONS) + "')"


@query(
    f"""with {_WORDS.format(AR, 'پاشان')}, f as (select *, list_transform(ws, lambda w: {_FORM.format('w')}) as forms from t),
    g as (select *, list_transform(range(1, len(ws) + 1), lambda i: case when (i > 1 and ws[i - 1] in {_CONJ}) or (i > 2 and ws[i - 2] in {_CONJ} and forms[i - 1] is null)
      or (i > 3 and ws[i - 3] in {_CONJ} and forms[i - 1] is null and forms[i - 2] is null) then forms[i] end) as new from f)
    select doc_id, pos, case when len(list_filter(new, lambda x: x is not null)) > 0 then {_TIDY.format("array_to_string(list_transform(range(1, len(ws) + 1), lambda i: coalesce(new[i], ws[i])), ' ')")} else array_to_string(ws, ' ') end as corrupted,
      len(list_filter(new, lambda x: x is not null)) as n_errors from g"""
)
def inject_cross_clause_agreement(spark, sf):
    """Each sentence follows a conjunction."""
    return _changed(_after(spark, sf, ("پاشان",)), "cross_clause_agreement")


def _all_phrases(spark, sf):
    return _after(spark, sf, [*(p for k in PHRASES.values() for p in k), *PREPOSITIONS])


@query()
def corrupt_sentences(spark, sf):
    """One or two kinds of errors for each sentence."""
    out = _all_phrases(spark, sf).withColumn("e", G.corrupt_sentences("s", F.concat_ws(":", *KEY), 0.5))
    return out.select(*KEY, F.col("e.corrupted").alias("corrupted"), F.array_join("e.errors.type", ",").alias("types"))


@query()
def gen_corpus(spark, sf):
    """50,000 pairs, of which seven in ten have errors: the quota is the feature."""
    out = G.generate_corpus(_all_phrases(spark, sf), "s", *KEY)
    return out.select("source_id", "original", "corrupted", F.size("errors").cast("long").alias("n_errors"))


@query("select 15000::bigint as clean_pairs, 35000::bigint as corrupted, 0::bigint as unchanged")
def gen_quota(spark, sf):
    """Exact quotas, whatever the table's size, and no corrupted pair that is as it was."""
    n = F.size("errors")
    return G.generate_corpus(_all_phrases(spark, sf), "s", *KEY).agg(F.count_if(n == 0).alias("clean_pairs"), F.count_if(n > 0).alias("corrupted"), F.count_if((n > 0) & (F.col("corrupted") == F.col("original"))).alias("unchanged"))


@query("select 0::bigint as n")
def gen_validated(spark, sf):
    """With the words of the documents as known ones, no corrupted pair has known new words only."""
    rows = _all_phrases(spark, sf)
    known = saved(rows.select(F.explode(F.split("s", " ")).alias("word")).where("word <> ''").distinct())
    out = G.generate_corpus(rows, "s", *KEY, target=5000, known=known).where(F.size("errors") > 0)
    return out.join(G.with_invalid_words(out, known, "original", "corrupted", "source_id").select("source_id"), "source_id", "left_anti").agg(F.count("*").alias("n"))


@query("select b.item_id, list_sum(list_transform(range(1, length(b.text) + 1), lambda i: case when i > 2 and i <= 7 then octet_length(encode(substr(b.text, i, 1))) else 0 end))::bigint as marked, octet_length(encode(b.text))::bigint as n from benchmark b")
def byte_labels(spark, sf):
    """Labels of the bytes of texts whose characters 2 to 6 are an error."""
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: G.byte_labels(t, [(2, 7)]))

    rows = table(spark, sf, "benchmark").select("item_id", F.pandas_udf(run, "array<int>")("text").alias("l"))
    return rows.select("item_id", F.aggregate("l", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("marked"), F.size("l").cast("bigint").alias("n"))
