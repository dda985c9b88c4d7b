"""One query for each error generator, on all sentences in Arabic script."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import graph_profile as G
from corpusloom.functions import morph_profile as P
from corpusloom.functions import verb_profile as V
from corpusloom.operators import errors as E
from corpusloom.operators.errors import CONTRACTED, FUSED, GENERATORS, MARKS, ORTHOGRAPHY, PARTICIPLES, PREPOSITIONS, inject
from corpusloom.operators import noun_errors as N
from corpusloom.operators.sentence_errors import CLOSERS, OPENERS, VERB_BEGINNINGS, connectors, whitespace, word_order
from corpusloom.plans.tables import AR, script_sentences

Q: dict = {}
SQL: dict[str, str] = {}

#: Tables are checked whole: with rate 1 and one form a word, SQL can give the corrupted text.
_ONE = {"preposition_fusion": {k: v[0] for k, v in FUSED.items()}, "demonstrative_contraction": {k: v[0] for k, v in CONTRACTED.items()}, "participle_voice_swap": PARTICIPLES | {v: k for k, v in PARTICIPLES.items()}}
#: Kinds whose forms SQL has as lists: at rate 1 only the form is drawn.
_LISTED = ("spelling_confusion", "orthography", "punctuation", "case_role_preposition", "dialectal_participle", "possessive_clitic", "morpheme_order")
_VERBS = ("نادەچم", "نەبوو", "دەچمەوە", "کردنەوە")
_WORDS = sorted({w for t in (FUSED, CONTRACTED, PARTICIPLES, PREPOSITIONS, _VERBS) for w in t})


def _sentences(spark, sf):
    """Sentences, each followed by a word of the tables, so that all generators have something to change."""
    pick = F.element_at(F.array(*map(F.lit, _WORDS)), (F.pmod("doc_id", F.lit(len(_WORDS))) + 1).cast("int"))
    return script_sentences(spark, sf).select("doc_id", "pos", F.concat_ws(" ", F.regexp_replace("s", r"\s+", " "), pick).alias("s"))


def _query(kind: str):
    def run(spark, sf):
        rows = _sentences(spark, sf)
        out = rows.withColumn("e", inject(F.col("s"), F.concat_ws(":", "doc_id", "pos"), kind, 1.0 if kind in _ONE or kind in _LISTED else 0.15))
        return out.select("doc_id", "pos", F.col("e.corrupted").alias("corrupted"), F.size("e.errors").cast("long").alias("n_errors"))

    run.__name__ = f"inject_{kind}"
    return run


def _sentence_query(rows, generator, rate: float):
    out = rows.withColumn("e", generator(F.col("s"), F.concat_ws(":", "doc_id", "pos"), rate))
    return out.select("doc_id", "pos", F.col("e.corrupted").alias("corrupted"), F.size("e.errors").cast("long").alias("n_errors"))


def inject_word_order(spark, sf):
    return _sentence_query(_sentences(spark, sf), word_order, 1.0)


def inject_whitespace(spark, sf):
    return _sentence_query(_sentences(spark, sf), whitespace, 1.0)


def inject_missing_adversative_connector(spark, sf):
    """Each sentence follows a connector, so that there is something to change."""
    pick = F.element_at(F.array(*map(F.lit, OPENERS + CLOSERS)), (F.pmod("doc_id", F.lit(len(OPENERS + CLOSERS))) + 1).cast("int"))
    return _sentence_query(_sentences(spark, sf).withColumn("s", F.concat_ws(" ", pick, "s")), connectors, 0.15)


Q |= {f.__name__: f for f in (inject_word_order, inject_whitespace, inject_missing_adversative_connector)}
for _kind in GENERATORS:
    Q[f"inject_{_kind}"] = _query(_kind)
_FOLLOWED = f"""(regexp_replace(s, '[\\s\\x0B]+', ' ', 'g') || ' ' || ([{', '.join(f"'{w}'" for w in _WORDS)}])[doc_id % {len(_WORDS)} + 1])"""
_TIDY = "trim(regexp_replace(regexp_replace({}, ' +', ' ', 'g'), ' ([,.،؛])', '\\1', 'g'))"
for _kind, _forms in _ONE.items():
    _case = "case w " + " ".join(f"when '{k}' then '{v}'" for k, v in _forms.items()) + " end"
    SQL[f"inject_{_kind}"] = f"""with {AR}, t as (select doc_id, pos, string_split({_FOLLOWED}, ' ') as ws from ar),
      u as (select *, len(list_filter(ws, lambda w: {_case} is not null)) as n from t)
      select doc_id, pos, case when n > 0 then {_TIDY.format(f"array_to_string(list_transform(ws, lambda w: coalesce({_case}, w)), ' ')")} else array_to_string(ws, ' ') end as corrupted, n as n_errors from u"""


def _once(x: str, y: str, when: str = "true") -> str:
    return f"case when contains(w, '{x}') and {when} then regexp_replace(w, '{x}', '{y}') end"


_STEM = "regexp_extract(w, '^(.+?)(ووە|وە)$', 1)"
_BARE = f"left(w, length(w) - {len(E.COMPLETIVE)})"
_AT = f"length(regexp_extract({_BARE}, '^([^{E.VOWELS}]*[{E.VOWELS}]+)[^{E.VOWELS}]', 1))"
_PLACE = f"case when {_AT} < 2 then least(3, length({_BARE})) else {_AT} end"
_MOVED = f"(left({_BARE}, {_PLACE}) || '{E.COMPLETIVE}' || substr({_BARE}, ({_PLACE}) + 1))"


def _own(end: str) -> str:
    stem = f"left(w, length(w) - {len(end)})"
    return f"ends_with(w, '{end}') and regexp_matches({stem}, '^[؀-ۿ]{{3,}}$') and not regexp_matches({stem}, '^({'|'.join(E.VERB_PREFIXES)})')"


_FREE = {"ئ": "left(w, 1) <> 'ئ'", "ی": "left(w, 1) <> 'ی'", "و": "not contains(w, 'وو') and not contains(w, 'ۆ')"}
_FORM_LISTS = {
    "spelling_confusion": [_once(x, y) for (a, b), n in V.CONFUSED_WEIGHTS.items() for x, y in ((a, b), (b, a)) for _ in range(int(2 * n))],
    "orthography": [
        *(f"case when contains(w, '{x}') and {"not ends_with(w, 'ە')" if x == 'ه' else 'true'} then replace(w, '{x}', '{y}') end" for a, b in ORTHOGRAPHY[:2] for x, y in ((a, b), (b, a))),
        "case when contains(w, 'وو') then regexp_replace(w, 'وو', 'و') when contains(w, 'و') then regexp_replace(w, 'و', 'وو') end",
        "case when left(w, 1) = 'ئ' then 'ی' || substr(w, 2) when left(w, 1) = 'ی' then 'ئ' || substr(w, 2) end",
        *(_once(x, y, _FREE.get(x, "true")) for a, b in ORTHOGRAPHY[2:] for x, y in ((a, b), (b, a))),
    ],
    "case_role_preposition": [f"case w {' '.join(f"when '{k}' then '{v[i]}'" for k, v in PREPOSITIONS.items() if i < len(v))} end" for i in range(3)],
    "dialectal_participle": [f"case when {_STEM} not in ('', {', '.join(f"'{x}'" for x in E.NOT_PARTICIPLES)}) then {_STEM} || '{x}' end" for x in ("یە", "گە")],
    "possessive_clitic": [f"case {' '.join(f"when {_own(end)} then left(w, length(w) - {len(end)}) || '{E.POSSESSIVES[end][i]}'" for end in sorted(E.POSSESSIVES, key=len, reverse=True))} end" for i in range(3)],
    "morpheme_order": [
        "case " + " ".join(f"when starts_with(w, '{a}') then '{b}' || substr(w, {len(a) + 1})" for a, b in E.PREFIX_ORDER.items()) + " end",
        f"case when ends_with(w, '{E.COMPLETIVE}') and length(w) > 5 and {_MOVED} <> w then {_MOVED} end",
        f"case w {' '.join(f"when '{k}' then '{v[0]}'" for k, v in E.PARTICLES.items())} end",
    ],
    "punctuation": [f"case w {' '.join(f"when '{m}' then '{v[i]}'" for m, v in MARKS.items())} end" for i in (0, 1)],
}


def _drawn(kind: str, index: str) -> str:
    return f"cast('0x' || substr(md5('42:{kind}:form:' || doc_id || ':' || pos || ':' || ({index})), 1, 8) as bigint)"


for _kind in _LISTED:
    _marks = "".join(MARKS)
    _ws, _joint = (f"regexp_extract_all({_FOLLOWED}, '[{_marks}]|[^{_marks}]+')", "") if _kind == "punctuation" else (f"string_split({_FOLLOWED}, ' ')", " ")
    SQL[f"inject_{_kind}"] = f"""with {AR}, t as (select doc_id, pos, {_ws} as ws from ar),
      f as (select doc_id, pos, list_transform(ws, lambda w: {{'w': w, 'f': list_filter([{', '.join(_FORM_LISTS[_kind])}], lambda x: x is not null)}}) as ws from t),
      g as (select doc_id, pos, list_transform(ws, lambda x, i: {{'w': x.w, 'new': case when len(x.f) > 0 then x.f[{_drawn(_kind, 'i - 1')} % len(x.f) + 1] end}}) as ws from f),
      u as (select *, len(list_filter(ws, lambda x: x.new is not null)) as n, array_to_string(list_transform(ws, lambda x: coalesce(x.new, x.w)), '{_joint}') as s from g)
      select doc_id, pos, case when n > 0 then {_TIDY.format('s')} else s end as corrupted, n as n_errors from u"""
#: At rate 1 all long words are cut, and of a run of short ones every second from its end is fused with its neighbour.
SQL["inject_whitespace"] = f"""with {AR}, t as (select doc_id, pos, list_filter(string_split({_FOLLOWED}, ' '), lambda x: x <> '') as ws from ar),
  w as (select doc_id, pos, unnest(ws) as w, generate_subscripts(ws, 1) - 1 as i, len(ws) as m from t),
  r as (select *, coalesce(min(case when length(w) >= 5 then i end) over (partition by doc_id, pos order by i rows between current row and unbounded following), m) - 1 - i as d from w),
  a as (select *, length(w) >= 5 as cut, length(w) < 5 and d % 2 = 1 as fused, {_drawn('whitespace', 'i')} % greatest(length(w) - 3, 1) + 2 as h from r)
  select doc_id, pos, {_TIDY.format("string_agg(case when cut then left(w, h) || ' ' || substr(w, h + 1) else w end || case when fused then '' else ' ' end, '' order by i)")} as corrupted,
    count(*) filter (cut or fused) as n_errors from a group by doc_id, pos"""
SQL["inject_word_order"] = f"""with {AR}, t as (select doc_id, pos, list_filter(string_split(regexp_replace(s, '[\\s\\x0B]+', ' ', 'g') || ' ' || ([{', '.join(f"'{w}'" for w in _WORDS)}])[doc_id % {len(_WORDS)} + 1], ' '), lambda w: w <> '') as ws from ar),
  u as (select *, len(ws) >= 3 and ({' or '.join(f"starts_with(ws[-1], '{p}')" for p in VERB_BEGINNINGS)}) as verb,
      cast('0x' || substr(md5('42:word_order:at:' || doc_id || ':' || pos || ':0'), 1, 8) as bigint) % greatest(len(ws) - 2, 1) + 1 as i from t)
  select doc_id, pos, case when verb then array_to_string(ws[1:1] || ws[-1:] || ws[2:-2], ' ')
      when len(ws) >= 4 then array_to_string(ws[1:i-1] || [ws[i+1], ws[i]] || ws[i+2:], ' ') else array_to_string(ws, ' ') end as corrupted,
    cast(verb or (len(ws) >= 4 and ws[i] <> ws[i+1]) as bigint) as n_errors from u"""


_NOUNS = ("کتێبی باش هات", "کوڕی مامۆستا هات", "کتێبەکە باش", "پیاوەکان هاتن", "ئاوەکان", "ئەم کتێبە", "ئەو پیاوەکە", "قوتابییان هاتن", "ئاو هات", "هەولێر جوان", "کتێبی کوڕی گەورە", "ماڵی تۆ ی")


def inject_noun_adjective_agreement(spark, sf):
    """Each sentence follows a noun phrase."""
    pick = F.element_at(F.array(*map(F.lit, _NOUNS)), (F.pmod("doc_id", F.lit(len(_NOUNS))) + 1).cast("int"))
    return _sentence_query(_sentences(spark, sf).withColumn("s", F.concat_ws(" ", pick, "s")), N.noun_adjective, 1.0)


def _choice(forms) -> str:
    return f"([{', '.join(f"'{x}'" for x in forms)}])[d % {len(forms)} + 1]"


Q["inject_noun_adjective_agreement"] = inject_noun_adjective_agreement
SQL["inject_noun_adjective_agreement"] = f"""with {AR}, t as (select doc_id, pos, string_split(([{', '.join(f"'{x}'" for x in _NOUNS)}])[doc_id % {len(_NOUNS)} + 1] || ' ' || {_FOLLOWED}, ' ') as ws from ar),
  w0 as (select doc_id, pos, unnest(ws) as t, generate_subscripts(ws, 1) - 1 as i from t), w1 as (select *, coalesce(lead(t) over (partition by doc_id, pos order by i), '') as nt from w0),
  w2 as (select *, ends_with(t, 'ی') and length(t) >= 2 and nt <> '' as lk, {_drawn('noun_adjective_agreement', 'i')} as d, nt in ({', '.join(f"'{x}'" for x in N.ADJECTIVES)}) as known from w1),
  w3 as (select *, lk and (i - coalesce(max(case when not lk then i end) over (partition by doc_id, pos order by i rows between unbounded preceding and 1 preceding), -1)) % 2 = 1 and (known or length(nt) >= 3) as linked from w2),
  w4 as (select *, linked or coalesce(lag(linked) over o, false) as covered, lead(linked) over o as nl from w3 window o as (partition by doc_id, pos order by i)),
  w5 as (select *, not covered and regexp_matches(t, '^.{{2,}}(?:{N.SINGULAR}|{N.PLURAL})$') as definite, not covered and not linked and not coalesce(nl, false) and not regexp_matches(nt, '^.{{2,}}(?:{N.SINGULAR}|{N.PLURAL})$') and t in ('ئەم', 'ئەو') and regexp_matches(nt, '^.{{2,}}ە$') as shown from w4),
  w6 as (select *, not covered and not shown and not coalesce(lag(shown) over (partition by doc_id, pos order by i), false) and not definite as alone from w5),
  w7 as (select *, case when linked then case when known and d % 100 < 35 then t || ' ' || nt || 'ان' when d // 1000 % 10 < 4 then left(t, length(t) - 1) || ' ' || nt when d // 1000 % 10 < 7 then left(t, length(t) - 1) || 'ەکەی ' || nt else left(t, length(t) - 1) || 'یی ' || nt end
      when definite then case when ends_with(t, '{N.SINGULAR}') then left(t, length(t) - 3) || '{N.PLURAL}' when left(t, length(t) - 4) not in ({', '.join(f"'{x}'" for x in G.MASS_NOUNS)}) then left(t, length(t) - 4) || '{N.SINGULAR}' end
      when shown then t || ' ' || left(nt, length(nt) - 1) || {_choice(N.NOT_SHOWN)} when alone and regexp_matches(t, '^.+یان$') and length(t) >= 4 then left(t, length(t) - 3) || 'ان'
      when alone and t in ({', '.join(f"'{x}'" for x in G.MASS_NOUNS)}) then t || {_choice(N.PLURALS)} when alone and t in ({', '.join(f"'{x}'" for x in G.PROPER_NOUNS)}) then t || {_choice(N.NOT_PROPER)} end as new from w6),
  w8 as (select *, coalesce(lag(new is not null and (linked or shown)) over (partition by doc_id, pos order by i), false) as gone from w7),
  u as (select doc_id, pos, string_agg(coalesce(new, t), ' ' order by i) as s, count(new) as n from w8 where not gone group by doc_id, pos)
  select doc_id, pos, case when n > 0 then {_TIDY.format('s')} else s end as corrupted, n as n_errors from u"""


_HOSTS = ("کتێبمان هات", "کتێبەکەی جوان", "کتێبی باش", "کتێبی دەچێت", "خۆمان هاتین", "نووسیڕای", "نووسیڕام هات", "(کتێبت )", "ئەمی")


def inject_clitic_form(spark, sf):
    """Each sentence follows a word with a clitic, or one that looks like it."""
    pick = F.element_at(F.array(*map(F.lit, _HOSTS)), (F.pmod("doc_id", F.lit(len(_HOSTS))) + 1).cast("int"))
    return _sentence_query(_sentences(spark, sf).withColumn("s", F.concat_ws(" ", pick, "s")), N.clitic_form, 1.0)


def _weighted(forms: dict[str, int]) -> str:
    below, out = 0, []
    for form, share in forms.items():
        below += share
        out.append(f"when d < {below} then '{form}'")
    return f"case {' '.join(out)} end"


_IN = lambda x, words: f"{x} in ({', '.join(f"'{y}'" for y in words)})"
Q["inject_clitic_form"] = inject_clitic_form
SQL["inject_clitic_form"] = f"""with {AR}, t as (select doc_id, pos, string_split(([{', '.join(f"'{x}'" for x in _HOSTS)}])[doc_id % {len(_HOSTS)} + 1] || ' ' || {_FOLLOWED}, ' ') as ws from ar),
  w0 as (select doc_id, pos, unnest(ws) as t, generate_subscripts(ws, 1) - 1 as i from t),
  w1 as (select *, coalesce(lead(t) over (partition by doc_id, pos order by i), '') as nt, regexp_extract(t, '{N.WORD}') as tail, {_drawn('clitic_form', 'i')} % 100 as d from w0),
  w2 as (select *, regexp_extract(tail, '^.+?({'|'.join(P.CLITICS)})$', 1) as c from w1), w3 as (select *, left(tail, length(tail) - length(c)) as stem from w2),
  w4 as (select *, c <> '' and length(stem) >= 2 and not {_IN('tail', N.INVARIANT)} and (c <> 'ی' or nt = '' or regexp_matches(nt, '^(?:{'|'.join(N.VERBS_BEHIND)}|[{N.MARKS_BEHIND}])') or regexp_matches(stem, '(?:{'|'.join(N.DEFINITE_BEFORE)})$')) as fits,
    {' or '.join(f"(ends_with(tail, '{m}') and {_IN(f'left(tail, length(tail) - {len(m)})', N.PASSIVE_STEMS)})" for m in N.PASSIVES)} as passive from w3),
  w5 as (select *, case when fits then stem || case {' '.join(f"when passive and c = '{a}' then '{b}'" for a, b in N.REASSIGNED.items())} {' '.join(f"when c = '{a}' then {_weighted(b)}" for a, b in N.SWAPS.items())} end end as new from w4),
  u as (select doc_id, pos, string_agg(case when new is null then t else left(t, length(t) - length(tail)) || new end, ' ' order by i) as s, count(new) as n from w5 group by doc_id, pos)
  select doc_id, pos, case when n > 0 then {_TIDY.format('s')} else s end as corrupted, n as n_errors from u"""
