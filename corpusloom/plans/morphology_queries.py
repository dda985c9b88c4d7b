"""Queries on morphological features, on all sentences in Arabic script, each behind two words that the rules know, in turn."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import morph_profile as P
from corpusloom.functions import profile
from corpusloom.operators import context as C
from corpusloom.operators import morphology as M
from corpusloom.plans.tables import AR, script_sentences

Q: dict = {}
SQL: dict[str, str] = {}
KEY = ("doc_id", "pos")
OPEN = (
    "دەچم ناچم نەچوو مەچۆ بردن کردن نووسین گەڕان ئەچم بکە بنووسە باخ بەرد کردم نووسیمان خوێندیان هەڵگرت هەڵیگرت وەردەگرم تێدەگەم دەخواتەوە دەڕواتەوە کوژرا سووتاند سووتێنرا دەسووتێنێت گەڕایەوە ناردووە بردوویەتی نەیتوانی دەوێت ناوێت "
    "ویستم نیە نییە پڕووزان کتێبەکە کتێبەکان کتێبێک پارەکەمان پارەکەم کتێبی گەورەیی مامۆستایان باخان دارستان هاوڕێ نانەوا کچۆڵە فڕۆک یارانە کوڕەشم کارگار بەختیار دووەم سێیەم دووەمین ١٢ ۱۲ ؟ ،"
).split()
_CLOSED = [*P.SUBJECT_PRONOUNS, *P.REFLEXIVES, *P.INTERROGATIVES, *P.RECIPROCALS, *P.DEMONSTRATIVES, *P.PREPOSITIONS, *P.COORDINATING, *P.SUBORDINATING, *P.PARTICLES, *P.NUMERALS, *P.QUANTIFIERS, *P.ADVERBS, *P.QUESTION_ADVERBS, *P.ADJECTIVES, *P.CONTRACTED, *P.FRACTIONS, *P.HALF, "گەورەتر", "گەورەترین", "هەرەباش", "بەباشی"]
_STEMS = [root + end for end, roots in P.PAST_ROOTS.items() for root in roots]
WORDS = [*OPEN, *dict.fromkeys(_CLOSED), *(s + e for s in _STEMS for e in ("م", "ن"))]


def sentences(spark, sf):
    at = F.col("doc_id") * 31 + F.col("pos")
    pick = lambda k, c: F.element_at(F.array(*map(F.lit, WORDS)), (F.pmod(at * k + c, F.lit(len(WORDS))) + 1).cast("int"))
    return script_sentences(spark, sf).select(*KEY, F.concat_ws(" ", pick(1, 0), pick(7, 3), "s").alias("s"))


def _words_sql(k: int, c: int) -> str:
    return "([" + ", ".join(f"'{w}'" for w in WORDS) + f"])[((doc_id * 31 + pos) * {k} + {c}) % {len(WORDS)} + 1]"


TOKENS = f"""{AR}, spoken as (select doc_id, pos, {_words_sql(1, 0)} || ' ' || {_words_sql(7, 3)} || ' ' || s as s from ar),
  split as (select doc_id, pos, regexp_extract_all(regexp_replace(' ' || s, '([\\s\\x0B])و([{profile.WAW_BEFORE}])', '\\1و \\2', 'g'), '[{profile.TOKEN_LETTERS}]+|[۰-۹0-9]+|[a-zA-Z]+|[^\\s\\x0B]') as ts from spoken),
  placed as (select doc_id, pos, unnest(ts) as token, generate_subscripts(ts, 1) - 1 as i from split), d as (select distinct token from placed)"""


def _in(x: str, words) -> str:
    return f"{x} in ({', '.join(f"'{w}'" for w in dict.fromkeys(words))})"


def _map(table: dict, x: str, part: int) -> str:
    return f"case {x} {' '.join(f"when '{k}' then '{v[part] or ''}'" for k, v in table.items())} else '' end"


def _alt(words) -> str:
    return "|".join(words)


def _closed_sql() -> str:
    """pos, person, number, lemma of the first rule that fits, as one CASE each."""
    rows = [
        (f"regexp_matches(token, '^[{P.PUNCTUATION}]+$')", "PUNCT"), (f"regexp_matches(token, '^[{P.DIGITS}]+$')", "NUM"), (_in("token", P.SUBJECT_PRONOUNS), "PRON"), (_in("token", P.REFLEXIVES), "PRON"), (_in("token", P.INTERROGATIVES), "PRON"),
        (_in("token", P.RECIPROCALS), "PRON"), (_in("token", P.DEMONSTRATIVES), "DET"), (_in("token", P.PREPOSITIONS), "ADP"), (_in("token", P.COORDINATING), "CCONJ"), (_in("token", P.SUBORDINATING), "SCONJ"), (_in("token", P.PARTICLES), "PART"),
        (_in("token", P.NUMERALS), "NUM"), (_in("token", P.QUANTIFIERS), "DET"), (_in("token", P.ADVERBS), "ADV"), (_in("token", P.QUESTION_ADVERBS), "ADV"), (f"starts_with(token, '{P.ADVERB_PREFIX}') and length(token) > 3", "ADV"), (_in("token", P.ADJECTIVES), "ADJ"),
        (f"ends_with(token, '{P.SUPERLATIVE}') and length(token) > 4", "ADJ"), (f"ends_with(token, '{P.COMPARATIVE}') and length(token) > 2", "ADJ"), (f"starts_with(token, '{P.MOST}') and length(token) > 4", "ADJ"), (_in("token", P.CONTRACTED), "DET"),
        *((f"regexp_matches(token, '^(?:{_alt(P.NUMERALS)}|[{P.DIGITS}]+){e}$') and length(token) > {len(e) + 1}", "NUM") for e in P.ORDINAL_ENDINGS), (_in("token", P.FRACTIONS), "NUM"), (_in("token", P.HALF), "NUM"),
    ]
    n = "case " + " ".join(f"when {c} then {i}" for i, (c, _) in enumerate(rows)) + " end"
    pos = "case rule " + " ".join(f"when {i} then '{p}'" for i, (_, p) in enumerate(rows)) + " end"
    return f"""ruled as (select token, {n} as rule from d), closed as (select token, {pos} as pos,
      case rule when 2 then {_map(P.SUBJECT_PRONOUNS, 'token', 0)} when 3 then {_map(P.CLITICS, 'substr(token, 3)', 0)} else '' end as person,
      case rule when 2 then {_map(P.SUBJECT_PRONOUNS, 'token', 1)} when 3 then {_map(P.CLITICS, 'substr(token, 3)', 1)} when 5 then 'pl' when 6 then 'sg' else '' end as number,
      case rule when 3 then '{P.REFLEXIVE}' when 15 then substr(token, 3) when 17 then left(token, length(token) - 4) when 18 then left(token, length(token) - 2) when 19 then substr(token, 5)
        when 21 then left(token, length(token) - 2) when 22 then left(token, length(token) - 4) when 23 then left(token, length(token) - 5) else token end as lemma
      from ruled where rule is not null)"""


def _verb_sql() -> str:
    past = [r for roots in P.PAST_ROOTS.values() for r in roots]
    present = list(P.PAST_TO_PRESENT.values())
    near = lambda s: f"regexp_matches(rest, '.(?:{s}).{{0,3}}$')"
    first = lambda cases: "case " + " ".join(f"when {c} then '{v}'" for c, v in cases) + " end"
    return f"""v0 as (select token, ends_with(token, 'ن') and length(token) > 2 and {_in("left(token, length(token) - 1)", [*_STEMS, *P.PAST_TO_PRESENT])} as inf, regexp_extract(token, '^(?:{_alt(P.NEGATIONS)})') as neg from d where token not in (select token from closed)),
    v1 as (select *, regexp_extract(substr(token, length(neg) + 1), '^(?:{_alt(P.PREVERBS)})') as cpx, substr(token, length(neg) + 1) as r1 from v0),
    v2 as (select *, substr(r1, length(cpx) + 1) as r2, case neg when 'مە' then 'imperative' else '' end as t1 from v1),
    v3 as (select *, regexp_extract(r2, '^(?:{_alt(P.MOODS)})') as m0, substr(r2, 2) as b, regexp_extract(substr(r2, 2), '^(.{{2,}}?)(?:{_alt(P.PRESENT_ENDINGS)})$', 1) as core from v2),
    v4 as (select *, case when m0 <> 'ب' then m0 when neg <> '' or cpx <> '' then m0
        when (case when regexp_matches(b, '^(?:{_alt(present)})') then 2 when regexp_matches(b, '^(?:{_alt(past)})') then 1 else 0 end) + regexp_matches(b, '^(?:{_alt(P.SH_TO_ZH)})')::int + (core <> '')::int + ({_in('core', [*past, *present])})::int >= 2 then m0 else '' end as mood from v3),
    v5 as (select *, substr(r2, length(mood) + 1) as rest, case mood when 'دە' then case when t1 = '' then 'present' else t1 end when 'ئە' then 'future' when 'ب' then case when t1 = '' then 'imperative' else t1 end else t1 end as t2 from v4),
    v6 as (select *, regexp_extract(rest, '^({_alt(P.T_STEMS)})تە', 1) as ts, regexp_matches(rest, '.[{P.T_BEFORE}]ت(?:{_alt(P.T_AFTER)})$') and (mood <> '' or neg <> '' or cpx <> '') as inside from v5),
    v7 as (select *, case when ts <> '' and t2 = '' then 'present' else t2 end as t3, mood <> '' or ts <> '' or inside as vb1 from v6),
    v8 as (select *, case when t3 = '' and not vb1 then regexp_extract(rest, '^(?:{_alt([*_STEMS, *P.PAST_TO_PRESENT])})') else '' end as past,
        case when {near(P.CAUSATIVE[0])} then 'causative' when {near(_alt(P.PASSIVE))} then 'passive' when {near(P.CAUSATIVE[1])} then 'causative' else '' end as vo, regexp_extract(rest, '^(.*?)(?:{_alt(P.AGAIN)})$', 1) as before from v7),
    v9 as (select *, vo = '' and length(before) >= 2 and not regexp_matches(before, '(?:{_alt(P.NO_CAUSATIVE)})$') as again, case when past <> '' then 'past' else t3 end as t4, regexp_matches(rest, '.(?:{_alt(P.PORTMANTEAU)})$') as fused,
        regexp_extract(rest, '^.+?({_alt(P.ENDINGS)})$', 1) as e0 from v8),
    v10 as (select *, case when again then 'causative' else vo end as voice, vb1 or past <> '' or vo <> '' or again as vb2, case when fused or (past <> '' and length(rest) - length(e0) < length(past)) then '' else e0 end as e from v9),
    v11 as (select *, fused or vb2 or ((neg <> '' or t4 <> '') and e <> '') as vb3, case when fused then 'present' else t4 end as t5,
        case when fused then '3' when e <> '' then {_map(P.ENDINGS, 'e', 0)} when ts <> '' then '3' else '' end as p1, case when fused then 'sg' when e <> '' then {_map(P.ENDINGS, 'e', 1)} when ts <> '' then 'sg' else '' end as n1,
        {_in('token', (P.NOT_HAVING, P.NOT_BEING))} as habun, regexp_replace(token, '[متینا]+$', '') as bare from v10),
    v12 as (select *, inf or habun or vb3 as verb, case when inf then 'infinitive' when habun then 'present' else t5 end as tense, case when inf then '' when habun then '3' else p1 end as person, case when inf then '' when habun then 'sg' else n1 end as number,
        case when inf or not (vb3 or mood = 'دە') then '' when mood = 'دە' then 'habitual' when contains(rest, 'وو') or ends_with(token, 'ووە') then 'perfect' when t5 = 'past' then 'perfective' else '' end as aspect,
        not inf and (neg <> '' or habun) as negated, case when inf then '' else cpx end as compound_prefix, case when inf then '' else voice end as voice_, case when fused and not inf then 'trans' else '' end as transitivity from v11),
    verbs as (select *, case when inf then {f"case when {_in('token', P.DOUBLETS)} then 'has_doublet_variant=true' else '' end"} else concat_ws(';',
        case when again and contains(before, 'ێ') then 'causative_vowel_shift=true' end,
        {first(((f"token = '{P.NOT_HAVING}'", 'habun_negation=possession'), (f"token = '{P.NOT_BEING}'", 'habun_negation=existence')))},
        case when ts <> '' or inside then 'has_epenthetic_t=true' end, case when fused then 'is_portmanteau_perfect=true' end,
        case when {_in('rest', P.WANT_FORMS)} or regexp_matches(token, '^(?:{_alt(P.WANT_PRESENT)}|{P.WANT_STEM})') or starts_with(rest, '{P.WANT_STEM}') then 'is_wistin_exception=true' end,
        case when cpx = '' then {first([(f"starts_with(r2, '{w}') or starts_with(token, '{w}')", f'missing_obligatory_preverb={w}') for w in P.NEEDS_PREVERB])} end,
        case when neg <> '' then 'negation_morpheme=' || neg end,
        case when voice = 'passive' and vb3 and regexp_matches(rest, '{_alt(P.PASSIVE_STEMS)}|^(?:{_alt(s[:3] for s in P.PASSIVE_STEMS)})') then 'passive_vowel_change=true' end,
        case when vb3 and t5 = 'past' then {first([(f"ends_with(rest, '{x}') or ends_with(bare, '{x}')", f'past_stem_final={x}') for x in P.PAST_FINALS])} end,
        case when vb3 and t5 in ('present', 'future') then {first([(f"contains(rest, '{x}')", f'present_stem_mutation={m}') for x, m in P.MUTATIONS.items()])} end) end as raw from v12)"""


def _nominal_sql() -> str:
    fits = lambda x, e, more: f"ends_with({x}, '{e}') and length({x}) > {len(e) + more}"
    first = lambda x, ends, more: "case " + " ".join(f"when {fits(x, e, more)} then '{e}'" for e in ends) + " else '' end"
    cut = lambda x, e: f"left({x}, length({x}) - length({e}))"
    agents = [e for ends in P.AGENTS.values() for e in ends]
    return f"""n0 as (select token, number as n0, raw as r0, {first('token', P.NOMINAL, 0)} as e from verbs where not verb),
    n1 as (select *, {cut('token', 'e')} as rest0, regexp_extract({cut('token', 'e')}, '^(.+?)(?:یی|ی)$', 1) as link from n0),
    n2 as (select *, e = '' and length(link) > 1 as ez from n1), n3 as (select *, case when ez then link else rest0 end as rest from n2),
    n4 as (select *, case when e = '' and not ez then {first('rest', P.DERIVATIONS, 1)} else '' end as derived from n3),
    n5 as (select *, e = '' and not ez and derived = '' and ({' or '.join(f"(starts_with(rest, '{p}') and length(rest) > {len(p) + 1})" for p in P.NOUN_PREFIXES)}) as begun from n4),
    n6 as (select *, case when e = '' and not ez and derived = '' and not begun then {first('rest', P.DIMINUTIVES, 1)} else '' end as small from n5),
    n7 as (select *, e = '' and not ez and derived = '' and not begun and small = '' as free from n6), n8 as (select *, case when free then {first('rest', agents, 1)} else '' end as agent from n7),
    nouns as (select token, {_map(P.NOMINAL, 'e', 0)} as definiteness, case when {_map(P.NOMINAL, 'e', 1)} <> '' then {_map(P.NOMINAL, 'e', 1)} when n0 <> '' then n0 else 'sg' end as number, case when ez then 'ez' else '' end as gcase,
        left(rest, length(rest) - length(derived) - length(small) - length(agent)) as lemma,
        concat_ws(';', case {' '.join(f"when {_in('agent', ends)} then 'agent_noun_class={name}'" for name, ends in P.AGENTS.items())} end, case when agent <> '' then 'is_agent_noun=true' end, case when small <> '' then 'is_diminutive=true' end,
          case when {first('rest', P.ADVERB_SUFFIXES, 2)} <> '' then 'possible_adverb_derivation=from_adj_suffix' end, case when free and {first('rest', P.ADJECTIVE_DIMINUTIVES, 2)} <> '' then 'possible_diminutive_adj=true' end) as own from n8)"""


_CLITIC = "case " + " ".join(f"when ends_with(token, '{c}') and length(token) > {len(c) + 1}{" and gcase <> 'ez'" if c == 'ی' else ''} then '{c}'" for c in P.CLITICS) + " else '' end"
FEATURES = f"""{TOKENS}, {_closed_sql()}, {_verb_sql()}, {_nominal_sql()},
  open as (select v.token, case when v.verb then 'VERB' else 'NOUN' end as pos, v.tense, v.aspect, v.voice_ as voice, v.person, v.negated, v.compound_prefix, v.transitivity, coalesce(n.number, v.number) as number,
      coalesce(n.gcase, '') as gcase, coalesce(n.definiteness, '') as definiteness, case when v.inf then v.token when v.ts <> '' then v.ts when v.verb then v.token else n.lemma end as lemma, v.raw, coalesce(n.own, '') as own
    from verbs v left join nouns n on n.token = v.token),
  hosts as (select *, {_CLITIC} as cl from open),
  features as (select token, pos, person, number, '' as tense, '' as aspect, '' as gcase, '' as definiteness, '' as transitivity, '' as cl from closed
    union all select token, pos, person, number, tense, aspect, gcase, definiteness, transitivity, cl from hosts)"""


def query(sql: str):
    def add(f):
        Q[f.__name__] = f
        SQL[f.__name__] = f"with {FEATURES} {sql}"
        return f

    return add


def _distinct(spark, sf):
    return M.sentence_tokens(sentences(spark, sf), "s", *KEY).select("token").distinct()


def _raw(*names: str):
    kept = F.filter(F.map_entries("raw"), lambda e: e["key"].isin(*names)) if names else F.map_entries("raw")
    return F.array_join(F.transform(F.array_sort(kept), lambda e: F.concat_ws("=", e["key"], e["value"])), ";")


def _open(spark, sf):
    tokens = _distinct(spark, sf)
    return M.open_classes(tokens, M.closed_classes(tokens))


@query("select token, pos, person, number, lemma from closed")
def morph_closed_class(spark, sf):
    return M.closed_classes(_distinct(spark, sf)).select("token", "pos", "person", "number", "lemma")


@query("select token, case when verb then 'VERB' else '' end as pos, tense, aspect, voice_ as voice, person, number, negated, compound_prefix, transitivity, raw from verbs")
def morph_verb(spark, sf):
    return _open(spark, sf).select("token", "pos", "tense", "aspect", "voice", "person", "number", "negated", "compound_prefix", "transitivity", _raw().alias("raw"))


NOMINAL_RAW = ("agent_noun_class", "is_agent_noun", "is_diminutive", "possible_adverb_derivation", "possible_diminutive_adj")


@query("select token, number, gcase as \"case\", definiteness, lemma, own as raw from open where pos = 'NOUN'")
def morph_nominal(spark, sf):
    rows = M.nominal_features(_open(spark, sf)).where("pos = 'NOUN'")
    return rows.select("token", "number", "case", "definiteness", "lemma", _raw(*NOMINAL_RAW).alias("raw"))


@query(f"select token, cl as clitic, {_map(P.CLITICS, 'cl', 0)} as clitic_person, {_map(P.CLITICS, 'cl', 1)} as clitic_number, cl = 'ی' and pos <> 'VERB' as unclear, cl not in ('', 'ی') and ends_with(left(token, length(token) - length(cl)), 'ش') as yish from hosts")
def morph_clitic(spark, sf):
    rows = M.clitic_features(M.nominal_features(_open(spark, sf)))
    has = lambda k: F.map_contains_key("raw", k)
    return rows.select("token", F.coalesce(F.try_element_at("raw", F.lit("hosted_clitic")), F.lit("")).alias("clitic"), "clitic_person", "clitic_number", has("yi_ambiguous").alias("unclear"), has("has_yish_preclitic").alias("yish"))


@query("""
  , told as (select doc_id, p.pos as sent, i, f.pos, f.number, f.gcase, lag(f.pos) over (partition by doc_id, p.pos order by i) as b from placed p join features f on f.token = p.token)
  select doc_id, sent as pos, string_agg(pos || '/' || case when b = 'ADP' and pos in ('NOUN', 'PRON', 'ADJ') and gcase = '' then 'obl' else gcase end || '/' || case when b = 'NUM' and pos = 'NOUN' and number = 'pl' then 'sg' else number end, ' ' order by i) as tags
  from told group by doc_id, sent""")
def morph_context(spark, sf):
    """All tokens of a sentence, with their part of speech, case and number in context."""
    rows = sentences(spark, sf).select("doc_id", "pos", "s")
    return C.tags_in_context(rows, "s", "doc_id", "pos")


def _vector_sql() -> str:
    known = M.vocabulary()
    own = {"case": "gcase", "clitic_person": _map(P.CLITICS, "cl", 0), "clitic_number": _map(P.CLITICS, "cl", 1)}
    return "concat_ws(',', " + ", ".join(f"case {own.get(f, f)} when '' then {known[f'{f}:UNK']} {' '.join(f"when '{v}' then {known[f'{f}:{v}']}" for v in values)} else 0 end" for f, values in P.FEATURES.items()) + ")"


@query(f"select token, {_vector_sql()} as vector from features")
def morph_vectors(spark, sf):
    return M.token_features(_distinct(spark, sf)).select("token", F.array_join(M.vector().cast("array<string>"), ",").alias("vector"))
