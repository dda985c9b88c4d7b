"""Queries on normalization, tokenization, filters and language scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import filters as S
from corpusloom.functions import profile as P
from corpusloom.functions import text as T
from corpusloom.operators import flow as W
from corpusloom.operators.augment import random_deletion, random_swap
from corpusloom.operators.unicode import nfc
from corpusloom.plans.tables import AR, SENTS, script_sentences, sentences, table

Q: dict = {}
SQL: dict[str, str] = {}
KEY = ("doc_id", "pos")


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _q(s: str) -> str:
    return s.replace("'", "''")


_STRIP = r"regexp_replace({}, '^[\s\x0B\x{{85}}\x{{A0}}]+|[\s\x0B\x{{85}}\x{{A0}}]+$', '', 'g')"
_GONE = P.TATWEEL + P.ZERO_WIDTH
_MAP = f"translate({{}}, '{''.join(P.CHAR_MAP)}{_GONE}', '{''.join(P.CHAR_MAP.values())}')"
_HEH = f"regexp_replace(regexp_replace({{0}}, '([{P.HEH_CONTEXT}])ه', '\\1ە', 'g'), '([{P.HEH_CONTEXT}])ه', '\\1ە', 'g')"
_SPACES = r"regexp_replace(regexp_replace(regexp_replace({}, '[ \t]+', ' ', 'g'), '\r\n?', chr(10), 'g'), '\n{{3,}}', chr(10) || chr(10), 'g')"
_WORDS = r"list_filter(regexp_split_to_array({}, '[\s\x0B\x{{85}}\x{{A0}}]+'), lambda w: w <> '')"


def _count(text: str) -> str:
    return f"len({_WORDS.format(f'replace({text}, chr(8204), chr(32))')})"


@query(f"with {AR} select doc_id, pos, {_MAP.format('s')} as out from ar")
def nrm_charmap(spark, sf):
    return script_sentences(spark, sf).select(*KEY, T.map_chars(F.col("s")).alias("out"))


@query(f"with {AR} select doc_id, pos, {_HEH.format('s')} as out from ar")
def nrm_heh(spark, sf):
    return script_sentences(spark, sf).select(*KEY, T.fold_heh(F.col("s")).alias("out"))


@query(f"select doc_id, {_STRIP.format(_SPACES.format('text'))} as out from documents")
def nrm_whitespace(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.whitespace(F.col("text")).alias("out"))


@query(f"with {AR} select doc_id, pos, {_STRIP.format(_SPACES.format(_HEH.format(_MAP.format('s'))))} as out from ar")
def nrm_full(spark, sf):
    return script_sentences(spark, sf).select(*KEY, T.normalize(F.col("s")).alias("out"))


@query(
    f"with {AR}"
    + r""" select doc_id, pos, regexp_replace(regexp_replace(regexp_replace(replace(regexp_replace(regexp_replace(regexp_replace(
      regexp_replace(replace(s, ',', '،'), '[\s\x0B\x{85}\x{A0}]+([.،؟!۔:;])', '\1', 'g'), '،{2,}', '،', 'g'), '،([؀-ۿ])', '، \1', 'g'), ':([؀-ۿ])', ': \1', 'g'),
      '...', '…'), '\.{2,}', '.', 'g'), '([؟!])\.', '\1', 'g'), '…([؀-ۿ])', '… \1', 'g') as out from ar"""
)
def nrm_punct(spark, sf):
    return script_sentences(spark, sf).select(*KEY, T.punctuation(F.col("s")).alias("out"))


_PAREN = r"regexp_replace({}, '\([^)]+\)([\s.،؟!۔:;]|$)', '\1', 'g')"


@query(f"with {SENTS} select doc_id, pos, {_STRIP.format(f"regexp_replace({_PAREN.format(_PAREN.format(_PAREN.format(_PAREN.format(_PAREN.format('s')))))}, ' {{2,}}', ' ', 'g')")} as out from sents")
def nrm_parens(spark, sf):
    return sentences(spark, sf).select(*KEY, T.strip_parentheticals(F.col("s")).alias("out"))


@query(
    r"""select page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html,
    '\[\[(?:[^|\]]*\|)?([^\]]*)\]\]', '\1', 'g'), '\{\{[^}]*\}\}', '', 'g'), '\[https?://[^\]]*\]', '', 'g'), '<ref[^>]*>.*?</ref>', '', 'g'), '<ref[^/]*/>', '', 'g'), '''{2,}', '', 'g'),
    '<[^>]+>', '', 'g'), '==+[^=]+=+', '', 'g'), '[\s\x0B\x{85}\x{A0}]+', ' ', 'g'), '^ | $', '', 'g') as out from pages"""
)
def nrm_wiki(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.wiki_markup(F.col("html")).alias("out"))


@query(f"with {SENTS} select doc_id, pos, s as out from sents")
def sentence_split(spark, sf):
    return sentences(spark, sf).select(*KEY, F.col("s").alias("out"))


@query(f"with {SENTS} select doc_id, pos, array_to_string({_WORDS.format('s')}, '|') as out, len({_WORDS.format('s')}) as n from sents")
def word_tokens(spark, sf):
    w = T.words(F.col("s"))
    return sentences(spark, sf).select(*KEY, F.array_join(w, "|").alias("out"), F.size(w).cast("long").alias("n"))


_TOKENS = rf"regexp_extract_all(regexp_replace(s, '(^|\s)و([{P.WAW_BEFORE}])', '\1و \2', 'g'), '[{P.TOKEN_LETTERS}]+|[۰-۹0-9]+|[a-zA-Z]+|[^\s]')"


@query(f"with {AR} select doc_id, pos, array_to_string({_TOKENS}, '|') as out from ar")
def regex_tokens(spark, sf):
    return script_sentences(spark, sf).select(*KEY, F.array_join(T.tokens(F.col("s")), "|").alias("out"))


@query(f"with {AR} select doc_id, pos, len({_TOKENS}) as tokens, {_count('s')} as words, list_unique({_TOKENS}) as types from ar")
def token_count(spark, sf):
    t = T.tokens(F.col("s"))
    return script_sentences(spark, sf).select(*KEY, F.size(t).cast("long").alias("tokens"), T.count_tokens(F.col("s")).cast("long").alias("words"), F.size(F.array_distinct(t)).cast("long").alias("types"))


@query(rf"with {AR} select doc_id, pos, regexp_replace(array_to_string({_TOKENS}, ' '), ' ([،؛؟۔.!:;)\]}}»])( |$)', '\1\2', 'g') as out from ar where not regexp_matches(s, '[،؛؟۔.!:;)\]}}»]\s*[،؛؟۔.!:;)\]}}»]')")
def join_tokens(spark, sf):
    rows = script_sentences(spark, sf).where(~F.col("s").rlike(r"[،؛؟۔.!:;)\]}»]\s*[،؛؟۔.!:;)\]}»]"))
    return rows.select(*KEY, T.join_tokens(T.tokens(F.col("s"))).alias("out"))


@query()
def join_tokens_all(spark, sf):
    """join_tokens() of every sentence; RE2 can't express it where closing marks stand side by side."""
    return script_sentences(spark, sf).select(*KEY, T.join_tokens(T.tokens(F.col("s"))).alias("out"))


_LINES = "lines as (select doc_id, unnest(l) as s, generate_subscripts(l, 1) - 1 as pos from (select doc_id, string_split(text, chr(10)) as l from documents))"


def lines(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "s"))


_VIS = r"length(regexp_replace({}, '[\s\x0B\x{{85}}\x{{A0}}]+', '', 'g'))"
_ARN = f"len(regexp_extract_all({{}}, '[{P.ARABIC}]'))"
_PROSE = f"({_VIS.format('s')} = 0 or {_ARN.format('s')} < 0.3 * {_VIS.format('s')} or ({_VIS.format('s')} > 5 and len(regexp_extract_all(s, '\\p{{Nd}}')) > 0.5 * {_VIS.format('s')}))"
_SCRIPT = f"({_VIS.format('s')} > 0 and {_ARN.format('s')} >= 0.5 * {_VIS.format('s')} and len(regexp_extract_all(s, '[a-zA-Z]')) <= 0.3 * {_VIS.format('s')})"
_REPEAT = "(coalesce(list_aggregate(list_transform(range(1, greatest(length(s) - 3, 1)), lambda i: (length(s) >= 5 and substr(s, i, 5) = repeat(substr(s, i, 1), 5) and substr(s, i, 1) <> chr(10))::int), 'sum'), 0) > 0)"
_OCR = r"regexp_matches(s, '(?i)(?:^|\s)(?:Wait|Item|Let''s|Check|OK|Actually|Sure|Note)(?:[,:\s]|$)')"
_SHORT = f"list_aggregate(list_transform({_WORDS.format('replace(s, chr(8204), chr(32))')}, lambda w: (w in ({', '.join(f"'{a}'" for a in P.ABBREVIATIONS)}))::int), 'min')"
_LENGTH = f"(case when {_count('s')} > 200 then false when {_count('s')} < 3 then coalesce({_SHORT}, 1) = 1 else true end)"
_FRAGMENT = r"(regexp_matches(s, '(?::|\.\.\.|…)\s*$') or not regexp_matches(s, '[.؟!۔)]\s*$'))"
_FORMULA = r"regexp_matches(s, '[←→≠≈]|\s[+=]\s')"


@query(
    f"with {AR} select doc_id, pos, regexp_matches(s, '[Ã¯Â»¿‚©«¨¼¶¤ï]{{3,}}') as mojibake, regexp_matches(s, '(^|[^؀-ۿ])[ً-ٟ]') as malformed, {_PROSE} as non_prose, {_REPEAT} as repetition, {_OCR} as ocr, {_SCRIPT} as script_ok, {_LENGTH} as length_ok, {_FORMULA} as formula, {_FRAGMENT} as fragment from ar"
)
def san_flags(spark, sf):
    s = F.col("s")
    flags = {"mojibake": S.mojibake, "malformed": S.malformed_diacritics, "non_prose": S.non_prose, "repetition": S.repetition, "ocr": S.ocr_phrases, "script_ok": S.script_ratio_passes, "length_ok": S.length_passes, "formula": S.formula, "fragment": S.fragment}
    return script_sentences(spark, sf).select(*KEY, *(f(s).alias(n) for n, f in flags.items()))


_REASON = f"case when s = '' then 'empty_after_strip' when regexp_matches(s, '[Ã¯Â»¿‚©«¨¼¶¤ï]{{3,}}') then 'mojibake' when regexp_matches(s, '(^|[^؀-ۿ])[ً-ٟ]') then 'malformed_diacritics' when {_PROSE} then 'non_prose' when {_REPEAT} then 'excessive_repetition' when {_OCR} then 'gemini_artifact' when not {_SCRIPT} then 'low_script_ratio' when not {_LENGTH} then case when {_count('s')} > 200 then 'too_long' else 'too_short' end end"


@query(f"with {AR} select coalesce({_REASON}, 'kept') as reason, count(*) as n from ar group by 1")
def san_reason_hist(spark, sf):
    return script_sentences(spark, sf).groupBy(F.coalesce(S.sanitize_reason(F.col("s")), F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


@query(
    f"with {_LINES}"
    + r""" select doc_id, pos, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(s,
    '(?i)https?://[^\s<>"]+|ftp://[^\s<>"]+|www\.[^\s<>"]+', '', 'g'), '[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}', '', 'g'), '(?i)\[\s*(?:\d+|citation needed|note\s*\d*)\s*\]', '', 'g'), '\{\{[^}]*\}\}', '', 'g'),
    '[#@][\p{L}\p{M}\p{Nd}\p{Pc}]+', '', 'g'), '---\s*Page\s+[۰-۹\d]+\s*---', '', 'g'), '\$[^$]+\$', '', 'g'),
    '^[\x{200C}\x{200D}]?\s*(?:[۰-۹0-9]+\s*[-).:]+\s*|[ؠ-ە][ـ\x{200C}]?\s*[-).:]+\s*|[a-zA-Z]\s*[-).:]+\s*|ـ+\s*|[-–—]\s+|پ[۰-۹0-9]+\s*[/:]\s*)', '', 'g'), '[²³¹⁰-⁹]', '', 'g'),
    '[\s\x0B\x{85}\x{A0}]{2,}', ' ', 'g'), '^[\s\x0B\x{85}\x{A0}]+|[\s\x0B\x{85}\x{A0}]+$', '', 'g') as out from lines"""
)
def san_strip(spark, sf):
    return lines(spark, sf).select(*KEY, S.strip_artifacts(F.col("s")).alias("out"))


def _split_sql(most: int) -> str:
    """Parts at clause ends, merged again from the left while they fit."""
    clauses = r"string_split(regexp_replace(s, '([.،؛;:!?؟۔])[ \t\n\x0B\f\r]+', '\1' || chr(1), 'g'), chr(1))"
    parts = f"list_filter(list_transform({clauses}, lambda x: {_STRIP.format('x')}), lambda x: x <> '')"
    both = "acc.now || ' ' || x.now"
    step = f"case when {_count(both)} <= {most} then {{'done': acc.done, 'now': {both}}} else {{'done': list_append(acc.done, acc.now), 'now': x.now}} end"
    merged = f"list_reduce(list_transform({parts}, lambda x: {{'done': []::varchar[], 'now': x}}), lambda acc, x: {step})"
    return f"""with {_LINES}, m as (select doc_id, pos, case when {_count('s')} > {most} then (select list_append(r.done, r.now) from (select {merged} as r)) else [s] end as parts from lines)
      select doc_id, pos, unnest(parts) as out, generate_subscripts(parts, 1) - 1 as part from m"""


@query(_split_sql(40))
def san_split_long(spark, sf):
    return lines(spark, sf).select(*KEY, F.posexplode(S.split_long(F.col("s"), 40)).alias("part", "out"))


def _gate_sql() -> str:
    out = [f"when {_count('s')} < 5 then 'too_few_tokens' when {_count('s')} > 40 then 'too_many_tokens' when strlen(s) > 480 then 'too_many_bytes' when {_FRAGMENT} then 'fragment'"]
    out += [f"when regexp_matches(s, '{_q(p)}') then '{n}'" for n, p in S.GATE_PATTERNS if p]
    out += [f"when {_VIS.format('s')} - {_ARN.format('s')} > 0.30 * {_VIS.format('s')} then 'low_arabic_ratio'", "when " + " or ".join(f"contains(s, '{b}')" for b in P.BOILERPLATE) + " then 'boilerplate'"]
    return "case " + " ".join(out) + " end"


@query(f"with {AR} select coalesce({_gate_sql()}, 'kept') as reason, count(*) as n from ar group by 1")
def gate_reason_hist(spark, sf):
    return script_sentences(spark, sf).groupBy(F.coalesce(S.gate_reason(F.col("s")), F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


@query(f"with {AR} select doc_id, pos, s as out from ar where {_gate_sql()} is null")
def gate_kept(spark, sf):
    return script_sentences(spark, sf).where(S.gate_reason(F.col("s")).isNull()).select(*KEY, F.col("s").alias("out"))


def _ratio(a: str, b: str) -> str:
    return f"({a}) / ({b})::double"


def _list(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def _detect_sql() -> str:
    both = sorted(set(P.CKB_WORDS) & (set(P.ARB_WORDS) | set(P.FAS_WORDS)))
    own = sorted(set(P.CKB_WORDS) - set(both))
    only = f"len(regexp_extract_all(s, '[{P.KURDISH_ONLY_CHARS}]'))"
    hit = lambda w: f"len(list_intersect(low, {_list(w)}))"
    return f"""{AR}, a as (select doc_id, lang, pos, s, length(translate(s, ' ' || chr(9) || chr(10), '')) as n, {_WORDS.format('s')} as w from ar),
    b as (select *, list_distinct(list_transform(w, lambda x: lower(x))) as low, len(regexp_extract_all(s, '[؀-ۿﭐ-﷿ﹰ-﻿]')) / n::double as ra, len(regexp_extract_all(s, '[{P.KURDISH_CHARS}]')) / n::double as rk,
      {only} as ko, len(regexp_extract_all(s, '[a-zA-Z]')) / n::double as rl, greatest(len(w), 1)::double as nw, len(regexp_extract_all(s, '(?:^|\\s)(?:دە|ئە|نا|بی?)\\S{{2,}}')) as verbs from a),
    c as (select *, least((case when ra > 0.7 then 0.4::double when ra > 0.5 then 0.2 else 0 end + case when rk > 0.10 then 0.35::double when rk > 0.05 then 0.25 when rk > 0.02 then 0.15 when ko > 0 then 0.05 else 0 end
      + case when ko >= 3 then 0.25::double when ko >= 1 then 0.15 else 0 end) * case when rl > 0.3 then 0.3::double else 1 end, 1::double) as script,
      {hit(own)} + {hit(both)} * 0.5::double as oh, least({hit(P.KMR_WORDS)} / nw, 1) as kmr, least({hit(P.ARB_WORDS)} / nw, 1) as arb, least({hit(P.FAS_WORDS)} / nw, 1) as fas,
      least(case when verbs >= 2 then 0.4::double when verbs >= 1 then 0.25 else 0 end + case when regexp_matches(s, '\\S+(?:ەکە|یەکە|ەکان|یەکان)(\\s|$)') then 0.3::double else 0 end
      + case when regexp_matches(s, '\\S+(?:ێک|ێکی)(\\s|$)') then 0.15::double else 0 end + case when len(regexp_extract_all(s, 'ە')) > 0.06::double * length(replace(s, ' ', '')) then 0.15::double else 0 end, 1::double) as morph from b),
    d as (select *, least(oh / nw, 1) as own from c),
    e as (select *, greatest(kmr, arb, fas) as most, case when kmr > own and kmr > 0.05 then 'kmr' when arb > own and arb > 0.1 then 'arb' when fas > own and fas > 0.1 then 'fas'
      when greatest(kmr, arb, fas) > 0.15 and own < 0.05 then case when kmr >= arb and kmr >= fas then 'kmr' when arb >= fas then 'arb' else 'fas' end end as rival from d),
    f as (select *, case when oh = 0 and most = 0 then 0.5::double else least(own * 3.0::double * case when kmr > own and kmr > 0.05 then 0.3::double when arb > own and arb > 0.1 then 0.2 when fas > own and fas > 0.1 then 0.2
      when most > 0.15 and own < 0.05 then 0.4 else 1 end, 1::double) end as words from e),
    g as (select *, (0.35::double * script + 0.40::double * words + 0.25::double * morph) * case when len(w) < 2 then 0.7::double else 1 end * case when ko = 0 and len(w) > 5 then 0.5::double else 1 end as conf from f)"""


@query(f"with {_detect_sql()} select doc_id, pos, floor(round_even(conf, 4) * 1000 + 1e-6)::bigint as confidence, floor(round_even(script, 4) * 1000 + 1e-6)::bigint as script_score, floor(round_even(words, 4) * 1000 + 1e-6)::bigint as word_score, floor(round_even(morph, 4) * 1000 + 1e-6)::bigint as morph_score from g")
def detect_scores(spark, sf):
    rows = script_sentences(spark, sf).withColumn("d", S.detect(F.col("s")))
    whole = lambda c: F.floor(F.col(f"d.{c}") * 1000 + 1e-6).cast("long")
    return rows.select(*KEY, whole("confidence").alias("confidence"), whole("script_score").alias("script_score"), whole("function_word_score").alias("word_score"), whole("morphology_score").alias("morph_score"))


@query(f"with {_detect_sql()} select lang, case when conf >= 0.55 then 'ckb' else coalesce(case when len(w) > 0 and not (oh = 0 and most = 0) then rival end, 'unknown') end as label, count(*) as n from g group by 1, 2")
def detect_label_by_lang(spark, sf):
    rows = script_sentences(spark, sf).withColumn("d", S.detect(F.col("s")))
    return rows.groupBy("lang", F.col("d.label").alias("label")).agg(F.count("*").alias("n"))


@query(f"with {_detect_sql()} select doc_id, pos, s as out from g where conf >= 0.55 and length(s) > 20 and length(s) < 500")
def detect_filter(spark, sf):
    s = F.col("s")
    return script_sentences(spark, sf).where((F.length(s) > 20) & (F.length(s) < 500) & S.detect(s)["is_sorani"]).select(*KEY, s.alias("out"))


@query(f"with {_detect_sql()} select case when not (length(s) > 20 and length(s) < 500) then 'length' when conf >= 0.55 then 'kept' else 'not_sorani' end as reason, count(*) as n from g group by 1")
def detect_filter_counts(spark, sf):
    return W.drop_reasons(W.language_filtered(script_sentences(spark, sf), "s"))


_NAMES = ["morphology_thesis.txt", "historical_kurdistan.txt", "random_file_12345.txt", "law_journal.txt", "AI_notes.txt", "poetry_and_novel.txt", "data_market_math.txt", "سیاسی.txt"]


def _category_sql() -> str:
    score = {c: " + ".join(f"(contains(lower(name), '{h}') or contains(name, '{h}'))::int" for h in hints) for c, hints in P.HINTS.items()}
    best = "greatest(" + ", ".join(f"s_{c}" for c in score) + ")"
    return f"select name, case when {best} = 0 then 'general' " + " ".join(f"when s_{c} = {best} then '{c}'" for c in score) + " end as category from (select name, " + ", ".join(f"{v} as s_{c}" for c, v in score.items()) + " from (select unnest(" + _list(_NAMES) + ") as name union all select distinct source from documents))"


@query(_category_sql())
def infer_category(spark, sf):
    names = spark.createDataFrame([(n,) for n in _NAMES], "name string").union(table(spark, sf, "documents").select("source").distinct())
    return names.select("name", S.infer_category(F.col("name")).alias("category"))


@query("select doc_id, nfc_normalize(text) as out from documents")
def nrm_nfc(spark, sf):
    return table(spark, sf, "documents").select("doc_id", nfc(F.col("text")).alias("out"))


_DRAW = "('0x' || substr(md5('{}:42:' || doc_id || ':' || pos || ':' || {}), 1, 8))::bigint"


@query(f"with {SENTS}, w as (select doc_id, pos, {_WORDS.format('s')} as w from sents), k as (select *, list_filter(list_transform(range(1, len(w) + 1), lambda i: case when {_DRAW.format('delete', '(i - 1)')} >= 429496729 then w[i] end), lambda x: x is not null) as k from w) select doc_id, pos, array_to_string(case when len(k) > 0 then k else w[1:1] end, ' ') as out from k")
def augment_deletion(spark, sf):
    return sentences(spark, sf).select(*KEY, random_deletion(F.col("s"), F.concat_ws(":", *KEY)).alias("out"))


@query(f"with {SENTS}, w as (select doc_id, pos, {_WORDS.format('s')} as w from sents), i as (select *, {_DRAW.format('swap', '0')} % greatest(len(w) - 1, 1) + 1 as i from w) select doc_id, pos, array_to_string(case when len(w) > 1 then list_transform(range(1, len(w) + 1), lambda k: case when k = i then w[i + 1] when k = i + 1 then w[i] else w[k] end) else w end, ' ') as out from i")
def augment_swap(spark, sf):
    return sentences(spark, sf).select(*KEY, random_swap(F.col("s"), F.concat_ws(":", *KEY)).alias("out"))
