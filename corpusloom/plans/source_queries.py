"""Queries on source formats and the dictionary joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.operators import lexicon as L
from corpusloom.operators import spelling as P
from corpusloom.plans.tables import PAIRS, pairs, table
from corpusloom.sources import readers as R

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _lines(spark, texts: list[str]):
    return spark.createDataFrame(list(enumerate(texts)), "line_no long, text string")


M2 = ["S a b c", "A 1 2|||R:X|||d|||REQUIRED|||-NONE-|||0", "", "S e f", "A 0 1|||M:Y|||g h|||REQUIRED|||-NONE-|||1", "A 1 1|||U|||", "A bad", ""]


@query("select * from (values (1, 'a b c', 1, 2, 'R:X', 'd', 0), (2, 'e f', 0, 1, 'M:Y', 'g h', 1), (2, 'e f', 1, 1, 'U', '', 0)) t(sent_id, source, start, stop, error_type, correction, annotator)")
def m2_parse(spark, sf):
    rows = R.parse_m2(_lines(spark, M2)).select("sent_id", "source", F.inline("edits"))
    return rows.withColumnRenamed("end", "stop").withColumn("sent_id", F.col("sent_id").cast("int"))


@query("select * from (values (1, 'S a b c' || chr(10) || 'A 1 2|||R:X|||d|||REQUIRED|||-NONE-|||0' || chr(10)), (2, 'S e f' || chr(10) || 'A 0 1|||M:Y|||g h|||REQUIRED|||-NONE-|||1' || chr(10) || 'A 1 1|||U||||||REQUIRED|||-NONE-|||0' || chr(10))) t(sent_id, block)")
def m2_roundtrip(spark, sf):
    return R.format_m2(R.parse_m2(_lines(spark, M2))).withColumn("sent_id", F.col("sent_id").cast("int"))


@query(f"with {PAIRS} select doc_id, pos, source, reference as target from pairs")
def jsonl_pairs(spark, sf):
    """Pairs written as JSON lines and parsed again."""
    rows = pairs(spark, sf).select("doc_id", "pos", F.to_json(F.struct("source", F.col("reference").alias("target"), F.lit(1).alias("extra"))).alias("text"))
    return R.parse_pairs(rows).where(~F.col("bad")).select("doc_id", "pos", "source", "target")


@query(r"select page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b[^>]*>.*?</script>', ' ', 'g'), '(?is)<style\b[^>]*>.*?</style>', ' ', 'g'), '(?is)<table\b[^>]*>.*?</table>', ' ', 'g'), '(?is)<sup\b[^>]*>.*?</sup>', ' ', 'g'), '(?s)<!--.*?-->|<[^>]*>', ' ', 'g'), '[\s\x0B\x{85}\x{A0}]+', ' ', 'g'), '^ | $', '', 'g') as text from pages")
def html_text(spark, sf):
    return table(spark, sf, "pages").select("page_id", R.html_text(F.col("html")).alias("text"))


DICTIONARY = ["4", "کتێب/N po:noun st:کتێب lem:کتێب", "چوو/I po:verb st:چوو", "چ/T po:verb st:چ", "ماڵ/NP po:noun"]
AFFIXES = ["SFX N Y 2", "SFX N 0 ەکە .", "SFX N 0 ان [^ا]", "PFX P N 1", "PFX P 0 نا .", "SFX I Y 1", "SFX I و ووم وو?", "TRY abc"]
WORDS = ["کتێبەکە", "کتێبان", "ناماڵ", "ماڵەکە", "چووەکە", "نییە"]


def _dictionary(spark):
    return R.parse_dictionary(_lines(spark, DICTIONARY))


def _affixes(spark):
    return R.parse_affixes(_lines(spark, AFFIXES))


_DIC = "(values ('کتێب', 'N', 'noun'), ('چوو', 'I', 'verb'), ('چ', 'T', 'verb'), ('ماڵ', 'NP', 'noun')) d(surface, flags, pos)"
_AFF = "(values ('SFX', 'N', '', 'ەکە', '.'), ('SFX', 'N', '', 'ان', '[^ا]'), ('PFX', 'P', '', 'نا', '.'), ('SFX', 'I', 'و', 'ووم', 'وو?')) a(kind, flag, strip, \"add\", condition)"
_WORDS = "(select unnest([" + ", ".join(f"'{w}'" for w in WORDS) + "]) as word) w"


@query(f"select * from {_DIC}")
def dictionary_parse(spark, sf):
    return _dictionary(spark).select("surface", "flags", "pos")


@query(f"select * from {_AFF}")
def affix_parse(spark, sf):
    return _affixes(spark)


@query(
    f"""select word, surface as base, kind, "add" from {_WORDS}, {_DIC}, {_AFF} where contains(flags, flag) and case when kind = 'SFX' then ends_with(word, "add") and surface = substr(word, 1, length(word) - length("add")) || strip and regexp_matches(surface, condition || '$')
      else starts_with(word, "add") and surface = strip || substr(word, length("add") + 1) and regexp_matches(surface, '^' || condition) end"""
)
def affix_decompose(spark, sf):
    words = spark.createDataFrame([(w,) for w in WORDS], "word string")
    return L.decompose(words, _dictionary(spark), _affixes(spark)).select("word", "base", "kind", "add")


#: An affix file for Latin words, and a dictionary of the benchmark's words, whose flags their digests choose.
LATIN = ["TRY eé", "SFX A Y 3", "SFX A 0 s .", "SFX A e ing e", "SFX A 0 er [^e]", "PFX A Y 2", "PFX A 0 re .", "PFX A e in e", "SFX B Y 1", "SFX B 0 ed .", "PFX B N 1", "PFX B 0 un .", "REP 1", "REP ph f"]


def _latin(spark):
    lines = _lines(spark, LATIN)
    return R.parse_affixes(lines), R.parse_affix_headers(lines)


def _latin_dictionary(spark, sf):
    words = table(spark, sf, "documents").select(F.explode(F.split(F.lower(F.coalesce("text", F.lit(""))), r"[^a-zé]+")).alias("surface")).where("surface <> ''").distinct()
    h = F.substring(F.md5("surface"), 1, 1)
    return words.where(h < "c").select("surface", F.when(h < "6", "A").when(h < "9", "B").otherwise("AB").alias("flags"), F.lit("").alias("pos"))


_LATIN_SQL = """with words as (select distinct unnest(regexp_split_to_array(lower(coalesce(text, '')), '[^a-zé]+')) as word from documents), dic as (select word as surface, case when substr(md5(word), 1, 1) < '6' then 'A' when substr(md5(word), 1, 1) < '9' then 'B' else 'AB' end as flags from words where word <> '' and substr(md5(word), 1, 1) < 'c'),
  sfx as (select * from (values ('A', '', 's', '.'), ('A', 'e', 'ing', 'e'), ('A', '', 'er', '[^e]'), ('B', '', 'ed', '.')) s(flag, strip, "add", cond)), pfx as (select * from (values ('A', '', 're', '.', true), ('A', 'e', 'in', 'e', true), ('B', '', 'un', '.', false)) p(flag, strip, "add", cond, crosses)),
  ended as (select surface, s.flag, s."add" as suffix, substr(surface, 1, length(surface) - length(strip)) || s."add" as middle from dic join sfx s on contains(flags, s.flag) where ends_with(surface, strip) and regexp_matches(surface, cond || '$')),
  both_ as (select surface, e.flag, suffix, p."add" as prefix, p."add" || substr(middle, length(p.strip) + 1) as form from ended e join pfx p on p.flag = e.flag and p.crosses where starts_with(middle, p.strip) and regexp_matches(middle, '^' || p.cond))"""


@query(f"{_LATIN_SQL} select distinct form as word, surface as base, prefix, suffix, flag from both_ where form in (select word from words where word <> '')")
def affix_two_sided(spark, sf):
    """Words of all documents that a prefix and a suffix make of a word of the dictionary."""
    words = table(spark, sf, "documents").select(F.explode(F.split(F.lower(F.coalesce("text", F.lit(""))), r"[^a-zé]+")).alias("word")).where("word <> ''")
    return L.decompose_both(words, _latin_dictionary(spark, sf), *_latin(spark)).select("word", "base", "prefix", "suffix", "flag")


@query(
    f"""{_LATIN_SQL}, begun as (select surface, p.flag, p."add" || substr(surface, length(p.strip) + 1) as form, crosses from dic join pfx p on contains(flags, p.flag) where starts_with(surface, p.strip) and regexp_matches(surface, '^' || p.cond)),
    two as (select b.surface, b.flag, substr(b.form, 1, length(b.form) - length(s.strip)) || s."add" as form from begun b join sfx s on s.flag = b.flag where b.crosses and ends_with(b.form, s.strip) and regexp_matches(b.form, s.cond || '$'))
    select flag, count(*) as n, count(distinct form) as forms from (select surface, flag, surface as form from dic, (values ('A'), ('B')) f(flag) where contains(flags, flag) union select surface, flag, middle from ended union select surface, flag, form from begun union select * from two) group by flag"""
)
def affix_forms(spark, sf):
    """All forms of the dictionary's words, counted by flag."""
    return L.forms(_latin_dictionary(spark, sf), *_latin(spark)).groupBy("flag").agg(F.count("*").alias("n"), F.countDistinct("form").alias("forms"))


@query(f"""select surface as base, case when kind = 'SFX' then substr(surface, 1, length(surface) - length(strip)) || "add" else "add" || substr(surface, length(strip) + 1) end as form from {_DIC}, {_AFF} where contains(flags, flag) and case when kind = 'SFX' then ends_with(surface, strip) and regexp_matches(surface, condition || '$') else starts_with(surface, strip) and regexp_matches(surface, '^' || condition) end""")
def affix_generate(spark, sf):
    return L.generate(_dictionary(spark), _affixes(spark)).select("base", "form")


@query(f"select word, surface as stem from {_WORDS}, {_DIC} where pos = 'verb' and starts_with(word, surface) qualify row_number() over (partition by word order by length(surface) desc) = 1")
def verb_stem(spark, sf):
    words = spark.createDataFrame([(w,) for w in WORDS], "word string")
    return L.verb_stem(words, _dictionary(spark)).select("word", "stem")


@query(f"select word, word in (select surface from {_DIC}) or word in ('کتێبەکە', 'کتێبان', 'ناماڵ', 'ماڵەکە') as valid from {_WORDS}")
def spell_valid(spark, sf):
    words = spark.createDataFrame([(w,) for w in WORDS], "word string")
    return L.valid(words, _dictionary(spark), _affixes(spark))


REPLACEMENTS = [(0, "ك", "ک"), (1, "ي", "ی"), (2, "مال", "ماڵ")]


def _suggestions(spark, tokens):
    return P.suggestions(tokens, _dictionary(spark), _affixes(spark), spark.createDataFrame(REPLACEMENTS, "rule_no int, pattern string, replacement string"))


_NOISY = ("كتێب", "مال", "کتێبەکە", "کتێو", "نەزانراو")


def _noisy(spark, sf):
    """Pairs' words in groups of five, each replaced by one that has a suggestion of its own kind."""
    words = F.array(*map(F.lit, _NOISY))
    return pairs(spark, sf).select("doc_id", "pos", F.concat_ws(" ", F.element_at(words, (F.pmod("doc_id", F.lit(5)) + 1).cast("int")), F.concat(F.element_at(words, (F.pmod("pos", F.lit(5)) + 1).cast("int")), F.lit("؟"))).alias("s"))


_FIXED = "['کتێب', 'ماڵ', 'کتێبەکە', 'کتێب', 'نەزانراو']"


@query(f"with {PAIRS} select doc_id, pos, {_FIXED}[doc_id % 5 + 1] || ' ' || {_FIXED}[pos % 5 + 1] || '؟' as s from pairs")
def spell_sentences(spark, sf):
    rows = _noisy(spark, sf)
    return P.correct_sentences(rows, "s", "doc_id", "pos", found=_suggestions(spark, P.cores(rows, "s")))


@query("select * from (values ('كتێب', 'کتێب'), ('مال', 'ماڵ'), ('کتێبەکە', 'کتێبەکە'), ('کتێو', 'کتێب'), ('نەزانراو', 'نەزانراو')) t(word, suggestions)")
def spell_suggestions(spark, sf):
    rows = _suggestions(spark, P.cores(_noisy(spark, sf), "s"))
    return rows.select("word", F.array_join("suggestions", "|").alias("suggestions"))


@query()
def augment_synonyms(spark, sf):
    rows = _noisy(spark, sf).select("doc_id", "pos", F.col("s").alias("source"), F.col("s").alias("target"), F.element_at(F.array(F.lit("swap"), F.lit("delete"), F.lit("synonym")), (F.pmod("doc_id", F.lit(3)) + 1).cast("int")).alias("strategy"))
    return P.augment_pairs(rows, "doc_id", "pos", found=_suggestions(spark, P.cores(rows, "source")))


@query("select * from (values ('چوو', false, true), ('چ', true, false)) t(surface, transitive, intransitive)")
def verb_transitivity(spark, sf):
    rows = P.with_transitivity(_dictionary(spark)).where("pos = 'verb'")
    return rows.select("surface", "transitive", "intransitive")
