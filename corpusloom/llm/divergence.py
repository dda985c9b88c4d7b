"""How a source's vocabulary differs from the other sources of its language: relational from end to end.

Terms are counted by group (language and source) in one pass; a language keeps the terms that enough of its documents hold. Groups
meet the kept vocabulary, so that terms that a group lacks have a share, too; a self-join of this table on language and term gives
the distance of each two sources.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import scratch, text_or_empty

# What stands between terms, and the letters that change case.
BETWEEN = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Added to each count of a term, and the whole that shares are parts of.
PRIOR, WHOLE = 5, 1_000_000_000
#: Parts of a language in the join of groups with the vocabulary: a language that holds most rows is spread over as many tasks.
SALTS = 64


def term_counts(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """lang, source, term, n (occurrences), d (documents with it). What is before, behind or instead of terms counts as the empty term, so
    each group has a row.

    Texts are split at what is no term: that takes time in proportion to a text, while regexp_extract_all copies it for each match.
    """
    terms = F.split(F.translate(text_or_empty(text), UPPER, UPPER.lower()), BETWEEN)
    rows = docs.select(text_or_empty(lang).alias("lang"), text_or_empty(source).alias("source"), F.sort_array(terms).alias("terms"))
    first = F.transform("terms", lambda t, i: F.struct(t.alias("term"), ((i == 0) | (t != F.get("terms", i - 1))).cast("int").alias("first")))
    rows = rows.select("lang", "source", F.explode(first).alias("t"))
    return rows.groupBy("lang", "source", "t.term").agg(F.count("*").alias("n"), F.sum("t.first").alias("d"))


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(WHOLE * (count + PRIOR) / (total + PRIOR * terms)), exactly, as long."""
    return F.lit(1).cast("long") + F.call_function("div", (count + PRIOR).cast("decimal(20,0)") * F.lit(WHOLE).cast("decimal(10,0)"), (total + terms * PRIOR).cast("decimal(20,0)"))


def divergence(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least_docs: int = 30, top: int = 50) -> DataFrame:
    """lang, source, part, item, value, rank: see the module's head.

    part 'pair': item is each other source of the language, value the sum of the distances of their shares over all kept terms (0 where
    the language keeps none). part 'term': item is each kept term that the group holds and has a larger share of than its language,
    value the difference, of which the `top` largest are returned. rank counts from 1 per group and part by falling value, then by the
    item's bytes.

    Null text, lang and source count as empty; the empty string is a language or a source like others. Each row is a document: repeated
    rows and ids count again. A group without terms has pairs, too. A language with one source has no pairs. An empty table gives no
    rows; columns besides the three are not read, and their names cannot clash. A very long text is a row like others: its terms are an
    array in one task.
    """
    counts = scratch(term_counts(docs, text, lang, source), "terms")
    vocabulary = counts.where("term <> ''").groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("d").alias("d")).where(F.col("d") >= least_docs).drop("d")
    kept = counts.join(vocabulary, ["lang", "term"])
    kept = scratch(kept.select("lang", "term", "source", "n", "lang_n"), "kept")
    vocabulary = kept.select("lang", "term", "lang_n").distinct()
    langs = vocabulary.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("lang_n").alias("lang_total"))
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = counts.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["total", "terms", "lang_total"])
    groups = scratch(groups, "groups")

    left = vocabulary.withColumn("salt", F.pmod(F.xxhash64("term"), F.lit(SALTS)))
    right = groups.where("terms > 0").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    cells = left.join(right, ["lang", "salt"]).drop("salt")
    dense = cells.join(kept.select("lang", "term", "source", "n"), ["lang", "term", "source"], "left").na.fill(0, ["n"])
    p, q = share(F.col("n"), F.col("total"), F.col("terms")), share(F.col("lang_n"), F.col("lang_total"), F.col("terms"))
    dense = scratch(dense.select("lang", "term", "source", "n", p.alias("p"), q.alias("q")), "dense")

    a, b = dense.select("lang", "term", "source", "p"), dense.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("other"))
    half = a.join(b, ["lang", "term"]).where("source < item").groupBy("lang", "source", "item").agg(F.sum(F.abs(F.col("p") - F.col("other"))).alias("value"))
    bare = groups.where("terms = 0").select("lang", "source")  # languages without kept terms: all of their distances are 0
    none = bare.join(bare.withColumnRenamed("source", "item"), "lang").where("source < item").withColumn("value", F.lit(0).cast("long"))
    half = half.unionByName(none)
    pairs = half.withColumn("way", F.explode(F.array(F.lit(True), F.lit(False)))).select(
        "lang", F.when(F.col("way"), F.col("source")).otherwise(F.col("item")).alias("source"), F.lit("pair").alias("part"), F.when(F.col("way"), F.col("item")).otherwise(F.col("source")).alias("item"), "value"
    )
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = dense.where("n > 0 and p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    terms = terms.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return pairs.withColumn("rank", F.row_number().over(order)).unionByName(terms)


SQL = r"""
with occurring as (
  select row, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from (
    select row_number() over () as row, coalesce(lang, '') as lang, coalesce(source, '') as source,
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents)),
vocabulary as (select lang, term, count(*) as lang_n from occurring group by lang, term having count(distinct row) >= 30),
langs as (select lang, count(*) as terms, sum(lang_n) as lang_total from vocabulary group by lang),
counts as (select lang, source, term, count(*) as n from occurring semi join vocabulary using (lang, term) group by all),
groups as (
  select g.lang, g.source, coalesce((select sum(n) from counts c where c.lang = g.lang and c.source = g.source), 0) as total
  from (select distinct coalesce(lang, '') as lang, coalesce(source, '') as source from documents) g),
dense as (
  select g.lang, v.term, g.source, coalesce(c.n, 0) as n,
         1 + (1000000000::hugeint * (coalesce(c.n, 0) + 5)) // (g.total + 5 * l.terms) as p,
         1 + (1000000000::hugeint * (v.lang_n + 5)) // (l.lang_total + 5 * l.terms) as q
  from groups g join vocabulary v on v.lang = g.lang join langs l on l.lang = g.lang
  left join counts c on c.lang = g.lang and c.source = g.source and c.term = v.term),
sums as (select a.lang, a.source, b.source as item, sum(abs(a.p - b.p)) as value from dense a join dense b on a.lang = b.lang and a.term = b.term group by all),
parts as (
  select g.lang, g.source, 'pair' as part, h.source as item, coalesce(s.value, 0) as value
  from groups g join groups h on h.lang = g.lang and h.source <> g.source
  left join sums s on s.lang = g.lang and s.source = g.source and s.item = h.source
  union all select lang, source, 'term', term, p - q from dense where n > 0 and p > q)
select lang, source, part, item, value::bigint as value, rank::int as rank from (
  select *, row_number() over (partition by lang, source, part order by value desc, item) as rank from parts) where part = 'pair' or rank <= 50"""
