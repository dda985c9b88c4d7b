"""Derived tables that queries run on, in Spark and as SQL text for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import profile as P
from corpusloom.functions import text as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df over all cores, where its table is fewer files than there are cores: a small file is one task, whatever is done with its rows.
    A table of many files is as it is, without a shuffle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores else df


def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, pos, lang, source, s: sentences of documents."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text"))
    return docs.select("doc_id", "lang", "source", F.posexplode(T.sentences(F.col("text"))).alias("pos", "s"))


def script_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sentences() in Arabic script, letter for letter."""
    return sentences(spark, sf_dir).withColumn("s", T.transliterate(F.col("s")))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, pos, error_type, source, hypothesis, reference: sentences with edits that md5 chooses."""
    h = F.md5(F.concat_ws(":", F.lit("42"), "doc_id", "pos"))
    bad = F.when(F.substring(h, 1, 1) < "8", F.regexp_replace("s", r"^(\S+)", "$1x")).otherwise(F.col("s"))
    bad = F.when(F.substring(h, 4, 1) < "4", F.regexp_replace(bad, r"\s\S+$", "")).otherwise(bad)
    kind = F.when(F.substring(h, 3, 1) < "4", "spelling").when(F.substring(h, 3, 1) < "8", "agreement").when(F.substring(h, 3, 1) < "c", "clitic").otherwise("order")
    rows = sentences(spark, sf_dir).select("doc_id", "pos", "lang", kind.alias("error_type"), bad.alias("source"), F.col("s").alias("reference"), h.alias("h"))
    return rows.withColumn("hypothesis", F.when(F.substring("h", 2, 1) < "8", F.col("source")).otherwise(F.col("reference"))).drop("h")


#: White space as Java and RE2 both write it.
WS = r"[ \t\n\x0B\f\r]"
SENTS = r"""sents as (
  select doc_id, lang, source, unnest(l) as s, generate_subscripts(l, 1) - 1 as pos from (
    select doc_id, lang, source, list_filter(list_transform(
      string_split(regexp_replace(text, '([.!?؟۔])[ \t\n\x0B\f\r]+', '\1' || chr(1), 'g'), chr(1)),
      lambda x: regexp_replace(x, '^[ \t\n\x0B\f\r\x{85}\x{A0}]+|[ \t\n\x0B\f\r\x{85}\x{A0}]+$', '', 'g')), lambda x: x <> '') as l
    from documents))"""
AR = SENTS + f""", ar as (select doc_id, lang, source, pos, translate(lower(s), '{P.LATIN}', '{P.SCRIPT}') as s from sents)"""
PAIRS = SENTS + r""", hashed as (select *, md5('42:' || doc_id || ':' || pos) as h from sents), broken as (
  select *, case when substr(h, 4, 1) < '4' then regexp_replace(b, '[ \t\n\x0B\f\r]\S+$', '') else b end as src from (
    select *, case when substr(h, 1, 1) < '8' then regexp_replace(s, '^(\S+)', '\1x') else s end as b from hashed)), pairs as (
  select doc_id, pos, lang, src as source, s as reference, case when substr(h, 2, 1) < '8' then src else s end as hypothesis,
    case when substr(h, 3, 1) < '4' then 'spelling' when substr(h, 3, 1) < '8' then 'agreement' when substr(h, 3, 1) < 'c' then 'clitic' else 'order' end as error_type
  from broken)"""
