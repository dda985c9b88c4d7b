"""Training-data pipeline: quality classifier, line deduplication, near duplicates, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame: the documents that it keeps, with their columns, and at the end
the packed pieces. Every stage works on whole texts of all documents that the one before kept. Empty tables give empty tables;
columns besides doc_id, text, lang, source and n_chars are carried along, whatever their names (but for those of this module,
which begin with _pipeline).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.chosen_path import jaccard_join
from corpusloom.llm.common import scratch
from corpusloom.llm.kneser_ney import judge
from corpusloom.llm.line_dedup import dedup_lines
from corpusloom.llm.packing import pack
from corpusloom.llm.queries import table, tokenizer, trusted
from corpusloom.llm.substring_dedup import find_repeats


ROW, ID, NEW = "_pipeline_row", "_pipeline_id", "_pipeline_text"


def _rows_of(judged: DataFrame) -> DataFrame:
    """Rows of an operator's result, each once, under names that no column of documents has."""
    return judged.select(F.col("row_key").alias(ROW), F.col("doc_id").alias(ID), *(F.col(c).alias(NEW) for c in judged.columns if c == "kept_text")).dropDuplicates([ROW, ID])


def _join(docs: DataFrame, judged: DataFrame, how: str) -> DataFrame:
    """docs joined with an operator's rows of the same id and text."""
    keyed = docs.withColumn("_pipeline_own", F.xxhash64("doc_id", "text"))
    return keyed.join(judged, (F.col("_pipeline_own") == F.col(ROW)) & keyed["doc_id"].eqNullSafe(F.col(ID)), how)


def _without(docs: DataFrame, judged: DataFrame) -> DataFrame:
    """docs without the rows that an operator doesn't keep."""
    return _join(docs, _rows_of(judged.where(~F.col("kept"))), "left_anti").select(*docs.columns)


def _replace_text(docs: DataFrame, changes: DataFrame, name: str) -> DataFrame:
    """docs with the texts of changes (kept) where a text changed. Rows that repeat id and text change alike."""
    changed = scratch(changes.where("kept is not null").select("row_key", "doc_id", F.col("kept").alias("kept_text")), name)
    values = {"text": F.coalesce(NEW, "text"), "n_chars": F.when(F.col(NEW).isNotNull(), F.length(NEW).cast("long")).otherwise(F.col("n_chars") if "n_chars" in docs.columns else None)}
    return _join(docs, _rows_of(changed), "left").select(*(values[c].alias(c) if c in values else F.col(c) for c in docs.columns))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity is outside their language's limits go. Null and empty texts, and all where too few trusted
    documents set limits, stay; rows of one id with other texts are judged on their own, equal rows alike."""
    return _without(docs, judge(docs, trusted(spark, sf_dir)))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that occur before, equal or nearly so, go; every document stays, null texts as they are. Of lines that tie, the one of
    the least (id, line number) stays, in all rows that repeat its id and text; null ids come first."""
    return _replace_text(docs, dedup_lines(docs), "pipeline-lines")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicate documents, the one with the least id stays; rows that tie in that id all stay. Null and empty
    texts have no near duplicates. A row of the same id with another text is not touched by the group's decision."""
    return _without(docs, jaccard_join(docs))


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of passages that occur anywhere else go, in equal rows too; every document stays, null and short texts as they are."""
    return _replace_text(docs, find_repeats(docs), "pipeline-passages")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences, with their ids. Null and empty texts are the end token; rows are packed one by one."""
    return pack(docs, tokenizer("word_bpe_49k.json"))


STAGES = [("quality_classifier", quality), ("line_dedup", lines), ("jaccard_join", near_duplicates), ("substring_dedup", passages), ("packing", packing)]
#: SQL can't express the language model, the edit join or tokenizers; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
