"""Queries of this subpackage and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm import divergence as D
from corpusloom.llm.bpe import round_trip
from corpusloom.llm.chosen_path import jaccard_join
from corpusloom.llm.exact_dedup import exact_groups
from corpusloom.llm.hnsw import near_vectors
from corpusloom.llm.kneser_ney import judge
from corpusloom.llm.line_dedup import dedup_lines
from corpusloom.llm.packing import pack
from corpusloom.llm.repair import read_grammars, write_grammars
from corpusloom.llm.secrets import secret_digests
from corpusloom.llm.substring_dedup import find_repeats
from corpusloom.llm.turns import damage, repair_digests
from corpusloom.llm.url_filter import filter_urls


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer(name: str) -> str:
    """A public tokenizer's file, at the same place on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json")).drop("ids")


def op2_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_grammars(write_grammars(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), terminals=50_257))


def trusted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of the documents that labels call good and not toxic."""
    return table(spark, sf_dir, "labels").where("quality = 1 and toxic = 0").select("doc_id")


def op3_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"), trusted(spark, sf_dir)).drop("row_key")


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents")).drop("row_key")


def op8_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents")).drop("kept", "row_key")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_repeats(table(spark, sf_dir, "documents")).drop("kept", "row_key")


def op11_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_digests(table(spark, sf_dir, "documents"))


def op12_repair_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    return repair_digests(damage(conversations), conversations)


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.divergence(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_packing, op2_repair, op3_kneser_ney, op4_exact_dedup, op5_bpe, op6_url_filter, op7_jaccard_join, op8_hnsw, op9_line_dedup, op10_substring_dedup, op11_secrets, op12_repair_turns, op13_divergence)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {
        "op4_exact_dedup": """
            select doc_id, max(doc_id) over w as keep_id, count(*) over w as group_size,
                   doc_id is not distinct from max(doc_id) over w as kept, sha256(coalesce(text, '')) as text_sha256
            from documents window w as (partition by coalesce(text, ''))""",
        "op13_divergence": D.SQL,
    }
