"""Exact deduplication with a heavy-hitter split, in DataFrame operations only.

Frequent digests are found with a Misra-Gries summary (Spark's freqItems aggregate: 1 / support counters a task, merged).
Their copies are counted exactly; the verified winners, at most 1 / support rows, are broadcast, so that rows of large
groups are settled map-side and never meet in one task. All other digests take an ordinary shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import scratch, text_or_empty

SUPPORT = 1e-3


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text: Column | None = None, support: float = SUPPORT) -> DataFrame:
    """One row per row of docs: id_col, keep_id, group_size, kept, text_sha256.

    Texts are equal when their digests are; null counts as empty. The row with the largest id stays. Null ids never win
    against others; a group of null ids only has keep_id null and keeps its rows. Rows that repeat an id are each reported,
    with the same flags. An empty table gives no rows; columns besides id and text are not read.
    """
    text = text_or_empty() if text is None else text
    digests = scratch(docs.select(F.col(id_col).alias("doc_id"), F.unhex(F.sha2(text, 256)).alias("digest")), "digests")
    frequent = digests.stat.freqItems(["digest"], support).select(F.explode("digest_freqItems").alias("digest"))  # at most 1 / support rows
    winners = digests.join(F.broadcast(frequent), "digest", "left_semi").groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    winners = scratch(winners.where("group_size > 1"), "winners")
    marked = digests.join(F.broadcast(winners), "digest", "left")
    heavy = marked.where("group_size is not null")
    rest = marked.where("group_size is null").select("digest", "doc_id")
    groups = rest.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    light = rest.join(groups, "digest")
    return heavy.unionByName(light).select(
        F.col("doc_id").alias(id_col), "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text: Column | None = None, support: float = SUPPORT) -> DataFrame:
    """The rows of docs that stay, with all their columns: see exact_groups(). Rows are told apart by id and text."""
    gone = exact_groups(docs, id_col, text, support).where(~F.col("kept")).select(F.col(id_col).alias("_gone_id"), F.unhex("text_sha256").alias("_gone_digest")).distinct()
    marked = docs.withColumn("_own_digest", F.unhex(F.sha2(text_or_empty() if text is None else text, 256)))
    return marked.join(gone, F.col("_own_digest").eqNullSafe(F.col("_gone_digest")) & marked[id_col].eqNullSafe(F.col("_gone_id")), "left_anti").drop("_own_digest")
