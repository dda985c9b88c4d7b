"""What several operators share: tables in the shared folder, connected components, Arrow batches in small pieces."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where it is unset and all runs on one machine (tests), a temporary
    one; on a cluster it must be set. Who sets it empties it: results read its tables for as long as they are used."""
    if at := spark.conf.get("spark.checkpoint.dir", None):
        return at.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="corpusloom-"))
        atexit.register(shutil.rmtree, _LOCAL[0], ignore_errors=True)
    return f"file://{_LOCAL[0]}"


def scratch(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage, survives lost executors, is computed once."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_or_empty(column: str | Column = "text") -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def pieces(batches: Iterator[pa.RecordBatch], size: int = 4_000_000, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Slices of batches with about size bytes of text each (one very long text is a slice of its own)."""
    for batch in batches:
        lengths = pc.binary_length(batch.column(column)).to_pylist()
        start = total = 0
        for i, n in enumerate(lengths):
            total += n or 0
            if total >= size:
                yield batch.slice(start, i + 1 - start)
                start, total = i + 1, 0
        if start < len(lengths):
            yield batch.slice(start)


BITMAP_BITS = 26


def bitmap(keys: DataFrame, column: str):
    """A broadcast bitmap of fixed size (8 MB) of a long column, to skip rows map-side before an exact join: see in_bitmap().

    Its words are combined in Spark; at most 2 ** 20 of them reach the driver. With many keys it lets more rows through, never
    fewer.
    """
    place = f"`{column}` & {(1 << BITMAP_BITS) - 1}L"
    words = keys.where(F.col(column).isNotNull()).groupBy(F.expr(f"shiftright({place}, 6)").alias("w")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(`{column}` & 63L as int))")).alias("b")).toArrow()
    out = np.zeros(1 << (BITMAP_BITS - 6), dtype=np.uint64)
    out[words.column("w").to_numpy()] = words.column("b").to_numpy().view(np.uint64)
    return keys.sparkSession.sparkContext.broadcast(out)


def in_bitmap(words: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether each long may be among the keys."""
    at = keys.astype(np.int64) & ((1 << BITMAP_BITS) - 1)
    return (words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) != 0


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Connected components of edges (a, b), both long: rows (id, root), root being the smallest id of the component.

    Alternates large-star and small-star steps. Each step is an aggregation (combined before the shuffle, so a hub costs
    one row a task) and an equi-join; every round's edges are a table in the shared folder. Loops, nulls, repeated and
    two-way edges are fine; ids without an edge to another id do not appear.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e = scratch(e, name)

    def state(x: DataFrame) -> tuple:
        return tuple(x.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())

    before = state(e)
    while True:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        small = small.select("b", "m").where("b <> m").unionByName(low.select(F.col("a").alias("b"), "m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        e = scratch(small.distinct(), name)
        after = state(e)
        if after == before:
            break
        before = after
    return e.select(F.col("a").alias("id"), F.col("b").alias("root")).unionByName(e.select(F.col("b").alias("id"), F.col("b").alias("root")).distinct())
