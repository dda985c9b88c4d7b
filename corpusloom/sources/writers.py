"""Sinks: lines, tab-separated categories with statistics, pair JSONL by split, parallel text, M² and review CSV."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from corpusloom.sources.readers import format_m2


def write_lines(df: DataFrame, column: str, path: str, mode: str = "overwrite") -> None:
    df.select(F.col(column).alias("value")).write.mode(mode).text(path)


def write_categories(df: DataFrame, path: str, category: str = "category", sentence: str = "sentence") -> None:
    """category, tab, sentence a line; counts by category beside it in <path>_stats."""
    df.select(F.concat_ws("\t", category, sentence).alias("value")).write.mode("overwrite").text(path)
    df.groupBy(category).agg(F.count("*").alias("sentences"), F.sum(F.length(sentence)).alias("chars")).write.mode("overwrite").json(f"{path}_stats")


def write_pairs(df: DataFrame, path: str, split: str = "split") -> None:
    """JSON lines in a folder for each split."""
    df.write.mode("overwrite").partitionBy(split).json(path)


def write_parallel(df: DataFrame, path: str, *order: str) -> None:
    """source and target lines in one order, in <path>/src and <path>/tgt, whose part files have the same rows: one job sorts and writes
    both, so that no bounds of ranges are drawn twice. A line break in a text becomes a space; nulls are empty lines."""
    line = lambda c: F.regexp_replace(F.coalesce(F.col(c), F.lit("")), r"[\r\n]+", " ")
    rows = df.select(*order, "source", "target").repartitionByRange(*order, "source", "target").sortWithinPartitions(*order, "source", "target")
    sides = F.array(*(F.struct(F.lit(n).alias("side"), line(c).alias("value")) for n, c in (("src", "source"), ("tgt", "target"))))
    rows = rows.select(F.monotonically_increasing_id().alias("at"), sides.alias("s")).select("at", F.inline("s")).sortWithinPartitions("side", "at")
    both = f"{path}/_both-{uuid.uuid4().hex}"
    rows.select("side", "value").write.partitionBy("side").text(both)
    files = df.sparkSession._jvm.org.apache.hadoop.fs
    fs = files.Path(path).getFileSystem(df.sparkSession._jsc.hadoopConfiguration())
    for name in ("src", "tgt"):
        fs.delete(files.Path(f"{path}/{name}"), True)
        if not fs.exists(files.Path(f"{both}/side={name}")):  # no rows
            df.sparkSession.createDataFrame([], "value string").write.text(f"{path}/{name}")
        elif not fs.rename(files.Path(f"{both}/side={name}"), files.Path(f"{path}/{name}")):
            raise OSError(f"{both}/side={name} cannot be moved to {path}/{name}")
    fs.delete(files.Path(both), True)


def write_m2(sentences: DataFrame, path: str) -> None:
    format_m2(sentences).orderBy("sent_id").select(F.col("block").alias("value")).write.mode("overwrite").text(path)


def write_review(df: DataFrame, path: str, *lists: str) -> None:
    """CSV with a header, whose first name follows a byte order mark; list columns joined by semicolons."""
    df = df.withColumnRenamed(df.columns[0], "\ufeff" + df.columns[0])
    df.select(*(F.array_join(c, ";").alias(c) if c in lists else F.col(c) for c in df.columns)).write.mode("overwrite").option("header", True).option("escape", "\"").csv(path)


def write_folds(df: DataFrame, path: str, k: int, fold: str = "fold") -> None:
    """<path>/fold_i/train and val, for each of the k folds: rows of the fold validate, all others train."""
    for i in range(k):
        for name, rows in (("train", df.where(F.col(fold) != i)), ("val", df.where(F.col(fold) == i))):
            rows.drop(fold).write.mode("overwrite").json(f"{path}/fold_{i}/{name}")


def write_corpus(pairs: DataFrame, statistics: DataFrame, path: str, *order: str) -> None:
    """Parallel text, annotations and statistics of generated pairs (original, corrupted, errors)."""
    rows = pairs.select(*order, F.col("corrupted").alias("source"), F.col("original").alias("target"))
    write_parallel(rows, path, *order)
    pairs.write.mode("overwrite").json(f"{path}/annotations")
    statistics.write.mode("overwrite").json(f"{path}/statistics")


def write_catalog(documents: DataFrame, path: str) -> None:
    """Catalog JSON of documents (filename, category, title, sentence_count), a row a file."""
    entries = F.array_sort(F.collect_list(F.struct("filename", "category", "title", "sentence_count")))
    documents.agg(entries.alias("documents")).coalesce(1).write.mode("overwrite").json(path)


def write_report(report: DataFrame, path: str) -> None:
    """A report of a few rows as one JSON file."""
    report.coalesce(1).write.mode("overwrite").json(path)


def markdown(report: DataFrame, most: int = 1000) -> str:
    """A report of a few rows (at most `most`, else an error) as a table."""
    rows = report.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report of more than {most} rows")
    lines = [report.columns, ["---"] * len(report.columns), *([("" if v is None else str(v)).replace("|", r"\|") for v in r] for r in rows)]
    return "\n".join("| " + " | ".join(x) + " |" for x in lines)


def append_records(records: DataFrame, path: str) -> None:
    """Records are added to a table of JSON lines, each with an id of its own."""
    records.withColumn("id", F.expr("uuid()")).write.mode("append").json(path)


def write_seen(seen: DataFrame, new: DataFrame, path: str) -> None:
    """The state of seen sentences with new ones: distinct, sorted, one a line. path is another than that of `seen`."""
    both = seen.select("text").unionByName(new.select("text")).where("text is not null and text <> ''").distinct()
    both.orderBy("text").select(F.col("text").alias("value")).write.mode("overwrite").text(path)


def scratch_folder(spark: SparkSession) -> str:
    """A new folder that all executors share: in spark.checkpoint.dir, or where that is unset and all runs on one machine, a temporary
    one that goes at the end of the process."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = tempfile.mkdtemp(prefix="corpusloom-")
        atexit.register(shutil.rmtree, at, ignore_errors=True)
        at = f"file://{at}"
    return f"{at.rstrip('/')}/{uuid.uuid4().hex}"


#: Tables of more rows are not broadcast unless a join says so.
BROADCAST_ROWS = 50_000


def saved(df: DataFrame) -> DataFrame:
    """df as a table in a folder that executors share: computed once, and read again where an executor is lost.

    Compressed columns of few values are files of a hundredth of what their rows take in memory, by which Spark would choose to send
    them whole through the driver. Tables of more than BROADCAST_ROWS rows are therefore merged in joins, as are relations made of them.
    """
    path, written = scratch_folder(df.sparkSession), Observation()
    df.observe(written, F.count(F.lit(1)).alias("n")).write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    return out.hint("merge") if written.get.get("n", 0) > BROADCAST_ROWS else out
