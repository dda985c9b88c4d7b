"""Text that arrives in files, as a stream: normalized, without repeated lines, written exactly once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corpusloom.functions import filters as S
from corpusloom.functions import text as T


def arriving_lines(spark: SparkSession, path: str, files: int | None = None) -> DataFrame:
    """text, file, at (when the file was written) of the lines of *.txt files as they appear in a folder, `files` of them at once at most."""
    reader = spark.readStream.option("pathGlobFilter", "*.txt")
    rows = (reader.option("maxFilesPerTrigger", files) if files else reader).text(path)
    return rows.select(F.col("value").alias("text"), F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_modification_time").alias("at"))


def normalized(lines: DataFrame, text: str = "text", least: int = 20) -> DataFrame:
    """lines with `text` normalized and punctuated, without those that the sanitizer drops or that have at most `least` characters. Row by
    row, so streams and tables give the same."""
    rows = lines.withColumn("_clean", S.strip_artifacts(F.col(text)))
    rows = rows.where(S.sanitize_reason(F.col("_clean")).isNull()).withColumn(text, T.punctuation(T.normalize(F.col("_clean")))).drop("_clean")
    return rows.where(F.length(text) > least)


def first_lines(lines: DataFrame, text: str = "text", at: str = "at", keep: str = "3650 days") -> DataFrame:
    """One row for each text. On a stream a text is remembered for `keep` behind the newest time `at`: the state has a row for each text of
    that time, by the hash of the text over all partitions."""
    if not lines.isStreaming:
        return lines.dropDuplicates([text])
    return lines.withWatermark(at, keep).dropDuplicatesWithinWatermark([text])


def write_stream(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """rows to a table of files, exactly once: what a run did not finish the next one, with the same checkpoint, does again without a
    trace of the first. Takes what is there and ends."""
    return rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def collect(spark: SparkSession, source: str, path: str, checkpoint: str, files: int | None = None) -> None:
    """New lines of a folder, normalized and without repeated ones, are added to the table at path."""
    write_stream(first_lines(normalized(arriving_lines(spark, source, files))).select("text"), path, checkpoint).awaitTermination()


def counts_by_window(events: DataFrame, at: str, by: str, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """start, by, n: events of windows of time; on a stream windows end when the newest event is `late` past them."""
    rows = events.withWatermark(at, late) if events.isStreaming else events
    return rows.groupBy(F.window(at, width).alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), by, "n")
