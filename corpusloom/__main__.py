"""Commands: each is one batch job over files. `python -m corpusloom COMMAND --help` lists its options."""

from __future__ import annotations

import argparse
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import dedup as D
from corpusloom.operators import evaluation as E
from corpusloom.operators import flow as W
from corpusloom.operators import generation as G
from corpusloom.operators import sampling as M
from corpusloom.operators import statistics as T
from corpusloom.sources import readers as R
from corpusloom.sources import writers
from corpusloom.streaming import lines as L

KEY = ("file", "line_no")


def sanitize(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """Lines that the sanitizer keeps, file by file; near duplicates go within a file."""
    rows = W.sanitized(R.read_lines(spark, a.input), "text", *KEY, near=a.threshold, by="file", language=a.detect)
    writers.write_lines(rows.where("reason is null"), "clean", f"{a.output}/sentences")
    return W.drop_reasons(rows)


def normalize(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """Sentences that are left of lines after all steps of the flow."""
    rows = W.normalization_flow(R.read_lines(spark, a.input), "text", *KEY, categories=a.categories, strict=a.strict, sanitize=not a.skip_sanitizer, gate=not a.skip_gate)
    kept = rows.where("reason is null")
    writers.write_lines(kept.select(F.concat_ws("\t", "category", "sentence").alias("s")) if a.categories else kept, "s" if a.categories else "sentence", f"{a.output}/sentences")
    return W.drop_reasons(rows)


def balance(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """An equal share of sentences of each category (a folder each)."""
    rows = R.read_categories(spark, a.input).select("file", "category", F.posexplode(F.split("text", "\n")).alias("line_no", "sentence")).where("trim(sentence) <> ''")
    picked = M.balanced_sample(rows, "category", *KEY, target=a.target, least=a.least, seed=a.seed)
    writers.write_categories(picked, f"{a.output}/balanced")
    return picked.groupBy("category").agg(F.count("*").alias("n"))


def generate(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """Pairs of right and corrupted sentences."""
    rows = R.read_lines(spark, a.input).where("text <> ''")
    pairs = G.generate_corpus(rows, "text", *KEY, target=a.target, ratio=a.ratio, rate=a.rate, seed=a.seed)
    sums = G.generation_statistics(pairs)
    writers.write_corpus(pairs.drop("text"), sums, a.output, "source_id", "corrupted")
    return sums


def split(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """Training, development and test pairs, at random (without texts that an earlier split has), by stratum or by group."""
    if not 0 < a.train + a.dev < 1:
        raise ValueError("train and dev leave something for test")
    rows = R.read_pairs(spark, a.input)
    if a.group:
        cut = M.split_groups(rows, a.group, a.train, a.dev, a.seed)
    elif a.stratify:
        cut = M.split_stratified(rows, a.stratify, *KEY, train=a.train, dev=a.dev, seed=a.seed)
    else:
        cut = D.without_leaks(M.split_random(rows, *KEY, train=a.train, dev=a.dev, seed=a.seed), "split", "target")
    writers.write_pairs(cut.drop("raw"), f"{a.output}/splits")
    return T.split_sizes(cut, "split")


def statistics(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """Error types of pairs."""
    rows = R.read_pairs(spark, a.input)
    types = rows.select(F.explode("errors.type").alias("type")).groupBy("type").agg(F.count("*").alias("n"))
    writers.write_report(T.error_statistics(rows), f"{a.output}/statistics")
    return types.withColumn("percent", F.round(100.0 * F.col("n") / F.lit(max(types.agg(F.sum("n")).first()[0] or 0, 1)), 2)).orderBy(F.desc("n"), "type")


def evaluate(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """Scores of hypotheses (lines of a file) for pairs of source and reference files."""
    read = lambda path: R.numbered_lines(spark.read.text(path))
    rows = R.zip_lines(read(a.input), read(a.reference)).withColumnRenamed("target", "reference")
    pairs = rows.join(read(a.hypotheses).select("line_no", F.col("text").alias("hypothesis")), "line_no", "left").withColumn("hypothesis", F.coalesce("hypothesis", "source"))
    out = E.edit_scores(pairs).crossJoin(E.char_error_rate(pairs))  # one row each
    writers.write_report(E.interval(pairs.select("line_no", E.edit_counts_udf("source", "hypothesis", "reference").alias("c")).select("line_no", "c.*"), "line_no"), f"{a.output}/interval")
    return out


def collect(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """New lines of a folder of text files, normalized and without repeated ones, added to those of earlier runs with the same output."""
    L.collect(spark, a.input, f"{a.output}/lines", f"{a.output}/state")
    return spark.read.parquet(f"{a.output}/lines").agg(F.count("*").alias("lines"))


def manifest(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """Digests and sizes of all files of a folder."""
    rows = R.manifest(spark, a.input)
    rows.write.mode("overwrite").json(f"{a.output}/manifest")
    return rows.agg(F.count("*").alias("files"), F.sum("size_bytes").alias("bytes"))


COMMANDS: dict[str, tuple[Callable, dict]] = {
    "sanitize": (sanitize, {"threshold": 0.9, "detect": False}), "normalize": (normalize, {"categories": False, "strict": False, "skip_sanitizer": False, "skip_gate": False}),
    "balance": (balance, {"target": 50_000, "least": 100, "seed": 42}), "generate": (generate, {"target": 50_000, "ratio": 0.7, "rate": 0.15, "seed": 42}),
    "split": (split, {"train": 0.8, "dev": 0.1, "seed": 42, "stratify": "", "group": ""}), "statistics": (statistics, {}), "evaluate": (evaluate, {"reference": "", "hypotheses": ""}), "manifest": (manifest, {}), "collect": (collect, {}),
}


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="corpusloom", description=__doc__)
    commands = out.add_subparsers(dest="command", required=True)
    for name, (run, options) in COMMANDS.items():
        one = commands.add_parser(name, help=run.__doc__)
        one.add_argument("input")
        one.add_argument("output")
        for option, default in options.items():
            kind = {"action": "store_true"} if default is False else {"type": type(default), "default": default}
            one.add_argument(f"--{option.replace('_', '-')}", **kind)
    return out


def main(arguments: list[str] | None = None) -> None:
    a = parser().parse_args(arguments)
    spark = SparkSession.builder.getOrCreate()
    print(writers.markdown(COMMANDS[a.command][0](spark, a)))


if __name__ == "__main__":
    main()
