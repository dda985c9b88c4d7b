"""Statistics of annotated pairs, grids of parameters, draws, and what models' outputs are reduced to."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import normalize, words
from corpusloom.sources.writers import saved


def error_statistics(records: DataFrame, errors: str = "errors") -> DataFrame:
    """n, mean_errors, several (records with two or more types) of records with an array of errors (type, ...)."""
    types = F.array_distinct(F.col(f"{errors}.type"))
    return records.agg(F.count("*").alias("n"), F.avg(F.size(errors)).alias("mean_errors"), F.count_if(F.size(types) > 1).alias("several"))


def primary_types(records: DataFrame, errors: str = "errors") -> DataFrame:
    """type, n: the type of each record's first error, or no_error."""
    return records.groupBy(F.coalesce(F.get(F.col(f"{errors}.type"), F.lit(0)), F.lit("no_error")).alias("type")).agg(F.count("*").alias("n"))


def error_counts(records: DataFrame, errors: str = "errors") -> DataFrame:
    """n_errors, n: how many records have how many errors."""
    return records.groupBy(F.size(errors).cast("long").alias("n_errors")).agg(F.count("*").alias("n"))


def new_tokens(original: Column, corrupted: Column) -> Column:
    """array<string>: distinct words of corrupted that original lacks."""
    return F.array_except(words(corrupted), words(original))


#: Words that invalid_share() judges in place at most, and of how many rows one is looked at to find them. Both only save time.
FREQUENT_WORDS, ROWS_A_LOOK = 5_000, 64


def invalid_share(df: DataFrame, text: str, known: DataFrame, *key: str) -> DataFrame:
    """key, share: the share of a text's words that table known (word) lacks; 0 without words. A row for each key.

    The words that are frequent in rows picked by a hash are judged first, and what they count in a text is found in place. All others
    are joined, so no word has a great part of the rows, and each text's counts go with one row at least.
    """
    valid = saved(known.select("word").distinct())
    looked_at = df.where(F.pmod(F.xxhash64(*key), F.lit(ROWS_A_LOOK)) == 0).select(F.explode(words(F.col(text))).alias("word"))
    frequent = looked_at.groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(FREQUENT_WORDS)
    judged = frequent.join(valid.withColumn("_k", F.lit(True)), "word", "left").select("word", "_k").collect()
    one_of = lambda w, found: w.isin(found) if found else F.lit(False)
    bad = lambda w: one_of(w, [r["word"] for r in judged if not r["_k"]])
    rows = df.select(*key, words(F.col(text)).alias("_w"))
    rows = rows.select(*key, F.size("_w").alias("_n"), F.size(F.filter("_w", bad)).alias("_bad"), F.filter("_w", lambda w: ~one_of(w, [r["word"] for r in judged])).alias("_rest"))
    rows = rows.select(*key, F.monotonically_increasing_id().alias("_id"), "_n", "_bad", F.posexplode_outer("_rest").alias("_i", "word"))
    first = F.coalesce("_i", F.lit(0)) == 0
    # No word has white space: texts without other words are dealt out by such names, instead of all to one task.
    rows = rows.select(*key, F.when(first, F.col("_n")).otherwise(0).alias("_n"), F.when(first, F.col("_bad")).otherwise(0).alias("_bad"), F.col("word").isNotNull().alias("_real"), F.coalesce("word", F.concat(F.lit(" "), F.pmod("_id", F.lit(4096)))).alias("word"))
    found = rows.join(valid.withColumn("_k", F.lit(1)), "word", "left").select(*key, "_n", (F.col("_bad") + (F.col("_real") & F.col("_k").isNull()).cast("int")).alias("_bad"))
    # A given number of partitions is not merged into fewer, whose tables of keys are larger.
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shares = found.repartition(parts, *(F.col(k) for k in key)).groupBy(*key).agg(F.sum("_n").alias("_n"), F.sum("_bad").alias("_bad"))
    return shares.select(*key, F.when(F.col("_n") > 0, F.col("_bad") / F.col("_n")).otherwise(0.0).alias("share"))


def audit_normalization(df: DataFrame, *columns: str, examples: int = 5, order: str = "doc_id") -> DataFrame:
    """field, n, changed, examples (the first changed values, before and after) of what normalization would do to columns."""
    long = df.select(order, F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).alias("before"), normalize(F.col(c)).alias("after")) for c in columns))).alias("x")).select(order, "x.*")
    changed = F.col("before") != F.col("after")
    ranked = long.where(changed).withColumn("_r", F.row_number().over(Window.partitionBy("field").orderBy(order, "before")))
    first = ranked.where(F.col("_r") <= examples).groupBy("field").agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", "before", "after"))), lambda x: F.struct(x["before"].alias("before"), x["after"].alias("after"))).alias("examples"))
    sums = long.groupBy("field").agg(F.count("*").alias("n"), F.count_if(changed).alias("changed"))
    return sums.join(first, "field", "left")


def with_default(rows: DataFrame, values: DataFrame, key: str, column: str, default: str) -> DataFrame:
    """rows with column of values by key; `default` where there is none."""
    return rows.join(values.select(key, column), key, "left").withColumn(column, F.coalesce(column, F.lit(default)))


def grid(spark: SparkSession, parameters: dict[str, list]) -> DataFrame:
    """One row for each combination of values, numbered in the order of nested loops."""
    frames = [spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"_{name} long, {name} {'double' if any(isinstance(v, float) for v in values) else 'long' if all(isinstance(v, int) for v in values) else 'string'}").coalesce(1) for name, values in parameters.items()]
    rows = reduce(lambda a, b: a.crossJoin(b), frames)  # a handful of values each, in one task: partitions would multiply
    number = F.lit(0).cast("long")
    for name, values in parameters.items():
        number = number * len(values) + F.col(f"_{name}")
    return rows.select(number.alias("trial"), *parameters)


def random_trials(trials: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """n of the trials, by md5 of seed and trial."""
    return trials.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), "trial")), "trial").limit(n)


def best_trials(trials: DataFrame, score: str, n: int = 5) -> DataFrame:
    return trials.orderBy(F.desc(score), "trial").limit(n)


def hashed(seed: str, *key: str | Column) -> Column:
    """A number below 2 ** 32 from md5."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), *key)), 1, 8), 16, 10).cast("long")


def draw_with_replacement(rows: DataFrame, n: int, number: str, seed: int = 42) -> DataFrame:
    """n rows drawn by md5 of seed and draw (column draw), of rows numbered from 0 without gaps."""
    size = rows.agg(F.count("*").alias("_size"))
    draws = rows.sparkSession.range(n).withColumnRenamed("id", "draw").join(F.broadcast(size)).where("_size > 0")
    return draws.select("draw", (hashed(str(seed), F.col("draw").cast("string")) % F.col("_size")).alias(number)).join(rows, number)


def weighted_choice(key: list[str | Column], weights: dict[str, float], seed: str) -> Column:
    """One of the names, with probabilities by their weights, from md5 of seed and key."""
    total, at, out = sum(weights.values()), 0.0, F
    place = hashed(seed, *key) / float(1 << 32) * total
    for name, w in weights.items():
        at += w
        out = out.when(place < at, name)
    return out.otherwise(list(weights)[-1])


def sized_samples(rows: DataFrame, sizes: list[int], *key: str, seed: int = 42) -> DataFrame:
    """Adds size: for each of the sizes that many rows without replacement, all where there are fewer; a smaller sample is part of a
    larger one. One ordering serves all."""
    from corpusloom.operators.sampling import numbered, shuffled

    ranked = numbered(rows.withColumn("_h", shuffled(seed, *key)), ["_h", *key])
    return ranked.withColumn("size", F.explode(F.array(*map(F.lit, sizes)))).where("_rn <= size").drop("_h", "_rn", "_n")


def confidence(log_probs: Column) -> Column:
    """min(1, exp(mean)) of an array of token log probabilities; 0 for an empty one."""
    mean = F.aggregate(log_probs, F.lit(0.0), lambda a, x: a + x) / F.size(log_probs)
    return F.when(F.size(log_probs) > 0, F.least(F.lit(1.0), F.exp(mean))).otherwise(0.0)


def token_classes(rows: DataFrame, scores: str, names: dict[int, str], *key: str) -> DataFrame:
    """key, pos, class, name of the tokens whose highest score (of an array of arrays) is not class 0; the first of equals."""
    tokens = rows.select(*key, F.posexplode(scores).alias("pos", "_s"))
    best = tokens.withColumn("class", (F.array_position("_s", F.array_max("_s")) - 1).cast("int"))
    lookup = F.create_map(*(x for k, v in names.items() for x in (F.lit(k), F.lit(v))))
    return best.where("class > 0").select(*key, "pos", "class", F.try_element_at(lookup, F.col("class")).alias("name"))


def split_sizes(rows: DataFrame, split: str) -> DataFrame:
    """split, n, percent."""
    return rows.groupBy(split).agg(F.count("*").alias("n")).withColumn("percent", 100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()))  # a row a split


def difficulty(text: Column, edges: Column, weight: float = 0.5) -> Column:
    return F.size(words(text)) + weight * edges


def dataset_digest(df: DataFrame, text: str, buckets: int = 4096) -> DataFrame:
    """digest, n: independent of the order of rows. Rows' digests are sorted and hashed in buckets of their first bits, then the
    buckets' digests, of which there are `buckets` at most."""
    rows = df.select(F.sha2(text, 256).alias("h"))
    bucket = F.conv(F.substring("h", 1, 8), 16, 10).cast("long") % buckets
    copies = rows.groupBy("h").agg(F.count("*").alias("c")).withColumn("b", bucket)
    one = copies.groupBy("b").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("h", "c"))), lambda x: F.concat_ws(":", x["h"], x["c"].cast("string"))), ","), 256).alias("h"), F.sum("c").alias("c"))
    return one.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("b", "h"))), lambda x: x["h"]), ""), 256).alias("digest"), F.sum("c").alias("n"))
