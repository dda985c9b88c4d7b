"""Splits, balanced and ordered samples. Pseudo-random order is md5 of seed and key, so that it is the same everywhere."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.sources.writers import saved


def shuffled(seed: int, *key: str) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *(F.col(k).cast("string") for k in key)))


#: Rows of a range that numbered() counts apart, at least, and rows whose keys are looked at for each bound.
RANGE_ROWS, LOOKED_AT = 20_000, 50


def _ranges(df: DataFrame, n: int) -> Column:
    """The number of the range that a row's _order is in. Bounds are found once, from keys that a hash picks, and are constants from
    then on, so that all uses of the rows agree, however they are executed."""
    parts = min(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // RANGE_ROWS))
    if parts < 2:
        return F.lit(0)
    picked = df.where(F.pmod(F.xxhash64("_order"), F.lit(max(1, n // (parts * LOOKED_AT)))) == 0).select("_order").distinct().orderBy("_order").collect()  # about parts x LOOKED_AT rows
    fields = df.schema["_order"].dataType.fields
    bounds = [picked[i * len(picked) // parts]["_order"] for i in range(1, parts)] if picked else []
    literals = [F.struct(*(F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(x, fields, strict=True))) for x in dict.fromkeys(bounds)]
    return F.size(F.filter(F.array(*literals), lambda b: b <= F.col("_order"))) if literals else F.lit(0)


def numbered(df: DataFrame, order: list, by: list | None = None) -> DataFrame:
    """_rn from 1 and _n, in each group if asked for. Ranges of rows are numbered apart, and their sizes are summed up."""
    groups = list(by or [])
    keyed = df.withColumn("_order", F.struct(*(F.col(c).alias(f"_{i}") if isinstance(c, str) else c.alias(f"_{i}") for i, c in enumerate([*groups, *order]))))
    rows = keyed.withColumn("_p", _ranges(keyed, keyed.count()))
    sizes = rows.groupBy(*groups, "_p").agg(F.count("*").alias("_c"))  # a row a range, and one more for each group
    inside = Window.partitionBy(*groups)
    before = F.coalesce(F.sum("_c").over(inside.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select(*(F.col(c).alias(f"_g{i}") for i, c in enumerate(groups)), F.col("_p").alias("_q"), before.alias("_before"), F.sum("_c").over(inside).alias("_n"))
    rows = rows.withColumn("_i", F.row_number().over(Window.partitionBy(*groups, "_p").orderBy("_order")))
    same = reduce(lambda a, c: a & c, (F.col(c).eqNullSafe(F.col(f"_g{i}")) for i, c in enumerate(groups)), F.col("_p") == F.col("_q"))
    return rows.join(sizes, same).withColumn("_rn", F.col("_before") + F.col("_i")).drop("_p", "_q", "_i", "_before", "_order", *(f"_g{i}" for i in range(len(groups))))


def _cut(rn: Column, n_train: Column, n_dev: Column) -> Column:
    return F.when(rn <= n_train, "train").when(rn <= n_train + n_dev, "dev").otherwise("test")


def split_random(df: DataFrame, *key: str, train: float = 0.8, dev: float = 0.1, seed: int = 42) -> DataFrame:
    """Adds split. From 3 rows on, each split has one at least."""
    rows = numbered(df.withColumn("_h", shuffled(seed, *key)), ["_h", *key])
    n = F.col("_n")
    a, b = F.floor(n * train + 1e-9), F.floor(n * dev + 1e-9)
    a, b = F.when(n >= 3, F.greatest(a, F.lit(1))).otherwise(a), F.when(n >= 3, F.greatest(b, F.lit(1))).otherwise(b)
    a = F.when((n >= 3) & (a + b >= n), n - b - 1).otherwise(a)
    return rows.withColumn("split", _cut(F.col("_rn"), a, b)).drop("_h", "_rn", "_n")


def split_stratified(df: DataFrame, by: str, *key: str, train: float = 0.8, dev: float = 0.1, seed: int = 42) -> DataFrame:
    """Adds split, cut in every stratum; a null stratum is 'unknown'."""
    rows = numbered(df.withColumns({"_h": shuffled(seed, *key), "_s": F.coalesce(by, F.lit("unknown"))}), ["_h", *key], ["_s"])
    return rows.withColumn("split", _cut(F.col("_rn"), F.floor(F.col("_n") * train + 1e-9), F.floor(F.col("_n") * dev + 1e-9))).drop("_h", "_s", "_rn", "_n")


def split_groups(df: DataFrame, group: str, train: float = 0.8, dev: float = 0.1, seed: int = 42) -> DataFrame:
    """Adds split; groups stay together. In shuffled order a group goes to the split whose target the rows before it fall short of."""
    sizes = df.groupBy(F.coalesce(group, F.lit("unknown")).alias("_g")).agg(F.count("*").alias("_c"))
    before = Window.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), "_g")), "_g").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("_g", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_b"), F.sum("_c").over(Window.partitionBy()).alias("_n"))
    n = F.col("_n")
    split = F.when(F.col("_b") < F.floor(n * train + 1e-9), "train").when(F.col("_b") < F.floor(n * train + 1e-9) + F.floor(n * dev + 1e-9), "dev").otherwise("test")
    groups = sizes.select("_g", split.alias("split"))
    return df.join(groups, F.coalesce(F.col(group), F.lit("unknown")) == F.col("_g")).drop("_g")


def kfold(df: DataFrame, *key: str, k: int = 5, seed: int = 42) -> DataFrame:
    """Adds fold (0 to k - 1): contiguous chunks of n div k in shuffled order, the last with the remainder."""
    rows = numbered(df.withColumn("_h", shuffled(seed, *key)), ["_h", *key])
    size = F.greatest(F.floor(F.col("_n") / k), F.lit(1))
    return rows.withColumn("fold", F.least(F.floor((F.col("_rn") - 1) / size), F.lit(k - 1)).cast("int")).drop("_h", "_rn", "_n")


def balanced_sample(df: DataFrame, category: str, *key: str, target: int = 50_000, least: int = 100, seed: int = 42, categories: list[str] | None = None) -> DataFrame:
    """An equal number of rows of each category with at least `least`; what small ones lack is shared once among the large ones.

    Remainders go to the first categories in order. The quotas are computed from one row a category.
    """
    sizes = df.groupBy(F.col(category).alias("_c")).agg(F.count("*").alias("_n")).where(F.col("_n") >= least)
    order = F.array_position(F.array(*map(F.lit, categories)), F.col("_c")) if categories else F.col("_c")
    every, by = Window.partitionBy(), Window.orderBy(order)
    active = sizes.withColumns({"_k": F.count("*").over(every), "_i": F.row_number().over(by)})
    active = active.withColumn("_q", F.floor(F.lit(target) / F.col("_k")) + (F.col("_i") <= F.lit(target) % F.col("_k")).cast("int"))
    active = active.withColumns({"_large": F.col("_n") > F.col("_q"), "_lack": F.sum(F.greatest(F.col("_q") - F.col("_n"), F.lit(0))).over(every)})
    active = active.withColumns({"_m": F.sum(F.col("_large").cast("int")).over(every), "_j": F.sum(F.col("_large").cast("int")).over(by.rowsBetween(Window.unboundedPreceding, 0))})
    extra = F.floor(F.col("_lack") / F.greatest("_m", F.lit(1))) + (F.col("_j") <= F.col("_lack") % F.greatest("_m", F.lit(1))).cast("int")
    quotas = active.select("_c", F.least("_n", F.col("_q") + F.when(F.col("_large"), extra).otherwise(0)).alias("_take"))
    rows = numbered(df.withColumn("_h", shuffled(seed, *key)), ["_h", *key], [category]).drop("_n")
    return rows.join(F.broadcast(quotas), F.col(category) == F.col("_c")).where("_rn <= _take").drop("_h", "_c", "_take").withColumnRenamed("_rn", "round")


#: Rows that oversample() takes from a heap of each task at most; more are numbered with all others.
HEAP_ROWS = 200_000


def oversample(df: DataFrame, target: int, *key: str) -> DataFrame:
    """target rows: the rows in key order, again and again. Adds copy (from 0). Of more than `target` rows only the first are numbered,
    and df is read once: _n is then `target`, for which copies are 0 as for any larger number."""
    if target <= HEAP_ROWS:
        df = saved(df.orderBy(*key).limit(target))
    rows = numbered(df, list(key))
    copies = F.floor((F.lit(target) - F.col("_rn")) / F.col("_n"))
    return rows.where(F.col("_rn") <= target).withColumn("copy", F.explode(F.sequence(F.lit(0).cast("bigint"), copies))).drop("_rn", "_n")


def augment_ratio(df: DataFrame, strategies: list[str], *key: str, ratio: float = 0.5, seed: int = 42) -> DataFrame:
    """int(n x ratio) rows in shuffled order, one for each strategy."""
    rows = numbered(df.withColumn("_h", shuffled(seed, *key)), ["_h", *key])
    return rows.where(F.col("_rn") <= F.floor(F.col("_n") * ratio)).drop("_h", "_rn", "_n").withColumn("strategy", F.explode(F.array(*map(F.lit, strategies))))


def curriculum(df: DataFrame, difficulty: str, *key: str, epoch: int, epochs: int = 30, least: float = 0.3, seed: int = 42) -> DataFrame:
    """The easiest rows, of which an epoch uses a share that grows from `least` to all. Adds place, a key that shuffles them anew in
    each epoch: sort or range-partition by it."""
    m = min(max(least, 0.1), 1.0)
    share = m + (1 - m) * min(epoch / (epochs - 1) if epochs > 1 else 1.0, 1.0) if epochs > 1 else m
    rows = numbered(df, [difficulty, *key])
    return rows.where(F.col("_rn") <= F.greatest(F.lit(1), F.ceil(F.lit(share) * F.col("_n") - 1e-9))).drop("_rn", "_n").withColumn("place", F.md5(F.concat_ws(":", F.lit(f"{seed}:{epoch}"), *key)))


def top_and_other(df: DataFrame, by: str, n: int) -> DataFrame:
    """name, n: the n most frequent values and the sum of the others as 'other'."""
    counts = df.groupBy(F.col(by).alias("name")).agg(F.count("*").alias("n"))
    ranked = counts.withColumn("_r", F.row_number().over(Window.orderBy(F.desc("n"), "name")))
    return ranked.groupBy(F.when(F.col("_r") <= n, F.col("name")).otherwise("other").alias("name")).agg(F.sum("n").alias("n"))


def union_all(*frames: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
