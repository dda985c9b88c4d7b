"""URL filter: rules first, then gradient-boosted trees on lexical features, in DataFrame operations only.

The trees are trained from labelled URLs (by default those that a rule decides) by histogram boosting: each level of each
tree is one aggregation of gradients by (node, feature, bin), of which only the sums reach the driver: at most
nodes x features x bins numbers. The fitted model is a plain column expression.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import scratch

#: (host, path, verdict); written host + path.
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Training rows at most: a bounded sample of the labelled URLs, those with the lowest hashes.
MAX_TRAINING_ROWS = 20_000
FEATURES = ("url_length", "host_length", "path_length", "depth", "digit_ratio", "entropy", "n_params", "host_labels", "suffix_share", "suffix_blocked")


def url_parts(url: Column) -> tuple[Column, Column, Column]:
    """Host (A-Z lower-cased), path, and what follows the path. Null or no '://': all empty."""
    rest = F.when(F.locate("://", url) > 0, F.substring(url, F.locate("://", url) + 3, F.length(url)))
    rest = F.coalesce(rest, F.lit(""))
    head = F.regexp_extract(rest, r"^([^?#]*)", 1)
    host = F.regexp_extract(head, r"^([^/]*)", 1)
    return F.translate(host, UPPER, LOWER), F.substring(head, F.length(host) + 1, F.length(head)), F.substring(rest, F.length(head) + 1, F.length(rest))


def rule_for(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as text, and its verdict; nulls if none does."""
    ordered = sorted(rules, key=lambda r: (-len(r[0] + r[1]), r))
    name = verdict = None
    for h, p, v in ordered:
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name = F.when(fits, h + p) if name is None else name.when(fits, h + p)
        verdict = F.when(fits, v) if verdict is None else verdict.when(fits, v)
    return (name, verdict) if ordered else (F.lit(None).cast("string"), F.lit(None).cast("string"))


def _count(text: Column, what: str) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit(what), F.lit("")))).cast("double")


def lexical(df: DataFrame) -> DataFrame:
    """Adds the lexical features to columns url, host, path, tail. All are 0 for a null or empty URL."""
    url = F.coalesce(F.col("url"), F.lit(""))
    n = F.greatest(F.length(url), F.lit(1)).cast("double")
    share = lambda c: (F.length(url) - F.length(F.replace(url, c, F.lit("")))) / n
    entropy = F.aggregate(F.filter(F.array_distinct(F.split(url, "")), lambda c: c != ""), F.lit(0.0), lambda a, c: a - share(c) * F.log2(share(c)))
    return df.select(
        "*",
        F.length(url).cast("double").alias("url_length"), F.length("host").cast("double").alias("host_length"), F.length("path").cast("double").alias("path_length"),
        _count(F.col("path"), "/").alias("depth"), (F.length(F.regexp_replace(url, "[^0-9]", "")) / n).alias("digit_ratio"), entropy.alias("entropy"),
        (_count(F.col("tail"), "=") + _count(F.col("tail"), "&")).alias("n_params"), (_count(F.col("host"), ".") + 1).alias("host_labels"),
    )


@dataclass
class BoostedTrees:
    """Additive trees over features: margin = prior + sum of leaves. A tree is (feature, cut, left, right) or a leaf's value."""

    prior: float = 0.0
    trees: list = field(default_factory=list)

    def margin(self) -> Column:
        total = F.lit(float(self.prior))
        for t in self.trees:
            total = total + self._column(t)
        return total

    def _column(self, t) -> Column:
        if not isinstance(t, tuple):
            return F.lit(float(t))
        return F.when(F.col(t[0]) <= t[1], self._column(t[2])).otherwise(self._column(t[3]))


def fit_trees(rows: DataFrame, label: str, features: tuple[str, ...], rounds: int = 8, depth: int = 3, bins: int = 16, rate: float = 0.3, ridge: float = 1.0) -> BoostedTrees:
    """Logistic gradient boosting on a bounded table. One class only, or no rows: the prior alone."""
    n, pos = rows.agg(F.count("*"), F.coalesce(F.sum(label), F.lit(0.0))).first()
    model = BoostedTrees(math.log((pos + 1) / (n - pos + 1)))
    if not pos or pos == n:
        return model
    cuts = rows.agg(*(F.percentile_approx(f, [i / bins for i in range(1, bins)], 10_000).alias(f) for f in features)).first()
    cuts = {f: sorted(set(cuts[f])) for f in features}
    binned = F.array(*(sum(((F.col(f) > c).cast("int") for c in cuts[f]), F.lit(0)) for f in features))
    rows = scratch(rows.select(F.col(label).cast("double").alias("_y"), *features, binned.alias("_bins")), "url-training")
    for _ in range(rounds):
        p = 1 / (1 + F.exp(-model.margin()))
        g = rows.select("*", (p - F.col("_y")).alias("_g"), (p * (1 - p)).alias("_h"))
        tree: dict[int, tuple] = {}  # node -> (feature, cut); its children are 2n and 2n + 1
        sums = {1: g.agg(F.sum("_g"), F.sum("_h")).first()}
        for level in range(depth):
            node = F.lit(1)
            for k in sorted(tree):
                f, c = tree[k]
                node = F.when(node == k, F.when(F.col(f) <= c, 2 * k).otherwise(2 * k + 1)).otherwise(node)
            open_nodes = [k for k in sums if 2**level <= k < 2 ** (level + 1)]
            hist: dict = {}
            for r in g.select(node.alias("node"), "_g", "_h", F.posexplode("_bins").alias("f", "bin")).groupBy("node", "f", "bin").agg(F.sum("_g").alias("g"), F.sum("_h").alias("h")).collect():
                hist.setdefault((r.node, r.f), []).append((r.bin, r.g, r.h))
            for k in open_nodes:
                gain, best = 1e-6, None
                for i, f in enumerate(features):
                    gl = hl = 0.0
                    for b, x, y in sorted(hist.get((k, i), []))[:-1]:
                        gl, hl = gl + x, hl + y
                        gr, hr = sums[k][0] - gl, sums[k][1] - hl
                        won = gl * gl / (hl + ridge) + gr * gr / (hr + ridge) - sums[k][0] ** 2 / (sums[k][1] + ridge)
                        if b < len(cuts[f]) and won > gain + 1e-12:
                            gain, best = won, (f, cuts[f][b], (gl, hl), (gr, hr))
                if best:
                    tree[k] = best[:2]
                    sums[2 * k], sums[2 * k + 1] = best[2:]

        def build(k: int):
            return (*tree[k], build(2 * k), build(2 * k + 1)) if k in tree else -rate * sums[k][0] / (sums[k][1] + ridge)

        model.trees.append(build(1))
    return model


@dataclass
class UrlFilter:
    """A fitted filter; suffixes: suffix, suffix_share, suffix_blocked (0.5 where no training row has the suffix) of every suffix."""

    model: BoostedTrees
    suffixes: DataFrame
    rules: tuple = RULES

    def apply(self, parts: DataFrame) -> DataFrame:
        known = lexical(parts).join(self.suffixes, "suffix", "left").fillna({"suffix_share": 0.0, "suffix_blocked": 0.5})
        return known.withColumn("score", 1 / (1 + F.exp(-self.model.margin())))


def split_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES) -> DataFrame:
    base = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))
    host, path, tail = url_parts(F.col("url"))
    base = base.select("*", host.alias("host"), path.alias("path"), tail.alias("tail"))
    name, verdict = rule_for(F.col("host"), F.col("path"), rules)
    return base.select("*", name.alias("rule"), verdict.alias("rule_verdict"), F.substring_index("host", ".", -1).alias("suffix"))


def fit_url_filter(parts: DataFrame, labelled: DataFrame | None = None, rules=RULES, max_rows: int = MAX_TRAINING_ROWS) -> UrlFilter:
    """parts: of split_urls(). labelled: such rows with rule_verdict as label; by default the rows of parts that a rule decides.

    The trees see at most max_rows labelled rows; the share of each suffix counts every row of parts.
    """
    rows = (parts if labelled is None else labelled).where("rule_verdict is not null")
    rows = rows.orderBy(F.xxhash64("url", "page_id"), "url", "page_id").limit(max_rows)
    rows = scratch(lexical(rows).withColumn("label", (F.col("rule_verdict") == "block").cast("double")), "url-sample")
    blocked = rows.groupBy("suffix").agg(((F.sum("label") + 1) / (F.count("*") + 2)).alias("suffix_blocked"))
    total = parts.count()
    counts = parts.groupBy("suffix").agg((F.count("*") / F.lit(float(max(total, 1)))).alias("suffix_share"))
    suffixes = scratch(counts.join(blocked, "suffix", "full").fillna({"suffix_share": 0.0, "suffix_blocked": 0.5}), "url-suffixes")
    training = rows.join(suffixes, "suffix", "left")
    return UrlFilter(fit_trees(training, "label", FEATURES), suffixes, rules)


def filter_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, max_rows: int = MAX_TRAINING_ROWS, threshold: float = 0.5) -> DataFrame:
    """One row per row of pages: page_id, host, path, rule, verdict ('allow' or 'block'), score.

    A null URL, or one without '://', has empty host and path and is judged by the trees. Repeated rows are each reported;
    an empty table gives no rows; other columns are not read.
    """
    parts = split_urls(pages, id_col, url_col, rules)
    judged = fit_url_filter(parts, rules=rules, max_rows=max_rows).apply(parts)
    verdict = F.coalesce("rule_verdict", F.when(F.col("score") >= threshold, "block").otherwise("allow"))
    return judged.select(F.col("page_id").alias(id_col), "host", "path", "rule", verdict.alias("verdict"), "score")
