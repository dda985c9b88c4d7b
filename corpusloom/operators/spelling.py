"""Spelling: suggestions for words, corrected sentences, and sentences with words replaced by what a dictionary suggests.

Suggestions are found once for each distinct word and joined to the places where it stands.
"""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import words
from corpusloom.operators import lexicon as L
from corpusloom.operators.augment import random_deletion, random_swap
from corpusloom.operators.statistics import hashed

#: Words of a dictionary that is compared by similarity at most: a list of its words goes to every worker.
LEXICON_WORDS = 500_000
_CORE, _MARKS = r"(?s)^(.+?)([.،؟!؛:»«\-]*)$", r"[.،؟!؛:»«\-]+$"


def _similar(unknown: DataFrame, dictionary: DataFrame, most: int, cutoff: float) -> DataFrame:
    """word, suggestions: the most similar words of the dictionary."""
    known = [r[0] for r in dictionary.select("surface").distinct().orderBy("surface").limit(LEXICON_WORDS + 1).collect()]
    if len(known) > LEXICON_WORDS:
        raise ValueError(f"a dictionary of more than {LEXICON_WORDS} words")
    shared = unknown.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [difflib.get_close_matches(w, shared.value, n=most, cutoff=cutoff) for w in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.list_(pa.string()))], ["word", "suggestions"])

    return unknown.select("word").mapInArrow(run, "word string, suggestions array<string>")


def suggestions(tokens: DataFrame, dictionary: DataFrame, affixes: DataFrame, replacements: DataFrame, most: int = 3, cutoff: float = 0.7) -> DataFrame:
    """word, suggestions: of a valid word itself; of another what the replacement rules make of it, in their order, else the most
    similar words, else itself. tokens: word, repeated or not."""
    judged = L.valid(tokens.select("word").distinct(), dictionary, affixes)
    ruled = L.suggest(judged.where("not valid"), dictionary, replacements).groupBy("word").agg(F.transform(F.array_sort(F.collect_list(F.struct("rule_no", "suggestion"))), lambda x: x["suggestion"]).alias("ruled"))
    rows = judged.join(ruled, "word", "left")
    near = _similar(rows.where("not valid and ruled is null"), dictionary, most, cutoff)
    rows = rows.join(near.where(F.size("suggestions") > 0), "word", "left")
    return rows.select("word", F.coalesce(F.slice("ruled", 1, most), "suggestions", F.array("word")).alias("suggestions"))


def _in_place(df: DataFrame, text: str, key: tuple, found: DataFrame, new: Column) -> DataFrame:
    """key, and text with each word's core replaced by `new` (of columns core, suggestions, i); marks at its end stay."""
    rows = df.select(*key, F.posexplode(words(F.col(text))).alias("i", "w"))
    rows = rows.select(*key, "i", F.regexp_extract("w", _CORE, 1).alias("core"), F.regexp_extract("w", _CORE, 2).alias("marks"))
    rows = rows.join(found.withColumnRenamed("word", "core"), "core", "left").withColumn("w", F.concat(new, "marks"))
    joined = rows.groupBy(*key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "w"))), lambda x: x["w"]), " ").alias("_text"))
    return df.join(joined, list(key), "left").withColumn(text, F.coalesce("_text", F.lit(""))).drop("_text")


def cores(df: DataFrame, text: str) -> DataFrame:
    """word: the distinct words of texts without the marks at their ends."""
    return df.select(F.explode(words(F.col(text))).alias("w")).select(F.regexp_extract("w", _CORE, 1).alias("word")).distinct()


def correct_sentences(df: DataFrame, text: str, *key: str, found: DataFrame, confidence: str | None = None, trusted: float = 0.9) -> DataFrame:
    """df with misspelled words replaced by the first suggestion (found: of suggestions()); texts of a confidence above `trusted` stay."""
    fixed = _in_place(df, text, key, found, F.coalesce(F.get("suggestions", F.lit(0)), F.col("core")))
    if confidence is None:
        return fixed
    old = df.select(*key, F.col(text).alias("_old"))
    return fixed.join(old, list(key)).withColumn(text, F.when(F.col(confidence) > trusted, F.col("_old")).otherwise(F.col(text))).drop("_old")


def synonym_replace(df: DataFrame, text: str, *key: str, found: DataFrame, p: float = 0.1, seed: int = 42) -> DataFrame:
    """df with words replaced by one of their suggestions other than themselves, each with probability p."""
    draw = lambda name: hashed(f"{seed}:{name}", *(F.col(k).cast("string") for k in key), F.col("i").cast("string"))
    others = F.filter("suggestions", lambda s: s != F.col("core"))
    one = F.get(others, (draw("which") % F.greatest(F.size(others), F.lit(1))).cast("int"))
    return _in_place(df, text, key, found, F.when(draw("synonym") < int(p * (1 << 32)), F.coalesce(one, F.col("core"))).otherwise(F.col("core")))


def augment_pairs(df: DataFrame, *key: str, found: DataFrame | None = None, strategy: str = "strategy", seed: int = 42) -> DataFrame:
    """df (source, target, strategy) with pairs augmented: swap and delete change the source, synonym both (given suggestions)."""
    place = F.concat_ws(":", *key)
    rows = df.withColumn("source", F.when(F.col(strategy) == "swap", random_swap(F.col("source"), place, seed=seed)).when(F.col(strategy) == "delete", random_deletion(F.col("source"), place, seed=seed)).otherwise(F.col("source")))
    if found is None:
        return rows
    same = F.col(strategy) != "synonym"
    changed = synonym_replace(synonym_replace(rows.where(~same), "target", *key, found=found, seed=seed), "source", *key, found=found, seed=seed)
    return rows.where(same).unionByName(changed.select(*rows.columns))


def lookup(dictionary: DataFrame, word: str) -> DataFrame:
    """Entries of a word."""
    return dictionary.where(F.col("surface") == word)


def with_transitivity(dictionary: DataFrame) -> DataFrame:
    """Adds transitive and intransitive of verbs, by their flags."""
    verb = F.col("pos") == "verb"
    return dictionary.withColumns({"transitive": verb & F.col("flags").contains("T"), "intransitive": verb & F.col("flags").contains("I")})


def verb_stems(dictionary: DataFrame, kind: str | None = None) -> DataFrame:
    """surface of verbs: all, or those with column `kind` of with_transitivity()."""
    rows = with_transitivity(dictionary).where("pos = 'verb'")
    return (rows.where(F.col(kind)) if kind else rows).select("surface").distinct()
