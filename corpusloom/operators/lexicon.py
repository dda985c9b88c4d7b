"""Dictionary and affix joins: analysis, generation, stems, validity, suggestions. Affix tables are small rule tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Classes of verbs by flag, first to last.
FLAG_ORDER = "TMIVW"


def _cuts(words: DataFrame) -> DataFrame:
    """word, kind, add, rest: each way to cut an affix off, the whole word included."""
    n = F.length("word")
    i = F.explode(F.sequence(F.lit(0), n)).alias("i")
    rows = words.select("word").distinct().select("word", i)
    suffix = rows.select("word", F.lit("SFX").alias("kind"), F.expr("substring(word, i + 1)").alias("add"), F.expr("left(word, i)").alias("rest"))
    prefix = rows.select("word", F.lit("PFX").alias("kind"), F.expr("left(word, i)").alias("add"), F.expr("substring(word, i + 1)").alias("rest"))
    return suffix.unionByName(prefix)


def decompose(words: DataFrame, dictionary: DataFrame, affixes: DataFrame) -> DataFrame:
    """word, base, kind, add, flag, pos, flags: dictionary entries from which one rule makes the word. Equi-joins on affix and base; the
    rule's condition and the entry's flag are checked on what they find."""
    found = _cuts(words).join(F.broadcast(affixes), ["kind", "add"])
    found = found.withColumn("surface", F.when(F.col("kind") == "SFX", F.concat("rest", "strip")).otherwise(F.concat("strip", "rest")))
    fits = F.when(F.col("kind") == "SFX", F.expr("surface rlike concat(condition, '$')")).otherwise(F.expr("surface rlike concat('^', condition)"))
    found = found.where(fits).join(dictionary, "surface").where(F.expr("contains(flags, flag)"))
    return found.withColumnRenamed("surface", "base").select("word", "base", "kind", "add", "flag", "pos", "flags")


def _crossing(affixes: DataFrame, headers: DataFrame) -> DataFrame:
    """Prefix rules of flags whose prefixes go with suffixes; headers: see sources.readers.parse_affix_headers()."""
    flags = headers.where("kind = 'PFX' and `cross`").select("flag").distinct()
    return affixes.where("kind = 'PFX'").join(F.broadcast(flags), "flag", "left_semi")


def decompose_both(words: DataFrame, dictionary: DataFrame, affixes: DataFrame, headers: DataFrame) -> DataFrame:
    """word, base, prefix, suffix, flag, pos, flags: dictionary entries from which a prefix and a suffix of one flag make the word.

    The two meet in the middle: words are cut by prefix rules, what is left by suffix rules of the same flag, and only what both leave
    meets the dictionary; no table of pairs of rules is made. A rule's condition is looked for in what stripping it gives.
    """
    n = F.length("word")
    cuts = words.select("word").distinct().select("word", F.explode(F.sequence(F.lit(0), n)).alias("i")).select("word", F.expr("left(word, i)").alias("add"), F.expr("substring(word, i + 1)").alias("rest"))
    before = cuts.join(F.broadcast(_crossing(affixes, headers)), "add").withColumn("middle", F.concat("strip", "rest")).where(F.expr("middle rlike concat('^', condition)"))
    before = before.select("word", F.col("add").alias("prefix"), "flag", "middle").distinct()
    cut = before.select("*", F.explode(F.sequence(F.lit(0), F.length("middle"))).alias("i")).select("word", "prefix", "flag", F.expr("left(middle, i)").alias("rest"), F.expr("substring(middle, i + 1)").alias("add"))
    both = cut.join(F.broadcast(affixes.where("kind = 'SFX'").drop("kind")), ["flag", "add"]).withColumn("surface", F.concat("rest", "strip")).where(F.expr("surface rlike concat(condition, '$')"))
    found = both.select("word", "prefix", F.col("add").alias("suffix"), "flag", "surface").distinct().join(dictionary, "surface").where(F.expr("contains(flags, flag)"))
    return found.select("word", F.col("surface").alias("base"), "prefix", "suffix", "flag", "pos", "flags")


# Fixed value: diacritics one behind the other.
DOUBLED = "[\u064b-\u065f]{2,}"


def forms(dictionary: DataFrame, affixes: DataFrame, headers: DataFrame) -> DataFrame:
    """base, flag, form: the entry itself, what one rule makes of it, and a prefix rule with a suffix rule where its flag allows both.
    Forms with doubled diacritics go, unless an entry has no others."""
    entries = dictionary.select(F.col("surface").alias("base"), F.explode(F.filter(F.split("flags", ""), lambda f: f != "")).alias("flag")).distinct()
    one = generate(dictionary, affixes)
    begun = generate(dictionary, _crossing(affixes, headers)).select("base", "flag", F.col("form").alias("surface"), F.col("flag").alias("flags"))
    two = begun.join(generate(begun.select("surface", "flags").distinct(), affixes.where("kind = 'SFX'")).select(F.col("base").alias("surface"), "flag", "form"), ["surface", "flag"]).select("base", "flag", "form")
    every = entries.withColumn("form", F.col("base")).unionByName(one).unionByName(two).distinct()
    right = Window.partitionBy("base", "flag")
    every = every.withColumn("_ok", ~F.col("form").rlike(DOUBLED))
    return every.withColumn("_any", F.max("_ok").over(right)).where("_ok or not _any").drop("_ok", "_any")


def generate(dictionary: DataFrame, affixes: DataFrame) -> DataFrame:
    """base, flag, form: what the rules of an entry's flags make of it."""
    entries = dictionary.select("surface", F.explode(F.filter(F.split("flags", ""), lambda f: f != "")).alias("flag"))
    rows = entries.join(F.broadcast(affixes), "flag")
    suffix = F.col("kind") == "SFX"
    fits = F.when(suffix, F.expr("endswith(surface, strip) and surface rlike concat(condition, '$')")).otherwise(F.expr("startswith(surface, strip) and surface rlike concat('^', condition)"))
    form = F.when(suffix, F.expr("concat(left(surface, length(surface) - length(strip)), `add`)")).otherwise(F.expr("concat(`add`, substring(surface, length(strip) + 1))"))
    return rows.where(fits).select(F.col("surface").alias("base"), "flag", form.alias("form")).distinct()


def verb_stem(words: DataFrame, dictionary: DataFrame) -> DataFrame:
    """word, stem, flags: the longest verb that the word begins with; of equals, by flag order."""
    prefixes = words.select("word").distinct().select("word", F.explode(F.expr("transform(sequence(1, greatest(length(word), 1)), i -> left(word, i))")).alias("surface"))
    rank = F.coalesce(*(F.when(F.col("flags").contains(f), i) for i, f in enumerate(FLAG_ORDER)), F.lit(len(FLAG_ORDER)))
    found = prefixes.join(dictionary.where("pos = 'verb'"), "surface").withColumn("_r", F.row_number().over(Window.partitionBy("word").orderBy(F.length("surface").desc(), rank, "flags")))
    return found.where("_r = 1").select("word", F.col("surface").alias("stem"), "flags")


def valid(words: DataFrame, dictionary: DataFrame, affixes: DataFrame) -> DataFrame:
    """word, valid: in the dictionary or made from it by a rule."""
    known = dictionary.select(F.col("surface").alias("word")).union(decompose(words, dictionary, affixes).select("word")).distinct()
    return words.join(known.withColumn("_k", F.lit(True)), "word", "left").select("word", F.coalesce("_k", F.lit(False)).alias("valid"))


def suggest(words: DataFrame, dictionary: DataFrame, replacements: DataFrame) -> DataFrame:
    """word, rule_no, suggestion: replacing the first match of a rule's pattern, where that gives a dictionary word."""
    rows = words.select("word").crossJoin(F.broadcast(replacements)).where(F.expr("word rlike pattern"))  # a few rules for each distinct word
    fixed = F.expr("concat(left(word, regexp_instr(word, pattern) - 1), replacement, substring(word, regexp_instr(word, pattern) + length(regexp_extract(word, concat('(', pattern, ')'), 1))))")
    rows = rows.withColumn("suggestion", fixed).where("suggestion <> word")
    return rows.join(dictionary.select(F.col("surface").alias("suggestion")).distinct(), "suggestion", "left_semi").select("word", "rule_no", "suggestion")
