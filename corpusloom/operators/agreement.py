"""Agreement checks of sentences, as windows over a table of tokens.

Sentences are cut into tokens once; rows of a sentence share all windows' key, so that all checks take one shuffle. A check
counts a sentence's violations; a sentence without any is right.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import graph_profile as G
from corpusloom.functions import morph_profile as P
from corpusloom.functions import verb_profile as V
from corpusloom.functions.text import tokens
from corpusloom.operators import morphology as M
from corpusloom.operators.errors import _first
from corpusloom.operators.graph import _has_stem
from corpusloom.sources.writers import saved

# Persons and numbers of pronouns and of the endings of verbs; words that a check looks for.
PRONOUNS = {"من": ("1", "sg"), "تۆ": ("2", "sg"), "ئەو": ("3", "sg"), "ئێمە": ("1", "pl"), "ئێوە": ("2", "pl"), "ئەوان": ("3", "pl")}
ENDINGS = {"ەم": ("1", "sg"), "یت": ("2", "sg"), "ێت": ("3", "sg"), "ات": ("3", "sg"), "ین": ("1", "pl"), "ەن": ("3", "pl"), "م": ("1", "sg"), "ێ": ("3", "sg"), "ن": ("3", "pl")}
MARKS, AND = ("،", ".", "؟", "!"), "و"
VERB_BEGINNINGS = ("دە", "ئە", "نا", "بی", "بە", "ب")
QUANTIFIERS = ("هەر", "هیچ", "هەموو", "چەند", "هەندێک")
NEGATIVE = ("هیچ", "هەرگیز", "هیچکەس", "هیچکام")
CONDITIONALS, RELATIVES, VOCATIVES = ("ئەگەر", "ئەگەری"), ("کە", "ئەوەی"), ("ئەی", "یا")
PAST_ADVERBS, PRESENT_ADVERBS = ("دوێنێ", "پار", "پێشتر", "بەرلە", "پارێ"), ("ئێستا", "ئەمڕۆ", "دواتر", "هەمیشە")
BARE_NOUNS = ("پیاو", "ژن", "منداڵ", "مامۆستا", "قوتابی", "کچ", "کوڕ")
DEMONSTRATIVES = ("ئەو", "ئەم", "ئەوان")
TRANSITIVE = [*V.TRANSITIVE_STEMS, *"پساند وەراند لێدا پێدا تێکرد ئاژاند ڕاکرد هەڵگرت هەڵدا پێشکەشکرد سەرکرد وەرگرت تەرخانکرد گۆڕی داخست قسەکرد باسکرد کارکرد دەسکرد گوێگرت پشتگرت".split()]
# What demonstratives forbid, vowels before a link, beginnings of verbs behind it, letters that are confused.
SHOWING, DEFINITE, INDEFINITE, ENDS_PHRASE = ("ئەم", "ئەو", "ئەمە", "ئەوە"), ("ەکە", "ەکان"), ("ێک", "یەک", "ێکی"), ("و", "،", ".", "؟")
FINAL_VOWELS, NO_MODIFIER = "اەێۆو", ("دە", "بی", "نا", "نە", "مە")
CONFUSED = {"ح": "ه", "خ": "غ", "ڵ": "ل", "ڕ": "ر", "ع": "ئ"}
#: Law that a check belongs to.
LAWS = {"subject_verb": "Law 1", "object_verb_ergative": "Law 2"}
#: Checks that ask for clauses, for parts, for what is known of a word beside others, and for what a word alone tells (VALUES).
BY_CLAUSE, BY_PART, BY_FLAG = {"subject_verb", "object_verb_ergative", "quantifier_noun"}, {"tense_consistency"}, {"clitic_consistency", "orthography"}
BY_VALUE = BY_CLAUSE | BY_PART | {"relative_clause", "vocative_imperative", "adverb_verb_tense", "compound_subject", "bare_noun"}
VALUES = {"present": "boolean", "stem": "boolean", "tense": "int", "person": "string", "number": "string", "vp": "string", "vn": "string", "verb": "boolean"}
#: Words within which a verb goes with a subject.
NEAR = 7


def _begins(word: Column, starts: tuple | list) -> Column:
    return word.rlike("^(?:" + "|".join(starts) + ")")


def _ending(word: Column, part: int) -> Column:
    """Person (0) or number (1) of a verb by its longest ending."""
    return F.coalesce(*(F.when(word.endswith(e), pn[part]) for e, pn in ENDINGS.items()))


def _pronoun(word: Column, part: int) -> Column:
    return F.coalesce(*(F.when(word == p, pn[part]) for p, pn in PRONOUNS.items()))


def _clauses(words: Column, least: int, marks: bool) -> Column:
    """array<int>: the clause of each word. With marks, a mark begins a clause, and so does `and` where the clause has a verb or `least`
    words; without, `and` where it has both."""
    start = F.struct(F.array().cast("array<int>").alias("ids"), F.lit(0).alias("now"), F.lit(0).alias("n"), F.lit(False).alias("verb"))
    verb = lambda w: _begins(w, VERB_BEGINNINGS) | (_begins(w, TRANSITIVE) if marks else F.lit(False))

    def step(s: Column, w: Column) -> Column:
        ends = (w == AND) & ((s["verb"] | (s["n"] >= least)) if marks else (s["verb"] & (s["n"] >= least)))
        if marks:
            ends = F.coalesce(w.isin(*MARKS), F.lit(False)) | (ends & (F.size(s["ids"]) > 0))
        counted = (w != AND) if marks else F.lit(True)
        return F.struct(
            F.array_append(s["ids"], s["now"] + ends.cast("int")).alias("ids"), (s["now"] + ends.cast("int")).alias("now"),
            F.when(ends, 0).otherwise(s["n"] + counted.cast("int")).alias("n"), F.when(ends, False).otherwise(s["verb"] | (verb(w) & counted)).alias("verb"),
        )

    return F.aggregate(words, start, step, lambda s: s["ids"])


def tense_of(word: Column) -> Column:
    """What a word says about its clause: present (1), past (2) or nothing (null)."""
    rest = F.substring(word, 3, 1 << 30)
    present = _begins(word, V.PRESENT_PREFIXES) | (word.startswith("نا") & (F.length(word) > 3) & rest.rlike("(?:" + "|".join(ENDINGS) + ")$")) | (word.startswith("ب") & (F.length(word) > 1))
    past = word.rlike("^(?:نە)?(?:" + "|".join(TRANSITIVE) + ")") | (word.rlike("(?:مان|تان|یان)$") & (F.length(word) > 4))
    return F.when(present, 1).when(past, 2)


def word_flags(distinct: DataFrame, known: DataFrame | None = None, clitics: bool = True) -> DataFrame:
    """token, clitic (it bears one that counts in a clause) and misspelt, of distinct tokens (column token).

    A clitic counts on words that are no verbs; not on a noun's link, for which the token with that link instead of the clitic is
    analyzed, unless clitics are not asked for. Misspelt are tokens that the table `known` (word) lacks, if it has them with one letter
    that is confused replaced.
    """
    t = F.col("token")
    rows = _clitics(distinct) if clitics else distinct.withColumn("clitic", F.lit(False))
    if known is None:
        return rows.select("token", "clitic", F.lit(False).alias("misspelt"))
    words = known.select(F.col("word").alias("_w")).distinct().withColumn("_known", F.lit(True))
    other = F.filter(F.array(*(F.when(t.contains(a), _first(t, a, b)) for a, b in CONFUSED.items())), lambda x: x.isNotNull())
    tried = rows.join(words.withColumnsRenamed({"_w": "token"}), "token", "left").where("_known is null").select("token", F.explode(other).alias("_w"))
    found = tried.join(words, "_w", "left_semi").select("token").distinct().withColumn("_other", F.lit(True))
    return rows.join(found, "token", "left").select("token", "clitic", F.coalesce("_other", F.lit(False)).alias("misspelt"))


def _clitics(distinct: DataFrame) -> DataFrame:
    """token, clitic of word_flags()."""
    t = F.col("token")
    fits = F.coalesce(*(F.when(t.endswith(c) & (F.length(t) > len(c) + 1), c) for c in P.CLITICS))
    verbal = _begins(t, (*V.PRESENT_PREFIXES, "نا")) | _has_stem(t, G.TRANSITIVE)
    rows = distinct.withColumn("_c", F.when(~F.coalesce(verbal, F.lit(False)), fits))
    probe = F.when(F.col("_c") == "ی", t).otherwise(F.concat(F.substring(t, F.lit(1), F.length(t) - F.length("_c")), F.lit("ی")))
    rows = rows.withColumn("_probe", probe)
    links = M.token_features(rows.where("_c is not null").select(F.col("_probe").alias("token")).distinct())
    links = links.select(F.col("token").alias("_probe"), (F.col("case") == "ez").alias("_ez"), F.map_contains_key("raw", "yi_ambiguous").alias("_unclear"))
    clitic = F.when(F.col("_c") == "ی", ~F.col("_unclear")).otherwise(~F.col("_ez")) & F.col("_c").isNotNull()
    return rows.join(links, "_probe", "left").select("token", F.coalesce(clitic, F.lit(False)).alias("clitic"))


def word_values(rows: DataFrame) -> DataFrame:
    """rows of distinct tokens with what checks ask of a word alone: present, verb, stem (of a transitive verb), tense; person and number as
    a pronoun, vp and vn as a verb."""
    t = F.col("token")
    rows = rows.withColumns({"present": _begins(t, V.PRESENT_PREFIXES), "stem": _has_stem(t, G.TRANSITIVE), "tense": tense_of(t), "person": _pronoun(t, 0), "number": _pronoun(t, 1), "vp": _ending(t, 0), "vn": _ending(t, 1)})
    return rows.withColumn("verb", F.col("present") | t.startswith("نا"))


def check_sentences(sentences: DataFrame, text: str, *key: str, known: DataFrame | None = None, checks: tuple[str, ...] | None = None) -> DataFrame:
    """key, and the violations of each of CHECKS, or of those that are asked for: steps that none of these needs are left out. key tells
    sentences apart; a sentence without tokens has no violations. known: a table of right words (word), without which none is misspelt."""
    asked = CHECKS if checks is None else checks
    needs = lambda some: any(c in some for c in asked)
    w = F.col("w")
    rows = sentences.select(*key, tokens(F.coalesce(F.col(text), F.lit(""))).alias("_t"))
    of_clause = {name: _clauses(F.col("_t"), 2, marks) if needs(some) else F.transform("_t", lambda _: F.lit(0)) for name, marks, some in (("clause", True, BY_CLAUSE), ("part", False, BY_PART))}
    rows = rows.withColumn("_c", F.arrays_zip(F.col("_t").alias("w"), *(c.alias(name) for name, c in of_clause.items())))
    rows = rows.select(*key, F.posexplode_outer("_c").alias("i", "x")).select(*key, "i", "x.*").withColumn("token", F.coalesce("w", F.lit("")))
    flags, values = needs(BY_FLAG), needs(BY_VALUE)
    if flags or values:
        rows = saved(rows)  # words are cut once, and read for counts and values
        unset = [F.lit(None).cast(t).alias(c) for c, t in VALUES.items()]
        made = lambda t: word_flags(t, known, "clitic_consistency" in asked) if flags else t.select("token", F.lit(False).alias("clitic"), F.lit(False).alias("misspelt"))
        rows = M.per_token(rows, lambda t: word_values(made(t)) if values else made(t).select("*", *unset))
        if needs(BY_PART) and len(asked) > 1:
            rows = saved(rows)  # read for checks and for tenses of clauses
    else:
        rows = rows.select("*", F.lit(False).alias("clitic"), F.lit(False).alias("misspelt"), *(F.lit(None).cast(t).alias(c) for c, t in VALUES.items()))
    rows = rows.drop("token")
    tenses = _tense_sequence(rows, *key) if needs(BY_PART) else None
    if tenses is not None and len(asked) == 1:
        return sentences.select(*key).join(tenses, list(key), "left").withColumn("tense_consistency", F.coalesce("tense_consistency", F.lit(0)))
    rows = rows.withColumn("mark", w.isin(*MARKS))
    order = Window.partitionBy(*key).orderBy("i")
    so_far = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({"segment": F.count_if(F.col("mark")).over(order), "before": F.lag("w").over(order), "person_before": F.lag("person", 2).over(order)})

    back = order.rowsBetween(Window.unboundedPreceding, -1)
    place = lambda c: F.max(F.when(c, F.col("i"))).over(back)
    object_person = F.coalesce(F.col("person"), F.when(w.endswith("ەکان") | w.endswith("ەکە"), "3"))
    object_number = F.coalesce(F.col("number"), F.when(w.endswith("ەکان"), "pl").when(w.endswith("ەکە"), "sg"))
    rows = rows.withColumns({"clause_before": F.coalesce(F.lag("clause").over(order), F.lit(0)), "shown": place(w.isin(*SHOWING)), "phrase_end": place(w.isin(*ENDS_PHRASE)), "word_after": F.lead("w").over(order)})
    rows = rows.withColumn("object", F.last(F.when(object_person.isNotNull(), F.struct(object_person.alias("p"), object_number.alias("n"), "clause_before")), ignorenulls=True).over(back))
    ends = lambda marks: reduce(lambda a, b: a | b, (w.endswith(m) for m in marks)).cast("int")
    in_phrase = ~w.isin(*SHOWING) & (F.col("i") - F.col("shown") <= 3) & (F.coalesce("phrase_end", F.lit(-1)) <= F.col("shown"))
    link = w.rlike(f"[{FINAL_VOWELS}]ی$") & ~_begins(F.col("word_after"), NO_MODIFIER)
    past = ~F.col("present") & F.col("stem") & F.col("vp").isNotNull() & (F.col("object.clause_before") == F.col("clause_before"))
    rows = rows.withColumns({
        "k_ezafe": F.when(in_phrase, ends(DEFINITE) + ends(INDEFINITE)).otherwise(0) + F.when(link, 1).otherwise(0),
        "k_ergative": past & ((F.col("object.p") != F.col("vp")) | (F.col("object.n") != F.col("vn"))),
    })

    # Clauses and segments are runs of words: what is the nearest in one is the nearest of all, if that is in it.
    fits = F.when(F.col("present") & F.col("vp").isNotNull(), F.struct("i", "vp"))
    stops = F.when(F.col("mark") | (w == AND), F.col("i"))
    ahead = F.when(F.col("verb"), F.struct("vp", "vn", "clause", "segment"))
    last_of = lambda c: F.last(F.when(c, F.struct("i", "segment")), ignorenulls=True).over(so_far)
    indicative = w.startswith("دە")
    noun = lambda c: F.when(c.endswith("ەکان"), "pl").when(c.endswith("ەکە"), "sg")
    called = F.when((F.col("i") >= 1) & (F.col("i") <= 3), F.coalesce(noun(w), F.col("number")))
    rows = rows.withColumns({"_marker": last_of(w.isin(*CONDITIONALS)), "_earlier": last_of(indicative)})
    rows = rows.withColumns({"_ahead": M.next_of(ahead, *key), "fit": M.next_of(fits, *key), "stop": M.next_of(stops, *key)})
    rows = rows.withColumns({f"in_{c}": F.when(F.col(f"_ahead.{c}") == F.col(c), F.col("_ahead")) for c in ("clause", "segment")})
    differs = lambda v, p, n: (F.col(f"{v}.vp") != p) | (F.col(f"{v}.vn") != n)
    ante = {"p": F.coalesce(_pronoun(F.col("before"), 0), F.when(noun(F.col("before")).isNotNull(), "3")), "n": F.coalesce(_pronoun(F.col("before"), 1), noun(F.col("before")))}
    relative = w.isin(*RELATIVES)
    marker, earlier = (F.when(F.col(f"{c}.segment") == F.col("segment"), F.col(f"{c}.i")) for c in ("_marker", "_earlier"))
    coordinated = (F.col("before") == AND) & F.col("person").isNotNull() & F.col("person_before").isNotNull()
    rows = rows.withColumns({
        "k_subject": F.col("person").isNotNull() & differs("in_clause", F.col("person"), F.col("number")),
        "k_quantifier": w.isin(*QUANTIFIERS) & (F.col("in_clause.vn") == "sg"),
        "k_relative": F.when(relative & (F.col("i") > 0), (F.col("in_segment.vn") != ante["n"]).cast("int") + (F.col("in_segment.vp") != ante["p"]).cast("int")),
        "k_conditional": indicative & (marker > F.coalesce(earlier, F.lit(-1))),
        "pair": F.when(coordinated, F.least("person", "person_before")),
    })
    def first_near(stops: bool) -> Column:
        """Person of the first present verb with an ending among the next words, before a mark or `and` if they stop."""
        found = F.col("fit.i") - F.col("i") <= NEAR
        return F.when(found & (F.col("stop").isNull() | (F.col("stop") > F.col("fit.i"))) if stops else found, F.col("fit.vp"))

    bare = w.isin(*BARE_NOUNS) & ~F.coalesce(F.col("before").isin(*DEMONSTRATIVES), F.lit(False)) & first_near(True).isNotNull()
    last_pair = F.max(F.when(F.col("pair").isNotNull(), F.struct("i", first_near(False).alias("vp"))))
    first_bare = F.min(F.when(bare, F.struct("i", first_near(True).alias("vp"))))
    first_called = F.min(F.when(called.isNotNull(), F.struct("i", called.alias("n"))))["n"]
    has = lambda c: F.coalesce(F.max(c.cast("int")), F.lit(0)) == 1
    total = lambda c: F.coalesce(F.count_if(c), F.lit(0))
    tense = F.coalesce(F.max(F.when(F.col("tense") == 1, F.lit(2))), F.max(F.when(F.col("tense") == 2, F.lit(1))))  # 2: present, 1: past
    command, addressed = F.min(F.when(w.startswith("ب") & (F.length(w) > 2), F.struct("i", "w")))["w"], first_called
    mismatch = ((addressed == "pl") & ~command.endswith("ن")) | ((addressed == "sg") & command.endswith("ن"))
    found = {
        "subject_verb": total(F.col("k_subject")),
        "clitic_consistency": (total(F.col("clitic")) >= 2).cast("long"),
        "ezafe": F.coalesce(F.sum("k_ezafe"), F.lit(0)),
        "object_verb_ergative": total(F.col("k_ergative")),
        "orthography": total(F.col("misspelt")),
        "negative_concord": (has(w.isin(*NEGATIVE)) & ~has(_begins(w, ("نا", "نە")))).cast("long"),
        "conditional": total(F.col("k_conditional")),
        "quantifier_noun": total(F.col("k_quantifier")),
        "relative_clause": F.coalesce(F.sum("k_relative"), F.lit(0)),
        "vocative_imperative": F.coalesce((has((F.col("i") == 0) & w.isin(*VOCATIVES)) & ~_begins(command, V.PRESENT_PREFIXES) & mismatch).cast("long"), F.lit(0)),
        "adverb_verb_tense": F.coalesce((has(w.isin(*PAST_ADVERBS)) & (tense == 2)).cast("long") + (has(w.isin(*PRESENT_ADVERBS)) & (tense == 1)).cast("long"), F.lit(0)),
        "compound_subject": F.coalesce((last_pair["vp"] != F.min("pair")).cast("long"), F.lit(0)),
        "bare_noun": F.coalesce(first_bare["vp"].isin("1", "2").cast("long"), F.lit(0)),
    }
    by_sentence = rows.groupBy(*key).agg(*(c.alias(name) for name, c in found.items() if name in asked))
    if tenses is None:
        return by_sentence
    return by_sentence.join(tenses, list(key), "left").withColumn("tense_consistency", F.coalesce("tense_consistency", F.lit(0)))


def _tense_sequence(rows: DataFrame, *key: str) -> DataFrame:
    """key, tense_consistency: coordinated clauses of which a past one follows a present one. Clauses without a verb are passed over."""
    has_verb = F.max(_begins(F.col("w"), VERB_BEGINNINGS).cast("int")) == 1
    tense = F.when(F.max((F.col("tense") == 1).cast("int")) == 1, 1).when(F.max((F.col("tense") == 2).cast("int")) == 1, 2)
    clauses = rows.where("w is not null").groupBy(*key, "part").agg(has_verb.alias("v"), tense.alias("t"))
    clauses = clauses.withColumn("any", F.max("v").over(Window.partitionBy(*key))).where("v or not any")
    clauses = clauses.withColumn("t0", F.lag("t").over(Window.partitionBy(*key).orderBy("part")))
    return clauses.groupBy(*key).agg(F.count_if(F.expr("t0 = 1 and t = 2")).alias("tense_consistency"))


CHECKS = (
    "subject_verb", "clitic_consistency", "ezafe", "tense_consistency", "object_verb_ergative", "negative_concord", "orthography", "conditional", "quantifier_noun", "relative_clause", "vocative_imperative", "adverb_verb_tense", "compound_subject", "bare_noun",
)


def by_check(checked: DataFrame) -> DataFrame:
    """check, law, correct, total, accuracy of check_sentences(), of the checks that it has."""
    long = checked.select(F.inline(F.array(*(F.struct(F.lit(c).alias("check"), F.lit(LAWS.get(c, "")).alias("law"), F.col(c).alias("v")) for c in CHECKS if c in checked.columns))))
    sums = long.groupBy("check", "law").agg(F.count_if(F.col("v") == 0).alias("correct"), F.count("*").alias("total"))
    return sums.withColumn("accuracy", F.when(F.col("total") > 0, F.col("correct") / F.col("total")).otherwise(0.0))


def by_law(checks: DataFrame) -> DataFrame:
    """law, correct, total, accuracy of by_check()."""
    sums = checks.where("law <> ''").groupBy("law").agg(F.sum("correct").alias("correct"), F.sum("total").alias("total"))
    return sums.withColumn("accuracy", F.when(F.col("total") > 0, F.col("correct") / F.col("total")).otherwise(0.0))


def accuracy(checked: DataFrame) -> DataFrame:
    """n, accuracy (sentences without a violation), passed (mean of checks without one), checks."""
    passed = reduce(lambda a, b: a + b, ((F.col(c) == 0).cast("int") for c in CHECKS))
    return checked.agg(F.count("*").alias("n"), F.avg((passed == len(CHECKS)).cast("double")).alias("accuracy"), F.avg(passed).alias("passed"), F.lit(len(CHECKS)).alias("checks"))


def accuracy_with_floor(checked: DataFrame, cer: str, floor: float = 0.5) -> DataFrame:
    """accuracy: sentences without a violation whose character error rate is below the floor."""
    passed = reduce(lambda a, b: a & b, (F.col(c) == 0 for c in CHECKS))
    return checked.agg(F.avg((passed & (F.col(cer) < floor)).cast("double")).alias("accuracy"))
