"""Morphological features of tokens, as relations.

Distinct tokens meet a table of rules (whole words, beginnings, ends), of which the one that comes first counts. Tokens of open classes
go through the slots of the verb, the endings of nouns and the clitics, as columns: each slot looks at what the one before left over.
The features come back to the tokens of sentences by a join, where neighbours change them (windows over a sentence).
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.functions import morph_profile as P
from corpusloom.functions.text import tokens
from corpusloom.sources.writers import saved

#: All of a token's features; an empty string is none.
TEXT = ("lemma", "pos", "person", "number", "tense", "aspect", "case", "definiteness", "transitivity", "clitic_person", "clitic_number", "compound_prefix", "voice")
FLAGS = ("is_clitic", "negated")
_FORMS = "kind string, key string, priority int, pos string, person string, number string, lemma string, longer int, raw string, value string"


def _any(words) -> str:
    return "|".join(words)


def closed_class_rules(spark: SparkSession) -> DataFrame:
    """kind (word, prefix, suffix), key, priority, pos, person, number, lemma (whole, rest, or the lemma), longer (letters that the token
    must have at least), raw and value (what else is known): a few hundred constant rows."""
    rows, rank = [], 0

    def words(keys, pos: str, number: str = "", raw: dict | None = None) -> None:
        nonlocal rank
        rank += 1
        for k in dict.fromkeys(keys):
            rows.append(("word", k, rank, pos, "", number, "whole", 0, "niwe_type" if raw else "", (raw or {}).get(k, "")))

    def affix(kind: str, key: str, pos: str, longer: int, raw: str = "", value: str = "") -> None:
        nonlocal rank
        rank += 1
        rows.append((kind, key, rank, pos, "", "", "rest", longer, raw, value))

    rank += 1
    rows += [("word", k, rank, "PRON", p, n, "whole", 0, "", "") for k, (p, n) in P.SUBJECT_PRONOUNS.items()]
    rank += 1
    rows += [("word", k, rank, "PRON", *P.CLITICS[k[len(P.REFLEXIVE) :]], P.REFLEXIVE, 0, "", "") for k in P.REFLEXIVES]
    words(P.INTERROGATIVES, "PRON")
    words(P.RECIPROCALS, "PRON", "pl")
    words(P.DEMONSTRATIVES, "DET", "sg")
    words(P.PREPOSITIONS, "ADP")
    words(P.COORDINATING, "CCONJ")
    words(P.SUBORDINATING, "SCONJ")
    words(P.PARTICLES, "PART")
    words(P.NUMERALS, "NUM")
    words(P.QUANTIFIERS, "DET")
    words(P.ADVERBS, "ADV")
    words(P.QUESTION_ADVERBS, "ADV")
    affix("prefix", P.ADVERB_PREFIX, "ADV", 4, "adverb_derivation", "from_adj_prefix")
    words(P.ADJECTIVES, "ADJ")
    affix("suffix", P.SUPERLATIVE, "ADJ", 5)
    affix("suffix", P.COMPARATIVE, "ADJ", 3)
    affix("prefix", P.MOST, "ADJ", 5)
    words(P.CONTRACTED, "DET")
    for ending, form in P.ORDINAL_ENDINGS.items():
        affix("suffix", ending, "NUM", len(ending) + 2, "ordinal_form", form)
    words(P.FRACTIONS, "NUM")
    words(P.HALF, "NUM", raw=P.HALF)
    return spark.createDataFrame(rows, _FORMS)


def closed_classes(distinct: DataFrame) -> DataFrame:
    """token, pos, person, number, lemma, raw (map): tokens that punctuation, digits or the first rule that fits settle. distinct: column
    token, each once."""
    token = F.col("token")
    rules = closed_class_rules(distinct.sparkSession)
    ends = {kind: sorted({len(k) for k in keys}) for kind, keys in (("prefix", [P.ADVERB_PREFIX, P.MOST]), ("suffix", [P.SUPERLATIVE, P.COMPARATIVE, *P.ORDINAL_ENDINGS]))}
    part = {"prefix": lambda n: F.substring(token, 1, n), "suffix": lambda n: F.right(token, F.lit(n))}
    keys = [F.struct(F.lit("word").alias("kind"), token.alias("key")), *(F.struct(F.lit(kind).alias("kind"), part[kind](n).alias("key")) for kind, lengths in ends.items() for n in lengths)]
    found = distinct.select("token", F.inline(F.array(*keys))).join(F.broadcast(rules), ["kind", "key"])
    n = F.length("key")
    rest = F.when(F.col("kind") == "prefix", F.substring(token, n + 1, F.length(token))).when(F.col("kind") == "suffix", F.substring(token, F.lit(1), F.length(token) - n)).otherwise(token)
    found = found.withColumn("rest", rest).where(F.length(token) >= F.col("longer"))
    found = found.where((F.col("raw") != "ordinal_form") | F.col("rest").isin(*P.NUMERALS) | F.col("rest").rlike(f"^[{P.DIGITS}]+$"))
    lemma = F.when(F.col("lemma") == "rest", F.col("rest")).when(F.col("lemma") == "whole", token).otherwise(F.col("lemma"))
    raw = F.when(F.col("value") != "", F.create_map("raw", "value")).otherwise(F.create_map().cast("map<string,string>"))
    first = F.min_by(F.struct("pos", "person", "number", lemma.alias("lemma"), raw.alias("raw")), "priority")
    by_rule = found.groupBy("token").agg(first.alias("f")).select("token", "f.*")
    plain = lambda pattern, pos: distinct.where(token.rlike(pattern)).select("token", F.lit(pos).alias("pos"), F.lit("").alias("person"), F.lit("").alias("number"), token.alias("lemma"), F.create_map().cast("map<string,string>").alias("raw"))
    marks, digits = f"^[{P.PUNCTUATION}]+$", f"^[{P.DIGITS}]+$"
    return plain(marks, "PUNCT").unionByName(plain(digits, "NUM")).unionByName(by_rule.where(~token.rlike(marks) & ~token.rlike(digits)))


def _after(text: Column, what: Column) -> Column:
    return F.substring(text, F.length(what) + 1, F.length(text))


def _lookup(table: dict, key: Column, part: int) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for k, v in table.items() for x in (k, v[part] or ""))), key), F.lit(""))


def _or(column: str, other: Column) -> Column:
    return F.when(F.col(column) != "", F.col(column)).otherwise(other)


def _put(rows: DataFrame, **raw: Column) -> DataFrame:
    """rows with entries of the map raw, where they are not null."""
    entries = F.array(*(F.struct(F.lit(k).alias("key"), v.cast("string").alias("value")) for k, v in raw.items()))
    return rows.withColumn("raw", F.map_concat("raw", F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull()))))


def prefix_evidence(rest: Column) -> Column:
    """How much says that the letter before `rest` is the prefix of the subjunctive: known stems behind it, and an ending."""
    past = [root for roots in P.PAST_ROOTS.values() for root in roots]
    present = list(P.PAST_TO_PRESENT.values())
    stem = F.when(rest.rlike(f"^(?:{_any(present)})"), 2).when(rest.rlike(f"^(?:{_any(past)})"), 1).otherwise(0)
    core = F.regexp_extract(rest, f"^(.{{2,}}?)(?:{_any(P.PRESENT_ENDINGS)})$", 1)
    return stem + rest.rlike(f"^(?:{_any(P.SH_TO_ZH)})").cast("int") + (core != "").cast("int") + core.isin(*past, *present).cast("int")


def verb_features(rows: DataFrame) -> DataFrame:
    """rows (token) with the features that the slots of a verb give; rest is what prefixes left. A token with too little of a verb has
    no pos."""
    token = F.col("token")
    past_stems = [root + end for end, roots in P.PAST_ROOTS.items() for root in roots]
    infinitive = token.endswith("ن") & (F.length(token) > 2) & F.substring(token, F.lit(1), F.length(token) - 1).isin(*past_stems, *P.PAST_TO_PRESENT)
    rows = rows.withColumns({c: F.lit("") for c in TEXT} | {c: F.lit(False) for c in FLAGS} | {"raw": F.create_map().cast("map<string,string>"), "_inf": infinitive})
    rows = rows.withColumn("_neg", F.regexp_extract("token", f"^(?:{_any(P.NEGATIONS)})", 0)).withColumn("rest", _after(token, F.col("_neg")))
    rows = rows.withColumn("compound_prefix", F.regexp_extract("rest", f"^(?:{_any(P.PREVERBS)})", 0)).withColumn("rest", _after(F.col("rest"), F.col("compound_prefix")))
    rows = rows.withColumns({"negated": F.col("_neg") != "", "tense": F.when(F.col("_neg") == "مە", "imperative").otherwise("")})
    begins = lambda w: F.col("rest").startswith(w) | token.startswith(w)
    missing = reduce(lambda a, w: a.when(begins(w), w), P.NEEDS_PREVERB[1:], F.when(begins(P.NEEDS_PREVERB[0]), P.NEEDS_PREVERB[0]))
    rows = _put(rows, negation_morpheme=F.when(F.col("negated"), F.col("_neg")), missing_obligatory_preverb=F.when(F.col("compound_prefix") == "", missing))

    mood = F.regexp_extract("rest", f"^(?:{_any(P.MOODS)})", 0)
    evidence = F.when(F.col("negated") | (F.col("compound_prefix") != ""), 2).otherwise(prefix_evidence(F.substring("rest", 2, 1 << 30)))
    rows = rows.withColumn("_mood", F.when(mood != "ب", mood).when(evidence >= 2, mood).otherwise(""))
    tense = F.when(F.col("_mood") == "دە", _or("tense", F.lit("present"))).when(F.col("_mood") == "ئە", "future").when(F.col("_mood") == "ب", _or("tense", F.lit("imperative"))).otherwise(F.col("tense"))
    rows = rows.withColumns({"tense": tense, "aspect": F.when(F.col("_mood") == "دە", "habitual").otherwise(""), "pos": F.when(F.col("_mood") != "", "VERB").otherwise(""), "rest": _after(F.col("rest"), F.col("_mood"))})

    t_stem = F.regexp_extract("rest", f"^({_any(P.T_STEMS)})تە", 1)
    found = t_stem != ""
    inside = F.col("rest").rlike(f".[{P.T_BEFORE}]ت(?:{_any(P.T_AFTER)})$") & ((F.col("_mood") != "") | F.col("negated") | (F.col("compound_prefix") != ""))
    rows = rows.withColumns({
        "lemma": t_stem, "tense": F.when(found, _or("tense", F.lit("present"))).otherwise(F.col("tense")), "person": F.when(found, "3").otherwise(""), "number": F.when(found, "sg").otherwise(""),
        "pos": F.when(found | inside, "VERB").otherwise(F.col("pos")), "_t": found | inside,
    })
    stem = F.regexp_extract("rest", f"^(?:{_any([*past_stems, *P.PAST_TO_PRESENT])})", 0)
    rows = rows.withColumn("_past", F.when((F.col("tense") == "") & (F.col("pos") == ""), stem).otherwise(""))
    rows = rows.withColumns({"tense": F.when(F.col("_past") != "", "past").otherwise(F.col("tense")), "pos": F.when(F.col("_past") != "", "VERB").otherwise(F.col("pos"))})

    near_end = lambda s: F.col("rest").rlike(f".(?:{s}).{{0,3}}$")
    voice = F.when(near_end(P.CAUSATIVE[0]), "causative").when(near_end(_any(P.PASSIVE)), "passive").when(near_end(P.CAUSATIVE[1]), "causative").otherwise("")
    before = F.regexp_extract("rest", f"^(.*?)(?:{_any(P.AGAIN)})$", 1)
    again = (voice == "") & (F.length(before) >= 2) & ~before.rlike(f"(?:{_any(P.NO_CAUSATIVE)})$")
    rows = rows.withColumns({"voice": F.when(again, "causative").otherwise(voice), "_again": again, "_before": before})
    rows = rows.withColumn("pos", F.when(F.col("voice") != "", "VERB").otherwise(F.col("pos")))

    fused = F.col("rest").rlike(f".(?:{_any(P.PORTMANTEAU)})$")
    ending = F.regexp_extract("rest", f"^.+?({_any(P.ENDINGS)})$", 1)
    ending = F.when((F.col("_past") != "") & (F.length("rest") - F.length(ending) < F.length("_past")), "").otherwise(ending)
    rows = rows.withColumns({"_fused": fused, "_ending": F.when(fused, "").otherwise(ending), "_verbal": (F.col("pos") == "VERB") | F.col("negated") | (F.col("tense") != "")})
    rows = rows.withColumns({
        "person": F.when(F.col("_fused"), "3").when(F.col("_ending") != "", _lookup(P.ENDINGS, F.col("_ending"), 0)).otherwise(F.col("person")),
        "number": F.when(F.col("_fused"), "sg").when(F.col("_ending") != "", _lookup(P.ENDINGS, F.col("_ending"), 1)).otherwise(F.col("number")),
        "tense": F.when(F.col("_fused"), "present").otherwise(F.col("tense")), "transitivity": F.when(F.col("_fused"), "trans").otherwise(""),
        "pos": F.when(F.col("_fused") | (F.col("_verbal") & (F.col("_ending") != "")), "VERB").otherwise(F.col("pos")),
    })
    verb, tense = F.col("pos") == "VERB", F.col("tense")
    rows = rows.withColumn("aspect", F.when(~verb | (F.col("aspect") != ""), F.col("aspect")).when(F.col("rest").contains("وو") | token.endswith("ووە"), "perfect").when(tense == "past", "perfective").otherwise(""))
    bare = F.regexp_replace("token", "[متینا]+$", "")
    final = F.coalesce(*(F.when(F.col("rest").endswith(x) | bare.endswith(x), x) for x in P.PAST_FINALS))
    mutation = F.coalesce(*(F.when(F.col("rest").contains(x), name) for x, name in P.MUTATIONS.items()))
    want = F.col("rest").isin(*P.WANT_FORMS) | token.rlike(f"^(?:{_any(P.WANT_PRESENT)}|{P.WANT_STEM})") | F.col("rest").startswith(P.WANT_STEM)
    rows = _put(
        rows, has_epenthetic_t=F.when(F.col("_t"), "true"), causative_vowel_shift=F.when(F.col("_again") & F.col("_before").contains("ێ"), "true"), is_portmanteau_perfect=F.when(F.col("_fused"), "true"),
        passive_vowel_change=F.when((F.col("voice") == "passive") & verb & F.col("rest").rlike(f"{_any(P.PASSIVE_STEMS)}|^(?:{_any(s[:3] for s in P.PASSIVE_STEMS)})"), "true"),
        past_stem_final=F.when(verb & (tense == "past"), final), present_stem_mutation=F.when(verb & tense.isin("present", "future"), mutation), is_wistin_exception=F.when(want, "true"),
    )
    habun = token.isin(P.NOT_HAVING, P.NOT_BEING)
    own = {"pos": "VERB", "tense": "present", "person": "3", "number": "sg"}
    rows = rows.withColumns({c: F.when(habun, v).otherwise(F.col(c)) for c, v in own.items()} | {"negated": F.col("negated") | habun})
    rows = _put(rows, habun_negation=F.when(habun, F.when(token == P.NOT_HAVING, "possession").otherwise("existence")))
    # An infinitive has no slots.
    none = {c: F.when(F.col("_inf"), {"pos": "VERB", "tense": "infinitive"}.get(c, "")).otherwise(F.col(c)) for c in TEXT if c != "lemma"}
    doublet = F.when(token.isin(*P.DOUBLETS), F.create_map(F.lit("has_doublet_variant"), F.lit("true"))).otherwise(F.create_map().cast("map<string,string>"))
    none |= {"lemma": F.when(F.col("_inf"), token).otherwise(F.col("lemma")), "negated": F.col("negated") & ~F.col("_inf"), "raw": F.when(F.col("_inf"), doublet).otherwise(F.col("raw"))}
    return rows.withColumns(none).drop("_inf", "_neg", "_mood", "_t", "_past", "_again", "_before", "_fused", "_ending", "_verbal")


def nominal_features(rows: DataFrame) -> DataFrame:
    """rows of verb_features() with those of nouns, where pos is none: endings of definiteness and number, the link to a modifier, and
    derivation. rest is what the endings left."""
    token, noun = F.col("token"), F.col("pos") != "VERB"
    fits = lambda text, end, more: text.endswith(end) & (F.length(text) > len(end) + more)
    first = lambda text, ends, more: F.coalesce(*(F.when(fits(text, e, more), e) for e in ends), F.lit(""))
    cut = lambda text, end: F.substring(text, F.lit(1), F.length(text) - F.length(end))
    rows = rows.withColumn("_end", F.when(noun, first(token, P.NOMINAL, 0)).otherwise(""))
    definite, number = _lookup(P.NOMINAL, F.col("_end"), 0), _lookup(P.NOMINAL, F.col("_end"), 1)
    rows = rows.withColumns({
        "definiteness": F.when(F.col("_end") != "", definite).otherwise(""), "number": F.when(number != "", number).otherwise(F.col("number")),
        "rest": F.when(noun, cut(token, F.col("_end"))).otherwise(F.col("rest")), "_open": noun & (F.col("_end") == ""),
    })
    link = F.regexp_extract("rest", "^(.+?)(?:یی|ی)$", 1)
    ez = F.col("_open") & (F.length(link) > 1)
    rows = rows.withColumns({"_ez": ez, "_link": link})
    rows = rows.withColumns({"case": F.when(F.col("_ez"), "ez").otherwise(""), "rest": F.when(F.col("_ez"), F.col("_link")).otherwise(F.col("rest")), "_open": F.col("_open") & ~F.col("_ez")})
    rest = F.col("rest")
    rows = rows.withColumn("_derived", F.when(F.col("_open"), first(rest, P.DERIVATIONS, 1)).otherwise(""))
    rows = rows.withColumn("_begun", F.col("_open") & (F.col("_derived") == "") & reduce(lambda a, b: a | b, (rest.startswith(p) & (F.length(rest) > len(p) + 1) for p in P.NOUN_PREFIXES)))
    rows = rows.withColumn("_small", F.when(F.col("_open") & (F.col("_derived") == "") & ~F.col("_begun"), first(rest, P.DIMINUTIVES, 1)).otherwise(""))
    rows = rows.withColumn("_open", F.col("_open") & (F.col("_derived") == "") & ~F.col("_begun") & (F.col("_small") == ""))
    agent = [e for ends in P.AGENTS.values() for e in ends]
    rows = rows.withColumn("_agent", F.when(F.col("_open"), first(rest, agent, 1)).otherwise(""))
    stripped = F.concat("_derived", "_small", "_agent")
    rows = _put(
        rows, is_diminutive=F.when(F.col("_small") != "", "true"), possible_diminutive_adj=F.when(F.col("_open") & (first(rest, P.ADJECTIVE_DIMINUTIVES, 2) != ""), "true"),
        possible_adverb_derivation=F.when(noun & (first(rest, P.ADVERB_SUFFIXES, 2) != ""), "from_adj_suffix"), is_agent_noun=F.when(F.col("_agent") != "", "true"),
        agent_noun_class=F.coalesce(*(F.when(F.col("_agent").isin(*ends), name) for name, ends in P.AGENTS.items())),
    )
    rows = rows.withColumns({
        "pos": F.when(noun, "NOUN").otherwise(F.col("pos")), "number": F.when(noun, _or("number", F.lit("sg"))).otherwise(F.col("number")),
        "lemma": _or("lemma", F.when(noun, cut(rest, stripped)).otherwise(F.lit(""))),
    })
    return rows.drop("_end", "_open", "_ez", "_link", "_derived", "_begun", "_small", "_agent")


def clitic_features(rows: DataFrame) -> DataFrame:
    """rows of nominal_features() with the clitic at the token's end. The last letter of a noun with a link is the link."""
    token = F.col("token")
    fits = lambda c: token.endswith(c) & (F.length(token) > len(c) + 1) & ((F.col("case") != "ez") if c == "ی" else F.lit(True))
    rows = rows.withColumn("_cl", F.coalesce(*(F.when(fits(c), c) for c in P.CLITICS), F.lit("")))
    has = F.col("_cl") != ""
    host = F.substring(token, F.lit(1), F.length(token) - F.length("_cl"))
    rows = rows.withColumns({"is_clitic": has, "clitic_person": _lookup(P.CLITICS, F.col("_cl"), 0), "clitic_number": _lookup(P.CLITICS, F.col("_cl"), 1)})
    unclear = (F.col("_cl") == "ی") & (F.col("pos") != "VERB")
    rows = _put(
        rows, hosted_clitic=F.when(has, F.col("_cl")), yi_ambiguous=F.when(unclear, "true"), yi_functions=F.when(unclear, "izafe,feminine,attribution"), has_yish_preclitic=F.when(has & (F.col("_cl") != "ی") & host.endswith("ش"), "true")
    )
    return rows.withColumn("lemma", _or("lemma", token)).drop("_cl", "rest")


def open_classes(distinct: DataFrame, closed: DataFrame) -> DataFrame:
    """verb_features() of the tokens that closed classes leave, as a table: what is asked of later steps does not go through the slots."""
    return saved(verb_features(distinct.join(closed.select("token"), "token", "left_anti")))


def token_features(distinct: DataFrame) -> DataFrame:
    """token, TEXT, FLAGS and raw of distinct tokens (column token). Each step is a table of distinct tokens: as one plan, expressions grow
    until planning them takes longer than the tokens do."""
    closed = saved(closed_classes(distinct))
    open_ = saved(clitic_features(saved(nominal_features(open_classes(distinct, closed)))))
    empty = [F.lit("").alias(c) for c in TEXT if c not in ("lemma", "pos", "person", "number")]
    closed = closed.select("token", "lemma", "pos", "person", "number", *empty, *(F.lit(False).alias(c) for c in FLAGS), "raw")
    return closed.unionByName(open_.select("token", *TEXT, *FLAGS, "raw"))


#: Tokens whose features are broadcast: no more than so many can each be this part of all.
FREQUENT = 1000


def sentence_tokens(sentences: DataFrame, text: str, *key: str) -> DataFrame:
    """key, i (from 0), token of all sentences; null texts have none."""
    return sentences.select(*key, F.posexplode(tokens(F.coalesce(F.col(text), F.lit("")))).alias("i", "token"))


def backwards(*key: str):
    """The window of a sentence from its end. What follows a row is before it there: a frame that reaches to a sentence's end is otherwise
    gone through anew for each row, which takes the square of the sentence's length."""
    return Window.partitionBy(*key).orderBy(F.desc("i"))


def next_of(value: Column, *key: str) -> Column:
    """The first value that is not null behind a row of a sentence."""
    return F.last(value, ignorenulls=True).over(backwards(*key).rowsBetween(Window.unboundedPreceding, -1))


def per_token(rows: DataFrame, make: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """rows (token and others) with the columns that make() gives for distinct tokens (a row each, token among its columns). What belongs
    to the most frequent tokens, of which there are FREQUENT at most, is broadcast; other tokens are joined by a shuffle, in which no key
    is frequent. rows are read three times."""
    counts = saved(rows.groupBy("token").agg(F.count("*").alias("_n")))
    made = saved(make(counts.select("token")).join(counts, "token").withColumn("_made", F.lit(True)))
    n = made.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    often, seldom = (made.where(c).drop("_n") for c in (F.col("_n") * FREQUENT >= max(n, 1), F.col("_n") * FREQUENT < max(n, 1)))
    marked = rows.join(F.broadcast(often), "token", "left")
    rest = marked.where("_made is null").select(*rows.columns).join(seldom, "token")
    return marked.where("_made").unionByName(rest).drop("_made")


def with_features(rows: DataFrame, extend: Callable[[DataFrame], DataFrame] = lambda f: f) -> DataFrame:
    """rows (token and others) with the features of their tokens, and what `extend` makes of these."""
    return per_token(saved(rows), lambda distinct: extend(token_features(distinct)))


def in_context(features: DataFrame, *key: str) -> DataFrame:
    """Features of the tokens (key, i) of sentences as their neighbours make them: behind a preposition nouns, pronouns and adjectives
    without a case are oblique; a noun behind a numeral is singular."""
    before = F.lag("pos").over(Window.partitionBy(*key).orderBy("i"))
    rows = features.withColumn("_before", before)
    oblique = (F.col("_before") == "ADP") & F.col("pos").isin("NOUN", "PRON", "ADJ") & (F.col("case") == "")
    forced = F.coalesce((F.col("_before") == "NUM") & (F.col("pos") == "NOUN") & (F.col("number") == "pl"), F.lit(False))
    rows = rows.withColumn("case", F.when(oblique, "obl").otherwise(F.col("case")))
    return _put(rows.withColumn("_forced", forced), cardinal_forced_sg=F.when(F.col("_forced"), "true")).withColumn("number", F.when(F.col("_forced"), "sg").otherwise(F.col("number"))).drop("_before", "_forced")


def analyzed(sentences: DataFrame, text: str, *key: str) -> DataFrame:
    """key, i, token and all features, in context."""
    return in_context(with_features(sentence_tokens(sentences, text, *key)), *key)


def vocabulary() -> dict[str, int]:
    """Numbers of feature values: of padding and of anything unknown first, then each feature's values and its own unknown."""
    names = ["PAD", "UNK", *(f"{f}:{v}" for f, values in P.FEATURES.items() for v in (*values, "UNK"))]
    return {n: i for i, n in enumerate(names)}


def vector() -> Column:
    """array<int>: the numbers of a row's features."""
    known = vocabulary()

    def number(f: str) -> Column:
        lookup = F.create_map(*(F.lit(x) for v in P.FEATURES[f] for x in (v, known[f"{f}:{v}"])))
        return F.when(F.col(f) == "", known[f"{f}:UNK"]).otherwise(F.coalesce(F.try_element_at(lookup, F.col(f)), F.lit(0)))

    return F.array(*map(number, P.FEATURES))
