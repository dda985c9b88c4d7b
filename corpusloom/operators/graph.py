"""Agreement graphs of sentences, as relations of tokens.

A token's own features decide whether it is a verb, a noun that can be a subject or a clause boundary; they are found once for each
distinct token. Running counts of boundaries over a sentence then tell clauses apart, so that "no boundary between" is an equality.
Edges come from as-of lookups (the last candidate before a token, the next verb behind it), from gaps and islands (coordinated
subjects) and, for subjects and verbs, from a band join within a clause by buckets of positions. No step compares all pairs of a sentence.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import graph_profile as G
from corpusloom.functions import morph_profile as P
from corpusloom.operators import morphology as M
from corpusloom.sources.writers import saved

_FRONT = "^(?:" + "|".join(G.PREFIXES) + ")(.+)$"
#: Features of tokens that edges or their violations ask for.
KEPT = ("pos", "person", "number", "tense", "aspect", "case", "definiteness", "transitivity")
KINDS = ("pronoun", "bare", "subject_noun", "boundary", "verb", "existential", "host")


def _begins(token: Column, words) -> Column:
    return token.rlike("^(?:" + "|".join(words) + ")")


def _has_stem(token: Column, stems) -> Column:
    """Whether a token begins with one of the stems, or does without its first prefix."""
    rest = F.regexp_extract(token, _FRONT, 1)
    return _begins(token, stems) | _begins(rest, stems)


def verb_classes(features: DataFrame) -> DataFrame:
    """Features of tokens with what the graph asks of a token alone: KINDS (booleans); and of verbs law, passive, wistin, and the person
    and number of their ending where the analysis has none."""
    t = F.col("token")
    verb, tense = F.col("pos") == "VERB", F.col("tense")
    trans = F.when(F.col("transitivity") != "", F.col("transitivity") == "trans").otherwise(_has_stem(t, G.TRANSITIVE))
    intrans = F.when(F.col("transitivity") != "", F.col("transitivity") == "intrans").otherwise(_has_stem(t, G.INTRANSITIVE))
    past = F.when(tense != "", tense).when(_begins(t, G.VERB_PREFIXES), "present").otherwise("past")
    wistin, passive = F.map_contains_key("raw", "is_wistin_exception"), F.col("voice") == "passive"
    light = F.coalesce(*(F.when(t.contains(s), v) for s, v in G.LIGHT_VERBS.items()))
    flips = (F.col("compound_prefix") == G.FLIPPING_PREVERB) & reduce(lambda a, b: a | b, (t.contains(r) for r in G.FLIPPED_ROOTS))
    rows = features.withColumns({"verb": verb, "vtense": F.when(verb, past), "_trans": trans, "_intrans": intrans, "wistin": verb & wistin})
    ergative = F.when(F.col("wistin") | (F.col("vtense") != "past"), False).when(F.col("_trans"), ~passive & ~flips).when(F.col("_intrans"), False).otherwise(F.coalesce(light, F.lit(False)))
    ending = F.regexp_extract("token", "^.*?(" + "|".join(P.ENDINGS) + ")$", 1)
    inferred = verb & (F.col("person") == "") & (ending != "")
    rows = rows.withColumns({
        "law": F.when(verb, F.when(ergative, "law2").otherwise("law1")), "passive": verb & passive & F.col("_trans") & ~F.col("wistin") & (F.col("vtense") == "past"), "_ending": ending, "_inferred": inferred,
    })
    rows = rows.withColumns({c: F.when(F.col("_inferred"), M._lookup(P.ENDINGS, F.col("_ending"), i)).otherwise(F.col(c)) for i, c in enumerate(("person", "number"))})
    noun, marked = F.col("pos") == "NOUN", t.rlike("(?:" + "|".join(G.NOUN_MARKS) + ")$")
    bare = noun & ~marked & ~t.isin(*G.PROPER_NOUNS, *P.QUANTIFIERS, *P.SUBJECT_PRONOUNS, *P.DEMONSTRATIVES)
    kinds = {
        "pronoun": t.isin(*P.SUBJECT_PRONOUNS), "bare": bare, "subject_noun": noun & ~bare & ~t.isin(*G.MASS_NOUNS, *G.COLLECTIVES, *G.PROPER_NOUNS, *P.QUANTIFIERS, *P.DEMONSTRATIVES),
        "boundary": F.col("pos").isin("PUNCT", "SCONJ") | t.isin(*G.SUBORDINATING) | ((t == G.AND) & (F.col("pos") == "CCONJ")) | (tense == "infinitive"),
        "existential": t.isin(*G.EXISTENTIAL_FORMS) | _has_stem(t, G.EXISTENTIAL_STEMS), "host": verb | _begins(t, G.VERB_PREFIXES),
    }
    return rows.withColumns(kinds).select("token", *KEPT, *KINDS, "law", "passive", "wistin", "vtense")


#: What is known of a token's neighbours and of verbs and candidates around it.
_VERB = ("i", "law", "passive", "wistin", "vtense", "before")


def graph_tokens(sentences: DataFrame, text: str, *key: str) -> DataFrame:
    """key, i, token, features and verb_classes() of all tokens, as a table; and of their place: before and upto (boundaries before a
    token, and with it), previous and next (token and pos), ahead and behind (the next and the last verb), n (tokens of the sentence)."""
    rows = M.with_features(M.sentence_tokens(sentences, text, *key), verb_classes)
    whole, order = Window.partitionBy(*key), Window.partitionBy(*key).orderBy("i")
    rows = rows.withColumn("upto", F.count_if("boundary").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("before", F.col("upto") - F.col("boundary").cast("int"))
    verb = F.when(F.col("verb"), F.struct(*_VERB))
    return saved(rows.withColumns({
        "previous": F.lag(F.struct("token", "pos")).over(order), "next": F.lead(F.struct("token", "pos")).over(order), "n": F.count("*").over(whole),
        "behind": F.last(verb, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)),
    }).withColumn("ahead", M.next_of(verb, *key)))


def _reaches(verb: str, reach: int) -> Column:
    """Whether a verb behind the token is at most `reach` tokens away, without a boundary between."""
    return (F.col(f"{verb}.i") - F.col("i") <= reach) & (F.col(f"{verb}.before") == F.col("upto"))


def _islands(rows: DataFrame, linked: Column, *key: str) -> DataFrame:
    """rows with `island`: a row that is not linked to the one before it begins one."""
    order = Window.partitionBy(*key).orderBy("i")
    return rows.withColumn("island", F.count_if(~F.coalesce(linked, F.lit(False))).over(order.rowsBetween(Window.unboundedPreceding, 0)))


def subject_spans(tokens: DataFrame, *key: str) -> DataFrame:
    """key, first, last (indices), members, person, number ('' where only the person agrees), kind (pronoun, nouns, bare, noun), and upto of
    the last: what can be the subject of a verb.

    Coordinated pronouns are one span, of the first person in the order 1, 2, 3 and plural; behind a negative conjunction the first
    pronoun counts. Coordinated nouns (with adjectives) are plural. A bare or marked noun alone is a span if a verb follows in its clause.
    """
    order = Window.partitionBy(*key).orderBy("i")
    rows = tokens.withColumns({"_1": F.lag("token").over(order), "_2": F.lag("pronoun", 2).over(order)})
    link = F.when(F.col("_2") & (F.col("_1") == G.AND), "and").when(F.col("_2") & F.col("_1").isin(*G.NEGATIVE_CONJUNCTIONS), "neither")
    pronouns = rows.where("pronoun").withColumn("_link", link).withColumn("_before", F.lag("_link").over(order))
    pronouns = _islands(pronouns, F.col("_link").isNotNull() & ~((F.col("_link") == "and") & F.coalesce(F.col("_before") == "neither", F.lit(False))), *key)
    member = F.struct("i", "person", "number", "_link", "_1", "upto")
    spans = pronouns.groupBy(*key, "island").agg(F.min_by(member, "i").alias("a"), F.max_by(member, "i").alias("z"), F.count("*").alias("m"), F.min("person").alias("least"), F.count_if(F.col("_link") == "neither").alias("neither"), F.array_sort(F.collect_list("i")).alias("members"))
    one = (F.col("m") == 1) | (F.col("neither") > 0) | F.coalesce(F.col("a._1").isin(*G.NEGATIVE_CONJUNCTIONS), F.lit(False))
    spans = spans.select(*key, F.col("a.i").alias("first"), F.col("z.i").alias("last"), "members", F.when(one, F.col("a.person")).otherwise(F.col("least")).alias("person"), F.when(one, F.col("a.number")).otherwise("pl").alias("number"), F.lit("pronoun").alias("kind"), F.col("z.upto").alias("upto"))

    head = F.last(F.when(F.col("pos") != "ADJ", F.struct("i", "pos")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -2))
    nouns = rows.withColumn("_head", head).where("pos = 'NOUN'")
    nouns = _islands(nouns, (F.col("_1") == G.AND) & (F.col("_head.pos") == "NOUN"), *key)
    groups = nouns.groupBy(*key, "island").agg(F.min("i").alias("first"), F.max("i").alias("last"), F.array_sort(F.collect_list("i")).alias("members"), F.max_by("upto", "i").alias("upto")).where("first < last")
    groups = groups.select(*key, "first", "last", "members", F.lit("3").alias("person"), F.lit("pl").alias("number"), F.lit("nouns").alias("kind"), "upto")

    inside = groups.select(*key, F.explode("members").alias("i"))
    follows = _reaches("ahead", G.SUBJECT_REACH) & (F.col("case") != "obl")
    quantified = F.coalesce(F.col("previous.token").isin(*G.NOT_BARE_AFTER), F.lit(False))
    single = tokens.where(follows & ((F.col("bare") & ~quantified) | F.col("subject_noun"))).join(inside, [*key, "i"], "left_anti")
    single = single.select(*key, F.col("i").alias("first"), F.col("i").alias("last"), F.array("i").alias("members"), F.lit("3").alias("person"), F.when(F.col("bare"), "").otherwise(F.col("number")).alias("number"), F.when(F.col("bare"), "bare").otherwise("noun").alias("kind"), "upto")
    return spans.unionByName(groups).unionByName(single)


FEATURES = ("person", "number")


def _edges(rows: DataFrame, source, target, kind, features, law, *key: str) -> DataFrame:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    listed = features if isinstance(features, Column) else F.array(*map(F.lit, features)).cast("array<string>")
    return rows.select(*key, source.cast("int").alias("source"), target.cast("int").alias("target"), lit(kind).alias("type"), listed.alias("features"), lit(law).alias("law"))


def within(spans: DataFrame, verbs: DataFrame, reach: int, *key: str) -> DataFrame:
    """Spans (last, upto) with the verbs (i, before) that follow in their clause, at most `reach` tokens behind: a band join by clause and
    by buckets of positions, each span being in two."""
    bucket = F.floor(F.col("last") / reach)
    left = spans.withColumn("_b", F.explode(F.array(bucket, bucket + 1)))
    right = verbs.select(*key, F.col("before").alias("upto"), F.floor(F.col("i") / reach).alias("_b"), "i", "law", "passive")
    return left.join(right, [*key, "upto", "_b"]).where((F.col("i") > F.col("last")) & (F.col("i") - F.col("last") <= reach)).drop("_b")


def law_edges(tokens: DataFrame, spans: DataFrame, *key: str) -> DataFrame:
    """Edges of law 1 (subjects and verbs) and of law 2 (of two or more spans before a past transitive verb, the last is its object)."""
    found = within(spans, tokens.where("verb"), G.SUBJECT_REACH, *key)
    one = found.where("law = 'law1'")
    agree = F.when(F.col("number") == "", F.array(F.lit("person"))).otherwise(F.array(*map(F.lit, FEATURES)))
    one = _edges(one, F.col("first"), F.col("i"), F.when(F.col("passive"), "passive_subject_verb").otherwise("subject_verb"), agree, "law1", *key)
    by_verb = Window.partitionBy(*key, "i")
    two = found.where("law = 'law2'").withColumns({"_last": F.max("last").over(by_verb), "_m": F.count("*").over(by_verb)})
    is_object = (F.col("_m") > 1) & (F.col("last") == F.col("_last"))
    nothing = F.array().cast("array<string>")
    two = _edges(two, F.col("first"), F.col("i"), F.when(is_object, "object_verb_ergative").otherwise("agent_non_agreeing"), F.when(is_object, F.array(*map(F.lit, FEATURES))).otherwise(nothing), "law2", *key)
    return one.unionByName(two)


def object_edges(tokens: DataFrame, spans: DataFrame, laws: DataFrame, *key: str) -> DataFrame:
    """What lies before or behind a verb and is no span: subjects behind it, objects before a past transitive verb, and verbs alone."""
    order = Window.partitionBy(*key).orderBy("i")
    candidate = (F.col("pronoun") | F.col("bare") | F.col("subject_noun")) & F.coalesce(F.col("previous.pos") != "ADP", F.lit(True))
    behind = M.next_of(F.when(candidate, F.struct("i", "upto", (F.col("bare") & ~F.col("pronoun")).alias("alone"))), *key)
    members = spans.select(*key, F.explode("members").alias("i")).distinct().withColumn("_in", F.lit(True))
    known = laws.select(*key, F.col("target").alias("i"), F.col("type").isin("subject_verb", "passive_subject_verb").alias("s"), F.col("type").isin("subject_verb", "agent_non_agreeing").alias("d"))
    known = known.groupBy(*key, "i").agg(F.max("s").alias("_subject"), F.max("d").alias("_linked"))
    rows = tokens.join(members, [*key, "i"], "left").join(known, [*key, "i"], "left")
    noun = F.struct("i", "upto", "bare", (F.col("case") == "obl").alias("oblique"))
    before = F.last(F.when(F.col("_in").isNull() & (F.col("pos") == "NOUN"), noun), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumns({"_next": behind, "_object": before}).where("verb")
    late = rows.where("law = 'law1' and not coalesce(_subject, false)").where((F.col("_next.i") - F.col("i") <= G.BACKWARD_REACH) & (F.col("_next.upto") == F.col("upto")))
    late = _edges(late, F.col("_next.i"), F.col("i"), "backward_subject_verb", F.when(F.col("_next.alone"), F.array(F.lit("person"))).otherwise(F.array(*map(F.lit, FEATURES))), "law1", *key)
    objects = rows.where("law = 'law2'").where((F.col("i") - F.col("_object.i") <= G.OBJECT_REACH) & (F.col("_object.upto") == F.col("before")))
    kind = F.when(F.col("_object.oblique"), "oblique_no_agreement").when(F.col("_object.bare"), "object_verb_ergative_zero").otherwise("object_verb_ergative")
    whole = ~F.col("_object.oblique") & ~F.col("_object.bare")
    objects = _edges(objects, F.col("_object.i"), F.col("i"), kind, F.when(whole, F.array(*map(F.lit, FEATURES))).otherwise(F.array().cast("array<string>")), "law2", *key)
    dropped = _edges(rows.where("not coalesce(_linked, false) and person <> ''"), F.col("i"), F.col("i"), "pro_drop_agreement", FEATURES, F.col("law"), *key)
    return late.unionByName(objects).unionByName(dropped)


def phrase_edges(tokens: DataFrame, *key: str) -> DataFrame:
    """Edges within noun phrases, and of quantifiers, measures, mass and collective nouns and demonstratives with the verb of their clause."""
    t, word, pos, v = F.col("token"), F.col("next.token"), F.col("next.pos"), "ahead"
    rows = tokens.where("next is not null")
    near = F.coalesce(_reaches(v, G.QUANTIFIER_REACH), F.lit(False))
    invariant = word.isin(*P.ADJECTIVES, *G.INVARIANT_PRONOUNS, *G.POSSESSIVES, *P.RECIPROCALS)
    nominal = ~word.isin(*P.SUBJECT_PRONOUNS) & ~_begins(word, G.VERB_PREFIXES)
    chain = F.when(t.isin(*P.QUANTIFIERS, *G.INDEFINITE_QUANTIFIERS), "quantifier").when(t.isin(*G.MEASURES), "measure").when(t.isin(*G.MASS_NOUNS), "mass").when(t.isin(*G.COLLECTIVES), "collective").when(t.isin(*P.DEMONSTRATIVES), "demonstrative").when(t.endswith("ی") & (F.length(t) > 1), "link")
    rows = rows.withColumn("_kind", chain)
    kind, i, verb = F.col("_kind"), F.col("i"), F.col(f"{v}.i")
    determiner = nominal & ~invariant & ~pos.isin("VERB", "ADP", "CONJ", "PRON", "PUNCT")
    to_verb = F.when((kind == "quantifier") & nominal & (word != G.AND) & pos.isin("NOUN", "ADJ", "DET"), "quantifier_verb").when(kind == "measure", "measure_word_verb").when((kind == "mass") & ~word.isin(*G.MEASURES), "mass_noun_no_agreement")
    to_verb = to_verb.when(kind == "collective", F.when(F.coalesce(F.col("previous.token").isin(*G.UNIVERSAL), F.lit(False)), "collective_plural").otherwise("collective_singular")).when((kind == "demonstrative") & ~determiner, "dem_proform_verb")
    agree = {"mass_noun_no_agreement": (), "collective_singular": ("person",), "dem_proform_verb": FEATURES}
    listed = reduce(lambda a, x: a.when(F.col("_to") == x[0], F.array(*map(F.lit, x[1])).cast("array<string>")), agree.items(), F.when(F.lit(False), F.array(F.lit("")))).otherwise(F.array(F.lit("number")))
    verbs = rows.withColumn("_to", to_verb).where(F.col("_to").isNotNull() & near)
    out = [_edges(verbs, i, verb, F.col("_to"), listed, F.when(F.col("_to") == "dem_proform_verb", F.col(f"{v}.law")).otherwise("law1"), *key)]
    out.append(_edges(rows.where((kind == "demonstrative") & determiner), i + 1, i, "dem_det_noun", ("number",), "", *key))
    linked = rows.where((kind == "link") & ~invariant)
    out.append(_edges(linked.where(pos == "ADJ"), i, i + 1, "adjective_invariant", (), "", *key))
    spurious = t.endswith("ی") & F.expr("left(token, length(token) - 1)").isin(*G.PRE_HEAD)
    out.append(_edges(rows.where(((kind == "link") & ~invariant | spurious) & pos.isin("NOUN", "DET", "NUM")), i + 1, i, "noun_det", ("number",), "", *key))
    out.append(_edges(linked.where(pos == "NOUN"), i, i + 1, "ezafe_possessive", ("number",), "", *key))
    out.append(_edges(rows.where(t.isin(*G.RECIPROCAL_VARIANTS) & near), i, verb, "reciprocal_verb", ("number",), F.col(f"{v}.law"), *key))
    out.append(_edges(rows.where((F.col("pos") == "NUM") & (pos == "NOUN")), i, i + 1, "numeral_forces_singular", ("number",), "", *key))
    out.append(_edges(rows.where((F.col("pos") == "NOUN") & (F.col("definiteness") == "def") & (pos == "ADJ")), i, i + 1, "def_marker_migration", ("definiteness",), "", *key))
    out.append(_edges(rows.where(t.isin(*G.CALLS) & pos.isin("NOUN", "PRON")), i, i + 1, "gender_vocative", ("gender",), "", *key))
    return reduce(DataFrame.unionByName, out)


def clitic_edges(tokens: DataFrame, *key: str) -> DataFrame:
    """Edges of clitics: on a verb to what they stand for (the last noun or pronoun of the clause before), with the role that the law of
    the nearest verb gives; on other words possessives, which do not agree."""
    order = Window.partitionBy(*key).orderBy("i")
    t = F.col("token")
    named = F.col("pronoun") | F.col("pos").isin("NOUN", "PRON") | t.isin(*G.PROPER_NOUNS)
    back = order.rowsBetween(Window.unboundedPreceding, -1)
    last = lambda c: F.last(F.when(c, F.struct("i", "upto")), ignorenulls=True).over(back)
    has = reduce(lambda a, b: a | b, (t.endswith(c) & (F.length(t) > len(c) + 1) for c in P.CLITICS))
    rows = tokens.withColumns({"_named": last(named), "_shown": last(named | t.isin(*P.DEMONSTRATIVES))}).where(has & (F.col("case") != "ez"))
    own = F.when(F.col("verb"), F.struct(*_VERB))
    nearest = F.coalesce(own, F.when(F.col("ahead").isNull() | (F.col("i") - F.col("behind.i") <= F.col("ahead.i") - F.col("i")), F.coalesce("behind", "ahead")).otherwise(F.col("ahead")))
    rows = rows.withColumn("_v", nearest)
    within_reach = lambda c: (F.col("i") - F.col(f"{c}.i") <= G.CLITIC_REACH) & (F.col(f"{c}.upto") == F.col("before"))
    out = [_edges(rows.where("not host"), F.col("i"), F.col("i"), "possessive_no_agreement", (), "", *key)]
    hosts, law = rows.where("host"), F.coalesce(F.col("_v.law"), F.lit(""))
    self_ = hosts.where(t.startswith(P.REFLEXIVE) & (F.col("_v.law") == "law2"))
    out.append(_edges(self_, F.col("i"), F.col("_v.i"), "clitic_patient", FEATURES, "law2", *key))
    out.append(_edges(self_.where(within_reach("_named")), F.col("_named.i"), F.col("i"), "reflexive_agreement", FEATURES, "law2", *key))
    role = F.when((law == "law2") & ~F.coalesce(F.col("_v.wistin"), F.lit(False)), "clitic_patient").otherwise("clitic_agent")
    out.append(_edges(hosts.where(~t.startswith(P.REFLEXIVE) & within_reach("_shown")), F.col("_shown.i"), F.col("i"), role, FEATURES, law, *key))
    return reduce(DataFrame.unionByName, out)


def clause_edges(tokens: DataFrame, *key: str) -> DataFrame:
    """Edges of possession, vocatives, relative clauses, adverbs of negation, conditions and participles. Forms of being that are no verbs
    by themselves count as verbs here, behind the others."""
    order = Window.partitionBy(*key).orderBy("i")
    t, i = F.col("token"), F.col("i")
    owns = reduce(lambda a, b: a | b, (t.endswith(p) & (F.length(t) > len(p)) for p in G.POSSESSIVES))
    rows = tokens.withColumn("_owned", F.coalesce(F.max(owns).over(order.rowsBetween(-G.CLITIC_REACH, -1)), F.lit(False)))
    added = F.col("existential") & ~F.col("_owned") & ~F.col("verb")
    rows = rows.withColumns({"_verbal": F.col("verb") | added, "_added": added, "_vt": F.when(added, F.when(t.contains("بوو"), "past").otherwise("present")).otherwise(F.col("vtense")), "_vl": F.when(added, "law1").otherwise(F.col("law"))})
    out = [_edges(rows.where("existential and _owned"), i, i, "existential_possession", FEATURES, "", *key)]

    seen = F.struct("_added", "i", F.col("_vt").alias("tense"), "before", "upto", _begins(t, G.IMPERATIVE_PREFIXES).alias("orders"))
    around = lambda n, m: F.collect_list(F.when(F.col("_verbal"), seen)).over(order.rowsBetween(n, m))
    same = lambda v: F.when(v["i"] > i, v["before"] == F.col("upto")).otherwise(v["upto"] == F.col("before"))
    first = lambda vs: F.try_element_at(F.array_sort(vs), F.lit(1))  # noqa: E731  verbs before added ones, then by place
    rows = rows.withColumns({"_near": around(-G.CALL_REACH, G.CALL_REACH), "_soon": around(1, G.CONDITION_REACH), "_later": F.count_if(F.col("verb")).over(M.backwards(*key).rowsBetween(Window.unboundedPreceding, -G.CONDITION_REACH - 1))})
    called = ~F.col("_verbal") & ~F.col("pos").isin("ADP", "ADV", "SCONJ", "PUNCT") & reduce(lambda a, b: a | b, (t.endswith(e) for e in G.CALL_ENDINGS))
    vocative = rows.where(called).withColumn("_v", first(F.filter("_near", lambda v: (v["tense"] == "imperative") & ~v["_added"] & v["orders"] & same(v)))).where("_v is not null")
    out.append(_edges(vocative, i, F.col("_v.i"), "vocative_imperative", ("number",), "law1", *key))
    never = rows.where(t == G.NEVER).withColumn("_v", first(F.filter("_near", same))).where("_v.tense = 'present'")
    out.append(_edges(never, i, F.col("_v.i"), "adverb_verb_tense", ("tense",), "", *key))
    condition = rows.where(t.isin(*G.CONDITIONALS)).withColumn("_v", first(F.filter("_soon", lambda v: same(v) & (~v["_added"] | (F.col("_later") == 0))))).where("_v is not null")
    out.append(_edges(condition, i, F.col("_v.i"), "conditional_agreement", ("tense",), "", *key))

    before = order.rowsBetween(Window.unboundedPreceding, -1)
    ante = F.last(F.when(F.col("pos").isin("NOUN", "PRON"), i), ignorenulls=True).over(before)
    verb = M.next_of(F.when(F.col("_verbal") & ~F.col("boundary"), F.struct("i", "upto", F.col("_vl").alias("law"))), *key)
    relative = rows.withColumns({"_ante": ante, "_v": verb}).where((t == G.RELATIVE) & (i - F.col("_ante") <= G.ANTECEDENT_REACH) & (F.col("_v.i") - i <= G.RELATIVE_REACH) & (F.col("_v.upto") == F.col("upto")))
    out.append(_edges(relative, F.col("_ante"), F.col("_v.i"), "relative_clause", FEATURES, F.col("_v.law"), *key))

    noun = F.when((F.col("pos") == "NOUN") & ~F.col("_verbal"), i)
    head = F.coalesce(F.min(noun).over(order.rowsBetween(-4, -1)), F.min(noun).over(order.rowsBetween(1, 3)))
    long = F.length(t) > 2
    participle = (long & t.endswith(G.PATIENT_ENDING) & ~_begins(t, G.PRESENT_PREFIXES)) | (long & t.endswith(G.AGENT_ENDING) & ~F.col("pos").isin("ADP", "DET", "PUNCT"))
    modified = rows.withColumn("_head", head).where(participle & ~F.col("_verbal") & F.col("_head").isNotNull())
    out.append(_edges(modified, F.col("_head"), i, "participial_modification", ("tense",), "", *key))
    return reduce(DataFrame.unionByName, out)


def agreement_edges(tokens: DataFrame, *key: str) -> DataFrame:
    """key, source, target, type, features, law: all edges of graph_tokens(), as a table, each once."""
    spans = saved(subject_spans(tokens, *key))
    laws = saved(law_edges(tokens, spans, *key))
    every = (laws, object_edges(tokens, spans, laws, *key), phrase_edges(tokens, *key), clitic_edges(tokens, *key), clause_edges(tokens, *key))
    return saved(reduce(DataFrame.unionByName, every).dropDuplicates([*key, "source", "target", "type"]))


CHECKED = tuple(f for f in KEPT if f != "pos")


def violations(tokens: DataFrame, edges: DataFrame, *key: str) -> DataFrame:
    """key, source, target, type, feature, law, source_value, target_value: features of edges that both ends have, with other values.
    Agents that do not agree are left out."""
    value = F.create_map(*(x for f in CHECKED for x in (F.lit(f), F.col(f))))
    values = tokens.select(*key, "i", value.alias("v"))
    long = edges.where("type <> 'agent_non_agreeing'").select(*key, "source", "target", "type", "law", F.explode("features").alias("feature"))
    end = lambda side: values.select(*key, F.col("i").alias(side), F.col("v").alias(f"_{side}"))
    both = long.join(end("source"), [*key, "source"]).join(end("target"), [*key, "target"])
    of = lambda side: F.coalesce(F.try_element_at(f"_{side}", F.col("feature")), F.lit("")).alias(f"{side}_value")
    out = both.select(*key, "source", "target", "type", "feature", "law", of("source"), of("target"))
    return out.where("source_value <> '' and target_value <> '' and source_value <> target_value")


def edge_counts(edges: DataFrame, *key: str) -> DataFrame:
    """type, n, sentences: edges of each type, and the sentences with one."""
    by = edges.groupBy("type", *key).agg(F.count("*").alias("n"))
    return by.groupBy("type").agg(F.sum("n").alias("n"), F.count("*").alias("sentences"))


def adjacency(tokens: DataFrame, edges: DataFrame, *key: str, types: int = 2 * len(G.EDGE_TYPES)) -> DataFrame:
    """key, type, place (of the type in the model's order), n, rows, starts, columns: the sparse matrix of each type of edge of a sentence.
    rows are the tokens with an edge; the targets of rows[k] are columns[starts[k]] to columns[starts[k + 1]] (exclusive). Types beyond
    the known ones follow in their names' order, up to `types` in all."""
    order = F.create_map(*(F.lit(x) for i, t in enumerate(G.EDGE_TYPES) for x in (t, i)))
    other = edges.select("type").distinct().where(~F.col("type").isin(*G.EDGE_TYPES))
    other = other.withColumn("_o", F.row_number().over(Window.orderBy("type")) + len(G.EDGE_TYPES) - 1)  # a row a type
    sizes = tokens.groupBy(*key).agg(F.max("n").alias("n"))
    by_row = edges.groupBy(*key, "type", "source").agg(F.array_sort(F.collect_set("target")).alias("targets"))
    until = F.sum(F.size("targets")).over(Window.partitionBy(*key, "type").orderBy("source").rowsBetween(Window.unboundedPreceding, 0))
    listed = F.array_sort(F.collect_list(F.struct("source", "until", "targets")))
    cells = by_row.withColumn("until", until).groupBy(*key, "type").agg(listed.alias("c")).join(sizes, list(key))
    place = F.coalesce(F.try_element_at(order, F.col("type")), F.col("_o")).cast("int")
    cells = cells.join(F.broadcast(other), "type", "left").withColumn("place", place).where(F.col("place") < types)
    return cells.select(*key, "type", "place", "n", F.col("c.source").alias("rows"), F.concat(F.array(F.lit(0).cast("bigint")), "c.until").alias("starts"), F.flatten("c.targets").alias("columns"))


# Roles of the ends of edges.
SOURCE_ROLES = {
    "subject_verb": "subject", "passive_subject_verb": "subject", "backward_subject_verb": "subject", "object_verb_ergative": "object", "object_verb_ergative_zero": "object", "agent_non_agreeing": "subject", "clitic_agent": "clitic_subject",
    "clitic_patient": "clitic_object", "noun_det": "noun", "adjective_invariant": "adjective", "dem_det_noun": "determiner", "dem_proform_verb": "demonstrative", "quantifier_verb": "quantifier", "measure_word_verb": "measure",
    "possessive_no_agreement": "possessor", "oblique_no_agreement": "oblique", "pro_drop_agreement": "pro_subject", "vocative_imperative": "vocative", "relative_clause": "relative", "conditional_agreement": "conditional",
    "collective_singular": "collective", "collective_plural": "collective", "mass_noun_no_agreement": "mass_noun", "gender_vocative": "vocative_particle", "ezafe_possessive": "possessor", "participial_modification": "participle", "reflexive_agreement": "reflexive",
}
TARGET_ROLES = {
    "subject_verb": "verb", "passive_subject_verb": "verb", "backward_subject_verb": "verb", "object_verb_ergative": "verb", "object_verb_ergative_zero": "verb", "clitic_agent": "verb", "clitic_patient": "verb", "noun_det": "determiner",
    "dem_det_noun": "noun", "dem_proform_verb": "verb", "quantifier_verb": "verb", "measure_word_verb": "verb", "vocative_imperative": "verb", "gender_vocative": "noun", "ezafe_possessive": "possessed", "participial_modification": "noun",
    "reflexive_agreement": "verb",
}


def token_roles(edges: DataFrame, *key: str) -> DataFrame:
    """key, i, roles (sorted): what tokens are in their edges."""
    lookup = lambda table: F.try_element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), F.col("type"))
    ends = F.array(F.struct(F.col("source").alias("i"), lookup(SOURCE_ROLES).alias("role")), F.struct(F.col("target").alias("i"), lookup(TARGET_ROLES).alias("role")))
    return edges.select(*key, F.inline(ends)).where("role is not null").groupBy(*key, "i").agg(F.array_sort(F.collect_set("role")).alias("roles"))
