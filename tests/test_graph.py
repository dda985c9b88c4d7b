"""Agreement graphs: golden sentences, and edges of random sentences against definitions tried token by token."""

import random

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import graph_profile as G
from corpusloom.operators import graph as A

WORDS = (
    "من تۆ ئەو ئێمە و و و نە یا کوڕ کچ پیاوەکە کتێبەکان گەورە جوان دەچم هاتن خوێند ناردی نووسیمان کوژرا بنووسە کردن ، ؟ کە ئەگەر لە بۆ زۆر دوو هەموو ئاو پەرداخ خەڵک ئەمە کوڕی کتێبم خوێندیان بوو هەیە پارەمان هۆ کوڕۆ نووسراو یەکتر هەرگیز".split()
)


def sentences() -> list:
    r = random.Random(11)
    return [" ".join(r.choices(WORDS, k=r.randint(0, 25))) for _ in range(250)] + [" ".join(r.choices(["من", "و", "دەچم", "کوڕ"], k=400)), "", "من"]


@pytest.fixture(scope="module")
def graph(spark):
    rows = spark.createDataFrame([*enumerate(sentences()), (9999, None)], "id long, s string").repartition(5)
    tokens = A.graph_tokens(rows, "s", "id")
    spans = A.subject_spans(tokens, "id")
    laws = A.law_edges(tokens, spans, "id")
    by = {}
    for t in tokens.orderBy("id", "i").collect():
        by.setdefault(t.id, []).append(t)
    return {"tokens": tokens, "by": by, "spans": spans.collect(), "laws": laws.collect(), "objects": A.object_edges(tokens, spans, laws, "id").collect(), "edges": A.agreement_edges(tokens, "id")}


def clear(ts, a: int, b: int) -> bool:
    return not any(t.boundary for t in ts[min(a, b) + 1 : max(a, b)])


def coordinated(ts, first: int) -> tuple[list, bool]:
    """Pronouns that are coordinated from `first` on: with `and`, then with negative conjunctions."""
    found, negative = [first], first > 0 and ts[first - 1].token in G.NEGATIVE_CONJUNCTIONS
    for words, negates in (((G.AND,), False), (G.NEGATIVE_CONJUNCTIONS, True)):
        while (k := found[-1] + 2) < len(ts) and ts[k].pronoun and ts[k - 1].token in words:
            found.append(k)
            negative |= negates
    return found, negative


def test_spans(graph):
    want = set()
    for key, ts in graph["by"].items():
        taken, at = set(), 0
        while at < len(ts):
            if not ts[at].pronoun:
                at += 1
                continue
            members, negative = coordinated(ts, at)
            pn = (ts[at].person, ts[at].number) if len(members) == 1 or negative else (min(ts[m].person for m in members), "pl")
            want.add((key, tuple(members), *pn))
            at = members[-1] + 1
        nouns = [t.i for t in ts if t.pos == "NOUN"]
        linked = {b: a for a, b in zip(nouns, nouns[1:]) if ts[b - 1].token == G.AND and all(t.pos == "ADJ" for t in ts[a + 1 : b - 1]) and b - 1 > a}
        for start in [n for n in nouns if n not in linked]:
            members = [start]
            while nxt := [b for b, a in linked.items() if a == members[-1]]:
                members += nxt
            if len(members) > 1:
                taken |= set(members)
                want.add((key, tuple(members), "3", "pl"))
        for t in ts:
            follows = any(v.verb and 0 < v.i - t.i <= 8 and clear(ts, t.i, v.i) for v in ts)
            if t.i not in taken and follows and (t.subject_noun or (t.bare and not (t.i and ts[t.i - 1].token in G.NOT_BARE_AFTER))):
                want.add((key, (t.i,), "3", "" if t.bare else t.number))
    assert {(s.id, tuple(s.members), s.person, s.number) for s in graph["spans"]} == want


def test_laws(graph):
    want = set()
    for key, ts in graph["by"].items():
        spans = [s for s in graph["spans"] if s.id == key]
        for v in (t for t in ts if t.verb):
            near = sorted((s for s in spans if 0 < v.i - s.last <= 8 and clear(ts, s.last, v.i)), key=lambda s: s.last)
            for k, s in enumerate(near):
                if v.law == "law1":
                    want.add((key, s.first, v.i, "passive_subject_verb" if v.passive else "subject_verb", ("person", "number") if s.number else ("person",)))
                else:
                    last = len(near) > 1 and k == len(near) - 1
                    want.add((key, s.first, v.i, "object_verb_ergative" if last else "agent_non_agreeing", ("person", "number") if last else ()))
    got = [(e.id, e.source, e.target, e.type, tuple(e.features)) for e in graph["laws"]]
    assert len(got) == len(set(got)) and set(got) == want and {t[3] for t in want} >= {"subject_verb", "object_verb_ergative", "agent_non_agreeing"}


def test_objects(graph):
    want = set()
    for key, ts in graph["by"].items():
        inside = {m for s in graph["spans"] if s.id == key for m in s.members}
        linked = {(e.target, e.type) for e in graph["laws"] if e.id == key}
        for v in (t for t in ts if t.verb):
            if v.law == "law1" and not linked & {(v.i, "subject_verb"), (v.i, "passive_subject_verb")}:
                fits = [t for t in ts[v.i + 1 : v.i + 8] if (t.pronoun or t.bare or t.subject_noun) and ts[t.i - 1].pos != "ADP" and clear(ts, v.i, t.i)]
                if fits:
                    want.add((key, fits[0].i, v.i, "backward_subject_verb"))
            if v.law == "law2":
                fits = [t for t in ts[max(v.i - 9, 0) : v.i] if t.pos == "NOUN" and t.i not in inside and clear(ts, t.i, v.i)]
                if fits:
                    want.add((key, fits[-1].i, v.i, "object_verb_ergative_zero" if fits[-1].bare else "object_verb_ergative"))
            if v.person and not linked & {(v.i, "subject_verb"), (v.i, "agent_non_agreeing")}:
                want.add((key, v.i, v.i, "pro_drop_agreement"))
    assert {(e.id, e.source, e.target, e.type) for e in graph["objects"]} == want and {x[3] for x in want} >= {"backward_subject_verb", "object_verb_ergative_zero", "pro_drop_agreement"}


GOLDEN = {
    "من دەچم": {("subject_verb", 0, 1)}, "من و تۆ دەچین": {("subject_verb", 0, 3)}, "من نان خوارد": {("agent_non_agreeing", 0, 2)}, "هەموو خەڵک دەچن": {("collective_plural", 1, 2), ("quantifier_verb", 0, 2)}, "خەڵک دەچێت": {("collective_singular", 0, 1)},
    "کوڕی گەورەتر هات": {("adjective_invariant", 0, 1)}, "کوڕی مامۆستا هات": {("ezafe_possessive", 0, 1), ("noun_det", 1, 0)}, "ئەم کتێب جوان": {("dem_det_noun", 1, 0)}, "ئەگەر دەچم": {("conditional_agreement", 0, 1)}, "هەرگیز دەچم": {("adverb_verb_tense", 0, 1)},
    "دوو کتێبەکان هات": {("numeral_forces_singular", 0, 1)}, "کتێبەکە جوان هات": {("def_marker_migration", 0, 1)}, "پیاوەکە کە دەچێت": {("relative_clause", 0, 2)}, "کوڕۆ بنووسە": {("vocative_imperative", 0, 1)}, "کتێبت هەیە": {("existential_possession", 1, 1), ("possessive_no_agreement", 0, 0)},
    "دەچم من": {("backward_subject_verb", 1, 0)}, "دەچم": {("pro_drop_agreement", 0, 0)}, "هۆ کوڕ هات": {("gender_vocative", 0, 1)}, "ئاو خوارد": {("mass_noun_no_agreement", 0, 1)}, "پەرداخ ئاو خوارد": {("measure_word_verb", 0, 2)}, "من کە دەچم": {("relative_clause", 0, 2)},
}
VIOLATED = {"من دەچم": set(), "من دەچین": {("subject_verb", "number")}, "تۆ دەچم": {("subject_verb", "person")}, "من و تۆ دەچین": {("subject_verb", "number")}}


def test_golden(spark):
    rows = spark.createDataFrame(list(enumerate([*GOLDEN, *VIOLATED])), "id long, s string")
    tokens = A.graph_tokens(rows, "s", "id")
    edges = A.agreement_edges(tokens, "id")
    got = {}
    for e in edges.collect():
        got.setdefault(e.id, set()).add((e.type, e.source, e.target))
    for i, (s, want) in enumerate(GOLDEN.items()):
        assert want <= got.get(i, set()), (s, want, got.get(i))
    wrong = {}
    for v in A.violations(tokens, edges, "id").where(F.col("type") == "subject_verb").collect():
        wrong.setdefault(v.id, set()).add((v.type, v.feature))
    assert {s: wrong.get(len(GOLDEN) + i, set()) for i, s in enumerate(VIOLATED)} == VIOLATED
    roles = {(r.id, r.i): r.roles for r in A.token_roles(edges, "id").collect()}
    assert "subject" in roles[0, 0] and "verb" in roles[0, 1]


def test_edges_are_there_once(graph):
    edges = graph["edges"]
    assert edges.count() == edges.select("id", "source", "target", "type").distinct().count() and {r.type for r in edges.select("type").distinct().collect()} <= set(G.EDGE_TYPES)
    ends = edges.join(graph["tokens"].groupBy("id").agg(F.max("n").alias("n")), "id")
    assert ends.where("source < 0 or target < 0 or source >= n or target >= n").count() == 0


def test_adjacency(graph):
    """Sparse matrices, expanded, are the edges; unknown types follow the known ones, up to the limit."""
    edges = graph["edges"]
    more = edges.limit(3).withColumn("type", F.concat(F.lit("new "), (F.monotonically_increasing_id() % 2).cast("string")))
    rows = A.adjacency(graph["tokens"], edges.unionByName(more), "id").collect()
    got = {(r.id, r.type, s, c) for r in rows for k, s in enumerate(r.rows) for c in r.columns[r.starts[k] : r.starts[k + 1]]}
    assert got == {(e.id, e.type, e.source, e.target) for e in edges.unionByName(more).collect()}
    assert all(r.place == (G.EDGE_TYPES.index(r.type) if r.type in G.EDGE_TYPES else len(G.EDGE_TYPES) + int(r.type[4:])) and r.starts[-1] == len(r.columns) for r in rows)
    assert all(r.place < 34 for r in A.adjacency(graph["tokens"], edges.unionByName(more), "id", types=34).collect())
