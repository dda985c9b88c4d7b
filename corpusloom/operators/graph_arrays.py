"""The edges of operators/graph.py on arrays of a block's tokens, for all sentences of a corpus.

Nothing looks beyond a sentence, so a window is a running sum or maximum, an as-of lookup an index, and a band join a step to each of the
few places that a relation reaches. Edges are arrays of the same length: sentence, source, target, type, features, law.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from corpusloom.functions import graph_profile as G
from corpusloom.functions import morph_profile as P
from corpusloom.operators import blocks, graph
from corpusloom.operators import morphology as M
from corpusloom.operators.blocks import Sentences, _take

_TEXTS, _FLAGS = (*graph.KEPT, "law", "vtense"), (*graph.KINDS, "passive", "wistin")
LAWS = ("", "law1", "law2")
FEATURES = ((), ("person",), ("person", "number"), ("number",), ("definiteness",), ("gender",), ("tense",))
NONE, PERSON, BOTH, NUMBER, DEFINITE, GENDER, TENSE = range(len(FEATURES))
TYPES = {t: n for n, t in enumerate(G.EDGE_TYPES)}
SPAN_KINDS = ("pronoun", "nouns", "bare", "noun")


def classes(distinct: DataFrame) -> DataFrame:
    """token and f: what the graph asks of distinct tokens, in one string."""
    rows = graph.verb_classes(M.token_features(distinct))
    flags = (F.coalesce(F.col(c), F.lit(False)).cast("int").cast("string") for c in _FLAGS)
    return rows.select("token", F.concat_ws("\t", *(F.coalesce(F.col(c), F.lit("")) for c in _TEXTS), *flags).alias("f"))


class Block:
    """What is known of a block's distinct tokens: arrays by their number."""

    def __init__(self, words: list[str], told: list[str]):
        number = {f: n for n, f in enumerate(dict.fromkeys(told))}
        of = np.fromiter((number[f] for f in told), np.int64, len(told))
        parts = [f.split("\t") for f in number]
        self.names = {}
        for n, c in enumerate((*_TEXTS, *_FLAGS)):
            column = [p[n] for p in parts]
            if c in _FLAGS:
                self.__dict__[c] = np.array([v == "1" for v in column], bool)[of]
                continue
            # Numbers of values follow their order, the empty one first.
            names = sorted({"", *column})
            self.names[c] = {v: k for k, v in enumerate(names)}
            self.__dict__[c] = np.array([self.names[c][v] for v in column], np.int16)[of]
        self.law = np.array([LAWS.index(p[_TEXTS.index("law")]) for p in parts], np.int16)[of]
        flag = lambda test: np.fromiter(map(test, words), bool, len(words))
        among = lambda some: flag(frozenset(some).__contains__)
        begins = lambda some: flag(lambda t: t.startswith(tuple(some)))
        longer = lambda some, more: flag(lambda t: any(t.endswith(e) and len(t) > len(e) + more for e in some))
        self.is_and, self.negative, self.not_bare_after = among([G.AND]), among(G.NEGATIVE_CONJUNCTIONS), among(G.NOT_BARE_AFTER)
        self.invariant = among([*P.ADJECTIVES, *G.INVARIANT_PRONOUNS, *G.POSSESSIVES, *P.RECIPROCALS])
        self.nominal = ~among(P.SUBJECT_PRONOUNS) & ~begins(G.VERB_PREFIXES)
        self.measure, self.universal, self.demonstrative, self.reciprocal, self.calls = among(G.MEASURES), among(G.UNIVERSAL), among(P.DEMONSTRATIVES), among(G.RECIPROCAL_VARIANTS), among(G.CALLS)
        link = flag(lambda t: t.endswith("ی") and len(t) > 1)
        tests = (among([*P.QUANTIFIERS, *G.INDEFINITE_QUANTIFIERS]), self.measure, among(G.MASS_NOUNS), among(G.COLLECTIVES), self.demonstrative, link)
        self.chain = np.select(tests, range(1, 7), 0)
        before_head = frozenset(G.PRE_HEAD)
        self.spurious = flag(lambda t: t.endswith("ی") and t[:-1] in before_head)
        self.proper, self.clitic, self.reflexive = among(G.PROPER_NOUNS), longer(P.CLITICS, 1), begins([P.REFLEXIVE])
        self.owns, self.was, self.orders = longer(G.POSSESSIVES, 0), flag(lambda t: "بوو" in t), begins(G.IMPERATIVE_PREFIXES)
        self.calling, self.never, self.conditional, self.relative = flag(lambda t: t.endswith(tuple(G.CALL_ENDINGS))), among([G.NEVER]), among(G.CONDITIONALS), among([G.RELATIVE])
        self.patient = flag(lambda t: len(t) > 2 and t.endswith(G.PATIENT_ENDING)) & ~begins(G.PRESENT_PREFIXES)
        self.agent = flag(lambda t: len(t) > 2 and t.endswith(G.AGENT_ENDING))

    def pos_in(self, *names: str) -> np.ndarray:
        return np.isin(self.pos, [self.names["pos"].get(n, -1) for n in names])


class Graph:
    """Spans and edges of a part of a block."""

    def __init__(self, block: Block, s: Sentences):
        self.b, self.s = block, s
        self.pos, self.pronoun, self.bare, self.noun, self.verb, self.law, self.boundary = (self.of(c) for c in ("pos", "pronoun", "bare", "subject_noun", "verb", "law", "boundary"))
        self.upto = s.running(self.boundary)
        self.before = self.upto - self.boundary
        self.previous, self.following = s.shifted(-1), s.shifted(1)
        self.ahead, self.behind = s.next(self.verb), s.last(self.verb)

    def of(self, name: str) -> np.ndarray:
        return getattr(self.b, name)[self.s.code]

    def is_pos(self, *names: str) -> np.ndarray:
        return self.b.pos_in(*names)[self.s.code]

    def value(self, feature: str, v: str) -> np.ndarray:
        return self.of(feature) == self.b.names[feature].get(v, -1)

    def at(self, values: np.ndarray, index: np.ndarray) -> np.ndarray:
        """A flag of other tokens; those that do not exist have none."""
        return _take(values, index, False)

    def reaches(self, verb: np.ndarray, reach: int) -> np.ndarray:
        return (verb >= 0) & (verb - self.s.at <= reach) & (_take(self.before, verb, -1) == self.upto)

    def edges(self, where, source, target, kind, features, law):
        """where: tokens (a mask) that have an edge; source and target: indices; all else by token, or one for all."""
        rows = np.flatnonzero(where)
        pick = lambda x: np.full(len(rows), x) if np.isscalar(x) else np.asarray(x)[rows]
        source, target = pick(source), pick(target)
        return self.listed(source, target, pick(kind), pick(features), pick(law))

    def listed(self, source, target, kind, features, law):
        s = self.s
        return np.stack([s.sentence[source], s.i[source], s.i[target], kind, features, law]).astype(np.int64)

    def spans(self) -> dict[str, np.ndarray]:
        """first, last (indices of tokens), members (how many), person, number (numbers of their values; -1 is the third person and the
        plural), kind, upto; and inside: tokens that are in a span."""
        s = self.s
        person, number = self.of("person"), self.of("number")
        after_and, after_no = self.at(self.of("is_and"), self.previous), self.at(self.of("negative"), self.previous)
        inside = self.pronoun.copy()

        rows = np.flatnonzero(self.pronoun)
        joined = self.at(self.pronoun, s.shifted(-2))
        link = np.select([joined & after_and, joined & after_no], [1, 2], 0)[rows]
        linked = (link > 0) & ~((link == 1) & (np.concatenate([[0], link[:-1]]) == 2)) if len(rows) else np.zeros(0, bool)
        first = np.flatnonzero(~linked)
        last = np.concatenate([first[1:], [len(rows)]])[: len(first)] - 1
        neither = np.add.reduceat((link == 2).astype(int), first) if len(first) else first
        least = np.minimum.reduceat(person[rows], first) if len(first) else first
        a, z, m = rows[first], rows[last], last - first + 1
        one = (m == 1) | (neither > 0) | after_no[a]
        spans = [(a, z, m, np.where(one, person[a], least), np.where(one, number[a], -1), np.zeros(len(a), int))]

        rows = np.flatnonzero(self.is_pos("NOUN"))
        is_noun = self.is_pos("NOUN")
        linked = (after_and & self.at(is_noun, s.last(~self.is_pos("ADJ"), 2)))[rows]
        first = np.flatnonzero(~linked)
        last = np.concatenate([first[1:], [len(rows)]])[: len(first)] - 1
        size = last - first + 1
        grouped = np.zeros(s.n, bool)
        grouped[rows[np.repeat(size > 1, size)]] = True
        several = size > 1
        a, z, m = rows[first[several]], rows[last[several]], size[several]
        spans.append((a, z, m, np.full(len(a), -1), np.full(len(a), -1), np.ones(len(a), int)))

        quantified = self.at(self.of("not_bare_after"), self.previous)
        single = self.reaches(self.ahead, G.SUBJECT_REACH) & ~self.value("case", "obl") & ((self.bare & ~quantified) | self.noun) & ~grouped
        a = np.flatnonzero(single)
        bare = self.bare[a]
        spans.append((a, a, np.ones(len(a), int), np.full(len(a), -1), np.where(bare, 0, number[a]), np.where(bare, 2, 3)))
        out = {c: np.concatenate([p[n] for p in spans]) for n, c in enumerate(("first", "last", "members", "person", "number", "kind"))}
        out["upto"], out["inside"] = self.upto[out["last"]], inside | grouped | single
        return out

    def laws(self, spans: dict[str, np.ndarray]):
        """Edges of both laws, and of verbs (flags): a subject, a link."""
        s, found = self.s, []
        for d in range(1, G.SUBJECT_REACH + 1):
            to = spans["last"] + d
            fits = to < s.end[spans["last"]]
            to = np.where(fits, to, 0)
            fits = fits & self.verb[to] & (self.before[to] == spans["upto"]) if s.n else fits
            k = np.flatnonzero(fits)
            found.append(np.stack([k, to[k]]))
        k, to = np.concatenate(found, axis=1)
        first, last, agree = spans["first"][k], spans["last"][k], np.where(spans["number"][k] == 0, PERSON, BOTH)
        law = self.law[to]
        many = np.bincount(to[law == 2], minlength=s.n)
        final = np.full(s.n, -1)
        np.maximum.at(final, to[law == 2], last[law == 2])
        is_object = (many[to] > 1) & (last == final[to])
        kind = np.where(law == 1, np.where(self.of("passive")[to], TYPES["passive_subject_verb"], TYPES["subject_verb"]), np.where(is_object, TYPES["object_verb_ergative"], TYPES["agent_non_agreeing"]))
        features = np.where(law == 1, agree, np.where(is_object, BOTH, NONE))
        subject, linked = np.zeros(s.n, bool), np.zeros(s.n, bool)
        subject[to[law == 1]] = True
        linked[to[np.isin(kind, [TYPES["subject_verb"], TYPES["agent_non_agreeing"]])]] = True
        return self.listed(first, to, kind, features, law), subject, linked

    def objects(self, spans, subject: np.ndarray, linked: np.ndarray):
        s, at = self.s, self.s.at
        candidate = (self.pronoun | self.bare | self.noun) & ~self.at(self.is_pos("ADP"), self.previous)
        behind, noun = s.next(candidate), s.last(~spans["inside"] & self.is_pos("NOUN"))
        late = self.verb & (self.law == 1) & ~subject & (behind >= 0) & (behind - at <= G.BACKWARD_REACH) & (_take(self.upto, behind, -1) == self.upto)
        alone = self.at(self.bare & ~self.pronoun, behind)
        out = [self.edges(late, behind, at, TYPES["backward_subject_verb"], np.where(alone, PERSON, BOTH), 1)]
        objects = self.verb & (self.law == 2) & (noun >= 0) & (at - noun <= G.OBJECT_REACH) & (_take(self.upto, noun, -1) == self.before)
        oblique, bare = self.at(self.value("case", "obl"), noun), self.at(self.bare, noun)
        kind = np.select([oblique, bare], [TYPES["oblique_no_agreement"], TYPES["object_verb_ergative_zero"]], TYPES["object_verb_ergative"])
        out.append(self.edges(objects, noun, at, kind, np.where(oblique | bare, NONE, BOTH), 2))
        out.append(self.edges(self.verb & ~linked & (self.of("person") > 0), at, at, TYPES["pro_drop_agreement"], BOTH, self.law))
        return np.concatenate(out, axis=1)

    def phrases(self):
        at, follows = self.s.at, self.following >= 0
        word = lambda name: self.at(self.of(name), self.following)
        pos = lambda *names: self.at(self.is_pos(*names), self.following)
        near, verb, chain = self.reaches(self.ahead, G.QUANTIFIER_REACH), self.ahead, self.of("chain")
        invariant, nominal = word("invariant"), word("nominal")
        determiner = nominal & ~invariant & ~pos("VERB", "ADP", "CONJ", "PRON", "PUNCT")
        universal = self.at(self.of("universal"), self.previous)
        tests = (((chain == 1) & nominal & ~word("is_and") & pos("NOUN", "ADJ", "DET"), "quantifier_verb", NUMBER), (chain == 2, "measure_word_verb", NUMBER), ((chain == 3) & ~word("measure"), "mass_noun_no_agreement", NONE), ((chain == 4) & universal, "collective_plural", NUMBER), (chain == 4, "collective_singular", PERSON), ((chain == 5) & ~determiner, "dem_proform_verb", BOTH))
        masks = [m for m, _, _ in tests]
        kind, features = np.select(masks, [TYPES[t] for _, t, _ in tests], -1), np.select(masks, [f for _, _, f in tests], NONE)
        verb_law = _take(self.law, verb, 0)
        out = [self.edges(follows & (kind >= 0) & near, at, verb, kind, features, np.where(kind == TYPES["dem_proform_verb"], verb_law, 1))]
        link, behind = follows & (chain == 6) & ~invariant, at + 1
        out.append(self.edges(follows & (chain == 5) & determiner, behind, at, TYPES["dem_det_noun"], NUMBER, 0))
        out.append(self.edges(link & pos("ADJ"), at, behind, TYPES["adjective_invariant"], NONE, 0))
        out.append(self.edges((link | (follows & self.of("spurious"))) & pos("NOUN", "DET", "NUM"), behind, at, TYPES["noun_det"], NUMBER, 0))
        out.append(self.edges(link & pos("NOUN"), at, behind, TYPES["ezafe_possessive"], NUMBER, 0))
        out.append(self.edges(follows & self.of("reciprocal") & near, at, verb, TYPES["reciprocal_verb"], NUMBER, verb_law))
        out.append(self.edges(self.is_pos("NUM") & pos("NOUN"), at, behind, TYPES["numeral_forces_singular"], NUMBER, 0))
        out.append(self.edges(self.is_pos("NOUN") & self.value("definiteness", "def") & pos("ADJ"), at, behind, TYPES["def_marker_migration"], DEFINITE, 0))
        out.append(self.edges(self.of("calls") & pos("NOUN", "PRON"), at, behind, TYPES["gender_vocative"], GENDER, 0))
        return np.concatenate(out, axis=1)

    def clitics(self):
        s, at = self.s, self.s.at
        named = self.pronoun | self.is_pos("NOUN", "PRON") | self.of("proper")
        last_named, last_shown = s.last(named), s.last(named | self.of("demonstrative"))
        bears, host, reflexive = self.of("clitic") & ~self.value("case", "ez"), self.of("host"), self.of("reflexive")
        back = (self.ahead < 0) | ((self.behind >= 0) & (at - self.behind <= self.ahead - at))
        verb = np.where(self.verb, at, np.where(back & (self.behind >= 0), self.behind, self.ahead))
        law = _take(self.law, verb, 0)
        within = lambda x: (x >= 0) & (at - x <= G.CLITIC_REACH) & (_take(self.upto, x, -1) == self.before)
        own = bears & host & reflexive & (law == 2)
        role = np.where((law == 2) & ~self.at(self.of("wistin"), verb), TYPES["clitic_patient"], TYPES["clitic_agent"])
        return np.concatenate([
            self.edges(bears & ~host, at, at, TYPES["possessive_no_agreement"], NONE, 0), self.edges(own, at, verb, TYPES["clitic_patient"], BOTH, 2),
            self.edges(own & within(last_named), last_named, at, TYPES["reflexive_agreement"], BOTH, 2), self.edges(bears & host & ~reflexive & within(last_shown), last_shown, at, role, BOTH, law),
        ], axis=1)

    def clauses(self):
        s, at = self.s, self.s.at
        existential = self.of("existential")
        owned = reduce(np.logical_or, (self.at(self.of("owns"), s.shifted(-d)) for d in range(1, G.CLITIC_REACH + 1)))
        added = existential & ~owned & ~self.verb
        verbal, law = self.verb | added, np.where(added, 1, self.law)
        past = self.of("was")
        present = np.where(added, ~past, self.value("vtense", "present"))
        imperative = ~added & self.value("vtense", "imperative") & self.of("orders")
        out = [self.edges(existential & owned, at, at, TYPES["existential_possession"], BOTH, 0)]

        def first(where: np.ndarray, a: int, b: int, fits) -> np.ndarray:
            """For tokens of a mask, the first verb from a to b places behind that fits; those that were added come after the others."""
            rows = np.flatnonzero(where)
            found = [np.full(len(rows), -1), np.full(len(rows), -1)]
            for d in range(a, b + 1):
                to = s.shifted(d)[rows]
                ok = (to >= 0) & self.at(verbal, to)
                same = np.where(d > 0, _take(self.before, to, -1) == self.upto[rows], _take(self.upto, to, -1) == self.before[rows])
                ok &= same & fits(rows, to)
                for n, kind in enumerate((~self.at(added, to), self.at(added, to))):
                    found[n] = np.where((found[n] < 0) & ok & kind, to, found[n])
            verb = np.full(s.n, -1)
            verb[rows] = np.where(found[0] >= 0, found[0], found[1])
            return verb

        called = ~verbal & ~self.is_pos("ADP", "ADV", "SCONJ", "PUNCT") & self.of("calling")
        v = first(called, -G.CALL_REACH, G.CALL_REACH, lambda _, to: self.at(imperative, to))
        out.append(self.edges(v >= 0, at, v, TYPES["vocative_imperative"], NUMBER, 1))
        v = first(self.of("never"), -G.CALL_REACH, G.CALL_REACH, lambda _, to: to >= 0)
        out.append(self.edges((v >= 0) & self.at(present, v), at, v, TYPES["adverb_verb_tense"], TENSE, 0))
        verbs = np.concatenate([[0], np.cumsum(self.verb)])
        later = verbs[s.end] - verbs[np.minimum(at + G.CONDITION_REACH + 1, s.end)]
        v = first(self.of("conditional"), 1, G.CONDITION_REACH, lambda rows, to: ~self.at(added, to) | (later[rows] == 0))
        out.append(self.edges(v >= 0, at, v, TYPES["conditional_agreement"], TENSE, 0))

        ante, v = s.last(self.is_pos("NOUN", "PRON")), s.next(verbal & ~self.boundary)
        relative = self.of("relative") & (ante >= 0) & (at - ante <= G.ANTECEDENT_REACH) & (v >= 0) & (v - at <= G.RELATIVE_REACH) & (_take(self.upto, v, -1) == self.upto)
        out.append(self.edges(relative, ante, v, TYPES["relative_clause"], BOTH, _take(law, v, 0)))
        noun, head = self.is_pos("NOUN") & ~verbal, np.full(s.n, -1)
        for d in (*range(-4, 0), *range(1, 4)):
            to = s.shifted(d)
            head = np.where((head < 0) & self.at(noun, to), to, head)
        participle = self.of("patient") | (self.of("agent") & ~self.is_pos("ADP", "DET", "PUNCT"))
        out.append(self.edges(participle & ~verbal & (head >= 0), head, at, TYPES["participial_modification"], TENSE, 0))
        return np.concatenate(out, axis=1)

    def every(self) -> np.ndarray:
        """All edges, each (sentence, source, target, type) once, by sentence, type, source and target."""
        spans = self.spans()
        laws, subject, linked = self.laws(spans)
        edges = np.concatenate([laws, self.objects(spans, subject, linked), self.phrases(), self.clitics(), self.clauses()], axis=1)
        edges = edges[:, np.lexsort((edges[2], edges[1], edges[3], edges[0]))]
        new = np.ones(edges.shape[1], bool)
        new[1:] = (np.diff(edges[:4]) != 0).any(axis=0)
        return edges[:, new]


_EDGE = (StructField("source", IntegerType()), StructField("target", IntegerType()), StructField("type", StringType()), StructField("features", ArrayType(StringType())), StructField("law", StringType()))
_LISTS, _TYPES, _LAWS = pa.array(FEATURES, pa.list_(pa.string())), pa.array(G.EDGE_TYPES), pa.array(LAWS)


def _law(n: int):
    def of(g: Graph) -> np.ndarray:
        edges = g.laws(g.spans())[0]
        return edges[:, edges[5] == n]

    return of


def _objects(g: Graph) -> np.ndarray:
    spans = g.spans()
    return g.objects(spans, *g.laws(spans)[1:])


KINDS = {"law1": _law(1), "law2": _law(2), "objects": _objects, "phrases": Graph.phrases, "clitics": Graph.clitics, "clauses": Graph.clauses, "every": Graph.every}


class _Run:
    """A function of the arrays of a part's graph, for in_blocks()."""

    prepare = Block

    def __init__(self, make):
        self.make = make

    def __call__(self, keys: pa.Table, block: Block, s: Sentences) -> pa.Table:
        return self.make(keys, Graph(block, s))


def _with_keys(keys: pa.Table, sentence: np.ndarray, **columns) -> pa.Table:
    out = keys.take(pa.array(sentence))
    for name, column in columns.items():
        out = out.append_column(name, column)
    return out


def _made(sentences: DataFrame, text: str, key: tuple[str, ...], fields, make) -> DataFrame:
    schema = StructType([*(sentences.schema[k] for k in key), *fields])
    return blocks.in_blocks(sentences, text, *key, features=classes, run=_Run(make), schema=schema)


def edges(sentences: DataFrame, text: str, *key: str, kind: str = "every") -> DataFrame:
    """key, source, target, type, features, law: edges of one of KINDS, as the functions of operators/graph.py give them."""
    def make(keys: pa.Table, g: Graph) -> pa.Table:
        e = KINDS[kind](g)
        ints = {c: pa.array(e[n].astype(np.int32)) for n, c in ((1, "source"), (2, "target"))}
        return _with_keys(keys, e[0], **ints, type=_TYPES.take(pa.array(e[3])), features=_LISTS.take(pa.array(e[4])), law=_LAWS.take(pa.array(e[5])))

    return _made(sentences, text, key, _EDGE, make)


def subject_spans(sentences: DataFrame, text: str, *key: str) -> DataFrame:
    """key, first, last, members (how many), person, number, kind of graph.subject_spans()."""
    fields = (*(StructField(c, IntegerType()) for c in ("first", "last", "members")), *(StructField(c, StringType()) for c in ("person", "number", "kind")))

    def make(keys: pa.Table, g: Graph) -> pa.Table:
        spans, i = g.spans(), g.s.i
        values = lambda c, fixed: pa.array([*fixed, *g.b.names[c]]).take(pa.array(np.where(spans[c] < 0, 0, spans[c] + 1)))
        ints = {"first": i[spans["first"]], "last": i[spans["last"]], "members": spans["members"]}
        kinds = pa.array(SPAN_KINDS).take(pa.array(spans["kind"]))
        return _with_keys(keys, g.s.sentence[spans["first"]], **{c: pa.array(v.astype(np.int32)) for c, v in ints.items()}, person=values("person", ("3",)), number=values("number", ("pl",)), kind=kinds)

    return _made(sentences, text, key, fields, make)


def violations(sentences: DataFrame, text: str, *key: str) -> DataFrame:
    """key, source, target, type, feature, law, source_value, target_value of graph.violations()."""
    fields = (*_EDGE[:3], *(StructField(c, StringType()) for c in ("feature", "law", "source_value", "target_value")))

    def make(keys: pa.Table, g: Graph) -> pa.Table:
        e, out = g.every(), []
        e = e[:, e[3] != TYPES["agent_non_agreeing"]]
        starts = np.flatnonzero(g.s.i == 0)
        offset = np.zeros(len(g.s.sizes), np.int64)
        offset[g.s.sentence[starts]] = starts
        for feature in graph.CHECKED:
            rows = e[:, np.isin(e[4], [n for n, f in enumerate(FEATURES) if feature in f])]
            values = g.of(feature)
            a, b = (values[offset[rows[0]] + rows[n]] for n in (1, 2))
            differ = (a > 0) & (b > 0) & (a != b)
            rows, names = rows[:, differ], pa.array(list(g.b.names[feature]))
            ints = {c: pa.array(rows[n].astype(np.int32)) for n, c in ((1, "source"), (2, "target"))}
            sides = {f"{c}_value": names.take(pa.array(v[differ])) for c, v in (("source", a), ("target", b))}
            out.append(_with_keys(keys, rows[0], **ints, type=_TYPES.take(pa.array(rows[3])), feature=pa.array([feature] * rows.shape[1], pa.string()), law=_LAWS.take(pa.array(rows[5])), **sides))
        return pa.concat_tables(out)

    return _made(sentences, text, key, fields, make)


def edge_counts(sentences: DataFrame, text: str, *key: str) -> DataFrame:
    """type, n, sentences of graph.edge_counts(), summed in blocks first."""
    fields = (StructField("type", StringType()), StructField("n", LongType()), StructField("sentences", LongType()))

    def make(keys: pa.Table, g: Graph) -> pa.Table:
        e = g.every()
        n = np.bincount(e[3], minlength=len(G.EDGE_TYPES))
        in_sentence = np.bincount(np.unique(e[0] * len(G.EDGE_TYPES) + e[3]) % len(G.EDGE_TYPES), minlength=len(G.EDGE_TYPES))
        some = np.flatnonzero(n)
        return pa.table({"type": _TYPES.take(pa.array(some)), "n": pa.array(n[some]), "sentences": pa.array(in_sentence[some])})

    rows = blocks.in_blocks(sentences, text, *key, features=classes, run=_Run(make), schema=StructType(list(fields)))
    return rows.groupBy("type").agg(F.sum("n").alias("n"), F.sum("sentences").alias("sentences"))


def adjacency(sentences: DataFrame, text: str, *key: str) -> DataFrame:
    """key, type, place, n, rows, starts, columns of graph.adjacency()."""
    lists = {"rows": IntegerType(), "starts": LongType(), "columns": IntegerType()}
    fields = (StructField("type", StringType()), StructField("place", IntegerType()), StructField("n", LongType()), *(StructField(c, ArrayType(t)) for c, t in lists.items()))

    def make(keys: pa.Table, g: Graph) -> pa.Table:
        sentence, source, target, kind, _, _ = g.every()
        group = sentence * len(G.EDGE_TYPES) + kind
        begins = np.flatnonzero(np.diff(group, prepend=-1))  # of a matrix
        row_begins = np.flatnonzero((np.diff(group, prepend=-1) != 0) | (np.diff(source, prepend=-1) != 0))
        row_ends = np.concatenate([row_begins[1:], [len(group)]])[: len(row_begins)]
        of_row = np.searchsorted(begins, row_begins, "right") - 1
        n_rows = np.bincount(of_row, minlength=len(begins))
        offsets = lambda sizes: pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
        # The starts of a matrix are 0, then the end of each row within it.
        first = np.concatenate([[0], np.cumsum(n_rows + 1)])[:-1]
        starts = np.zeros(len(row_begins) + len(begins), np.int64)
        inside = np.arange(len(row_begins)) - (np.cumsum(n_rows) - n_rows)[of_row]
        starts[first[of_row] + inside + 1] = row_ends - begins[of_row]
        cells = np.diff(np.concatenate([begins, [len(group)]]))
        rows = pa.ListArray.from_arrays(offsets(n_rows), pa.array(source[row_begins].astype(np.int32)))
        columns = pa.ListArray.from_arrays(offsets(cells), pa.array(target.astype(np.int32)))
        of = sentence[begins]
        return _with_keys(keys, of, type=_TYPES.take(pa.array(kind[begins])), place=pa.array(kind[begins].astype(np.int32)), n=pa.array(g.s.sizes[of]), rows=rows, starts=pa.ListArray.from_arrays(offsets(n_rows + 1), pa.array(starts)), columns=columns)

    return _made(sentences, text, key, fields, make)
