"""Edges from arrays of blocks against the relations of operators/graph.py, and running values against loops."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_graph import sentences

from corpusloom.operators import graph as A
from corpusloom.operators import graph_arrays as B
from corpusloom.operators.blocks import Sentences


def test_places_stay_within_sentences():
    r = np.random.default_rng(3)
    for sizes in ([], [0, 0], [1], r.integers(0, 7, 60)):
        s = Sentences(np.zeros(int(np.sum(sizes)), np.int32), np.array(sizes, np.int64))
        flag = r.random(s.n) < 0.3
        same = lambda a, b: s.sentence[a] == s.sentence[b]
        for before in (1, 2):
            assert s.last(flag, before).tolist() == [max((j for j in range(k - before + 1) if flag[j] and same(j, k)), default=-1) for k in range(s.n)]
        assert s.next(flag).tolist() == [min((j for j in range(k + 1, s.n) if flag[j] and same(j, k)), default=-1) for k in range(s.n)]
        assert s.running(flag).tolist() == [sum(bool(flag[j]) and same(j, k) for j in range(k + 1)) for k in range(s.n)]


@pytest.fixture(scope="module")
def both(spark):
    rows = spark.createDataFrame([*enumerate(sentences()), (9999, None)], "id long, s string").repartition(5)
    tokens = A.graph_tokens(rows, "s", "id")
    return rows, tokens, A.agreement_edges(tokens, "id")


def test_edges_are_those_of_the_relations(both):
    rows, tokens, edges = both
    listed = lambda df: sorted(map(str, df.select("id", "source", "target", "type", "features", "law").collect()))
    assert listed(B.edges(rows, "s", "id")) == listed(edges)
    spans = A.subject_spans(tokens, "id").select("id", "first", "last", F.size("members").alias("members"), "person", "number", "kind")
    assert sorted(map(str, B.subject_spans(rows, "s", "id").collect())) == sorted(map(str, spans.collect()))


def test_matrices_counts_and_violations_are_those_of_the_relations(both):
    rows, tokens, edges = both
    for made, known in ((B.edge_counts(rows, "s", "id"), A.edge_counts(edges, "id")), (B.violations(rows, "s", "id"), A.violations(tokens, edges, "id")), (B.adjacency(rows, "s", "id"), A.adjacency(tokens, edges, "id"))):
        assert sorted(map(str, made.select(*known.columns).collect())) == sorted(map(str, known.collect()))
