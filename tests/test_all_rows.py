"""Queries over all rows, which have no SQL, against brute force."""

import numpy as np
import pytest

from corpusloom.functions import profile as P
from corpusloom.plans import catalog
from corpusloom.plans.tables import pairs

TEXTS = ["One two three four. Für Elise spielt niemand heute. Ça va très bien!", "Only this.", "Ein Wort", None, "Closing marks ( side by side ) ] end ، ؛ again. Niño come pan ) . Last one here"] + [f"Sentence {i} über alles {i * 7} done. Another plain one {i}." for i in range(12)]


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("sf"))
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(TEXTS)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    return at


@pytest.fixture(scope="module")
def counted(spark, sf):
    """(tp, fn) of each pair: its edits are a changed first word and a lost last word, and the hypothesis has all of them or none."""
    out = []
    for r in sorted(pairs(spark, sf).collect(), key=lambda r: (r.doc_id, r.pos)):
        s, t = r.source.split(), r.reference.split()
        n = (s[0] != t[0]) + (len(s) < len(t))
        out.append((n, 0) if r.hypothesis == r.reference else (0, n))
    assert len({x for x in out}) > 3
    return out


def f05(tp: int, fn: int) -> float:
    r = tp / (tp + fn) if tp + fn else 0
    return 1.25 * r / (0.25 + r) if tp else 0.0


def run(spark, sf, name):
    assert name not in catalog.oracle_sql()
    return catalog.queries()[name](spark, sf).collect()


def test_bootstrap(spark, sf, counted):
    """Against the same draws row by row, and against resampling with replacement."""
    keys = [r.k for r in pairs(spark, sf).orderBy("doc_id", "pos").selectExpr("xxhash64(doc_id, pos) as k").collect()]
    weights = np.array([np.random.Generator(np.random.Philox(key=[42, k & 0xFFFFFFFFFFFFFFFF])).poisson(1.0, 1000) for k in keys])
    n = np.array(counted)
    scores = sorted(f05(*x) for x in (weights.T @ n).tolist())
    (got,) = run(spark, sf, "bootstrap_ci_all_pairs")
    assert (got.low, got.high) == pytest.approx((scores[25], scores[975]), abs=1e-6)
    r = np.random.default_rng(1)
    drawn = sorted(f05(*n[r.integers(0, len(n), len(n))].sum(axis=0).tolist()) for _ in range(1000))
    assert (got.low, got.high) == pytest.approx((drawn[25], drawn[975]), abs=0.08)


@pytest.mark.parametrize("name", ["f05_corpus_all_pairs", "m2_f05_all_pairs"])
def test_scores(spark, sf, counted, name):
    tp, fn = sum(x for x, _ in counted), sum(x for _, x in counted)
    (got,) = run(spark, sf, name)
    assert (got.tp, got.fp, got.fn) == (tp, 0, fn) and got.f05 == pytest.approx(f05(tp, fn), abs=1e-6)


def distance(a: str, b: str) -> int:
    p = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        q = [i]
        for j, y in enumerate(b, 1):
            q.append(min(p[j] + 1, q[-1] + 1, p[j - 1] + (x != y)))
        p = q
    return p[-1]


def test_cer(spark, sf):
    each = [(distance(r.hypothesis, r.reference), len(r.reference)) for r in pairs(spark, sf).collect()]
    (got,) = run(spark, sf, "cer_all_pairs")
    assert got.cer == pytest.approx(sum(d for d, _ in each) / sum(n for _, n in each), abs=1e-6)
    assert got.mean_cer == pytest.approx(sum(d / n for d, n in each) / len(each), abs=1e-6)


def test_join_tokens(spark, sf):
    want = {}
    for r in catalog.queries()["regex_tokens"](spark, sf).collect():
        text = ""
        for i, t in enumerate(r.out.split("|")):
            text += t if i == 0 or t in P.NO_SPACE_BEFORE else f" {t}"
        want[r.doc_id, r.pos] = text
    got = {(r.doc_id, r.pos): r.out for r in run(spark, sf, "join_tokens_all")}
    assert got == want and any(")]" in x for x in got.values())
