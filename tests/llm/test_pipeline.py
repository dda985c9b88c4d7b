"""The stages of the pipeline against brute force, with null and repeated ids."""

import random
from collections import Counter

import corpus_pipeline
import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def texts() -> list:
    r = random.Random(8)
    some = lambda n: " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 6))) for _ in range(n))
    base, line, passage = [some(60) for _ in range(8)], "a line that several documents have", some(50)
    out = [(0, f"{line}\n{base[0]}"), (None, base[1]), (None, f"{base[2]}\n{line}"), (None, f"{line}s\n{base[3]}\nends")]
    out += [(7, f"first\n{line}"), (7, f"other\n{base[4]}\n{line}"), (7, base[5]), (7, base[5]), (7, base[1] + " more"), (8, base[6]), (8, base[0] + " more")]
    out += [(9, f"{base[7]} {passage}"), (None, f"{passage} {some(60)}"), (9, f"{some(70)} {passage} end"), (10, None), (None, ""), (None, None), (11, "x")]
    return out


def distance(a: str, b: str) -> int:
    p = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        q = [i]
        for j, y in enumerate(b, 1):
            q.append(min(p[j] + 1, q[-1] + 1, p[j - 1] + (x != y)))
        p = q
    return p[-1]


def classes(n: int, linked) -> list:
    """The number of the component of each of n items."""
    of = list(range(n))
    for i in range(n):
        for j in range(i):
            if of[i] != of[j] and linked(i, j):
                of = [of[j] if x == of[i] else x for x in of]
    return of


def without_lines(docs: list) -> list:
    rows = [(d, (t or "").split("\n")) for d, t in docs]
    kinds = sorted({x for _, ls in rows for x in ls if x and not x.isspace()})
    of = dict(zip(kinds, classes(len(kinds), lambda i, j: min(len(kinds[i]), len(kinds[j])) >= 20 and abs(len(kinds[i]) - len(kinds[j])) <= 2 and distance(kinds[i], kinds[j]) <= 2), strict=True))
    key = lambda d, i: (d is not None, d or 0, i)
    first = {}
    for d, ls in rows:
        for i, x in enumerate(ls):
            if x in of:
                first[of[x]] = min(first.get(of[x], key(d, i)), key(d, i))
    kept = [[x for i, x in enumerate(ls) if x not in of or first[of[x]] == key(d, i)] for d, ls in rows]
    return [(d, t if len(k) == len(ls) else "\n".join(k)) for (d, t), (_, ls), k in zip(docs, rows, kept, strict=True)]


def without_near(docs: list) -> list:
    words = [(t or "").split() for _, t in docs]
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()} for w in words]
    of = classes(len(docs), lambda i, j: bool(sets[i] and sets[j]) and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]))
    least = {c: min((d for (d, _), e in zip(docs, of, strict=True) if e == c and d is not None), default=None) for c in of}
    return [(d, t) for (d, t), c in zip(docs, of, strict=True) if d == least[c]]


def without_passages(docs: list) -> list:
    words = [(t or "").split() for _, t in docs]
    times, out = Counter(tuple(w[i : i + 35]) for w in words for i in range(len(w) - 34)), []
    for (d, t), w in zip(docs, words, strict=True):
        gone = {k for i in range(len(w) - 34) if times[tuple(w[i : i + 35])] > 1 for k in range(i, i + 35)}
        out.append((d, " ".join(x for i, x in enumerate(w) if i not in gone) if gone else t))
    return out


def test_stages(spark, tmp_path):
    """No label trusts a document, so the first stage keeps all."""
    docs = texts()
    spark.createDataFrame([(d, t, "en", "s", len(t or ""), "k", 5, "i") for d, t in docs], DOCS + ", kept string, row_key long, _id string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    want, table = docs, corpus_pipeline.table(spark, str(tmp_path), "documents")
    for (_, stage), brute in zip(corpus_pipeline.STAGES[:-1], (list, without_lines, without_near, without_passages), strict=True):
        table, want = corpus_pipeline.scratch(stage(spark, table, str(tmp_path)), "test"), brute(want)
        got = table.collect()
        assert Counter((r.doc_id, r.text) for r in got) == Counter(want)
        assert all(r.n_chars == len(r.text or "") and (r.kept, r.row_key, r._id) == ("k", 5, "i") for r in got)
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = Counter()
    for d, t in want:
        ids[d] += len(tok.encode(t or "", add_special_tokens=False).ids) + 1
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    have = Counter()
    for r in got:
        have[r.doc_id] += r.length
    assert have == ids
    tokens = Counter(x for r in got for x in np.frombuffer(bytes(r.ids), "<u4").tolist())
    assert tokens == Counter(x for _, t in want for x in [*tok.encode(t or "", add_special_tokens=False).ids, 2])


def test_empty(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_quality(spark, tmp_path):
    """Junk goes, whether it shares its id with a clean text or not; clean, null and empty texts and their repeats stay."""
    r = random.Random(4)
    words = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(60)]
    clean = [(i, " ".join(r.choices(words, k=40))) for i in range(600)]
    junk = [(700, "#@!~ %^&* " * 20), (3, "0101 1010 " * 30), (None, "?;?; " * 40)]
    rows = [*clean, clean[4], (None, clean[9][1]), (800, None), (800, ""), *junk]
    spark.createDataFrame([(d, t, "en", "s", 0) for d, t in rows], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i, _ in clean], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = Counter((x.doc_id, x.text) for x in corpus_pipeline.quality(spark, corpus_pipeline.table(spark, str(tmp_path), "documents"), str(tmp_path)).collect())
    gone = Counter(rows) - got
    assert all(gone[j] == 1 for j in junk) and len(gone) <= 10 and not got - Counter(rows) and got[800, None] == got[800, ""] == 1 and got[clean[4]] in (0, 2)
