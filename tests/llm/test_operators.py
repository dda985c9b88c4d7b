"""Operators against brute force on small fixtures with nulls, empty and long texts, ties, repeated rows and extra columns."""

import hashlib
import pickle
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from corpusloom.llm import bpe, chosen_path, exact_dedup, hnsw, kneser_ney, line_dedup, packing, repair, substring_dedup, url_filter

DOCS = "doc_id long, text string, lang string, source string, n_chars long, row long, kept string, digest string"
BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


def texts() -> list:
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(1, 6)))
    base = [" ".join(word() for _ in range(120)) for _ in range(12)]
    passage = " ".join(word() for _ in range(60))
    near = [" ".join(w if i != k else "changed" for i, w in enumerate(base[0].split())) for k in range(0, 30, 7)]
    lines = "\n".join(["a line that is shared by several documents", base[3][:80], "short"])
    out = [*base, *near, base[1], base[1], f"{base[4]} {passage}", f"{passage} {base[5]}", lines, lines.replace("shared", "sharad"), None, "", " ", "x", "one two three", "one two three", "word " * 3000, "<|endoftext|> a", "a\x1cb\x00  c\n\n"]
    return list(enumerate(out))


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if i % 3 else None, f"src{i % 4}" if i % 5 else None, 0, i, "k", "d") for i, t in texts()]
    return spark.createDataFrame([*rows, rows[2], (None, "without an id", "fr", "src1", 0, 1, "", "")], DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def rows_of(docs) -> list:
    return [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()]


def test_exact(docs, empty):
    got = exact_dedup.exact_groups(docs, support=0.05).collect()
    groups = {}
    for d, t in rows_of(docs):
        groups.setdefault(hashlib.sha256(t.encode()).hexdigest(), []).append(d)
    assert len(got) == docs.count()
    for r in got:
        g = groups[r.text_sha256]
        best = max((d for d in g if d is not None), default=None)
        assert (r.group_size, r.keep_id, r.kept) == (len(g), best, r.doc_id == best)
    assert exact_dedup.exact_groups(empty).count() == 0


def test_packing(docs, empty):
    tok = Tokenizer.from_file(WORD)
    got = packing.pack(docs, WORD, window=64).collect()
    want = Counter(tuple(tok.encode(t, add_special_tokens=False).ids + [2]) for _, t in rows_of(docs))
    spans = {}
    for r in got:
        assert zlib.crc32(bytes(r.ids)) == r.ids_crc32 and len(r.ids) == 4 * r.length
        spans.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in spans.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at & (at - 1) == 0 and at <= 64
    assert sum(r.length for r in got) == sum(len(k) * n for k, n in want.items())
    own = {}
    for r in got:
        own.setdefault(r.doc_id, {})[r.start] = np.frombuffer(bytes(r.ids), "<u4").tolist()
    for d, t in rows_of(docs):
        if d not in (None, 2):  # 2 is there twice
            assert sum((x for _, x in sorted(own[d].items())), []) == tok.encode(t, add_special_tokens=False).ids + [2]
    assert packing.pack(empty, WORD).count() == 0


@pytest.mark.parametrize("grain", [1, 8])
def test_packing_proportions(grain):
    sizes = [1000, 37, 5, 4001]
    rounds, filled = packing.Rounds(sizes, packing.credits(list("abcd"), sizes, None, 64), 64, grain), np.zeros((4, 200), dtype=int)
    places = set()
    for i, n in enumerate(sizes):
        for first in range(0, n, 7):  # documents
            for _, length, seq, offset in rounds.place(i, first, min(7, n - first)):
                filled[i, seq] += length
                places |= {(seq, offset + k) for k in range(length)}
    full = sum(sizes) // 64
    assert len(places) == sum(sizes) and filled[:, :full].sum() == 64 * full
    for i, n in enumerate(sizes):
        carried = np.cumsum(filled[i, :full] - 64 * n / sum(sizes))
        assert np.abs(carried).max() <= grain * (2 + len(sizes))


def test_packing_targets(spark):
    """Sources keep to their targets as long as they have tokens, and all tokens are packed."""
    rows = [(i, "a b c d e f g " * 5, None, "abcn"[i % 4] if i % 4 < 3 else None, 0, i, "", "") for i in range(400)]
    docs = spark.createDataFrame(rows, DOCS)
    got = packing.pack(docs, WORD, window=128, targets={"a": 0.5, "b": 0.25}, grain=8).collect()
    filled = Counter()
    for r in got:
        filled[r.sequence_id, r.source] += r.length
    assert sum(filled.values()) == 400 * 36
    lasting = 100 * 36 * 2 // 128 - 2  # windows until source a has no tokens left
    share = Counter()
    for (seq, source), n in filled.items():
        if seq < lasting:
            share[source] += n / (128 * lasting)
    assert abs(share["a"] - 0.5) < 0.02 and abs(share["b"] - 0.25) < 0.02 and abs(share["c"] - share[None]) < 0.02
    with pytest.raises(ValueError):
        packing.pack(docs, WORD, targets={"a": 0.7, "b": 0.4})


def test_packing_many_sources(spark):
    """Sources with less than a token a window have common queues, and documents stay whole but for the grain and window ends."""
    docs = spark.createDataFrame([(i, "one two three four", None, f"source {i}", 0, i, "", "") for i in range(600)], DOCS)
    got = packing.pack(docs, WORD, window=64, grain=32).collect()
    assert sum(r.length for r in got) == 600 * 5 and {r.source for r in got} == {f"source {i}" for i in range(600)}
    assert len(got) < 900


def test_repair(docs, empty):
    tok = Tokenizer.from_file(BYTE)
    files = repair.write_grammars(docs, BYTE, 50_257, block_ids=500)
    got = repair.read_grammars(files, with_ids=True).orderBy("start").collect()
    start = 0
    for r in got:
        assert r.start == start and zlib.crc32(bytes(r.ids)) == r.ids_crc32
        start += r.n_tokens
    ids = [r.doc_id for r in got]
    assert ids == sorted(ids, key=lambda d: (d is not None, d or 0))
    assert Counter(bytes(r.ids) for r in got) == Counter(np.array(tok.encode(t, add_special_tokens=False).ids + [2], dtype="<u4").tobytes() for _, t in rows_of(docs))
    assert repair.read_grammars(repair.write_grammars(empty, BYTE, 50_257)).count() == 0


@pytest.mark.parametrize("bits", [20, 3])
def test_repair_leaves_no_frequent_pair(monkeypatch, bits):
    """Copies of a long passage need many rounds; with few slots, pairs share theirs with others."""
    monkeypatch.setattr(repair, "SLOT_BITS", bits)
    monkeypatch.setattr(repair, "MANY", 1000)
    r = np.random.default_rng(2)
    passage = r.integers(3, 900, 400)
    ids = np.concatenate([np.append(np.append(passage, r.integers(3, 900, 50)), 2) for _ in range(8)])
    symbols, last, rules, lengths = repair.compress(ids, ids == 2, 1000, rules_a_round=4096 if bits > 3 else 8)
    pairs = Counter((a, b) for a, b, end in zip(symbols[:-1].tolist(), symbols[1:].tolist(), last[:-1], strict=True) if not end)
    assert max(pairs.values()) < 4 and lengths.max() > 64

    def expand(x):
        return [x] if x < 1000 else expand(rules[x - 1000][0]) + expand(rules[x - 1000][1])

    assert sum(map(expand, symbols.tolist()), []) == ids.tolist()


def test_repair_random_access():
    r = np.random.default_rng(1)
    docs_ = [np.append(r.integers(3, 9, n), 2).astype("<u4") for n in (0, 1, 500, 3000)]
    p = repair.Payload(repair.to_payload([4, None, 6, 7], docs_, 10))
    assert len(p.rules) and p.null.tolist() == [0, 1, 0, 0]
    for k, d in enumerate(docs_):
        assert (p.document(k) == d).all() and [p.at(k, i) for i in range(0, len(d), 7)] == d[::7].tolist()


def test_bpe(docs, empty):
    tok = Tokenizer.from_file(BYTE)
    got = {r.doc_id: r for r in bpe.round_trip(docs, BYTE).collect()}
    for d, t in rows_of(docs):
        ids = tok.encode(t, add_special_tokens=False).ids
        assert got[d].n_tokens == len(ids) and got[d].ids_sha256 == hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest()
        assert got[d].decoded_sha256 == hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.round_trip(empty, BYTE).count() == 0


def test_bpe_stream():
    tok, own = Tokenizer.from_file(BYTE), bpe.StreamingBpe(BYTE)
    for s in ("a" * 5000, "ab" * 3000, "=" * 4000, "thequickbrownfox" * 300, "0" * 3000):
        for size in (own.lookahead + 150, 2 * own.lookahead):
            assert list(own.stream((s[i : i + 100].encode() for i in range(0, len(s), 100)), size)) == tok.encode(s, add_special_tokens=False).ids
    invalid = [own.first[0xE2], own.first[0x82], own.first[0x41], own.first[0xFF]]
    assert "".join(own.decode([np.array([i]) for i in invalid])) == tok.decode(invalid, skip_special_tokens=False)


def test_urls(spark):
    urls = ["http://A.org/x", "https://org/", "http://a.example.org/es/1", "http://example.org/en/12", "http://x.com/fr/9", "ftp://com/de/?q=1", "http://b.net/en/3", "none", None, "", "http://notorg/x", "http://EXAMPLE.org", "http://é.com/fr/#/de/"]
    pages = spark.createDataFrame([(i, u, "h", "v", 1.0) for i, u in enumerate(urls * 3)], "page_id long, url string, html string, verdict string, score double")
    got = {r.page_id: r for r in url_filter.filter_urls(pages).collect()}
    want = ["org/", "org/", "example.org/es/", "example.org/en/1", "com/fr/", "com/de/", None, None, None, None, None, None, "com/fr/"]
    assert len(got) == len(urls) * 3 and [got[i].rule for i in range(len(urls))] == want
    assert (got[0].host, got[0].path, got[5].path, got[8].host, got[11].path) == ("a.org", "/x", "/de/", "", "")
    assert {i: got[i].verdict for i in (0, 2, 3, 4, 5)} == {0: "allow", 2: "block", 3: "block", 4: "allow", 5: "block"}
    assert url_filter.filter_urls(pages.limit(0)).count() == 0


def test_url_trees_learn(spark):
    r = random.Random(2)
    rows = [(i, f"http://{'ads' * r.randint(2, 4) if bad else 'www'}{r.randint(1, 99)}.net/{'1' * r.randint(5, 20) if bad else 'page'}?{'a=1&' * 3 if bad else ''}", "block" if bad else "allow") for i in range(400) for bad in [r.random() < 0.5]]
    df = spark.createDataFrame(rows, "page_id long, url string, label string")
    parts = url_filter.split_urls(df).join(df.select("page_id", "label"), "page_id").withColumn("rule_verdict", __import__("pyspark.sql.functions", fromlist=["col"]).col("label"))
    fitted = url_filter.fit_url_filter(parts, parts.where("page_id % 2 = 0"))
    held = fitted.apply(parts.where("page_id % 2 = 1")).selectExpr("avg(cast((score >= 0.5) = (label = 'block') as int)) as a").first().a
    assert held > 0.95


def test_url_suffix_shares(spark):
    """Every suffix has its share of all rows, also one that no rule decides; only its blocked share is the prior."""
    urls = ["http://a.org/x"] * 3 + ["http://x.com/fr/9"] * 2 + ["http://b.net/en/3"] * 4 + [None]
    parts = url_filter.split_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"))
    got = {(r.suffix, r.suffix_share, r.suffix_blocked) for r in url_filter.fit_url_filter(parts).apply(parts).collect()}
    assert got == {("org", 0.3, 0.2), ("com", 0.2, 0.25), ("net", 0.4, 0.5), ("", 0.1, 0.5)}


def sets_of(docs) -> list:
    out = []
    for d, t in rows_of(docs):
        w = t.encode().split()
        out.append((d, {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}))
    return out


@pytest.mark.parametrize(("limit", "block", "shingles"), [(256, 4096, 1 << 21), (3, 3, 1 << 21), (3, 100, 300)])
def test_jaccard(docs, empty, limit, block, shingles):
    sets = sets_of(docs)
    links = [[j for j, (_, b) in enumerate(sets) if j != i and a and b and len(a & b) >= 0.8 * len(a | b)] for i, (_, a) in enumerate(sets)]
    got = Counter((r.doc_id, r.n_links) for r in chosen_path.jaccard_join(docs, limit=limit, block=block, shingles=shingles).collect())
    assert got == Counter((d, len(links[i])) for i, (d, _) in enumerate(sets))
    assert chosen_path.jaccard_join(empty).count() == 0


def test_vectors(spark):
    r = np.random.default_rng(3)
    base = r.normal(size=(40, 8))
    v = [x.tolist() for x in base] + [(base[0] + 0.05 * r.normal(size=8)).tolist() for _ in range(30)] + [base[1].tolist()] * 3 + [(2 * base[1]).tolist(), None, [], [0.0] * 8, [None] * 8, [float("nan")] * 8, [1.0, 2.0]]
    df = spark.createDataFrame([(i, x, 1, "c") for i, x in enumerate(v)], "vec_id long, embedding array<double>, label int, class string")
    got = {x.vec_id: x for x in hnsw.near_vectors(df, shards=2).collect()}
    n = 74
    u = np.array(v[:n])
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    near = u @ u.T >= 0.95
    assert [got[i].n_links for i in range(n)] == (near.sum(axis=1) - 1).tolist()
    assert got[40].component_id == 0 and got[71].component_id == 1 and all(got[i].n_links == 0 and got[i].kept for i in range(n, len(v)))
    assert hnsw.near_vectors(df.limit(0)).count() == 0


@pytest.mark.parametrize("audits", [512, 1])
def test_vectors_that_graphs_do_not_reach(spark, monkeypatch, audits):
    """Graphs without links fail every audit; with one audit vector, which has no link, the first audit finds nothing."""

    def cut(units):
        from corpusloom.llm.hnsw import Graph  # in the worker

        graph = Graph(units)
        for near in graph.near:
            if near is not None:
                near[:] = -1
        return graph

    monkeypatch.setattr(hnsw, "Graph", cut)
    monkeypatch.setattr(hnsw, "AUDITS", audits)
    r = np.random.default_rng(4)
    v = r.normal(size=(60, 8))
    v[40:] = v[0] + 0.05 * r.normal(size=(20, 8))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    links = (u @ u.T >= 0.95).sum(axis=1) - 1
    assert {x.vec_id: x.n_links for x in hnsw.near_vectors(df, shards=2).collect()} == dict(enumerate(links.tolist()))


def distance(a: str, b: str) -> int:
    p = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        q = [i]
        for j, y in enumerate(b, 1):
            q.append(min(p[j] + 1, q[-1] + 1, p[j - 1] + (x != y)))
        p = q
    return p[-1]


def test_within_and_probes():
    r = random.Random(1)
    for _ in range(4000):
        a = "".join(r.choice("abc") for _ in range(r.randint(0, 14)))
        b = list(a)
        for _ in range(r.randint(0, 4)):
            b.insert(r.randint(0, len(b)), r.choice("abc")) if r.random() < 0.5 or not b else b.pop(r.randrange(len(b)))
        b, t = "".join(b), r.randint(0, 4)
        near = distance(a, b) <= t
        assert line_dedup.within(a, b, t) == near
        if near and min(len(a), len(b)) > t:
            x, y = sorted((a, b), key=len, reverse=True)
            index = {(i, y[s : s + n]) for i, (s, n) in enumerate(line_dedup.segments(len(y), t))}
            assert any((i, x[s : s + n]) in index for i, s, n in line_dedup.probes(len(x), len(y), t))


def test_lines(docs, empty):
    docs = docs.where("doc_id is not null")
    rows = rows_of(docs)
    found = [(x, d, i) for d, t in rows for i, x in enumerate(t.split("\n")) if x and not x.isspace()]
    kinds = sorted({x for x, _, _ in found})
    up = {x: x for x in kinds}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(kinds):
        for b in kinds[i + 1 :]:
            if min(len(a), len(b)) >= 20 and abs(len(a) - len(b)) <= 2 and len(a) < 200 and distance(a, b) <= 2:
                up[root(b)] = root(a)
    first = {}
    for x, d, i in found:
        first[root(x)] = min(first.get(root(x), (10**9, 0)), (d, i))
    for r in line_dedup.dedup_lines(docs).collect():
        t = dict(rows)[r.doc_id]
        kept = "\n".join(x for i, x in enumerate(t.split("\n")) if not x or x.isspace() or first[root(x)] == (r.doc_id, i))
        assert (r.kept_sha256, r.kept if r.n_removed else t) == (hashlib.sha256(kept.encode()).hexdigest(), kept)
    assert line_dedup.dedup_lines(empty).count() == 0


@pytest.mark.parametrize("hot", [2000, 2])
def test_substrings(docs, empty, hot, monkeypatch):
    monkeypatch.setattr(substring_dedup, "HOT_ANCHOR", hot)
    words = [(d, t.encode().split()) for d, t in rows_of(docs)]
    times = Counter(tuple(w[i : i + 35]) for _, w in words for i in range(len(w) - 34))
    want = Counter()
    for d, w in words:
        gone = [False] * len(w)
        for i in range(len(w) - 34):
            if times[tuple(w[i : i + 35])] > 1:
                gone[i : i + 35] = [True] * 35
        want[d, len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone, strict=True) if not g)).hexdigest()] += 1
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.find_repeats(docs).collect()) == want
    assert substring_dedup.find_repeats(empty).count() == 0


def test_language_model(spark, docs, empty):
    """Probabilities of a small model against the definition, and that they sum to 1 over the letters."""
    data = ["abab", "abc", "aab"]
    df = spark.createDataFrame([(t,) for t in data], "text string")
    counts = kneser_ney.count_grams(df, 2)
    raw = Counter(x for t in data for x in map("".join, zip("\x01" + t, t, strict=False)))
    assert {r.gram: r.n for r in counts.collect()} == raw
    letters = "abcz"
    wanted = spark.createDataFrame([(c + d, 1) for c in letters for d in letters], "gram string, times long")
    p = {r.gram: r.p for r in kneser_ney.probabilities(counts, wanted, 2).collect()}
    d = kneser_ney.discounts(counts)
    uni = Counter(g[1] for g in raw)
    e = kneser_ney.discounts(spark.createDataFrame(list(uni.items()), "gram string, n long"))
    off = lambda n, d: d[min(n, 3) - 1] if n else 0
    low = {c: (max(uni[c] - off(uni[c], e), 0) + sum(off(n, e) for n in uni.values()) / (len(uni) + 1)) / sum(uni.values()) for c in letters}
    for g, x in p.items():
        ctx = {k: n for k, n in raw.items() if k[0] == g[0]}
        want = (max(raw[g] - off(raw[g], d), 0) + sum(off(n, d) for n in ctx.values()) * low[g[1]]) / sum(ctx.values()) if ctx else low[g[1]]
        assert abs(x - want) < 1e-9
    assert all(abs(sum(p[c + x] for x in letters) - 1) < 1e-9 for c in "ab")
    trusted = spark.createDataFrame([(i,) for i in range(12)], "doc_id long")
    got = kneser_ney.judge(docs, trusted).collect()
    assert len(got) == docs.count() and all(r.kept and r.perplexity is None for r in got if not r.n_chars)
    few = kneser_ney.judge(docs, trusted.limit(0))
    assert few.where("not kept").count() == 0 and kneser_ney.judge(empty, trusted).count() == 0


def test_limits_of_few_held_out(spark):
    """A language with one held-out document keeps its clean documents, not its junk; few held-out documents in all set no limits."""
    r = random.Random(6)
    words = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(60)]
    held = {x.id for x in spark.range(2000).where(f"pmod(xxhash64(id), 16) < {kneser_ney.HELD_OUT}").collect()}
    rare = [min(i for i in held if i >= 1000), *[i for i in range(1000, 1100) if i not in held][:30]]
    rows = [(i, " ".join(r.choices(words, k=40)), "en") for i in range(400)] + [(i, " ".join(r.choices(words, k=40)), "xx") for i in rare]
    junk = (5000, "#@!~ %^&* " * 20, "xx")
    docs = spark.createDataFrame([*rows, junk], "doc_id long, text string, lang string")
    trusted = spark.createDataFrame([(i,) for i, _, _ in rows], "doc_id long")
    got = {x.doc_id: x.kept for x in kneser_ney.judge(docs, trusted).collect()}
    assert all(got[i] for i in rare) and not got[5000]
    assert kneser_ney.judge(docs, trusted.where("doc_id >= 1000")).where("not kept").count() == 0


@pytest.mark.parametrize("table_rows", [0, 60, 10**6])
def test_perplexity(spark, docs, table_rows):
    """Each row's sum of logarithms against brute force, also of repeated rows and of start marks in texts, whatever is broadcast."""
    more = spark.createDataFrame([(900, "a\x01\x01b", "en", None, 0, 0, "", ""), (901, "🎉 é🎉", None, None, 0, 0, "", "")], DOCS)
    rows = docs.unionByName(more).selectExpr("xxhash64(doc_id, text) as row", "doc_id", "lang", "coalesce(text, '') as text")
    grams = kneser_ney.count_grams(rows, 3)
    p = kneser_ney.probabilities(grams, grams.withColumnRenamed("n", "times"), 3)
    logs = {r.gram: np.log(r.p) for r in p.collect()}
    want, n = Counter(), 0
    for r in rows.collect():
        t = "\x01\x01" + r.text
        want[r.doc_id, round(sum(logs[t[i : i + 3]] for i in range(len(r.text))), 4)] += 1
        n += len(r.text)
    got = kneser_ney.score(rows, p, 3, table_rows).collect()
    assert sum(r.n for r in got) == n and {r.gram: r.n for r in grams.collect()} == Counter(t[i : i + 3] for r in rows.collect() for t in ["\x01\x01" + r.text] for i in range(len(r.text)))
    assert Counter((r.doc_id, round(r.log, 4)) for r in got) == want


def test_counts_in_parts(spark, docs):
    """Counts are the same where a task can't hold all n-grams at once."""
    rows = docs.select("text")
    assert {(r.gram, r.n) for r in kneser_ney.count_grams(rows, 5, held=50).collect()} == {(r.gram, r.n) for r in kneser_ney.count_grams(rows, 5).collect()}


def test_limits(spark):
    """Limits are the quantiles of the held-out trusted documents of each language."""
    r = random.Random(7)
    rows = [(i, "".join(r.choices("abcdefgh  ", k=r.randint(5, 60))), "en" if i % 3 else "de") for i in range(8000)]
    docs = spark.createDataFrame([*rows, rows[5]], "doc_id long, text string, lang string")
    got = kneser_ney.judge(docs, spark.createDataFrame([(i,) for i, _, _ in rows[:7500]], "doc_id long"), low=0.1, high=0.9).collect()
    held = {x.id for x in spark.range(7500).where(f"pmod(xxhash64(id), 16) < {kneser_ney.HELD_OUT}").collect()}
    assert len(got) == 8001
    for lang in ("en", "de"):
        own = sorted(x.perplexity for x in got if x.lang == lang and x.doc_id in held)
        one = next(x for x in got if x.lang == lang)
        assert own[int(0.1 * len(own)) - 2] <= one.low_limit <= own[int(0.1 * len(own)) + 2] and own[int(0.9 * len(own)) - 2] <= one.high_limit <= own[int(0.9 * len(own)) + 2]
        assert all(x.kept == (x.low_limit <= x.perplexity <= x.high_limit) for x in got if x.lang == lang)


def test_exact_rows(docs):
    """Of equal texts the largest id stays; rows of the same id with other texts, and null ids, are on their own."""
    more = docs.limit(0).sparkSession.createDataFrame([(1, "twin", "en", None, 0, 0, "", ""), (2, "twin", "en", None, 0, 0, "", ""), (1, "other text of 1", "en", None, 0, 0, "", "")], DOCS)
    got = exact_dedup.exact_dedup(docs.unionByName(more), support=0.05)
    best, rows = {}, rows_of(docs.unionByName(more))
    for d, t in rows:
        best[t] = max(best.get(t, (False, 0)), (d is not None, d or 0))
    assert got.columns == docs.columns
    assert Counter((r.doc_id, r.text or "") for r in got.collect()) == Counter((d, t) for d, t in rows if (d is not None, d or 0) == best[t])


def test_jaccard_recall(spark):
    """Measured against all pairs: 60 groups of texts at 0.8 to 0.9 similarity."""
    r = random.Random(9)
    rows = []
    for g in range(60):
        w = [f"w{r.randrange(10**6)}" for _ in range(120)]
        for k in range(12):
            v = list(w)
            for i in range(0, 120, 40):
                if r.random() < 0.5:
                    v[r.randrange(i, i + 40)] = f"x{g}-{k}-{i}"
            rows.append((12 * g + k, " ".join(v)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sets = [{tuple(t.split()[i : i + 5]) for i in range(116)} for _, t in rows]
    true = sum(len(a & b) >= 0.8 * len(a | b) for g in range(60) for i, a in enumerate(sets[12 * g : 12 * g + 12]) for b in sets[12 * g : 12 * g + i])
    got = chosen_path.jaccard_join(docs, limit=8).agg({"n_links": "sum"}).first()[0] / 2
    assert true > 1000 and got <= true and got >= 0.999 * true


def test_graph_is_small_and_searches_as_before():
    """A graph that is sent takes no vectors and no empty layers with it."""
    units = np.random.default_rng(3).normal(size=(3000, 16))
    units /= np.linalg.norm(units, axis=1)[:, None]
    graph = hnsw.Graph(units)
    want = {k: sorted(found.tolist()) for k, found in graph.search(units[:200], 0.8, 32)}
    data = pickle.dumps(graph, protocol=5)
    assert len(data) < 3000 * (4 * graph.cap[0] + 40)
    sent = pickle.loads(data)
    sent.v = units.astype(np.float32)
    assert {k: sorted(found.tolist()) for k, found in sent.search(units[:200], 0.8, 32)} == want


def test_wide_beams_become_exact(monkeypatch):
    """Of a large group of near vectors all are found, without a beam as wide as the group."""
    r = np.random.default_rng(4)
    units = np.concatenate([np.ones((900, 8)) + r.normal(scale=0.01, size=(900, 8)), r.normal(size=(300, 8))])
    units /= np.linalg.norm(units, axis=1)[:, None]
    monkeypatch.setattr(hnsw, "WIDEST", 128)
    graph, widths = hnsw.Graph(units), []
    beam = graph._beam
    monkeypatch.setattr(graph, "_beam", lambda q, at, width, l: widths.append(width) or beam(q, at, width, l))
    got = {k: set(found.tolist()) for k, found in graph.search(units[:50], 0.95, 32)}
    assert max(widths) <= 128 and set(got) == set(range(50))
    assert all(set(np.flatnonzero(units @ units[k] >= 0.95)) <= got[k] for k in range(50))
