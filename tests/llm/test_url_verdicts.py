"""Operator 6 against a brute-force version: host, path, rule and verdict of every row, trees evaluated node by node."""

import itertools
import math
import random
from collections import Counter

import pytest

from corpusloom.llm import url_filter as U


def parts(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    head = rest
    for mark in "?#":
        head = head.split(mark)[0]
    host = head.split("/")[0]
    return "".join(c.lower() if c.isascii() else c for c in host), head[len(host) :], rest[len(head) :]


def rule(host, path):
    fits = [(h + p, v) for h, p, v in U.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits, key=lambda x: len(x[0]), default=(None, None))


def features(url, host, path, tail, shares, blocked):
    url = url or ""
    n = max(len(url), 1)
    suffix = host.split(".")[-1]
    entropy = -sum(c / n * (math.log(c / n) / math.log(2)) for c in Counter(url).values())
    return {
        "url_length": len(url), "host_length": len(host), "path_length": len(path), "depth": path.count("/"), "digit_ratio": sum(c in "0123456789" for c in url) / n, "entropy": entropy, "n_params": tail.count("=") + tail.count("&"),
        "host_labels": host.count(".") + 1, "suffix_share": shares.get(suffix, 0.0), "suffix_blocked": blocked.get(suffix, 0.5),
    }


def leaves(tree, f):
    """The leaf of a tree, or both where a feature is on a cut but for the last bits."""
    if not isinstance(tree, tuple):
        return [tree]
    name, cut, left, right = tree
    sides = [left, right] if f[name] != cut and math.isclose(f[name], cut, rel_tol=1e-12) else [left if f[name] <= cut else right]
    return [x for side in sides for x in leaves(side, f)]


@pytest.mark.parametrize("most", [10_000, 60])
def test_verdicts(spark, most):
    r = random.Random(4)
    word = lambda: "".join(r.choices("abcdefgh0123456789É", k=r.randint(1, 9)))
    hosts = ["org", "example.org", "a.Example.org", "notorg", "com", "x.com", "b.net", "c.net", "d.info", "", "É.com"]
    paths = ["", "/", "/es/", "/es/1", "/en/1", "/en/12", "/fr/", "/de/x", "/fr", "/x//y", "#/de/", "?q=/fr/"]
    urls = [f"{r.choice(['http', 'https', 'ftp', ''])}://{r.choice(hosts)}{r.choice(paths)}{word()}{r.choice(['', '?a=1', '?a=1&b=2', '#t?x', '://y'])}" for _ in range(300)]
    urls += [None, "", "no scheme", "://", "a://b", *urls[:40]]
    pages = spark.createDataFrame([(i if i % 50 else None, u, "h", 0.0, "r") for i, u in enumerate(urls)], "page_id long, url string, host string, score double, rule string")
    fitted = U.fit_url_filter(U.split_urls(pages), max_rows=most)
    rows = [(u, *parts(u)) for u in urls]
    shares = {s: n / len(urls) for s, n in Counter(x[1].split(".")[-1] for x in rows).items()}
    known = {s.suffix: s for s in fitted.suffixes.collect()}
    assert {s: pytest.approx(k.suffix_share) for s, k in known.items() if k.suffix_share} == shares
    if most > len(urls):  # all labelled rows are seen
        labels = Counter()
        for _, h, p, _ in rows:
            if v := rule(h, p)[1]:
                labels[h.split(".")[-1], v == "block"] += 1
        assert all(known[s].suffix_blocked == pytest.approx((labels[s, True] + 1) / (labels[s, True] + labels[s, False] + 2)) for s in known if labels[s, True] + labels[s, False])
    blocked = {s: k.suffix_blocked for s, k in known.items()}
    got = {}
    for x in U.filter_urls(pages, max_rows=most).collect():
        got.setdefault((x.host, x.path, x.rule), []).append((x.verdict, x.score))
    verdicts = Counter()
    for u, h, p, tail in rows:
        name, verdict = rule(h, p)
        margins = [fitted.model.prior + sum(xs) for xs in itertools.product(*(leaves(t, features(u, h, p, tail, shares, blocked)) for t in fitted.model.trees))]
        scores = [1 / (1 + math.exp(-m)) for m in margins]
        hit = next((x for x in got[h, p, name] if any(math.isclose(x[1], y, rel_tol=1e-9) for y in scores) and x[0] == (verdict or ("block" if x[1] >= 0.5 else "allow"))), None)
        assert hit, (u, got[h, p, name], scores)
        got[h, p, name].remove(hit)
        verdicts[name is None, hit[0]] += 1
    assert not any(got.values()) and fitted.model.trees and {v for r, v in verdicts if r} == {"allow", "block"}
    named = U.filter_urls(pages, max_rows=most).select("page_id", "host", "path", "rule").collect()
    assert Counter(map(tuple, named)) == Counter((i if i % 50 else None, h, p, rule(h, p)[0]) for i, (_, h, p, _) in enumerate(rows))
