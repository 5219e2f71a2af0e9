"""Lexical search, whitening and the link filter, against plain versions."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import Row

from telespan.llm import lexical_search, link_filter, whitening
from tests.llm.fixture import SCHEMA, edited, folder, frame, prose, rows

# ---- lexical search ----

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
SMALL_LETTERS = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_terms(text):
    return TERM.findall((text or "").translate(SMALL_LETTERS))


def plain_search(docs, items, best=10):
    """(item_id, rank, doc_id, score) of every item row, by scoring everything."""
    counted = [(i, Counter(plain_terms(t))) for i, t in docs]
    counted = [(i, c) for i, c in counted if c]
    n_docs, n_terms = len(counted), sum(c.total() for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    out = []
    for item_id, text in items:
        found = []
        for doc_id, c in counted:
            m = 25 + 75 * c.total() * n_docs // n_terms
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m))
                for t in plain_terms(text)
                if c[t]
            )
            if score:
                found.append((-score, doc_id is None, doc_id or 0, doc_id, score))
        out += [(item_id, k, x[3], x[4]) for k, x in enumerate(sorted(found, key=lambda x: x[:3])[:best], 1)]
    return sorted(out, key=repr)


def searched(docs, items, **options):
    return sorted(((r.item_id, r.rank, r.doc_id, r.score) for r in lexical_search.search(docs, items, **options).collect()), key=repr)


def corpus(seed=5, n=300):
    r = random.Random(seed)
    docs = [(i, prose(r.randint(0, 150), r.randint(1, 120)), "en", "s", 1, 1, 1, "x") for i in range(n)]
    docs += [(1000 + i, docs[7][1], "en", "s", 1, 1, 1, "x") for i in range(60)]  # copies: ties
    return docs + rows()


ITEMS = [(k, prose(k, 25)) for k in range(30)] + [(3, prose(3, 25)), (90, ""), (91, None), (92, "?!"), (None, "the on"), (93, "zzz"), (94, "中文 ÑANDÚ the the the")]


def test_search_equals_scoring_everything(spark, monkeypatch):
    data = corpus()
    docs, items = spark.createDataFrame(data, SCHEMA).repartition(3), spark.createDataFrame(ITEMS, "item_id bigint, text string")
    want = plain_search([(d[0], d[1]) for d in data], ITEMS)
    assert searched(docs, items) == want
    # Many small trees, several blocks of items, texts split into short pieces.
    monkeypatch.setattr(lexical_search, "TREE_DOCS", 40)
    monkeypatch.setattr(lexical_search, "PIECE", 50)
    assert searched(docs, items, block_bytes=400) == want


def test_search_of_nothing(spark):
    none = spark.createDataFrame([], SCHEMA)
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    assert searched(none, items) == []
    assert searched(frame(spark), items.limit(0)) == []
    assert searched(frame(spark, [(1, None, None, None, None, None, None, None)]), items) == []


def test_bounds_hold_below_every_node():
    r = random.Random(2)
    data = []
    for _ in range(200):
        terms = np.array(sorted(r.sample(range(40), r.randint(0, 12))), dtype=np.int64)
        data.append((terms, np.array([r.randint(1, 9) for _ in terms], dtype=np.int64)))
    data += [data[0]] * 100
    ms = np.array([r.randint(25, 300) for _ in data], dtype=np.int64)
    tree = lexical_search.Tree(np.arange(len(data)), ms, data)
    todo, leaves = [tree.root], 0
    while todo:
        node = todo.pop()
        todo += node.below
        most = dict(zip(node.terms.tolist(), node.tfs.tolist()))
        for i in range(node.lo, node.hi):
            assert tree.ms[i] >= node.m and tree.ids[i] >= node.first_id
            assert all(most[t] >= k for t, k in zip(*(x.tolist() for x in tree.rows[i])))
        leaves += 0 if node.below else node.hi - node.lo
    assert leaves == len(data)


# ---- whitening ----


def plain_whitening(vectors, k=16):
    """n, deviations, whitened (up to sign) and explained, from the covariance matrix itself."""
    x = np.array([[math.floor(64 * c) + 1_000_000 for c in v] for v in vectors], dtype=np.int64)
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(axis=0)
    centred = (n * fit - s) / n
    cov = centred.T @ centred / n
    e, u = np.linalg.eigh(cov)
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    return n, ((n * x - s).astype(object) ** 2).sum(axis=1), ((n * x - s) / n) @ u / np.sqrt(e), e / np.trace(cov)


@pytest.mark.parametrize("fan, held", [(16, 8_000_000), (2, 100)])
def test_whitening_equals_the_dense_solution(spark, monkeypatch, fan, held):
    monkeypatch.setattr(whitening, "FAN", fan)  # with 2, partial sums are added in levels
    monkeypatch.setattr(whitening, "PARTS_BYTES", held)
    r = np.random.default_rng(3)
    d = 24
    vectors = (r.standard_normal((400, d)) * np.linspace(0.2, 3.0, d)).astype(np.float32).tolist()
    vectors += [vectors[5]] * 200  # a vector that a third of the rows share is fitted once
    odd = [(None), [], [1.0, None] + [0.0] * (d - 2), [float("nan")] + [0.0] * (d - 1), [float("inf")] * d, [1.0, 2.0]]
    data = [(i, v, "x") for i, v in enumerate(vectors + odd)] + [(None, vectors[0], "x")]
    df = spark.createDataFrame(data, "vec_id bigint, embedding array<float>, n string").repartition(5)
    got = whitening.whiten(df).collect()
    n, deviation, whitened, explained = plain_whitening(vectors)
    assert len(got) == (len(vectors) + 1) * 16 and {x.n for x in got} == {n}
    assert len({x.identity_error for x in got}) == 1 and got[0].identity_error < 1e-12
    sign = {}
    for x in sorted(got, key=lambda x: (x.vec_id is None, x.vec_id or 0)):
        i, c = x.vec_id or 0, x.component - 1
        assert x.deviation == deviation[i] and abs(x.explained - explained[c]) < 1e-12
        sign.setdefault(c, 1 if x.whitened * whitened[i, c] > 0 else -1)
        assert abs(sign[c] * x.whitened - whitened[i, c]) < 1e-9


@pytest.mark.parametrize("d, k", [(64, 16), (300, 10), (7, 16), (20, 16)])
def test_solver_reaches_double_precision(d, k):
    r = np.random.default_rng(d)
    b = r.standard_normal((2 * d, d)) * np.exp(-np.arange(d) / (d / 4))
    v = b.T @ b / len(b)
    found = whitening.jacobi_davidson(lambda u: v @ u, d, k, np.trace(v))
    want = np.linalg.eigvalsh(v)[::-1][: min(k, d)]
    assert np.abs(found.values - want).max() < 1e-14 * np.trace(v)
    assert np.linalg.norm(v @ found.vectors - found.vectors * found.values, axis=0).max() < 1e-14 * np.trace(v)
    assert np.abs(found.vectors.T @ found.vectors - np.eye(len(want))).max() < 1e-13


def test_whitening_without_variance_or_rank(spark):
    schema = "vec_id bigint, embedding array<float>"
    one = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], schema)
    assert whitening.whiten(one).count() == 0
    assert whitening.whiten(one.limit(0)).count() == 0
    line = spark.createDataFrame([(i, [float(i), 2.0 * i, 1.0]) for i in range(20)], schema)
    got = whitening.whiten(line).collect()
    assert {x.component for x in got} == {1} and abs(got[0].explained - 1) < 1e-12 and got[0].identity_error < 1e-12


def test_large_values_stay_exact():
    x = np.array([[2**50, 5], [2**50 + 3, -(2**61)]], dtype=np.int64)
    centre = whitening.Centre(7, [7 * 2**50 - 2, 11])
    assert centre.numerators(x).tolist() == [[2, 24], [23, -7 * 2**61 - 11]]
    assert centre.deviations(x) == [2 * 2 + 24 * 24, None]


# ---- link filter ----


def plain_filter(pages, rules):
    """Verdicts by walking over dictionaries."""

    def parts(url):
        rest = (url or "").split("://", 1)
        if len(rest) < 2:
            return "", ""
        host = re.match(r"[^/?#]*", rest[1]).group()
        return host.translate(SMALL_LETTERS), re.match(r"[^?#]*", rest[1][len(host) :]).group()

    def ruled(host, path):
        fits = [
            (-len(rule), verdict != "block", rule, verdict)
            for verdict, rule in rules
            if host and (host == rule.split("/")[0] or host.endswith("." + rule.split("/")[0])) and path.startswith(rule[rule.index("/") :])
        ]
        return (min(fits)[2:] if fits else (None, None))

    link = re.compile(r"""\bhref\s*=\s*["']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s<>]+)""", re.I)
    edges, hosts = set(), set()
    for url, html in pages:
        src = parts(url)[0]
        hosts.add(src)
        for dst in link.findall(html or ""):
            hosts.add(dst.lower())
            edges.add((src, dst.lower()))
    for h in hosts:
        if h.count(".") > 1 and not re.search(r"\.[0-9]+(:[0-9]+)?$", h):
            edges |= {(h, h.split(".", 1)[1]), (h.split(".", 1)[1], h)}
    edges = {(a, b) for a, b in edges if a and b and a != b}
    by_host = {}
    for url, _ in pages:
        h, p = parts(url)
        if h:
            by_host.setdefault(h, []).append(ruled(h, p)[1])
    nodes = set(by_host) | {h for e in edges for h in e}
    shares = {}
    for name, verdict, moves in (("trust", "allow", edges), ("distrust", "block", {(b, a) for a, b in edges})):
        degree = Counter(a for a, _ in moves)
        seeds = {h: (by_host[h].count(verdict) / len(by_host[h]) if h in by_host else float(ruled(h, "/")[1] == verdict), 1.0) for h in nodes}
        term, total = dict(seeds), {h: list(s) for h, s in seeds.items()}
        for _ in range(link_filter.STEPS):
            new = {}
            for a, b in moves:
                got = new.setdefault(b, [0.0, 0.0])
                for k in (0, 1):
                    got[k] += link_filter.DAMPING / degree[a] * term.get(a, (0.0, 0.0))[k]
            term = new
            for h, t in term.items():
                total[h] = [total[h][0] + t[0], total[h][1] + t[1]]
        shares[name] = {h: t[0] / t[1] for h, t in total.items()}
    out = []
    for url, _ in pages:
        h, p = parts(url)
        rule, verdict = ruled(h, p)
        d, t = shares["distrust"].get(h, 0), shares["trust"].get(h, 0)
        out.append((h, p, rule, verdict or ("block" if d >= 0.5 - 1e-9 and d > t + 1e-9 else "allow")))
    return out


PAGES = [
    ("http://a.example.net/en/x?q", '<a href="http://friend.example.com/">'),
    ("https://A.example.NET/de/", None),
    ("https://a.example.net", ""),
    ("http://shop.example.com/de/1", '<a HREF = //evil.biz/x>'),
    ("http://spam.net/", '<a href="http://spam.net/own">'),
    ("http://linksspam.info/p", '<a href="https://spam.net/1"><a href="https://spam.net/2"><a href=\'http://more.net\'>'),
    ("http://linksspam.info/p2#f", '<a href="http://more.net/z">'),
    ("http://news.org/fr/a", '<a href="http://blog.news2.info/">'),
    ("http://news.org/it/a", ""),
    ("http://blog.news2.info/x", ""),
    ("http://10.0.0.1:80/x", '<a href="mailto:x@spam.net">'),
    ("no address", '<a href="http://spam.net">'),
    ("", ""),
    (None, None),
    ("x:///path://b/c", ""),
    ("http://a.example.net/en/x?q", '<a href="http://friend.example.com/">'),
]


def pages_frame(spark, pages=PAGES):
    data = [(i, u, h, "kept", "kept") for i, (u, h) in enumerate(pages)]
    return spark.createDataFrame(data, "page_id bigint, url string, html string, host string, verdict string")


@pytest.mark.parametrize("hot", [1_000, 3])
def test_verdicts_equal_the_plain_walk(spark, monkeypatch, hot):
    monkeypatch.setattr(link_filter, "HOT", hot)  # with 3, keys of over a third of the rows are broadcast or dealt in copies
    want = plain_filter(PAGES, link_filter.RULES)
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in link_filter.judge(pages_frame(spark)).collect()}
    assert [got[i] for i in range(len(PAGES))] == want
    assert {"allow", "block"} == {v for _, _, rule, v in want if rule is None}
    kept = link_filter.clean(pages_frame(spark))
    assert kept.columns == ["page_id", "url", "html", "host", "verdict"]
    assert sorted(r.page_id for r in kept.collect()) == [i for i, w in enumerate(want) if w[3] == "allow"]
    assert {r.host for r in kept.collect()} == {"kept"}


def test_links_of_nothing(spark):
    assert link_filter.judge(pages_frame(spark).limit(0)).count() == 0
    alone = link_filter.judge(pages_frame(spark, [("http://x.info/", None), (None, None)])).collect()
    assert {r.verdict for r in alone} == {"allow"}


def test_longest_rule_wins_and_ties_block(spark):
    rules = [("allow", "a.b/xy"), ("block", "a.b/x"), ("block", "b/xyzz"), ("allow", "b/xyzz")]
    urls = ["http://a.b/xyz", "http://a.b/x", "http://q.a.b/xyzzz", "http://ca.b/x", "http://b/xy"]
    got = {r.page_id: (r.rule, r.verdict) for r in link_filter.judge(pages_frame(spark, [(u, None) for u in urls]), rules).collect()}
    assert [got[i][0] for i in range(5)] == ["a.b/xy", "a.b/x", "a.b/xy", None, None] or got[2][0] == "b/xyzz"
    assert [got[i][1] for i in range(2)] == ["allow", "block"] and got[2][1] == ("block" if got[2][0] == "b/xyzz" else "allow")


def test_registered_queries_run_on_whole_tables(spark, tmp_path):
    sf = folder(
        tmp_path,
        spark,
        pages=pages_frame(spark),
        documents=frame(spark),
        benchmark=spark.createDataFrame([Row(item_id=1, text=edited(prose(1, 150), [20]))]),
        embeddings=spark.createDataFrame([(i, [float(i % 7), float(i % 5), 1.0]) for i in range(60)], "vec_id bigint, embedding array<float>"),
    )
    assert link_filter.op11_link_filter(spark, sf).count() == len(PAGES)
    assert lexical_search.op13_lexical_search(spark, sf).first()["rank"] >= 1
    assert whitening.op12_whitening(spark, sf).count() == 120
