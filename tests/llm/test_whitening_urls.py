import math
import random
from collections import defaultdict

import numpy as np
import pytest

from tessera.llm import urls, whitening

VECTORS = "vec_id long, embedding array<float>"


def table_of(spark, rows, schema=VECTORS):
    return spark.createDataFrame(rows, schema).repartition(5)


def brute(rows, k=4):
    """Whole vectors, exact sums in Python and the covariance's eigenvectors."""
    good = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    x = {i: tuple(math.floor(256 * float(np.float32(c))) for c in v) for i, v in good}
    fit = np.array(sorted(set(x.values())), dtype=float)
    n, sums = len(fit), [sum(c) for c in zip(*set(x.values()))]
    c = fit - fit.mean(axis=0)
    e, u = np.linalg.eigh(c.T @ c / n)
    e, u = e[::-1], u[:, ::-1]
    out = {}
    for i, v in x.items():
        for j in range(min(k, len(e))):
            out[i, j + 1] = (n, sum((n * a - s) ** 2 for a, s in zip(v, sums)), float((np.array(v) - fit.mean(axis=0)) @ u[:, j] / np.sqrt(e[j])), e[j] / e.sum())
    return out


def test_whitening_equals_eigenvectors_of_the_covariance(spark):
    r = np.random.default_rng(3)
    base = r.normal(size=(400, 12)) @ r.normal(size=(12, 12)) * 0.3 + 5
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(base)]
    rows += [(1000 + k, rows[0][1]) for k in range(200)]  # copies count once in the fit
    bad = [(2000, None), (2001, [1.0] * 11 + [None]), (2002, [1.0] * 11 + [math.nan]), (2003, [1.0] * 11 + [math.inf])]
    df = table_of(spark, [(*x, "x", 7) for x in rows + bad], VECTORS + ", n string, component int")
    model = whitening.fit_whitening(df)
    got = {(x.vec_id, x.component): x for x in whitening.whiten(df, model).collect()}
    want = brute(rows)
    assert set(got) == set(want)
    for j in (1, 2, 3, 4):
        sign = np.sign(got[5, j].whitened * want[5, j][2])
        for i, _ in rows:
            g, w = got[i, j], want[i, j]
            assert (g.n, g.deviation) == w[:2]
            assert abs(g.whitened - sign * w[2]) < 1e-8 and abs(g.explained - w[3]) < 1e-10 and g.identity_error < 1e-10
    assert model.passes >= 2


def test_ill_conditioned_and_dependent_columns(spark):
    r = np.random.default_rng(4)
    a = r.normal(size=(300, 3)) * [50, 1, 0.05]
    x = np.c_[a, a[:, 0], np.zeros(300), np.full(300, 7.25)]
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    df = table_of(spark, rows)
    model = whitening.fit_whitening(df)
    want = brute(rows)
    assert len(model.values) == 4 or len(model.values) == 3
    got = {(y.vec_id, y.component): y.whitened for y in whitening.whiten(df, model).collect()}
    for j in (1, 2, 3):
        sign = np.sign(got[0, j] * want[0, j][2])
        assert max(abs(got[i, j] - sign * want[i, j][2]) for i, _ in rows) < 1e-5
    assert model.error < 1e-6


def test_few_rows_short_vectors_and_empty_tables(spark):
    none = table_of(spark, [(1, None)])
    assert whitening.fit_whitening(none) is None and whitening.whiten(none, None).count() == 0
    same = table_of(spark, [(i, [1.0, 2.0]) for i in range(5)])
    assert whitening.whiten(same, whitening.fit_whitening(same)).count() == 0  # no variance, no component
    ragged = [(1, [1.0]), (2, [1.0, 3.0]), (None, [2.0, 0.0]), (None, [2.0, 0.0]), (3, [])]
    df = table_of(spark, ragged)
    out = whitening.whiten(df, whitening.fit_whitening(df)).collect()
    assert len(out) == 10 and {x.n for x in out} == {4}
    huge = table_of(spark, [(1, [3e38, 1.0]), (2, [-3e38, 2.0]), (3, [0.0, 3.0])])
    out = whitening.whiten(huge, whitening.fit_whitening(huge)).collect()
    assert all(math.isfinite(x.whitened) for x in out) and {x.vec_id for x in out} == {1, 2, 3}


RULES = "host string, path string, verdict string"


def slow(pages, rules, default):
    out = []
    for i, url in pages:
        host = path = ""
        if url and "://" in url:
            rest = url.split("://", 1)[1]
            cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
            host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
            path = rest[cut:]
            path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
        fits = [(len(h.lower() + p), len(h), v, h.lower() + p) for h, p, v in rules if h and (host == h.lower() or host.endswith("." + h.lower())) and path.startswith(p) and host]
        best = max(fits, default=None)
        out.append((i, host, path, best and best[3], best[2] if best else default))
    return sorted(out, key=repr)


@pytest.mark.parametrize("most_sent", [0, 100])
def test_rules_equal_a_slow_judge(spark, most_sent):
    r = random.Random(5)
    hosts = ["a.org", "b.a.org", "org", "ORG", "x.com", "y.x.com", "xa.org", "org.", "", "a.org:80", "..org"]
    rules = [("org", "/", "allow"), ("a.org", "/p", "block"), ("A.org", "/p", "allow"), ("a.org", "/p/q", "allow"), ("x.com", "", "block"), ("y.x.com", "/é", "allow"), ("", "/", "block"), ("x.com", "p", "allow"), ("x.com", None, "allow"), ("q.org", "/", "other")]
    known = [(h, p or "", v) for h, p, v in rules if v != "other" and (not p or p.startswith("/")) and not (h == "x.com" and v == "allow")]
    known = [k for k in known if not (k[0] == "A.org")]
    paths = ["", "/", "/p", "/p/q", "/pq?x=/p/q", "/é/1", "#/p", "?u=http://a.org/p", "/P"]
    pages = [(i, f"http://{r.choice(hosts)}{r.choice(paths)}") for i in range(300)]
    pages += [(900, None), (901, ""), (902, "a.org/p"), (903, "://a.org/p"), (904, "http:///p"), (905, "h\n://a.org/p\nq"), (None, "http://a.org/p"), (5, "http://a.org/" + "p" * 50_000), (6, "http://" + "a." * 5_000 + "org/p"), (7, "http://a.org/p"), (7, "http://a.org/p")]
    pages += [(2000 + i, "http://hot.a.org/p/q") for i in range(500)]
    df = spark.createDataFrame([(*p, "x", "y") for p in pages], "page_id long, url string, host string, rule string").repartition(3)
    got = urls.judge(df, spark.createDataFrame(rules, RULES), "allow", most_sent=most_sent).collect()
    assert sorted((tuple(x) for x in got), key=repr) == slow(pages, known, "allow")


def test_no_rules_and_no_pages(spark):
    pages = spark.createDataFrame([(1, "http://a.org/")], "page_id long, url string")
    rules = spark.createDataFrame([("org", "/", "allow")], RULES)
    assert [tuple(x) for x in urls.judge(pages, rules.limit(0), "block").collect()] == [(1, "a.org", "/", None, "block")]
    assert urls.judge(pages.limit(0), rules).count() == 0


def test_one_short_prefix_for_several_rules_is_confirmed_by_digests(spark, monkeypatch):
    monkeypatch.setattr(urls, "SHORT", 0)  # all rules share the empty prefix
    counts = defaultdict(int)
    pages = spark.createDataFrame([(i, f"http://h{i % 3}.org/p{i % 2}") for i in range(30)], "page_id long, url string")
    rules = spark.createDataFrame([("h1.org", "/p1", "block"), ("h2.org", "/p", "allow"), ("org", "/", "allow")], RULES)
    for x in urls.judge(pages, rules, "block").collect():
        counts[x.rule, x.verdict] += 1
    assert counts == {("h1.org/p1", "block"): 5, ("h2.org/p", "allow"): 10, ("org/", "allow"): 15}
