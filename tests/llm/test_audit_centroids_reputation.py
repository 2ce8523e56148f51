"""The filter audit, centroid clustering and host reputation against plain Python, and their defined cases."""

import hashlib
import itertools
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from recallium.llm import audit, centroids, registry, reputation

DOCS = "doc_id long, text string, source string, form string, digest string, part string, n_words int"
LABELS = "doc_id long, quality int, toxic int, source string"


def brute_audit(docs, labels):
    first, good, bad = {}, set(), set()
    for d, t, *_ in docs:
        if d is not None:
            first[t or ""] = min(first.get(t or "", d), d)
    for d, q, x, *_ in labels:
        good |= {d} if q == 1 else set()
        bad |= {d} if x == 1 else set()
    rows = []
    for d, t, s, *_ in docs:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": d is not None and first.get(t, d) < d}
        rows.append((s or "", {k for k, v in fails.items() if v}, d is not None and d in good, d is not None and d in bad))
    out = {}
    for order in itertools.permutations("ABCDE"):
        for step, own in enumerate(order):
            before = set(order[:step])
            for part in {r[0] for r in rows}:
                of = [r for r in rows if r[0] == part]
                gone = [r for r in of if own in r[1] and not r[1] & before]
                out[part, "".join(order), step + 1] = [sum(not r[1] & (before | {own}) for r in of), len(gone), sum(own in r[1] and bool(r[1] & before) for r in of), sum(r[1] == {own} for r in of), sum(r[2] for r in gone), sum(r[3] for r in gone)]
    shapley = {}
    for (part, order, step), v in out.items():
        shapley[part, order[step - 1]] = shapley.get((part, order[step - 1]), 0) + v[1]
    return {(p, o, s, *v, shapley[p, o[s - 1]]) for (p, o, s), v in out.items()}


def clash(rows):
    return [(*r, "x", "y", "z", 7) for r in rows]


def test_audit_equals_brute_force(spark):
    rng = random.Random(3)
    long = " ".join(f"w{i}" for i in range(250))
    texts = ["", None, "ONE TWO", "a b # c", long, long + " UPPER" * 60, "x " * 300, "x " * 300, "é ü\n" * 120, long + " $", "\u2003wide\u00a0space"]
    docs = [(i, rng.choice(texts), rng.choice(["p", "q", None, ""])) for i in range(90)] + [(None, long, "p"), (None, long, "p"), (5, long, "q"), (5, long, "q"), (5, "other", "q")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None]), "s") for i in range(0, 90, 2)] + [(4, 1, 1, "s"), (4, 0, 0, "s"), (None, 1, 1, "s"), (777, 1, 1, "s")]
    got = audit.audit(spark.createDataFrame(clash(docs), DOCS), spark.createDataFrame(labels, LABELS))
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == brute_audit(docs, labels)


def test_audit_of_an_empty_table(spark):
    assert audit.audit(spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS)).count() == 0


def test_a_very_long_text_has_all_its_words_counted(spark):
    text = " ".join(f"w{i % 70_000}" for i in range(140_001))
    r = audit.facts(spark.createDataFrame(clash([(1, text, "p")]), DOCS)).first()
    assert (r["n_words"], r["n_distinct"]) == (140_001, 70_000)


def brute_clusters(rows, k=8, rounds=10):
    kept = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) and abs(x) < 1e5 for x in v)]
    name = lambda i: hashlib.sha256(f"3:{'' if i is None else i}".encode()).hexdigest()
    cs = [v for _, v in sorted(kept, key=lambda r: (name(r[0]), r[1]))[:k]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda v: min((far(v, c), j) for j, c in enumerate(cs))
    for _ in range(rounds):
        of = [near(v)[1] for _, v in kept]
        cs = [[sum(col) // len(col) for col in zip(*(v for (_, v), o in zip(kept, of, strict=True) if o == j), strict=True)] if j in of else c for j, c in enumerate(cs)]
    last = [(i, *near(v)) for i, v in kept]
    whole = sum(d for _, d, _ in last)
    return sorted((i is None, i or 0, j, d, sum(e for _, e, m in last if m == j), whole, hashlib.sha256(",".join(map(str, cs[j])).encode()).hexdigest()) for i, d, j in last)


@pytest.mark.parametrize("n", [0, 3, 120])
def test_clusters_equal_brute_force(spark, n):
    rng = np.random.default_rng(n)
    rows = [(i, [float(x) for x in rng.normal(0, 1 + i % 3, 64).astype(np.float32)]) for i in range(n)]
    if n > 10:
        rows += [(7, rows[7][1]), (8, rows[9][1]), (None, rows[9][1]), (500, None), (501, [1.0] * 63), (502, [None] + [0.0] * 63), (503, [float("nan")] + [0.0] * 63), (504, [float("-inf")] + [1.0] * 63), (505, []), (506, [3e38] + [0.0] * 63)]
        rows += [(600 + i, [0.25] * 64) for i in range(9)]
    table = spark.createDataFrame([(i, v, 1, "c") for i, v in rows], "vec_id long, embedding array<float>, cluster int, x string")
    got = centroids.cluster(table)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted((r[0] is None, r[0] or 0, *r[1:]) for r in got.collect()) == brute_clusters(rows)


def test_bounds_screen_centroids_and_lose_none():
    rng = np.random.default_rng(1)
    scale = 10.0 ** rng.integers(0, 4, 400)
    x = np.floor(rng.normal(0, 1, (400, 64)) * scale[:, None] * 50).astype(np.int64)
    c = x[:8].copy()
    of, distance, taken = centroids.nearest(x, centroids.segment_norms(x), c)
    exact = ((x[:, None] - c[None]) ** 2).sum(-1)
    assert (of == exact.argmin(1)).all() and (distance == exact.min(1)).all()
    assert 400 <= taken < 400 * 8


def url_parts(url):
    if url is None or "://" not in url:
        return "", ""
    m = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1])
    return re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]


URLS = ["http://A.Example.NET/en/1", "https://example.net/de/2?x=/en/", "x://net", "x://net/", "x://my.net?q=/", "http://example.com/de/", "http://badexample.com/de/", "http://s.example.com/de/3#a", "http://a.org/fr/4", "http://É.ORG/fr", "no scheme", "://", "a://b://c/d", None, "", "http://u@host.org:80/fr/", "http://1.2.3.4/x", "http://x.example.net/EN/"]


def test_rules_and_parts_of_urls(spark):
    pages = spark.createDataFrame([(i, u, "h", "p") for i, u in enumerate(URLS)] + [(None, URLS[0], "h", "p"), (0, URLS[0], "h", "p")], "page_id long, url string, host string, path string")
    got = reputation.judge(pages, pages.select("url", F.lit(None).cast("boolean").alias("bad")), registry.RULES)
    rows = got.collect()
    assert len(rows) == len(URLS) + 2 and {r["page_id"] for r in rows} == {None, *range(len(URLS))}
    for r in rows:
        if r["page_id"] is not None:
            host, path = url_parts(URLS[r["page_id"]])
            fit = [x for x in registry.RULES if (host == x.host or host.endswith("." + x.host)) and path.startswith(x.path)]
            best = max(fit, key=lambda x: len(x.host + x.path), default=None)
            assert (r["host"], r["path"], r["rule"]) == (host, path, best and best.host + best.path)
            assert r["verdict"] == (best.verdict if best else "allow")


def beta_above(a, b, limit, n=400_000):
    x = (np.arange(n) + 0.5) / n
    w = (a - 1) * np.log(x) + (b - 1) * np.log(1 - x)
    w = np.exp(w - w.max())
    return float(w[x > limit].sum() / w.sum())


def test_posterior_probability(spark):
    cases = [(1.0, 1.0), (3.5, 2.0), (20.0, 5.0), (400.0, 420.0), (1.2, 30.0), (90000.0, 80000.0)]
    got = spark.createDataFrame(cases, "a double, b double").select("a", "b", reputation.probability_above("a", "b", 0.5).alias("p")).collect()
    for r in got:
        assert r["p"] == pytest.approx(beta_above(r["a"], r["b"], 0.5), abs=2e-4)


def test_bad_hosts_are_blocked_and_few_labels_are_shrunk(spark):
    """A host with many bad pages goes; one with two bad pages stays while its domain is good, and goes where its whole domain is bad."""
    rows = []
    for h, n, k in [("bad.a.biz", 60, 58), ("few.good.biz", 2, 2), *((f"h{i}.good.biz", 30, 1 + i % 2) for i in range(6)), *((f"h{i}.evil.biz", 30, 28 + i % 2) for i in range(6)), ("few.evil.biz", 2, 2), ("none.evil.biz", 0, 0)]:
        rows += [(f"http://{h}/{i}", i < k if i < n else None) for i in range(n + 3)]
    outcomes = spark.createDataFrame(rows, "url string, bad boolean")
    pages = outcomes.select(F.monotonically_increasing_id().alias("page_id"), "url")
    got = {r["host"]: r for r in reputation.judge(pages, outcomes, []).select("host", "verdict", "posterior_mean", "n_labelled", "n_bad").distinct().collect()}
    assert {h for h, r in got.items() if r["verdict"] == "block"} >= {"bad.a.biz", "few.evil.biz", "h0.evil.biz"}
    assert not {h for h, r in got.items() if r["verdict"] == "block" and "good" in h}
    assert got["few.good.biz"]["posterior_mean"] < 0.6 < got["few.evil.biz"]["posterior_mean"]
    assert got["bad.a.biz"][3:] == (60, 58)


def test_domains(spark):
    hosts = {"a.b.example.com": ("example.com", "com"), "com": ("com", "com"), "": ("", ""), "u:p@x.y.org:80": ("y.org", "org"), "10.0.0.1": ("10.0.0.1", ""), "x.y.co.uk": ("y.co.uk", "co.uk"), "co.uk": ("co.uk", "co.uk"), "x.org.": ("x.org", "org")}
    df = spark.createDataFrame([(h,) for h in hosts], "h string")
    d, s = reputation.domain_and_suffix(F.col("h"), ["co.uk"])
    assert {r["h"]: (r["d"], r["s"]) for r in df.select("h", d.alias("d"), s.alias("s")).collect()} == hosts


def test_empty_tables_and_too_many_rules(spark):
    pages = spark.createDataFrame([], "page_id long, url string")
    assert reputation.judge(pages, spark.createDataFrame([], "url string, bad boolean"), registry.RULES).count() == 0
    with pytest.raises(ValueError):
        reputation.longest_rule([reputation.Rule("block", f"h{i}", "/") for i in range(300)])
