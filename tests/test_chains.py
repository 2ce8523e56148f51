"""Chains of versions against a walk in plain Python."""

import json
import random

import pytest

from recallium.operators import chains


def walk(nxt, i):
    seen, at = set(), i
    while at in nxt:
        if at in seen:
            return (i, None, None, True)
        seen.add(at)
        at = nxt[at]
    return (i, at, len(seen), False)


def got(df):
    return sorted(tuple(r) for r in df.select("id", "head", "depth", "in_loop").collect())


@pytest.mark.parametrize("lengths", [[1], [2], [3, 1, 8, 9], [2000, 17, 1]])
def test_long_chains(spark, lengths):
    nxt, ids = {}, []
    for k, n in enumerate(lengths):
        names = [f"c{k}-{i}" for i in range(n)]
        ids += names
        nxt |= dict(zip(names, names[1:], strict=False))
    random.Random(1).shuffle(ids)
    out = chains.heads(spark.createDataFrame([(i,) for i in ids], "id string"), spark.createDataFrame(list(nxt.items()), "id string, next string"))
    assert got(out) == sorted(walk(nxt, i) for i in ids)


def test_loops_stars_and_random_graphs(spark):
    rng, nxt = random.Random(5), {}
    for i in range(300):
        if rng.random() < 0.8:
            nxt[f"n{i}"] = f"n{rng.randrange(300)}"
    nxt |= {"self": "self", "to-self": "self", **{f"leaf{i}": "hub" for i in range(500)}, "hub": "mid", "mid": "top"}
    ids = sorted({*nxt, *nxt.values(), *(f"n{i}" for i in range(300))})
    out = chains.heads(spark.createDataFrame([(i,) for i in ids], "id string"), spark.createDataFrame(list(nxt.items()), "id string, next string"))
    assert got(out) == sorted(walk(nxt, i) for i in ids)


def test_edges_are_read_from_either_end(spark):
    rel = lambda *r: json.dumps([{"type": t, "targetId": i} for t, i in r])
    rows = [("a", 1, None), ("b", 2, rel(("supersedes", "a"))), ("c", 3, rel(("supersedes", "b"), ("supports", "a"))), ("d", 3, rel(("supersedes", "b"), ("supersedes", "gone"))), ("x", 1, rel(("superseded_by", "y"))), ("y", 0, "not json"), ("z", 9, "[]"), ("w", None, rel(("superseded_by", "nobody")))]
    df = spark.createDataFrame(rows, "id string, ts long, relations string")
    assert sorted(map(tuple, chains.superseding_edges(df).collect())) == [("a", "b"), ("b", "d"), ("x", "y")]  # of equal times the greatest id
    assert got(chains.newest_versions(df)) == [("a", "d", 2, False), ("b", "d", 1, False), ("c", "c", 0, False), ("d", "d", 0, False), ("w", "w", 0, False), ("x", "y", 1, False), ("y", "y", 0, False), ("z", "z", 0, False)]


def test_nothing(spark):
    assert got(chains.newest_versions(spark.createDataFrame([], "id string, ts long, relations string"))) == []
