"""Compaction, support, windows and session files against plain Python on small rows."""

import json
import random

import numpy as np
import pytest

from recallium.functions import vector as V
from recallium.operators import compaction, support
from recallium.plans.compaction_queries import message_windows
from recallium.sources.sessions import read_messages


def cos(a, b):
    return float(np.dot(a, b) / (np.linalg.norm(a) * np.linalg.norm(b)))


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(5)
    middles = rng.normal(size=(6, 8))
    out = [(i, float(i % 4) / 4, (middles[i % 6] + rng.normal(scale=0.25, size=8)).tolist()) for i in range(60)]
    return [*out, (60, 0.9, out[3][2]), (61, 0.1, out[3][2]), (62, 0.5, [0.0] * 8), (63, 0.5, None), (64, None, out[5][2])]


def test_greedy_clusters(spark, rows):
    planes = np.array(V.hyperplanes(compaction.PLANES, 8))
    sound = [r for r in rows if r[2] and any(r[2])]
    bucket = {r[0]: tuple(planes @ np.array(r[2]) >= 0) for r in sound}
    left, expected = sorted(sound, key=lambda r: (-(r[1] or 0), r[0])), set()
    while left:
        seed = left[0]
        took = [r for r in left if r is seed or (bucket[r[0]] == bucket[seed[0]] and cos(r[2], seed[2]) >= 0.88)]
        left = [r for r in left if r not in took]
        if len(took) > 1:
            expected |= {(r[0], seed[0]) for r in took}
    found = compaction.greedy_clusters(spark.createDataFrame(rows, "doc_id long, importance double, vector array<double>"), 8)
    assert {tuple(r) for r in found.select("doc_id", "seed").collect()} == expected and expected


def test_batch_survivors(spark, rows):
    sound = [(r[0] % 9, r[0], r[2]) for r in rows]
    expected = set()
    for batch in range(9):
        kept = []
        for _, i, v in sorted((r for r in sound if r[0] == batch), key=lambda r: r[1]):
            dup = any(v and any(v) and k and any(k) and cos(k, v) > 0.85 for k in kept)
            expected.add((batch, i, not dup))
            if not dup:
                kept.append(v)
    found = compaction.batch_survivors(spark.createDataFrame(sound, "batch long, doc_id long, vector array<double>"))
    assert {tuple(r) for r in found.collect()} == expected


def test_merged(spark):
    rows = [(2, 1, "b\n A \n", 0.2, "fact", "x"), (2, 2, "a\nc", 0.9, "decision", "s"), (2, 5, "C\nd", 0.3, "fact", "x"), (7, 7, None, 0.5, "fact", None), (7, 8, "", 0.5, "other", "x")]
    found = compaction.merged(spark.createDataFrame(rows, "seed long, doc_id long, text string, importance double, category string, scope string")).orderBy("seed").collect()
    assert [tuple(r) for r in found] == [(2, 3, "a\nc\nb\nd", 0.9, "fact", "s"), (7, 2, "", 0.5, "fact", None)]


def test_common_length():
    rng = random.Random(3)
    for _ in range(60):
        a, b = (rng.choices("abc", k=rng.randrange(12)) for _ in "ab")
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert support.common_length(a, b) == table[-1][-1]


def test_confidence_support(spark):
    asked = spark.createDataFrame([(1, "I like green tea"), (2, "?!"), (3, "alpha"), (4, "喜欢茶")], "conv_id long, candidate string")
    said = spark.createDataFrame([(1, "Hm! I like green tea! Really"), (1, "nothing"), (2, "x"), (4, "我喜欢"), (9, "y"), (4, None)], "conv_id long, text string")
    found = {r["conv_id"]: r for r in support.confidence_support(asked, said).collect()}
    assert found[1]["best"] == 1 and found[1]["coverage"] == 1 and found[1]["score"] == 1
    assert found[2]["score"] == found[3]["score"] == 0
    best = 2 * 2 / 6
    assert found[4]["best"] == pytest.approx(best) and found[4]["score"] == pytest.approx(0.7 * best + 0.3 * 2 / 3 - 0.25 / 3)
    assert len(found) == 4


def test_message_windows(spark):
    rows = [(1, t, "user" if t % 2 else "tool", "x" * 4) for t in range(1, 15)] + [(2, 1, "assistant", "y" * 99), (3, 1, "user", "  ")]
    found = message_windows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), most=30, again=1).orderBy("conv_id", "chunk").collect()
    assert [tuple(r) for r in found] == [(1, 0, 1, 3, 30), (1, 1, 3, 5, 30), (1, 2, 5, 7, 30), (2, 0, 1, 1, 105)]


def test_read_messages(spark, tmp_path):
    lines = [
        {"type": "message", "timestamp": "t1", "message": {"role": "user", "content": " hello "}}, {"type": "other"}, {"type": "message", "message": {"role": "system", "content": "no"}},
        {"type": "message", "message": {"role": "assistant", "content": [{"type": "text", "text": "a"}, {"type": "image"}, {"type": "text", "text": "b"}]}}, {"type": "message", "message": {"role": "user", "content": ""}},
    ]
    (tmp_path / "s.jsonl").write_text("\n".join(map(json.dumps, lines)) + "\n{broken\n")
    found = read_messages(spark, str(tmp_path / "*.jsonl")).orderBy("id").collect()
    assert [tuple(r)[1:] for r in found] == [(1, "user", "t1", "hello"), (2, "assistant", "", "a\nb")]
