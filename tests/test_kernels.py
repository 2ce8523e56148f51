"""Hand-computed values of the scoring kernels, edge cases of vectors and rules, and streaming against batch."""

import math
import shutil

import pytest
from pyspark.sql import functions as F

from recallium.functions import kernels as K
from recallium.functions import patterns as P
from recallium.functions import vector as V
from recallium.operators import search as S
from recallium.plans import lifecycle_queries as L
from recallium.sources import memories as M

ROW = {
    "s": 0.5, "v": 0.8, "b": 0.4, "ts": M.NOW - 14 * M.DAY, "importance": 0.6, "len": 1000.0, "access_count": 0, "last_accessed_at": None, "dynamic": False, "category": "entity",
    "tier": "working", "confidence": 0.7, "injected_count": 0, "last_confirmed_at": None, "bad_count": 0, "doc_id": 0, "kind": "entities",
}
SCHEMA = "s double, v double, b double, ts long, importance double, len double, access_count long, last_accessed_at long, dynamic boolean, category string, tier string, confidence double, injected_count long, last_confirmed_at long, bad_count long, doc_id long, kind string"


def value(spark, text, **changed):
    return spark.createDataFrame([ROW | changed], SCHEMA).select(F.expr(text).alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("text", "changed", "want"),
    [
        (K.FUSION, {}, 0.7 * 0.8 + 0.3 * 0.4),
        (K.FUSION, {"v": 0.1, "b": 1.0}, 0.92),
        (K.FUSION, {"v": None}, 0.4),
        (K.FUSION, {"v": None, "b": None}, 0.1),
        (K.RECENCY, {}, 0.5 + math.exp(-1) * 0.1),
        (K.IMPORTANCE, {"importance": None}, 0.5 * (0.85 + 0.15 * 0.7)),
        (K.IMPORTANCE, {"importance": float("nan")}, 0.5 * 0.85),
        (K.IMPORTANCE, {"importance": float("inf")}, 0.5 * 0.85),
        (K.RECENCY, {"ts": 0}, 0.6),
        (K.RECENCY, {"ts": -5}, 0.6),
        (K.RECENCY, {"ts": None}, 0.6),
        (K.TIME_DECAY, {"ts": 0}, 0.5),
        (K.SEARCH_BOOST, {"importance": float("nan")}, 0.5 * 0.3),
        (K.LENGTH, {}, 0.5 / 1.5),
        (K.LENGTH, {"len": 10.0}, 0.5),
        (K.half_life("60.0"), {}, 60.0),
        (K.half_life("60.0"), {"access_count": 10**6, "last_accessed_at": M.NOW}, 180.0),
        (K.RERANK_LIGHT, {"v": 1.0}, 0.65),
        (K.rerank_floor(True), {"b": 0.75}, 0.475),
        (K.WEIBULL, {"importance": 0.0}, math.exp(-math.log(2) / 30 * 14)),
        (K.FREQUENCY, {}, 0.0),
        (K.CONFIRM, {"last_confirmed_at": M.NOW - 14 * M.DAY}, 0.75),
        (K.CONFIRM, {"last_confirmed_at": M.NOW - 14 * M.DAY, "ts": M.NOW}, 1.0),
        (K.SIGMOID, {"b": 0.5}, 1 / (1 + math.exp(-1))),
        (K.SIGMOID, {"b": 0.0}, 0.5),
        (K.TIME_DECAY, {}, 0.5 * (0.5 + 0.5 * math.exp(-14 / 60))),
        (K.TIME_DECAY, {"kind": "events"}, 0.5 * (0.5 + 0.5 * math.exp(-14 / 24))),
        (K.TIME_DECAY, {"kind": "profile", "dynamic": True}, 0.5 * (0.5 + 0.5 * math.exp(-14 / 40))),
        (K.ADMISSION, {"kind": "events"}, 0.1 * 0.5 + 0.1 * 0.7 + 0.1 * 0.2 + 0.1 * 0.5 + 0.6 * 0.45),
        (K.ADMISSION, {"kind": "patterns", "v": None}, 0.1 * 0.5 + 0.1 * 0.7 + 0.1 + 0.1 * 0.5 + 0.6 * 0.85),
        (K.CONFIDENCE_UPDATE, {"bad_count": 2}, 0.6),
        (K.CONFIDENCE_UPDATE, {"ts": M.NOW - 130 * M.DAY}, 0.6),
        (K.CONFIDENCE_UPDATE, {"ts": M.NOW - 130 * M.DAY, "last_confirmed_at": M.NOW - 40 * M.DAY}, 0.7 + 0.025 - 0.01),
        (K.LINE_QUALITY, {"access_count": 6}, 1.0),
        (K.clamp01("s"), {"s": float("nan")}, 0.0),
        (K.clamp01("s", "0.3"), {"s": None}, 0.3),
    ],
)
def test_kernel(spark, text, changed, want):
    assert value(spark, text, **changed) == pytest.approx(want, abs=1e-9)


def test_decay_falls_with_age(spark):
    values = [value(spark, K.COMPOSITE, ts=M.NOW - d * M.DAY) for d in (0, 1, 10, 100, 1000)]
    assert values == sorted(values, reverse=True)


def test_health_and_recovery(spark):
    """By hand: one of two core memories is active, mean confidence 0.5, 3 bad of 5 accesses."""
    rows = [(1, "core", "confirmed", 0.3, 2, 3), (2, "core", "archived", 0.6, 0, 1), (3, "peripheral", "archived", 0.7, 1, 1), (4, "working", "archived", 0.4, 0, 0)]
    df = spark.createDataFrame(rows, "doc_id long, tier string, state string, confidence double, bad_count long, access_count long")
    assert L.health(df).first()[0] == pytest.approx(0.4 * 0.5 + 0.3 * 0.5 + 0.3 * (1 - 3 / 6))
    assert L.health(df.where("false")).first()[0] == 0.5
    assert L.recovered(df).count() == 0
    assert sorted(map(tuple, L.recovered(df, 0.9).collect())) == [(2, "confirmed", "core"), (3, "confirmed", "working")]


def test_cosine_edges(spark):
    rows = [([1.0, 0.0], [1.0, 0.0], 1.0), ([1.0, 0.0], [0.0, 2.0], 0.0), ([0.0, 0.0], [1.0, 1.0], 0.0), ([1.0], [1.0, 1.0], 0.0), ([], [], 0.0), (None, [1.0], 0.0)]
    df = spark.createDataFrame(rows, "a array<double>, b array<double>, want double")
    assert all(r["x"] == pytest.approx(r["want"]) for r in df.select(V.cosine(F.col("a"), F.col("b")).alias("x"), "want").collect())


def test_min_max_of_single_and_equal_hits(spark):
    rows = [(1, 1, 3.0), (2, 1, 2.0), (2, 2, 2.0), (3, 1, 1.0), (3, 2, 5.0), (3, 3, 3.0)]
    out = {(r["qid"], r["doc_id"]): r["bm25"] for r in S.min_max(spark.createDataFrame(rows, "qid long, doc_id long, bm25 double")).collect()}
    assert out == {(1, 1): 0.0, (2, 1): 0.0, (2, 2): 0.0, (3, 1): 0.0, (3, 2): 1.0, (3, 3): 0.5}


def test_demotion_keeps_all_rows(spark):
    rows = [(1, 1, 0.9, [1.0, 0.0]), (1, 2, 0.8, [1.0, 0.01]), (1, 3, 0.7, [0.0, 1.0])]
    out = S.demote_similar(spark.createDataFrame(rows, "qid long, doc_id long, score double, vector array<double>")).orderBy("rank").collect()
    assert [r["doc_id"] for r in out] == [1, 3, 2]


def test_ascii_boundaries(spark):
    df = spark.createDataFrame([("我my是",), ("amy",), ("my x",)], "t string")
    assert [r[0] for r in df.select(P.any_of(F.col("t"), [r"\bmy\b"])).collect()] == [True, False, True]


def test_scope_filter(spark):
    df = spark.createDataFrame([(None,), ("global",), ("agent:x",)], "scope string")
    assert [df.where(M.scope_filter(s)).count() for s in (None, [], ["global"], ["agent:x"])] == [3, 0, 2, 1]


def test_stream_equals_batch(spark, tmp_path):
    from recallium.streaming import sessions

    source = "/root/testdata/sf0.001"
    (tmp_path / "in").mkdir()
    shutil.copy(f"{source}/events.parquet", tmp_path / "in")
    events = sessions.read_events(spark, str(tmp_path / "in"))
    stream = sessions.rate_limited(events).writeStream.format("memory").queryName("passed").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    stream.awaitTermination(120)
    from recallium import registry

    batch = registry.queries()["cooldown_decisions"](spark, source).where("passed").select("event_id")
    assert {r[0] for r in spark.table("passed").select("event_id").collect()} == {r[0] for r in batch.collect()}
