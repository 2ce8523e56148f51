"""State with time limits: error signals, debounced counts, learned noise; each over restarts."""

import datetime
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from recallium.sources.versions import Versions
from recallium.streaming import noise, signals

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@pytest.fixture
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    yield spark
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def at(minute):
    return datetime.datetime(2024, 1, 1, 10) + datetime.timedelta(minutes=minute)


def test_error_signals_wait_for_prompts(rocks, tmp_path):
    """New signals only, each once, the latest three; forgotten after half an hour; state is kept over restarts."""
    source, out = str(tmp_path / "in"), str(tmp_path / "out")

    def send(rows):
        rocks.createDataFrame([(s, at(m), k, sig, sig and f"text {sig}") for s, m, k, sig in rows], signals.SIGNALS).coalesce(1).write.mode("append").json(source)
        stream = signals.pending_signals(rocks.readStream.schema(signals.SIGNALS).json(source))
        query = stream.writeStream.foreachBatch(lambda b, _: b.write.mode("append").json(out)).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        assert query.awaitTermination(120)
        found = sorted((r["session"], r["at"], r["signature"]) for r in rocks.read.schema(signals.PENDING).json(out).collect())
        return [(s, int((a - at(0)).total_seconds() // 60), x) for s, a, x in found]

    first = [("s", 1, "error", "a"), ("s", 2, "error", "b"), ("s", 3, "error", "a"), (" s ", 4, "prompt", None), ("s", 5, "prompt", None), (" ", 5, "error", "x"), ("t", 5, "error", "t1")]
    assert send(first) == [("s", 4, "a"), ("s", 4, "b")]
    second = send([("s", 6, "error", x) for x in "acdefg"] + [("s", 7, "prompt", None), ("t", 8, "prompt", None)])
    assert second == [("s", 4, "a"), ("s", 4, "b"), ("s", 7, "e"), ("s", 7, "f"), ("s", 7, "g"), ("t", 8, "t1")]
    third = send([("s", 50, "error", "a"), ("s", 51, "prompt", None), ("t", 52, "prompt", None)])
    assert third == sorted([*second, ("s", 51, "a")])  # "a" is new again after half an hour
    assert ("t", 52, "t1") not in third


def test_only_thirty_signals_are_kept(rocks, tmp_path):
    rows = [("s", i, "error", f"{i:02}") for i in range(29)] + [("s", 29, "error", "x"), ("s", 29, "error", "y"), ("s", 29, "error", "00"), ("s", 29, "prompt", None)]
    rocks.createDataFrame([(s, at(m), k, sig, "") for s, m, k, sig in rows], signals.SIGNALS).coalesce(1).write.json(str(tmp_path / "in"))
    stream = signals.pending_signals(rocks.readStream.schema(signals.SIGNALS).json(str(tmp_path / "in")), processor=signals.ErrorSignals(most=30, shown=99))
    query = stream.writeStream.format("memory").queryName("thirty").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "check")).start()
    assert query.awaitTermination(120)
    got = [r["signature"] for r in rocks.table("thirty").collect()]
    assert got == [f"{i:02}" for i in range(1, 29)] + ["x", "y"]  # "00" was known when it came again, and went with the thirty-first


def test_counts_go_out_when_it_is_quiet_and_are_written_once(rocks, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    kinds = "memory long, n long, at long"
    memories = Versions(rocks, f"file://{tmp_path}/m")
    memories.create(rocks.createDataFrame([(1, 5, 10), (2, 0, None), (3, 9_999, 7)], "doc_id long, access_count long, last_accessed_at long"), buckets=2)
    rocks.createDataFrame([(1, 1, 100), (2, 1, 50)], kinds).coalesce(1).write.json(source)
    stream = signals.debounced_counts(rocks.readStream.schema(kinds).json(source), 2_000)

    def sink(batch, batch_id):
        if not batch.isEmpty():
            batch.write.mode("append").json(out)
            signals.write_back(memories, batch, batch_id, "accesses")
            assert signals.write_back(memories, batch, batch_id, "accesses") is None  # the batch comes again

    query = stream.writeStream.foreachBatch(sink).option("checkpointLocation", str(tmp_path / "check")).trigger(processingTime="500 milliseconds").start()
    try:
        rocks.createDataFrame([(1, 2, 300), (3, 5, 1)], kinds).coalesce(1).write.mode("append").json(source)
        until = time.time() + 120
        while time.time() < until and memories.read().where("access_count > 0").select(F.sum("access_count")).first()[0] < 5 + 3 + 1 + 10_000:
            time.sleep(1)
    finally:
        query.stop()
    assert sorted(map(tuple, memories.read().collect())) == [(1, 8, 300), (2, 1, 50), (3, 10_000, 7)]
    bursts = rocks.read.schema(kinds).json(out).groupBy("memory").agg(F.sum("n")).collect()
    assert sorted(map(tuple, bursts)) == [(1, 3), (2, 1), (3, 5)]


def test_writing_back_is_tried_again(spark, tmp_path):
    memories = Versions(spark, f"file://{tmp_path}/m")
    memories.create(spark.createDataFrame([(1, None, None)], "doc_id long, access_count long, last_accessed_at long"), buckets=2)
    counts, fails, waits = spark.createDataFrame([(1, 2, 9), (1, 1, 4)], "memory long, n long, at long"), [1, 2], []
    plain = memories.merge

    def merge(*a):
        if fails:
            if fails.pop() == 1:
                plain(*a)  # it committed, and then the answer was lost
            raise OSError("store")
        return plain(*a)

    memories.merge = merge
    assert signals.write_back(memories, counts, 0, "s", wait=waits.append) is None
    assert waits == [0, 1] and tuple(memories.read().first()) == (1, 3, 9)
    fails[:] = [2] * 9
    with pytest.raises(OSError):
        signals.write_back(memories, counts, 1, "s", wait=waits.append)
    assert len(fails) == 4


def brute_learn(fixed, vectors, most):
    unit = lambda v: np.array(v) / np.linalg.norm(v)
    bank = []
    for p, v in vectors:
        if all(float(unit(v) @ unit(x)) < noise.KNOWN for x in [*fixed, *(b for _, b in bank)]):
            bank = [*bank, (p, v)][-most:]
    return [p for p, _ in bank]


def test_learned_noise_is_its_own_filter(spark, tmp_path):
    rng = np.random.default_rng(3)
    fixed = [list(map(float, v)) for v in np.eye(4)[:2]]
    vectors = [(i, list(map(float, v))) for i, v in enumerate(rng.normal(0, 1, (90, 4)))] + [(90, [1.0, 0.01, 0.0, 0.0]), (91, [])]
    bank = spark.createDataFrame(list(enumerate(fixed)), "place long, vector array<double>")
    kinds, source, path = "place long, vector array<double>", str(tmp_path / "in"), f"file://{tmp_path}/bank"
    for part in (vectors[:40], vectors[40:]):  # two runs of the stream: the second goes on from the version of the first
        spark.createDataFrame(part, kinds).coalesce(1).write.mode("append").parquet(source)
        assert noise.learn_noise(spark.readStream.schema(kinds).parquet(source), bank, path, str(tmp_path / "check"), most=12).awaitTermination(120)
    want = brute_learn(fixed, vectors[:91], 12)
    assert sorted(r["place"] for r in noise.learned(spark, path).collect()) == want and len(want) == 12
    noise.learn_batch(spark, spark.createDataFrame(vectors[40:], kinds), 1, bank, path, 12)  # the batch comes again
    assert sorted(r["place"] for r in noise.learned(spark, path).collect()) == want
    asked = spark.createDataFrame([(1, vectors[want[-1]][1]), (2, [0.9, 0.1, 0.0, 0.0]), (3, [-1.0, -1.0, -1.0, -1.0])], "doc_id long, vector array<double>")
    found = {r["doc_id"]: r["is_noise"] for r in noise.is_noise(asked, noise.prototypes(spark, bank, path)).collect()}
    assert found[1] and found[2]


def test_a_bank_that_cannot_tell_texts_apart_is_not_used(spark, tmp_path):
    path, kinds = f"file://{tmp_path}/bank", "place long, vector array<double>"
    same = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.01])], kinds)
    noise.learn_batch(spark, spark.createDataFrame([(5, [0.0, 1.0])], kinds), 0, same, path)
    assert not noise.usable(same) and noise.learned(spark, path).count() == 0 and noise.prototypes(spark, same, path).count() == 0
    assert not noise.usable(same.limit(0)) and noise.usable(same.limit(1))
    assert noise.KNOWN == 0.90
