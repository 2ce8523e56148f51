"""The table in versions: concurrent writers, delete vectors, rewriting of touched buckets only, restoring."""

import threading
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from recallium.operators import compaction
from recallium.sources.versions import Change, ConcurrentWrite, Versions

SCHEMA = "doc_id long, text string, n int"


@pytest.fixture
def versions(spark, tmp_path):
    t = Versions(spark, f"file://{tmp_path}/t")
    t.create(spark.createDataFrame([(i, f"t{i}", i) for i in range(40)], SCHEMA), buckets=4)
    return t


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_reading_and_writing(spark, versions):
    assert rows(versions.read()) == rows(spark.createDataFrame([(i, f"t{i}", i) for i in range(40)], SCHEMA))
    versions.append(spark.createDataFrame([(100, "new", 1), (None, "no key", 2)], SCHEMA))
    versions.delete(spark.createDataFrame([(3,), (100,), (999,), (None,)], "doc_id long"))
    have = {r["doc_id"]: r["text"] for r in versions.read().collect()}
    assert set(have) == {None, *range(40)} - {3}
    versions.append(spark.createDataFrame([(3, "again", 7)], SCHEMA))  # a later row of a deleted key is seen
    versions.update(spark.createDataFrame([(3, None, 8), (4, "four", None), (500, "nobody", 1)], SCHEMA))
    have = {r["doc_id"]: (r["text"], r["n"]) for r in versions.read().collect()}
    assert have[3] == ("again", 8) and have[4] == ("four", 4) and 500 not in have and have[None] == ("no key", 2)
    assert [versions.manifest(v)["operation"] for v in versions.history()] == ["create", "append", "delete", "append", "update"]
    assert versions.read(1).count() == 40


def test_an_update_rewrites_only_the_buckets_it_touches(spark, versions):
    before = versions.manifest()["buckets"]
    versions.update(spark.createDataFrame([(7, "seven", None)], SCHEMA))
    after = versions.manifest()["buckets"]
    assert len([b for b in before if before[b] != after[b]]) == 1
    assert versions.read().where("doc_id = 7").first()["text"] == "seven" and versions.read().count() == 40


def test_replacing_is_one_version(spark, versions):
    v = versions.replace(spark.createDataFrame([(1,), (2,)], "doc_id long"), spark.createDataFrame([(1, "merged", 3)], SCHEMA))
    assert v == 2 and versions.read().where("doc_id IN (1, 2)").collect()[0]["text"] == "merged" and versions.read().count() == 39
    assert versions.restore(1) == 3 and versions.read().count() == 40


def test_concurrent_writers_lose_nothing(spark, versions):
    """Appends, deletes and updates of the same bucket at once: each is there afterwards."""

    def work(i):
        if i % 3 == 0:
            return versions.append(spark.createDataFrame([(1000 + i, f"w{i}", i)], SCHEMA))
        if i % 3 == 1:
            return versions.delete(spark.createDataFrame([(i,)], "doc_id long"))
        return versions.update(spark.createDataFrame([(20, None, 500 + i), (20 + i, f"u{i}", None)], SCHEMA))

    with ThreadPoolExecutor(4) as pool:
        got = list(pool.map(work, range(9)))
    assert sorted(got) == list(range(2, 11))
    have = {r["doc_id"]: r["text"] for r in versions.read().collect()}
    assert {1000, 1003, 1006} <= set(have) and not {1, 4, 7} & set(have) and [have[20 + i] for i in (2, 5, 8)] == ["u2", "u5", "u8"]
    assert versions.read().count() == 40 and versions.read().where("doc_id = 20").first()["n"] in (502, 505, 508)


def test_a_conflict_makes_the_change_anew(spark, versions):
    """Another writer changes the bucket between reading and committing: both changes are kept."""
    inner, seen = versions._rewrite, []

    def slow(operation, touched, change, m):
        out = inner(operation, touched, change, m)
        if not seen:
            seen.append(1)
            Versions(spark, versions.root).update(spark.createDataFrame([(7, None, 70)], SCHEMA))
        else:
            seen.append(2)
        return out

    versions._rewrite = slow
    versions.update(spark.createDataFrame([(7, "seven", None)], SCHEMA))
    assert seen == [1, 2] and tuple(versions.read().where("doc_id = 7").first()) == (7, "seven", 70)
    used = {c for f in versions.manifest()["buckets"].values() for c, _ in f["rows"]}
    assert used <= set(versions.files.children(f"{versions.root}/rows"))


def test_giving_up_and_existing_tables(spark, versions):
    with pytest.raises(ConcurrentWrite):
        versions.create(spark.createDataFrame([(1, "x", 1)], SCHEMA))

    def always(m):
        Versions(spark, versions.root).append(spark.createDataFrame([(1, "x", 1)], SCHEMA))
        return Change("update", reads=set(range(4)))

    with pytest.raises(ConcurrentWrite):
        versions._commit(always, attempts=2)


def test_put_if_absent_has_one_winner(spark, tmp_path):
    files, wins, gate = Versions(spark, f"file://{tmp_path}/x").files, [], threading.Barrier(8)

    def put(i):
        gate.wait()
        if files.put_if_absent(f"file://{tmp_path}/x/one.json", f"writer {i}"):
            wins.append(i)

    threads = [threading.Thread(target=put, args=(i,)) for i in range(8)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert len(wins) == 1 and files.read(f"file://{tmp_path}/x/one.json") == f"writer {wins[0]}" and files.children(f"file://{tmp_path}/x") == ["one.json"]


def test_compacting_and_vacuum(spark, versions):
    for i in range(3):
        versions.append(spark.createDataFrame([(200 + j, "a", i) for j in range(8 * i, 8 * i + 8)], SCHEMA))
    versions.delete(spark.createDataFrame([(i,) for i in range(0, 40, 2)], "doc_id long"))
    want = rows(versions.read())
    versions.compact(most=1)
    assert rows(versions.read()) == want and all(len(f["rows"]) <= 1 and not f["deletes"] for f in versions.manifest()["buckets"].values())
    assert versions.vacuum(keep=1) > 0 and rows(versions.read()) == want and len(versions.history()) == 1
    versions.append(spark.createDataFrame([(900, "later", 1)], SCHEMA))
    assert versions.read().count() == len(want) + 1


def test_a_table_without_rows(spark, tmp_path):
    t = Versions(spark, f"file://{tmp_path}/e")
    t.create(spark.createDataFrame([], SCHEMA), buckets=2)
    assert t.read().collect() == [] and t.read().columns == ["doc_id", "text", "n"]
    t.delete(spark.createDataFrame([(1,)], "doc_id long"))
    t.append(spark.createDataFrame([(1, "x", 2)], SCHEMA))
    assert t.read().select(F.sum("n")).first()[0] == 2


MEMORIES = "doc_id long, text string, vector array<double>, importance double, category string, scope string, ts long, metadata string"


@pytest.fixture
def memories(spark, tmp_path):
    rows = [(1, "a\nb", [1.0, 0.0], 0.2, "fact", "global", 5, None), (2, "B\nc", [1.0, 0.01], 0.9, "other", "global", 6, None), (3, "d", [0.0, 1.0], 0.5, "fact", "global", 7, None), (4, "e", [1.0, 0.0], 0.1, "fact", "global", 99, None), (5, "f", [1.0, 0.0], 0.1, "fact", "agent:x", 6, None), (6, "g", [], 0.1, "fact", "global", 6, None)]
    t = Versions(spark, f"file://{tmp_path}/m")
    t.create(spark.createDataFrame(rows, MEMORIES), buckets=4)
    return t


def test_compaction_is_one_transaction(spark, memories):
    planned = compaction.compact(memories, 2, 50, ["global"], dry_run=True)
    assert (planned.scanned, planned.clusters, planned.deleted, planned.created, planned.version) == (3, 1, 0, 0, None) and memories.history() == [1]
    done = compaction.compact(memories, 2, 50, ["global"])
    assert (done.scanned, done.clusters, done.deleted, done.created, done.version) == (3, 1, 2, 1, 2)
    have = {r["doc_id"]: r for r in memories.read().collect()}
    new = next(r for i, r in have.items() if i not in range(7))
    assert set(have) - {new["doc_id"]} == {3, 4, 5, 6} and new["text"] == "B\nc\na" and (new["importance"], new["category"], new["scope"]) == (0.9, "other", "global")
    assert new["metadata"] == '{"compacted":true,"sourceCount":2,"compactedAt":50}' and new["vector"] == pytest.approx([1.0, 0.005], abs=1e-4)
    assert compaction.compact(memories, 2, 50, ["global"]).version is None and memories.read(1).count() == 6


def test_compaction_sees_what_others_wrote_meanwhile(spark, memories):
    """A member is changed while a run plans: the run is made anew and takes the change over."""
    plain, seen = memories.read, []

    def read(*a):
        seen.append(1)
        rows = plain(*a)
        if len(seen) == 1:
            Versions(spark, memories.root).update(spark.createDataFrame([(1, "changed")], "doc_id long, text string"))
        return rows

    memories.read = read
    done = compaction.compact(memories, 2, 50, ["global"])
    assert len(seen) == 2 and done.version == 3
    memories.read = plain
    assert [r["text"] for r in memories.read().where("metadata IS NOT NULL").collect()] == ["B\nc\nchanged"]
