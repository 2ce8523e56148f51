"""Batches of candidates against a small table, by hand: order, batches, refilling, slots, unsafe answers, edges of both ends, rounds."""

import math

import pytest

from recallium.operators import deduplication as D


def at(degrees):
    return [math.cos(math.radians(degrees)), math.sin(math.radians(degrees))]


def said(row, shown):
    return row.said, None if row.place is None or row.place != row.place else int(row.place), row.label


def memory(i, degrees, category="entities", active=True, scope="global", text=None):
    return (i, scope, category, text or f"m{i}", at(degrees), active, None, 0, 0)


def candidate(i, degrees, answer="create", place=None, category="entities", batch=0, scope="global", text=None, label="general"):
    return (-i, scope, batch, i, category, text or f"c{i}", at(degrees), answer, place, label)


def run(spark, memories, candidates, most=D.MOST):
    m = spark.createDataFrame(memories, D.MEMORIES)
    c = spark.createDataFrame(candidates, D.CANDIDATES + ", said string, place long, label string")
    rows, decisions = D.deduplicate(m, c, said, most)
    return {r["id"]: r for r in rows.collect()}, {r["cid"]: (r["decision"], r["match"]) for r in decisions.collect()}


def edges(row):
    return [(r["type"], r["targetId"]) for r in row["relations"]]


def test_a_superseded_memory_is_seen_no_more_and_the_new_one_at_once(spark):
    rows, d = run(spark, [memory(1, 0), memory(2, 20)], [candidate(1, 0, "supersede", 1), candidate(2, 1, "supersede", 1), candidate(3, 1, "support", 2)])
    assert d == {-1: ("supersede", 1), -2: ("supersede", -1), -3: ("support", 2)}  # -2 stands at the same place as -3, then 2
    assert edges(rows[1]) == [("superseded_by", "-1")] and edges(rows[-1]) == [("supersedes", "1"), ("superseded_by", "-2")] and edges(rows[-2]) == [("supersedes", "-1")]
    assert {i for i, r in rows.items() if not r["active"]} == {1, -1} and rows[2]["supports"] == 1


def test_created_memories_are_seen_from_the_next_batch_on(spark):
    _, d = run(spark, [], [candidate(1, 0), candidate(2, 0, "support", 1), candidate(3, 0, "support", 1, batch=1), candidate(4, 0, "support", 1, batch=1, scope="agent:x")])
    assert d == {-1: ("create", None), -2: ("create", None), -3: ("support", -2), -4: ("create", None)}


def test_ended_ones_make_room_among_the_five(spark):
    """Seven active memories; after two are superseded the sixth and seventh are among the five that are looked at."""
    rows, d = run(spark, [memory(i, i) for i in range(1, 8)] + [memory(9, 0, active=False)], [candidate(1, 0, "supersede", 1), candidate(2, 0, "supersede", 2), candidate(3, 3, "merge", 3), candidate(4, 90, "merge", 1)])
    assert d[-1] == ("supersede", 1) and d[-2] == ("supersede", 2) and d[-3][0] == "merge" and d[-4] == ("create", None)
    assert rows[9]["relations"] == [] and rows[d[-3][1]]["text"] == "c3"


@pytest.mark.parametrize(
    ("answer", "place", "category", "label", "want"),
    [
        ("supersede", None, "entities", "general", ("create", None)), ("supersede", 4, "entities", "general", ("create", None)), ("contradict", 0, "events", "x", ("create", None)), ("SKIP", 1, "entities", "x", ("skip", None)),
        ("odd", 1, "entities", "x", ("create", None)), (None, 1, "entities", "x", ("create", None)), ("merge", None, "patterns", "x", ("merge", 1)), ("merge", 2, "events", "x", ("create", None)), ("supersede", 1, "cases", "x", ("create", None)),
        ("contradict", 2, "entities", "general", ("supersede", 2)), ("contradict", 2, "entities", "travel", ("contradict", 2)), ("contradict", 2, "cases", "general", ("contradict", 2)), ("contextualize", 9, "entities", "x", ("contextualize", 1)), ("support", 3, "events", "x", ("support", 3)),
    ],
)
def test_answers_are_made_safe(answer, place, category, label, want):
    class Row:
        pass

    row = Row()
    near = [{"id": i, "score": 1 - i / 100, "own": False, "kind": "entities", "brand": None, "item": None} for i in range(1, 6)]
    row.cid, row.category, row.batch, row.said, row.place, row.label, row.near, row.around, row.brand, row.item = -1, category, 0, answer, place, label, near, near, None, None
    out = D._step(said)(None, row)[1]
    assert (out["decision"], out["match"]) == want


def test_profiles_merge_with_the_nearest_profile_whatever_its_state(spark):
    rows, d = run(spark, [memory(1, 40, "profile", active=False), memory(2, 80)], [candidate(1, 0, category="profile"), candidate(2, 85, category="profile"), candidate(3, 170, category="profile", scope="agent:y")])
    assert d == {-1: ("merge", 1), -2: ("create", None), -3: ("create", None)} and rows[1]["text"] == "c1" and rows[1]["supports"] == 1


def test_another_item_of_the_brand_is_new(spark):
    old = memory(1, 0, "preferences", text="我喜欢麦当劳的板烧鸡腿堡")
    for text, want in [("我喜欢麦当劳的麦辣鸡翅", ("create", None)), ("我喜欢麦当劳的板烧鸡腿堡", ("skip", None)), ("我喜欢星巴克的拿铁", ("skip", None)), ("tea", ("skip", None))]:
        _, d = run(spark, [old], [candidate(1, 0, "skip", 1, "preferences", text=text)])
        assert d[-1] == want


def test_rounds_equal_one_run(spark):
    memories = [memory(i, 3 * i) for i in range(20)]
    answers = ["supersede", "create", "merge", "support", "contradict", "contextualize", "skip"]
    some = [candidate(i, (7 * i) % 60, answers[i % 7], i % 3 + 1, batch=i // 4, scope=["global", "agent:x"][i % 2]) for i in range(1, 40)]
    one, rounds = run(spark, memories, some), run(spark, memories, some, most=5)
    assert one[1] == rounds[1] and {i: (r["active"], r["text"], edges(r), r["supports"], r["contradictions"]) for i, r in one[0].items()} == {i: (r["active"], r["text"], edges(r), r["supports"], r["contradictions"]) for i, r in rounds[0].items()}
    assert run(spark, memories, []) == ({r["id"]: r for r in spark.createDataFrame(memories, D.MEMORIES).collect()}, {})
