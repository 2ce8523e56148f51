"""Sequential rules over events, by results worked out by hand."""

import datetime as dt

import pytest

from recallium import registry

START = dt.datetime(2024, 1, 1)


@pytest.fixture
def run(spark, tmp_path):
    def go(name, rows):
        """rows: (minute, event_type, k), all of one user."""
        events = [(i, START + dt.timedelta(minutes=m), 1, kind, 0.0, f'{{"k": {k}}}') for i, (m, kind, k) in enumerate(rows)]
        spark.createDataFrame(events, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").write.mode("overwrite").parquet(f"file://{tmp_path}/events.parquet")
        return registry.queries()[name](spark, f"file://{tmp_path}").collect()

    return go


def test_rate_limit_counts_only_what_went_through(run):
    out = run("hourly_rate_limit_of_two", [(0, "view", 0), (10, "view", 0), (20, "view", 0), (60, "view", 0), (61, "view", 0), (65, "view", 0), (71, "view", 0)])
    # at 60 the one at 0 still counts, at 61 no longer (20 never counted); at 65 those of 10 and 61 count, at 71 only 61
    assert [r["allowed"] for r in sorted(out, key=lambda r: r["event_id"])] == [True, True, False, False, True, False, True]


def test_support_keeps_eight_contexts(run):
    rows = [(i, "purchase", i) for i in range(9)]
    assert [tuple(r) for r in run("support_counters", [*rows, (20, "view", 50)])] == [(1, 9, 1.0, 8)]
    # context 0 was pushed out by the ninth; it comes back without its confirmation and pushes out 1
    assert [tuple(r) for r in run("support_counters", [*rows, (30, "error", 0)])] == [(1, 9, round(8 / 9, 6), 8)]


def test_bad_recalls_pause_a_memory(run):
    out = run("bad_recall_suppression", [(i, "click", 0) for i in range(16)])
    got = [tuple(r)[1:] for r in sorted(out, key=lambda r: r["event_id"])]
    # the sixth injection is the fifth bad recall: turns 7 to 14 pause, turn 15 is the sixth bad recall
    assert got[:6] == [(True, b, 14 if b == 5 else 0) for b in range(6)]
    assert got[6:14] == [(False, 5, 14)] * 8 and got[14:] == [(True, 6, 23), (False, 6, 23)]
    out = run("bad_recall_suppression", [(0, "click", 0), (1, "purchase", 0), (2, "click", 0), (3, "click", 0)])
    assert [r["bad_count"] for r in sorted(out, key=lambda r: r["event_id"])] == [0, 0, 1]
