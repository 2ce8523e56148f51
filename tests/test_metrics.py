"""Metrics over the newest records and merged rollups, against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from recallium.operators import metrics as M


def records(spark, rows):
    return spark.createDataFrame(rows, M.RECORDS)


def test_summary_of_the_newest(spark):
    rows = [("write", i, i // 2, float(i), i % 3 == 0, {"a": 1.0} if i % 2 else {"a": 0.5, "b": 1.0}) for i in range(20)] + [("idle", 1, 5, 7.0, False, {}), ("none", 2, 5, None, True, None)]
    got = {r["operation"]: r for r in M.summary(records(spark, rows), most=10).collect()}
    newest = list(range(10, 20))
    w = got["write"]
    assert (w["n"], w["failures"], w["mean"], w["p95"]) == (10, sum(i % 3 == 0 for i in newest), 14.5, 19.0)
    assert w["features"] == {"a": pytest.approx(0.75), "b": pytest.approx(0.5)}
    assert (got["idle"]["p95"], got["idle"]["features"]) == (7.0, None) and (got["none"]["n"], got["none"]["failures"], got["none"]["mean"]) == (1, 1, None)


def test_hours_merge_into_one_sketch_within_the_rank_error(spark):
    rng = random.Random(6)
    values = [rng.lognormvariate(0, 2) for _ in range(30_000)]
    rows = [("search", i, i * 20_000, v, False, {"hits": float(i % 11)}) for i, v in enumerate(values)]
    hours = M.by_hour(records(spark, rows))
    whole = M.merged(hours, "operation", "feature").select("feature", "n", "total", "least", "most", *(M.quantile(q).alias(f"q{int(q * 100)}") for q in (0.01, 0.5, 0.95, 0.99)))
    got = {r["feature"]: r for r in whole.collect()}
    assert hours.where("feature IS NULL").count() == 167
    r, order = got[None], sorted(values)
    assert (r["n"], r["least"], r["most"]) == (30_000, order[0], order[-1]) and r["total"] == pytest.approx(sum(values))
    for q in (1, 50, 95, 99):
        assert abs(sum(v <= r[f"q{q}"] for v in values) / len(values) - q / 100) <= M.RANK_ERROR
    assert got["hits"]["n"] == 30_000 and abs(got["hits"]["q50"] - 5) <= 1


def test_missing_measurements_and_nothing(spark):
    rows = [("a", 1, 5, None, True, {"x": float("nan"), "y": 2.0}), ("a", 2, 5, 3.0, False, None)]
    got = {(r["feature"], r["n"], r["failures"]) for r in M.by_hour(records(spark, rows)).collect()}
    assert got == {(None, 1, 0), ("y", 1, 1)}
    assert M.by_hour(records(spark, [])).count() == 0 and M.merged(M.by_hour(records(spark, [])), F.lit(1).alias("one")).count() == 0
