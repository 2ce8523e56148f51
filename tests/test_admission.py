"""Admission of candidates by hand."""

import math

import pytest

from recallium.operators import admission as A
from recallium.sources.memories import DAY, NOW


def at(degrees):
    return [math.cos(math.radians(degrees)), math.sin(math.radians(degrees))]


def run(spark, candidates, memories, preset=A.PRESETS["balanced"]):
    c = spark.createDataFrame(candidates, "cid long, scope string, kind string, vector array<double>, utility double, confidence double")
    m = spark.createDataFrame(memories, "id long, scope string, kind string, ts long, vector array<double>")
    return {r["cid"]: r for r in A.evaluate(c, m, preset, NOW).collect()}


def test_presets_weigh_and_limit():
    assert all(sum(p.normalized().weights.values()) == pytest.approx(1) for p in A.PRESETS.values())
    p = A.Preset(weights={"utility": 3, "novelty": 1, "recency": -5, "confidence": 0, "typePrior": 0}, reject=0.9, admit=0.7, priors={"events": 7}).normalized()
    assert p.weights == {"utility": 0.5, "confidence": 0.0, "novelty": 0.5, "recency": 0.0, "typePrior": 0.0} and (p.reject, p.admit) == (0.7, 0.7) and p.priors["events"] == 1.0 and p.priors["cases"] == 0.8
    assert A.Preset(weights={}).normalized().weights == pytest.approx(A.WEIGHTS) and A.Preset(weights=dict.fromkeys(A.FEATURES, -1)).normalized().weights == A.WEIGHTS
    assert A.Preset(weights={"utility": float("nan"), "typePrior": 0.8}).normalized().weights["typePrior"] == pytest.approx(0.8 / 1.2)


def test_recency_is_the_gap_to_matches_and_kinds_go_first(spark):
    memories = [(1, "global", "events", NOW, at(0)), (2, "global", "entities", NOW - 14 * DAY, at(60)), (3, None, "entities", NOW - 28 * DAY, at(40)), (4, "agent:x", "entities", NOW, at(0))]
    got = run(spark, [(-1, "global", "entities", at(0), 0.4, 0.2), (-2, None, "patterns", at(0), None, 0.2), (-3, "agent:z", "profile", at(0), float("nan"), None), (-4, "global", "odd", [], 1.0, 1.0)], memories)
    r = got[-1]  # 2 and 3 are of its kind, the nearest is 3 at 40 degrees, the latest 2 of two weeks ago
    assert r["compared"] == [3, 2] and r["matched"] == [3] and r["recency"] == pytest.approx(0.5) and r["novelty"] == pytest.approx(1 - math.cos(math.radians(40)))
    assert r["score"] == pytest.approx(0.1 * 0.4 + 0.1 * 0.2 + 0.1 * (1 - math.cos(math.radians(40))) + 0.1 * 0.5 + 0.6 * 0.75, abs=1e-8)
    assert r["decision"] == "pass_to_dedup" and r["hint"] == "update_or_merge" and r["reason"].startswith("Admission passed (0.583); hint=update_or_merge; maxSimilarity=0.766")
    assert got[-2]["compared"] == [1, 3, 2] and got[-2]["recency"] == 0.0 and got[-2]["utility"] == 0.5
    assert (got[-3]["recency"], got[-3]["novelty"], got[-3]["hint"], got[-3]["utility"], got[-3]["confidence"]) == (1.0, 1.0, "add", 0.5, 0.0)
    assert (got[-4]["typePrior"], got[-4]["max_similarity"], got[-4]["compared"]) == (0.5, 0.0, None)


def test_rejected(spark):
    got = run(spark, [(-1, "global", "events", at(0), 0.0, 0.0)], [(1, "global", "events", NOW, at(0))], A.PRESETS["conservative"])
    assert got[-1]["decision"] == "reject" and got[-1]["hint"] is None and got[-1]["reason"] == "Admission rejected (0.118 < 0.520). maxSimilarity=1.000."
    assert run(spark, [], [(1, "global", "events", NOW, at(0))]) == {}
