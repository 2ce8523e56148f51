"""Scoring kernels as SQL expressions over named columns, for F.expr(); each is pure and stays in code generation.

Scores s, v (vector), b (text), ages in days; dates in epoch milliseconds."""

from __future__ import annotations

from recallium.sources.memories import DAY, NOW


def clamp01(x: str, fallback: str = "0.0") -> str:
    """The fallback holds for null, NaN and infinite values only; it is no floor."""
    return f"(CASE WHEN ({x}) IS NULL OR isnan({x}) OR abs({x}) = CAST('Infinity' AS DOUBLE) THEN {fallback} ELSE least(1.0, greatest(0.0, {x})) END)"


def age(column: str = "ts") -> str:
    return f"(greatest(0.0, CAST({NOW} - {column} AS DOUBLE) / {DAY}.0))"


FUSION = f"(CASE WHEN v IS NOT NULL THEN {clamp01('greatest(0.7 * v + 0.3 * coalesce(b, 0.0), CASE WHEN coalesce(b, 0.0) >= 0.75 THEN 0.92 * b ELSE 0.0 END)', '0.1')} ELSE {clamp01('b', '0.1')} END)"


def rerank_floor(returned: bool) -> str:
    a, b, c = ("0.95", "0.9", "0.5") if returned else ("1.0", "0.95", "0.8")
    return f"(s * CASE WHEN coalesce(b, 0.0) >= 0.75 THEN {a} WHEN coalesce(b, 0.0) >= 0.6 THEN {b} ELSE {c} END)"


RERANK_BLEND = f"greatest({rerank_floor(True)}, {clamp01('0.6 * coalesce(v, 0.0) + 0.4 * s')})"
RERANK_UNRETURNED = f"greatest({rerank_floor(False)}, 0.8 * s)"
RERANK_LIGHT = clamp01("0.7 * s + 0.3 * coalesce(v, 0.0)", "s")
#: Days since the time of a row; one that is null, 0 or before counts as now.
STAMPED_AGE = age(f"(CASE WHEN ts > 0 THEN ts ELSE {NOW} END)")
RECENCY = clamp01(f"s + exp(-{STAMPED_AGE} / 14.0) * 0.1", "s")
IMPORTANCE = clamp01("s * (0.85 + 0.15 * coalesce(importance, 0.7))", "s * 0.85")
LENGTH = clamp01("s / (1.0 + 0.5 * log2(greatest(len / 500.0, 1.0)))", "s * 0.6")


def half_life(base: str) -> str:
    """Reinforced by accesses, which fade with a 30-day half-life; at most three times the base."""
    since = f"(greatest(0.0, CAST({NOW} - coalesce(last_accessed_at, {NOW}) AS DOUBLE) / {DAY}.0))"
    effective = f"(least(access_count, 10000) * exp(-{since} * ln(2.0) / 30.0))"
    return f"(CASE WHEN access_count <= 0 THEN {base} ELSE least({base} + {base} * 0.5 * ln(1.0 + {effective}), {base} * 3.0) END)"


# How much longer a kind (the newer category) lives, and its prior at admission.
KINDS = (("profile", 2.0, 0.95), ("preferences", 1.5, 0.9), ("entities", 1.0, 0.75), ("events", 0.4, 0.45), ("cases", 0.5, 0.8), ("patterns", 1.0, 0.85))
_OF_KIND = lambda i, other: "(CASE kind " + " ".join(f"WHEN '{k[0]}' THEN {k[i]}" for k in KINDS) + f" ELSE {other} END)"
CATEGORY_LIFE = _OF_KIND(1, 1.0)
BASE_LIFE = f"((CASE WHEN dynamic THEN 20.0 ELSE 60.0 END) * {CATEGORY_LIFE})"
TIME_DECAY = clamp01(f"s * (0.5 + 0.5 * exp(-{STAMPED_AGE} / {half_life(BASE_LIFE)}))", "s * 0.5")
BETA = "(CASE tier WHEN 'core' THEN 0.8 WHEN 'working' THEN 1.0 ELSE 1.3 END)"
LAST_ACTIVE = "(CASE WHEN access_count > 0 THEN coalesce(last_accessed_at, ts) ELSE ts END)"
WEIBULL = f"exp(-(ln(2.0) / ((CASE WHEN dynamic THEN 10.0 ELSE 30.0 END) * exp(1.5 * importance))) * power({age(LAST_ACTIVE)}, {BETA}))"
SPAN = f"(greatest(1.0, CAST({LAST_ACTIVE} - ts AS DOUBLE) / {DAY}.0) / greatest(access_count - 1, 1))"
FREQUENCY = f"((1.0 - exp(-access_count / 5.0)) * CASE WHEN access_count > 1 THEN 0.5 + 0.5 * exp(-{SPAN} / 30.0) ELSE 1.0 END)"
COMPOSITE = f"(0.4 * {WEIBULL} + 0.3 * {FREQUENCY} + 0.3 * importance * confidence)"
TIER_FLOOR = "(CASE tier WHEN 'core' THEN 0.9 WHEN 'working' THEN 0.7 ELSE 0.5 END)"
_BOOSTED = clamp01(f"s * least(1.0, greatest(0.3, 0.3 + 0.7 * greatest({TIER_FLOOR}, {COMPOSITE})))", "s * 0.3")
SEARCH_BOOST = f"(CASE WHEN isnan({COMPOSITE}) THEN s * 0.3 ELSE {_BOOSTED} END)"
#: Over a column composite.
TIER_NEXT = f"""CASE WHEN tier = 'peripheral' AND access_count >= 3 AND composite >= 0.4 THEN 'working'
 WHEN tier = 'working' AND access_count >= 10 AND composite >= 0.7 AND importance >= 0.8 THEN 'core'
 WHEN tier = 'working' AND (composite < 0.15 OR ({age()} > 60 AND access_count < 3)) THEN 'peripheral'
 WHEN tier = 'core' AND composite < 0.15 AND access_count < 3 THEN 'working' ELSE tier END"""
IDLE = f"(CASE WHEN last_accessed_at IS NULL THEN {age()} ELSE {age('last_accessed_at')} END)"
CONFIRM = f"(CASE WHEN last_confirmed_at IS NULL THEN 0.0 ELSE CASE WHEN {age()} <= 0 THEN 1.0 ELSE 0.5 + 0.5 * power(2.0, -{age('last_confirmed_at')} / 14.0) END END)"
TIER_AGE = f"(0.5 + 0.5 * (1.0 - exp(-{age()} / CASE tier WHEN 'core' THEN 30.0 WHEN 'working' THEN 14.0 ELSE 7.0 END)))"
CONSOLIDATION = clamp01(
    f"0.25 * power(2.0, -{IDLE} / 14.0) + 0.20 * (1.0 - exp(-access_count / 8.0)) + 0.20 * (1.0 - exp(-injected_count / 10.0)) + 0.15 * {CONFIRM} + 0.05 * {TIER_AGE} - 0.15 * (1.0 - power(2.0, -bad_count / 3.0))"
)
#: Over a column score.
CONSOLIDATION_ACTION = "CASE WHEN bad_count >= 5 THEN 'suppress' WHEN score >= 0.75 THEN 'promote' WHEN score <= 0.15 THEN 'archive' ELSE 'maintain' END"
#: Days since the last access, confirmed use or, failing these, the making.
UNUSED = f"(greatest(0.0, CAST({NOW} - greatest(coalesce(last_accessed_at, 0), coalesce(last_confirmed_at, 0), ts) AS DOUBLE) / {DAY}.0))"
CONFIDENCE_UPDATE = f"least(1.0, greatest(0.1, confidence - least(0.5, 0.05 * bad_count) + CASE WHEN last_confirmed_at IS NOT NULL THEN 0.025 ELSE 0.0 END - CASE WHEN {UNUSED} > 30 THEN least(0.3, ({UNUSED} - 30.0) * 0.001) ELSE 0.0 END))"
# Midpoint in days, steepness, weight and quality of reflection kinds.
REFLECTION_KINDS = (("invariant", 45, 0.22, 1.1, 1.0), ("derived", 7, 0.65, 1.0, 0.95), ("decision", 45, 0.25, 1.1, 1.0), ("user-model", 21, 0.3, 1.0, 0.95), ("agent-model", 10, 0.35, 0.95, 0.93), ("lesson", 7, 0.45, 0.9, 0.9))
_KIND = lambda k: "(CASE doc_id % 6 " + " ".join(f"WHEN {i} THEN {float(r[k])}" for i, r in enumerate(REFLECTION_KINDS)) + " END)"
REFLECTION = f"(1.0 / (1.0 + exp({_KIND(2)} * ({age()} - {_KIND(1)}))) * {_KIND(3)} * {_KIND(4)} * CASE WHEN dynamic THEN 0.75 ELSE 1.0 END)"
LINE_QUALITY = "(CASE WHEN access_count <= 0 THEN 0.2 ELSE least(1.0, 0.55 + 0.075 * least(6, access_count)) END)"
ADMISSION_PRIOR = _OF_KIND(2, 0.5)
ADMISSION = f"(0.1 * s + 0.1 * confidence + 0.1 * (1.0 - greatest(0.0, coalesce(v, 0.0))) + 0.1 * (1.0 - power(2.0, -{age()} / 14.0)) + 0.6 * {ADMISSION_PRIOR})"
INTENT_BOOST = "(CASE WHEN category IN ('preference', 'decision') THEN least(1.0, s * 1.15) ELSE s END)"
#: Raw text scores are divided by the midpoint; what is not above 0 gets one half. b stands for a tenth of a raw score.
MIDPOINT = 5.0
SIGMOID = f"(CASE WHEN b > 0 THEN 1.0 / (1.0 + exp(-(b * 10.0) / {MIDPOINT})) ELSE 0.5 END)"
