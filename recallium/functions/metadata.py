"""JSON metadata of memories: tolerant reading, patches, relations. Malformed text reads as an empty object.

Fields are read from a variant; `text` marks where only JSON strings count, numbers may be numeric strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from recallium.functions import patterns as P
from recallium.functions import rules as R

MOST_RELATIONS = 16


def parsed(raw: Column) -> Column:
    """A variant, null unless the text is a JSON object."""
    v = F.try_parse_json(raw)
    return F.when(F.schema_of_variant(v).startswith("OBJECT"), v)


def text_of(m: Column, path: str) -> Column:
    """A JSON string without white space around it, null where there is none or it is blank."""
    found = F.try_variant_get(m, path, "variant")
    return F.when(F.schema_of_variant(found) == "STRING", F.nullif(P.strip(F.try_variant_get(m, path, "string")), F.lit("")))


def number_of(m: Column, path: str) -> Column:
    return F.coalesce(F.try_variant_get(m, path, "double"), F.try_variant_get(m, path, "string").try_cast("double"))


def count_of(m: Column, path: str, otherwise: Column) -> Column:
    n = number_of(m, path)
    return F.when(n >= 0, F.floor(n)).otherwise(otherwise).cast("long")


def time_of(m: Column, path: str) -> Column:
    n = number_of(m, path)
    return F.when(n > 0, F.floor(n)).cast("long")


def one_of(m: Column, path: str, values: list[str], otherwise) -> Column:
    t = text_of(m, path)
    return F.when(t.isin(values), t).otherwise(otherwise)


# Tiers, states, sources, layers; the default comes last by rule.
TIERS, STATES = ["core", "working", "peripheral"], ["pending", "confirmed", "archived"]
SOURCES, LAYERS = ["manual", "auto-capture", "reflection", "session-summary", "legacy"], ["durable", "working", "reflection", "archive"]
VERSIONED = ["preferences", "entities"]


def smart(m: Column, text: Column, category: Column, ts: Column) -> dict[str, Column]:
    """All fields with their defaults, by name; m as of parsed()."""
    legacy = R.legacy_category(category, text)
    kind = text_of(m, "$.type")
    by_kind = F.when(kind == "session-summary", "session-summary").when(kind.isin("memory-reflection", "memory-reflection-item"), "reflection").otherwise("legacy")
    given = F.try_variant_get(m, "$.source", "string")
    source = F.when(given.isNull(), by_kind).when(given.isin(SOURCES), given).otherwise("legacy")
    state = F.coalesce(F.try_variant_get(m, "$.state", "string"), F.when(source == "session-summary", "archived").otherwise("confirmed"))
    state = F.when(state.isin(STATES), state).otherwise("confirmed")
    layer = F.when(source.isin("reflection", "session-summary"), "reflection").when(state == "archived", "archive").when(legacy.isin("profile", "preferences", "events"), "durable").otherwise("working")
    layer = F.coalesce(F.try_variant_get(m, "$.memory_layer", "string"), layer)
    named = F.coalesce(text_of(m, "$.memory_category"), legacy)
    l0 = F.coalesce(text_of(m, "$.l0_abstract"), text)
    valid_from, ended = F.coalesce(time_of(m, "$.valid_from"), ts), time_of(m, "$.invalidated_at")
    confidence = F.try_variant_get(m, "$.confidence", "double")
    return {
        "l0_abstract": l0, "l1_overview": F.coalesce(text_of(m, "$.l1_overview"), F.concat(F.lit("- "), l0)), "l2_content": F.coalesce(text_of(m, "$.l2_content"), text), "memory_category": named,
        "tier": one_of(m, "$.tier", TIERS, "working"), "access_count": count_of(m, "$.access_count", F.lit(0)), "confidence": F.coalesce(F.least(F.lit(1.0), F.greatest(F.lit(0.0), confidence)), F.lit(0.7)),
        "last_accessed_at": count_of(m, "$.last_accessed_at", ts), "valid_from": valid_from, "invalidated_at": F.when(ended >= valid_from, ended), "temporal_type": one_of(m, "$.memory_temporal_type", ["static", "dynamic"], None),
        "valid_until": time_of(m, "$.valid_until"), "fact_key": F.coalesce(text_of(m, "$.fact_key"), F.when(named.isin(VERSIONED), P.fact_key(named, l0))), "superseded_by": text_of(m, "$.superseded_by"),
        "state": state, "source": source, "memory_layer": F.when(layer.isin(LAYERS), layer).otherwise("working"), "injected_count": count_of(m, "$.injected_count", F.lit(0)), "bad_recall_count": count_of(m, "$.bad_recall_count", F.lit(0)),
        "legacy": m.isNull() | text_of(m, "$.memory_category").isNull(),
    }


#: Names of the known fields in the JSON text, where they differ.
WRITTEN_AS = {"temporal_type": "memory_temporal_type"}


def built(raw: Column, patch: Column, text: Column, category: Column, ts: Column) -> Column:
    """The metadata as JSON after a patch: every known field in its normal form, those without a value left out, and every key that is not
    known as it was, whatever it holds. Building again changes nothing."""
    after = patched(raw, patch)
    fields = {WRITTEN_AS.get(n, n): c for n, c in smart(parsed(after), text, category, ts).items() if n != "legacy"}
    kind = "map<string,variant>"
    known = F.try_variant_get(F.try_parse_json(F.to_json(F.struct(*(c.alias(n) for n, c in fields.items())))), "$", kind)
    others = F.map_filter(F.try_variant_get(F.try_parse_json(after), "$", kind), lambda k, _: ~k.isin(list(fields)))
    return F.to_json(F.map_concat(others, known))


def patched(raw: Column, patch: Column) -> Column:
    """The object with the patch's keys in place, as JSON; null values of a patch count too."""
    kind = "map<string,variant>"
    old, new = (F.coalesce(F.try_variant_get(F.try_parse_json(x), "$", kind), F.create_map().cast(kind)) for x in (raw, patch))
    merged = F.map_concat(F.map_filter(old, lambda k, _: ~F.array_contains(F.map_keys(new), k)), new)
    return F.to_json(merged)


def with_relation(relations: Column, kind: str, target: Column) -> Column:
    """An array of (type, target) with one more, unless it is there; at most MOST_RELATIONS stay, the oldest."""
    new = F.struct(F.lit(kind).alias("type"), target.alias("target"))
    there = F.exists(relations, lambda r: (r["type"] == kind) & (r["target"] == target))
    return F.slice(F.when(there, relations).otherwise(F.concat(relations, F.array(new))), 1, MOST_RELATIONS)
