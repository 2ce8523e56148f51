"""Reflections: Markdown with known sections, cut into rules, changes, items to remember and entries for governance."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recallium.functions import rules as R

# Headings, what marks a line as a rule, a change or an open task, and how many of each are kept.
INVARIANTS, DERIVED, MERGED = "Invariants", "Derived", "Invariants & Reflections"
OPEN_LOOPS, DECISIONS = "Open loops / next actions", "Decisions (durable)"
LESSONS, GOVERNANCE = "Lessons & pitfalls (symptom / cause / fix / prevention)", "Learning governance candidates (.learnings / promotion / skill extraction)"
MAPPED = [("User model deltas (about the human)", "preference", "user-model"), ("Agent model deltas (about the assistant/system)", "preference", "agent-model"), (LESSONS, "fact", "lesson"), (DECISIONS, "decision", "decision")]
RULE = re.compile(r"^(always|never|when\b|if\b|before\b|after\b|prefer\b|avoid\b|require\b|only\b|do not\b|must\b|should\b)|\b(must|should|never|always|prefer|avoid|required?)\b", re.I | re.A)
CHANGE = re.compile(r"^(this run|next run|going forward|follow-up|re-check|retest|verify|confirm|avoid repeating|adjust|change|update|retry|keep|watch)\b|\b(this run|next run|delta|change|adjust|retry|re-check|retest|verify|confirm|avoid repeating|follow-up)\b", re.I | re.A)
TASK = re.compile(r"^(investigate|verify|confirm|re-check|retest|update|add|remove|fix|avoid|keep|watch|document)\b", re.I | re.A)
OLD_RULE, OLD_CHANGE = re.compile("invariant|stable|policy|rule", re.I), re.compile("reflect|inherit|derive|change|apply", re.I)
MOST_RULES, MOST_CHANGES = 8, 10
_PLACEHOLDER, _UNSAFE, _PREFIX = re.compile("|".join(R.PLACEHOLDERS), re.I), [re.compile(p, re.I | re.A) for p in R.UNSAFE], re.compile(R.LINE_PREFIX, re.I)


def sections(markdown: str) -> dict[str, list[str]]:
    """Lines below each second-level heading (lower case); of headings that come again only the first block counts."""
    out: dict[str, list[str]] = {}
    now, closed = None, set()
    for raw in re.split(r"\r?\n", markdown):
        line = raw.strip().lower()
        if line.startswith("## "):
            name = line[3:]
            if now is not None and name != now:
                closed.add(now)
            now = name
        elif now is not None and now not in closed:
            out.setdefault(now, []).append(raw)
    return out


def bullets(found: dict[str, list[str]], heading: str) -> list[str]:
    lines = (x.strip() for x in found.get(heading.lower(), []))
    return [b for x in lines if x.startswith(("- ", "* ")) and (b := x[2:].strip())]


def clean(lines: list[str], safe: bool = False) -> list[str]:
    """Without emphasis, prefixes and placeholders; safe also leaves out what tries to instruct a model."""
    bare = [_PREFIX.sub("", x.replace("**", "")).strip() for x in lines]
    kept = [x for x in bare if (y := x.replace("**", "").strip()) and not _PLACEHOLDER.search(y)]
    return [x for x in kept if not any(p.search(x) for p in _UNSAFE)] if safe else kept


def slices(markdown: str, safe: bool = False) -> tuple[list[str], list[str]]:
    """Rules that hold and changes for the next run; older forms are read where the newer sections are empty."""
    s = sections(markdown)
    pick = lambda lines, *tests: [x for x in clean(lines, safe) if all(t.search(x) for t in tests)]
    old = bullets(s, MERGED)
    rules = pick(bullets(s, INVARIANTS), RULE) or pick([x for x in old if OLD_RULE.search(x)], RULE) or pick(bullets(s, DECISIONS), RULE)
    changes = pick(bullets(s, DERIVED), CHANGE) or pick([x for x in old if OLD_CHANGE.search(x)], CHANGE) + pick(bullets(s, OPEN_LOOPS), TASK, CHANGE)
    return rules[:MOST_RULES], changes[:MOST_CHANGES]


def items(markdown: str, safe: bool = True) -> list[tuple[str, str, str, int, int, str]]:
    """(kind, section, category, ordinal, group size, text) of everything that a reflection says."""
    s, out = sections(markdown), []
    groups = [*zip(("invariant", "derived"), (INVARIANTS, DERIVED), ("reflection",) * 2, slices(markdown, safe), strict=True)]
    groups += [(kind, heading, category, clean(bullets(s, heading), safe)) for heading, category, kind in MAPPED]
    for kind, section, category, lines in groups:
        out += [(kind, section, category, i, len(lines), x) for i, x in enumerate(lines)]
    return out


def governance(markdown: str) -> list[dict]:
    """Entries proposed for governance; plain bullets make one entry."""
    lines = sections(markdown).get(GOVERNANCE.lower(), [])
    out = []
    for block in re.split(r"(?=^###\s+Entry\b)", "\n".join(lines).strip(), flags=re.M | re.I):
        body = re.sub(r"^###\s+Entry\b[^\n]*\n?", "", block.strip(), flags=re.I).strip()
        parts = re.split(r"^###[^\S\n]+([^\n]+?)[^\S\n]*$", body, flags=re.M)
        named = {k.lower(): v.strip().partition("\n")[0].strip() for k, v in zip(parts[1::2], parts[2::2], strict=True)}  # a section's first line counts
        if named.get("summary"):
            field = lambda name, head=body: (m[1].strip() if (m := re.search(rf"^\*\*{name}\*\*:\s*(.+)$", head, re.M | re.I)) else None)
            out.append({"priority": field("Priority"), "status": field("Status"), "area": field("Area"), "summary": named["summary"], "details": named.get("details") or None, "suggested_action": named.get("suggested action") or None})
    said = clean([b for x in lines if (t := x.strip()).startswith(("- ", "* ")) and (b := t[2:].strip())])
    if not out and said:
        out = [{
            "priority": "medium", "status": "pending", "area": "config", "summary": "Reflection learning governance candidates", "details": "\n".join(f"- {x}" for x in said),
            "suggested_action": "Review the governance candidates, promote durable rules to AGENTS.md / SOUL.md / TOOLS.md when stable, and extract a skill if the pattern becomes reusable.",
        }]
    return out


ITEMS = "id long, kind string, section string, category string, ordinal int, group_size int, text string"


def item_rows(reflections: DataFrame, safe: bool = True) -> DataFrame:
    """reflections (id, text) -> one row an item."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame([(i, *x) for i, t in zip(f["id"], f["text"].fillna(""), strict=True) for x in items(t, safe)], columns=[x.split()[0] for x in ITEMS.split(", ")])

    return reflections.select("id", "text").mapInPandas(run, ITEMS)


def event_id(at_ms: Column, *parts: Column) -> Column:
    """refl-<time>-<eight digits of SHA-1 over time and parts>."""
    at = F.greatest(F.lit(0).cast("long"), at_ms)
    day = F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'") + F.make_dt_interval(secs=(F.floor(at / 1000)).cast("decimal(18,6)"))
    joined = F.concat_ws("|", at.cast("string"), *(p.cast("string") for p in parts))
    return F.concat(F.lit("refl-"), F.date_format(day, "yyyyMMddHHmmss"), F.lit("-"), F.substring(F.sha1(joined.cast("binary")), 1, 8))
