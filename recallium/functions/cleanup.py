"""Cleaning of captured messages and of model answers: rules that go line by line or character by character, in Python, applied in
Arrow batches. Whatever needs no state is an expression in rules.py."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Wrapper lines, phrases that come with them, headings of metadata blocks, and the notice of a new session.
WRAPPER = re.compile(r"\[(?:Subagent Context|Subagent Task)\]", re.I)
PHRASE = re.compile(r"(?:Results auto-announce to your requester\.?|do not busy-poll for status\.?|Reply with a brief acknowledgment only\.?|Do not use any memory tools\.?)", re.I)
LEADING_PHRASES = re.compile(r"(?:You are running as a subagent\b.*?(?:(?<=\.)\s+|$)|Results auto-announce to your requester\.?\s*|do not busy-poll for status\.?\s*|Reply with a brief acknowledgment only\.?\s*|Do not use any memory tools\.?\s*)+", re.I)
ANY_PHRASE = re.compile(r"(?:You are running as a subagent\b.*?(?:$|(?<=\.)\s+)|Results auto-announce to your requester\.?\s*|do not busy-poll for status\.?\s*|Reply with a brief acknowledgment only\.?\s*|Do not use any memory tools\.?\s*)", re.I)
SUBAGENT = re.compile(r"You are running as a subagent\b", re.I)
SYSTEM_LINE = re.compile(r"^System:\s*\[[^\]]*\]\s*.*$", re.M)
LABELLED_JSON = re.compile(r"(?:Conversation info|Sender|Replied message)\s*\(untrusted[^)]*\):\s*```json\s*\{[\s\S]*?\}\s*```")
ENVELOPE_JSON = re.compile(r'```json\s*(?=\{[\s\S]*?"message_id"\s*:)(?=\{[\s\S]*?"sender_id"\s*:)\{[\s\S]*?\}\s*```')
HEADINGS = [
    "Conversation info (untrusted metadata):", "Sender (untrusted metadata):", "Thread starter (untrusted, for context):", "Replied message (untrusted, for context):",
    "Forwarded message context (untrusted metadata):", "Chat history since last reply (untrusted, for context):",
]
NEW_SESSION = "A new session was started via /new or /reset. Execute your Session Startup sequence now"
SYSTEM_EVENT = re.compile(r"^System:\s*\[[^\n]*?\]\s*.*$", re.M | re.I)
HEADED_BLOCK = re.compile(r"(?:^|\n)\s*(?:" + "|".join(map(re.escape, HEADINGS)) + r")\s*\n```json[\s\S]*?\n```\s*")
BARE_JSON = re.compile(r'\{[\s\S]*?"(?:chat_id|message_id|sender_id|open_chat_id)"[\s\S]*?\}')
MESSAGE_ID = re.compile(r"\b(?:ou_|msg_|om_)[a-zA-Z0-9]+\b", re.A)
ADDRESSEE = re.compile(r"(?:<@!?[0-9]+>|@[A-Za-z0-9_.-]+)\s*")
MEMORY_BLOCK, UNTRUSTED_BLOCK = re.compile(r"<relevant-memories>\s*[\s\S]*?</relevant-memories>\s*", re.I), re.compile(r"\[UNTRUSTED DATA[^\n]*\][\s\S]*?\[END UNTRUSTED DATA\]\s*", re.I)
PASSES = 6


def _few_blank_lines(text: str) -> str:
    return re.sub(r"\n{3,}", "\n\n", text)


def strip_envelope(text: str) -> str:
    """What a person wrote: wrapper lines, and phrases that follow them, go from the lead-in; log lines and metadata blocks from everywhere."""
    lines, out, wrapped = text.split("\n"), [], False
    for i, line in enumerate(lines):
        bare = line.strip()
        if WRAPPER.match(bare):
            wrapped = True
            rest = WRAPPER.sub("", bare, count=1).strip()
            out.append(re.sub(r"\s{2,}", " ", rest[m.end() :] if (m := LEADING_PHRASES.match(rest)) else rest).strip())
        elif not bare:
            out.append("")
        elif PHRASE.fullmatch(bare):
            out.append("" if wrapped else line)
        elif not (wrapped and SUBAGENT.match(bare)):
            out += lines[i:]  # the lead-in ends here
            break
    whole = "\n".join(out)
    for pattern in (SYSTEM_LINE, LABELLED_JSON, ENVELOPE_JSON):
        whole = pattern.sub("", whole)
    return _few_blank_lines(whole).strip()


def _without_metadata(text: str) -> str:
    for _ in range(PASSES):  # what one pass uncovers the next takes
        after = text
        for pattern in (SYSTEM_EVENT, HEADED_BLOCK, BARE_JSON):
            after = pattern.sub("\n", after)
        after = _few_blank_lines(MESSAGE_ID.sub("", after)).strip()
        if after == text.strip():
            return after
        text = after
    return text


def _without_notice(text: str) -> str:
    if not text.startswith(NEW_SESSION):
        return text
    _, blank, rest = text.partition("\n\n")
    return rest.strip() if blank else "\n".join(text.split("\n")[2:]).strip()


def _without_wrappers(text: str) -> str:
    lines = text.strip().split("\n")
    for i, line in enumerate(lines):
        bare = line.strip()
        if bare and not WRAPPER.match(bare):
            return "\n".join(lines[i:]).strip()
        said = re.sub(r"\s{2,}", " ", ANY_PHRASE.sub("", WRAPPER.sub("", bare, count=1).strip())).strip()
        if said:
            return "\n".join([said, *lines[i + 1 :]]).strip()
    return ""


def captured(role: str | None, text: str | None) -> str | None:
    """A message as it is captured; null if nothing is left of it."""
    if role is None or text is None:
        return None
    t = text.strip()
    if role in ("user", "assistant"):
        t = _without_metadata(_without_notice(UNTRUSTED_BLOCK.sub("", MEMORY_BLOCK.sub("", t)).strip()))
        t = ADDRESSEE.sub("", t, count=1).strip() if ADDRESSEE.match(t) else t
        t = _few_blank_lines(_without_metadata(_without_wrappers(t))).strip()
    return t or None


def json_in(answer: str) -> str | None:
    """The JSON of a model's answer: a fenced block, else the first balanced object."""
    fence = re.search(r"```(?:json)?\s*\n?([\s\S]*?)```", answer)
    if fence:
        return fence[1].strip()
    start, depth = answer.find("{"), 0
    for m in re.finditer(r"[{}]", answer[start:]) if start >= 0 else ():
        depth += 1 if m[0] == "{" else -1
        if not depth:
            return answer[start : start + m.end()]
    return None


_CONTROL = {"\n": "\\n", "\r": "\\r", "\t": "\\t"}
_PART = re.compile(r'"(?P<after>\s*(?P<next>.)?)|\\.|[\n\r\t]|,(?=\s*[}\]])', re.S)


def repaired_json(text: str) -> str:
    """With quotes inside strings escaped, line ends and tabs in strings written out, commas before a closing bracket gone."""
    out, at, inside = [], 0, False
    for m in iter(lambda: _PART.search(text, at), None):
        out.append(text[at : m.start()])
        found = m[0][0]
        at = m.start() + (2 if found == "\\" else 1)
        if found == '"':
            ends = inside and (m["next"] is None or m["next"] in ",}]:")
            out.append('"' if ends or not inside else '\\"')
            inside = not ends
        elif found == "\\":
            out.append(m[0])
        elif found == ",":
            out.append("," if inside else "")
        else:
            out.append(_CONTROL[found] if inside else found)
    return "".join(out) + text[at:]


def answer_json(answer: str | None) -> str | None:
    """Compact JSON of the object in a model's answer, repaired if need be; null where there is none."""
    found = json_in(answer) if answer else None
    for text in (found, repaired_json(found)) if found else ():
        try:
            value = json.loads(text, strict=True)
        except ValueError:
            continue
        return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":")) if isinstance(value, dict) else None
    return None


# Where providers put their results, and the name of the score, most likely first.
RERANKERS = {
    "tei": ([(), ("results",), ("data",)], ["score", "relevance_score"]), "dashscope": ([("output", "results"), ("results",)], ["relevance_score", "score"]), "pinecone": ([("data",), ("results",)], ["score", "relevance_score"]),
    "voyage": ([("data",), ("results",)], ["relevance_score", "score"]), "jina": ([("results",), ("data",)], ["relevance_score", "score"]), "siliconflow": ([("results",), ("data",)], ["relevance_score", "score"]),
}


def rerank_request(provider: str, model: str, query: str, texts: list[str], top: int) -> dict:
    """The body that a provider expects."""
    if provider == "tei":
        return {"query": query, "texts": texts}
    if provider == "dashscope":
        return {"model": model, "input": {"query": query, "documents": texts}}
    documents = [{"text": t} for t in texts] if provider == "pinecone" else texts
    return {"model": model, "query": query, "documents": documents, ("top_k" if provider == "voyage" else "top_n"): top}


def rerank_items(provider: str, answer) -> list[tuple[int, float]] | None:
    """(index, score) of a provider's answer; null where nothing can be read."""
    places, names = RERANKERS.get(provider, RERANKERS["jina"])
    if provider == "dashscope" and isinstance(answer, dict) and answer.get("output"):
        places = places[:1]

    def number(x) -> float | None:
        try:
            n = float(x)
        except (TypeError, ValueError):
            return None
        return n if abs(n) != float("inf") and n == n else None

    for path in places:
        found = answer
        for key in path:
            found = found.get(key) if isinstance(found, dict) else None
        items = []
        for x in found if isinstance(found, list) else ():
            score = next((n for n in map(number, (x.get(k) for k in names)) if n is not None), None) if isinstance(x, dict) else None
            if score is not None and number(x.get("index")) is not None:
                items.append((int(number(x["index"])), score))
        if items:
            return items
    return None


def _column(f, *columns: Column) -> Column:
    @F.pandas_udf("string")
    def run(*series: pd.Series) -> pd.Series:
        return pd.Series([f(*x) for x in zip(*series, strict=True)], dtype=object)

    return run(*columns)


def envelope_stripped(text: Column) -> Column:
    return _column(lambda t: None if t is None else strip_envelope(t), text)


def captured_text(role: Column, text: Column) -> Column:
    return _column(captured, role, text)


def json_answer(text: Column) -> Column:
    return _column(answer_json, text)
