"""Rules on texts that give labels, values or cleaned texts, as expressions; each has its SQL beside it."""

from __future__ import annotations

import functools

from pyspark.sql import Column
from pyspark.sql import functions as F

from recallium.functions import patterns as P

# Signs of what holds for a while and of what lasts.
DYNAMIC = [
    r"\btoday\b", r"\byesterday\b", r"\btomorrow\b", r"\brecently\b", r"\bcurrently\b", r"\bright now\b", r"\bthis week\b", r"\bthis month\b", r"\blast week\b", r"\bnext week\b", r"\bthis morning\b", r"\btonight\b", r"\blater\b",
    "今天", "昨天", "明天", "最近", "正在", "刚才", "刚刚", "这周", "这个月", "上周", "下周", "目前", "现在", "今晚", "今早", "稍后", "待会",
]
STATIC = [
    r"\bfavorite\b", r"\bprefer\b", r"\balways\b", r"\bname is\b", r"\bborn\b", r"\bgraduated\b", r"\blive in\b", r"\bwork at\b", r"\bjob\b", r"\bprofession\b", r"\bhobby\b", r"\ballergic\b",
    "喜欢", "偏好", "一直", "名字", "叫做", "出生", "毕业", "住在", "工作", "职业", "爱好", "过敏",
]
# Who somebody is and how to address them; group 1 is the value.
_WORD = "[^\\s，。,.!！?？\"'“”‘’「」『』]"
NAME = [rf"(?:我的名字是|我(?:现在)?叫|本名是)\s*({_WORD}+)", r"calls?\s+themselves\s+['\"]([^'\"]+)['\"]", "name\\s+is\\s+['\"]?([^'\".,\\n]+)['\"]?"]
ADDRESS = [
    rf"(?:以后你叫我|以后请叫我|请叫我|以后称呼我(?:为)?|称呼我(?:为)?|称呼其为|称呼他为)\s*({_WORD}+)", rf"(?:希望(?:在[^\n。]{{0,20}})?(?:以后)?(?:你)?(?:被)?称呼(?:我|其|他)?为)\s*({_WORD}+)",
    "(?:被称呼为|称呼偏好(?:是)?|Preferred address(?: is)?|be addressed as|addressed as)\\s*['\"]?([^'\".,\\n]+)['\"]?", "(?:addressive identifier is|preferred (?:and permanently assigned )?addressive identifier is)\\s*['\"]?([^'\".,\\n]+)['\"]?",
]
NAME_HINTS = ["^姓名[:：]", "^## Identity$", r"(?:^|\n)-\s*Name:\s+", "用户当前姓名/自称为"]
ADDRESS_HINTS = ["^称呼偏好[:：]", "^## Addressing$", "Preferred form of address", "被称呼为", "addressive identifier"]
PROFILE_HINTS = ["^User profile:", r"^##\s*(?:Background|Profile|Context)$", r"(?:^|\n)-\s*(?:Timezone|Pronouns?|Role|Language|Working style|Collaboration style)\s*:", r"(?:我的时区是|我的代词是|我是|我的身份是|my timezone is|my pronouns are|i am)\b", "(?:时区|代词|协作方式|工作方式|语言偏好)"]
PERSONAL = [r"\b(my |i am |i'm |name is |叫我|我的|我是)\b"]
# Lines that must not be put before a model, and lines that say nothing.
UNSAFE = [
    r"^\s*(?:(?:next|this)\s+run\s+)?(?:ignore|disregard|forget|override|bypass)\b[\s\S]{0,80}\b(?:instructions?|guardrails?|policy|developer|system)\b",
    r"\b(?:reveal|print|dump|show|output)\b[\s\S]{0,80}\b(?:system prompt|developer prompt|hidden prompt|hidden instructions?|full prompt|prompt verbatim|secrets?|keys?|tokens?)\b",
    r"<\s*/?\s*(?:system|assistant|user|tool|developer|inherited-rules|derived-focus)\b[^>]*>", r"^(?:system|assistant|user|developer|tool)\s*:",
]
PLACEHOLDERS = [r"^\(none( captured)?\)$", "^(invariants?|reflections?|derived)[:：]$", "apply this session'?s deltas next run", "apply this session'?s distilled changes next run", "investigate why embedded reflection generation failed"]
LINE_PREFIX = r"^(invariants?|reflections?|derived)[:：]\s*"
# A liking for things of a brand; how lists of things are divided and where they end.
LIKES = [
    (r"(?:^|[\s，,。；;！!？?])(?:我|用户)?(?:很|更|还)?(?:喜欢|爱吃|偏爱|常吃|想吃)(?:吃|喝|用|买)?([\p{Han}A-Za-z0-9&·'\-]{1,24})的([\p{Han}A-Za-z0-9&·'\-\s、,，和及与/]{1,80})", 1, 2),
    (r"\b(?:i|user)?\s*(?:really\s+|still\s+|also\s+)?(?:like|love|prefer|enjoy)\s+([a-z0-9'&\-\s]{1,80})\s+from\s+([a-z0-9'&\-\s]{1,40})", 2, 1),
]
DIVIDERS, CLAUSE_ENDS = "(?:、|,|，|/|以及|及|与|和| and | & )", "(?:因为|所以|但是|不过|if |when |because |but )"
# Transcript noise.
NOISE_PREFIXES = ["✅ New session started", "NO_REPLY"]
TRANSCRIPT_BOILERPLATE = ["[queued messages while agent was busy]", "you are running a boot check", "boot.md — gateway startup health check", "read heartbeat.md", "[claude_code_done]", "claude_code_done"]
INJECTED = ["<relevant-memories>", "UNTRUSTED DATA", "END UNTRUSTED DATA"]


def java(pattern: str) -> str:
    """The pattern for Java's engine: ASCII word boundaries, script names."""
    return P.b(pattern).replace(r"\p{Han}", r"\p{IsHan}")


def quoted(s: str) -> str:
    return s.replace("'", "''")


def temporal(text: Column) -> Column:
    """What holds for a while wins over what lasts; neither counts as lasting."""
    return F.when(P.any_of(text, DYNAMIC), "dynamic").otherwise("static")


TEMPORAL_SQL = f"CASE WHEN {P.any_sql('text', DYNAMIC)} THEN 'dynamic' ELSE 'static' END"
_LEAD, _TRAIL = "^[\\s\"'“”‘’「」『』*`_]+", "[\\s\"'“”‘’「」『』*`_。！，、,.!?:：；;]+$"


def first_value(text: Column, patterns: list[str]) -> Column:
    """Group 1 of the first pattern whose value is not empty once quotes and punctuation around it are gone; else the empty text."""
    trimmed = [F.regexp_replace(F.regexp_replace(F.regexp_extract(text, "(?i)" + java(p), 1), _LEAD, ""), _TRAIL, "") for p in patterns]
    return F.coalesce(*(F.nullif(x, F.lit("")) for x in trimmed), F.lit(""))


def first_value_sql(text: str, patterns: list[str]) -> str:
    each = [f"nullif(regexp_replace(regexp_replace(regexp_extract({text}, '(?i){quoted(p)}', 1), '{quoted(_LEAD)}', ''), '{quoted(_TRAIL)}', ''), '')" for p in patterns]
    return f"coalesce({', '.join(each)}, '')"


def like(text: Column) -> Column:
    """A struct of brand and items (normalised), null where no liking of that kind is found."""
    t = P.strip(F.regexp_replace(F.regexp_replace(text, r"(?m)^\[(用户|助手)\]\s*", ""), r"\s+", " "))
    found = []
    for p, brand, items in LIKES:
        raw = F.regexp_extract(t, "(?i)" + java(p), items)
        parts = F.filter(F.transform(F.split(F.element_at(F.split(raw, "(?i)" + CLAUSE_ENDS), 1), "(?i)" + DIVIDERS), token), lambda x: x != "")
        b = token(F.regexp_extract(t, "(?i)" + java(p), brand))
        found.append(F.when((b != "") & (F.size(parts) > 0), F.struct(b.alias("brand"), parts.alias("items"))))
    return F.coalesce(*found)


def token(x: Column) -> Column:
    """Without quotes and punctuation around it, articles and white space; lower case."""
    bare = F.regexp_replace(P.strip(F.regexp_replace(x, r"\s+", " ")), "^[“\"'`‘’]+|[”\"'`‘’。！!？?，,；;:：]+$", "")
    return F.lower(F.regexp_replace(F.regexp_replace(bare, java(r"(?i)\b(?:the|a|an)\s+"), ""), r"\s+", ""))


def token_sql(x: str) -> str:
    bare = f"regexp_replace(trim(regexp_replace({x}, '\\s+', ' ', 'g')), '{quoted(chr(94) + '[“' + chr(34) + chr(39) + '`‘’]+|[”' + chr(34) + chr(39) + '`‘’。！!？?，,；;:：]+$')}', '', 'g')"
    return f"lower(regexp_replace(regexp_replace({bare}, '(?i)\\b(?:the|a|an)\\s+', '', 'g'), '\\s+', '', 'g'))"


def clean_line(line: Column) -> Column:
    return P.strip(F.regexp_replace(F.regexp_replace(line, r"\*\*", ""), "(?i)" + LINE_PREFIX, ""))


def is_unsafe(line: Column) -> Column:
    """Lines that try to instruct a model, and empty ones."""
    t = clean_line(line)
    return (t == "") | functools.reduce(lambda x, y: x | y, (t.rlike("(?i)" + java(p)) for p in UNSAFE))


def is_placeholder(line: Column) -> Column:
    t = P.strip(F.regexp_replace(line, r"\*\*", ""))
    return (t == "") | P.any_of(t, PLACEHOLDERS)


def for_context(text: Column, most: int = 300) -> Column:
    """One line without markup."""
    t = F.regexp_replace(F.regexp_replace(text, r"[\r\n]+", r"\\n"), r"</?[a-zA-Z][^>]*>", "")
    return F.substring(P.strip(F.regexp_replace(F.translate(t, "<>", "＜＞"), r"\s+", " ")), 1, most)


def truncated(text: Column, most: int) -> Column:
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.regexp_replace(F.substring(text, 1, max(1, most - 1)), r"\s+$", ""), F.lit("…")))


def error_summary(text: Column, most: int = 220) -> Column:
    t = P.strip(F.regexp_replace(P.redact(text), r"\s+", " "))
    return F.when(t == "", "(empty tool error)").when(F.length(t) <= most, t).otherwise(F.concat(F.substring(t, 1, most - 3), F.lit("...")))


def legacy_category(category: Column, text: Column) -> Column:
    """The newer category of an older one; facts about a person are a profile."""
    personal = P.any_of(text, PERSONAL) & (F.length(text) < 200)
    return F.when(category == "preference", "preferences").when(category == "entity", "entities").when(category == "decision", "events").when((category == "fact") & personal, "profile").when(category == "fact", "cases").otherwise("patterns")


LEGACY_CATEGORY_SQL = f"CASE category WHEN 'preference' THEN 'preferences' WHEN 'entity' THEN 'entities' WHEN 'decision' THEN 'events' WHEN 'fact' THEN CASE WHEN {P.any_sql('text', PERSONAL)} AND length(text) < 200 THEN 'profile' ELSE 'cases' END ELSE 'patterns' END"


def transcript(text: Column) -> Column:
    """Without injected memories, headers and JSON blocks."""
    t = F.regexp_replace(P.strip(text), r"<relevant-memories>[\s\S]*?</relevant-memories>", "")
    t = F.regexp_replace(F.regexp_replace(t, r"(?i)^Conversation info \(untrusted metadata\):\s*\n+", ""), r"(?i)^Replied message \(untrusted, for context\):\s*\n+", "")
    return P.strip(F.regexp_replace(F.regexp_replace(t, r"```json[\s\S]*?```", ""), r"\n{3,}", "\n\n"))


def transcript_sql(text: str) -> str:
    strip = lambda x: f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"
    t = f"regexp_replace({strip(text)}, '<relevant-memories>[\\s\\S]*?</relevant-memories>', '', 'g')"
    t = f"regexp_replace(regexp_replace({t}, '(?i)^Conversation info \\(untrusted metadata\\):\\s*\\n+', ''), '(?i)^Replied message \\(untrusted, for context\\):\\s*\\n+', '')"
    return strip(f"regexp_replace(regexp_replace({t}, '```json[\\s\\S]*?```', '', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g')")


def is_transcript_noise(text: Column) -> Column:
    low = F.lower(text)
    said = [F.contains(low, F.lit(x)) for x in TRANSCRIPT_BOILERPLATE] + [text.startswith(x) for x in NOISE_PREFIXES]
    return (text == "") | text.startswith("/") | (F.length(text) > 2000) | (text.startswith("```") & text.endswith("```")) | functools.reduce(lambda x, y: x | y, said)


def transcript_noise_sql(text: str) -> str:
    said = [f"contains(lower({text}), '{quoted(x)}')" for x in TRANSCRIPT_BOILERPLATE] + [f"starts_with({text}, '{quoted(x)}')" for x in NOISE_PREFIXES]
    return f"({text} = '' OR starts_with({text}, '/') OR length({text}) > 2000 OR (starts_with({text}, '```') AND ends_with({text}, '```')) OR {' OR '.join(said)})"


def skips_message(role: Column, text: Column) -> Column:
    """Empty messages, commands, and user messages with injected blocks."""
    t = P.strip(text)
    return (t == "") | t.startswith("/") | ((role == "user") & functools.reduce(lambda x, y: x | y, (F.contains(t, F.lit(x)) for x in INJECTED)))


def agent_of_session(key: Column) -> Column:
    """The agent in a session key agent:<id>[:..]; null for other keys and reserved names."""
    found = F.trim(F.regexp_extract(F.trim(key), r"^agent:([^:]*)", 1))
    return F.when((found != "") & ~found.isin("system", "undefined"), found)


def scopes_of(value: str | None) -> list[str]:
    """A comma-separated setting as scope names."""
    return [x.strip() for x in (value or "").split(",") if x.strip()]


_TO_END, _TO_SPACE = r"(?s)^(.*?)(?:[.!?]\s|[。！？])", "(?s)^(.*) "


def brief(text: Column, most: int = 80) -> Column:
    """The first sentence if it is short enough, else the text, else its opening up to a blank that stands late enough."""
    end = F.length(F.regexp_extract(text, _TO_END, 1))
    opening = F.substring(text, 1, most)
    words = F.regexp_extract(opening, _TO_SPACE, 1)
    cut = F.concat(F.when(F.length(words) > most * 0.6, words).otherwise(opening), F.lit("..."))
    return F.when((end > 0) & (end < most), F.substring(text, F.lit(1), end + 1)).when(F.length(text) <= most, text).otherwise(cut)


def at_depth(text: Column, category: Column, scope: Column, depth: Column, score: Column) -> Column:
    """A line of recall: l0 brief, l1 up to 300 characters, else whole."""
    percent = F.concat(F.lit(" ("), F.round(score * 100).cast("int").cast("string"), F.lit("%)"))
    medium = F.when(F.length(text) > 300, F.concat(F.substring(text, 1, 297), F.lit("..."))).otherwise(text)
    placed = lambda t: F.concat(F.lit("- ["), category, F.lit(":"), scope, F.lit("] "), t, percent)
    return F.when(depth == "l0", F.concat(F.lit("- ["), category, F.lit("] "), brief(text), percent)).when(depth == "l1", placed(medium)).otherwise(placed(text))
