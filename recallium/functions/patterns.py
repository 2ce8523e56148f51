"""Rules on texts: fixed patterns and the expressions built from them.

Word boundaries of the source rules are ASCII. Java's are not, so b() writes them as look-arounds for Spark, while the
same patterns keep their short form for engines whose boundaries are ASCII."""

from __future__ import annotations

import functools
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The rules' patterns, in their order.
DENIAL = ["i don'?t have (any )?(information|data|memory|record)", "i'?m not sure about", "i don'?t recall", "i don'?t remember", "it looks like i don'?t", "i wasn'?t able to find", "no (relevant )?memories found", "i don'?t have access to"]
META_QUESTION = [
    r"\bdo you (remember|recall|know about)\b", r"\bcan you (remember|recall)\b", r"\bdid i (tell|mention|say|share)\b", r"\bhave i (told|mentioned|said)\b", r"\bwhat did i (tell|say|mention)\b",
    "如果你知道.+只回复", r"如果不知道.+只回复\s*none", "只回复精确代号", r"只回复\s*none", "你还?记得", "记不记得", "还记得.*吗", "你[知晓]道.+吗", r"我(?:之前|上次|以前)(?:说|提|讲).*(?:吗|呢|？|\?)",
]
BOILERPLATE = ["^(hi|hello|hey|good morning|good evening|greetings)", "^fresh session", "^new session", "^HEARTBEAT"]
DIAGNOSTIC = [r"\bquery\s*->\s*(none|no explicit solution|unknown|not found)\b", r"\buser asked for\b.*\b(none|no explicit solution|unknown|not found)\b", r"\bno explicit solution\b"]
PLATFORM = [r"model\s+(?:switched|changed)\s+to", r"(?:exec\s+(?:completed|failed|started)|starting\s+channels|dispatching\s+to\s+agent)"]
ENVELOPE = [
    r"^<<<EXTERNAL_UNTRUSTED_CONTENT\b", r"^<<<END_EXTERNAL_UNTRUSTED_CONTENT\b", r"^Sender\s*\(untrusted metadata\):", r"^Conversation info\s*\(untrusted metadata\):",
    r"^Thread starter\s*\(untrusted, for context\):", r"^Forwarded message context\s*\(untrusted metadata\):", r"^\[Queued messages while agent was busy\]", r"^System:\s*\[[\d\-: +GMT]+\]",
]
SKIP = [
    r"^(hi|hello|hey|good\s*(morning|afternoon|evening|night)|greetings|yo|sup|howdy|what'?s up)\b", "^/", r"^(run|build|test|ls|cd|git|npm|pip|docker|curl|cat|grep|find|make|sudo)\b",
    r"^(yes|no|yep|nope|ok|okay|sure|fine|thanks|thank you|thx|ty|got it|understood|cool|nice|great|good|perfect|awesome|👍|👎|✅|❌)\s*[.!]?$",
    r"^(go ahead|continue|proceed|do it|start|begin|next|实施|實施|开始|開始|继续|繼續|好的|可以|行)\s*[.!]?$", r"^[0-9#*\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}\s]+$", "HEARTBEAT", r"^\[System", r"^(ping|pong|test|debug)\s*[.!?]?$",
]
FORCE = [
    r"\b(remember|recall|forgot|memory|memories)\b", r"\b(last time|before|previously|earlier|yesterday|ago)\b", r"\b(my (name|email|phone|address|birthday|preference))\b",
    r"\b(what did (i|we)|did i (tell|say|mention))\b", "(你记得|[你妳]記得|之前|上次|以前|还记得|還記得|提到过|提到過|说过|說過)",
]
CJK = r"[\x{4e00}-\x{9fff}\x{3040}-\x{309f}\x{30a0}-\x{30ff}\x{ac00}-\x{d7af}]"
TRIGGERS = [
    "zapamatuj si|pamatuj|remember", "preferuji|radši|nechci|prefer", "rozhodli jsme|budeme používat", r"\b(we|i|you)\s+(decided|switch(ed)?|migrate(d)?|will use)\b", r"\bwe'?ll use\b|\bwe will use\b",
    r"\b(going forward|from now on)\b", r"\+\d{10,}", r"[\w.-]+@[\w.-]+\.\w+", r"můj\s+\w+\s+je|je\s+můj", r"my\s+\w+\s+is|is\s+my", "i (like|prefer|hate|love|want|need|care)", "always|never|important",
    "记住|记一下|别忘了|备注", "偏好|喜好|喜欢|讨厌|不喜欢|爱用|习惯", "决定|选择了|改用|换成|以后用", r"我的\S+是|叫我|称呼", "老是|总是|从不|一直|每次都", "重要|关键|注意|千万别",
]
EXCLUDE = [
    r"\b(memory-pro|memory_store|memory_recall|memory_forget|memory_update)\b", r"\b(delete|remove|forget|purge|cleanup|clean up|clear)\b.*\b(memory|memories|entry|entries)\b",
    r"\b(memory|memories)\b.*\b(delete|remove|forget|purge|cleanup|clean up|clear)\b", r"\bhow do i\b.*\b(delete|remove|forget|purge|cleanup|clear)\b", "(删除|刪除|清理|清除).{0,12}(记忆|記憶|memory)",
]
INTENTS = [
    ("preference", "l0", [r"\b(prefer|preference|style|convention|like|dislike|favorite|habit)\b", r"\b(how do (i|we) usually|what('s| is) (my|our) (style|convention|approach))\b", "(偏好|喜欢|习惯|风格|惯例|常用|不喜欢|不要用|别用)"]),
    ("decision", "l1", [r"\b(why did (we|i)|decision|decided|chose|rationale|trade-?off|reason for)\b", r"\b(what was the (reason|rationale|decision))\b", "(为什么选|决定|选择了|取舍|权衡|原因是|当时决定)"]),
    ("entity", "l1", [r"\b(who is|who are|tell me about|info on|details about|contact info)\b", r"\b(who('s| is) (the|our|my)|what team|which (person|team))\b", "(谁是|告诉我关于|详情|联系方式|哪个团队)"]),
    ("event", "full", [r"\b(when did|what happened|timeline|incident|outage|deploy|release|shipped)\b", r"\b(last (week|month|time|sprint)|recently|yesterday|today)\b", "(什么时候|发生了什么|时间线|事件|上线|部署|发布|上次|最近)"]),
    ("fact", "l1", [r"\b(how (does|do|to)|what (does|do|is)|explain|documentation|spec)\b", r"\b(config|configuration|setup|install|architecture|api|endpoint)\b", "(怎么|如何|是什么|解释|文档|规范|配置|安装|架构|接口)"]),
]
CATEGORIES = [
    ("preference", "prefer|radši|like|love|hate|want|偏好|喜歡|喜欢|討厭|讨厌|不喜歡|不喜欢|愛用|爱用|習慣|习惯"),
    ("decision", r"rozhodli|decided|we decided|will use|we will use|we'?ll use|switch(ed)? to|migrate(d)? to|going forward|from now on|budeme|決定|决定|選擇了|选择了|改用|換成|换成"),
    ("entity", r"\+\d{10,}|@[\w.-]+\.\w+|is called|jmenuje se|我的\S+是|叫我|稱呼|称呼"),
    ("fact", r"\b(is|are|has|have|je|má|jsou)\b|總是|总是|從不|从不|一直|每次都|老是"),
]
EXPIRY_HOURS = [("后天|day after tomorrow", 48), (r"明天|\btomorrow\b", 24), (r"下周|\bnext week\b", 168), (r"这周|\bthis week\b", 72), (r"下个月|\bnext month\b", 720), (r"这个月|\bthis month\b", 360), (r"今晚|\btonight\b", 12), (r"今天|\btoday\b", 18)]
ERROR_SIGNALS = [r"\[error\]|error:|exception:|fatal:|traceback|syntaxerror|typeerror|referenceerror|npm err!", "command not found|no such file|permission denied|non-zero|exit code", r"\"status\"\s*:\s*\"error\"|\"status\"\s*:\s*\"failed\"|\biserror\b", r"错误\s*[：:]|异常\s*[：:]|报错\s*[：:]|失败\s*[：:]"]
# Pattern and replacement; the groups of a replacement stand for what the pattern only looks at.
SECRETS = [
    (r"Bearer\s+[A-Za-z0-9\-._~+/]+=*", "Bearer [REDACTED]"), (r"\bsk-[A-Za-z0-9]{20,}\b", "[REDACTED]"), (r"\bsk-proj-[A-Za-z0-9\-_]{20,}\b", "[REDACTED]"), (r"\bsk-ant-[A-Za-z0-9\-_]{20,}\b", "[REDACTED]"),
    (r"\bghp_[A-Za-z0-9]{36,}\b", "[REDACTED]"), (r"\bgho_[A-Za-z0-9]{36,}\b", "[REDACTED]"), (r"\bghu_[A-Za-z0-9]{36,}\b", "[REDACTED]"), (r"\bghs_[A-Za-z0-9]{36,}\b", "[REDACTED]"), (r"\bgithub_pat_[A-Za-z0-9_]{22,}\b", "[REDACTED]"),
    (r"\bxox[baprs]-[A-Za-z0-9-]{10,}\b", "[REDACTED]"), (r"\bAIza[0-9A-Za-z_-]{20,}\b", "[REDACTED]"), (r"\bAKIA[0-9A-Z]{16}\b", "[REDACTED]"), (r"\bnpm_[A-Za-z0-9]{36,}\b", "[REDACTED]"),
    (r"(?i)\b(?:token|api[_-]?key|secret|password)\s*[:=]\s*[\"']?[^\s\"',;)}\]]{6,}[\"']?\b", "[REDACTED]"),
    (r"-----BEGIN\s+(?:RSA\s+|EC\s+|DSA\s+|OPENSSH\s+)?PRIVATE\s+KEY-----[\s\S]*?-----END\s+(?:RSA\s+|EC\s+|DSA\s+|OPENSSH\s+)?PRIVATE\s+KEY-----", "[REDACTED]"),
    (r"(://)[^@\s]+:[^@\s]+(@)", "$1[REDACTED]$2"), (r"/home/[^\s\"',;)}\]]+", "[REDACTED]"), (r"/Users/[^\s\"',;)}\]]+", "[REDACTED]"), (r"[A-Z]:\\[^\s\"',;)}\]]+", "[REDACTED]"),
    (r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}", "[REDACTED]"),
]
SYNONYMS = [
    (["挂了", "挂掉", "宕机"], ["shutdown", "crashed"], ["崩溃", "crash", "error", "报错", "宕机", "失败"]), (["卡住", "卡死", "没反应"], ["hung", "frozen"], ["hang", "timeout", "超时", "无响应", "stuck"]),
    (["炸了", "爆了"], ["oom"], ["崩溃", "crash", "OOM", "内存溢出", "error"]), (["配置", "设置"], ["config", "configuration"], ["配置", "config", "configuration", "settings", "设置"]),
    (["部署", "上线"], ["deploy", "deployment"], ["deploy", "部署", "上线", "发布", "release"]), (["容器"], ["docker", "container"], ["Docker", "容器", "container", "docker-compose"]),
    (["报错", "出错", "错误"], ["error", "exception"], ["error", "报错", "exception", "错误", "失败", "bug"]), (["修复", "修了", "修好"], ["bugfix", "hotfix"], ["fix", "修复", "patch", "解决"]),
    (["踩坑"], ["troubleshoot"], ["踩坑", "bug", "问题", "教训", "排查", "troubleshoot"]), (["记忆", "记忆系统"], ["memory"], ["记忆", "memory", "记忆系统", "LanceDB", "索引"]), (["搜索", "查找", "找不到"], ["search", "retrieval"], ["搜索", "search", "retrieval", "检索", "查找"]),
    (["推送"], ["git push"], ["push", "推送", "git push", "commit"]), (["日志"], ["logfile", "logging"], ["日志", "log", "logging", "输出", "打印"]), (["权限"], ["permission", "authorization"], ["权限", "permission", "access", "授权", "认证"]),
]
MAX_EXPANSIONS = 5


def b(pattern: str) -> str:
    """ASCII word boundaries for Java's engine."""
    return pattern.replace(r"\b", r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))")


@functools.cache
def needed(pattern: str) -> frozenset[str] | None:
    """Lower-case strings of which a match holds at least one; None where none can be told."""
    try:
        tree = re._parser.parse(pattern)
    except re.error:
        return None

    def strength(found: frozenset[str]) -> int:
        return min(map(len, found))

    def of(items) -> frozenset[str] | None:
        best, run = None, ""

        def offer(found):
            nonlocal best
            if found and (best is None or strength(found) > strength(best)):
                best = found

        for op, arg in [*items, (None, None)]:
            if op is re._constants.LITERAL:
                run += chr(arg).lower()
                continue
            if run:
                offer(frozenset([run]))
                run = ""
            if op is re._constants.SUBPATTERN:
                offer(of(arg[3]))
            elif op is re._constants.BRANCH:
                each = [of(x) for x in arg[1]]
                if all(each):
                    offer(frozenset().union(*each))
            elif op in (re._constants.MAX_REPEAT, re._constants.MIN_REPEAT) and arg[0] >= 1:
                offer(of(arg[2]))
        return best

    found = of(tree)
    return found if found and (strength(found) >= 2 or not any(x.isalnum() for x in found)) else None


def gated(text: Column, lower: Column, pattern: str, flags: str) -> Column:
    """The pattern's search behind a search for the strings it needs, which is far cheaper; anchored patterns fail fast anyway."""
    hit, strings = text.rlike(flags + b(pattern)), None if pattern.startswith("^") else needed(pattern)
    return hit if strings is None else functools.reduce(lambda x, y: x | y, (F.contains(lower, F.lit(x)) for x in sorted(strings))) & hit


def any_of(text: Column, patterns: list[str], flags: str = "(?i)") -> Column:
    """Whether one of the patterns is found."""
    lower = F.lower(text)
    return F.coalesce(functools.reduce(lambda x, y: x | y, (gated(text, lower, p, flags) for p in patterns)), F.lit(False) & text.isNotNull())


def any_sql(text: str, patterns: list[str], flags: str = "(?i)") -> str:
    return f"regexp_matches({text}, '{flags}" + "|".join(f"(?:{p})" for p in patterns).replace("'", "''") + "')"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def is_noise(text: Column) -> Column:
    t = strip(text)
    return (F.length(t) < 5) | any_of(t, DENIAL + META_QUESTION + BOILERPLATE + DIAGNOSTIC + PLATFORM)


def should_skip(text: Column) -> Column:
    t = strip(F.regexp_replace(strip(text), r"(?i)^\[cron:[^\]]+\]\s*", ""))
    short = (F.length(t) < F.when(t.rlike(CJK), 6).otherwise(15)) & ~t.rlike("[?？]")
    return F.when(any_of(t, FORCE), False).when(F.length(t) < 5, True).when(any_of(t, SKIP), True).otherwise(short)


def should_capture(text: Column) -> Column:
    t = strip(text)
    least = F.when(t.rlike(CJK), 4).otherwise(10)
    rejected = (F.length(t) < least) | (F.length(t) > 500) | F.contains(t, F.lit("<relevant-memories>")) | (t.startswith("<") & F.contains(t, F.lit("</")))
    rejected = rejected | (F.contains(t, F.lit("**")) & F.contains(t, F.lit("\n-"))) | (F.regexp_count(t, F.lit(r"[\x{1F300}-\x{1F9FF}]")) > 3)
    return ~rejected & ~any_of(t, EXCLUDE) & any_of(t, TRIGGERS)


def first_of(text: Column, rules: list[tuple], default) -> Column:
    """The value of the first rule (value, patterns) that is found."""
    out = None
    for value, patterns in rules:
        hit = any_of(text, [patterns] if isinstance(patterns, str) else patterns)
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out.otherwise(default)


def first_sql(text: str, rules: list[tuple], default: str) -> str:
    cases = " ".join(f"WHEN {any_sql(text, [p] if isinstance(p, str) else p)} THEN {repr(v)}" for v, p in rules)
    return f"CASE {cases} ELSE {default} END"


def redact(text: Column) -> Column:
    """Texts without any string that a pattern needs, nearly all, are not looked at by any pattern."""
    lower, out = F.lower(text), text
    has = lambda p: functools.reduce(lambda x, y: x | y, (F.contains(lower, F.lit(x)) for x in sorted(needed(p) or [""])))
    for p, r in SECRETS:
        out = F.regexp_replace(out, b(p), r)
    return F.when(functools.reduce(lambda x, y: x | y, (has(p) for p, _ in SECRETS)), out).otherwise(text)


def redact_sql(text: str) -> str:
    for p, r in SECRETS:
        to = r.replace("$", chr(92))
        text = f"regexp_replace({text}, '{p.replace(chr(39), chr(39) * 2)}', '{to}', 'g')"
    return text


def error_signature(text: Column) -> Column:
    t = F.lower(redact(text))
    for p, r in ((r"[a-z]:\\[^ \n\r\t]+", "<path>"), (r"/[^ \n\r\t]+", "<path>"), (r"\b0x[0-9a-f]+\b", "<hex>"), (r"\b\d+\b", "<n>"), (r"\s+", " ")):
        t = F.regexp_replace(t, b(p), r)
    return F.substring(F.trim(t), 1, 240)


def fact_key(category: Column, text: Column) -> Column:
    """category:topic, where the topic stands before a colon or an arrow."""
    t = strip(text)
    colon, arrow = F.regexp_extract(t, "^(.{1,120}?)[：:]", 1), F.regexp_extract(t, r"^(.{1,120}?)(?:\s*->|\s*=>)", 1)
    topic = F.when(colon != "", colon).when(arrow != "", arrow).otherwise(t)
    topic = F.trim(F.regexp_replace(F.regexp_replace(F.lower(topic), r"\s+", " "), r"[。.!?]+$", ""))
    return F.when(topic != "", F.concat(category, F.lit(":"), topic))
