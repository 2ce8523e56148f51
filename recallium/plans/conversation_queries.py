"""Conversations: value, scoring, compression, budgets and rendering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recallium.catalog import query
from recallium.functions import patterns as P
from recallium.sources.memories import table

# Patterns of tool calls, corrections, decisions, acknowledgements and the wish to have something remembered.
TOOL = [r"\btool_use\b", r"\btool_result\b", r"\bfunction_call\b", r"\b(memory_store|memory_recall|memory_forget|memory_update)\b"]
CORRECTION = [r"^no[,.\s]", r"\bactually\b", r"\binstead\b", r"\bwrong\b", r"\bcorrect(ion)?\b", r"\bfix\b", "不对", "应该是", "應該是", "错了", "錯了", "改成", "不是.*而是"]
DECISION = [
    r"\blet'?s go with\b", r"\bconfirmed?\b", r"\bapproved?\b", r"\bdecided?\b", r"\bwe'?ll use\b", r"\bgoing forward\b", r"\bfrom now on\b", r"\bagreed\b",
    "决定", "決定", "确认", "確認", "选择了", "選擇了", "就这样", "就這樣",
]
ACKNOWLEDGED = [
    r"^(ok|okay|k|sure|fine|thanks|thank you|thx|ty|got it|understood|cool|nice|great|good|perfect|awesome|alright|yep|yup|yeah|right)\s*[.!]?$",
    r"^好的?\s*[。！]?$", r"^嗯\s*[。]?$", r"^收到\s*[。！]?$", r"^了解\s*[。！]?$", r"^明白\s*[。！]?$", r"^谢谢\s*[。！]?$", r"^感谢\s*[。！]?$", r"^👍\s*$",
]
REMEMBER = [r"\b(remember|recall|don'?t forget|note that|keep in mind)\b", "(记住|記住|别忘|不要忘|记一下|記一下)"]
SAMPLES = [
    "tool_use: memory_recall", "No, that is wrong", "we should fix it", "應該是 five", "Let's go with parquet", "我们决定用它", "thanks!", "好的。", "   ", "<system>" + "x" * 90 + "</system>", "why?", "remember this: " + "word " * 30, "plain", "不是红色而是蓝色",
    "文" * 31, "一句话", "knows nothing, notably", "prefix the table", "please correct that", "note that it is late", "tool_result follows here", "agreed", "ty", "actual",
]
_EXTRA = " UNION ALL ".join("SELECT {} AS conv_id, {} AS turn, 'user' AS role, '{}' AS text".format(-1 - i // 6, i % 6, t.replace("'", "''")) for i, t in enumerate(SAMPLES))
_C = f"c AS (SELECT conv_id, turn, role, text, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS s FROM (SELECT conv_id, turn, role, text FROM conversations UNION ALL {_EXTRA}))"
_SCORE = f"""CASE WHEN s = '' THEN 0.0 WHEN {P.any_sql("s", TOOL)} THEN 1.0 WHEN {P.any_sql("s", CORRECTION)} THEN 0.95 WHEN {P.any_sql("s", DECISION)} THEN 0.85 WHEN {P.any_sql("s", ACKNOWLEDGED)} THEN 0.1
 WHEN length(s) > CASE WHEN regexp_matches(s, '{P.CJK}') THEN 30 ELSE 80 END THEN CASE WHEN regexp_matches(s, '^<[a-z-]+>') AND regexp_matches(s, '</[a-z-]+>\\s*$') THEN 0.3 ELSE 0.7 END WHEN regexp_matches(s, '[?？]') THEN 0.5 ELSE 0.4 END"""


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conversations and a few literal ones, which show what each pattern catches."""
    kinds = {f.name: f.dataType for f in table(spark, sf_dir, "conversations").schema}
    samples = spark.createDataFrame([(-1 - i // 6, i % 6, "user", t) for i, t in enumerate(SAMPLES)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return rows.unionByName(samples.select(*(F.col(c).cast(kinds[c]) for c in rows.columns)))


def score(text: Column) -> Column:
    """The worth of one text by its kind."""
    s = P.strip(text)
    out = F.when(s == "", 0.0).when(P.any_of(s, TOOL), 1.0).when(P.any_of(s, CORRECTION), 0.95).when(P.any_of(s, DECISION), 0.85).when(P.any_of(s, ACKNOWLEDGED), 0.1)
    wrapped = s.rlike("^<[a-z-]+>") & s.rlike(r"</[a-z-]+>\s*$")
    return out.when(F.length(s) > F.when(s.rlike(P.CJK), 30).otherwise(80), F.when(wrapped, 0.3).otherwise(0.7)).when(s.rlike("[?？]"), 0.5).otherwise(0.4)


@query(f"WITH {_C} SELECT conv_id, turn, CAST({_SCORE} AS DOUBLE) AS score FROM c")
def score_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns(spark, sf_dir).select("conv_id", "turn", score(F.col("text")).alias("score"))


@query(f"""WITH {_C}, v AS (SELECT conv_id, string_agg(text, ' ' ORDER BY turn) AS t, coalesce(sum(CASE WHEN length(s) > 20 THEN length(text) END), 0) AS chars, count(*) AS n FROM c GROUP BY 1)
 SELECT conv_id, round(least(1.0, CASE WHEN {P.any_sql("t", REMEMBER)} THEN 0.5 ELSE 0 END + CASE WHEN {P.any_sql("t", TOOL)} THEN 0.4 ELSE 0 END + CASE WHEN {P.any_sql("t", CORRECTION + DECISION)} THEN 0.3 ELSE 0 END + CASE WHEN chars > 200 THEN 0.2 ELSE 0 END + CASE WHEN n > 6 THEN 0.1 ELSE 0 END)::DOUBLE, 6) AS value FROM v""")
def conversation_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a conversation as a whole is worth; a conversation's turns are joined into one text."""
    s = P.strip(F.col("text"))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), " ")
    v = turns(spark, sf_dir).groupBy("conv_id").agg(joined.alias("t"), F.sum(F.when(F.length(s) > 20, F.length("text"))).alias("chars"), F.count(F.lit(1)).alias("n"))
    part = lambda c, x: F.when(c, x).otherwise(0.0)
    t = F.col("t")
    return v.select("conv_id", F.round(F.least(F.lit(1.0), part(P.any_of(t, REMEMBER), 0.5) + part(P.any_of(t, TOOL), 0.4) + part(P.any_of(t, CORRECTION + DECISION), 0.3) + part(F.col("chars") > 200, 0.2) + part(F.col("n") > 6, 0.1)), 6).alias("value"))


@query(f"WITH {_C}, r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM c WHERE role IN ('user', 'assistant')) SELECT conv_id, string_agg(role || ': ' || s[1:80], chr(10) ORDER BY turn) AS rendered FROM r WHERE r <= 6 GROUP BY 1")
def render_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest six messages in order of time."""
    rows = turns(spark, sf_dir).where(F.col("role").isin("user", "assistant"))
    rows = rows.withColumn("r", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))).where("r <= 6")
    line = F.concat("role", F.lit(": "), F.substring(P.strip(F.col("text")), 1, 80))
    return rows.groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", line.alias("l")))), lambda x: x["l"]), "\n").alias("rendered"))


@query("SELECT conv_id, role, count(*) AS n, sum(length(text)) AS chars FROM conversations GROUP BY 1, 2")
def message_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").groupBy("conv_id", "role").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).cast("decimal(38,0)").alias("chars"))


@query(f"""WITH {_C}, t AS (SELECT conv_id, turn, length(s) AS n, sum(length(s)) OVER (PARTITION BY conv_id ORDER BY turn) AS total, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM c) SELECT conv_id, turn, CAST(CASE WHEN total <= 600 THEN n ELSE 600 - (total - n) END AS BIGINT) AS chars FROM t WHERE total - n < 600 AND r <= 3""")
def character_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items while they fit into 600 characters, the first that does not is cut, at most three."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    n = F.length(P.strip(F.col("text"))).cast("long")
    t = turns(spark, sf_dir).select("conv_id", "turn", n.alias("n"), F.sum(n).over(w).alias("total"), F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")).alias("r"))
    return t.where((F.col("total") - F.col("n") < 600) & (F.col("r") <= 3)).select("conv_id", "turn", F.when(F.col("total") <= 600, F.col("n")).otherwise(600 - (F.col("total") - F.col("n"))).alias("chars"))


def compressed(sizes: list[int], scores: list[float], budget: int, least: int = 3, low: float = 0.3) -> list[int]:
    """Places of the texts that stay within the budget: the first, the last, then the best scored, a tool call with what follows it;
    where every score is low, the latest up to a least number."""
    n = len(sizes)
    if sum(sizes) <= budget:
        return list(range(n))
    partner: dict[int, int] = {}
    for i in range(n - 1):
        if scores[i] == 1.0 and i not in partner:
            partner |= {i: i + 1, i + 1: i}
    kept: set[int] = set()
    used = 0

    def take(i: int) -> bool:
        nonlocal used
        fits = i not in kept and used + sizes[i] <= budget
        if fits:
            kept.add(i)
            used += sizes[i]
        return fits

    take(0)
    take(n - 1)
    for i in sorted(range(1, n - 1), key=lambda i: (-scores[i], i)):
        if used < budget and take(i) and i in partner:
            take(partner[i])
    if max(scores) < low:
        for i in reversed(range(n)):
            if len(kept) < min(least, n):
                take(i)
    return sorted(kept)


@query()
def compress_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns kept within 2000 characters a conversation."""

    def one(pdf):
        pdf = pdf.sort_values("turn").reset_index(drop=True)
        return pdf.iloc[compressed(pdf["chars"].tolist(), pdf["score"].tolist(), 2000)][["conv_id", "turn", "score"]]

    rows = turns(spark, sf_dir).select("conv_id", "turn", score(F.col("text")).alias("score"), F.length("text").alias("chars"))
    return rows.groupBy("conv_id").applyInPandas(one, "conv_id long, turn long, score double")


# What makes a lesson structured, principled, technical, vague or concrete.
STRUCTURED, PRINCIPLED = [r"pitfall\s*:|cause\s*:|fix\s*:|prevention\s*:"], [r"decision principle|trigger\s*:|action\s*:"]
TECHNICAL = [r"\b(openclaw|docker|systemd|ssh|git|api|json|yaml|config)\b"]
VAGUE, CONCRETE = ["be careful|best practice|should|建议|注意"], ["cause|fix|prevention|trigger|action|原因|修复|预防|触发"]
LESSONS = [
    ("Pitfall: the docker config broke. Fix: pin the image", "fact", 0.9, 2), ("pitfall: THE docker config broke.  fix: pin the image", "fact", 0.5, 1), ("You should be careful with the git hooks", "rule", 0.8, 1),
    ("Trigger: a slow api; action: cache its answers", "decision", 1.7, 3), ("no evidence for this lesson at all", "fact", 0.9, 0), ("short one", "fact", 0.9, 1), ("Always use “quotes” of one kind, it’s simpler", None, None, 1), (" " * 5 + "Use utc everywhere, in every table" + " " * 5, "preference", 0.6, 1),
]
_LESSONS = ", ".join("({}, '{}', {}, {}, {})".format(i, t.replace("'", "''"), f"'{c}'" if c else "NULL", "NULL" if imp is None else imp, e) for i, (t, c, imp, e) in enumerate(LESSONS))
_LESSON_SQL = f"""raw AS (SELECT conv_id * 1000 + turn AS id, text, CASE turn % 3 WHEN 0 THEN 'fact' WHEN 1 THEN 'rule' ELSE 'decision' END AS category, CAST(turn % 5 AS DOUBLE) / 4 AS importance, turn % 3 AS evidence FROM conversations
 UNION ALL SELECT -1 - id, text, category, CAST(importance AS DOUBLE), evidence FROM (VALUES {_LESSONS}) l(id, text, category, importance, evidence)),
 lessons AS (SELECT id, substr(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), 1, 480) AS text, CASE WHEN category IN ('fact', 'decision', 'preference', 'other') THEN category ELSE 'other' END AS category, coalesce(importance, 0.7) AS importance, evidence FROM raw WHERE length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) >= 10),
 scored AS (SELECT *, lower(translate(regexp_replace(text, '\\s+', ' ', 'g'), '“”‘’', '""' || chr(39) || chr(39))) AS key, CAST(CASE WHEN {P.any_sql("text", STRUCTURED)} THEN 2 ELSE 0 END + CASE WHEN {P.any_sql("text", PRINCIPLED)} THEN 2 ELSE 0 END + CASE WHEN {P.any_sql("text", TECHNICAL)} THEN 1 ELSE 0 END
 + CASE WHEN length(text) < 120 THEN 0.5 ELSE 0 END + CASE WHEN evidence >= 1 THEN 1 ELSE 0 END + CASE WHEN evidence >= 2 THEN 0.5 ELSE 0 END + greatest(0, least(1, importance)) AS DOUBLE) AS score FROM lessons)"""


def lessons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lessons of texts of ten characters or more, cut at 480, unknown categories as other; each with its score."""
    turn, conv = F.col("turn").cast("long"), F.col("conv_id").cast("long")
    found = table(spark, sf_dir, "conversations").select(
        (conv * 1000 + turn).alias("id"), "text", F.when(turn % 3 == 0, "fact").when(turn % 3 == 1, "rule").otherwise("decision").alias("category"), ((turn % 5).cast("double") / 4).alias("importance"), (turn % 3).alias("evidence")
    )
    raw = found.unionByName(spark.createDataFrame([(-1 - i, t, c, imp, e) for i, (t, c, imp, e) in enumerate(LESSONS)], "id long, text string, category string, importance double, evidence long"))
    text, named = P.strip(F.col("text")), F.col("category").isin("fact", "decision", "preference", "other")
    rows = raw.where(F.length(text) >= 10).select("id", F.substring(text, 1, 480).alias("text"), F.when(named, F.col("category")).otherwise("other").alias("category"), F.coalesce("importance", F.lit(0.7)).alias("importance"), "evidence")
    t, part = F.col("text"), lambda c, x: F.when(c, x).otherwise(0.0)
    score = part(P.any_of(t, STRUCTURED), 2.0) + part(P.any_of(t, PRINCIPLED), 2.0) + part(P.any_of(t, TECHNICAL), 1.0) + part(F.length(t) < 120, 0.5) + part(F.col("evidence") >= 1, 1.0) + part(F.col("evidence") >= 2, 0.5)
    key = F.lower(F.translate(F.regexp_replace(t, r"\s+", " "), "“”‘’", "\"\"''"))
    return rows.withColumn("key", key).withColumn("score", score + F.greatest(F.lit(0.0), F.least(F.lit(1.0), "importance")))


@query(f"WITH {_LESSON_SQL} SELECT id, category, importance, round(score, 6) AS score, length(text) AS n FROM scored")
def score_lessons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lessons(spark, sf_dir).select("id", "category", "importance", F.round("score", 6).alias("score"), F.length("text").cast("long").alias("n"))


@query(f"""WITH {_LESSON_SQL}, f AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY key ORDER BY id) = 1) SELECT id, round(score, 6) AS score FROM f
 WHERE evidence > 0 AND length(key) >= 20 AND NOT ({P.any_sql("key", VAGUE)} AND NOT {P.any_sql("key", CONCRETE)}) ORDER BY f.score DESC, id LIMIT 20""")
def reduce_lessons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of equal lessons; those with evidence that are neither short nor vague; the best twenty."""
    rows = lessons(spark, sf_dir)
    first = rows.groupBy("key").agg(F.min_by(F.struct(*rows.columns), "id").alias("f")).select("f.*")
    key = F.col("key")
    good = (F.col("evidence") > 0) & (F.length(key) >= 20) & ~(P.any_of(key, VAGUE) & ~P.any_of(key, CONCRETE))
    return first.where(good).orderBy(F.desc("score"), "id").limit(20).select("id", F.round("score", 6).alias("score"))
