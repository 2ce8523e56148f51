"""Statistics over memories, admissions and retrieval traces. Admissions and traces are read off the events table:
an event is a trace (value: milliseconds, k: results), its type a source; errors and signups are rejections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recallium.catalog import query
from recallium.operators import metrics
from recallium.operators.folds import sorted_fold
from recallium.operators.stored import stored
from recallium.sources.memories import BASE_SQL, DAY, MILLIS_SQL, NOW, base, millis, table

_EVENTS = f"ev AS (SELECT event_id, user_id, event_type, value, {MILLIS_SQL} AS at_ms, CAST(props->>'$.k' AS BIGINT) AS k FROM events)"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select("event_id", "user_id", "event_type", "value", millis("ts").alias("at_ms"), F.get_json_object("props", "$.k").cast("long").alias("k"))


@query(f"WITH {BASE_SQL} SELECT coalesce(scope, 'global') AS scope, category, count(*) AS n FROM base GROUP BY GROUPING SETS ((coalesce(scope, 'global')), (category), ())")
def store_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Total, by scope and by category, in one aggregation over grouping sets."""
    rows = base(spark, sf_dir).withColumn("scope", F.coalesce("scope", F.lit("global")))
    return rows.groupingSets([["scope"], ["category"], []], "scope", "category").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {BASE_SQL} SELECT CASE WHEN scope IS NULL OR scope = 'global' THEN 'global' ELSE split_part(scope, ':', 1) END AS scope_type, count(DISTINCT scope) AS scopes, count(*) AS n FROM base GROUP BY 1")
def scope_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.coalesce("scope", F.lit("global")) == "global", "global").otherwise(F.substring_index("scope", ":", 1))
    return base(spark, sf_dir).groupBy(kind.alias("scope_type")).agg(F.countDistinct("scope").alias("scopes"), F.count(F.lit(1)).alias("n"))


@query(f"WITH {BASE_SQL} SELECT doc_id, coalesce(regexp_extract(scope, '^([a-z]+):(.*)$', 1), '') AS kind, coalesce(regexp_extract(scope, '^([a-z]+):(.*)$', 2), '') AS name, coalesce(regexp_full_match(scope, '[A-Za-z0-9._:\\-]+'), false) AS valid FROM base")
def scope_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = lambda i: F.coalesce(F.regexp_extract("scope", "^([a-z]+):(.*)$", i), F.lit(""))
    return base(spark, sf_dir).select("doc_id", part(1).alias("kind"), part(2).alias("name"), F.coalesce(F.col("scope").rlike(r"^[A-Za-z0-9._:\-]+$"), F.lit(False)).alias("valid"))


@query(f"""WITH {BASE_SQL}, access AS (SELECT 'agent' || g AS agent, unnest(['global', 'agent:src' || g, 'reflection:agent:src' || g]) AS scope FROM range(5) r(g))
 SELECT agent, count(*) AS n FROM base b JOIN access a ON a.scope = coalesce(b.scope, 'global') GROUP BY 1""")
def scope_access(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that each agent may read; its own reflection scope is always among them."""
    g = F.col("id").cast("string")
    access = spark.range(5).select(F.concat(F.lit("agent"), g).alias("agent"), F.explode(F.array(F.lit("global"), F.concat(F.lit("agent:src"), g), F.concat(F.lit("reflection:agent:src"), g))).alias("scope"))
    return base(spark, sf_dir).withColumn("scope", F.coalesce("scope", F.lit("global"))).join(F.broadcast(access), "scope").groupBy("agent").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {_EVENTS}, r AS (SELECT *, 'score ' || CAST(k AS VARCHAR) || ' below 0.' || CAST(k % 7 AS VARCHAR) || ' for ' || event_type || CAST(user_id % 3 AS VARCHAR) AS reason FROM ev WHERE event_type IN ('error', 'signup')),
 g AS (SELECT trim(regexp_replace(regexp_replace(lower(reason), '\\d+(?:\\.\\d+)?', '#', 'g'), '\\s+', ' ', 'g')) AS reason_key, count(*) AS n, arg_min(reason, event_id) AS label FROM r GROUP BY 1)
 SELECT label, n FROM g ORDER BY n DESC, label LIMIT 5""")
def rejection_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five most frequent reasons, keyed with numbers masked, labelled as first seen."""
    e = events(spark, sf_dir).where(F.col("event_type").isin("error", "signup"))
    s = lambda c: c.cast("string")
    e = e.withColumn("reason", F.concat(F.lit("score "), s(F.col("k")), F.lit(" below 0."), s(F.col("k") % 7), F.lit(" for "), "event_type", s(F.col("user_id") % 3)))
    key = F.trim(F.regexp_replace(F.regexp_replace(F.lower("reason"), r"\d+(?:\.\d+)?", "#"), r"\s+", " "))
    return e.groupBy(key.alias("reason_key")).agg(F.count(F.lit(1)).alias("n"), F.min_by("reason", "event_id").alias("label")).orderBy(F.desc("n"), "label").limit(5).select("label", "n")


@query(f"""WITH {_EVENTS}, c AS (SELECT 'c' || CAST(k % 6 AS VARCHAR) AS category, count(*) FILTER (event_type NOT IN ('error', 'signup')) AS admitted, count(*) FILTER (event_type IN ('error', 'signup')) AS rejected FROM ev GROUP BY 1)
 SELECT category, admitted, rejected, round(rejected / CAST(admitted + rejected AS DOUBLE), 6) AS reject_rate FROM c""")
def admission_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    no = F.col("event_type").isin("error", "signup")
    c = events(spark, sf_dir).groupBy(F.concat(F.lit("c"), (F.col("k") % 6).cast("string")).alias("category")).agg(F.count_if(~no).alias("admitted"), F.count_if(no).alias("rejected"))
    return c.withColumn("reject_rate", F.round(F.col("rejected") / (F.col("admitted") + F.col("rejected")), 6))


@query(f"WITH {_EVENTS} SELECT count(*) FILTER (at_ms >= {NOW - DAY}) AS last_24h, count(*) FILTER (at_ms >= {NOW - 7 * DAY}) AS last_7d, count(*) AS total, max(at_ms) AS latest FROM ev WHERE event_type IN ('error', 'signup')")
def admission_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).where(F.col("event_type").isin("error", "signup"))
    return e.agg(F.count_if(F.col("at_ms") >= NOW - DAY).alias("last_24h"), F.count_if(F.col("at_ms") >= NOW - 7 * DAY).alias("last_7d"), F.count(F.lit(1)).alias("total"), F.max("at_ms").alias("latest"))


@query(f"""WITH {_EVENTS}, l AS (SELECT * FROM ev ORDER BY at_ms DESC, event_id DESC LIMIT 1000) SELECT count(*) AS queries, count(*) FILTER (k % 10 = 0) AS zero_results, CAST(floor(avg(value) + 0.5) AS BIGINT) AS avg_ms,
 round(quantile_disc(value, 0.95), 6) AS p95_ms, round(avg(k), 1) AS avg_results FROM l""")
def retrieval_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over the latest thousand traces; the percentile is the nearest rank."""
    latest = events(spark, sf_dir).orderBy(F.desc("at_ms"), F.desc("event_id")).limit(1000)
    p95 = F.element_at(F.sort_array(F.collect_list("value")), F.ceil(F.lit(0.95) * F.count(F.lit(1))).cast("int"))
    return latest.agg(
        F.count(F.lit(1)).alias("queries"), F.count_if(F.col("k") % 10 == 0).alias("zero_results"), F.floor(F.avg("value") + 0.5).alias("avg_ms"), F.round(p95, 6).alias("p95_ms"), F.round(F.avg("k"), 1).alias("avg_results")
    )


@query(f"WITH {_EVENTS} SELECT event_type AS operation, count(*) AS n, round(avg(value), 6) AS mean, round(min(value), 6) AS least, round(max(value), 6) AS most FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY at_ms DESC, event_id DESC) AS r FROM ev) WHERE r <= 500 GROUP BY 1")
def operation_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest 500 measurements of each operation."""
    w = Window.partitionBy("event_type").orderBy(F.desc("at_ms"), F.desc("event_id"))
    e = events(spark, sf_dir).withColumn("r", F.row_number().over(w)).where("r <= 500")
    return e.groupBy(F.col("event_type").alias("operation")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.min("value"), 6).alias("least"), F.round(F.max("value"), 6).alias("most"))


_TURNS = f"{_EVENTS}, t AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY at_ms, event_id) AS turn FROM ev)"
HOUR = 3600000


def _limiter(most: int, name: str) -> None:
    def step(held, row):
        held = [x for x in held or [] if x >= row.at_ms - HOUR]
        allowed = len(held) < most
        return (held + [row.at_ms] if allowed else held), allowed

    @query(f"""WITH RECURSIVE {_TURNS}, f AS (SELECT user_id, event_id, turn, [at_ms] AS held, true AS allowed FROM t WHERE turn = 1
 UNION ALL SELECT t.user_id, t.event_id, t.turn, CASE WHEN len(list_filter(f.held, lambda x: x >= t.at_ms - {HOUR})) < {most} THEN list_append(list_filter(f.held, lambda x: x >= t.at_ms - {HOUR}), t.at_ms) ELSE list_filter(f.held, lambda x: x >= t.at_ms - {HOUR}) END,
 len(list_filter(f.held, lambda x: x >= t.at_ms - {HOUR})) < {most} FROM f JOIN t ON t.user_id = f.user_id AND t.turn = f.turn + 1) SELECT event_id, allowed FROM f""", name)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = events(spark, sf_dir).select("user_id", "at_ms", "event_id")
        return sorted_fold(rows, ["user_id"], ["at_ms", "event_id"], step, "allowed", "boolean").select("event_id", "allowed")

    run.__doc__ = f"At most {most} events that went through in the hour before, both ends included; one that was held back does not count."


#: The rule's own limit, and one that these users reach.
_limiter(30, "hourly_rate_limit")
_limiter(2, "hourly_rate_limit_of_two")


@query(f"""WITH RECURSIVE {_EVENTS}, t AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY at_ms, event_id) AS turn FROM ev),
 shown AS (SELECT user_id, k, min(turn) AS turn FROM t GROUP BY 1, 2 UNION ALL SELECT s.user_id, s.k, min(t.turn) FROM shown s JOIN t ON t.user_id = s.user_id AND t.k = s.k AND t.turn >= s.turn + 8 GROUP BY s.user_id, s.k, s.turn)
 SELECT t.event_id, t.turn, s.turn IS NOT NULL AS injected FROM t LEFT JOIN shown s USING (user_id, k, turn)""")
def injection_repeat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A memory that was shown less than eight turns ago in the session is not shown again; only turns that show it count."""

    def step(last, row):
        shown = last is None or row.turn - last >= 8
        return (row.turn if shown else last), shown

    t = events(spark, sf_dir).withColumn("turn", F.row_number().over(Window.partitionBy("user_id").orderBy("at_ms", "event_id")).cast("long"))
    return sorted_fold(t.select("user_id", "k", "turn", "event_id"), ["user_id", "k"], ["turn"], step, "injected", "boolean").select("event_id", "turn", "injected")


SLICES, BAD, PAUSE = 8, 5, 8


@query(f"""WITH RECURSIVE {_EVENTS}, t AS (SELECT user_id, event_id, k, event_type, row_number() OVER (PARTITION BY user_id ORDER BY at_ms, event_id) AS turn FROM ev WHERE event_type IN ('purchase', 'error')),
 f AS (SELECT user_id, CAST(0 AS BIGINT) AS turn, CAST([] AS STRUCT(k BIGINT, up BIGINT, down BIGINT)[]) AS slices, CAST([] AS STRUCT(k BIGINT, up BIGINT, down BIGINT)[]) AS every FROM t WHERE turn = 1
 UNION ALL SELECT user_id, turn, every[1:{SLICES}], every FROM (SELECT t.user_id, t.turn, list_prepend(struct_pack(k := t.k,
 up := CAST(coalesce(list_filter(f.slices, lambda x: x.k = t.k)[1].up, 0) + CASE t.event_type WHEN 'purchase' THEN 1 ELSE 0 END AS BIGINT),
 down := CAST(coalesce(list_filter(f.slices, lambda x: x.k = t.k)[1].down, 0) + CASE t.event_type WHEN 'error' THEN 1 ELSE 0 END AS BIGINT)), list_filter(f.slices, lambda x: x.k <> t.k)) AS every FROM f JOIN t ON t.user_id = f.user_id AND t.turn = f.turn + 1)),
 l AS (SELECT *, list_sum(list_transform(every, lambda x: x.up)) AS up, list_sum(list_transform(every, lambda x: x.down)) AS down FROM f QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY turn DESC) = 1)
 SELECT user_id, CAST(up + down AS BIGINT) AS observations, round(up / CAST(up + down AS DOUBLE), 6) AS strength, len(slices) AS slices FROM l WHERE turn > 0""")
def support_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confirmations and contradictions by context after a user's last observation. The eight latest contexts stay; what an observation
    pushes out still counts in the totals of that observation, and a context that comes back starts anew."""

    def step(slices, row):
        old = next((x for x in slices or [] if x[0] == row.k), (row.k, 0, 0))
        up = row.event_type == "purchase"
        every = [(row.k, old[1] + up, old[2] + (not up)), *(x for x in slices or [] if x[0] != row.k)]
        return every[:SLICES], [sum(x[1] for x in every), sum(x[2] for x in every), min(len(every), SLICES)]

    seen = events(spark, sf_dir).where(F.col("event_type").isin("purchase", "error")).select("user_id", "at_ms", "event_id", "k", "event_type")
    after = sorted_fold(seen, ["user_id"], ["at_ms", "event_id"], step, "after", "array<long>")
    last = after.groupBy("user_id").agg(F.max_by("after", F.struct("at_ms", "event_id")).alias("x"))
    every = F.col("x")[0] + F.col("x")[1]
    return last.select("user_id", every.alias("observations"), F.round(F.col("x")[0] / every, 6).alias("strength"), F.col("x")[2].alias("slices"))


@query(f"""WITH RECURSIVE {_TURNS}, f AS (SELECT user_id, CAST(0 AS BIGINT) AS event_id, CAST(0 AS BIGINT) AS turn, 'none' AS event_type, CAST(NULL AS BIGINT) AS injected_at, CAST(NULL AS BIGINT) AS confirmed_at, CAST(0 AS BIGINT) AS bad, CAST(0 AS BIGINT) AS until, false AS injected FROM t WHERE turn = 1
 UNION ALL SELECT user_id, event_id, turn, event_type, CASE WHEN goes THEN at_ms ELSE injected_at END, CASE event_type WHEN 'purchase' THEN at_ms ELSE confirmed_at END, next_bad,
 CASE WHEN goes AND next_bad >= {BAD} THEN greatest(until, turn + {PAUSE}) ELSE until END, goes FROM (
 SELECT *, bad + CASE WHEN goes AND injected_at IS NOT NULL AND (confirmed_at IS NULL OR confirmed_at < injected_at) THEN 1 ELSE 0 END AS next_bad FROM (
 SELECT t.user_id, t.event_id, t.turn, t.event_type, t.at_ms, f.injected_at, f.confirmed_at, f.bad, f.until, t.event_type = 'click' AND t.turn > f.until AS goes FROM f JOIN t ON t.user_id = f.user_id AND t.turn = f.turn + 1)))
 SELECT event_id, injected, bad AS bad_count, until AS suppressed_until FROM f WHERE event_type = 'click'""")
def bad_recall_suppression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks stand for a memory that is up for injection, purchases for its confirmed use, events for turns. An injection whose
    predecessor was not confirmed since is a bad recall; from the fifth on the memory pauses for eight turns."""

    def step(state, row):
        injected_at, confirmed_at, bad, until, turn = state or (None, None, 0, 0, 0)
        turn += 1
        goes = row.event_type == "click" and turn > until
        if goes:
            bad += injected_at is not None and (confirmed_at is None or confirmed_at < injected_at)
            until = max(until, turn + PAUSE) if bad >= BAD else until
            injected_at = row.at_ms
        if row.event_type == "purchase":
            confirmed_at = row.at_ms
        return (injected_at, confirmed_at, bad, until, turn), [int(goes), int(bad), int(until)]

    rows = events(spark, sf_dir).select("user_id", "at_ms", "event_id", "event_type")
    after = sorted_fold(rows, ["user_id"], ["at_ms", "event_id"], step, "x", "array<long>").where("event_type = 'click'")
    return after.select("event_id", (F.col("x")[0] == 1).alias("injected"), F.col("x")[1].alias("bad_count"), F.col("x")[2].alias("suppressed_until"))


@query(f"""WITH {_EVENTS} SELECT event_type AS source, CAST(floor(at_ms / 3600000) AS BIGINT) AS hour, count(*) AS n, count(DISTINCT user_id) AS users FROM ev GROUP BY 1, 2""")
def hourly_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tumbling windows of an hour, the batch form of the streaming aggregation."""
    return events(spark, sf_dir).groupBy(F.col("event_type").alias("source"), F.floor(F.col("at_ms") / 3600000).alias("hour")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("users"))


@query()
def cooldown_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five minutes must pass since the last event that went through; one that was held back does not count. A fold over each user's sorted events."""

    def step(last, row):
        passed = last is None or row.at_ms - last >= 300_000
        return (row.at_ms if passed else last), passed

    rows = events(spark, sf_dir).select("user_id", "at_ms", "event_id")
    return sorted_fold(rows, ["user_id"], ["at_ms", "event_id"], step, "passed", "boolean").select("event_id", "passed")


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as measurements: the type is the operation, the value its latency, k a score."""
    score = F.col("k") / 100
    e = events(spark, sf_dir)
    return e.select(F.col("event_type").alias("operation"), "event_id", "at_ms", F.col("value").alias("latency"), (F.col("event_id") % 7 == 0).alias("failed"), F.create_map(F.lit("k"), score).alias("features"))


@query(f"""WITH {_EVENTS}, r AS (SELECT *, k::DOUBLE / 100 AS score FROM ev), m AS (SELECT event_type AS operation, NULL AS feature, at_ms // 86400000 * 86400000 AS day, event_id, value AS x FROM r UNION ALL SELECT event_type, 'k', at_ms // 86400000 * 86400000, event_id, score FROM r WHERE score IS NOT NULL)
 SELECT operation, coalesce(feature, 'latency') AS measure, CAST(day AS BIGINT) AS day, count(*) AS n, count(*) FILTER (event_id % 7 = 0) AS failures, round(sum(x), 4) AS total, min(x) AS least, max(x) AS most, true AS p50_in_bounds, true AS p95_in_bounds FROM m GROUP BY ALL""")
def metric_rollups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days merged from hours: counts and bounds, and whether the sketches' quantiles stand where the records have them."""
    records = _records(spark, sf_dir)
    day = (F.floor(F.col("hour") / metrics.DAY) * metrics.DAY).alias("day")
    days = stored(metrics.merged(metrics.by_hour(records), "operation", F.coalesce("feature", F.lit("latency")).alias("measure"), day).withColumns({f"p{p}": metrics.quantile(p / 100) for p in (50, 95)}).drop("sketch"))
    of_day = (F.floor(F.col("at_ms") / metrics.DAY) * metrics.DAY).alias("day")
    values = records.select("operation", F.lit("latency").alias("measure"), of_day, F.col("latency").alias("x")).unionByName(records.select("operation", of_day, F.explode("features").alias("measure", "x")).select("operation", "measure", "day", "x"))
    keys = ["operation", "measure", "day"]
    ranks = values.join(days.select(*keys, "p50", "p95"), keys).groupBy(*keys).agg(*(F.count_if(F.col("x") < F.col(p)).alias(f"{p}_below") for p in ("p50", "p95")), *(F.count_if(F.col("x") <= F.col(p)).alias(f"{p}_up_to") for p in ("p50", "p95")))
    slack = F.col("n") * metrics.RANK_ERROR + 1
    inside = lambda p: (F.col(f"p{p}_below") <= p / 100 * F.col("n") + slack) & (F.col(f"p{p}_up_to") >= p / 100 * F.col("n") - slack)
    return days.join(ranks, keys).select(*keys, "n", "failures", F.round("total", 4).alias("total"), "least", "most", inside(50).alias("p50_in_bounds"), inside(95).alias("p95_in_bounds"))
