"""New memories against what is known: two stages of deduplication for batches of candidates, decided in order, and the table that results.

Neighbours are found beforehand, by one k-NN within scopes over the memories and one over the candidates themselves; then the
candidates of a scope are folded in order over these short lists. A candidate sees the memories that earlier ones ended as ended, those
that superseded something as memories at once, and those that were merely created from the next batch on (a batch is written at its end).
Each earlier candidate can end one memory, so the k-NN fetches as many more as there are candidates of a scope; more than MOST of a scope go in
rounds, each against the table that the one before left.

The second stage is a model's answer: judge(candidate, shown) -> (said, place, label), a function of the candidate's row and of the ids and
scores of up to three memories shown."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recallium.functions import rules as R
from recallium.functions import vector as V
from recallium.operators.folds import sorted_fold
from recallium.operators.stored import stored

# How near counts, how many are looked at and shown; what merges always, may merge, has versions; decisions, those that end a memory,
# those that name one.
NEAR, PROFILE_NEAR, LOOKED_AT, SHOWN = 0.7, 0.3, 5, 3
ALWAYS_MERGED, MERGEABLE, VERSIONED = ["profile"], ["preferences", "entities", "patterns"], ["preferences", "entities"]
DECISIONS, ENDING, NAMING = ["create", "merge", "skip", "support", "contextualize", "contradict", "supersede"], ["contradict", "supersede"], ["merge", "support", "contextualize", "contradict", "supersede"]
#: Candidates of a scope that are decided in one round.
MOST = 256

MEMORIES = "id long, scope string, category string, text string, vector array<double>, active boolean, relations array<struct<type: string, targetId: string>>, supports long, contradictions long"
CANDIDATES = "cid long, scope string, batch long, position long, category string, text string, vector array<double>"
Judge = Callable[[object, list], tuple]


def slot(text: Column) -> Column:
    """(brand, item) of a liking for a single thing, else null."""
    like = R.like(text)
    return F.when(F.size(like["items"]) == 1, F.struct(like["brand"].alias("brand"), like["items"][0].alias("item")))


def neighbours(memories: DataFrame, candidates: DataFrame, more: int) -> DataFrame:
    """cid, near, around: for each candidate with neighbours its active memories and fellow candidates at NEAR or above, and what is at
    PROFILE_NEAR or above in any state, best first. more: the candidates of a scope, at most."""
    described = lambda rows, key: rows.select(F.col(key).alias("id"), F.col("category").alias("kind"), F.col("slot.brand").alias("brand"), F.col("slot.item").alias("item"))
    asked = candidates.select(F.col("cid").alias("qid"), "vector", "scope")

    def found(corpus: DataFrame, key: str, queries: DataFrame, k: int, own: bool, use: str) -> DataFrame:
        hits = V.knn(corpus, queries, k, key, "scope").withColumnRenamed(key, "id").join(described(corpus, key), "id").where(F.col("id") != F.col("qid") if own else F.lit(True))
        return hits.select("qid", "id", (1 / (2 - F.col("cos"))).alias("score"), F.lit(own).alias("own"), "kind", "brand", "item", F.lit(use).alias("use"))

    profiles = candidates.where(F.col("category").isin(ALWAYS_MERGED)).select(F.col("cid").alias("qid"), "vector", "scope")
    rows = found(memories.where("active"), "id", asked, LOOKED_AT + more, False, "near").unionByName(found(candidates, "cid", asked, more + 1, True, "both")).unionByName(found(memories, "id", profiles, 1, False, "around"))
    listed = rows.select("qid", "use", F.struct((-F.col("score")).alias("order"), "id", "score", "own", "kind", "brand", "item").alias("x"))
    pick = lambda use, least: F.array_sort(F.collect_list(F.when(F.col("use").isin(use, "both") & (F.col("x.score") >= least), F.col("x"))))
    return listed.groupBy(F.col("qid").alias("cid")).agg(pick("near", NEAR).alias("near"), pick("around", PROFILE_NEAR).alias("around"))


def _step(judge: Judge) -> Callable:
    def decide(row, gone: set, made: set) -> tuple:
        visible = [x for x in row.around if not x["own"] or x["id"] in made]
        if row.category in ALWAYS_MERGED:
            best = visible[0] if visible else None
            return ("merge", best["id"], "profile") if best is not None and best["kind"] in ALWAYS_MERGED else ("create", None, "profile")
        near = [x for x in row.near if (not x["own"] or x["id"] in made) and x["id"] not in gone][:LOOKED_AT]
        if not near:
            return "create", None, "nothing near"
        if row.category == "preferences" and row.brand is not None and all(x["brand"] == row.brand and x["item"] != row.item for x in near):
            return "create", None, "other item of the brand"
        shown = near[:SHOWN]
        said, place, label = judge(row, [(x["id"], x["score"]) for x in shown])
        said = said.lower() if isinstance(said, str) else "create"
        named = isinstance(place, int) and 1 <= place <= len(shown)
        if said not in DECISIONS or (said in ENDING and not named):
            return "create", None, "unsafe answer"
        match = shown[place - 1 if named else 0]["id"]
        if said == "contradict" and row.category in VERSIONED and label == "general":
            said = "supersede"
        if (said == "merge" and row.category not in MERGEABLE) or (said == "supersede" and row.category not in VERSIONED):
            return "create", None, "not for the category"
        return said, match if said in NAMING else None, "answer"

    def step(state, row):
        gone, made, pending, batch = state or (set(), set(), set(), None)
        if row.batch != batch:
            made, pending = made | pending, set()
        decision, match, reason = decide(row, gone, made)
        if decision == "supersede":
            gone, made = gone | {match}, made | {row.cid}
        elif decision in ("create", "contextualize", "contradict"):
            pending = pending | {row.cid}
        return (gone, made, pending, row.batch), {"decision": decision, "match": match, "reason": reason}

    return step


def decide(memories: DataFrame, candidates: DataFrame, judge: Judge) -> DataFrame:
    """The candidates' columns and what is decided: decision, match (the memory it names), reason. One round: see MOST."""
    memories, candidates = (df.withColumn("scope", F.coalesce("scope", F.lit("global"))).withColumn("slot", slot(F.col("text"))) for df in (memories, candidates))
    more = candidates.groupBy("scope").count().agg(F.max("count")).first()[0] or 0
    known = neighbours(memories, candidates, more)
    rows = candidates.join(known, "cid", "left").withColumns({"brand": F.col("slot.brand"), "item": F.col("slot.item")}).drop("slot", "vector")
    empty = lambda c: F.coalesce(c, F.slice(c, 1, 0), F.array().cast(known.schema[c].dataType))
    rows = rows.withColumns({c: empty(c) for c in ("near", "around")})
    folded = sorted_fold(rows, ["scope"], ["batch", "position", "cid"], _step(judge), "out", "struct<decision: string, match: long, reason: string>")
    return folded.select("cid", "scope", "batch", "position", "category", "out.*")


def applied(memories: DataFrame, candidates: DataFrame, decisions: DataFrame, merged: Callable[[Column, Column], Column] = lambda old, new: new) -> DataFrame:
    """The memories after the decisions: new rows with their edges, ended ones with theirs, merged texts (merged(old, new); vectors stay), counts
    of support and contradiction. A merge counts as support."""
    edge = lambda kind, target: F.struct(F.lit(kind).alias("type"), target.cast("string").alias("targetId"))
    d = decisions.select("cid", "decision", "match", "batch", "position")
    kinds = F.when(F.col("decision") == "supersede", "supersedes").when(F.col("decision") == "contextualize", "contextualizes").when(F.col("decision") == "contradict", "contradicts")
    new = candidates.drop("batch", "position").join(d.where(F.col("decision").isin("create", "supersede", "contextualize", "contradict")), "cid")
    none = F.array().cast("array<struct<type: string, targetId: string>>")
    relations = F.when(kinds.isNotNull(), F.array(F.struct(kinds.alias("type"), F.col("match").cast("string").alias("targetId")))).otherwise(none)
    rows = new.select(F.col("cid").alias("id"), F.coalesce("scope", F.lit("global")).alias("scope"), "category", "text", F.col("vector").cast("array<double>").alias("vector"), F.lit(True).alias("active"), relations.alias("relations"), F.lit(0).cast("long").alias("supports"), F.lit(0).cast("long").alias("contradictions"))
    on = lambda *kinds: F.col("decision").isin(*kinds)
    effects = d.where("match IS NOT NULL").join(candidates.select("cid", F.col("text").alias("new_text")), "cid").groupBy(F.col("match").alias("id")).agg(
        F.max(F.when(on("supersede"), F.col("cid"))).alias("ended_by"), F.count_if(on("support", "merge")).alias("more"), F.count_if(on("contradict")).alias("against"),
        F.max(F.when(on("merge"), F.struct("batch", "position", "cid", "new_text")))["new_text"].alias("new_text"),
    )
    every = memories.select(*rows.columns).unionByName(rows).join(effects, "id", "left")
    ended = F.col("ended_by").isNotNull()
    return every.select(
        "id", "scope", "category", F.when(F.col("new_text").isNotNull(), merged(F.col("text"), F.col("new_text"))).otherwise(F.col("text")).alias("text"), "vector", (F.col("active") & ~ended).alias("active"),
        F.when(ended, F.concat(F.coalesce("relations", none), F.array(edge("superseded_by", F.col("ended_by"))))).otherwise(F.coalesce("relations", none)).alias("relations"),
        (F.col("supports") + F.coalesce("more", F.lit(0))).alias("supports"), (F.col("contradictions") + F.coalesce("against", F.lit(0))).alias("contradictions"),
    )


def deduplicate(memories: DataFrame, candidates: DataFrame, judge: Judge, most: int = MOST) -> tuple[DataFrame, DataFrame]:
    """(the memories after all candidates, the decisions). memories: MEMORIES; candidates: CANDIDATES, more columns for the judge; their ids
    (cid) are new. Batches stay whole: one that is larger than `most` is a round of its own."""
    in_scope = Window.partitionBy(F.coalesce("scope", F.lit("global"))).orderBy("batch", "position", "cid")
    batch = Window.partitionBy(F.coalesce("scope", F.lit("global")), "batch")
    placed = stored(candidates.withColumn("_at", F.row_number().over(in_scope) - 1).withColumn("_round", F.floor(F.min("_at").over(batch) / most)).drop("_at"))
    rounds = [r["_round"] for r in placed.select("_round").distinct().orderBy("_round").collect()]  # one a `most` candidates of the largest scope
    decisions = None
    for r in rounds:
        part = placed.where(F.col("_round") == r).drop("_round")
        made = stored(decide(memories, part, judge))
        memories = stored(applied(memories, part, made))
        decisions = made if decisions is None else decisions.unionByName(made)
    if decisions is None:
        decisions = memories.sparkSession.createDataFrame([], "cid long, scope string, batch long, position long, category string, decision string, match long, reason string")
    return memories, decisions
