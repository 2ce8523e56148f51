"""Queries over chains of versions, the versioned table and the stored index."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recallium.catalog import query
from recallium.operators import chains, compaction
from recallium.operators import search as S
from recallium.operators.stored import shared_folder
from recallium.operators.text_index import index_of
from recallium.plans.search_queries import _BM25, _QT, POOL, text_queries
from recallium.sources.memories import BASE_SQL, DAY, NOW, base, table, with_vectors
from recallium.sources.versions import Versions


def _scratch(spark: SparkSession, what: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/recallium/{what}-{uuid.uuid4().hex}"


#: Each turn of a conversation is a version of what the turn before said; every tenth conversation's first turn claims to supersede itself, and every seventh says its edges from the older end.
_IDS = "conv_id || ':' || turn"
_RELATIONS = """'[{"type":"' || CASE WHEN conv_id % 7 = 0 THEN 'superseded_by' ELSE 'supersedes' END || '","targetId":"' || conv_id || ':' || CASE WHEN conv_id % 7 = 0 THEN turn + 1 WHEN conv_id % 10 = 0 AND turn = 0 THEN 0 ELSE turn - 1 END || '"},{"type":"supports","targetId":"' || conv_id || ':0"}]'"""


@query(f"""WITH RECURSIVE m AS (SELECT {_IDS} AS id, conv_id, turn, turn AS ts, {_RELATIONS} AS relations FROM conversations), x AS (SELECT id, unnest(CAST(relations AS JSON[])) AS r FROM m),
 s AS (SELECT r->>'$.targetId' AS id, id AS nxt FROM x WHERE r->>'$.type' = 'supersedes' UNION SELECT id, r->>'$.targetId' FROM x WHERE r->>'$.type' = 'superseded_by'),
 e AS (SELECT s.id, arg_max(s.nxt, (m.ts, m.id)) AS nxt FROM s JOIN m ON m.id = s.nxt WHERE s.id IN (SELECT id FROM m) GROUP BY 1), n AS (SELECT DISTINCT id FROM m),
 w AS (SELECT id, id AS place, 0 AS depth, [id] AS seen, false AS again FROM n UNION ALL SELECT w.id, e.nxt, depth + 1, list_append(seen, e.nxt), list_contains(seen, e.nxt) FROM w JOIN e ON e.id = w.place WHERE NOT again),
 f AS (SELECT id, arg_max(place, depth) AS place, max(depth) AS depth, bool_or(again) AS again FROM w GROUP BY 1) SELECT id, CASE WHEN NOT again THEN place END AS head, CAST(CASE WHEN NOT again THEN depth END AS BIGINT) AS depth, again AS in_loop FROM f""")
def version_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest version of each turn and how many steps away it is, over edges read from relations."""
    turns = table(spark, sf_dir, "conversations").select(F.expr(_IDS).alias("id"), F.col("turn").alias("ts"), F.expr(_RELATIONS).alias("relations"))
    return chains.newest_versions(turns)


@query(f"""WITH {BASE_SQL}, o AS (SELECT doc_id, category, importance + CASE WHEN doc_id % 6 = 1 THEN 0.5 ELSE 0 END AS importance FROM base WHERE doc_id % 9 <> 4), r AS (SELECT 'merged' AS category, doc_id, importance FROM o WHERE doc_id % 9 = 5)
 SELECT doc_id, category, importance FROM o WHERE doc_id % 9 <> 5 UNION ALL SELECT doc_id, category, importance FROM r""")
def versioned_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table in versions after an append, an update, a deletion and a replacement."""
    rows = base(spark, sf_dir).select("doc_id", "category", "importance")
    memories = Versions(spark, _scratch(spark, "memories"))
    memories.create(rows.where("doc_id % 2 = 0"), buckets=8)
    memories.append(rows.where("doc_id % 2 = 1"))
    memories.update(rows.where("doc_id % 6 = 1").select("doc_id", (F.col("importance") + 0.5).alias("importance")))
    memories.delete(rows.where("doc_id % 9 = 4"))
    some = memories.read().where("doc_id % 9 = 5")
    memories.replace(some, some.withColumn("category", F.lit("merged")))
    return memories.read()


@query(f"WITH {_QT}, {_BM25} SELECT qid, doc_id, rank, round(b, 6) AS score FROM norm")
def indexed_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full-text search over the stored index of the documents, which is made at the first search of a table and kept."""
    hits = S.min_max(index_of(spark, f"{sf_dir}/documents.parquet").search(text_queries(spark, sf_dir), POOL))
    return hits.select("qid", "doc_id", "rank", F.round("bm25", 6).alias("score"))


#: Removed and added rows: every third document goes, benchmark items come.
_CHANGED = "documents AS (SELECT doc_id, text FROM src WHERE doc_id % 3 <> 1 UNION ALL SELECT -1 - item_id, text FROM benchmark)"


@query(f"WITH src AS (SELECT * FROM main.documents), {_CHANGED}, {_QT}, {_BM25} SELECT qid, doc_id, rank, round(b, 6) AS score FROM norm")
def indexed_search_after_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same after removals and additions, which are segments beside the first one."""
    index = index_of(spark, f"{sf_dir}/documents.parquet").fork(_scratch(spark, "text-index"))
    index.remove(table(spark, sf_dir, "documents").where("doc_id % 3 = 1").select("doc_id", "text"))
    index.append(table(spark, sf_dir, "benchmark").select((-1 - F.col("item_id")).alias("doc_id"), "text"))
    hits = S.min_max(index.search(text_queries(spark, sf_dir), POOL))
    return hits.select("qid", "doc_id", "rank", F.round("bm25", 6).alias("score"))


@query()
def compacted_memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The memories after one run of compaction (at most 200 of a week or more, the oldest first) as one version; greedy, so without SQL."""
    rows = with_vectors(spark, sf_dir).select("doc_id", "text", F.col("vector").cast("array<double>").alias("vector"), "importance", "category", F.coalesce("scope", F.lit("global")).alias("scope"), "ts", F.lit(None).cast("string").alias("metadata"))
    memories = Versions(spark, _scratch(spark, "compaction"))
    memories.create(rows, buckets=8)
    compaction.compact(memories, 64, NOW - 7 * DAY)
    return memories.read().select("doc_id", "importance", "category", "scope", "ts", F.md5(F.coalesce("text", F.lit(""))).alias("text_md5"), F.get_json_object("metadata", "$.sourceCount").cast("long").alias("source_count"))
