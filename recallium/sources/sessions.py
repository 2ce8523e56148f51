"""Session files: one JSON object a line, messages among other events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recallium.functions import patterns as P

_LINE = "type string, timestamp string, message struct<role:string,content:string>"
_BLOCKS = "array<struct<type:string,text:string>>"


def read_messages(spark: SparkSession, path: str) -> DataFrame:
    """session, id, role, timestamp, text of user and assistant messages; id counts those with text within their file.

    Content is a string or a list of blocks, whose texts are joined by line ends. Other lines, broken ones too, are left out."""
    lines = spark.read.text(path, wholetext=False).select("value", F.col("_metadata.file_path").alias("session"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    rows = lines.select("session", "block", "at", F.from_json("value", _LINE).alias("o")).where("o.type = 'message' AND o.message.role IN ('user', 'assistant')")
    content = F.col("o.message.content")
    blocks = F.filter(F.from_json(content, _BLOCKS), lambda b: (b["type"] == "text") & (b["text"] != ""))
    text = F.when(F.ltrim(content).startswith("[{"), F.coalesce(F.array_join(F.transform(blocks, lambda b: b["text"]), "\n"), content)).otherwise(content)
    rows = rows.select("session", "block", "at", F.col("o.message.role").alias("role"), F.coalesce("o.timestamp", F.lit("")).alias("timestamp"), P.strip(text).alias("text")).where("text <> ''")
    order = Window.partitionBy("session").orderBy("block", "at")
    return rows.select("session", F.row_number().over(order).alias("id"), "role", "timestamp", "text")
