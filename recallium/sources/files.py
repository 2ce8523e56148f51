"""Readers and writers of files: Markdown, JSON lines, exports; opening a table that an older version wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# Columns that older tables lack.
DEFAULTS = {"scope": "global", "timestamp": 0.0, "metadata": "{}"}


def open_or_create(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """The table at path, an empty one of this schema where there is none; columns of DEFAULTS that it lacks are added."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)
    if not there:
        spark.createDataFrame([], schema).write.mode("ignore").parquet(path)
    return migrated(spark.read.parquet(path))


def migrated(df: DataFrame) -> DataFrame:
    """Older rows get the defaults of columns that came later."""
    return df.withColumns({c: F.lit(v) for c, v in DEFAULTS.items() if c not in df.columns})


def checked_path(spark: SparkSession, path: str) -> str:
    """The qualified path, created if need be; an error that says why where it can't be written."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(folder) and not fs.getFileStatus(folder).isDirectory():
        raise ValueError(f"{path} is a file, not a folder")
    if not fs.exists(folder) and not fs.mkdirs(folder):
        raise ValueError(f"{path} cannot be created")
    probe = jvm.org.apache.hadoop.fs.Path(folder, "_probe")
    try:
        fs.create(probe, True).close()
        fs.delete(probe, False)
    except Exception as e:
        raise ValueError(f"{path} cannot be written") from e
    return fs.makeQualified(folder).toString()


def bullets(texts: DataFrame, keys: list[str], least: int) -> DataFrame:
    """keys and bullet: lines that begin with a bullet and white space, a leading byte-order mark aside."""
    lines = texts.select(*keys, F.explode(F.split(F.regexp_replace("text", "^\ufeff+", ""), "\r?\n")).alias("line")).where(F.col("line").rlike(r"^[-*+]\s"))
    trimmed = F.regexp_replace(F.substring("line", 3, 1 << 30), r"^\s+|\s+$", "")
    return lines.select(*keys, trimmed.alias("bullet")).where(F.length("bullet") >= least)


def import_markdown(spark: SparkSession, path: str, least: int = 5) -> DataFrame:
    """path and bullet of every bullet in the files at path, one row for each different bullet of a file."""
    files = spark.read.option("wholetext", True).text(path).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    return bullets(files, ["path"], least).distinct()


def read_audits(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """JSON lines; lines that are no JSON object are left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def export_json(rows: DataFrame, path: str, most: int = 1000) -> None:
    """The newest rows without vectors, as JSON lines."""
    rows.drop("vector").orderBy(F.desc("ts"), "doc_id").limit(most).write.mode("overwrite").json(path)


def append_lines(rows: DataFrame, column: str, path: str) -> None:
    """Adds lines of text; earlier files stay."""
    rows.select(F.col(column).cast("string").alias("value")).write.mode("append").text(path)


def append_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def newest_files(spark: SparkSession, pattern: str, reset_mark: str = ".reset.") -> DataFrame:
    """path, name (without what a reset added) and mtime of session files, newest first. Lists, reads no content."""
    found = spark.read.format("binaryFile").load(pattern).select("path", "modificationTime")
    name = F.substring_index(F.substring_index("path", "/", -1), reset_mark, 1)
    return found.select("path", name.alias("name"), F.col("modificationTime").alias("mtime")).orderBy(F.desc("mtime"), "path")
