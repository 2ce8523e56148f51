"""Tables kept for a second reading."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Where none is set: a machine-local one in local mode, else the warehouse."""
    local = spark.sparkContext.master.startswith("local[")
    return spark.conf.get("spark.checkpoint.dir", None) or (f"file://{tempfile.gettempdir()}/recallium-shared" if local else spark.conf.get("spark.sql.warehouse.dir"))


def stored(df: DataFrame) -> DataFrame:
    """df, written once as Parquet to the shared folder, so that reading it again computes nothing again and lost executors cost nothing.
    Its size is known from then on, so joins with it are planned by it. The files go when the application ends."""
    spark = df.sparkSession
    name = f"{shared_folder(spark).rstrip('/')}/recallium/stored-{uuid.uuid4().hex}"
    df.write.parquet(name)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    return spark.read.schema(df.schema).parquet(name)
