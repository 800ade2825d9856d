"""Tables that outlive the job that made them: written to the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """A new path in the folder that spark.checkpoint.dir names; only a local session without that setting gets a temporary folder."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        top = "file://" + tempfile.mkdtemp(prefix="attesta-")
        spark.conf.set("spark.checkpoint.dir", top)
    return f"{top.rstrip('/')}/attesta-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """df as a table: its plan runs once, and a lost executor costs only its own tasks."""
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
