"""Tables written between jobs, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def base(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a local folder of our own only where it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.gridloom.scratch", None)
    if not found:
        found = "file://" + tempfile.mkdtemp(prefix="gridloom-")
        spark.conf.set("spark.gridloom.scratch", found)
    return found.rstrip("/")


def materialise(df: DataFrame, name: str) -> DataFrame:
    path = f"{base(df.sparkSession)}/gridloom/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
