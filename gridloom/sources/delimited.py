"""Delimited text with a header, every field as text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_delimited(spark: SparkSession, path: str, delim: str = ",") -> DataFrame:
    if len(delim) != 1:
        raise ValueError("the delimiter must be one character")
    reader = spark.read.option("header", True).option("sep", delim).option("inferSchema", False).option("quote", "").option("mode", "PERMISSIVE")
    return reader.option("nullValue", "\x00").option("emptyValue", "").csv(path)
