"""Token counts through a digest cache.

Counts are stored under (digest of the normalised content, digest of the tokenizer's version). A call joins the
documents' digests to the stored counts, encodes each distinct content that has none once, and appends those counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_values, materialise, scratch_path, slices, small_batches
from .tokens import Encoder, drops_space, tokenizer_digest, tokenizer_path

CACHE_SCHEMA = "digest binary, tokenizer string, n_tokens long"


def _normalised(text: str, folds: bool) -> F.Column:
    """Content up to what cannot change a count: where the tokenizer drops white space, runs of spaces and line feeds
    count as one space and ends are cut off; else the text itself."""
    value = F.coalesce(F.col(text), F.lit(""))
    return F.trim(F.regexp_replace(value, "[ \n]{2,}|\n", " ")) if folds else value


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """The stored counts; an absent cache is an empty one."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], CACHE_SCHEMA)
    return spark.read.schema(CACHE_SCHEMA).parquet(path)


def count_tokens(docs: DataFrame, cache: str, tokenizer: str | None = None, limit: int = 2048, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row of docs; other columns of docs are left out.

    cache: path of the cache table in a shared folder; it is read, and the counts of the distinct misses are
    appended to it before this function returns. A null or empty text has 0 bytes and 0 tokens. Repeated rows, rows
    with equal ids and rows with null ids each give a row. An empty table gives an empty table. A call that fails
    while appending can leave counts twice: they are equal, and reading takes one of each.
    """
    spark, path = docs.sparkSession, tokenizer or tokenizer_path()
    version, folds = tokenizer_digest(path), drops_space(path)
    small_batches(spark)
    base = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    keyed = base.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), F.unhex(F.sha2(_normalised("text", folds), 256)).alias("digest"))
    keyed = materialise(keyed, "token-digests")
    stored = read_cache(spark, cache).where(F.col("tokenizer") == version)
    # one row of each distinct miss: its digest, and the least id that carries it
    misses = keyed.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).join(stored, "digest", "left_anti")
    misses = misses.select(F.col("digest").alias("miss"), F.col("doc_id").alias("miss_id"))
    texts = base.withColumn("digest", F.unhex(F.sha2(_normalised("text", folds), 256)))
    # ids are spread evenly, so joining on id and digest spreads copies of a hot text as well
    found = texts.join(misses.hint("shuffle_hash"), (F.col("digest") == F.col("miss")) & F.col("doc_id").eqNullSafe(F.col("miss_id"))).select("digest", "text")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, seen = Encoder.of(path), set()
        for batch in slices(batches):
            digests, texts = [], []
            for digest, value in zip(batch.column(0).to_pylist(), byte_values(batch.column(1)), strict=True):
                if digest not in seen:
                    seen.add(digest)
                    digests.append(digest)
                    texts.append(value)
            counts = [n for _, ends in encoder.runs(texts) for n in np.diff(ends, prepend=0).tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array([version] * len(counts), pa.string()), pa.array(counts, pa.int64())], names=["digest", "tokenizer", "n_tokens"])

    found.mapInArrow(encode, CACHE_SCHEMA).write.mode("append").parquet(cache)
    counts = spark.read.schema(CACHE_SCHEMA).parquet(cache).where(F.col("tokenizer") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    # both sides of the join are tables, so that adaptive execution can split the rows of a hot digest
    joined = keyed.join(materialise(counts, "token-counts").hint("merge"), "digest")
    return joined.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole table `documents`, with a cache of its own that starts empty."""
    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), scratch_path(spark, "token-cache"))
