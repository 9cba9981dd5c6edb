"""The corpus pipeline: language ID, quality rules, near-duplicate removal, substring dedup, packing.

STAGES are (name, function) pairs; each function takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import common, jaccard, language, packing, quality, substring


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no language is recognised (null, empty or blank texts, and texts without a letter) go. Where
    nothing was learned, since no row outside the held-out remainder has a label, nothing can be judged and all
    documents stay. Repeated rows are judged alike, ties between languages do not matter here."""
    samples = language.sample_texts(docs)
    if not samples:
        return docs
    predicted, score = common.unused(docs.columns, "lang_pred", "lang_score")
    found = language.classify(docs, samples, into=(predicted, score))
    return found.where(F.col(predicted) != "und").select(*common.columns_of(docs.columns))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or a certified cutoff go: null, empty and short texts among them. Equal rows
    share their verdict, null languages form the stratum 'other', an id labelled good and bad counts as bad."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: five-word shingles, similarity 0.8 or more. It is the one of the
    least id (of equal ids the least hash), repeated rows become one, texts without words all stay."""
    return jaccard.keep_one(docs, width=5, percent=80)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words inside any 50-word window that occurs more than once are cut out of the texts. All rows stay, those that
    were nulls too; a text may become empty."""
    cut = substring.cut_repeats(docs, width=50)
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else cut


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's token ids packed into sequences of 4096; null and empty texts are one end token each."""
    return packing.pack(docs)


STAGES = [
    ("language ID", language_stage),
    ("quality rules", quality_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("substring dedup", substring_stage),
    ("best-fit packing", packing_stage),
]

#: Encoding with a tokenizer and automata have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = common.materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
