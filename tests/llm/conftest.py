import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


def prose(rng, n, words=None):
    words = words or [f"w{k}" for k in range(400)]
    return " ".join(rng.choice(words) for _ in range(n))


@pytest.fixture(scope="session")
def make_docs(spark):
    """A table of documents from (doc_id, text[, lang]) rows, with columns whose names clash with inner ones."""

    def make(rows, clash=False):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "s", None if r[1] is None else len(r[1])) for r in rows]
        df = spark.createDataFrame(full, SCHEMA)
        if clash:
            from pyspark.sql import functions as F

            for c in ("row", "set", "key", "size", "rank", "digest", "marks", "component", "bucket", "payload", "stratum", "words", "node", "slot"):
                df = df.withColumn(c, F.lit("x"))
        return df

    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and blank texts, repeated rows, null ids, a very long text."""
    import random

    rng = random.Random(5)
    long = prose(rng, 30_000)
    copy = prose(rng, 120)
    return [(1, None), (2, ""), (3, " \t\n "), (4, copy), (4, copy), (5, copy), (None, copy), (None, "alone without an id"), (6, long), (7, long + " tail"), (8, "one"), (9, "ONE"), (10, None, None), (11, "a b c", None), (12, "!!! ... 123"), (13, "é" * 300)]
