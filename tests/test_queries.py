import os

import pytest

from gridloom.plans import oracle, queries
from gridloom.streaming import rollup

duckdb = pytest.importorskip("duckdb")


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for f in os.listdir(sf):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from '{sf}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_matches_sql(spark, duck, sf, name):
    own = queries.QUERIES[name](spark, sf)
    if name not in oracle.ORACLE_SQL:
        assert own.count() > 0
        return
    a, b = own.toPandas(), duck.sql(oracle.ORACLE_SQL[name]).df()
    columns = sorted(a.columns)
    assert columns == sorted(b.columns) and len(a) == len(b)
    show = lambda x: x[columns].astype(str).sort_values(columns).reset_index(drop=True)
    assert show(a).equals(show(b))


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_streams(spark, sf, tmp_path):
    from gridloom.operators import counts
    from gridloom.plans import points

    rows = points.points(spark, sf)
    rows.write.parquet(str(tmp_path / "points"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "points"))
    run = rollup.stream_counts(stream, 0, 4).writeStream.outputMode("complete").format("memory").queryName("tiles").trigger(availableNow=True).start()
    run.awaitTermination()
    from pyspark.sql import functions as F

    from gridloom.operators.build import place

    batch = counts.count_all(place(rows, 4).select(F.lit(4).alias("z"), F.col("tx").alias("x"), F.col("ty").alias("y"), F.lit(1).alias("n")), 0, 4).select("zoom", "x", "y", "total_count")
    assert spark.table("tiles").exceptAll(batch).count() == 0 and batch.exceptAll(spark.table("tiles")).count() == 0
    run = rollup.stream_bins(stream, 2, 5).writeStream.outputMode("complete").format("memory").queryName("bins").trigger(availableNow=True).start()
    run.awaitTermination()
    assert spark.table("bins").count() > 0
