"""Sums over squares against adding up cell by cell, and samples against ranking whole tiles."""

import random
from collections import Counter

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from gridloom.operators import density, dyadic, pyramid


@pytest.mark.parametrize("levels", [1, 2, 3, 4, 13])
def test_sums_of_all_widths(spark, levels):
    rng = random.Random(levels)
    cells = [(k % 3, rng.randint(-9, 70), rng.randint(-70, 9), rng.choice([-2, 0, 1, 5])) for k in range(600)]
    expected = Counter()
    for key, x, y, s in cells:
        for i in range(levels):
            expected[key, i, x >> i, y >> i] += s
    found = dyadic.dyadic_sums(spark.createDataFrame(cells, "k int, bx long, by long, s long").repartition(5), levels, ("k",))
    assert Counter({(r["k"], r["i"], r["bx"], r["by"]): r["s"] for r in found.collect()}) == expected and found.count() == len(set(expected))
    for x in set(expected):  # sums of 0 are rows too
        assert expected[x] is not None
    none = dyadic.dyadic_sums(spark.createDataFrame([], "bx long, by long, s long"), levels)
    assert none.count() == 0 and none.columns == ["i", "bx", "by", "s"]


def shuffled_rows(spark, df):
    """Records that all exchanges of a query wrote."""
    df.write.format("noop").mode("overwrite").save()
    store = spark._jsparkSession.sharedState().statusStore()
    last = store.executionsList().last()
    values = store.executionMetrics(last.executionId())
    names = {m.accumulatorId(): m.name() for m in (last.metrics().apply(k) for k in range(last.metrics().size()))}
    out = 0
    for key, name in names.items():
        if name == "shuffle records written" and values.contains(key):
            out += int(values.apply(key).split("\n")[-1].split(" ")[0].replace(",", ""))
    return out


def test_dense_pixels_are_shuffled_once(spark):
    """A row for each block of four by four pixels and less for all wider bins."""
    n = 1 << 18
    points = spark.range(n).select(F.lit(0).alias("z"), F.lit(0).cast("long").alias("tx"), F.lit(0).cast("long").alias("ty"), (F.col("id") % 512).cast("int").alias("px"), (F.col("id") / 512).cast("int").alias("py"), F.lit(1).alias("cnt"))
    assert 0 < shuffled_rows(spark, density.bin_sums(points, 13, True)) <= 1.5 * n


def ranked_whole(points, caps, z):
    order = F.md5(F.concat_ws("|", pyramid.seed_of(z, "tx", "ty").cast("string"), F.col("idx").cast("string")))
    rank = F.row_number().over(Window.partitionBy("tx", "ty").orderBy(order, "idx"))
    rows = points.join(caps.select("tx", "ty", "cap"), ["tx", "ty"]).withColumn("pick", rank).where("pick <= cap")
    return sorted((r["tx"], r["ty"], r["idx"], r["pick"]) for r in rows.collect())


@pytest.mark.parametrize("ranked", [1, 7, 300, 1_000_000])
def test_samples_equal_ranking_whole_tiles(spark, ranked):
    rng = random.Random(ranked)
    rows = [(rng.choice([0, 0, 0, 1]), rng.choice([0, 5]), rng.randint(0, 1500) if k % 4 else 7, f"v{k}") for k in range(2500)]
    points = spark.createDataFrame(rows, "tx long, ty long, idx long, v string").repartition(6)
    counts = points.groupBy("tx", "ty").count().withColumnRenamed("count", "n")
    for cap in (F.lit(1), F.lit(40), F.floor(F.col("n") * 0.6), F.col("n"), F.col("n") + 5):
        caps = counts.withColumn("cap", cap.cast("long"))
        kept = pyramid.sample(points, caps, 3, ranked=ranked)
        assert kept.columns == points.columns
        found = sorted((r["tx"], r["ty"], r["idx"], r["pick"]) for r in pyramid.picked(kept, 3).collect())
        assert found == ranked_whole(points, caps, 3)


def test_what_is_ranked_is_small(spark):
    """One tile with all points: of 200,000 no more than a few are under its threshold's prefix."""
    points = spark.range(200_000).select(F.lit(0).cast("long").alias("tx"), F.lit(0).cast("long").alias("ty"), F.col("id").alias("idx"))
    caps = spark.createDataFrame([(0, 0, 50_000, 200_000)], "tx long, ty long, cap long, n long")
    r = pyramid.thresholds(points, caps, 0, ranked=1000).first()
    assert 0 < r["size"] <= 30 and r["before"] < 50_000 <= r["before"] + r["size"]
    assert pyramid.sample(points, caps, 0, ranked=1000).count() == 50_000
