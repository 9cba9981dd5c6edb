"""Tiles encoded in chunks by several tasks against the same tiles encoded by one."""

import random

import pytest
from pyspark.sql import functions as F

from gridloom.operators import build
from gridloom.sources import mlt
from gridloom.sources.archive import decompress

TYPES = {"i": "INT", "f": "FLOAT", "s": "STRING", "none": "INT"}


@pytest.mark.parametrize("n", [0, 1, 1023, 1024, 1025, 5000])
def test_joined_chunks_are_the_tile(n):
    rng = random.Random(n)
    xs, ys = [rng.randint(-9, 4100) for _ in range(n)], [rng.randint(-9, 4100) for _ in range(n)]
    columns = {"i": [rng.choice([None, 1, -(1 << 31), 1 << 40]) for _ in range(n)], "f": [rng.random() for _ in range(n)], "s": [rng.choice([None, "", "é" * 300]) for _ in range(n)]}
    types = {"i": "int", "f": "float", "s": "string"}
    for nullable in (None, {"i": True, "f": True, "s": True}):
        whole = mlt.encode_layer("layer", xs, ys, columns, types, nullable)
        parts = [slice(k, k + 1024) for k in range(0, max(1, n), 1024)]
        chunks = [mlt.encode_chunk(xs[p], ys[p], {c: v[p] for c, v in columns.items()}, types) for p in parts]
        assert mlt.join_chunks("layer", chunks, types, nullable) == whole


@pytest.mark.parametrize("nullable", [None, {"i": True, "f": False, "s": True, "none": True}])
def test_tiles_of_several_tasks(spark, nullable):
    """One tile with most points, a middling one, and small ones; the order is that of seq however rows lie."""
    n = 9000
    tile = F.when(F.col("id") % 10 < 7, 0).when(F.col("id") % 10 < 9, 1).otherwise(2 + F.col("id") % 90)
    rows = spark.range(n).select(tile.cast("long").alias("tile_id"), (F.col("id") % 4096).cast("int").alias("px"), (F.col("id") * 7 % 4096).cast("int").alias("py"), ((F.col("id") * 7919) % 9001).alias("seq"), F.when(F.col("id") % 5 > 0, F.col("id") - 40).alias("i"), (F.col("id") / 3).alias("f"), F.when(F.col("id") % 3 > 0, F.concat(F.lit("v"), F.col("id") % 77)).alias("s"), F.lit(None).cast("long").alias("none"))
    found = {r["tile_id"]: r for r in build.encode_tiles(rows.repartition(6), "mlt", "layer", TYPES, nullable, chunk=1024).collect()}
    whole = {r["tile_id"]: r for r in build.encode_tiles(rows, "mlt", "layer", TYPES, nullable).collect()}
    assert set(found) == set(whole) and found[0]["n"] == 6300 > 1024
    for k in whole:
        assert found[k]["n"] == whole[k]["n"] and decompress(bytes(found[k]["data"]), 2) == decompress(bytes(whole[k]["data"]), 2)


def test_places_within_keys(spark):
    rng = random.Random(1)
    rows = [(rng.choice([1, 1, 1, 1, 2, 3]), k) for k in rng.sample(range(100_000), 4000)]
    found = build.numbered(spark.createDataFrame(rows, "k long, o long").repartition(7), "k", "o", "place").collect()
    expected = {}
    for k in (1, 2, 3):
        expected |= {(k, o): nth for nth, o in enumerate(sorted(o for own, o in rows if own == k))}
    assert {(r["k"], r["o"]): r["place"] for r in found} == expected and len(found) == 4000
