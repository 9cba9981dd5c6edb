"""Regions as cells against testing every point with every ring."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from gridloom.functions.geometry import in_ring
from gridloom.functions.projection import HALF
from gridloom.operators import cover, export

RINGS = "ring array<struct<x:double,y:double>>"


def star(rng, n, cx, cy, size):
    """A ring of n vertices around a place, with spikes; closed every other time."""
    ring = [(cx + size * rng.uniform(0.2, 1) * math.cos(2 * math.pi * k / n), cy + size * rng.uniform(0.2, 1) * math.sin(2 * math.pi * k / n)) for k in range(n)]
    return ring + ring[:1] if rng.random() < 0.5 else ring


def test_points_of_many_regions(spark):
    rng = random.Random(6)
    rings = [star(rng, rng.choice([3, 5, 40, 700]), rng.uniform(-1.5e7, 1.5e7), rng.uniform(-1.5e7, 1.5e7), rng.choice([2e3, 1e5, 3e6, 1.2e7])) for _ in range(40)]
    rings += [[(-1e6, -1e6), (1e6, -1e6), (1e6, 1e6), (-1e6, 1e6), (-1e6, -1e6)], [(0.0, 0.0)], [(5.0, 5.0), (9.0, 9.0)]]
    rings += [[(-HALF, -HALF), (HALF, -HALF), (HALF, 0.0), (-HALF, 0.0)]]
    regions = spark.createDataFrame([(r,) for r in rings] + [(None,), ([],)], RINGS)
    places = [(rng.uniform(-1.6e7, 1.6e7), rng.uniform(-1.6e7, 1.6e7)) for _ in range(4000)]
    places += [p for r in rings[:20] for p in r[:20]] + [(x * 1e6, y * 1e6) for x in (-1, 0, 1) for y in (-1, 0, 1)] + places[:50]
    for r in rings[:30]:  # near edges
        for (ax, ay), (bx, by) in zip(r[:8], r[1:9], strict=False):
            t = rng.random()
            places += [(ax + t * (bx - ax) + d, ay + t * (by - ay)) for d in (-1e-3, 0.0, 1e-3, 40.0)]
    rows = [(k, *p) for k, p in enumerate(places)] + [(-1, None, 0.0), (-2, float("nan"), 0.0)]
    points = spark.createDataFrame(rows, "id long, gx double, gy double").withColumn("inside", F.lit("x"))
    for some in (regions, regions.limit(3), regions.limit(0)):
        brute = points.join(some.select(F.col("ring").alias("_r")), in_ring("gx", "gy", "_r"), "left_semi")
        found = export.points_in_regions(points, some)
        assert found.columns == points.columns
        assert sorted(r["id"] for r in found.collect()) == sorted(r["id"] for r in brute.collect())


def test_few_points_of_a_large_region_are_tested():
    """Of points around a ring of very many vertices fewer than a tenth of (point, edge) pairs are looked at."""
    rng = random.Random(7)
    ring = [(3e5 * (1 + 0.02 * rng.random()) * math.cos(2 * math.pi * k / 10_000), 3e5 * (1 + 0.02 * rng.random()) * math.sin(2 * math.pi * k / 10_000)) for k in range(10_000)]
    level, cells = cover.cells_of(np.array(ring))
    w, by_cell = 2 * HALF / (1 << level), {(x, y): (inside, edges) for x, y, inside, edges in cells}
    tests = edges_seen = wrong = 0
    for _ in range(3000):
        x, y = rng.uniform(-3.2e5, 3.2e5), rng.uniform(-3.2e5, 3.2e5)
        inside, edges = by_cell.get((math.floor((x + HALF) / w), math.floor((y + HALF) / w)), (False, None))
        if edges is not None:
            tests, edges_seen, inside = tests + 1, edges_seen + len(edges), cover._inside(edges, x, y)
        wrong += inside != cover._inside(np.concatenate([np.array(ring), np.roll(np.array(ring), 1, axis=0)], axis=1), x, y)
    assert not wrong and tests < 600 and edges_seen < 3000 * 10_000 / 100
    assert sum(len(e) for *_, e in cells if e is not None) < 20 * len(ring)


def test_polygons_of_many_regions(spark):
    """The same rows as with literal rings, one by one."""
    rng = random.Random(8)
    rings = [star(rng, rng.choice([3, 5, 40]), rng.uniform(-1e6, 1e6), rng.uniform(-1e6, 1e6), rng.choice([2e3, 1e5, 4e5])) for _ in range(25)]
    shapes = [(k, star(rng, rng.choice([3, 6, 20]), rng.uniform(-1.3e6, 1.3e6), rng.uniform(-1.3e6, 1.3e6), rng.choice([1e3, 3e4, 9e5]))) for k in range(150)] + [(900, None), (901, []), (902, rings[0])]
    polygons = spark.createDataFrame(shapes, f"id long, {RINGS}").withColumn("region", F.lit("x")).repartition(4)
    for some in (rings, rings[:1], []):
        found = export.polygons_in_regions(polygons, spark.createDataFrame([(r,) for r in some], RINGS))
        expected = export.filter_polygons(polygons.where(F.size("ring") > 0), rings=some) if some else polygons.limit(0)
        assert found.columns == polygons.columns
        assert sorted(r["id"] for r in found.collect()) == sorted(r["id"] for r in expected.collect())
