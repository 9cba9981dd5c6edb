import math
import time

import pytest
from pyspark.sql import functions as F

from gridloom.functions import geometry, projection, text, tileid
from gridloom.operators import export
from gridloom.sources import regions

SQUARE = [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0), (0.0, 0.0)]


def test_known_ids():
    assert [tileid.id_of(0, 0, 0), tileid.id_of(1, 0, 0), tileid.id_of(1, 0, 1), tileid.id_of(1, 1, 1), tileid.id_of(1, 1, 0)] == [0, 1, 2, 3, 4]
    with pytest.raises(ValueError):
        tileid.id_of(3, 8, 0)


def test_ids_are_a_bijection(spark):
    for z in range(7):
        n = 1 << z
        tiles = spark.range(n * n).select((F.col("id") / n).cast("long").alias("x"), (F.col("id") % n).alias("y"))
        rows = tiles.withColumn("t", tileid.tile_id("x", "y", z)).withColumn("b", tileid.tile_xy("t", z)).collect()
        assert sorted(r["t"] for r in rows) == list(range(tileid.first_id(z), tileid.first_id(z + 1)))
        assert all(r["t"] == tileid.id_of(z, r["x"], r["y"]) and tuple(r["b"]) == (r["x"], r["y"]) for r in rows)
        assert all(tileid.zxy_of(r["t"]) == (z, r["x"], r["y"]) for r in rows[:50])


def test_deep_ids(spark):
    rows = spark.range(500).select(F.pmod(F.col("id") * 7919 * 7919, F.lit(1 << 15)).alias("x"), F.pmod(F.col("id") * 104729, F.lit(1 << 15)).alias("y"))
    for r in rows.withColumn("t", tileid.tile_id("x", "y", 15)).collect():
        assert r["t"] == tileid.id_of(15, r["x"], r["y"])


def test_round_trip_within_half_a_pixel(spark):
    rows = spark.range(2000).select(((F.col("id") * 7919) % 36000 - 18000).cast("double").alias("a"), ((F.col("id") * 104729) % 35999 - 18000).cast("double").alias("b"))
    rows = rows.select((F.col("a") * 1000 + 0.37).alias("gx"), (F.col("b") * 1000 - 0.21).alias("gy"))
    z = 12
    t = rows.withColumns({"tx": projection.tile_x("gx", z), "ty": projection.tile_y("gy", z)})
    t = t.withColumns({"px": projection.pixel(projection.local_x("gx", "tx", z)), "py": projection.pixel(projection.local_y("gy", "ty", z))})
    t = t.withColumns({"dx": F.abs(projection.global_x("tx", "px", z) - F.col("gx")), "dy": F.abs(projection.global_y("ty", "py", z) - F.col("gy"))})
    worst = t.agg(F.max("dx"), F.max("dy"), F.min("px"), F.max("px")).first()
    assert worst[0] <= projection.scale(z) / 2 + 1e-4 and worst[1] <= projection.scale(z) / 2 + 0.0095 and worst[2] >= 0 and worst[3] <= 4096


def test_edges_of_the_plane(spark):
    inf = float("inf")
    rows = spark.createDataFrame([(inf, 0.0), (-inf, 0.0), (float("nan"), 0.0), (projection.HALF, 0.0), (-projection.HALF, 0.0), (0.0, 0.0)], "gx double, gy double")
    found = [r[0] for r in rows.select(projection.in_plane("gx", "gy", 5)).collect()]
    assert found == [False, False, False, False, True, True]


def test_wgs84(spark):
    r = spark.range(1).select(projection.longitude(F.lit(projection.HALF)), projection.latitude(F.lit(0.0)), projection.latitude(F.lit(math.pi * projection.RADIUS))).first()
    assert abs(r[0] - 180) < 1e-6 and abs(r[1]) < 1e-12 and abs(r[2] - 85.0511287798) < 1e-8


def test_point_in_ring_is_half_open(spark):
    rows = spark.createDataFrame([(5.0, 5.0), (0.0, 0.0), (10.0, 5.0), (5.0, 10.0), (5.0, 0.0), (-1.0, 5.0)], "x double, y double")
    ring = F.array(*[F.struct(F.lit(a).alias("x"), F.lit(b).alias("y")) for a, b in SQUARE])
    literal = [r[0] for r in rows.select(geometry.in_any_region("x", "y", [SQUARE])).collect()]
    assert literal == [r[0] for r in rows.select(geometry.in_ring("x", "y", ring)).collect()] == [True, True, False, False, True, False]


def test_boxes_that_cross_overlap(spark):
    box = lambda *v: F.struct(*[F.lit(float(x)).alias(n) for x, n in zip(v, ("xmin", "ymin", "xmax", "ymax"), strict=True)])
    r = spark.range(1).select(geometry.boxes_overlap(box(-10, -1, 10, 1), box(-1, -10, 1, 10)), geometry.boxes_overlap(box(0, 0, 1, 1), box(1, 1, 2, 2)), geometry.boxes_overlap(box(0, 0, 1, 1), box(2, 0, 3, 1))).first()
    assert tuple(r) == (True, True, False)


def test_negative_ring_box_and_centroid(spark):
    ring = F.array(*[F.struct(F.lit(a).alias("x"), F.lit(b).alias("y")) for a, b in [(-9.0, -9.0), (-3.0, -9.0), (-3.0, -3.0), (-9.0, -9.0)]])
    r = spark.range(1).select(geometry.ring_box(ring), geometry.centroid(ring)).first()
    assert tuple(r[0]) == (-9.0, -9.0, -3.0, -3.0) and tuple(r[1]) == (-5.0, -7.0)
    open_ring = F.array(*[F.struct(F.lit(a).alias("x"), F.lit(b).alias("y")) for a, b in [(0.0, 0.0), (1.0, 0.0)]])
    with pytest.raises(Exception, match="not closed"):
        spark.range(1).select(geometry.centroid(open_ring)).collect()


def test_boxes_with_open_sides():
    assert not export.Box().active and not export.Box(xmin=float("-inf")).active and export.Box(xmax=1.0).active
    limits = export.tile_limits(10, export.Box(xmax=1e6))
    assert limits["x_from"] is None and limits["y_from"] is None and limits["x_to"] == 537


def test_prune_never_loses_a_point(spark):
    rows = spark.range(4000).select((((F.col("id") * 7919) % 36000) * 1000.0 - 18e6).alias("gx"), (((F.col("id") * 104729) % 35999) * 1000.0 - 18e6).alias("gy"))
    z = 6
    rows = rows.withColumns({"z": F.lit(z), "x": projection.tile_x("gx", z), "y": projection.tile_y("gy", z)})
    box = export.Box(-3e6, -7e6, 5e6, 2e6)
    assert export.filter_points(export.prune_tiles(rows, z, box), box).count() == export.filter_points(rows, box).count() > 0


def test_region_files(tmp_path):
    path = tmp_path / "r.json"
    path.write_text('{"geometry": {"type": "Feature", "geometry": {"type": "MultiPolygon", "coordinates": [[[[0,0],[1,0],[1,1],[0,0]]],[[[5,5,9],[6,5],[6,6],[5,5]]]]}}}')
    assert regions.read_regions(str(path)) == [[(0, 0), (1, 0), (1, 1), (0, 0)], [(5, 5), (6, 5), (6, 6), (5, 5)]]
    with pytest.raises(ValueError):
        regions.rings_of({"type": "Polygon", "coordinates": [[[0, 0]], [[1, 1]]]})
    with pytest.raises(ValueError):
        regions.rings_of({"type": "Point", "coordinates": [0, 0]})


def test_number_text(spark):
    rows = spark.createDataFrame([(0.0625,), (1.0005,), (-2.5,), (1e7,), (123456.789,)], "v double")
    assert [r[0] for r in rows.select(text.fixed("v")).collect()] == ["0.062", "1.000", "-2.500", "10000000.000", "123456.789"]
    values = [0.0, 1.0, 0.5, 1 / 3, 123456.0, 1e-5, 0.00012345678, 1.5e300, 99999.5, 2.5]
    rows = spark.createDataFrame([(v,) for v in values], "v double")
    assert [r[0] for r in rows.select(text.general("v", 5)).collect()] == [f"{v:.5g}" for v in values]
    assert [r[0] for r in rows.select(text.general("v", 9)).collect()] == [f"{v:.9g}" for v in values]


def test_prefix_numbers(spark):
    rows = spark.createDataFrame([("5.000000",), ("12abc",), ("abc",), (" -7",), ("99999999999",), (None,), ("1.5e3x",), (".5",), ("",)], "v string")
    found = rows.select(text.count_value("v"), text.prefix_double("v")).collect()
    assert [r[0] for r in found] == [5, 12, 0, -7, 0, 0, 1, 0, 0]
    assert [r[1] for r in found] == [5.0, 12.0, None, -7.0, 99999999999.0, None, 1500.0, 0.5, None]
    assert [r[0] for r in rows.select(text.filled("v")).collect()][5] == "NA"


@pytest.mark.parametrize("z", [1, 6, 15, 31])
def test_tile_numbers_meet_predicates(spark, z):
    """Filters and joins on a computed number are planned at once, and are right."""
    n = 1 << z
    places = [(k * 7919 % n, k * 104729 % n) for k in range(50)]
    rows = tileid.with_tile_id(spark.createDataFrame([(x, y, "t") for x, y in places], "`x` long, y long, `a b` string"), "x", "y", z)
    numbers = sorted(tileid.id_of(z, x, y) for x, y in places)
    low, high, some = numbers[10], numbers[40], numbers[::7]
    began = time.monotonic()
    found = lambda r: sorted(x["tile_id"] for x in r.select("tile_id").collect())
    assert found(rows.where(F.col("tile_id") > low)) == [v for v in numbers if v > low]
    assert found(rows.where(F.col("tile_id").between(low, high))) == [v for v in numbers if low <= v <= high]
    assert found(rows.where(F.col("tile_id").isin(some))) == [v for v in numbers if v in some]
    assert found(rows.where("tile_id = tile_id + 0 and x >= 0")) == numbers
    other = spark.createDataFrame([(v,) for v in set(some)], "tile_id long")
    assert found(rows.join(other, "tile_id")) == [v for v in numbers if v in some]
    assert found(rows.join(other, "tile_id", "left_anti")) == [v for v in numbers if v not in some]
    assert rows.columns == ["x", "y", "a b", "tile_id"]
    assert time.monotonic() - began < 40
