"""The derived tables that the registered queries run on, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: A plane of points from `events`: spread by two primes, with a small count and a category.
POINTS_SPARK = """
select event_id as id, user_id, event_type as gene, cast(value as bigint) % 7 as cnt,
  (cast((event_id * 7919) % 1000003 as double) / cast(1000003 as double)) * cast(36000000 as double) - cast(18000000 as double) as gx,
  (cast((event_id * 104729) % 999983 as double) / cast(999983 as double)) * cast(36000000 as double) - cast(18000000 as double) as gy
from events
"""
POINTS_SQL = POINTS_SPARK.replace("cast(value as bigint)", "cast(trunc(value) as bigint)")

#: Octagon-like rings around customers' places, of whole-number offsets.
RING_OFFSETS = ((-3000, -4000), (5000, -3000), (4000, 2500), (-1000, 6000), (-6000, 1000))
_VERTICES_SPARK = ", ".join(f"named_struct('x', cx + cast({dx} as double), 'y', cy + cast({dy} as double))" for dx, dy in (*RING_OFFSETS, RING_OFFSETS[0]))
POLYGONS_SPARK = f"""
select c_custkey as id, c_mktsegment as segment, case when c_custkey % 5 = 0 then '' when c_custkey % 7 = 0 then null else c_name end as label, array({_VERTICES_SPARK}) as ring
from (select *, cast((c_custkey * 7919) % 1009 - 504 as double) * cast(10000 as double) as cx, cast((c_custkey * 104729) % 997 - 498 as double) * cast(12000 as double) as cy from customer) c
"""
_VERTICES_SQL = ", ".join(f"{{'x': cx + cast({dx} as double), 'y': cy + cast({dy} as double)}}" for dx, dy in (*RING_OFFSETS, RING_OFFSETS[0]))
POLYGONS_SQL = POLYGONS_SPARK.replace(f"array({_VERTICES_SPARK})", f"[{_VERTICES_SQL}]")

#: A concave region, a square with negative coordinates only, a thin cross, and two disjoint parts.
CONCAVE = [(-1e7, -1e7), (1e7, -8e6), (5e6, 9e6), (0.0, 2e6), (-6e6, 1.1e7), (-1e7, -1e7)]
NEGATIVE = [(-9e6, -9e6), (-2e6, -9e6), (-2e6, -3e6), (-9e6, -3e6), (-9e6, -9e6)]
CROSS = [(-1.7e7, -2e5), (-2e5, -2e5), (-2e5, -1.7e7), (2e5, -1.7e7), (2e5, -2e5), (1.7e7, -2e5), (1.7e7, 2e5), (2e5, 2e5), (2e5, 1.7e7), (-2e5, 1.7e7), (-2e5, 2e5), (-1.7e7, 2e5), (-1.7e7, -2e5)]
PARTS = [[(1e6, 1e6), (7e6, 2e6), (6e6, 8e6), (2e6, 6e6), (1e6, 1e6)], [(-1.5e7, -1.4e7), (-9e6, -1.3e7), (-1.2e7, -6e6), (-1.5e7, -1.4e7)]]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(POINTS_SPARK.replace("from events", "from {e}"), e=table(spark, sf_dir, "events"))


def polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(POLYGONS_SPARK.replace("from customer", "from {c}"), c=table(spark, sf_dir, "customer"))
