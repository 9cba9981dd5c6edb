"""The registered queries of the library: one for each operator, over whole tables."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geometry, projection, text, tileid
from ..operators import build, commands, counts, density, export, pyramid
from ..sources import mvt, regions, sinks
from ..sources.archive import COMPRESSION, TILE_TYPES, compress
from ..sources.scratch import base, materialise
from ..sources.tiles import read_tiles
from ..sources.writer import write_archive
from . import points as data

Z = 10
ROLL = 6
DENSE = 2

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def _placed(spark: SparkSession, sf_dir: str, z: int) -> DataFrame:
    return build.place(data.points(spark, sf_dir), z)


# --- tile algebra -----------------------------------------------------------------------------------------------


@query
def tile_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return data.points(spark, sf_dir).select("id", projection.tile_x("gx", Z).alias("tx"), projection.tile_y("gy", Z).alias("ty"))


@query
def pixel_quantize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _placed(spark, sf_dir, Z).select("id", "tx", "ty", F.col("px").cast("long").alias("px"), F.col("py").cast("long").alias("py"))


@query
def pixel_to_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _placed(spark, sf_dir, Z).select("id", projection.global_x("tx", "px", Z).alias("gx"), projection.global_y("ty", "py", Z).alias("gy"))


@query
def tile_hilbert_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _placed(spark, sf_dir, 15).select("id", "tile_id")


@query
def tile_id_inverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    tiles = _placed(spark, sf_dir, ROLL).select("tile_id").distinct()
    return tiles.select("tile_id", tileid.tile_xy("tile_id", ROLL).alias("t")).select("tile_id", "t.x", "t.y")


@query
def tile_bbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    tiles = _placed(spark, sf_dir, ROLL).select("tx", "ty").distinct()
    return tiles.select("tx", "ty", tileid.tile_box("tx", "ty", ROLL).alias("b")).select("tx", "ty", "b.xmin", "b.ymin", "b.xmax", "b.ymax")


@query
def tile_parent_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    tiles = _placed(spark, sf_dir, ROLL).select("tx", "ty").distinct()
    up = tiles.groupBy(tileid.parent("tx").alias("px"), tileid.parent("ty").alias("py"))
    return up.agg(F.count(F.lit(1)).alias("children"), F.min(F.col("ty").bitwiseAND(1) * 2 + F.col("tx").bitwiseAND(1)).alias("first_child"))


@query
def wgs84_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    span = data.points(spark, sf_dir).agg(F.min("gx").alias("x0"), F.max("gx").alias("x1"), F.min("gy").alias("y0"), F.max("gy").alias("y1"))
    e7 = lambda v: (v * 1e7).cast("long")
    return span.select(e7(projection.longitude("x0")).alias("min_lon_e7"), e7(projection.latitude("y0")).alias("min_lat_e7"), e7(projection.longitude("x1")).alias("max_lon_e7"), e7(projection.latitude("y1")).alias("max_lat_e7"))


# --- counts and densities ---------------------------------------------------------------------------------------


def _levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """z, x, y, n of a small pyramid: the highest zoom has all points, each lower one those whose id's low bits are 0."""
    tiles = _placed(spark, sf_dir, ROLL).groupBy("tx", "ty").agg(*[F.sum((F.col("id") % (1 << (ROLL - z)) == 0).cast("long")).alias(f"n{z}") for z in range(ROLL + 1)])
    shift = lambda c, z: F.shiftright(F.col(c), ROLL - z)
    each = F.array(*[F.struct(F.lit(z).alias("z"), shift("tx", z).alias("x"), shift("ty", z).alias("y"), F.col(f"n{z}").alias("n")) for z in range(ROLL + 1)])
    return tiles.select(F.explode(each).alias("r")).select("r.*").where("n > 0").groupBy("z", "x", "y").agg(F.sum("n").alias("n"))


@query
def count_tiles_zoom(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _placed(spark, sf_dir, ROLL).select(F.lit(ROLL).alias("z"), F.col("tx").alias("x"), F.col("ty").alias("y"), F.lit(1).alias("n"))
    return counts.count_zoom(rows, ROLL)


@query
def count_tiles_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.count_all(_levels(spark, sf_dir), 0, ROLL)


def _dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _placed(spark, sf_dir, DENSE).withColumn("z", F.lit(DENSE))


@query
def density_mt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return density.density(_dense(spark, sf_dir), **density.THREADED, tiles_only=True)


@query
def density_st(spark: SparkSession, sf_dir: str) -> DataFrame:
    return density.density(_dense(spark, sf_dir), **density.SINGLE, tiles_only=True)


@query
def density_compact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return density.density(_dense(spark, sf_dir), **density.THREADED, compact=True).drop("tile_x", "tile_y")


@query
def density_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = density.density(_dense(spark, sf_dir), **density.THREADED)
    return rows.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit("ALL")) for c in ("tile_x", "tile_y")})


# --- exports ----------------------------------------------------------------------------------------------------

BOX = export.Box(-5e6, -8e6, 9e6, 7e6)


def _pick(points: DataFrame) -> DataFrame:
    return points.select("id", "gene", "gx", "gy")


@query
def export_bbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pick(export.filter_points(data.points(spark, sf_dir), BOX))


@query
def export_partial_bbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pick(export.filter_points(data.points(spark, sf_dir), export.Box(xmax=1e6)))


@query
def export_polygon_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pick(export.filter_points(data.points(spark, sf_dir), rings=[data.CONCAVE]))


@query
def export_multipolygon(spark: SparkSession, sf_dir: str) -> DataFrame:
    shape = {"type": "Feature", "geometry": {"type": "MultiPolygon", "coordinates": [[[list(p) for p in r]] for r in data.PARTS]}}
    rings = spark.createDataFrame([([tuple(p) for p in r],) for r in regions.rings_of(json.loads(json.dumps(shape)))], "ring array<struct<x:double,y:double>>")
    return _pick(export.points_in_regions(data.points(spark, sf_dir), rings))


@query
def export_region_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles that overlap the boxes of the regions, and their points."""
    rings = [data.CROSS, data.NEGATIVE]
    tiles = _placed(spark, sf_dir, ROLL).groupBy("tx", "ty").agg(F.count(F.lit(1)).alias("n")).withColumn("b", tileid.tile_box("tx", "ty", ROLL))
    hit = F.lit(False)
    for x0, y0, x1, y1 in regions.boxes_of(rings):
        box = F.struct(F.lit(x0).alias("xmin"), F.lit(y0).alias("ymin"), F.lit(x1).alias("xmax"), F.lit(y1).alias("ymax"))
        hit = hit | geometry.boxes_overlap(F.col("b"), box)
    return tiles.where(hit).select("tx", "ty", "n")


@query
def export_bbox_and_polygon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pick(export.filter_points(data.points(spark, sf_dir), BOX, [data.CROSS, data.NEGATIVE]))


@query
def export_tsv_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.point_rows(data.points(spark, sf_dir), ["id", "gene", "cnt"])


@query
def export_geojson_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.geojson_lines(data.points(spark, sf_dir), ["id", "gene", "cnt"])


# --- polygons ---------------------------------------------------------------------------------------------------


@query
def polygon_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return data.polygons(spark, sf_dir).select("id", geometry.centroid("ring").alias("c")).select("id", "c.x", "c.y")


@query
def polygon_bbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    return data.polygons(spark, sf_dir).select("id", geometry.ring_box("ring").alias("b")).select("id", "b.xmin", "b.ymin", "b.xmax", "b.ymax")


@query
def polygon_bbox_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export.filter_polygons(data.polygons(spark, sf_dir), export.Box(-1e6, -1.5e6, 2e6, 2.5e6)).select("id")


@query
def polygon_region_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export.filter_polygons(data.polygons(spark, sf_dir), rings=data.PARTS).select("id")


@query
def polygon_region_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with the regions as a table, by their cells."""
    rings = spark.createDataFrame([(r,) for r in data.PARTS], "ring array<struct<x:double,y:double>>")
    return export.polygons_in_regions(data.polygons(spark, sf_dir), rings).select("id")


@query
def polygon_vertices_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return data.polygons(spark, sf_dir).select("id", sinks.vertices_text("ring").alias("Vertices"))


@query
def column_select_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export.polygon_rows(data.polygons(spark, sf_dir).withColumn("key", F.col("id").cast("string")), ["key", "label"])


# --- text, types and directories --------------------------------------------------------------------------------

_TYPED = """
select cast(l_linenumber as string) as a, case when l_orderkey % 11 = 0 then 'NA' else cast(l_partkey as string) end as b,
  case when l_orderkey % 3 = 0 then '' else concat(cast(l_suppkey as string), '.5') end as c, l_returnflag as d,
  case when l_orderkey % 2 = 0 then 'NA' else '' end as e, case when l_linenumber = 1 then '12abc' else '7' end as f
from {t}
"""


@query
def type_infer(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.sql(_TYPED, t=data.table(spark, sf_dir, "lineitem"))
    return build.infer_types(rows, ["a", "b", "c", "d", "e", "f"])


@query
def prefix_number_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = data.table(spark, sf_dir, "part").withColumn("v", F.expr("case p_partkey % 4 when 0 then concat(p_size, '.000000') when 1 then concat('  -', p_size, p_brand) when 2 then p_name else concat('+', p_partkey) end"))
    return rows.select("p_partkey", text.count_value("v").cast("long").alias("cnt"), text.prefix_double("v").alias("num"))


@query
def busiest_tile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build.busiest_tile(_placed(spark, sf_dir, ROLL).groupBy("tile_id").agg(F.count(F.lit(1)).alias("n")))


@query
def directory_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of each tile in the listing: by zoom, x, then y from below."""
    tiles = _levels(spark, sf_dir).select("z", "x", "y")
    before = Window.partitionBy("z", "x").orderBy(F.desc("y"))
    columns = tiles.groupBy("z", "x").agg(F.count(F.lit(1)).alias("n"))
    starts = columns.withColumn("start", F.sum("n").over(Window.partitionBy("z").orderBy("x")) - F.col("n"))
    return tiles.withColumn("k", F.row_number().over(before)).join(starts, ["z", "x"]).select("z", "x", "y", (F.col("start") + F.col("k")).cast("long").alias("place"))


def _lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _placed(spark, sf_dir, ROLL).groupBy("tile_id").agg((F.count(F.lit(1)) * 13 + 21).alias("length"))


@query
def directory_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offsets by prefix sums in two steps: within blocks of tile ids, then over blocks."""
    tiles = _lengths(spark, sf_dir).withColumn("block", F.shiftright("tile_id", 8))
    blocks = tiles.groupBy("block").agg(F.sum("length").alias("total"))
    blocks = blocks.select("block", (F.sum("total").over(Window.partitionBy(F.lit(0)).orderBy("block")) - F.col("total")).alias("start"))
    own = F.sum("length").over(Window.partitionBy("block").orderBy("tile_id")) - F.col("length")
    return tiles.withColumn("own", own).join(blocks, "block").select("tile_id", F.col("length").cast("long").alias("length"), (F.col("start") + F.col("own")).cast("long").alias("offset"))


@query
def run_length_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries with runs to addressed tiles."""
    entries = data.table(spark, sf_dir, "supplier").select((F.col("s_suppkey") * 40).cast("long").alias("first"), (F.col("s_suppkey") % 7 + 1).cast("long").alias("run"), (F.col("s_suppkey") * 1000).cast("long").alias("offset"))
    return entries.select(F.explode(F.sequence("first", F.col("first") + F.col("run") - 1)).alias("tile_id"), "offset")


# --- pyramids ---------------------------------------------------------------------------------------------------

LIMIT_N, LIMIT_BYTES, TOP = 400, 12_000, 4


def _parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """n and estimated bytes of each parent at zoom 3 of tiles at zoom 4."""
    tiles = _placed(spark, sf_dir, TOP).groupBy("tx", "ty").agg(F.count(F.lit(1)).alias("n"))
    up = tiles.groupBy(F.shiftright("tx", 1).alias("tx"), F.shiftright("ty", 1).alias("ty"))
    return up.agg(F.sum("n").cast("long").alias("n"), (F.sum("n") * 9 + 100).cast("long").alias("bytes")).withColumn("est", F.col("bytes") * 10)


@query
def pyramid_level_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pyramid.level_ratio(_parents(spark, sf_dir), LIMIT_BYTES, LIMIT_N)


def _caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    parents = _parents(spark, sf_dir)
    return parents.crossJoin(F.broadcast(pyramid.level_ratio(parents, LIMIT_BYTES, LIMIT_N))).withColumn("cap", pyramid.tile_cap(F.col("n"), F.col("ratio")))


@query
def pyramid_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _caps(spark, sf_dir).select("tx", "ty", "n", "cap")


def _sampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pyramid.sample(_placed(spark, sf_dir, TOP - 1), _caps(spark, sf_dir).select("tx", "ty", "cap", "n"), TOP - 1, idx="id")


@query
def pyramid_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sampled(spark, sf_dir).select("tx", "ty", "id")


@query
def pyramid_level_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = _placed(spark, sf_dir, TOP).select(F.lit(TOP).alias("zoom"), "id").unionByName(_sampled(spark, sf_dir).select(F.lit(TOP - 1).alias("zoom"), "id"))
    return top.groupBy("zoom").agg(F.count(F.lit(1)).alias("kept"))


@query
def pyramid_size_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _caps(spark, sf_dir).select("tx", "ty", pyramid.column_cap(F.col("cap"), 3, 1200, 1.0).alias("cap"))


@query
def attr_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct values of an attribute in a tile, numbered in order of first appearance."""
    first = _placed(spark, sf_dir, DENSE).groupBy("tx", "ty", "gene").agg(F.min("id").alias("first"))
    return first.withColumn("code", F.row_number().over(Window.partitionBy("tx", "ty").orderBy("first")) - 1).select("tx", "ty", "gene", F.col("code").cast("long").alias("code"))


# --- archives -------------------------------------------------------------------------------------


def _archive(spark: SparkSession, sf_dir: str, codec: str, zoom: int = 3) -> str:
    path = f"{base(spark)}/points-{codec}-{uuid.uuid4().hex}.archive"
    rows = data.points(spark, sf_dir).select("gx", "gy", F.col("id").alias("seq"), "id", "gene", F.col("cnt").alias("count"))
    build.write_points(build.place(rows, zoom), path, zoom, codec, "points", {"id": "INT", "gene": "STRING", "count": "INT"})
    return path


def _roundtrip(spark: SparkSession, sf_dir: str, codec: str) -> DataFrame:
    found = commands.export(spark, _archive(spark, sf_dir, codec))
    own = data.points(spark, sf_dir).select(F.col("id").cast("string").alias("id"), F.col("gx").alias("x0"), F.col("gy").alias("y0"))
    near = projection.scale(3) * 0.51 + 0.01
    number, count = F.col("id").cast("long"), F.col("count").cast("long")
    # sums over products of a point's id and its attributes: a value lost or on another point changes them
    kept = {"ids": F.sum(number), "counts": F.sum(count * (number % 1009)), "genes": F.sum((F.ascii("gene") * 31 + F.length("gene")) * (number % 1009)), "kinds": F.count_distinct("gene")}
    return found.join(own, "id").agg(F.count(F.lit(1)).alias("n"), *[v.cast("long").alias(k) for k, v in kept.items()], F.coalesce(F.sum(F.when((F.abs(F.col("gx") - F.col("x0")) <= near) & (F.abs(F.col("gy") - F.col("y0")) <= near), 0).otherwise(1)), F.lit(0)).cast("long").alias("far"))


@query
def archive_roundtrip_mlt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _roundtrip(spark, sf_dir, "mlt")


@query
def archive_roundtrip_mvt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _roundtrip(spark, sf_dir, "mvt")


@query
def archive_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return commands.summarize(spark, _archive(spark, sf_dir, "mlt"))[2].select("z", "x", "y", "tile_id")


@query
def archive_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    return commands.summarize(spark, _archive(spark, sf_dir, "mvt"))[0].select("addressed_tiles_count", "tile_entries_count", "tile_type", "tile_compression", "clustered", "min_zoom", "max_zoom", "center_zoom")


@query
def archive_tiles_in_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filters become intervals of the curve, which choose leaves and entries."""
    found = read_tiles(spark, _archive(spark, sf_dir, "mlt", 5), data=False)
    return found.where("z = 5 and x between 3 and 21 and y <= 13 and y <> 7").select("z", "x", "y", "tile_id")


def _polygon_archive(spark: SparkSession, sf_dir: str, zoom: int) -> str:
    """Triangles at the points of the plane, with an id and the point's category."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("id")
        x, y = (table.column(c).to_numpy() for c in ("px", "py"))
        xs, ys = np.column_stack([x, x + 9, x]).ravel(), np.column_stack([y, y, y + 6]).ravel()
        data = mvt.encode_rings("cells", xs, ys, np.full(len(x), 3), {"id": table.column("id"), "gene": table.column("gene")})
        return pa.table({"tile_id": table.column("tile_id")[:1], "data": pa.array([compress(data)], pa.binary())})

    path = f"{base(spark)}/polygons-{uuid.uuid4().hex}.archive"
    tiles = _placed(spark, sf_dir, zoom).select("tile_id", "px", "py", "id", "gene").groupBy("tile_id").applyInArrow(run, "tile_id long, data binary")
    header = {"tile_type": TILE_TYPES["mvt"], "tile_compression": COMPRESSION["gzip"], "min_zoom": zoom, "max_zoom": zoom}
    write_archive(tiles, path, header, {"vector_layers": [{"id": "cells", "fields": {"id": "Number", "gene": "String"}, "minzoom": zoom, "maxzoom": zoom}]})
    return path


@query
def archive_polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Polygons written to an archive come back with their attributes, their mean vertex within half a pixel."""
    found = commands.export_polygon(spark, _polygon_archive(spark, sf_dir, 3), ["id", "gene"])
    s = projection.scale(3)
    own = data.points(spark, sf_dir).select(F.col("id").cast("string").alias("id"), (F.col("gx") + 3 * s).alias("x0"), (F.col("gy") - 2 * s).alias("y0"))
    near = (F.abs(F.col("X").cast("double") - F.col("x0")) <= s * 0.51 + 0.01) & (F.abs(F.col("Y").cast("double") - F.col("y0")) <= s * 0.51 + 0.01)
    return found.join(own, "id").select(F.col("id").cast("long").alias("id"), "gene", near.alias("near"))


@query
def archive_polygons_in_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Polygons of an archive whose box meets a box, counted by category; bounds lie between pixels."""
    found = commands.export_polygon(spark, _polygon_archive(spark, sf_dir, 3), ["id", "gene"], xmin=-9_000_100.5, xmax=7_000_100.5, ymax=8_000_100.5)
    own = data.points(spark, sf_dir).select(F.col("id").cast("string").alias("id"), "gx", "gy")
    s = projection.scale(3)
    # those within a pixel of a bound may round to either side
    sure = (F.col("gx") + 9 * s > -9_000_100.5 + s) & (F.col("gx") < 7_000_100.5 - s) & (F.col("gy") - 6 * s < 8_000_100.5 - s)
    return found.join(own, "id").where(sure).groupBy("gene").agg(F.count(F.lit(1)).alias("n"))


@query
def archive_pyramid(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = _archive(spark, sf_dir, "mlt")
    out = source.replace(".archive", "-pyramid.archive")
    commands.build_pyramid(spark, source, out, 0, max_tile_features=500)
    return materialise(commands.count_tiles(spark, out), "pyramid-counts")
