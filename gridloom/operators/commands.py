"""The eight commands over archives, as functions that return DataFrames or write files."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import count_value
from ..sources.archive import NAMES, Archive, open_front
from ..sources.regions import Ring, read_regions
from ..sources.tiles import count_features, read_points, read_polygons, read_tiles, typed
from . import counts, density
from .build import build_points
from .export import Box, filter_points, filter_polygons, polygon_rows, prune_tiles
from .pyramid import build_pyramid

__all__ = ["build_points", "build_pyramid", "count_tiles", "export", "export_polygon", "summarize", "summary_lines", "summary_text", "tile_density_stats", "tile_density_stats_mt"]


def _zoom(archive: Archive, zoom: int) -> int:
    """-1 is the highest zoom; others must lie in the archive's range."""
    low, high = archive.header["min_zoom"], archive.header["max_zoom"]
    if zoom == -1:
        return high
    if not low <= zoom <= high:
        raise ValueError(f"zoom {zoom} is outside {low} to {high}")
    return zoom


def summarize(spark: SparkSession, path: str) -> tuple[DataFrame, dict, DataFrame]:
    """(header as one row, metadata, one row for each tile in the directory's order)."""
    archive = open_front(path)
    header = spark.createDataFrame([tuple(int(archive.header[n]) for n in NAMES)], ", ".join(f"{n} long" for n in NAMES))
    return header, archive.metadata, read_tiles(spark, path, data=False).orderBy("z", "x", F.desc("y"))


def summary_lines(path: str, hdr: bool = False, meta: bool = False, tile: bool = False, all: bool = False, spark: SparkSession | None = None) -> Iterator[str]:
    """What is asked for, line by line; the listing of tiles is sorted by Spark and passes through part by part."""
    if not (hdr or meta or tile or all):
        raise ValueError("ask for the header, the metadata, the tiles, or all")
    archive = open_front(path)
    if hdr or all:
        yield from (f"{n}: {archive.header[n]}" for n in NAMES)
    if meta or all:
        yield json.dumps(archive.metadata, indent=2)
    if tile or all:
        listing = summarize(spark or SparkSession.builder.getOrCreate(), path)[2]
        yield from ("\t".join(map(str, r)) for r in listing.toLocalIterator())


def summary_text(path: str, hdr: bool = False, meta: bool = False, tile: bool = False, all: bool = False, spark: SparkSession | None = None) -> str:
    return "\n".join(summary_lines(path, hdr, meta, tile, all, spark))


def count_tiles(spark: SparkSession, path: str, zoom: int = -1) -> DataFrame:
    """Points per tile: of one zoom, or (-1) of all with the roll-up from the highest. Tiles are not decoded."""
    archive = open_front(path)
    tiles = read_tiles(spark, path)
    if zoom >= 0:
        tiles = tiles.where(F.col("z") == zoom)
    found = count_features(tiles, archive.codec)
    if zoom >= 0:
        return counts.count_zoom(found, zoom)
    return counts.count_all(found, archive.header["min_zoom"], archive.header["max_zoom"])


def _density(spark: SparkSession, path: str, preset: dict, count: str, feature: str, compact: bool, zoom: int) -> DataFrame:
    archive = open_front(path)
    z = _zoom(archive, zoom)
    points = read_points(read_tiles(spark, path).where(F.col("z") == z), archive.codec, [count, feature])
    there = F.map_contains_key("attrs", count) & F.map_contains_key("attrs", feature)
    checked = points.withColumn("_text", F.when(there, F.try_element_at("attrs", F.lit(count))).otherwise(F.raise_error(F.lit(f"a feature lacks {count} or {feature}")).cast("string")))
    return density.density(checked.withColumn("cnt", count_value("_text")), preset["widths"], preset["positive"], "cnt", compact)


def tile_density_stats(spark: SparkSession, path: str, count: str = "count", feature: str = "gene", compact: bool = False, zoom: int = -1) -> DataFrame:
    """20 widths; counts of 0 or less take part."""
    return _density(spark, path, density.SINGLE, count, feature, compact, zoom)


def tile_density_stats_mt(spark: SparkSession, path: str, count: str = "count", feature: str = "gene", compact: bool = False, zoom: int = -1) -> DataFrame:
    """13 widths; positive counts only."""
    return _density(spark, path, density.THREADED, count, feature, compact, zoom)


def _regions(polygon: str | list[Ring] | None) -> list[Ring] | None:
    return read_regions(polygon) if isinstance(polygon, str) else polygon


def _fields(archive: Archive) -> dict[str, str]:
    return (archive.metadata.get("vector_layers") or [{}])[0].get("fields", {})


def export(spark: SparkSession, path: str, zoom: int = -1, xmin: float | None = None, xmax: float | None = None, ymin: float | None = None, ymax: float | None = None, polygon: str | list[Ring] | None = None, columns: list[str] | None = None) -> DataFrame:
    """Points with gx, gy and a text column for each attribute (in the metadata's order)."""
    archive, box, rings = open_front(path), Box(xmin, ymin, xmax, ymax), _regions(polygon)
    z, names = _zoom(archive, zoom), columns or list(_fields(archive))
    tiles = prune_tiles(read_tiles(spark, path), z, box, rings)
    points = typed(filter_points(read_points(tiles, archive.codec, names), box, rings), names)
    return points.select("gx", "gy", *[F.col(f"`{c}`") for c in names])


def export_polygon(spark: SparkSession, path: str, columns: list[str] | None = None, layer_name: str | None = None, remove_columns: tuple[str, ...] = ("lat", "lon"), missing_value: str = "NA", write_vertices: bool = False, zoom: int = -1, xmin: float | None = None, xmax: float | None = None, ymin: float | None = None, ymax: float | None = None, polygon: str | list[Ring] | None = None, precision: int = 3, unique_by: str | None = None) -> DataFrame:
    """Polygon rows as text: mean vertex, vertices if asked for, and columns. A polygon cut by tile edges gives a row
    for each tile; with unique_by one row for each value of that column stays (rows without a value all stay)."""
    archive, box, rings = open_front(path), Box(xmin, ymin, xmax, ymax), _regions(polygon)
    z, names = _zoom(archive, zoom), columns or [c for c in _fields(archive) if c not in remove_columns]
    polygons = read_polygons(prune_tiles(read_tiles(spark, path), z, box, rings), archive.codec, layer_name)
    rows = typed(filter_polygons(polygons, box, rings), names)
    if unique_by:
        first = Window.partitionBy(unique_by).orderBy("tx", "ty", "fidx")
        named = rows.where(F.col(unique_by).isNotNull()).withColumn("_k", F.row_number().over(first)).where("_k = 1").drop("_k")
        rows = named.unionByName(rows.where(F.col(unique_by).isNull()))
    return polygon_rows(rows, names, missing_value, write_vertices, precision)
