"""Exports: points and polygons under zoom, box and region filters."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import centroid, in_any_region, in_box, ring_box, row_in_regions
from ..functions.projection import HALF, tile_width
from ..functions.text import filled, fixed
from ..sources.regions import Ring, boxes_of
from ..sources.scratch import materialise
from ..sources.sinks import vertices_text
from . import cover


@dataclass
class Box:
    """Inclusive bounds, each optional."""

    xmin: float | None = None
    ymin: float | None = None
    xmax: float | None = None
    ymax: float | None = None

    @property
    def active(self) -> bool:
        return any(v is not None and v == v and abs(v) != float("inf") for v in (self.xmin, self.ymin, self.xmax, self.ymax))

    def bounds(self) -> dict[str, float | None]:
        usable = lambda v: v if v is not None and v == v and abs(v) != float("inf") else None
        return {k: usable(getattr(self, k)) for k in ("xmin", "ymin", "xmax", "ymax")}


def tile_limits(z: int, box: Box | None, rings: list[Ring] | None = None) -> dict[str, int | None]:
    """The least and largest tile x and y that can hold what the filters ask for; a margin of one pixel on each side."""
    bounds = box.bounds() if box else dict.fromkeys(("xmin", "ymin", "xmax", "ymax"))
    if rings:
        boxes = boxes_of(rings)
        cover = {"xmin": min(b[0] for b in boxes), "ymin": min(b[1] for b in boxes), "xmax": max(b[2] for b in boxes), "ymax": max(b[3] for b in boxes)}
        for k, v in cover.items():
            pick = max if k.endswith("min") else min
            bounds[k] = v if bounds[k] is None else pick(bounds[k], v)
    w, n = tile_width(z), 1 << z
    slack = w / 4096 + 1
    at = lambda v: max(-1, min(n, int(v // w)))
    return {
        "x_from": None if bounds["xmin"] is None else at(bounds["xmin"] - slack + HALF),
        "x_to": None if bounds["xmax"] is None else at(bounds["xmax"] + slack + HALF),
        "y_from": None if bounds["ymax"] is None else at(HALF - bounds["ymax"] - slack),
        "y_to": None if bounds["ymin"] is None else at(HALF - bounds["ymin"] + slack),
    }


def prune_tiles(tiles: DataFrame, z: int, box: Box | None = None, rings: list[Ring] | None = None, x: str = "x", y: str = "y") -> DataFrame:
    """tiles of one zoom that can hold a hit; the comparisons reach the data source."""
    out, limits = tiles.where(F.col("z") == z), tile_limits(z, box, rings)
    for column, low, high in ((x, "x_from", "x_to"), (y, "y_from", "y_to")):
        if limits[low] is not None:
            out = out.where(F.col(column) >= limits[low])
        if limits[high] is not None:
            out = out.where(F.col(column) <= limits[high])
    return out


def filter_points(points: DataFrame, box: Box | None = None, rings: list[Ring] | None = None, x: str = "gx", y: str = "gy") -> DataFrame:
    """Points in the box and in any of the regions."""
    out = points.where(in_box(x, y, **box.bounds())) if box and box.active else points
    return out.where(in_any_region(x, y, rings)) if rings else out


def points_in_regions(points: DataFrame, regions: DataFrame, x: str = "gx", y: str = "gy") -> DataFrame:
    """Points in any of many regions, given as a table with a column `ring` (closed or not); all columns stay, each row
    once. Null coordinates are in no region.

    For region sets too large for literal expressions. Points meet the cells of regions (see cover) on the grid of each
    level in use, by an equi-join; points in cells inside a region are found by that, and only those on its edge are
    tested, against the edges that matter there. A semi-join leaves each point once.
    """
    cells = materialise(cover.cover(regions), "cover")
    levels = _levels(cells)
    if not levels:
        return points.limit(0)
    names = {c: f"_point{k}" for k, c in enumerate(points.columns)}
    px, py = names[x], names[y]
    own = points.toDF(*names.values())
    if len(levels) == 1:
        found = _on_grid(own, px, py, levels).join(cells, _meets(px, py), "left_semi")
    else:
        # a place is tried on the grid of each level, and may lie in regions of several: places are found first, once each
        places = _on_grid(own.select(px, py).distinct(), px, py, levels)
        hits = places.join(cells, _meets(px, py), "left_semi").select(F.col(px).alias("_hx"), F.col(py).alias("_hy")).distinct()
        found = own.join(hits, (F.col(px) == F.col("_hx")) & (F.col(py) == F.col("_hy")), "left_semi")
    return found.select(*[F.col(n).alias(c) for c, n in names.items()])


def _levels(cells: DataFrame) -> list[int]:
    """The levels of the grid in use, of which there are 27 at most."""
    return sorted(r["cz"] for r in cells.select("cz").distinct().collect())


def _on_grid(places: DataFrame, x: str, y: str, levels: list[int]) -> DataFrame:
    """places with _z, _cx, _cy: their cell at each level."""
    each = places.withColumn("_z", F.explode(F.array(*[F.lit(z) for z in levels])))
    return each.withColumns({"_cx": cover.cell(x, F.col("_z")), "_cy": cover.cell(y, F.col("_z"))})


def _meets(x: str, y: str) -> Column:
    """A place on the grid lies in the region of a cell."""
    tested = F.col(x).between(F.col("xmin"), F.col("xmax")) & F.col(y).between(F.col("ymin"), F.col("ymax")) & cover.in_edges(x, y, "edges")
    return (F.col("_z") == F.col("cz")) & (F.col("_cx") == F.col("cx")) & (F.col("_cy") == F.col("cy")) & (F.col("inside") | tested)


def polygons_in_regions(polygons: DataFrame, regions: DataFrame, ring: str = "ring") -> DataFrame:
    """Polygon rows that match any of many regions, given as a table with a column `ring`: any vertex lies in a region, or
    both corners of the polygon's box lie in the same one (what filter_polygons does with a few). All columns stay, each
    row once; null and empty rings match nothing.

    Vertices and corners meet the cells of regions (see cover); a pair of polygon and region is known by its two numbers,
    so corners found in several cells or levels count once.
    """
    names = {c: f"_column{k}" for k, c in enumerate(polygons.columns)}
    own = materialise(polygons.toDF(*names.values()).withColumn("_row", F.monotonically_increasing_id()), "polygons")
    cells = materialise(cover.cover(materialise(regions.select("ring").withColumn("_id", F.monotonically_increasing_id()), "regions"), "ring", "_id"), "cover")
    levels = _levels(cells)
    if not levels:
        return polygons.limit(0)
    shape = F.col(names[ring])
    vertices = own.select("_row", F.explode(shape).alias("v")).select("_row", F.col("v.x").alias("_x"), F.col("v.y").alias("_y"))
    by_vertex = _on_grid(vertices, "_x", "_y", levels).join(cells, _meets("_x", "_y"), "left_semi").select("_row")
    box = ring_box(shape)
    corners = own.where(F.size(shape) > 0).select("_row", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), box[f"x{side}"].alias("x"), box[f"y{side}"].alias("y")) for k, side in enumerate(("min", "max"))])).alias("v"))
    placed = _on_grid(corners.select("_row", "v.k", F.col("v.x").alias("_x"), F.col("v.y").alias("_y")), "_x", "_y", levels)
    pairs = placed.join(cells, _meets("_x", "_y")).groupBy("_row", "region").agg(F.bit_or(F.col("k") + 1).alias("both"))
    hits = by_vertex.unionByName(pairs.where("both = 3").select("_row")).distinct()
    return own.join(hits, "_row", "left_semi").select(*[F.col(n).alias(c) for c, n in names.items()])


def filter_polygons(polygons: DataFrame, box: Box | None = None, rings: list[Ring] | None = None, ring: str = "ring") -> DataFrame:
    """Polygon rows whose box overlaps the box, and that match the regions."""
    out = polygons
    if box and box.active:
        own, b = ring_box(ring), box.bounds()
        for low, high, edge in (("xmin", "xmax", "x"), ("ymin", "ymax", "y")):
            if b[low] is not None:
                out = out.where(own[f"{edge}max"] >= F.lit(b[low]))
            if b[high] is not None:
                out = out.where(own[f"{edge}min"] <= F.lit(b[high]))
    return out.where(row_in_regions(ring, rings)) if rings else out


def polygon_rows(polygons: DataFrame, columns: list[str], missing: str = "NA", vertices: bool = False, digits: int = 3, ring: str = "ring") -> DataFrame:
    """X, Y (mean of vertices), Vertices if asked for, and the columns with missing fields filled."""
    mid = centroid(ring)
    own = polygons.withColumn("_mid", mid)
    extra = [vertices_text(ring, digits).alias("Vertices")] if vertices else []
    return own.select(fixed(F.col("_mid.x"), digits).alias("X"), fixed(F.col("_mid.y"), digits).alias("Y"), *extra, *[filled(c, missing).alias(c) for c in columns])
