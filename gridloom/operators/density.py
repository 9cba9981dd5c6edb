"""Multi-resolution density: sums of a count over square bins of 1, 2, 4, ... pixels, and how often each sum occurs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .dyadic import dyadic_sums

#: The two presets: widths, and whether counts of 0 or less are left out.
SINGLE = {"widths": 20, "positive": False}
THREADED = {"widths": 13, "positive": True}


def bin_sums(points: DataFrame, widths: int, positive: bool, count: str = "cnt", key: tuple[str, ...] = ("z", "tx", "ty")) -> DataFrame:
    """key, i, bx, by, s: the sum of the count in each bin of 2**i pixels. Pixels shift as signed numbers.

    Each width is summed from a narrower one (see dyadic_sums).
    """
    rows = points.where(F.col(count) > 0) if positive else points.where(F.col(count).isNotNull())
    pixels = rows.select(*key, F.col("px").cast("long").alias("bx"), F.col("py").cast("long").alias("by"), F.col(count).cast("long").alias("s"))
    return dyadic_sums(pixels, widths, key)


def density(points: DataFrame, widths: int = 13, positive: bool = True, count: str = "cnt", compact: bool = False, tiles_only: bool = False) -> DataFrame:
    """zoom, tile_x, tile_y, width, num_pts, num_grids: per tile, and over all tiles (tile_x and tile_y null).

    compact: only the rows over all tiles; tiles_only: only those of tiles.
    """
    sums = bin_sums(points, widths, positive, count).withColumn("width", F.call_function("shiftleft", F.lit(1), F.col("i")).cast("long"))
    if compact:
        found = sums.groupBy("z", "width", "s").agg(F.count(F.lit(1)).alias("num_grids")).withColumns({"tx": F.lit(None).cast("long"), "ty": F.lit(None).cast("long")})
    else:
        per_tile = sums.groupBy("z", "tx", "ty", "width", "s").agg(F.count(F.lit(1)).alias("num_grids"))
        if tiles_only:
            return per_tile.select(F.col("z").alias("zoom"), F.col("tx").alias("tile_x"), F.col("ty").alias("tile_y"), "width", F.col("s").alias("num_pts"), "num_grids")
        grouped = per_tile.groupingSets([["z", "tx", "ty", "width", "s"], ["z", "width", "s"]], "z", "tx", "ty", "width", "s")
        found = grouped.agg(F.sum("num_grids").cast("long").alias("num_grids"))
    return found.select(F.col("z").alias("zoom"), F.col("tx").alias("tile_x"), F.col("ty").alias("tile_y"), "width", F.col("s").alias("num_pts"), "num_grids")


def density_text(rows: DataFrame) -> DataFrame:
    """Rows of density as the text sink writes them: tiles first, then ALL."""
    order = rows.orderBy(F.col("tile_x").isNull(), "tile_x", F.desc("tile_y"), "width", "num_pts")
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("ALL")).alias(c)
    return order.select("zoom", shown("tile_x"), shown("tile_y"), "width", "num_pts", "num_grids")
