"""Points per tile, and their roll-up to every ancestor tile."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import general
from ..functions.tileid import first_id, with_tile_id
from .dyadic import dyadic_sums


def count_zoom(counts: DataFrame, zoom: int) -> DataFrame:
    """zoom, x, y, tile_id, tile_count at one zoom. counts: z, x, y, n (one row or more for a tile)."""
    own = counts.where(F.col("z") == zoom).groupBy("x", "y").agg(F.sum("n").cast("long").alias("tile_count"))
    return with_tile_id(own, "x", "y", zoom).select(F.lit(zoom).alias("zoom"), "x", "y", "tile_id", "tile_count")


def count_all(counts: DataFrame, min_zoom: int, max_zoom: int) -> DataFrame:
    """zoom, x, y, tile_id, total_count, tile_count, frac_in_tile: the points of the highest zoom summed over every
    ancestor, and what the tile itself holds. A total of 0 has no fraction.

    Each level is summed from a deeper one (see dyadic_sums), so that the roll-up handles tiles, not points.
    """
    per_tile = counts.groupBy("z", "x", "y").agg(F.sum("n").cast("long").alias("n"))
    top = per_tile.where(F.col("z") == max_zoom).select(F.col("x").alias("bx"), F.col("y").alias("by"), F.col("n").alias("s"))
    total = dyadic_sums(top, max_zoom - min_zoom + 1).select((F.lit(max_zoom) - F.col("i")).alias("zoom"), F.col("bx").alias("x"), F.col("by").alias("y"), F.col("s").alias("total_count"))
    own = per_tile.select(F.col("z").alias("zoom"), "x", "y", F.col("n").alias("tile_count"))
    out = total.join(own, ["zoom", "x", "y"], "left").withColumn("tile_count", F.coalesce("tile_count", F.lit(0).cast("long")))
    # the descendants of a tile at the highest zoom follow each other on the curve, the first one has its place times 4**levels
    shift = F.lit(max_zoom) - F.col("zoom")
    deep = {"_x": F.call_function("shiftleft", F.col("x"), shift), "_y": F.call_function("shiftleft", F.col("y"), shift)}
    out = with_tile_id(out.withColumns(deep), "_x", "_y", max_zoom, "_id").withColumn("_first", F.element_at(F.array(*[F.lit(first_id(k)).cast("long") for k in range(max_zoom + 1)]), F.col("zoom") + 1))
    number = F.call_function("shiftright", F.col("_id") - F.lit(first_id(max_zoom)), 2 * shift) + F.col("_first")
    return out.select("zoom", "x", "y", number.alias("tile_id"), "total_count", "tile_count", F.expr("try_divide(cast(tile_count as double), cast(total_count as double))").alias("frac_in_tile"))


def count_text(rows: DataFrame) -> DataFrame:
    """Rows of count_all as the text sink writes them, in order of zoom, x, y."""
    shown = rows.withColumn("frac_in_tile", general("frac_in_tile", 5)) if "frac_in_tile" in rows.columns else rows
    return shown.orderBy("zoom", "x", "y")
