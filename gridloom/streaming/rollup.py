"""Tile counts and densities over streams of points. Both are sums, so they update as points arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.projection import in_plane, tile_x, tile_y
from ..operators.build import place


def stream_counts(points: DataFrame, min_zoom: int, max_zoom: int, x: str = "gx", y: str = "gy") -> DataFrame:
    """zoom, x, y, total_count of every tile and ancestor; for output modes complete and update."""
    inside = points.where(in_plane(x, y, max_zoom)).select(tile_x(x, max_zoom).alias("tx"), tile_y(y, max_zoom).alias("ty"))
    up = inside.select(F.explode(F.sequence(F.lit(min_zoom), F.lit(max_zoom))).alias("zoom"), "tx", "ty")
    shift = F.lit(max_zoom) - F.col("zoom")
    rows = up.select("zoom", F.call_function("shiftright", F.col("tx"), shift).alias("x"), F.call_function("shiftright", F.col("ty"), shift).alias("y"))
    return rows.groupBy("zoom", "x", "y").agg(F.count(F.lit(1)).alias("total_count"))


def stream_bins(points: DataFrame, zoom: int, widths: int = 13, positive: bool = True, count: str = "cnt") -> DataFrame:
    """tx, ty, width, bx, by, s: bin sums of density(); their histogram is a batch query over the result."""
    rows = place(points.where(F.col(count) > 0) if positive else points, zoom)
    wide = rows.select("tx", "ty", "px", "py", F.col(count).cast("long").alias("s"), F.explode(F.sequence(F.lit(0), F.lit(widths - 1))).alias("i"))
    shift = lambda c: F.call_function("shiftright", F.col(c).cast("long"), F.col("i"))
    return wide.groupBy("tx", "ty", F.call_function("shiftleft", F.lit(1), F.col("i")).cast("long").alias("width"), shift("px").alias("bx"), shift("py").alias("by")).agg(F.sum("s").alias("s"))


def windowed_counts(points: DataFrame, zoom: int, time: str, window: str, watermark: str, x: str = "gx", y: str = "gy") -> DataFrame:
    """Tile counts in time windows, with late points dropped after the watermark."""
    inside = points.withWatermark(time, watermark).where(in_plane(x, y, zoom))
    return inside.groupBy(F.window(time, window), tile_x(x, zoom).alias("tx"), tile_y(y, zoom).alias("ty")).agg(F.count(F.lit(1)).alias("n"))
