"""Boxes, rings and regions as Column expressions. A ring is an array of struct(x, y)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .projection import _c


def ring_box(ring: Column | str) -> Column:
    """struct(xmin, ymin, xmax, ymax) of a ring."""
    ring = _c(ring)
    xs, ys = F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("xmin"), F.array_min(ys).alias("ymin"), F.array_max(xs).alias("xmax"), F.array_max(ys).alias("ymax"))


def boxes_overlap(a: Column, b: Column) -> Column:
    """Closed boxes share a point; crosses and shared edges count."""
    return (a["xmin"] <= b["xmax"]) & (b["xmin"] <= a["xmax"]) & (a["ymin"] <= b["ymax"]) & (b["ymin"] <= a["ymax"])


def in_box(x: Column | str, y: Column | str, xmin: float | None = None, ymin: float | None = None, xmax: float | None = None, ymax: float | None = None) -> Column:
    """Inclusive box test; each bound is optional. Not-a-number coordinates are in no box with a bound."""
    x, y = _c(x), _c(y)
    out = F.lit(True)
    for v, low, high in ((x, xmin, xmax), (y, ymin, ymax)):
        if low is not None:
            out = out & (v >= F.lit(float(low)))
        if high is not None:
            out = out & (v <= F.lit(float(high)))
        if low is not None or high is not None:
            out = out & ~F.isnan(v)
    return out


def in_ring(x: Column | str, y: Column | str, ring: Column | str) -> Column:
    """Even-odd test with half-open edges: a vertex or lower edge counts once."""
    x, y, ring = _c(x), _c(y), _c(ring)
    n = F.size(ring)

    def crosses(p: Column, i: Column) -> Column:
        q = F.element_at(ring, F.when(i == 0, n).otherwise(i))
        spans = (p["y"] > y) != (q["y"] > y)
        at = F.when(spans, (q["x"] - p["x"]) * (y - p["y"]) / (q["y"] - p["y"]) + p["x"])
        return F.when(spans & (x < at), 1).otherwise(0)

    return F.aggregate(F.transform(ring, crosses), F.lit(0), lambda a, v: a + v) % 2 == 1


def in_any_region(x: Column | str, y: Column | str, rings: list[list[tuple[float, float]]]) -> Column:
    """Point in any of a few literal rings: straight-line arithmetic for each edge, so it stays in generated code."""
    x, y = _c(x), _c(y)
    out = F.lit(False)
    for ring in rings:
        count = F.lit(0)
        for (xi, yi), (xj, yj) in zip(ring, [ring[-1], *ring[:-1]], strict=True):
            if yi == yj:
                continue
            spans = (F.lit(float(yi)) > y) != (F.lit(float(yj)) > y)
            at = F.lit(float(xj) - float(xi)) * (y - F.lit(float(yi))) / F.lit(float(yj) - float(yi)) + F.lit(float(xi))
            count = count + F.when(spans & (x < at), 1).otherwise(0)
        xs, ys = [p[0] for p in ring], [p[1] for p in ring]
        out = out | (in_box(x, y, min(xs), min(ys), max(xs), max(ys)) & (count % 2 == 1))
    return out


def centroid(ring: Column | str) -> Column:
    """Mean of a closed ring's vertices, the closing one left out; a ring that is not closed is an error."""
    ring = _c(ring)
    first, last, n = F.element_at(ring, 1), F.element_at(ring, -1), F.size(ring) - 1
    closed = (F.abs(first["x"] - last["x"]) <= 1e-6) & (F.abs(first["y"] - last["y"]) <= 1e-6)
    own = F.slice(ring, F.lit(1), n)
    mean = lambda f: F.aggregate(own, F.lit(0.0), lambda a, p: a + p[f]) / n
    bad = F.raise_error(F.lit("ring is not closed"))
    return F.struct(F.when(closed, mean("x")).otherwise(bad.cast("double")).alias("x"), F.when(closed, mean("y")).otherwise(bad.cast("double")).alias("y"))


def _vertex_in(ring: list[tuple[float, float]]):
    return lambda p: in_any_region(p["x"], p["y"], [ring])


def row_in_regions(ring: Column | str, rings: list[list[tuple[float, float]]]) -> Column:
    """A polygon row is kept if both corners of its box, or any vertex, lie in one region. Not an exact overlap."""
    box = ring_box(ring)
    out = F.lit(False)
    for own in rings:
        corners = in_any_region(box["xmin"], box["ymin"], [own]) & in_any_region(box["xmax"], box["ymax"], [own])
        out = out | corners | F.exists(_c(ring), _vertex_in(own))
    return out
