"""Regions as cells of a grid: cells inside a region need no test, cells on its edge test the edges that matter there.

A region is put on the grid of the zoom level at which its box is no wider or higher than a tile, and this grid is then
halved once for every doubling of the region's vertices, five times at most: quarters that no edge crosses are inside or
outside as a whole, the others are divided further. What a point of a cell on the edge needs is the edges in the
cell's band of y that do not lie to the left of it: all others cross no ray from the point to the right.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.projection import HALF, _c

#: Levels of the grid, halvings at most, and edges up to which a grid is halved once.
DEEPEST, HALVINGS, FEW = 26, 5, 8
COVER = "region long, cz int, cx long, cy long, inside boolean, xmin double, ymin double, xmax double, ymax double, edges array<struct<xi:double,yi:double,xj:double,yj:double>>"


def _crossing(e: np.ndarray, x0: float, y0: float, x1: float, y1: float) -> np.ndarray:
    """Which edges (xi, yi, xj, yj) may touch a box: their boxes meet, and not all corners lie on one side."""
    near = (np.minimum(e[:, 0], e[:, 2]) <= x1) & (np.maximum(e[:, 0], e[:, 2]) >= x0) & (np.minimum(e[:, 1], e[:, 3]) <= y1) & (np.maximum(e[:, 1], e[:, 3]) >= y0)
    dx, dy = e[:, 2] - e[:, 0], e[:, 3] - e[:, 1]
    sides = np.stack([dx * (y - e[:, 1]) - dy * (x - e[:, 0]) for x in (x0, x1) for y in (y0, y1)])
    slack = 1e-9 * (np.abs(dx) + np.abs(dy)) * (x1 - x0)
    return near & (sides.min(axis=0) <= slack) & (sides.max(axis=0) >= -slack)


def _inside(e: np.ndarray, x: float, y: float) -> bool:
    """The even-odd test of in_ring."""
    own = e[(e[:, 1] > y) != (e[:, 3] > y)]
    return bool((x < (own[:, 2] - own[:, 0]) * (y - own[:, 1]) / (own[:, 3] - own[:, 1]) + own[:, 0]).sum() % 2)


def cells_of(ring: np.ndarray) -> tuple[int, list[tuple[int, int, bool, np.ndarray | None]]]:
    """(level, cells): x, y, whether the cell is inside, and else its edges, of a ring of vertices (n, 2)."""
    edges = np.concatenate([ring, np.roll(ring, 1, axis=0)], axis=1)
    low, high = ring.min(axis=0), ring.max(axis=0)
    extent = max(float((high - low).max()), 1e-3)
    z = min(20, max(0, math.floor(math.log2(2 * HALF / extent))))
    last = min(DEEPEST, z + max(1, min(HALVINGS, int(math.log2(max(2, len(ring) / FEW))) + 1)))
    cell = lambda v, level: math.floor((v + HALF) / (2 * HALF / (1 << level)))
    out: list[tuple[int, int, bool, np.ndarray | None]] = []
    now = [(x, y, edges) for x in range(cell(low[0], z), cell(high[0], z) + 1) for y in range(cell(low[1], z), cell(high[1], z) + 1)]
    for level in range(z, last + 1):
        w, after = 2 * HALF / (1 << level), []
        slack = 1e-9 * w + 1e-6
        for x, y, own in now:
            x0, y0 = x * w - HALF, y * w - HALF
            own = own[_crossing(own, x0 - slack, y0 - slack, x0 + w + slack, y0 + w + slack)]
            if not len(own):
                if _inside(edges, x0 + w / 2, y0 + w / 2):
                    n = 1 << (last - level)
                    out += [(x * n + i, y * n + j, True, None) for i in range(n) for j in range(n)]
            elif level < last:
                after += [(2 * x + i, 2 * y + j, own) for i in (0, 1) for j in (0, 1)]
            else:
                band = (np.minimum(edges[:, 1], edges[:, 3]) <= y0 + w + slack) & (np.maximum(edges[:, 1], edges[:, 3]) >= y0 - slack) & (np.maximum(edges[:, 0], edges[:, 2]) >= x0 - slack)
                out.append((x, y, False, edges[band & (edges[:, 1] != edges[:, 3])]))
        now = after
    return last, out


def cover(regions: DataFrame, ring: str = "ring", key: str | None = None) -> DataFrame:
    """region, cz, cx, cy, inside, the region's box, and edges (empty where inside) for the cells of each region; cells
    count from the lower left. key: the column of whole numbers that names a region (null without). Null and empty rings
    have no cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own, region in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                vertices = np.array([(p["x"], p["y"]) for p in own or () if p and p["x"] is not None and p["y"] is not None], float).reshape(-1, 2)
                if not len(vertices) or not np.isfinite(vertices).all():
                    continue
                level, cells = cells_of(vertices)
                box = [*vertices.min(axis=0), *vertices.max(axis=0)]
                for k in range(0, len(cells), 512):
                    part = cells[k : k + 512]
                    counts = [0 if e is None else len(e) for *_, e in part]
                    flat = np.concatenate([np.zeros((0, 4)), *[e for *_, e in part if e is not None]])
                    values = pa.StructArray.from_arrays([pa.array(flat[:, c]) for c in range(4)], names=["xi", "yi", "xj", "yj"])
                    edges = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), values)
                    n = len(part)
                    columns = [pa.array([region] * n, pa.int64()), pa.array([level] * n, pa.int32()), pa.array([c[0] for c in part], pa.int64()), pa.array([c[1] for c in part], pa.int64()), pa.array([c[2] for c in part]), *[pa.array([v] * n, pa.float64()) for v in box], edges]
                    yield pa.RecordBatch.from_arrays(columns, names=["region", "cz", "cx", "cy", "inside", "xmin", "ymin", "xmax", "ymax", "edges"])

    return regions.select(F.col(ring), (F.col(key) if key else F.lit(None)).cast("long").alias("_key")).mapInArrow(run, COVER)


def in_edges(x: Column | str, y: Column | str, edges: Column | str) -> Column:
    """The even-odd test over edges, in the arithmetic of in_ring."""
    x, y = _c(x), _c(y)

    def crosses(e: Column) -> Column:
        spans = (e["yi"] > y) != (e["yj"] > y)
        at = F.when(spans, (e["xj"] - e["xi"]) * (y - e["yi"]) / (e["yj"] - e["yi"]) + e["xi"])
        return F.when(spans & (x < at), 1).otherwise(0)

    return F.aggregate(F.transform(_c(edges), crosses), F.lit(0), lambda a, v: a + v) % 2 == 1


def cell(v: Column | str, z: Column) -> Column:
    """The cell of a coordinate at a level."""
    return F.floor((_c(v) + F.lit(HALF)) / (F.lit(2 * HALF) / F.call_function("shiftleft", F.lit(1).cast("long"), z))).cast("long")
