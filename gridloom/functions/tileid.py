"""Tile numbers along the Hilbert curve, tile parents and tile boxes, as Column expressions and for plain numbers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .projection import HALF, _c, tile_width


def first_id(z: int) -> int:
    """Number of the first tile of a zoom level: all tiles above it come before."""
    return ((1 << (2 * z)) - 1) // 3


def tile_id(x: Column | str, y: Column | str, z: int) -> Column:
    """Number of a tile; its quadrant at each bit adds to the distance, and the rest of the path is turned."""
    if z == 0:
        return F.lit(0).cast("long")

    def step(t: Column, a: Column) -> Column:
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), a)
        rx, ry = t["x"].bitwiseAND(bit), t["y"].bitwiseAND(bit)
        turn = lambda own, other: F.when(ry == 0, F.when(rx != 0, bit - 1 - other).otherwise(other)).otherwise(own)
        more = F.call_function("shiftleft", (F.lit(3).cast("long") * rx).bitwiseXOR(ry), a)
        return F.struct(turn(t["x"], t["y"]).alias("x"), turn(t["y"], t["x"]).alias("y"), (t["d"] + more).alias("d"))

    start = F.struct(_c(x).cast("long").alias("x"), _c(y).cast("long").alias("y"), F.lit(first_id(z)).cast("long").alias("d"))
    return F.aggregate(F.sequence(F.lit(z - 1), F.lit(0), F.lit(-1)), start, step, lambda t: t["d"])


#: The lower 32 bits, as text of SQL.
_EVERY = f"{(1 << 32) - 1}L"


def with_tile_id(rows: DataFrame, x: str, y: str, z: int, name: str = "tile_id") -> DataFrame:
    """rows with the number of the tile in columns x and y, as plain arithmetic in generated code.

    The turns of the curve at all bits form a prefix product, taken in log2(32) steps over all bits at once: (a, b)
    say how the path is turned at each bit, (c, d) which parts of x and y the turns so far exchange. Each step reads
    the step before several times, so steps are columns, not one nested expression; and the number leaves as the one
    element of an exploded array, through which the optimizer moves no filter: a predicate on the number (a filter, or
    what a join infers) would otherwise be written out in terms of x and y, doubling at every step.
    """
    if z == 0:
        return rows.withColumn(name, F.lit(0).cast("long"))
    keep = ["`" + n.replace("`", "``") + "`" for n in rows.columns if n != name]
    # an odd number of levels starts with its axes exchanged against the 32 levels that are computed
    own = {"_hx": F.col(y if z % 2 else x).cast("long"), "_hy": F.col(x if z % 2 else y).cast("long")}
    out = rows.withColumns(own).selectExpr(*keep, "_hx", "_hy", "_hx ^ _hy as _ha", f"{_EVERY} ^ (_hx | _hy) as _hc", f"_hx & (_hy ^ {_EVERY}) as _hd")
    out = out.selectExpr("*", f"{_EVERY} ^ _ha as _hb")
    turns = ["shiftright(_ha, 1) ^ _ha as _hb", "shiftright(_hc, 1) ^ (_hb & shiftright(_hd, 1)) ^ _hc as _hc", "(_ha & shiftright(_hc, 1)) ^ shiftright(_hd, 1) ^ _hd as _hd"]
    out = out.selectExpr(*keep, "_hx", "_hy", "_ha | shiftright(_hb, 1) as _ha", *turns)
    for k in (2, 4, 8, 16):
        a, b, c, d = (f"shiftright(_h{v}, {k})" for v in "abcd")
        turns = [f"_hc ^ (_ha & {c}) ^ (_hb & {d}) as _hc", f"_hd ^ (_hb & {c}) ^ ((_ha ^ _hb) & {d}) as _hd"]
        if k < 16:
            turns += [f"(_ha & {a}) ^ (_hb & {b}) as _ha", f"(_ha & {b}) ^ (_hb & ({a} ^ {b})) as _hb"]
        out = out.selectExpr(*keep, "_hx", "_hy", *turns)
    out = out.selectExpr(*keep, "_hx ^ _hy as _h0", "_hc ^ shiftright(_hc, 1) as _ha", "_hd ^ shiftright(_hd, 1) as _hb")
    out = out.selectExpr(*keep, "_h0", f"_hb | ({_EVERY} ^ (_h0 | _ha)) as _h1")
    for k, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        out = out.selectExpr(*keep, *[f"(_h{v} | shiftleft(_h{v}, {k})) & {mask}L as _h{v}" for v in "01"])
    out = out.selectExpr(*keep, f"((shiftleft(_h1, 1) | _h0) & {(1 << (2 * z)) - 1}L) + {first_id(z)}L as _ha")
    return out.select(*keep, F.explode(F.array("_ha")).alias(name))


def tile_xy(number: Column | str, z: int) -> Column:
    """struct(x, y) of a tile's number at a known zoom level."""

    def step(t: Column, a: Column) -> Column:
        s = F.call_function("shiftleft", F.lit(1).cast("long"), a)
        rx = F.call_function("shiftright", t["d"], F.lit(1)).bitwiseAND(F.lit(1))
        ry = t["d"].bitwiseXOR(rx).bitwiseAND(F.lit(1))
        flip = (ry == 0) & (rx == 1)
        fx, fy = F.when(flip, s - 1 - t["x"]).otherwise(t["x"]), F.when(flip, s - 1 - t["y"]).otherwise(t["y"])
        nx, ny = F.when(ry == 0, fy).otherwise(fx), F.when(ry == 0, fx).otherwise(fy)
        return F.struct((nx + s * rx).alias("x"), (ny + s * ry).alias("y"), F.call_function("shiftright", t["d"], F.lit(2)).alias("d"))

    zero = F.lit(0).cast("long")
    start = F.struct(zero.alias("x"), zero.alias("y"), (_c(number) - F.lit(first_id(z))).cast("long").alias("d"))
    if z == 0:
        return F.struct(zero.alias("x"), zero.alias("y"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(z - 1)), start, step, lambda t: F.struct(t["x"].alias("x"), t["y"].alias("y")))


def parent(v: Column | str, levels: int = 1) -> Column:
    return F.shiftright(_c(v), levels)


def tile_box(tx: Column | str, ty: Column | str, z: int) -> Column:
    """struct(xmin, ymin, xmax, ymax) of a tile, for pruning."""
    w = F.lit(tile_width(z))
    left, top = _c(tx) * w - F.lit(HALF), F.lit(HALF) - _c(ty) * w
    return F.struct(left.alias("xmin"), (top - w).alias("ymin"), (left + w).alias("xmax"), top.alias("ymax"))


def id_of(z: int, x: int, y: int) -> int:
    """The same number for plain integers."""
    n = 1 << z
    if not (0 <= z <= 31 and 0 <= x < n and 0 <= y < n):
        raise ValueError(f"no tile {z}/{x}/{y}")
    d = first_id(z)
    for a in range(z - 1, -1, -1):
        bit = 1 << a
        rx, ry = x & bit, y & bit
        d += ((3 * rx) ^ ry) << a
        if not ry:
            x, y = (bit - 1 - y, bit - 1 - x) if rx else (y, x)
    return d


def zxy_of(number: int) -> tuple[int, int, int]:
    """Zoom level, x and y of a tile's number."""
    z = 0
    while first_id(z + 1) <= number:
        z += 1
    if z > 31:
        raise ValueError(f"no tile has number {number}")
    d, x, y = number - first_id(z), 0, 0
    for a in range(z):
        s = 1 << a
        rx = (d >> 1) & 1
        ry = (d ^ rx) & 1
        if not ry:
            if rx:
                x, y = s - 1 - x, s - 1 - y
            x, y = y, x
        x, y, d = x + s * rx, y + s * ry, d >> 2
    return z, x, y


def places_of(numbers: np.ndarray, z: int) -> tuple[np.ndarray, np.ndarray]:
    """x and y of many tiles of one zoom level."""
    d = numbers - first_id(z)
    x, y = np.zeros_like(d), np.zeros_like(d)
    for a in range(z):
        s = 1 << a
        rx = (d >> 1) & 1
        ry = (d ^ rx) & 1
        flip, turn = (ry == 0) & (rx == 1), ry == 0
        x, y = np.where(flip, s - 1 - x, x), np.where(flip, s - 1 - y, y)
        x, y = np.where(turn, y, x) + s * rx, np.where(turn, x, y) + s * ry
        d = d >> 2
    return x, y


def box_spans(z: int, x: tuple[int, int], y: tuple[int, int], most: int = 256) -> list[tuple[int, int]]:
    """Intervals of numbers that hold all tiles of a box (bounds included) at a zoom level, in order, about `most` or
    fewer: a quarter of the plane is one interval of the curve, so quarters are split until they lie in the box, or
    there are enough of them; what then juts out of the box is included."""
    n = 1 << z
    (x0, x1), (y0, y1) = (max(0, x[0]), min(n - 1, x[1])), (max(0, y[0]), min(n - 1, y[1]))
    if x0 > x1 or y0 > y1:
        return []
    done, edge = [], [(0, 0, 0)]
    for level in range(z + 1):
        size, after = 1 << (z - level), []
        for _, cx, cy in edge:
            left, top = cx * size, cy * size
            if left > x1 or top > y1 or left + size <= x0 or top + size <= y0:
                continue
            inside = x0 <= left and left + size - 1 <= x1 and y0 <= top and top + size - 1 <= y1
            (done if inside or level == z else after).append((level, cx, cy))
        if len(done) + 4 * len(after) > most:
            done, after = done + after, []
        edge = [(level + 1, 2 * cx + i, 2 * cy + j) for _, cx, cy in after for i in (0, 1) for j in (0, 1)]
    spans = sorted((id_of(level, cx, cy) - first_id(level)) << (2 * (z - level)) for level, cx, cy in done)
    lengths = {(id_of(level, cx, cy) - first_id(level)) << (2 * (z - level)): 1 << (2 * (z - level)) for level, cx, cy in done}
    out: list[tuple[int, int]] = []
    for start in spans:
        first, last = first_id(z) + start, first_id(z) + start + lengths[start] - 1
        if out and out[-1][1] + 1 == first:
            out[-1] = out[-1][0], last
        else:
            out.append((first, last))
    return out
