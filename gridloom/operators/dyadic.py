"""Sums over squares of 1, 2, 4, ... cells a side, each width from a narrower one.

A block of four by four cells is one row with sixteen sums, which tasks add up before anything is shuffled. It holds all
sums of its cells, of the four squares of two by two, and of itself; and blocks are the cells of the next step. So two
widths take one shuffle of at most a row a block, where a row for each cell and width would be shuffled otherwise. After
three steps a cell is 64 by 64 of the first ones, and so few are left that one shuffle serves all wider squares.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STEPS = 3


def _sum_of(parts: list[str]) -> str:
    """The sum of what is there, null if nothing is, as text of SQL."""
    return f"if(coalesce({', '.join(parts)}) is null, null, {' + '.join(f'coalesce({p}, 0L)' for p in parts)})"


def dyadic_sums(cells: DataFrame, levels: int, key: tuple[str, ...] = ()) -> DataFrame:
    """key, i, bx, by, s: the sums of s over the squares of 2**i cells a side, for i from 0 to levels - 1, where there is
    a cell. cells: key, bx, by, s (long; one row or more for a cell, s not null); places shift as signed numbers."""
    names = [f"`{k}`" for k in key]
    out, now, low = None, cells.selectExpr(*names, "cast(bx as long) bx", "cast(by as long) by", "cast(s as long) s"), 0
    for low in range(0, min(2 * STEPS, max(1, levels - 1)), 2):
        numbered = now.selectExpr(*names, "shiftright(bx, 2) _x", "shiftright(by, 2) _y", "(by & 3) * 4 + (bx & 3) _k", "s")
        block = numbered.groupBy(*key, "_x", "_y").agg(*[F.expr(f"sum(if(_k = {k}, s, null)) _c{k}") for k in range(16)])
        # cells are 4 * row + column; quarters hold two by two of them
        quarters = [_sum_of([f"_c{4 * (2 * y + j) + 2 * x + i}" for j in (0, 1) for i in (0, 1)]) + f" _q{2 * y + x}" for y in (0, 1) for x in (0, 1)]
        block = block.selectExpr("*", *quarters).selectExpr("*", _sum_of([f"_q{k}" for k in range(4)]) + " _all")
        entry = lambda i, side, k, s: f"named_struct('i', {i}, 'bx', _x * {side} + {k % side}, 'by', _y * {side} + {k // side}, 's', {s})"
        found = [entry(0, 4, k, f"_c{k}") for k in range(16)] if low == 0 else []
        found += [entry(low + 1, 2, k, f"_q{k}") for k in range(4)] if low + 1 < levels else []
        found += [entry(low + 2, 1, 0, "_all")] if low + 2 < levels else []
        rows = block.selectExpr(*names, f"explode(array({', '.join(found)})) e").where("e.s is not null").selectExpr(*names, "e.*")
        out = rows if out is None else out.unionByName(rows)
        now = block.selectExpr(*names, "_x bx", "_y by", "_all s")
    if low + 3 < levels:
        wide = now.selectExpr(*names, "bx", "by", "s", f"explode(sequence({low + 3}, {levels - 1})) i")
        wide = wide.selectExpr(*names, "i", f"shiftright(bx, i - {low + 2}) bx", f"shiftright(by, i - {low + 2}) by", "s")
        out = out.unionByName(wide.groupBy(*key, "i", "bx", "by").agg(F.sum("s").alias("s")))
    return out
