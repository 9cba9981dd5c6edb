"""Connected components of an edge table, without collecting it."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise


class UnionFind:
    """Sets of numbers; the least member stands for each set."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def find(self, x: int) -> int:
        parent = self.parent
        root = parent.setdefault(x, x)
        while parent[root] != root:
            root = parent[root]
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    def union(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.parent[max(a, b)] = min(a, b)
        return True


def stars(pairs: Iterable[tuple[int, int]]) -> tuple[list[int], list[int]]:
    """Edges from each member to the least of its set."""
    found = UnionFind()
    for a, b in pairs:
        found.union(a, b)
    nodes = [n for n in list(found.parent) if found.find(n) != n]
    return nodes, [found.find(n) for n in nodes]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stars of what a task holds: at most one edge for each node in it."""
    for batch in batches:
        both = np.unique(np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[:2]], axis=1), axis=0) if batch.num_rows else np.zeros((0, 2), np.int64)
        u, v = stars(map(tuple, both.tolist()))
        yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])


def components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 200) -> DataFrame:
    """node, component (the least node reachable) for every node of an edge. The rounds needed grow with the logarithm
    of the longest path; more than most_rounds are an error, never an unfinished result.

    Large-star and small-star steps in turn, each written to the shared folder. Joins are between written tables, so
    that adaptive execution can split the edges of a node with very many neighbours.
    """
    now = edges.where(F.col(a) != F.col(b)).select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v"))
    now = materialise(now.mapInArrow(_contract, "u long, v long"), "edges")
    mark = None
    for _ in range(most_rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialise(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = both.join(least.hint("merge"), "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        large = materialise(large, "large")
        discard(now, least)
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = materialise(down.groupBy("u").agg(F.min("v").alias("m")), "least")
        joined = down.join(least.hint("merge"), "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = materialise(joined.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "small")
        discard(large, least)
        seen = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if (seen["n"], seen["h"]) == mark or not seen["n"]:
            break
        mark = (seen["n"], seen["h"])
    else:
        raise RuntimeError(f"components are not settled after {most_rounds} rounds")
    nodes = now.groupBy("u").agg(F.min("v").alias("v"))
    return nodes.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(nodes.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
