"""Near-duplicate vectors by collision-counting projections.

1. Unit vectors are projected on many random directions; a vector's sketch holds one small number for each.
2. A table sorts the vectors by one of the projections. Each vector asks for those in the window around its own value
   and counts, over all projections, how often they collide: fall in the window centred on it. A pair goes on with as
   many collisions as a linked pair has with probability 1 - miss. A few tables with different sorting projections
   make up for linked pairs outside one window. Only ids and sketches are shuffled for this.
3. Vectors are fetched for ids with a counted pair alone, and such pairs are verified by cosine in double precision.

A window at cosine 0.9 holds almost half of unrelated vectors, so counting alone is quadratic. From `whole` vectors on
a table is first cut into cells of some further projections (at random offsets), with as many tables more as keep the
recall; the number of vectors in a cell stays near `whole`.
A pair is dealt with in the first table in which it meets, so links are counted once. Equal vectors are one vector
with a multiplicity, and no pair leaves a task unless it connects two components there.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise
from .graph import components, stars

_SEED = 20_011


def _least_hits(tries: int, p: float, miss: float) -> int:
    """The largest c with P(Bin(tries, p) < c) <= miss."""
    tail = 0.0
    for c in range(tries + 1):
        tail += math.comb(tries, c) * p**c * (1 - p) ** (tries - c)
        if tail > miss:
            return c
    return tries


class Plan:
    """Numbers of projections, tables and collisions for n vectors, from the recall asked for at the threshold."""

    COUNTED, FIRST = 48, 24  # projections counted, and those of them counted for every pair in a window
    CELL = 4.0  # width of a cell, in standard deviations of the difference of two vectors at the threshold
    STEP = 0.04  # of a sketch's numbers; values lie within 5 of 0

    def __init__(self, n: int, cosine: float, recall: float = 0.99, miss: float = 5e-4, whole: int = 8192) -> None:
        self.cosine = cosine
        self.deviation = math.sqrt(max(1e-12, 2 - 2 * cosine))
        self.cell = self.CELL * self.deviation
        apart = self._share(self.cell / math.sqrt(2))
        #: projections that cut a table into cells
        self.k = 0 if n <= whole else math.ceil(math.log(n / whole) / -math.log(apart))
        # windows of two deviations: a linked pair is inside with 0.9545 in each projection
        self.window = min(127, math.ceil(2 * self.deviation / self.STEP) + 1)
        meets = 0.9545 * self._share(self.CELL) ** self.k
        self.tables = max(1, math.ceil(math.log(1 - recall) / math.log(1 - meets)))
        self.first_least, self.least = _least_hits(self.FIRST, 0.9545, miss / 2), _least_hits(self.COUNTED, 0.9545, miss / 2)

    @staticmethod
    def _share(r: float) -> float:
        """Chance that two values with a normal difference fall in one cell of r of its deviations, at a random offset."""
        return math.erf(r / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))

    def sorting(self, tab: int) -> int:
        return tab % self.COUNTED

    def sketches(self, unit: np.ndarray) -> np.ndarray:
        """One signed byte for each projection."""
        direct = np.random.default_rng([_SEED, unit.shape[1]]).standard_normal((unit.shape[1], self.COUNTED))
        return np.clip(np.rint(unit @ direct / self.STEP), -127, 127).astype(np.int8)

    def cells(self, unit: np.ndarray) -> np.ndarray:
        """A 64-bit name of each vector's cell in each table; vectors of different lengths never share one."""
        names = np.full((len(unit), self.tables), np.uint64(unit.shape[1]))
        if self.k:
            rng = np.random.default_rng([_SEED + 1, unit.shape[1]])
            direct, offset = rng.standard_normal((unit.shape[1], self.tables * self.k)), rng.random(self.tables * self.k)
            at = np.floor(unit @ direct / self.cell + offset).astype(np.int64).reshape(len(unit), self.tables, self.k)
            with np.errstate(over="ignore"):
                for i in range(self.k):
                    names = (names ^ at[:, :, i].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
                    names ^= names >> np.uint64(29)
        return names.view(np.int64)

    def collisions(self, left: np.ndarray, right: np.ndarray, sort: int, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
        """(rows of left, rows of right, pairs looked at): pairs in each other's window of projection `sort` with enough
        collisions in the first projections, some hundred queries at a time. same: left is right, each pair once."""
        w = self.window
        ox, oy = np.argsort(left[:, sort], kind="stable"), np.argsort(right[:, sort], kind="stable")
        sx, sy = left[ox, sort].astype(np.int16), right[oy, sort].astype(np.int16)
        first = [sort, *[j for j in range(self.FIRST + 1) if j != sort]][: self.FIRST]
        ys = np.ascontiguousarray(right[oy][:, first].T).view(np.uint8)
        xs = (left[ox][:, first].astype(np.int16) + w).astype(np.uint8)
        for a in range(0, len(ox), 256):
            b = min(a + 256, len(ox))
            lo, hi = int(np.searchsorted(sy, sx[a] - w)), int(np.searchsorted(sy, sx[b - 1] + w, side="right"))
            lo = max(lo, a) if same else lo
            for c in range(lo, hi, 16_384):
                d = min(c + 16_384, hi)
                # within the window: 0 <= x - y + w <= 2 w, in bytes that wrap
                near = xs[a:b, 0][:, None] - ys[0, c:d][None, :] <= 2 * w
                hits = near.view(np.uint8).copy()
                for j in range(1, self.FIRST):
                    hits += (xs[a:b, j][:, None] - ys[j, c:d][None, :] <= 2 * w).view(np.uint8)
                i, k = np.nonzero(near & (hits >= self.first_least))
                if same:
                    later = k + c > i + a
                    i, k = i[later], k[later]
                yield ox[i + a], oy[k + c], (b - a) * (d - c)

    def counted(self, left: np.ndarray, right: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Which of the pairs have enough collisions over all projections."""
        out = np.zeros(len(x), bool)
        for a in range(0, len(x), 1 << 17):
            p, q = left[x[a : a + (1 << 17)]].astype(np.int16), right[y[a : a + (1 << 17)]].astype(np.int16)
            out[a : a + (1 << 17)] = (np.abs(p - q) <= self.window).sum(axis=1) >= self.least
        return out


def _units(raw: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, unit vectors) for the packed vectors of each length."""
    sizes = np.array([len(r) for r in raw], np.int64)
    for n in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == n)
        v = np.frombuffer(b"".join([raw[i] for i in rows.tolist()]), "<f8").reshape(len(rows), -1)
        v = v / np.abs(v).max(axis=1, keepdims=True)
        yield rows, v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def _packed(vectors: DataFrame) -> DataFrame:
    """The rows with their vectors as packed doubles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(batch.num_columns - 1)
            flat = values.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
            ends = np.cumsum(values.value_lengths().to_numpy(zero_copy_only=False)).astype(int).tolist() if len(values) else []
            raw = [flat[a:b].tobytes() for a, b in zip([0, *ends[:-1]], ends, strict=True)] if ends else []
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(raw, pa.binary())], names=batch.schema.names)

    return vectors.select("key", "h1", "h2", "many", "first", "vector").mapInArrow(run, "key long, h1 long, h2 long, many long, first long, vector binary")


def _sketched(vectors: DataFrame, plan: Plan) -> DataFrame:
    """key, sketch, cells (one for each table) of each vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, unit in _units(batch.column(1).to_pylist()):
                sketch = [s.tobytes() for s in plan.sketches(unit)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(sketch, pa.binary()), pa.array(list(plan.cells(unit)), pa.list_(pa.int64()))], names=["key", "sketch", "cells"])

    return vectors.select("key", "vector").mapInArrow(run, "key long, sketch binary, cells array<long>")


_PLACE = "tab int, cell long, part int, left int, right int, side int, key long"


def _groups(table: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """(left rows, right rows, same) for each cell of a task."""
    cell, side = table.column("cell").to_numpy(), table.column("side").to_numpy()
    two = table.column("left")[0].as_py() != table.column("right")[0].as_py()
    order = np.argsort(cell, kind="stable")
    cuts = np.flatnonzero(np.concatenate([[True], cell[order][1:] != cell[order][:-1], [True]]))
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        rows = order[a:b]
        if two:
            low = side[rows] == table.column("left")[0].as_py()
            if low.any() and not low.all():
                yield rows[low], rows[~low], False
        elif len(rows) > 1:
            yield rows, rows, True


def _with_partners(met: DataFrame, plan: Plan) -> DataFrame:
    """The places of ids that have a counted pair there."""

    def run(table: pa.Table) -> pa.Table:
        tab = table.column("tab")[0].as_py()
        sketch = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.int8).reshape(table.num_rows, -1)
        there = np.zeros(table.num_rows, bool)
        for xs, ys, same in _groups(table):
            left, right = sketch[xs], sketch[ys]
            for x, y, looked in plan.collisions(left, right, plan.sorting(tab), same):
                if 20 * len(x) < looked:  # in a dense place all go on, and are counted with their vectors
                    good = plan.counted(left, right, x, y)
                    x, y = x[good], y[good]
                there[xs[x]] = there[ys[y]] = True
        return table.select([c.split()[0] for c in _PLACE.split(", ")]).take(pa.array(np.flatnonzero(there)))

    return met.groupBy("tab", "part", "left", "right").applyInArrow(run, _PLACE)


def _links(met: DataFrame, plan: Plan) -> DataFrame:
    """kind 0: vector a has b further links; kind 1: a and b are connected."""

    def run(table: pa.Table) -> pa.Table:
        tab = table.column("tab")[0].as_py()
        key, many = table.column("key").to_numpy(), table.column("many").to_numpy()
        raw, more, pairs = table.column("vector").to_pylist(), np.zeros(table.num_rows, np.int64), []
        for xs, ys, same in _groups(table):
            # a cell's vectors have one length
            rows = xs if same else np.concatenate([xs, ys])
            ((_, unit),) = _units([raw[i] for i in rows.tolist()])
            sketch, cells = plan.sketches(unit), plan.cells(unit) if plan.k else None
            cut = len(rows) if same else len(xs)
            lu, ru = unit[:cut], unit if same else unit[cut:]
            ls, rs = sketch[:cut], sketch if same else sketch[cut:]
            for x, y, looked in plan.collisions(ls, rs, plan.sorting(tab), same):
                if not len(x):
                    continue
                good = plan.counted(ls, rs, x, y)
                x, y = x[good], y[good]
                if 20 * len(x) > looked:
                    ix, iy = np.unique(x, return_inverse=True), np.unique(y, return_inverse=True)
                    good = (lu[ix[0]] @ ru[iy[0]].T)[ix[1], iy[1]] >= plan.cosine - 1e-9
                    x, y = x[good], y[good]
                good = np.concatenate([np.einsum("ij,ij->i", lu[x[k : k + 65_536]], ru[y[k : k + 65_536]]) >= plan.cosine for k in range(0, max(1, len(x)), 65_536)])
                x, y = x[good], y[good]
                for t in range(tab):  # pairs that met in a table before
                    fresh = np.abs(ls[x, plan.sorting(t)].astype(np.int16) - rs[y, plan.sorting(t)]) > plan.window
                    if cells is not None:
                        fresh |= cells[:cut][x, t] != (cells if same else cells[cut:])[y, t]
                    x, y = x[fresh], y[fresh]
                if len(x):
                    more += np.bincount(xs[x], many[ys[y]], len(more)).astype(np.int64) + np.bincount(ys[y], many[xs[x]], len(more)).astype(np.int64)
                    u, v = stars(zip(key[xs[x]].tolist(), key[ys[y]].tolist(), strict=True))
                    pairs += zip(u, v, strict=True)
        u, v = stars(pairs)
        at = np.flatnonzero(more)
        return pa.table({"kind": pa.array([0] * len(at) + [1] * len(u), pa.int32()), "a": pa.array([*key[at].tolist(), *u], pa.int64()), "b": pa.array([*more[at].tolist(), *v], pa.int64())})

    return met.groupBy("tab", "part", "left", "right").applyInArrow(run, "kind int, a long, b long")


def near_duplicates(rows: DataFrame, cosine: float = 0.8, recall: float = 0.99, vec_id: str = "vec_id", vector: str = "embedding", block: int = 8192, whole: int = 8192) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of rows.

    Vectors that are null, empty, zero, or hold null or non-finite components link with nothing, as do vectors of
    different lengths. Equal vectors link. Rows with null ids are counted as links; a component of null ids only has a
    null component_id, and null ids are not kept. An empty table gives an empty table. Links below the threshold are
    never made; each at or above it is found with probability `recall` or more. Cells of more than `block` vectors are
    compared in pairs of blocks. Vectors are told apart by 128-bit hashes.
    """
    value = F.col(vector)
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    good = F.coalesce((F.size(value) > 0) & F.forall(value, finite) & F.exists(value, lambda x: x != 0), F.lit(False))
    double = value.cast("array<double>")
    keyed = rows.select(F.col(vec_id).cast("long").alias("vec_id"), F.when(good, F.xxhash64(double)).alias("h1"), F.when(good, F.xxhash64(F.lit(7), double)).alias("h2"), F.when(good, double).alias("vector"))
    distinct = keyed.where("h1 is not null").groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("many"), F.first("vector").alias("vector"), F.min("vec_id").alias("first"))
    distinct = materialise(_packed(distinct.withColumn("key", F.monotonically_increasing_id())), "vectors")
    n = distinct.count()
    plan = Plan(n, cosine, recall, whole=whole)
    sketched = materialise(_sketched(distinct, plan), "sketches")
    dealt = sketched.select("key", "sketch", F.posexplode("cells").alias("tab", "cell"))
    spots = max(1, n // block)
    hot = materialise(dealt.groupBy("tab", "cell").count().where(F.col("count") > block), "hot-cells")
    dealt = dealt.join(hot, ["tab", "cell"], "left").withColumn("blocks", F.coalesce(F.ceil(F.col("count") / block).cast("int"), F.lit(1)))
    dealt = dealt.withColumn("side", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    part = F.when(F.col("blocks") > 1, -1 - F.pmod(F.xxhash64("cell"), F.lit(1 << 30))).otherwise(F.pmod(F.xxhash64("cell"), F.lit(spots))).cast("int")
    met = dealt.select("tab", "cell", part.alias("part"), F.least("side", "other").alias("left"), F.greatest("side", "other").alias("right"), "side", "key", "sketch")
    places = materialise(_with_partners(met, plan), "partners")
    full = places.join(distinct.select("key", "many", "vector"), "key")
    links = materialise(_links(full, plan), "vector-links")
    more = links.where("kind = 0").groupBy(F.col("a").alias("key")).agg(F.sum("b").alias("more"))
    joined = components(links.where("kind = 1"))
    named = materialise(distinct.select("key", "h1", "h2", "many", "first").join(joined, F.col("key") == F.col("node"), "left").withColumn("component", F.coalesce("component", "key")).join(more, "key", "left").select("h1", "h2", "component", "first", (F.col("many") - 1 + F.coalesce("more", F.lit(0))).alias("n_links")), "vector-classes")
    roots = materialise(named.groupBy("component").agg(F.min("first").alias("component_id")), "vector-roots")
    classes = materialise(named.join(roots.hint("merge"), "component").select("h1", "h2", "n_links", "component_id"), "vector-components")
    found = keyed.where("h1 is not null").join(classes.hint("merge"), ["h1", "h2"]).select("vec_id", "n_links", "component_id")
    rest = keyed.where("h1 is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return found.unionByName(rest).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op9_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), cosine=0.9, recall=0.9995)


OP9_SQL = """
WITH RECURSIVE v AS (SELECT row_number() OVER () rid, vec_id, embedding::DOUBLE[] e FROM embeddings),
u AS (SELECT * FROM v WHERE e IS NOT NULL AND len(e) > 0 AND list_count(e) = len(e) AND len(list_filter(e, lambda x: NOT isfinite(x))) = 0 AND list_sum(list_transform(e, lambda x: abs(x))) > 0),
l AS (SELECT a.rid x, b.rid y FROM u a JOIN u b ON a.rid <> b.rid AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.9),
r AS (SELECT rid, rid AS o FROM v UNION SELECT r.rid, l.y FROM r JOIN l ON l.x = r.o),
c AS (SELECT r.rid, min(t.vec_id) component_id FROM r JOIN v t ON t.rid = r.o GROUP BY r.rid),
n AS (SELECT x rid, count(*) n FROM l GROUP BY x)
SELECT vec_id, coalesce(n, 0)::BIGINT n_links, component_id, vec_id = component_id AS kept FROM v JOIN c USING (rid) LEFT JOIN n USING (rid)
"""
