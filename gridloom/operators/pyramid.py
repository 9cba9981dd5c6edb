"""Lower zoom levels by uniform subsampling, level by level.

The points of a level are the unit of work, not bytes: each level groups the kept points of the one below by parent
tile, finds one ratio for the level, and keeps the first points of a seeded hash order in each tile.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.projection import origin_x, origin_y, scale
from ..functions.tileid import with_tile_id
from ..sources import mlt, mvt
from ..sources.archive import COMPRESSION as PACKINGS
from ..sources.archive import TILE_TYPES, compress, open_front
from ..sources.scratch import materialise
from ..sources.tiles import read_stored_points, read_tiles, stored_schema, unpacked_value
from ..sources.writer import write_archive

GZIP = PACKINGS["gzip"]

#: Fixed values of the size model.
MAX_BYTES, MAX_FEATURES, COMPRESSION, BYTES_COLUMN, BYTES_POINT, DAMPING = 500_000, 50_000, 10.0, 8, 20, 0.95


def level_ratio(parents: DataFrame, max_bytes: int = MAX_BYTES, max_features: int = MAX_FEATURES, compression: float = COMPRESSION) -> DataFrame:
    """max_n, max_est, ratio: the share of points a level keeps. parents: n, est (bytes before packing) of each tile."""
    top = parents.agg(F.max("n").alias("max_n"), F.max("est").alias("max_est"))
    by_n = F.when(F.col("max_n") > max_features, F.lit(float(max_features)) / F.col("max_n")).otherwise(F.lit(1.0))
    budget = max_bytes * compression
    by_bytes = F.when(F.col("max_est") > budget, F.lit(float(budget)) / F.col("max_est")).otherwise(F.lit(1.0))
    return top.select("max_n", "max_est", F.least(by_n, by_bytes).alias("ratio"))


def tile_cap(n: F.Column, ratio: F.Column) -> F.Column:
    """Points a tile may keep: the ratio's share, at least one."""
    return F.greatest((ratio * n).cast("long"), F.lit(1).cast("long"))


def column_cap(cap: F.Column, columns: int, max_bytes: int = MAX_BYTES, compression: float = COMPRESSION, per_column: int = BYTES_COLUMN, per_point: int = BYTES_POINT) -> F.Column:
    """The cap after the size estimate of columnar tiles, which grows in proportion: one shrink step suffices."""
    each, budget = per_point + columns * per_column, max_bytes * compression
    smaller = F.greatest((cap * (F.lit(float(budget)) / (cap * F.lit(each))) * F.lit(DAMPING)).cast("long"), F.lit(1).cast("long"))
    return F.when(cap * each > budget, smaller).otherwise(cap)


def seed_of(z: int, x: str, y: str) -> F.Column:
    return F.pmod(F.lit(z * 1_000_000).cast("long") + F.col(x) * 1000 + F.col(y), F.lit(1 << 32))


#: Tiles up to so many points are ranked as they are; a step of the search looks at so many digits of the hash.
RANKED, DIGITS, HASH_DIGITS = 100_000, 4, 32


def _hashed(points: DataFrame, z: int, key: tuple[str, str], idx: str) -> DataFrame:
    return points.withColumn("_order", F.md5(F.concat_ws("|", seed_of(z, *key).cast("string"), F.col(idx).cast("string"))))


def thresholds(points: DataFrame, caps: DataFrame, z: int, key: tuple[str, str] = ("tx", "ty"), idx: str = "idx", ranked: int = RANKED) -> DataFrame:
    """key, cap, prefix, before, size: the tile's first `cap` points by hash are the `before` points whose hash is below
    the prefix and the first of the `size` points whose hash begins with it, of which there are at most about `ranked`.

    caps: key, cap and n (the tile's points). Points of larger tiles are counted by the next digits of their hash, with
    partial sums in each task; only points under the prefix so far are counted again. All passes read points, none sorts.
    """
    spark = points.sparkSession
    now = materialise(caps.select(*key, "cap", F.lit("").alias("prefix"), F.lit(0).cast("long").alias("before"), F.col("n").cast("long").alias("size")), "thresholds")
    hashed = _hashed(points.select(*key, idx), z, key, idx)
    for length in range(0, HASH_DIGITS, DIGITS):
        large = now.where((F.col("size") > ranked) & (F.length("prefix") == length))
        if large.isEmpty():
            break
        under = hashed.join(large, list(key)).where(F.substring("_order", 1, length) == F.col("prefix")) if length else hashed.join(large, list(key))
        found = under.groupBy(*key, F.substring("_order", 1, length + DIGITS).alias("next")).agg(F.count(F.lit(1)).alias("n"), F.first("cap").alias("cap"), F.first("before").alias("before"))
        # at most 16**DIGITS rows a tile
        upto = F.sum("n").over(Window.partitionBy(*key).orderBy("next")) + F.col("before")
        found = found.withColumn("upto", upto).where(F.col("upto") >= F.col("cap"))
        first = F.min_by(F.struct(F.col("next").alias("prefix"), (F.col("upto") - F.col("n")).alias("before"), F.col("n").alias("size")), "next")
        deeper = found.groupBy(*key).agg(F.first("cap").alias("cap"), first.alias("to")).select(*key, "cap", "to.*")
        # a tile with fewer points than its cap keeps them all: every hash is below this prefix
        every = large.join(deeper.select(*key), list(key), "left_anti").select(*key, "cap", F.lit("~").alias("prefix"), F.lit(0).cast("long").alias("before"), F.lit(0).cast("long").alias("size"))
        rest = now.join(large.select(*key), list(key), "left_anti")
        now = materialise(rest.unionByName(deeper).unionByName(every), "thresholds")
    return now


def sample(points: DataFrame, caps: DataFrame, z: int, key: tuple[str, str] = ("tx", "ty"), idx: str = "idx", ranked: int = RANKED) -> DataFrame:
    """The first points of each tile (as many as its cap) in the order of a hash of the tile's seed and the point's place,
    equal hashes by place. caps: key, cap, n. The same points come out however the input is partitioned, and no task
    ranks more of a tile than about `ranked` points: what lies below the tile's threshold stays without being sorted."""
    if caps.where(F.col("n") > ranked).isEmpty():
        return picked(points.join(caps.select(*key, F.col("cap").alias("_cap")), list(key)), z, key, idx).where("pick <= _cap").select(*points.columns)
    wide = _hashed(points, z, key, idx).join(thresholds(points, caps, z, key, idx, ranked).drop("size"), list(key))
    head = F.substring(F.col("_order"), F.lit(1), F.length("prefix"))
    below = wide.where(head < F.col("prefix")).select(*points.columns)
    order = Window.partitionBy(*key).orderBy("_order", idx)
    edge = wide.where(head == F.col("prefix")).withColumn("_pick", F.row_number().over(order)).where(F.col("_pick") <= F.col("cap") - F.col("before"))
    return below.unionByName(edge.select(*points.columns))


def picked(kept: DataFrame, z: int, key: tuple[str, str] = ("tx", "ty"), idx: str = "idx") -> DataFrame:
    """A sample with `pick`, the 1-based rank of each point in the order in which sample() takes them."""
    rank = F.row_number().over(Window.partitionBy(*key).orderBy("_order", idx))
    return _hashed(kept, z, key, idx).withColumn("pick", rank).drop("_order")


def _row_cap(points: DataFrame, budget: float) -> DataFrame:
    """tx, ty, keep: how many of a tile's picks fit the size estimate of row-oriented tiles."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("pick")
        layers, rows = table.column("layer").to_pylist(), table.column("attrs").to_pylist()
        cur = table.num_rows
        while cur > 1:
            keys, values, tags = set(), set(), 0
            for layer, own in zip(layers[:cur], rows[:cur], strict=True):
                keys |= {(layer, k) for k, _ in own}
                values |= {(layer, v) for _, v in own}
                tags += 2 * len(own)
            total = sum(50 + len(n) for n in set(layers[:cur])) + sum(len(k) + 2 for _, k in keys) + sum(len(v) + 2 for _, v in values) + 10 * cur + tags
            if total <= budget:
                break
            smaller = int(cur * (budget / total) * DAMPING)
            cur = max(1, smaller if smaller < cur else cur - 1)
        return pa.table({"tx": table.column("tx")[:1], "ty": table.column("ty")[:1], "keep": pa.array([cur], pa.int64())})

    return points.select("tx", "ty", "pick", "layer", "attrs").groupBy("tx", "ty").applyInArrow(run, "tx long, ty long, keep long")


def _encoded(level: DataFrame, codec: str, schema: dict[str, dict[str, tuple[str, bool]]]) -> DataFrame:
    """tile_id, tx, ty, n, data: packed tiles of a level, layer by layer, with values and types as they were stored."""

    def columns(rows: list[dict[str, object]], layer: str) -> tuple[dict[str, list], dict[str, str], dict[str, bool]]:
        own = schema[layer]
        cast = {"int": lambda v: v, "float": float, "string": mlt.text_of}
        values = {c: [None if r.get(c) is None else cast[own[c][0]](r[c]) for r in rows] for c in own}
        return values, {c: t for c, (t, _) in own.items()}, {c: n for c, (_, n) in own.items()}

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("layer", "ascending"), ("seq", "ascending")])
        names, xs, ys, attrs = (table.column(c).to_pylist() for c in ("layer", "px", "py", "attrs"))
        out, at = [], 0
        for name, n in Counter(names).items():
            part = slice(at, at + n)
            if codec == "mlt":
                values, types, nulls = columns([{k: unpacked_value(v) for k, v in row} for row in attrs[part]], name)
                out.append(mlt.encode_layer(name, xs[part], ys[part], values, types, nulls))
            else:
                out.append(mvt.encode_raw(name, xs[part], ys[part], attrs[part]))
            at += n
        return pa.table({"tile_id": table.column("tile_id")[:1], "tx": table.column("tx")[:1], "ty": table.column("ty")[:1], "n": pa.array([len(xs)], pa.int64()), "data": pa.array([compress(b"".join(out))], pa.binary())})

    own = level.select("tile_id", "tx", "ty", "layer", "seq", "px", "py", "attrs")
    return own.groupBy("tile_id").applyInArrow(run, "tile_id long, tx long, ty long, n long, data binary")


def level_up(points: DataFrame, tiles: DataFrame, z: int, codec: str, n_columns: int, max_bytes: int = MAX_BYTES, max_features: int = MAX_FEATURES, compression: float = COMPRESSION, per_column: int = BYTES_COLUMN, per_point: int = BYTES_POINT) -> DataFrame:
    """Points kept at zoom z, from those of z + 1 (tx, ty, layer, seq, gx, gy, attrs) and their packed tiles (tx, ty, n, bytes)."""
    up = lambda c: F.shiftright(F.col(c), 1).alias(c)
    parents = tiles.select(up("tx"), up("ty"), "n", "bytes").groupBy("tx", "ty").agg(F.sum("n").cast("long").alias("n"), (F.sum("bytes") * F.lit(float(compression))).cast("long").alias("est"))
    parents = materialise(parents, "parents")
    ratio = level_ratio(parents, max_bytes, max_features, compression).first()["ratio"]
    if ratio is None:
        ratio = 1.0
    caps = parents.withColumn("cap", tile_cap(F.col("n"), F.lit(float(ratio))))
    if codec == "mlt":
        caps = caps.withColumn("cap", column_cap(F.col("cap"), n_columns, max_bytes, compression, per_column, per_point))
    # the place of a point among its parent's: lower half first, then left, then its own place
    quarter = (F.col("ty").bitwiseAND(1) * 2 + F.col("tx").bitwiseAND(1)).cast("long")
    moved = points.withColumn("idx", quarter * F.lit(1 << 40) + F.col("seq")).withColumns({"tx": F.shiftright("tx", 1), "ty": F.shiftright("ty", 1)})
    kept = sample(moved, caps.select("tx", "ty", "cap", "n"), z)
    if codec == "mvt":
        kept = materialise(picked(kept, z), "picked")
        kept = kept.join(_row_cap(kept, max_bytes * compression), ["tx", "ty"]).where("pick <= keep").drop("keep")
    s = F.lit(scale(z))
    kept = kept.withColumn("seq", F.row_number().over(Window.partitionBy("tx", "ty").orderBy("layer", "idx")).cast("long") - 1)
    place = {"px": F.round((F.col("gx") - origin_x("tx", z)) / s).cast("int"), "py": F.round((origin_y("ty", z) - F.col("gy")) / s).cast("int")}
    return with_tile_id(kept.withColumns(place).drop("idx", "pick"), "tx", "ty", z)


def build_pyramid(spark: SparkSession, source: str, out: str, min_zoom: int = 0, max_tile_bytes: int = MAX_BYTES, max_tile_features: int = MAX_FEATURES, scale_factor_compression: float = COMPRESSION, est_bytes_per_column: int = BYTES_COLUMN, est_offset_per_point: int = BYTES_POINT) -> dict[int, int]:
    """Adds all zoom levels from the highest one's parents down to min_zoom; returns points kept by zoom.

    Tiles of the highest zoom are copied as they are. Below it, layers stay apart and values keep their stored form:
    the messages of row-oriented tiles, the column types of columnar ones.
    """
    archive = open_front(source)
    codec, top = archive.codec, archive.header["max_zoom"]
    low = min(min_zoom, top)
    at_top = read_tiles(spark, source).where(F.col("z") == top)
    schema = stored_schema(at_top) if codec == "mlt" else {}
    n_columns = max(map(len, schema.values()), default=0)
    level = materialise(read_stored_points(at_top, codec), "level")
    counts = level.groupBy("tx", "ty").agg(F.count(F.lit(1)).alias("n"))
    copied = read_tiles(spark, source, stored=True).where(F.col("z") == top).select("tile_id", F.col("x").alias("tx"), F.col("y").alias("ty"), "data")
    if archive.header["tile_compression"] != GZIP:
        copied = copied.mapInArrow(_compressed, copied.schema)
    tiles = materialise(copied.join(counts, ["tx", "ty"], "left").select("tile_id", "tx", "ty", F.coalesce("n", F.lit(0).cast("long")).alias("n"), "data"), "copied")
    every, kept = tiles, {top: tiles.agg(F.sum("n")).first()[0] or 0}
    for z in range(top - 1, low - 1, -1):
        sizes = tiles.where("n > 0").select("tx", "ty", "n", F.length("data").cast("long").alias("bytes"))
        level = materialise(level_up(level, sizes, z, codec, n_columns, max_tile_bytes, max_tile_features, scale_factor_compression, est_bytes_per_column, est_offset_per_point), "level")
        tiles = materialise(_encoded(level, codec, schema), "encoded")
        kept[z] = tiles.agg(F.sum("n")).first()[0] or 0
        every = every.unionByName(tiles)
    metadata = dict(archive.metadata)
    for part in [*metadata.get("vector_layers", []), *metadata.get("tilestats", {}).get("layers", [])]:
        if "minzoom" in part:
            part["minzoom"] = low
    header = archive.header | {"min_zoom": low, "clustered": 0, "tile_type": TILE_TYPES[codec], "tile_compression": GZIP}
    write_archive(every, out, header, metadata)
    return kept


def _compressed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([compress(d) for d in batch.column(3).to_pylist()], pa.binary())], names=batch.schema.names)
