"""From delimited text or a table of points to a single-zoom archive."""

from __future__ import annotations

import math
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from ..functions.projection import in_plane, latitude, local_x, local_y, longitude, pixel, tile_x, tile_y
from ..functions.text import MISSING, prefix_double
from ..functions.tileid import id_of, with_tile_id, zxy_of
from ..sources import mlt, mvt
from ..sources.archive import TILE_TYPES, compress
from ..sources.delimited import read_delimited
from ..sources.scratch import materialise
from ..sources.writer import write_archive

_FLOAT = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+|0[xX][0-9a-fA-F]+|[iI][nN][fF]|[nN][aA][nN])"


def is_missing(v: Column) -> Column:
    return v.isNull() | v.isin(*MISSING)


def is_int(v: Column) -> Column:
    return v.rlike(r"^\s*[+-]?[0-9]+$") & F.trim(v).try_cast("long").isNotNull()


def is_float(v: Column, name: str) -> Column:
    """A number leads the text and fits a double."""
    value = prefix_double(name)
    return v.rlike(_FLOAT) & ~F.coalesce((F.abs(value) == F.lit(float("inf"))), F.lit(False))


def infer_types(rows: DataFrame, columns: list[str]) -> DataFrame:
    """column, type (INT, FLOAT or STRING), nullable: the narrowest type that all values of a column fit.

    Each value is looked at once (0 missing, 1 whole, 2 number, 3 other); then one pass with two aggregates a column.
    A column without values is a nullable INT.
    """
    kinds = []
    for k, c in enumerate(columns):
        v = F.col(f"`{c}`")
        kinds.append(F.when(is_missing(v), 0).when(is_int(v), 1).when(is_float(v, c), 2).otherwise(3).alias(f"k{k}"))
    parts = [F.struct(F.lit(c).alias("column"), F.coalesce(F.max(f"k{k}"), F.lit(0)).alias("kind"), F.coalesce(F.min(f"k{k}") == 0, F.lit(False)).alias("nullable")) for k, c in enumerate(columns)]
    found = rows.select(*kinds).agg(F.array(*parts).alias("r")).select(F.explode("r").alias("r"))
    kind = F.when(F.col("r.kind") <= 1, F.lit("INT")).when(F.col("r.kind") == 2, F.lit("FLOAT")).otherwise(F.lit("STRING"))
    return found.select(F.col("r.column").alias("column"), kind.alias("type"), F.col("r.nullable").alias("nullable"))


def value_of(c: str, kind: str) -> Column:
    """A text field as its column's type; missing fields are null."""
    v = F.col(f"`{c}`")
    if kind == "INT":
        own = F.trim(v).try_cast("long")
    elif kind == "FLOAT":
        low = F.lower(F.trim(v))
        special = F.when(low.rlike(r"^[+-]?nan"), F.lit(float("nan"))).when(low.rlike(r"^-inf"), F.lit(float("-inf"))).when(low.rlike(r"^\+?inf"), F.lit(float("inf")))
        hexed = F.when(low.rlike(r"^[+-]?0x[0-9a-f]"), F.conv(F.regexp_extract(low, r"0x([0-9a-f]+)", 1), 16, 10).cast("double") * F.when(low.startswith("-"), -1.0).otherwise(1.0))
        own = F.coalesce(special, hexed, prefix_double(c))
    else:
        own = v
    return F.when(~is_missing(v), own).alias(c)


def place(rows: DataFrame, zoom: int, x: str = "gx", y: str = "gy") -> DataFrame:
    """rows with tx, ty, px, py, tile_id; rows outside the plane are left out (see outside())."""
    inside = rows.where(in_plane(x, y, zoom)).withColumns({"tx": tile_x(x, zoom), "ty": tile_y(y, zoom)})
    own = {"px": pixel(local_x(x, "tx", zoom)).cast("int"), "py": pixel(local_y(y, "ty", zoom)).cast("int")}
    return with_tile_id(inside.withColumns(own), "tx", "ty", zoom)


def outside(rows: DataFrame, zoom: int, x: str = "gx", y: str = "gy") -> DataFrame:
    return rows.where(~F.coalesce(in_plane(x, y, zoom), F.lit(False)))


#: Tiles of more points than this are encoded in chunks by several tasks.
CHUNK = 128 * mlt.ALIGN


def encode_tiles(placed: DataFrame, codec: str, layer: str, types: dict[str, str], nullable: dict[str, bool] | None = None, order: str = "seq", ids: bool = False, chunk: int = CHUNK) -> DataFrame:
    """tile_id, n, data: packed tiles, their points in order of `order`. A tile is encoded by one task; columnar tiles of
    more than `chunk` points (a multiple of mlt.ALIGN) by one for each so many, whose streams are then joined. Row-oriented
    tiles have dictionaries over all their points and are not cut."""
    if codec != "mlt":
        return _whole_tiles(placed, codec, layer, types, nullable, order, ids)
    large = materialise(placed.groupBy("tile_id").count().where(F.col("count") > chunk).select("tile_id"), "large-tiles")
    if large.isEmpty():
        return _whole_tiles(placed, codec, layer, types, nullable, order, ids)
    small = _whole_tiles(placed.join(large, "tile_id", "left_anti"), codec, layer, types, nullable, order, ids)
    return small.unionByName(_joined_tiles(placed.join(large, "tile_id", "left_semi"), layer, types, nullable, order, chunk))


def _kinds(types: dict[str, str]) -> dict[str, str]:
    return {c: {"INT": "int", "FLOAT": "float", "STRING": "string"}[t] for c, t in types.items()}


def _columns(placed: DataFrame, order: str, columns: list[str], *more: str) -> DataFrame:
    return placed.select("tile_id", "px", "py", F.col(order).alias("seq"), *more, *[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(columns)])


def _whole_tiles(placed: DataFrame, codec: str, layer: str, types: dict[str, str], nullable: dict[str, bool] | None, order: str, ids: bool) -> DataFrame:
    columns, kinds = list(types), _kinds(types)

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("seq")
        if codec == "mlt":
            values = {c: table.column(f"c{k}").to_pylist() for k, c in enumerate(columns)}
            data = mlt.encode_layer(layer, table.column("px").to_pylist(), table.column("py").to_pylist(), values, kinds, nullable)
        else:
            data = mvt.encode_points(layer, table.column("px").to_numpy(), table.column("py").to_numpy(), {c: table.column(f"c{k}") for k, c in enumerate(columns)}, ids=ids)
        return pa.table({"tile_id": pa.array([table.column("tile_id")[0].as_py()], pa.int64()), "n": pa.array([len(table)], pa.int64()), "data": pa.array([compress(data)], pa.binary())})

    return _columns(placed, order, columns).groupBy("tile_id").applyInArrow(run, "tile_id long, n long, data binary")


def numbered(rows: DataFrame, key: str, order: str, name: str = "nth") -> DataFrame:
    """rows with their place (from 0) among the rows of their key, in order. Rows are sorted by range, so that a key with
    very many rows is spread over tasks; each task counts its own, and what came before is summed over tasks."""
    own, part = f"_{name}", f"_{name}_part"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, seen, task = None, 0, TaskContext.get().partitionId()
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(at).to_numpy(zero_copy_only=False)
            begins = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
            starts = np.repeat(begins, np.diff(np.append(begins, len(keys))))
            places = np.arange(len(keys)) - starts
            if keys[0] == last:
                places[: begins[1] if len(begins) > 1 else len(keys)] += seen
            last, seen = keys[-1], int(places[-1]) + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(places, pa.int64()), pa.array(np.full(len(keys), task, np.int32))], names=[*batch.schema.names, own, part])

    at = rows.columns.index(key)
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ordered = rows.repartitionByRange(parts, key, order).sortWithinPartitions(key, order)
    schema = StructType([*rows.schema.fields, StructField(own, LongType()), StructField(part, IntegerType())])
    table = materialise(ordered.mapInArrow(run, schema), "numbered")
    before = Window.partitionBy(key).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    runs = table.groupBy(key, part).agg(F.count(F.lit(1)).alias("_n"))  # a row for each key of each task
    starts = runs.select(key, part, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return table.join(starts, [key, part]).withColumn(name, F.col("_before") + F.col(own)).select(*rows.columns, name)


def _joined_tiles(placed: DataFrame, layer: str, types: dict[str, str], nullable: dict[str, bool] | None, order: str, chunk: int) -> DataFrame:
    """Columnar tiles from chunks of their points."""
    if chunk % mlt.ALIGN:
        raise ValueError(f"chunks hold a multiple of {mlt.ALIGN} points")
    columns, kinds = list(types), _kinds(types)

    def encode(table: pa.Table) -> pa.Table:
        table = table.sort_by("nth")
        values = {c: table.column(f"c{k}").to_pylist() for k, c in enumerate(columns)}
        own = mlt.encode_chunk(table.column("px").to_pylist(), table.column("py").to_pylist(), values, kinds)
        streams = [own.vertices, *[part for c in own.columns for part in c[:3]]]
        row = {"tile_id": table.column("tile_id")[:1], "chunk": table.column("chunk")[:1], "streams": pa.array([streams], pa.list_(pa.binary())), "counts": pa.array([[own.n, *[c[3] for c in own.columns]]], pa.list_(pa.int64()))}
        return pa.table(row)

    def join(table: pa.Table) -> pa.Table:
        table = table.sort_by("chunk")
        chunks = []
        for streams, counts in zip(table.column("streams").to_pylist(), table.column("counts").to_pylist(), strict=True):
            chunks.append(mlt.MltChunk(counts[0], streams[0], [(*streams[1 + 3 * k : 4 + 3 * k], counts[1 + k]) for k in range(len(columns))]))
        data = compress(mlt.join_chunks(layer, chunks, kinds, nullable))
        return pa.table({"tile_id": table.column("tile_id")[:1], "n": pa.array([sum(k.n for k in chunks)], pa.int64()), "data": pa.array([data], pa.binary())})

    rows = numbered(_columns(placed, order, columns), "tile_id", "seq").withColumn("chunk", F.expr(f"nth div {chunk}"))
    chunks = rows.groupBy("tile_id", "chunk").applyInArrow(encode, "tile_id long, chunk long, streams array<binary>, counts array<long>")
    return chunks.groupBy("tile_id").applyInArrow(join, "tile_id long, n long, data binary")


def metadata_of(layer: str, codec: str, types: dict[str, str], zoom: int, n: int) -> dict:
    kinds = {c: "String" if t == "STRING" else "Number" for c, t in types.items()}
    return {
        "name": layer, "type": "overlay", "version": "2", "format": "pbf" if codec == "mvt" else codec,
        "vector_layers": [{"id": layer, "fields": kinds, "minzoom": zoom, "maxzoom": zoom}],
        "tilestats": {"layerCount": 1, "layers": [{"layer": layer, "count": n, "geometry": "Point", "attributeCount": len(kinds), "attributes": [{"attribute": c, "type": k.lower()} for c, k in kinds.items()]}]},
    }


def busiest_tile(counts: DataFrame) -> DataFrame:
    """tile_id of the most points, the lowest of equals."""
    return counts.agg(F.max_by("tile_id", F.struct("n", (-F.col("tile_id")).alias("o"))).alias("tile_id"))


def layer_name(path: str) -> str:
    """File name without its last extension."""
    return os.path.splitext(os.path.basename(path.rstrip("/")))[0]


def write_points(placed: DataFrame, path: str, zoom: int, codec: str, layer: str, types: dict[str, str], nullable: dict[str, bool] | None = None, x: str = "gx", y: str = "gy") -> dict:
    """Encodes placed points and writes the archive; returns its header fields."""
    tiles = materialise(encode_tiles(placed, codec, layer, types, nullable), "encoded")
    span = placed.agg(F.min(x).alias("x0"), F.max(x).alias("x1"), F.min(y).alias("y0"), F.max(y).alias("y1"))
    lonlat = span.select(*[(f(c) * 1e7).cast("long").cast("int").alias(c) for c, f in (("x0", longitude), ("y0", latitude), ("x1", longitude), ("y1", latitude))]).first()
    best = busiest_tile(tiles).first()["tile_id"]
    n = tiles.agg(F.sum("n")).first()[0] or 0
    header = {"clustered": 1, "tile_compression": 2, "tile_type": TILE_TYPES[codec], "min_zoom": zoom, "max_zoom": zoom, "center_zoom": zoom}
    if n:
        z, tx, ty = zxy_of(best)
        from ..functions.projection import HALF, RADIUS

        w = 2 * HALF / (1 << z)
        cx, cy = tx * w - HALF + 0.5 * w / 256, HALF - ty * w - 0.5 * w / 256
        header |= {"min_lon_e7": lonlat["x0"], "min_lat_e7": lonlat["y0"], "max_lon_e7": lonlat["x1"], "max_lat_e7": lonlat["y1"]}
        header |= {"center_lon_e7": int(cx / RADIUS * 180 / math.pi * 1e7), "center_lat_e7": int((2 * math.atan(math.exp(cy / RADIUS)) - math.pi / 2) * 180 / math.pi * 1e7)}
        assert id_of(z, tx, ty) == best
    write_archive(tiles, path, header, metadata_of(layer, codec, types, zoom, n))
    return header | {"points": n}


def build_points(spark: SparkSession, source: str, out: str, format: str = "MLT", zoom: int = 0, colname_x: str = "X", colname_y: str = "Y", delim: str = ",") -> dict:
    """A delimited file of points into an archive. Rows without usable coordinates are dropped; rows outside the plane
    are left out and counted."""
    if format.upper() not in ("MLT", "MVT"):
        raise ValueError("format must be MLT or MVT")
    rows = read_delimited(spark, source, delim)
    if colname_x not in rows.columns or colname_y not in rows.columns:
        raise ValueError(f"columns {colname_x} and {colname_y} are needed; there are {rows.columns}")
    columns = [c for c in rows.columns if c not in (colname_x, colname_y)]
    good = rows.withColumns({"gx": prefix_double(colname_x), "gy": prefix_double(colname_y)}).where("gx is not null and gy is not null")
    found = {r["column"]: r for r in infer_types(good, columns).collect()} if columns else {}
    types, nullable = {c: found[c]["type"] for c in columns}, {c: found[c]["nullable"] for c in columns}
    numbered = good.withColumn("seq", F.monotonically_increasing_id()).select("gx", "gy", "seq", *[value_of(c, types[c]) for c in columns])
    done = write_points(place(numbered, zoom), out, zoom, format.lower(), layer_name(source), types, nullable)
    return done | {"outside": outside(numbered, zoom).count()}
