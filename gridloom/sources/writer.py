"""The archive sink: packed tiles of a DataFrame into one file, without their bytes or a list of them on the driver.

Tiles are sorted by range and written as a table, in which each knows its place within its task. Summed over tasks (one
row each) these give all offsets. Leaves of the directory are made by tasks as well, each from its own stretch of
entries; the driver sees a pointer for each leaf, of which there are so few that the root holds them.
"""

from __future__ import annotations

import itertools
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import archive
from .archive import COMPRESSION, HEADER_SIZE, LEAF_START, Entry, compress, encode_directory, encode_header, split_directory
from .placed import write_placed
from .scratch import materialise

#: Up to so many entries the directory is made on the driver (it may fit into the root); root pointers aimed at beyond.
SMALL, POINTERS = 20_000, 1500
GZIP = COMPRESSION["gzip"]


def _laid_out(tiles: DataFrame) -> DataFrame:
    """part, nth, own, tile_id, length, data: tiles in order, each with its number and place in its task's part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, nth, own = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            lengths = [len(d.as_buffer()) if d.is_valid else 0 for d in batch.column(1)]
            places = list(itertools.accumulate(lengths, initial=own))
            n, own = batch.num_rows, places.pop()
            columns = [pa.array([part] * n, pa.int32()), pa.array(range(nth, nth + n), pa.int64()), pa.array(places, pa.int64()), batch.column(0), pa.array(lengths, pa.int64()), batch.column(1)]
            yield pa.RecordBatch.from_arrays(columns, names=["part", "nth", "own", "tile_id", "length", "data"])
            nth += n

    parts = max(1, int(tiles.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ordered = tiles.select(F.col("tile_id").cast("long").alias("tile_id"), "data").repartitionByRange(parts, "tile_id").sortWithinPartitions("tile_id")
    return materialise(ordered.mapInArrow(run, "part int, nth long, own long, tile_id long, length long, data binary"), "tiles")


def _leaves(entries: DataFrame, size: int) -> DataFrame:
    """leaf, first, length, data: a directory of each `size` entries (rank, tile_id, offset, length)."""

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(zip(*[table.column(c).to_pylist() for c in ("tile_id", "offset", "length")], strict=True))
        data = compress(encode_directory([Entry(*r) for r in rows]), GZIP)
        return pa.table({"leaf": table.column("leaf")[:1], "first": pa.array([rows[0][0]], pa.int64()), "length": pa.array([len(data)], pa.int64()), "data": pa.array([data], pa.binary())})

    numbered = entries.select(F.expr(f"rank div {size}").cast("long").alias("leaf"), "tile_id", "offset", "length")
    return materialise(numbered.groupBy("leaf").applyInArrow(run, "leaf long, first long, length long, data binary"), "leaves")


def _directory(spark: SparkSession, entries: DataFrame, total: int) -> tuple[bytes, int, DataFrame]:
    """(root, bytes of all leaves, rows of own place and data of the leaves)."""
    nothing = spark.createDataFrame([], "own long, data binary")
    if total <= SMALL:
        rows = [Entry(r["tile_id"], r["offset"], r["length"]) for r in entries.orderBy("tile_id").collect()]
        root, leaves = split_directory(rows, GZIP)
        return root, len(leaves), spark.createDataFrame([(0, bytearray(leaves))], "own long, data binary") if leaves else nothing
    size = LEAF_START
    while True:
        if total <= size * POINTERS:
            table = _leaves(entries, size)
            found = table.select("leaf", "first", "length").orderBy("leaf").collect()  # one row a leaf, at most POINTERS
            places = list(itertools.accumulate((r["length"] for r in found), initial=0))
            root = compress(encode_directory([Entry(r["first"], at, r["length"], 0) for r, at in zip(found, places, strict=False)]), GZIP)
            if len(root) <= archive.ROOT_LIMIT:
                starts = spark.createDataFrame([(r["leaf"], at) for r, at in zip(found, places, strict=False)], "leaf long, own long")
                return root, places[-1], table.join(F.broadcast(starts), "leaf").select("own", "data")
        size *= 2


def write_archive(tiles: DataFrame, path: str, header: dict[str, int], metadata: dict, appends: bool | None = None) -> dict[str, int]:
    """tiles: tile_id (each once), data (packed bytes). Returns the header as written.

    path: a folder that all tasks see, or an address of a file system; appends: see write_placed(). An existing file is
    replaced when the new one is complete, and is left as it is if a task fails.
    """
    spark = tiles.sparkSession
    table = _laid_out(tiles)
    parts = table.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("bytes")).orderBy("part").collect()  # one row a task
    ranks = list(itertools.accumulate((r["n"] for r in parts), initial=0))
    offsets = list(itertools.accumulate((r["bytes"] for r in parts), initial=0))
    starts = F.broadcast(spark.createDataFrame([(r["part"], a, b) for r, a, b in zip(parts, ranks, offsets, strict=False)], "part int, rank0 long, offset0 long"))
    entries = table.select("part", "nth", "own", "tile_id", "length").join(starts, "part").select((F.col("rank0") + F.col("nth")).alias("rank"), "tile_id", (F.col("offset0") + F.col("own")).alias("offset"), "length")
    root, leaf_bytes, leaves = _directory(spark, entries, ranks[-1])

    meta, at = compress(json.dumps(metadata).encode(), GZIP), HEADER_SIZE
    full = dict(header, root_dir_offset=at, root_dir_bytes=len(root), json_metadata_offset=at + len(root), json_metadata_bytes=len(meta), leaf_dirs_offset=at + len(root) + len(meta), leaf_dirs_bytes=leaf_bytes)
    begin = full["leaf_dirs_offset"] + leaf_bytes
    full |= {"tile_data_offset": begin, "tile_data_bytes": offsets[-1], "internal_compression": GZIP}
    full |= {"addressed_tiles_count": ranks[-1], "tile_entries_count": ranks[-1], "tile_contents_count": ranks[-1]}
    front = spark.createDataFrame([(0, bytearray(encode_header(full) + root + meta))], "place long, data binary")
    rows = table.where("length > 0").join(starts, "part").select((F.col("offset0") + F.col("own") + F.lit(begin)).alias("place"), "data")
    rows = rows.unionByName(leaves.select((F.col("own") + F.lit(full["leaf_dirs_offset"])).alias("place"), "data")).unionByName(front)
    write_placed(rows, path, begin + offsets[-1], appends)
    return full
