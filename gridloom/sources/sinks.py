"""Text sinks: tab-separated files and GeoJSON lines, as one file that tasks write together or as folders of parts."""

from __future__ import annotations

import itertools
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import fixed
from .placed import write_placed
from .scratch import materialise


def point_rows(points: DataFrame, columns: list[str], digits: int = 3) -> DataFrame:
    """X, Y as fixed text and the attributes."""
    return points.select(fixed("gx", digits).alias("X"), fixed("gy", digits).alias("Y"), *[F.col(c).cast("string").alias(c) for c in columns])


def geojson_lines(points: DataFrame, columns: list[str], digits: int = 3) -> DataFrame:
    """One GeoJSON point feature in each line; values are text and escaped."""
    pair = F.concat(F.lit("["), fixed("gx", digits), F.lit(","), fixed("gy", digits), F.lit("]"))
    props = F.to_json(F.struct(*[F.coalesce(F.col(c).cast("string"), F.lit("NA")).alias(c) for c in columns])) if columns else F.lit("{}")
    line = F.concat(F.lit('{"type":"Feature","geometry":{"type":"Point","coordinates":'), pair, F.lit('},"properties":'), props, F.lit("}"))
    return points.select(line.alias("value"))


def vertices_text(ring: Column | str, digits: int = 3) -> Column:
    """[[x,y],...] of a closed ring without its last vertex."""
    ring = F.col(ring) if isinstance(ring, str) else ring
    own = F.slice(ring, F.lit(1), F.greatest(F.size(ring) - 1, F.lit(0)))
    each = F.transform(own, lambda p: F.concat(F.lit("["), fixed(p["x"], digits), F.lit(","), fixed(p["y"], digits), F.lit("]")))
    return F.concat(F.lit("["), F.array_join(each, ","), F.lit("]"))


def write_tsv(rows: DataFrame, path: str, folder: bool = False) -> None:
    """One tab-separated file with a head line, in blocks of gzip if the path ends in .gz; nulls are empty. folder: a
    folder of parts instead, each compressed as a whole."""
    if folder:
        writer = rows.write.mode("overwrite").option("compression", "gzip" if path.endswith(".gz") else "none")
        writer.option("sep", "\t").option("header", True).option("quote", "").option("emptyValue", "").csv(path)
        return
    line = F.array_join(F.array(*[F.coalesce(F.col("`" + c.replace("`", "``") + "`").cast("string"), F.lit("")) for c in rows.columns]), "\t")
    _write_lines(rows.select(line.alias("value")), path, "\t".join(rows.columns) + "\n")


def write_lines(rows: DataFrame, path: str, folder: bool = False) -> None:
    """One text file of lines (see write_tsv)."""
    if folder:
        rows.write.mode("overwrite").option("compression", "gzip" if path.endswith(".gz") else "none").text(path)
        return
    _write_lines(rows.select(F.coalesce(F.col(rows.columns[0]), F.lit("")).alias("value")), path, "")


#: Bytes of text in a block, of which the packed form with its size field is at most 64 KB; bytes of a row of blocks.
BLOCK, ROW = 65_280, 1 << 20
#: An empty block, which ends a file of blocks (a fixed value of the format).
END_BLOCK = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")


def block(data: bytes) -> bytes:
    """A gzip member of its own with its size in the extra field BC, so that readers can go from block to block."""
    for level in (6, 0):
        packer = zlib.compressobj(level, zlib.DEFLATED, -15)
        packed = packer.compress(data) + packer.flush()
        if len(packed) <= 65_510:
            break
    head = struct.pack("<4BI2BH2B2H", 31, 139, 8, 4, 0, 0, 255, 6, 66, 67, 2, len(packed) + 25)
    return head + packed + struct.pack("<2I", zlib.crc32(data), len(data))


def blocks(data: bytes) -> bytes:
    return b"".join(block(data[k : k + BLOCK]) for k in range(0, len(data), BLOCK))


def _write_lines(lines: DataFrame, path: str, head: str) -> None:
    """Tasks pack their lines into blocks in order and write them at their places; only sizes come to the driver."""
    spark, packed = lines.sparkSession, path.endswith(".gz")
    size = ROW // BLOCK * BLOCK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, own, rest = TaskContext.get().partitionId(), 0, b""

        def chunk(text: bytes) -> pa.RecordBatch:
            nonlocal own
            data = blocks(text) if packed else text
            row = pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([own], pa.int64()), pa.array([len(data)], pa.int64()), pa.array([data], pa.binary())], names=["part", "own", "length", "data"])
            own += len(data)
            return row

        for batch in batches:
            if batch.num_rows:
                rest += "\n".join(batch.column(0).to_pylist()).encode() + b"\n"
            while len(rest) >= size:
                yield chunk(rest[:size])
                rest = rest[size:]
        if rest:
            yield chunk(rest)

    table = materialise(lines.mapInArrow(run, "part int, own long, length long, data binary"), "lines")
    parts = table.groupBy("part").agg(F.sum("length").alias("n")).orderBy("part").collect()  # one row a task
    front = blocks(head.encode()) if packed else head.encode()
    places = list(itertools.accumulate((r["n"] for r in parts), initial=len(front)))
    starts = F.broadcast(spark.createDataFrame([(r["part"], at) for r, at in zip(parts, places, strict=False)], "part int, start long"))
    ends = [(0, bytearray(front))] if front else []
    ends += [(places[-1], bytearray(END_BLOCK))] if packed else []
    rows = table.join(starts, "part").select((F.col("start") + F.col("own")).alias("place"), "data").unionByName(spark.createDataFrame(ends, "place long, data binary"))
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target = target.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(target).toString()
    write_placed(rows, target, places[-1] + (len(END_BLOCK) if packed else 0))
