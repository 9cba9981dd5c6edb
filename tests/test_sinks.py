"""Single text files: order, nulls, and blocks of gzip that can be read from any of them on."""

import gzip
import os
import struct
import zlib

from pyspark.sql import functions as F

from gridloom.sources import sinks


def members(data):
    """(place, text) of each block, by its size field alone."""
    at = 0
    while at < len(data):
        magic, flags, extra = data[at : at + 3], data[at + 3], struct.unpack_from("<H", data, at + 10)[0]
        assert magic == b"\x1f\x8b\x08" and flags == 4 and extra == 6 and data[at + 12 : at + 16] == b"BC\x02\x00"
        size = struct.unpack_from("<H", data, at + 16)[0] + 1
        assert size <= 1 << 16
        text = zlib.decompress(data[at + 18 : at + size - 8], -15)
        assert struct.unpack_from("<2I", data, at + size - 8) == (zlib.crc32(text), len(text))
        yield at, text
        at += size
    assert at == len(data)


def test_blocks_of_any_bytes():
    for data in (b"", b"a", b"x" * 200_000, os.urandom(300_000), os.urandom(sinks.BLOCK)):
        packed = sinks.blocks(data) + sinks.END_BLOCK
        assert gzip.decompress(packed) == data and b"".join(t for _, t in members(packed)) == data


def test_one_packed_file_in_order(spark, tmp_path):
    n = 120_000
    rows = spark.range(n).select(F.col("id").alias("a"), F.when(F.col("id") % 3 == 0, None).otherwise(F.sha2(F.col("id").cast("string"), 256)).alias("b c"), F.lit("").alias("d"), (F.col("id") / 8).alias("e"))
    path = str(tmp_path / "out.tsv.gz")
    sinks.write_tsv(rows.repartition(9).orderBy("a"), path)
    data = open(path, "rb").read()
    lines = gzip.decompress(data).decode().split("\n")
    assert lines[0] == "a\tb c\td\te" and lines[-1] == "" and len(lines) == n + 2
    assert [int(x.split("\t")[0]) for x in lines[1:-1]] == list(range(n)) and lines[1] == "0\t\t\t0.0" and lines[2].endswith("\t\t0.125")
    found = list(members(data))
    assert found[-1][1] == b"" and data.endswith(sinks.END_BLOCK) and len(found) > 60
    at = found[len(found) // 2][0]
    assert lines[-2].encode() in gzip.decompress(data[at:])
    assert os.listdir(tmp_path) == ["out.tsv.gz"]
    sinks.write_tsv(rows.limit(0), path)  # an old file gives way
    assert gzip.decompress(open(path, "rb").read()) == b"a\tb c\td\te\n"


def test_plain_lines(spark, tmp_path):
    path = str(tmp_path / "lines")
    sinks.write_lines(spark.createDataFrame([("é",), (None,), ("b",)], "v string").coalesce(1), path)
    assert open(path, encoding="utf-8").read() == "é\n\nb\n"
    sinks.write_lines(spark.createDataFrame([], "v string"), path)
    assert os.path.getsize(path) == 0
    sinks.write_tsv(spark.range(3), str(tmp_path / "folder"), folder=True)
    assert spark.read.option("header", True).csv(str(tmp_path / "folder")).count() == 3
