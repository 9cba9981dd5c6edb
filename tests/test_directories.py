"""Archives larger than a process should hold: written and read by tasks, runs and filters as intervals."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.functions.tileid import box_spans, first_id, id_of, places_of, zxy_of
from gridloom.sources import archive, placed, tiles, writer
from gridloom.sources.archive import Entry

HEADER = {"tile_type": 1, "tile_compression": 1, "max_zoom": 15}


def write_front(path, entries, data=b""):
    with open(path, "wb") as f:
        f.write(archive.front_of(HEADER, {}, entries) + data)


def test_places_and_spans_of_boxes():
    rng = random.Random(2)
    for z in (0, 1, 2, 5, 9, 31):
        n = 1 << z
        own = [(rng.randrange(n), rng.randrange(n)) for _ in range(50)]
        ids = np.array([id_of(z, x, y) for x, y in own])
        assert list(zip(*[c.tolist() for c in places_of(ids, z)], strict=True)) == own
    for _ in range(60):
        z = rng.choice([1, 3, 6])
        x, y = (sorted(rng.randint(-2, (1 << z) + 1) for _ in range(2)) for _ in range(2))
        inside = {id_of(z, a, b) for a in range(1 << z) for b in range(1 << z) if x[0] <= a <= x[1] and y[0] <= b <= y[1]}
        exact, rough = box_spans(z, x, y, 10_000), box_spans(z, x, y, 4)
        assert {i for a, b in exact for i in range(a, b + 1)} == inside and all(a[1] + 1 < b[0] for a, b in zip(exact, exact[1:], strict=False))
        assert inside <= {i for a, b in rough for i in range(a, b + 1)} and len(rough) <= 20
        assert all(first_id(z) <= a <= b < first_id(z + 1) for a, b in rough)
    assert sum(b - a + 1 for a, b in box_spans(31, (0, (1 << 31) - 1), (0, (1 << 30) - 1))) == 1 << 61


def reads_of(monkeypatch):
    reads = []
    real = archive.RangeReader.read
    monkeypatch.setattr(archive.RangeReader, "read", lambda self, at, n: reads.append((at, n)) or real(self, at, n))
    return reads


def test_a_lookup_reads_one_leaf(tmp_path, monkeypatch):
    rng, entries, data, at, tile = random.Random(3), [], [], 0, 0
    for k in range(60_000):
        tile += rng.randint(2, 900)
        data.append(b"%d" % k * rng.randint(1, 9))
        entries.append(Entry(tile, at, len(data[-1])))
        at += len(data[-1])
    path = str(tmp_path / "many")
    write_front(path, entries, b"".join(data))
    reads = reads_of(monkeypatch)
    assert archive.find_tile(path, *zxy_of(entries[44_444].tile_id)) == data[44_444]
    assert len(reads) == 5 and sum(n for _, n in reads) < 40_000  # header, root, metadata, leaf, tile
    assert archive.find_tile(path, *zxy_of(entries[44_444].tile_id + 1)) is None and archive.find_tile(path, *zxy_of(tile + 3)) is None


def partitions_of(path, **limits):
    reader = tiles.TileArchiveReader({"path": path, "taskbytes": 1 << 20})
    reader.limits = [({"z": 0, "x": 1, "y": 2, "tile_id": 3}[c], kind, v) for c, (kind, v) in limits.items()]
    return reader, reader.partitions()


def test_a_run_of_very_many_tiles(spark, tmp_path, monkeypatch):
    """It is planned from its two ends; a filter takes what it wants of it."""
    path, run = str(tmp_path / "run"), 1_000_000_000
    write_front(path, [Entry(0, 0, 3), Entry(first_id(15), 3, 4, run), Entry(first_id(15) + run, 0, 3)], b"abcwxyz")
    reads = reads_of(monkeypatch)
    reader, parts = partitions_of(path)
    assert 500 <= len(parts) <= 1024 and sum(n for _, n in reads) < 2000
    third = next(iter(reader.read(parts[3])))
    assert third.num_rows <= tiles.ROWS and set(third.column("data").to_pylist()) == {b"wxyz"}
    some = tiles.read_tiles(spark, path).where(f"tile_id >= {first_id(15) + run - 5}")
    assert [(r["tile_id"] - first_id(15) - run, bytes(r["data"])) for r in some.orderBy("tile_id").collect()] == [(k, b"wxyz" if k < 0 else b"abc") for k in range(-5, 1)]
    box = tiles.read_tiles(spark, path, data=False).where("z = 15 and x between 100 and 109 and y in (7, 9, 40000)")
    assert box.columns == ["z", "x", "y", "tile_id", "offset", "length"]
    assert {(r["x"], r["y"]) for r in box.collect()} == {(x, y) for x in range(100, 110) for y in (7, 9)}
    assert len(partitions_of(path, z=("=", 15), x=("=", 5), y=("=", 5))[1]) == 1


@pytest.mark.parametrize("task_bytes", [200, 5000, 1 << 20])
def test_slices_give_every_tile_once(tmp_path, monkeypatch, task_bytes):
    monkeypatch.setattr(archive, "ROOT_LIMIT", 80)
    rng, entries, at, tile = random.Random(4), [], 0, 0
    for _ in range(1500):
        run = rng.choice([1, 1, 1, 2, 50])
        entries.append(Entry(tile, at, 7, run))
        tile, at = tile + run + rng.choice([0, 0, 3]), at + 7
    path = str(tmp_path / "slices")
    write_front(path, entries, b"".join(b"%07d" % k for k in range(len(entries))))
    for limits in ({}, {"tile_id": ("<=", tile // 2)}, {"z": ("in", [4, 6])}, {"x": (">", 20)}, {"y": ("<", 3)}, {"z": (">=", 40)}, {"z": ("in", [None])}):
        reader = tiles.TileArchiveReader({"path": path, "taskbytes": task_bytes})
        reader.limits = [({"z": 0, "x": 1, "y": 2, "tile_id": 3}[c], kind, v) for c, (kind, v) in limits.items()]
        found = [(r["tile_id"], r["z"], r["x"], r["y"], r["data"]) for part in reader.partitions() for b in reader.read(part) for r in b.to_pylist()]
        every = [(e.tile_id + k, *zxy_of(e.tile_id + k), b"%07d" % n) for n, e in enumerate(entries) for k in range(e.run)]
        test = {"<=": lambda a, b: a <= b, "in": lambda a, b: a in b, ">": lambda a, b: a > b, "<": lambda a, b: a < b, ">=": lambda a, b: a >= b}
        place = {"tile_id": 0, "z": 1, "x": 2, "y": 3}
        assert sorted(found) == [r for r in every if all(test[kind](r[place[c]], v) for c, (kind, v) in limits.items())]


def some_tiles(spark, n):
    return spark.range(n).select((F.col("id") * 7 % 100_003).alias("tile_id"), F.encode(F.concat(F.lit("tile "), F.repeat(F.col("id").cast("string"), (F.col("id") % 9).cast("int"))), "utf-8").alias("data"))


@pytest.mark.parametrize("appends", [False, True])
def test_directories_made_by_tasks(spark, tmp_path, monkeypatch, appends):
    """Leaves of tasks, a root of pointers, and files that can only be appended to hold what one process would write."""
    rows, path = some_tiles(spark, 30_000), f"file://{tmp_path}/archive"
    monkeypatch.setattr(writer, "POINTERS", 5)
    header = writer.write_archive(rows, path, HEADER, {"k": "v"}, appends)
    found = archive.open_archive(path)
    assert found.header == archive.decode_header(archive.encode_header(header)) and found.metadata == {"k": "v"} and found.header["leaf_dirs_bytes"] > 0
    expected = {r["tile_id"]: bytes(r["data"]) for r in rows.collect()}
    assert [e.tile_id for e in found.entries] == sorted(expected) and len(archive.open_front(path).entries) <= 5
    assert {r["tile_id"]: bytes(r["data"]) for r in tiles.read_tiles(spark, path).collect()} == expected
    assert os.listdir(tmp_path) == ["archive"] or sorted(os.listdir(tmp_path)) == [".archive.crc", "archive"]
    size = found.header["tile_data_offset"] + found.header["tile_data_bytes"]
    assert os.path.getsize(tmp_path / "archive") == size


def test_small_and_empty_archives(spark, tmp_path):
    path = str(tmp_path / "a")
    for n in (0, 1, 1000):
        writer.write_archive(some_tiles(spark, n), path, HEADER, {})
        found = archive.open_archive(path)
        assert len(found.entries) == found.header["tile_entries_count"] == n and tiles.read_tiles(spark, path).count() == n


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    path = tmp_path / "target"
    path.write_bytes(b"as it was")
    rows = spark.range(1000).select((F.col("id") * 3).alias("place"), F.when(F.col("id") < 990, F.lit(b"abc")).otherwise(F.raise_error(F.lit("no more")).cast("binary")).alias("data"))
    with pytest.raises(Exception, match="no more"):
        placed.write_placed(rows, str(path), 3000)
    short = spark.range(10).select((F.col("id") * 3).alias("place"), F.lit(b"abc").alias("data"))
    with pytest.raises(Exception, match="30 bytes written"):
        placed.write_placed(short, str(path), 33)
    assert os.listdir(tmp_path) == ["target"] and path.read_bytes() == b"as it was"
    placed.write_placed(short.orderBy(F.desc("place")), str(path), 30)
    assert path.read_bytes() == b"abc" * 10 and os.listdir(tmp_path) == ["target"]
