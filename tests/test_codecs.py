import numpy as np
import pyarrow as pa
import pytest

from gridloom.sources import archive, mlt, mvt, wire
from gridloom.sources.archive import Entry


def test_varints():
    for v in (0, 1, 127, 128, 300, (1 << 32) - 1, (1 << 63), (1 << 64) - 1):
        assert wire.get_varint(wire.put_varint(v), 0)[0] == v
    assert wire.get_varints(wire.put_varints([0, 1, 127, 128, 1 << 40])).tolist() == [0, 1, 127, 128, 1 << 40]
    with pytest.raises(wire.WireError):
        wire.get_varint(b"\xff\xff", 0)
    with pytest.raises(wire.WireError):
        wire.get_varints(b"\x01\xff")


def test_zigzag():
    values = [0, -1, 1, -2, 2, 2147483647, -2147483648]
    assert [wire.unzigzag(wire.zigzag(v)) for v in values] == values
    assert wire.unzigzag(wire.zigzags(np.array(values))).tolist() == values


@pytest.mark.parametrize("n", [0, 1, 7, 8, 9, 1024, 1025, 3000])
def test_bools(n):
    values = np.random.default_rng(n).random(n) > 0.5
    assert (wire.bools_decode(wire.bools_encode(values), n) == values).all()


def test_bools_repeat_run_and_padding():
    assert wire.bools_decode(bytes([1, 0x0F]), 32).tolist() == ([True] * 4 + [False] * 4) * 4
    assert wire.bools_decode(b"", 3).tolist() == [True] * 3


def test_header_round_trip_and_errors():
    values = {n: i for i, n in enumerate(archive.NAMES)} | {"min_lon_e7": -1800000000, "clustered": 1}
    data = archive.encode_header(values)
    assert len(data) == 127 and archive.decode_header(data) == values
    with pytest.raises(archive.ArchiveError):
        archive.decode_header(b"x" * 127)
    with pytest.raises(archive.ArchiveError):
        archive.decode_header(data[:7] + b"\x02" + data[8:])


def test_directory():
    entries = [Entry(0, 0, 10, 1), Entry(1, 10, 5, 3), Entry(9, 100, 7, 1), Entry(20, 0, 10, 1)]
    data = archive.encode_directory(entries)
    assert archive.decode_directory(data) == entries
    with pytest.raises(wire.WireError):
        archive.decode_directory(data + b"\x00")
    with pytest.raises(wire.WireError):
        archive.decode_directory(data[:-1])


def test_leaf_directories_and_lookup(tmp_path):
    rng = np.random.default_rng(3)
    ids = np.unique(rng.integers(0, 1 << 30, 30_000)).tolist()
    entries, at = [], 0
    for i in ids:
        n = int(rng.integers(1, 1 << 20))
        entries.append(Entry(i, at, n))
        at += n
    root, leaves = archive.split_directory(entries)
    assert len(root) <= 16384 - 127 and leaves
    path = tmp_path / "a"
    path.write_bytes(archive.front_of({"tile_type": 6}, {"k": 1}, entries))
    found = archive.open_archive(str(path))
    assert found.entries == entries and found.metadata == {"k": 1} and found.header["tile_entries_count"] == len(ids)
    from gridloom.functions.tileid import zxy_of

    assert archive.lookup(found, *zxy_of(ids[77])) == entries[77]
    assert found.tiles()[0][4] >= found.header["tile_data_offset"]


def test_runs_share_bytes_and_order():
    a = archive.Archive({"tile_data_offset": 1000}, {}, [Entry(1, 0, 9, 4)])
    rows = a.tiles()
    assert [r[:3] for r in rows] == [(1, 0, 1), (1, 0, 0), (1, 1, 1), (1, 1, 0)] and {r[4] for r in rows} == {1000}


def test_compressions():
    assert archive.decompress(archive.compress(b"abc"), 2) == b"abc" and archive.decompress(b"abc", 1) == b"abc"
    with pytest.raises(archive.ArchiveError):
        archive.decompress(b"abc", 3)
    with pytest.raises(archive.ArchiveError):
        _ = archive.Archive({"tile_type": 2}, {}).codec


def test_mvt_values_and_layers():
    tile = mvt.encode_layer("b", [1, 4096], [2, -7], {"s": ["x", "é"], "i": [-5, 1 << 40], "f": [0.5, None], "t": [True, False]})
    tile += mvt.encode_layer("a", [3], [4], {"s": ["y"]}) + mvt.encode_layer("b", [9], [9], {})
    layers = mvt.decode(tile)
    assert [x.name for x in layers] == ["a", "b"] and len(layers[1].features) == 2
    assert layers[1].features[0].attrs == {"s": "x", "i": -5, "f": 0.5, "t": True} and layers[1].features[1].rings == [[(4096, -7)]]
    assert "f" not in layers[1].features[1].attrs and mvt.count(tile) == 4


def _layer(*more, version=True, extent=True):
    body = (wire.field(15, 0, b"\x02") if version else b"") + wire.field(1, 2, b"n") + (wire.field(5, 0, wire.put_varint(4096)) if extent else b"") + b"".join(more)
    return wire.field(3, 2, body)


def _feature(tags, commands, kind=1):
    return wire.field(2, 2, wire.field(2, 2, wire.put_varints(tags)) + wire.field(3, 0, bytes([kind])) + wire.field(4, 2, wire.put_varints(commands)))


def test_mvt_duplicate_keys_first_wins_and_typed_values():
    import struct

    keys = wire.field(3, 2, b"k")
    values = [wire.field(1, 2, b"t"), wire.field(2, 5, struct.pack("<f", 1.5)), wire.field(3, 1, struct.pack("<d", 2.5)), wire.field(4, 0, wire.put_varint((1 << 64) - 3)), wire.field(5, 0, wire.put_varint((1 << 64) - 1)), wire.field(6, 0, wire.put_varint(5)), wire.field(7, 0, b"\x01")]
    expected = ["t", 1.5, 2.5, -3, (1 << 64) - 1, -3, True]
    for v, e in zip(values, expected, strict=True):
        tile = _layer(keys, wire.field(4, 2, v), wire.field(4, 2, wire.field(1, 2, b"other")), _feature([0, 0, 0, 1], [9, 2, 2]))
        assert mvt.decode(tile)[0].features[0].attrs == {"k": e}
    assert [mvt.text_of(v) for v in (1.0, True, None, 7, "x")] == ["1.000000", "true", None, "7", "x"]


@pytest.mark.parametrize("tile", [_layer(version=False), _layer(extent=False), _layer(_feature([0], [9, 2, 2])), _layer(_feature([0, 0], [9, 2, 2])), _layer(_feature([], [9, 80000, 2])), _layer(_feature([], [9, 2])), _layer(_feature([], [12, 2, 2]))])
def test_mvt_rejects(tile):
    with pytest.raises(mvt.TileError):
        mvt.decode(tile)


def test_mvt_polygons():
    ring = [(0, 0), (10, 0), (10, 10)]
    tile = mvt.encode_polygons("p", [[ring], [ring, ring]], [{"a": "x"}, {}])
    one, two = mvt.decode(tile)[0].features
    assert one.kind == mvt.POLYGON and one.rings == [[*ring, ring[0]]] and len(two.rings) == 2


@pytest.mark.parametrize("nulls", ["none", "some", "all"])
@pytest.mark.parametrize("kind", ["int", "float", "string"])
def test_mlt_types(kind, nulls):
    n = 1030
    rng = np.random.default_rng(1)
    make = {"int": lambda: int(rng.integers(-(1 << 31), 1 << 31)), "float": lambda: float(np.float32(rng.normal())), "string": lambda: "é" * int(rng.integers(0, 4))}[kind]
    values = [make() if nulls == "none" or (nulls == "some" and rng.random() < 0.5) else None for _ in range(n)]
    xs, ys = rng.integers(-100, 5000, n).tolist(), rng.integers(-100, 5000, n).tolist()
    tile = mlt.encode_layer("L", xs, ys, {"c": values, "d": ["k"] * n}, {"c": kind, "d": "string"})
    found = mlt.decode(tile)
    assert found.columns["c"] == values and found.columns["d"] == ["k"] * n and found.xs.tolist() == xs and found.ys.tolist() == ys
    assert mlt.count(tile) == n and found.name == "L" and found.extent == 4096


def test_mlt_edges():
    tile = mlt.encode_layer("L", [1], [2], {"c": [1 << 40]}, {"c": "int"}, {"c": True})
    assert mlt.decode(tile).columns["c"] == [0]
    empty = mlt.encode_layer("L", [], [], {"c": []}, {"c": "string"})
    assert mlt.count(empty) == 0 and mlt.decode(empty).columns["c"] == []
    assert mlt.decode(b"") is None and mlt.count(b"") == 0
    assert mlt.text_of(0.1) == "0.1" and mlt.text_of(None) is None


def _plain(tile):
    """What decode finds: layers with kinds, rings and attributes as text."""
    return [(layer.name, [(f.kind, f.rings, {k: mvt.text_of(v) for k, v in f.attrs.items()}) for f in layer.features]) for layer in mvt.decode(tile)]


def _columnar(tile):
    out = []
    for layer in mvt.decode_columns(tile):
        texts, features = layer.texts().to_pylist(), []
        for part in layer.parts():
            ring = vertex = tag = 0
            for kind, rings, tags in zip(part.kinds.tolist(), part.rings.tolist(), part.tags.tolist(), strict=True):
                shape = []
                for size in part.sizes[ring : ring + rings].tolist():
                    shape.append(list(zip(part.xs[vertex : vertex + size].tolist(), part.ys[vertex : vertex + size].tolist(), strict=True)))
                    vertex += size
                own = {layer.keys[k]: texts[v] for k, v in zip(part.keys[tag : tag + tags], part.values[tag : tag + tags], strict=True)}
                features.append((kind, shape, own))
                ring, tag = ring + rings, tag + tags
        out.append((layer.name, features))
    return out


def test_columns_of_tiles_equal_features(monkeypatch):
    """Bytes and features of whole columns are those of one feature after the other, whatever the parts."""
    rng = np.random.default_rng(5)
    n = 300
    xs, ys = rng.integers(-300, 5000, n), rng.integers(-300, 5000, n)
    some = lambda make: [None if rng.random() < 0.2 else make() for _ in range(n)]
    columns = {"a": some(lambda: int(rng.integers(-9, 9))), "b": some(lambda: int(rng.integers(-(1 << 62), 1 << 62))), "none": [None] * n, "c": some(lambda: int(rng.integers(-9, 30))), "f": some(lambda: float(rng.integers(4)) / 4), "s": some(lambda: "é" * int(rng.integers(0, 200)))}
    types = {"a": pa.int32(), "b": pa.int64(), "none": pa.int64(), "c": pa.int64(), "f": pa.float64(), "s": pa.string()}
    tables = {k: pa.array(v, types[k]) for k, v in columns.items()}
    sizes = rng.integers(2, 9, n)
    vx, vy = rng.integers(-30, 4200, sizes.sum()), rng.integers(-30, 4200, sizes.sum())
    ends = np.cumsum(sizes)
    rings = [[list(zip(vx[e - k : e].tolist(), vy[e - k : e].tolist(), strict=True))] for e, k in zip(ends, sizes, strict=True)]
    attrs = [{"a": columns["c"][i] or 0, "s": columns["s"][i] or "x"} for i in range(n)]
    whole = {"a": pa.array([r["a"] for r in attrs], pa.int64()), "s": pa.array([r["s"] for r in attrs])}
    for size in (7, n, 1 << 14):
        monkeypatch.setattr(mvt, "PART", size)
        for ids in (False, True):
            tile = mvt.encode_layer("p", xs.tolist(), ys.tolist(), columns, ids=ids)
            assert mvt.encode_points("p", xs, ys, tables, ids=ids) == tile
            assert _columnar(tile) == _plain(tile)
        tile = mvt.encode_polygons("q", rings, attrs)
        assert mvt.encode_rings("q", vx, vy, sizes, whole) == tile
        mixed = tile + mvt.encode_layer("o", [1], [2], {}) + mvt.encode_polygons("r", [[rings[0][0], rings[1][0]], rings[2]], [{"k": 1.5}, {"k": True}])
        # a key twice in a feature, two equal keys, an empty feature, an empty value
        odd = b"".join([wire.field(15, 0, b"\x02"), wire.field(1, 2, b"s"), wire.field(2, 2, wire.field(2, 2, bytes([0, 0, 1, 1, 0, 1])) + wire.field(3, 0, b"\x01")), wire.field(2, 2, b""), wire.field(3, 2, b"k"), wire.field(3, 2, b"k"), wire.field(4, 2, b""), wire.field(4, 2, wire.field(5, 0, b"\x07")), wire.field(5, 0, b"\x10")])
        assert _columnar(mixed + wire.field(3, 2, odd)) == _plain(mixed + wire.field(3, 2, odd))
    with pytest.raises(mvt.TileError):
        next(mvt.decode_columns(mvt.encode_layer("p", [40000], [1], {}))[0].parts())


def test_memory_of_a_large_tile():
    """A tile of 200,000 features is encoded and decoded in a few times its bytes (before: over 1,000 bytes a feature)."""
    import tracemalloc

    n = 200_000
    x = np.arange(n) % 4000
    tracemalloc.start()
    try:
        tile = mvt.encode_rings("p", np.column_stack([x, x + 9, x]).ravel(), np.column_stack([x, x, x + 6]).ravel(), np.full(n, 3), {"id": pa.array(np.arange(n)), "gene": pa.array(["a", "b"] * (n // 2))})
        wrote = tracemalloc.get_traced_memory()[1]
        tracemalloc.reset_peak()
        layer = mvt.decode_columns(tile)[0]
        seen = sum(len(part.kinds) for part in layer.parts()), len(layer.texts())
        read = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert seen == (n, n + 2) and wrote < 300 * n and read < 300 * n, (wrote / n, read / n)
