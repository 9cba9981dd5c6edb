"""Archives as DataFrames: the `tilearchive` data source and decoders of its tiles."""

from __future__ import annotations

import bisect
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from ..functions.tileid import box_spans, first_id, places_of
from . import mlt, mvt
from .archive import COMPRESSION, DEPTH, HEADER_SIZE, ArchiveError, RangeReader, decode_directory, decode_header, decompress, open_front, with_next
from .wire import ragged

TILES = "z int, x long, y long, tile_id long, offset long, length long, data binary"
POINTS = "z int, tx long, ty long, layer string, fidx int, px int, py int, gx double, gy double, attrs map<string,string>"
#: Points with their values as stored: messages of row-oriented tiles, packed values of columnar ones.
STORED = "tx long, ty long, layer string, seq long, gx double, gy double, attrs map<string,binary>"
POLYGONS = "z int, tx long, ty long, layer string, fidx int, ring array<struct<x:double,y:double>>, attrs map<string,string>"
_COLUMNS = {"z": 0, "x": 1, "y": 2, "tile_id": 3}


#: Rows of a batch, bytes of a request, and the gap between tiles that a request reads over.
ROWS, REQUEST, GAP = 2000, 1 << 20, 4096
#: Tiles of a task beside its bytes, and slices of one directory.
TASK_TILES, MOST_SLICES = 1_000_000, 1024


class Slice(InputPartition):
    """Parts of directories: (offset and length of a directory, its slice, of how many slices)."""

    def __init__(self, directories: list[tuple[int, int, int, int]]) -> None:
        self.directories = directories


class TileArchiveReader(DataSourceReader):
    """The driver reads the root; tasks read the leaves that hold wanted tiles, and then neighbouring tiles in one
    request each. Runs stay intervals until their tiles are rows: filters are intervals of tile ids too, and a long run
    is cut among tasks."""

    def __init__(self, options: dict) -> None:
        self.path = options["path"]
        self.task_bytes = int(options.get("taskbytes", 8 << 20))
        self.stored = str(options.get("stored", "false")).lower() == "true"
        self.data = str(options.get("data", "true")).lower() == "true"
        self.limits: list[tuple[int, str, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        kinds = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<=", In: "in"}
        for f in filters:
            name = getattr(f, "attribute", ())
            if type(f) in kinds and len(name) == 1 and name[0] in _COLUMNS:
                self.limits.append((_COLUMNS[name[0]], kinds[type(f)], f.value))
            else:
                yield f

    def _bounds(self, column: int, low: int, high: int) -> tuple[int, int]:
        """The least and largest value that the filters on a column leave."""
        for at, kind, value in self.limits:
            if at != column:
                continue
            if kind in ("=", "in"):
                values = [v for v in value if v is not None] if kind == "in" else [value]
                low, high = max(low, min(values, default=high + 1)), min(high, max(values, default=low - 1))
            elif kind in (">", ">="):
                low = max(low, value + (kind == ">"))
            else:
                high = min(high, value - (kind == "<"))
        return low, high

    def spans(self) -> list[tuple[int, int]]:
        """Intervals of tile ids, in order, outside which no tile is wanted."""
        (z0, z1), (first, last) = self._bounds(0, 0, 31), self._bounds(3, 0, (1 << 63) - 1)
        out = []
        for z in range(z0, z1 + 1):
            own = (1 << z) - 1
            x, y = self._bounds(1, 0, own), self._bounds(2, 0, own)
            out += [(first_id(z), first_id(z + 1) - 1)] if (x, y) == ((0, own), (0, own)) else box_spans(z, x, y)
        return [(max(a, first), min(b, last)) for a, b in out if a <= last and b >= first]

    def _keep(self, rows: dict[int, np.ndarray]) -> np.ndarray:
        """Which tiles all filters want; rows: z, x, y and tile ids by their place among the columns."""
        good = np.ones(len(rows[3]), bool)
        for at, kind, value in self.limits:
            v = rows[at]
            if kind == "in":
                good &= np.isin(v, [w for w in value if w is not None])
            else:
                good &= {"=": v == value, ">": v > value, ">=": v >= value, "<": v < value, "<=": v <= value}[kind]
        return good

    def partitions(self) -> list[InputPartition]:
        front, spans = open_front(self.path), self.spans()
        header, root = front.header, front.entries
        leaves = [e for e, after in with_next(root) if not e.run and _meets(spans, e.tile_id, after - 1)]
        own = [(max(a, e.tile_id), min(b, e.tile_id + e.run - 1), e.length) for e in root if e.run for a, b in _within(spans, e.tile_id, e.tile_id + e.run - 1)]
        slices = lambda size, tiles: min(MOST_SLICES, max(1, -(-size // self.task_bytes), -(-tiles // TASK_TILES)))
        parts = []
        if own:
            n = min(sum(b - a + 1 for a, b, _ in own), slices(sum(length for *_, length in own), sum(b - a + 1 for a, b, _ in own)))
            parts += [Slice([(header["root_dir_offset"], header["root_dir_bytes"], k, n)]) for k in range(n)]
        if leaves:
            every = sum(1 for e in root if not e.run)
            size, tiles = header["tile_data_bytes"] // every, header["addressed_tiles_count"] // every
            n, many, held = slices(size, tiles), max(1, self.task_bytes // max(1, size)), []
            for e in leaves:
                place = header["leaf_dirs_offset"] + e.offset, e.length
                if n > 1:
                    parts += [Slice([(*place, k, n)]) for k in range(n)]
                    continue
                held.append((*place, 0, 1))
                if len(held) >= many:
                    parts.append(Slice(held))
                    held = []
            parts += [Slice(held)] if held else []
        return parts or [Slice([])]

    def _entries(self, reader: RangeReader, header: dict[str, int], offset: int, length: int, spans: list[tuple[int, int]], depth: int = 0) -> Iterator[tuple[int, int, int, int]]:
        """(first id, last id, absolute offset, length) of wanted parts of a directory's entries, leaves below included."""
        if depth >= DEPTH:
            raise ArchiveError("directories are nested too deeply")
        here = decode_directory(decompress(reader.read(offset, length), header["internal_compression"]))
        root = offset == header["root_dir_offset"]
        for e, after in with_next(here):
            if e.run:
                for a, b in _within(spans, e.tile_id, e.tile_id + e.run - 1):
                    yield a, b, header["tile_data_offset"] + e.offset, e.length
            elif not root and _meets(spans, e.tile_id, after - 1):  # leaves of the root have slices of their own
                yield from self._entries(reader, header, header["leaf_dirs_offset"] + e.offset, e.length, spans, depth + 1)

    def read(self, partition: Slice) -> Iterator[pa.RecordBatch]:
        if not partition.directories:
            return
        spans = self.spans()
        with RangeReader(self.path) as reader:
            header = decode_header(reader.read(0, HEADER_SIZE))
            kind = COMPRESSION["none"] if self.stored else header["tile_compression"]
            for offset, length, nth, of in partition.directories:
                entries = list(self._entries(reader, header, offset, length, spans))
                for rows, places, lengths in self._rows(_sliced(entries, nth, of)):
                    columns = [pa.array(rows[0], pa.int32()), *[pa.array(rows[k], pa.int64()) for k in (1, 2, 3)], pa.array(places, pa.int64()), pa.array(lengths, pa.int64())]
                    names = ["z", "x", "y", "tile_id", "offset", "length"]
                    if not self.data:
                        yield pa.RecordBatch.from_arrays(columns, names=names)
                        continue
                    for start, stop in _requests(places, lengths):
                        data = _unpacked(reader, places[start:stop], lengths[start:stop], kind)
                        yield pa.RecordBatch.from_arrays([*[c.slice(start, stop - start) for c in columns], pa.array(data, pa.binary())], names=[*names, "data"])

    def _rows(self, entries: list[tuple[int, int, int, int]]) -> Iterator[tuple[dict[int, np.ndarray], np.ndarray, np.ndarray]]:
        """Tiles of entries in batches: columns by their place, absolute offsets, lengths."""
        held: list[tuple[np.ndarray, int, int]] = []
        size = 0
        for first, last, offset, length in entries:
            for a in range(first, last + 1, ROWS):
                ids = np.arange(a, min(last + 1, a + ROWS))
                held.append((ids, offset, length))
                size += len(ids)
                if size >= ROWS:
                    yield self._batch(held)
                    held, size = [], 0
        if held:
            yield self._batch(held)

    def _batch(self, held: list[tuple[np.ndarray, int, int]]) -> tuple[dict[int, np.ndarray], np.ndarray, np.ndarray]:
        counts = [len(h[0]) for h in held]
        ids, places, lengths = np.concatenate([h[0] for h in held]), np.repeat([h[1] for h in held], counts), np.repeat([h[2] for h in held], counts)
        z, x, y = (np.zeros(len(ids), np.int64) for _ in range(3))
        for own in range(32):
            at = np.flatnonzero((ids >= first_id(own)) & (ids < first_id(own + 1)))
            if len(at):
                z[at] = own
                x[at], y[at] = places_of(ids[at], own)
        if ids[-1] >= first_id(32):
            raise ArchiveError(f"no tile has number {ids[-1]}")
        rows = {0: z, 1: x, 2: y, 3: ids}
        good = self._keep(rows)
        return {k: v[good] for k, v in rows.items()}, places[good], lengths[good]


def _within(spans: list[tuple[int, int]], first: int, last: int) -> Iterator[tuple[int, int]]:
    """What of an interval lies in the spans."""
    for a, b in spans[bisect.bisect_left(spans, first, key=lambda s: s[1]) :]:
        if a > last:
            return
        yield max(a, first), min(b, last)


def _meets(spans: list[tuple[int, int]], first: int, last: int) -> bool:
    return next(_within(spans, first, last), None) is not None


def _sliced(entries: list[tuple[int, int, int, int]], nth: int, of: int) -> list[tuple[int, int, int, int]]:
    """The nth of equal parts of the tiles of entries, cutting runs."""
    total = sum(b - a + 1 for a, b, *_ in entries)
    low, high, seen, out = total * nth // of, total * (nth + 1) // of, 0, []
    for a, b, offset, length in entries:
        first, last = max(a, a + low - seen), min(b, a + high - seen - 1)
        if first <= last:
            out.append((first, last, offset, length))
        seen += b - a + 1
    return out


def _requests(places: np.ndarray, lengths: np.ndarray) -> Iterator[tuple[int, int]]:
    """Stretches of rows whose bytes lie close together."""
    start = 0
    while start < len(places):
        low, end, stop = places[start], places[start] + lengths[start], start + 1
        while stop < len(places) and low <= places[stop] <= end + GAP and places[stop] + lengths[stop] - low <= REQUEST:
            end = max(end, places[stop] + lengths[stop])
            stop += 1
        yield start, stop
        start = stop


def _unpacked(reader: RangeReader, places: np.ndarray, lengths: np.ndarray, kind: int) -> list[bytes]:
    """The tiles of a stretch; those of a run share their bytes, which are unpacked once."""
    base, end = int(places.min()), int((places + lengths).max())
    raw, known, out = reader.read(base, end - base), {}, []
    for place, length in zip(places.tolist(), lengths.tolist(), strict=True):
        if (place, length) not in known:
            known[place, length] = decompress(raw[place - base : place - base + length], kind)
        out.append(known[place, length])
    return out


class TileArchive(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tilearchive"

    def schema(self) -> str:
        return TILES if str(self.options.get("data", "true")).lower() == "true" else TILES.removesuffix(", data binary")

    def reader(self, schema: object) -> DataSourceReader:
        return TileArchiveReader(self.options)


def read_tiles(spark: SparkSession, path: str, task_bytes: int = 8 << 20, stored: bool = False, data: bool = True) -> DataFrame:
    """One row for each addressed tile, unpacked, with the bytes as stored, or (data=False) without them. Filters on z,
    x, y and tile_id are applied to the directory; that needs spark.sql.python.filterPushdown.enabled in the session,
    which is set here."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(TileArchive)
    return spark.read.format("tilearchive").option("path", path).option("taskBytes", task_bytes).option("stored", stored).option("data", data).load()


def _origin(z: int, tx: int, ty: int) -> tuple[float, float, float]:
    from ..functions.projection import RADIUS, scale

    grid, unit = 2147483648.0, np.pi * RADIUS / 2147483648.0
    span = float(1 << (32 - z))
    return (tx * span - grid) * unit, (4294967295.0 - ty * span - grid) * unit, scale(z)


def read_points(tiles: DataFrame, codec: str, attrs: list[str] | None = None, strict: bool = True) -> DataFrame:
    """Points of tiles with their attributes as text. attrs: only these; strict: other geometries are an error."""
    keep = None if attrs is None else set(attrs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for z, tx, ty, data in _tiles(batches):
            ox, oy, s = _origin(z, tx, ty)
            for layer, first, px, py, own in _points_of(data, codec, keep, strict):
                n = len(px)
                columns = [pa.array(np.full(n, z, np.int32)), pa.array(np.full(n, tx)), pa.array(np.full(n, ty)), pa.array([layer] * n, pa.string()), pa.array(np.arange(first, first + n, dtype=np.int32)), pa.array(px.astype(np.int32)), pa.array(py.astype(np.int32)), pa.array(ox + s * px), pa.array(oy - s * py), own]
                yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in POINTS.split(", ")])

    return tiles.select("z", "x", "y", "data").mapInArrow(run, POINTS)


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, int, bytes]]:
    """z, x, y and bytes of tiles, of which one at a time leaves its batch."""
    for batch in batches:
        for k, place in enumerate(zip(*[batch.column(c).to_pylist() for c in range(3)], strict=True)):
            yield *place, batch.column(3)[k].as_py()


def _points_of(data: bytes, codec: str, keep: set[str] | None, strict: bool) -> Iterator[tuple[str, int, np.ndarray, np.ndarray, pa.Array]]:
    """(layer, number of the first point, pixels, attributes) of some points of a tile at a time."""
    if codec == "mlt":
        layer = mlt.decode(data)
        if layer:
            names = [c for c in layer.columns if keep is None or c in keep]
            for a in range(0, len(layer.xs), mvt.PART):
                part = slice(a, a + mvt.PART)
                rows = [[(c, mlt.text_of(layer.columns[c][i])) for c in names] for i in range(a, min(a + mvt.PART, len(layer.xs)))]
                yield layer.name, a, np.array(layer.xs[part], np.int64), np.array(layer.ys[part], np.int64), pa.array(rows, pa.map_(pa.string(), pa.string()))
        return
    for layer in mvt.decode_columns(data):
        texts, first = layer.texts(), 0
        for part in layer.parts():
            single = (part.kinds == mvt.POINT) & (part.rings == 1)
            at = (np.cumsum(part.rings) - part.rings)[single]
            single[single] = part.sizes[at] == 1
            if strict and not single.all():
                raise mvt.TileError("a feature is not a single point")
            vertex = _first_vertices(part, single)
            yield layer.name, first, part.xs[vertex], part.ys[vertex], _attributes(layer, part, texts, single, keep)
            first += len(vertex)


def _first_vertices(part: mvt.Part, chosen: np.ndarray) -> np.ndarray:
    """Where the first vertex of each chosen feature is; each has one."""
    return (np.cumsum(part.sizes) - part.sizes)[(np.cumsum(part.rings) - part.rings)[chosen]]


def _attributes(layer: mvt.LayerColumns, part: mvt.Part, values: pa.Array, chosen: np.ndarray, keep: set[str] | None = None) -> pa.Array:
    """A map for each chosen feature; values: of the layer, by their numbers."""
    wanted = np.repeat(chosen, part.tags)
    if keep is not None:
        wanted &= np.array([k in keep for k in layer.keys], bool)[part.keys] if layer.keys else wanted
    rows = np.repeat(np.arange(len(chosen)), part.tags)[wanted]
    sizes = np.bincount(rows, minlength=len(chosen))[chosen]
    offsets = pa.array(np.append(0, np.cumsum(sizes)), pa.int32())
    keys = pa.array(layer.keys, pa.string()).take(pa.array(part.keys[wanted]))
    return pa.MapArray.from_arrays(offsets, keys, values.take(pa.array(part.values[wanted])))


#: How values of columnar tiles are packed, by type.
PACKED = {"int": ("<q", b"i"), "float": ("<f", b"f")}


def packed_value(value: object, kind: str) -> bytes:
    return b"s" + str(value).encode() if kind == "string" else PACKED[kind][1] + struct.pack(PACKED[kind][0], value)


def unpacked_value(data: bytes) -> object:
    return data[1:].decode() if data[:1] == b"s" else struct.unpack("<q" if data[:1] == b"i" else "<f", data[1:])[0]


def read_stored_points(tiles: DataFrame, codec: str) -> DataFrame:
    """Points of tiles, layer by layer, with nothing lost of their values; seq counts through a tile's layers. Features
    that are not points are left out, of several points in one feature the first counts."""

    def layers(data: bytes) -> Iterator[tuple]:
        kind = pa.map_(pa.string(), pa.binary())
        if codec == "mlt":
            own = mlt.decode(data)
            if own:
                rows = [[(c, packed_value(v[i], own.types[c])) for c, v in own.columns.items() if v[i] is not None] for i in range(len(own.xs))]
                yield own.name, own.xs, own.ys, pa.array(rows, kind)
            return
        for layer in mvt.decode_columns(data):
            values = layer.messages()
            for part in layer.parts():
                points = (part.kinds == mvt.POINT) & (part.rings > 0)
                vertex = _first_vertices(part, points)
                yield layer.name, part.xs[vertex], part.ys[vertex], _attributes(layer, part, values, points)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for z, tx, ty, data in _tiles(batches):
            (ox, oy, s), first = _origin(z, tx, ty), 0
            for name, px, py, own in layers(data):
                n = len(px)
                arrays = [pa.array(np.full(n, tx)), pa.array(np.full(n, ty)), pa.array([name] * n, pa.string()), pa.array(np.arange(first, first + n)), pa.array(ox + s * np.array(px, float)), pa.array(oy - s * np.array(py, float)), own]
                yield pa.RecordBatch.from_arrays(arrays, names=[c.split()[0] for c in STORED.split(", ")])
                first += n

    return tiles.select("z", "x", "y", "data").mapInArrow(run, STORED)


def stored_schema(tiles: DataFrame) -> dict[str, dict[str, tuple[str, bool]]]:
    """layer -> column -> (type, nullable) of columnar tiles, in order. A column with several types takes the widest;
    one that some tiles lack is nullable. Comes to the driver as one row for each layer and column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [own for own in map(mlt.decode, batch.column(0).to_pylist()) if own]
            rows = [(own.name, k, c, ("int", "float", "string").index(own.types[c]), own.nullable[c], len(found)) for own in found for k, c in enumerate(own.columns)]
            rows += [(own.name, -1, "", 0, False, 0) for own in found]
            columns = zip(*rows, strict=True) if rows else [[]] * 6
            types = (pa.string(), pa.int32(), pa.string(), pa.int32(), pa.bool_(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names=["layer", "k", "name", "kind", "nulls", "n"])

    rows = tiles.select("data").mapInArrow(run, "layer string, k int, name string, kind int, nulls boolean, n long")
    found = rows.groupBy("layer", "name").agg(F.min("k").alias("k"), F.max("kind").alias("kind"), F.bool_or("nulls").alias("nulls"), F.count(F.lit(1)).alias("n")).orderBy("layer", "k", "name").collect()
    every = {r["layer"]: r["n"] for r in found if r["k"] < 0}
    out: dict[str, dict[str, tuple[str, bool]]] = {layer: {} for layer in every}
    for r in found:
        if r["k"] >= 0:
            out[r["layer"]][r["name"]] = ("int", "float", "string")[r["kind"]], r["nulls"] or r["n"] < every[r["layer"]]
    return out


def read_polygons(tiles: DataFrame, codec: str = "mvt", layer_name: str | None = None) -> DataFrame:
    """Polygons with one ring (others are left out), closed, in the plane's coordinates."""
    if codec != "mvt":
        raise mvt.TileError("polygons are read from row-oriented tiles only")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for z, tx, ty, data in _tiles(batches):
            ox, oy, s = _origin(z, tx, ty)
            for layer in mvt.decode_columns(data):
                if layer_name and layer.name != layer_name:
                    continue
                texts = layer.texts()
                for part in layer.parts():
                    if (part.kinds != mvt.POLYGON).any():
                        raise mvt.TileError("a feature is not a polygon")
                    single = part.rings == 1
                    ring = (np.cumsum(part.rings) - part.rings)[single]
                    single[single] = part.sizes[ring] > 1
                    ring = ring[part.sizes[ring] > 1]
                    n, sizes = len(ring), part.sizes[ring]
                    at = ragged((np.cumsum(part.sizes) - part.sizes)[ring], sizes)
                    vertices = pa.StructArray.from_arrays([pa.array(ox + s * part.xs[at]), pa.array(oy - s * part.ys[at])], names=["x", "y"])
                    rings = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), vertices)
                    columns = [pa.array(np.full(n, z, np.int32)), pa.array(np.full(n, tx)), pa.array(np.full(n, ty)), pa.array([layer.name] * n, pa.string()), pa.array((part.first + np.flatnonzero(single)).astype(np.int32)), rings, _attributes(layer, part, texts, single)]
                    yield pa.RecordBatch.from_arrays(columns, names=["z", "tx", "ty", "layer", "fidx", "ring", "attrs"])

    return tiles.select("z", "x", "y", "data").mapInArrow(run, POLYGONS)


def count_features(tiles: DataFrame, codec: str) -> DataFrame:
    """z, x, y, tile_id and the number of features, from tile heads alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = mlt.count if codec == "mlt" else mvt.count
        for batch in batches:
            n = [counter(d) for d in batch.column(4).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(n, pa.int64())], names=["z", "x", "y", "tile_id", "n"])

    return tiles.select("z", "x", "y", "tile_id", "data").mapInArrow(run, "z int, x long, y long, tile_id long, n long")


def typed(points: DataFrame, fields: dict[str, str] | list[str]) -> DataFrame:
    """points with a column for each attribute, in the given order; Number attributes as doubles, missing ones null."""
    names = list(fields)
    kinds = fields if isinstance(fields, dict) else dict.fromkeys(names, "String")
    own = [F.try_element_at("attrs", F.lit(n)).alias(n) if kinds[n] != "Number" else F.try_element_at("attrs", F.lit(n)).try_cast("double").alias(n) for n in names]
    return points.select(*[c for c in points.columns if c != "attrs"], *own)
