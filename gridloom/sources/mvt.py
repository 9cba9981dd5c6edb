"""Row-oriented vector tiles: features with tags into shared keys and values."""

from __future__ import annotations

import struct
from array import array
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .wire import WireError, double_of, field as wire_field, field_places, fields, get_varints, put_varint, put_varints, ragged, stream_varints, unzigzag, varint_sizes, varints_at, zigzag, zigzags

#: Fixed values of the format.
POINT, LINE, POLYGON = 1, 2, 3


class TileError(ValueError):
    """A tile that cannot be read as asked."""


@dataclass
class Feature:
    kind: int
    rings: list[list[tuple[int, int]]]
    attrs: dict[str, object]


@dataclass
class Layer:
    name: str
    extent: int
    features: list[Feature] = field(default_factory=list)


def _value(data: bytes) -> object:
    """The value of a message; the last field wins."""
    out: object = None
    for number, kind, raw in fields(data):
        if number == 1:
            out = raw.decode()
        elif number in (2, 3):
            out = double_of(raw)
        elif number == 4:
            out = raw - (1 << 64) if raw >> 63 else raw
        elif number == 5:
            out = raw
        elif number == 6:
            out = unzigzag(raw)
        elif number == 7:
            out = bool(raw)
        elif kind > 5:
            raise WireError("bad value")
    return out


def text_of(value: object) -> str | None:
    """How a value is written: doubles with six decimals, booleans in words."""
    if value is None:
        return None
    if isinstance(value, bool):
        return "true" if value else "false"
    return f"{value:.6f}" if isinstance(value, float) else str(value)


def geometry(commands: np.ndarray) -> list[list[tuple[int, int]]]:
    """Rings (or single points) from move, line and close commands, in tile coordinates."""
    out: list[list[tuple[int, int]]] = []
    at, x, y, n = 0, 0, 0, len(commands)
    while at < n:
        command, count = int(commands[at]) & 7, int(commands[at]) >> 3
        at += 1
        if command in (1, 2):
            if at + 2 * count > n:
                raise TileError("geometry ends early")
            steps = unzigzag(commands[at : at + 2 * count]).reshape(-1, 2)
            at += 2 * count
            for dx, dy in steps.tolist():
                x, y = x + dx, y + dy
                if not (-32768 <= x <= 32767 and -32768 <= y <= 32767):
                    raise TileError("coordinate outside 16 bits")
                if command == 1:
                    out.append([(x, y)])
                elif out:
                    out[-1].append((x, y))
                else:
                    raise TileError("line before any move")
        elif command == 7:
            if out:
                out[-1].append(out[-1][0])
        else:
            raise TileError(f"unknown command {command}")
    return out


def decode(data: bytes, raw: bool = False) -> list[Layer]:
    """Layers in order of name, the first of a name; each needs a version, an extent and a name. raw: values stay the
    bytes of their messages."""
    found: dict[str, Layer] = {}
    for number, _, body in fields(data):
        if number != 3:
            continue
        name, extent, version, keys, values, features = None, None, None, [], [], []
        for n, _, value in fields(body):
            if n == 1:
                name = value.decode()
            elif n == 2:
                features.append(value)
            elif n == 3:
                keys.append(value.decode())
            elif n == 4:
                values.append(value)
            elif n == 5:
                extent = value
            elif n == 15:
                version = value
        if name is None or extent is None or version is None:
            raise TileError("a layer needs a name, an extent and a version")
        if name in found:
            continue
        layer, known = Layer(name, extent), values if raw else [_value(v) for v in values]
        for message in features:
            kind, tags, shape = 0, np.zeros(0, np.uint64), np.zeros(0, np.uint64)
            for n, _, value in fields(message):
                if n == 2:
                    tags = get_varints(value)
                elif n == 3:
                    kind = value
                elif n == 4:
                    shape = get_varints(value)
            if len(tags) % 2:
                raise TileError("tags do not pair up")
            attrs: dict[str, object] = {}
            for k, v in tags.reshape(-1, 2).tolist():
                if k >= len(keys) or v >= len(known):
                    raise TileError("tag out of range")
                attrs.setdefault(keys[k], known[v])
            layer.features.append(Feature(kind, geometry(shape), attrs))
        found[name] = layer
    return [found[n] for n in sorted(found)]


def count(data: bytes) -> int:
    """Features of all layers, without reading them."""
    return sum(1 for number, _, body in fields(data) if number == 3 for n, _, _ in fields(body) if n == 2)


def _encode_value(value: object) -> bytes:
    if isinstance(value, bool):
        return wire_field(7, 0, put_varint(int(value)))
    if isinstance(value, int):
        return wire_field(6, 0, put_varint(zigzag(value, 64)))
    if isinstance(value, float):
        return wire_field(2, 5, struct.pack("<f", value))
    return wire_field(1, 2, str(value).encode())


def encode_layer(name: str, xs: list[int], ys: list[int], columns: dict[str, list], extent: int = 4096, ids: bool = False) -> bytes:
    """A tile with one layer of points; equal values of a kind are stored once, nulls are left out."""
    keys = list(columns)
    values: dict[tuple[type, object], int] = {}
    tags: list[list[int]] = [[] for _ in xs]
    for k, key in enumerate(keys):
        for row, v in enumerate(columns[key]):
            if v is not None:
                tags[row] += [k, values.setdefault((type(v), v), len(values))]
    used = {t for row in tags for t in row[::2]}
    renamed = {k: i for i, k in enumerate(sorted(used))}
    body = [wire_field(15, 0, b"\x02"), wire_field(1, 2, name.encode())]
    for row, (x, y) in enumerate(zip(xs, ys, strict=True)):
        own = tags[row]
        own[::2] = [renamed[k] for k in own[::2]]
        shape = put_varints([9, zigzag(x), zigzag(y)])
        feature = (wire_field(1, 0, put_varint(row + 1)) if ids else b"") + (wire_field(2, 2, put_varints(own)) if own else b"") + wire_field(3, 0, b"\x01") + wire_field(4, 2, shape)
        body.append(wire_field(2, 2, feature))
    body += [wire_field(3, 2, keys[k].encode()) for k in sorted(used)]
    body += [wire_field(4, 2, _encode_value(v)) for _, v in values]
    body.append(wire_field(5, 0, put_varint(extent)))
    return wire_field(3, 2, b"".join(body))


def encode_raw(name: str, xs: list[int], ys: list[int], rows: list[list[tuple[str, bytes]]], extent: int = 4096) -> bytes:
    """A layer of points whose values are messages already; keys and values in use are stored once, ids count from 1."""
    keys: dict[str, int] = {}
    values: dict[bytes, int] = {}
    body = [wire_field(15, 0, b"\x02"), wire_field(1, 2, name.encode())]
    for k, (x, y, own) in enumerate(zip(xs, ys, rows, strict=True)):
        tags = [t for key, value in own for t in (keys.setdefault(key, len(keys)), values.setdefault(value, len(values)))]
        shape = put_varints([9, zigzag(x), zigzag(y)])
        body.append(wire_field(2, 2, wire_field(1, 0, put_varint(k + 1)) + (wire_field(2, 2, put_varints(tags)) if tags else b"") + wire_field(3, 0, b"\x01") + wire_field(4, 2, shape)))
    body += [wire_field(3, 2, k.encode()) for k in keys] + [wire_field(4, 2, v) for v in values]
    return wire_field(3, 2, b"".join([*body, wire_field(5, 0, put_varint(extent))]))


def encode_polygons(name: str, rings: list[list[list[tuple[int, int]]]], attrs: list[dict[str, object]], extent: int = 4096) -> bytes:
    """A tile with one layer of polygons; rings come without a closing vertex."""
    keys, values, body = {}, {}, [wire_field(15, 0, b"\x02"), wire_field(1, 2, name.encode())]
    for shape, own in zip(rings, attrs, strict=True):
        tags, commands, x, y = [], [], 0, 0
        for k, v in own.items():
            tags += [keys.setdefault(k, len(keys)), values.setdefault((type(v), v), len(values))]
        for ring in shape:
            for k, (px, py) in enumerate(ring):
                if k < 2:
                    commands.append(9 if k == 0 else (len(ring) - 1) << 3 | 2)
                commands += [zigzag(px - x), zigzag(py - y)]
                x, y = px, py
            commands.append(15)
        body.append(wire_field(2, 2, wire_field(2, 2, put_varints(tags)) + wire_field(3, 0, b"\x03") + wire_field(4, 2, put_varints(commands))))
    body += [wire_field(3, 2, k.encode()) for k in keys] + [wire_field(4, 2, _encode_value(v)) for _, v in values]
    return wire_field(3, 2, b"".join([*body, wire_field(5, 0, put_varint(extent))]))


# --- whole columns of features ----------------------------------------------------------------------------------
#
# The same tiles for tables: bytes equal those of encode_layer and encode_polygons, features those of decode. No object
# is made for a feature, so what a task holds of a tile is a few times its bytes.

#: Features or values that are encoded or decoded together.
PART = 1 << 14


def _numbered(columns: list[pa.Array], by_row: bool) -> tuple[list[np.ndarray], list[bytes]]:
    """(numbers of the values of each column, -1 for nulls; the stored values in order, as bytes). Equal values of a kind
    are stored once, in the order in which they appear column by column or row by row."""
    n, width, at, firsts, messages = len(columns[0]) if columns else 0, len(columns), 0, [], []
    numbers: list[np.ndarray] = [np.zeros(0, np.int32)] * width
    for kind in dict.fromkeys(c.type for c in columns):
        own = [k for k, c in enumerate(columns) if c.type == kind]
        coded = pa.concat_arrays([columns[k] for k in own]).dictionary_encode()
        index = pc.fill_null(coded.indices, -1).to_numpy(zero_copy_only=False)
        first = np.full(len(coded.dictionary), n * width, np.int64)
        for j, k in enumerate(own):
            part = index[j * n : (j + 1) * n]
            there = np.flatnonzero(part >= 0)
            np.minimum.at(first, part[there], there * width + k if by_row else k * n + there)
            numbers[k] = np.where(part >= 0, part + np.int32(at), np.int32(-1))
        firsts.append(first)
        messages.append(coded.dictionary)
        at += len(first)
    order = np.argsort(np.concatenate([np.zeros(0, np.int64), *firsts]), kind="stable")
    rank = np.empty(at + 1, np.int32)
    rank[order], rank[at] = np.arange(at), -1
    return [rank[c] for c in numbers], _stored(messages, order)


def _stored(pools: list[pa.Array], order: np.ndarray) -> list[bytes]:
    """Value fields of a layer, in order, some thousands a piece."""
    starts, out = np.cumsum([0, *[len(p) for p in pools]]), []
    for a in range(0, len(order), PART):
        part = order[a : a + PART]
        sizes, held = np.zeros(len(part), np.int64), []
        for pool, start in zip(pools, starts, strict=False):
            own = np.flatnonzero((part >= start) & (part < start + len(pool)))
            values = pool.take(pa.array(part[own] - start))
            if pa.types.is_integer(pool.type):
                number = zigzags(values.to_numpy())
                size = varint_sizes(number)
                flat = np.column_stack([np.full(len(own), 34), size + 1, np.full(len(own), 48)]).astype(np.uint64)
                held.append((own, stream_varints(np.column_stack([flat, number]).ravel())))
                sizes[own] = size + 3
            else:
                messages = [wire_field(4, 2, _encode_value(v)) for v in values.to_pylist()]
                held.append((own, b"".join(messages)))
                sizes[own] = [len(m) for m in messages]
        data, places = np.empty(int(sizes.sum()), np.uint8), np.cumsum(sizes) - sizes
        for own, raw in held:
            data[ragged(places[own], sizes[own])] = np.frombuffer(raw, np.uint8)
        out.append(data.tobytes())
    return out


def _wide(column: pa.Array) -> pa.Array:
    """Whole numbers and floats of one width each, so that equal values are found."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_integer(column.type):
        return column.cast(pa.int64())
    return column.cast(pa.float64()) if pa.types.is_floating(column.type) else column


def _encode_features(name: str, kind: int, total: int, shapes: Callable[[slice], tuple[np.ndarray, np.ndarray]], columns: dict[str, pa.Array], by_row: bool, extent: int, ids: bool) -> bytes:
    """A tile with one layer. shapes: geometry of some features, and how many numbers each has."""
    used = {k: _wide(v) for k, v in columns.items() if v.null_count < len(v)}
    numbers, values = _numbered(list(used.values()), by_row)
    body = [wire_field(15, 0, b"\x02"), wire_field(1, 2, name.encode())]
    for a in range(0, total, PART):
        shape, part = shapes(slice(a, a + PART))
        n = len(part)
        size = np.add.reduceat(varint_sizes(shape), np.cumsum(part) - part)
        tags = [c[a : a + n] for c in numbers]
        tag_bytes = sum((np.where(c >= 0, varint_sizes(np.full(n, k, np.uint64)) + varint_sizes(np.maximum(c, 0).astype(np.uint64)), 0) for k, c in enumerate(tags)), np.zeros(n, np.int64))
        tagged, every, row = tag_bytes > 0, np.ones(n, bool), np.arange(a + 1, a + n + 1)
        # every byte of a feature belongs to a varint: (number or numbers, where it is there)
        inner = [(8, every), (row, every)] if ids else []
        inner += [(18, tagged), (tag_bytes, tagged)]
        for k, c in enumerate(tags):
            inner += [(k, c >= 0), (np.maximum(c, 0), c >= 0)]
        inner += [(24, every), (kind, every), (34, every), (size, every)]
        numbers_of = np.empty((n, 2 + len(inner)), np.uint64)
        there = np.empty(numbers_of.shape, bool)
        for k, (value, has) in enumerate(inner):
            numbers_of[:, k + 2], there[:, k + 2] = value, has
        own = varint_sizes(numbers_of[:, 2:].ravel()).reshape(n, -1)
        numbers_of[:, 0], numbers_of[:, 1], there[:, :2] = 18, (own * there[:, 2:]).sum(axis=1) + size, True
        heads = there.sum(axis=1)
        starts = np.cumsum(heads + part) - heads - part
        flat = np.empty(int((heads + part).sum()), np.uint64)
        flat[ragged(starts, heads)] = numbers_of[there]
        flat[ragged(starts + heads, part)] = shape
        body.append(stream_varints(flat))
    body += [wire_field(3, 2, k.encode()) for k in used] + values
    return wire_field(3, 2, b"".join([*body, wire_field(5, 0, put_varint(extent))]))


def _zigzag32(values: np.ndarray) -> np.ndarray:
    return zigzags(values.astype(np.int32))


def encode_points(name: str, xs: np.ndarray, ys: np.ndarray, columns: dict[str, pa.Array], extent: int = 4096, ids: bool = False) -> bytes:
    """encode_layer of columns."""

    def shapes(part: slice) -> tuple[np.ndarray, np.ndarray]:
        x, y = _zigzag32(xs[part]), _zigzag32(ys[part])
        return np.column_stack([np.full(len(x), 9, np.uint64), x, y]).ravel(), np.full(len(x), 3)

    return _encode_features(name, POINT, len(xs), shapes, columns, False, extent, ids)


def encode_rings(name: str, xs: np.ndarray, ys: np.ndarray, sizes: np.ndarray, columns: dict[str, pa.Array], extent: int = 4096) -> bytes:
    """encode_polygons of polygons of one ring each; sizes: vertices of each ring (two or more), without a closing one.
    Nulls are left out."""
    if (sizes < 2).any():
        raise TileError("a ring has two vertices at least")
    first = np.cumsum(sizes) - sizes

    def shapes(part: slice) -> tuple[np.ndarray, np.ndarray]:
        own, low = sizes[part], int(first[part.start])
        starts, x, y = first[part] - low, xs[low : low + int(own.sum())], ys[low : low + int(own.sum())]
        dx, dy = np.diff(x, prepend=0), np.diff(y, prepend=0)
        dx[starts], dy[starts] = x[starts], y[starts]
        counts = 2 * own + 3
        begins = np.cumsum(counts) - counts
        out = np.empty(int(counts.sum()), np.uint64)
        out[begins], out[begins + 3], out[begins + counts - 1] = 9, ((own - 1) << 3 | 2).astype(np.uint64), 15
        nth = ragged(np.zeros(len(own), np.int64), own)
        at = np.repeat(begins, own) + 1 + 2 * nth + (nth > 0)
        out[at], out[at + 1] = _zigzag32(dx), _zigzag32(dy)
        return out, counts

    return _encode_features(name, POLYGON, len(sizes), shapes, columns, True, extent, False)


@dataclass
class Part:
    """Some features of a layer, the first of them the nth: kinds; rings of each; vertices of each ring, with their
    places; tags of each, with the numbers of keys and values, each key once."""

    first: int
    kinds: np.ndarray
    rings: np.ndarray
    sizes: np.ndarray
    xs: np.ndarray
    ys: np.ndarray
    tags: np.ndarray
    keys: np.ndarray
    values: np.ndarray


class LayerColumns:
    """A layer whose features are decoded a part at a time."""

    def __init__(self, data: bytes, start: int, end: int) -> None:
        self.data, self.raw = data, np.frombuffer(data, np.uint8)
        name, extent, version, keys, features, values = None, None, None, [], array("q"), array("q")
        for number, kind, a, b in field_places(data, start, end):
            if number == 2:
                features.append(a)
                features.append(b)
            elif number == 4:
                values.append(a)
                values.append(b)
            elif number == 1:
                name = data[a:b].decode()
            elif number == 3:
                keys.append(data[a:b].decode())
            elif number == 5:
                extent = a
            elif number == 15:
                version = a
        if name is None or extent is None or version is None:
            raise TileError("a layer needs a name, an extent and a version")
        self.name, self.keys = name, keys
        self.features, self._values = (np.frombuffer(v, np.int64).reshape(-1, 2) for v in (features, values))
        known: dict[str, int] = {}
        self._same = np.array([known.setdefault(k, i) for i, k in enumerate(keys)], np.int64)

    def messages(self) -> pa.Array:
        """The stored values as they are."""
        return pa.array([self.data[a:b] for a, b in self._values.tolist()], pa.binary())

    def texts(self) -> pa.Array:
        """The stored values as text; whole numbers in zigzag form are read together."""
        parts = [self._texts(self._values[a : a + PART]) for a in range(0, len(self._values), PART)]
        return pa.concat_arrays(parts) if parts else pa.array([], pa.string())

    def _texts(self, places: np.ndarray) -> pa.Array:
        starts, ends = places[:, 0], places[:, 1]
        size = ends - starts
        last = np.where(size > 1, self.raw[np.maximum(ends - 1, 0)], 255)
        plain = (size > 1) & (size < 11) & (last < 128) & (self.raw[np.minimum(starts, len(self.raw) - 1)] == 48)
        at = np.flatnonzero(plain)
        number, stop = varints_at(self.raw, starts[at] + 1, ends[at])
        at, number = at[stop == ends[at]], number[stop == ends[at]]
        plain = np.zeros(len(places), bool)
        plain[at] = True
        rest = np.flatnonzero(~plain)
        others = [text_of(_value(self.data[a:b])) for a, b in places[rest].tolist()]
        order = np.empty(len(places), np.int64)
        order[at], order[rest] = np.arange(len(at)), len(at) + np.arange(len(rest))
        return pa.concat_arrays([pa.array(unzigzag(number), pa.int64()).cast(pa.string()), pa.array(others, pa.string())]).take(pa.array(order))

    def parts(self) -> Iterator[Part]:
        for a in range(0, len(self.features), PART):
            yield self._part(a, self.features[a : a + PART])

    def _part(self, first: int, places: np.ndarray) -> Part:
        n, at, ends = len(places), places[:, 0].copy(), places[:, 1]
        kinds, tags, shapes = np.zeros(n, np.int64), np.zeros((n, 2), np.int64), np.zeros((n, 2), np.int64)
        live = np.flatnonzero(at < ends)
        while len(live):  # the next field of all features that have one
            key, at[live] = varints_at(self.raw, at[live], ends[live])
            number, kind = key >> np.uint64(3), key & np.uint64(7)
            if not np.isin(kind, (0, 1, 2, 5)).all():
                raise WireError("unknown wire type")
            if (((number == 2) | (number == 4)) & (kind != 2)).any() or ((number == 3) & (kind != 0)).any():
                raise TileError("a field of a feature has the wrong type")
            own = live[kind == 0]
            value, at[own] = varints_at(self.raw, at[own], ends[own])
            is_kind = number[kind == 0] == 3
            kinds[own[is_kind]] = value[is_kind].astype(np.int64)
            size = np.where(kind == 1, 8, np.where(kind == 5, 4, 0)).astype(np.uint64)
            packed = live[kind == 2]
            size[kind == 2], at[packed] = varints_at(self.raw, at[packed], ends[packed])
            if (size > (ends[live] - at[live]).astype(np.uint64)).any():
                raise WireError("field exceeds message")
            for k, where in ((2, tags), (4, shapes)):
                of = number == k
                where[live[of], 0], where[live[of], 1] = at[live[of]], size[of].astype(np.int64)
            at[live] += size.astype(np.int64)
            live = live[at[live] < ends[live]]
        return Part(first, kinds, *self._shapes(*self._packed(shapes)), *self._tags(*self._packed(tags)))

    def _packed(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Varints of stretches, and how many each holds."""
        starts, sizes = places[:, 0], places[:, 1]
        data = self.raw[ragged(starts, sizes)]
        ends = np.cumsum(sizes)
        if (data[ends[sizes > 0] - 1] >= 128).any():
            raise WireError("truncated varint")
        seen = np.append(0, np.cumsum(data < 128))
        return get_varints(data), seen[ends] - seen[ends - sizes]

    def _tags(self, numbers: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if (counts % 2).any():
            raise TileError("tags do not pair up")
        pairs = numbers.reshape(-1, 2)
        if (pairs[:, 0] >= len(self.keys)).any() or (pairs[:, 1] >= len(self._values)).any():
            raise TileError("tag out of range")
        counts, values = counts // 2, pairs[:, 1].astype(np.int64)
        keys = self._same[pairs[:, 0].astype(np.int64)] if len(pairs) else np.zeros(0, np.int64)
        rows = np.repeat(np.arange(len(counts)), counts)
        once = np.unique(rows * max(1, len(self.keys)) + keys, return_index=True)[1]
        if len(once) < len(keys):  # the first of a key counts
            once.sort()
            counts, keys, values = np.bincount(rows[once], minlength=len(counts)), keys[once], values[once]
        return counts, keys, values

    def _shapes(self, numbers: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Rings of each feature, vertices of each ring, and their places. Single points and single closed rings are read
        together; if there is another shape, all are read one by one."""
        ends = np.cumsum(counts)
        begins, n = ends - counts, len(counts)
        if n and (counts >= 3).all() and (numbers[begins] == 9).all():
            ring = counts > 3
            at, more = begins[ring], counts[ring]
            steps = (more - 5) // 2
            if (more >= 7).all() and (more % 2 == 1).all() and (numbers[at + 3] == (steps << 3 | 2).astype(np.uint64)).all() and (numbers[at + more - 1] == 15).all():
                own = np.ones(len(numbers), bool)
                own[begins] = own[at + 3] = own[at + more - 1] = False
                return self._rings(unzigzag(numbers[own]).reshape(-1, 2), np.where(ring, (counts - 3) // 2, 1), ring)
        rings = [geometry(numbers[a:b]) for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]
        vertices = np.array([p for shape in rings for r in shape for p in r], np.int64).reshape(-1, 2)
        return np.array([len(s) for s in rings], np.int64), np.array([len(r) for s in rings for r in s], np.int64), vertices[:, 0], vertices[:, 1]

    def _rings(self, steps: np.ndarray, sizes: np.ndarray, closed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        if (np.abs(steps) > 65535).any() or (steps == np.iinfo(np.int64).min).any():
            raise TileError("coordinate outside 16 bits")
        starts = np.cumsum(sizes) - sizes
        sums = np.cumsum(steps, axis=0)
        vertices = sums - np.repeat(sums[starts] - steps[starts], sizes, axis=0)
        if ((vertices < -32768) | (vertices > 32767)).any():
            raise TileError("coordinate outside 16 bits")
        whole = sizes + closed
        at = ragged(starts, whole)
        at[np.cumsum(whole)[closed] - 1] = starts[closed]  # the first vertex closes a ring
        return np.ones(len(sizes), np.int64), whole, vertices[at, 0], vertices[at, 1]


def decode_columns(data: bytes) -> list[LayerColumns]:
    """decode for tables: layers in order of name, the first of a name."""
    found: dict[str, LayerColumns] = {}
    for number, kind, a, b in field_places(data, 0, len(data)):
        if number == 3 and kind == 2:
            layer = LayerColumns(data, a, b)
            found.setdefault(layer.name, layer)
    return [found[n] for n in sorted(found)]
