"""Columnar vector tiles of points: one layer, a geometry column and typed columns, each in streams."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from .wire import WireError, bools_decode, bools_encode, float32, get_varint, get_varints, put_varint, put_varints, unzigzag, zigzags

#: Fixed values of the format: column type codes (odd: nullable) and stream heads.
GEOMETRY, INT, FLOAT, STRING = 4, 16, 24, 28
HEAD = {"type": b"\x10\x02", "vertex": b"\x13\x02", "int": b"\x10\x02", "float": b"\x10\x00", "length": b"\x30\x02", "data": b"\x10\x00", "present": b"\x00\x02"}


@dataclass
class MltLayer:
    name: str
    extent: int
    xs: np.ndarray
    ys: np.ndarray
    types: dict[str, str]
    columns: dict[str, list]
    nullable: dict[str, bool]


def _stream(head: bytes, n: int, body: bytes) -> bytes:
    return head + put_varint(n) + put_varint(len(body)) + body


def _name(text: str) -> bytes:
    raw = text.encode()
    return put_varint(len(raw)) + raw


#: Points of a chunk are a multiple of this, so that presence bits (literal runs of 128 bytes) follow one another.
ALIGN = 1024


@dataclass
class MltChunk:
    """The streams of some points of a tile: vertices, and of each column presence bits, lengths, data, and values there."""

    n: int
    vertices: bytes
    columns: list[tuple[bytes, bytes, bytes, int]]


def encode_chunk(xs: list[int], ys: list[int], columns: dict[str, list], types: dict[str, str]) -> MltChunk:
    """Streams of points that stand one after the other in a tile, without their heads; ints beyond 32 bits are 0."""
    n = len(xs)
    xy = np.stack([np.array(xs, np.int64), np.array(ys, np.int64)], axis=1).ravel() if n else np.zeros(0, np.int64)
    out = []
    for c, values in columns.items():
        there = np.array([v is not None for v in values], bool)
        own, lengths = [v for v in values if v is not None], b""
        if types[c] == "string":
            raw = [str(v).encode() for v in own]
            lengths, data = put_varints([len(r) for r in raw]), b"".join(raw)
        elif types[c] == "int":
            data = put_varints(zigzags(np.array([int(v) if -(1 << 31) <= int(v) < 1 << 31 else 0 for v in own], np.int64)))
        else:
            data = float32(np.array(own, np.float64))
        out.append((bools_encode(there), lengths, data, len(own)))
    return MltChunk(n, put_varints(zigzags(xy)), out)


def join_chunks(name: str, chunks: list[MltChunk], types: dict[str, str], nullable: dict[str, bool] | None = None, extent: int = 4096) -> bytes:
    """A tile with one layer from its chunks in order; all but the last hold a multiple of ALIGN points. types: int, float
    or string for each column; nullable: None for what the values say."""
    n = sum(k.n for k in chunks)
    there = [sum(k.columns[i][3] for k in chunks) for i in range(len(types))]
    nulls = nullable or {c: there[i] < n for i, c in enumerate(types)}
    code = {"int": INT, "float": FLOAT, "string": STRING}
    out = [_name(name), put_varint(extent), put_varint(len(types) + 1), put_varint(GEOMETRY)]
    for c in types:
        out += [put_varint(code[types[c]] + bool(nulls[c])), _name(c)]
    out += [put_varint(2), _stream(HEAD["type"], n, bytes(n)), _stream(HEAD["vertex"], 2 * n, b"".join(k.vertices for k in chunks))]
    for i, c in enumerate(types):
        present, lengths, data = (b"".join(k.columns[i][part] for k in chunks) for part in range(3))
        present = _stream(HEAD["present"], n, present) if nulls[c] else b""
        if types[c] == "string":
            out += [put_varint(2 + bool(nulls[c])), present, _stream(HEAD["length"], there[i], lengths), _stream(HEAD["data"], 0, data)]
        else:
            out += [present, _stream(HEAD[types[c]], there[i], data)]
    body = b"\x01" + b"".join(out)
    return put_varint(len(body)) + body


def encode_layer(name: str, xs: list[int], ys: list[int], columns: dict[str, list], types: dict[str, str], nullable: dict[str, bool] | None = None, extent: int = 4096) -> bytes:
    """A tile with one layer, as one chunk."""
    return join_chunks(name, [encode_chunk(xs, ys, columns, types)], {c: types[c] for c in columns}, nullable, extent)


def _layers(data: bytes):
    at = 0
    while at < len(data):
        size, at = get_varint(data, at)
        if at + size > len(data) or size < 1:
            raise WireError("layer exceeds tile")
        yield data[at], data[at + 1 : at + size]
        at += size


class _Cursor:
    def __init__(self, data: bytes) -> None:
        self.data, self.at = data, 0

    def number(self) -> int:
        value, self.at = get_varint(self.data, self.at)
        return value

    def text(self) -> str:
        return self.take(self.number()).decode()

    def take(self, n: int) -> bytes:
        if self.at + n > len(self.data):
            raise WireError("stream exceeds layer")
        self.at += n
        return self.data[self.at - n : self.at]

    def stream(self) -> tuple[bytes, int, bytes]:
        head = self.take(2)
        n, size = self.number(), self.number()
        return head, n, self.take(size)


def _front(body: bytes) -> tuple[_Cursor, str, int, list[tuple[int, str]]]:
    c = _Cursor(body)
    name, extent, n = c.text(), c.number(), c.number()
    kinds = []
    for _ in range(n):
        code = c.number()
        kinds.append((code, c.text() if code >= 10 else ""))
    return c, name, extent, kinds


def decode(data: bytes) -> MltLayer | None:
    """The first layer with tag 1; whole-number columns are codes 16 to 23, so what the encoder writes is read back."""
    for tag, body in _layers(data):
        if tag != 1:
            continue
        c, name, extent, kinds = _front(body)
        xs = ys = np.zeros(0, np.int64)
        types: dict[str, str] = {}
        columns: dict[str, list] = {}
        nullable: dict[str, bool] = {}
        n = 0
        for code, column in kinds:
            if code == GEOMETRY:
                for _ in range(c.number()):
                    head, count, raw = c.stream()
                    if head[0] == HEAD["vertex"][0]:
                        xy = unzigzag(get_varints(raw)).reshape(-1, 2)
                        n, xs, ys = count // 2, xy[:, 0], xy[:, 1]
                continue
            kind = "int" if 16 <= code <= 23 else "float" if 24 <= code <= 27 else "string"
            there = None
            streams = c.number() if kind == "string" else 1 + code % 2
            own: list = []
            lengths = np.zeros(0, np.int64)
            for _ in range(streams):
                head, count, raw = c.stream()
                if head[0] >> 4 == 0:
                    there = bools_decode(raw, n)
                elif head[0] >> 4 == 3:
                    lengths = get_varints(raw).astype(np.int64)
                elif kind == "int":
                    own = unzigzag(get_varints(raw)).tolist()
                elif kind == "float":
                    own = np.frombuffer(raw, "<f4").astype(float).tolist()
                else:
                    ends = np.cumsum(lengths)
                    own = [raw[e - k : e].decode() for e, k in zip(ends.tolist(), lengths.tolist(), strict=True)]
            types[column], nullable[column] = kind, bool(code % 2)
            if there is not None:
                rest = iter(own)
                own = [next(rest, None) if t else None for t in there.tolist()]
            columns[column] = own
        return MltLayer(name, extent, xs, ys, types, columns, nullable)
    return None


def count(data: bytes) -> int:
    """Points of the first layer with tag 1, from the head of its vertex stream."""
    for tag, body in _layers(data):
        if tag == 1:
            c, _, _, kinds = _front(body)
            if any(code == GEOMETRY for code, _ in kinds):
                for _ in range(c.number()):
                    head, n, _ = c.stream()
                    if head[0] == HEAD["vertex"][0]:
                        return n // 2
    return 0


def text_of(value: object) -> str | None:
    """How a value is written: floats with nine significant digits."""
    return None if value is None else f"{value:.9g}" if isinstance(value, float) else str(value)
