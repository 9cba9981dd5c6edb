"""Varints, zigzag, protobuf fields and run-length coded booleans."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np


class WireError(ValueError):
    """Bytes that are no valid encoding."""


def put_varint(value: int) -> bytes:
    out = bytearray()
    while value > 127:
        out.append(value & 127 | 128)
        value >>= 7
    out.append(value)
    return bytes(out)


def get_varint(data: bytes, at: int) -> tuple[int, int]:
    """(value, place after it)."""
    value = shift = 0
    while True:
        if at >= len(data) or shift > 63:
            raise WireError("truncated or overlong varint")
        b = data[at]
        at += 1
        value |= (b & 127) << shift
        if b < 128:
            if value >> 64:
                raise WireError("varint exceeds 64 bits")
            return value, at
        shift += 7


def put_varints(values: list[int] | np.ndarray) -> bytes:
    return b"".join([bytes((v,)) if v < 128 else put_varint(v) for v in (values.tolist() if isinstance(values, np.ndarray) else values)])


def get_varints(data: bytes) -> np.ndarray:
    """All varints of packed bytes as unsigned 64-bit numbers, found by their last bytes."""
    raw = np.frombuffer(data, np.uint8)
    if not len(raw):
        return np.zeros(0, np.uint64)
    ends = np.flatnonzero(raw < 128)
    if not len(ends) or ends[-1] != len(raw) - 1:
        raise WireError("truncated varint")
    starts = np.concatenate([[0], ends[:-1] + 1])
    lengths = ends - starts + 1
    if lengths.max() > 10:
        raise WireError("overlong varint")
    out = np.zeros(len(ends), np.uint64)
    for k in range(int(lengths.max())):
        has = lengths > k
        out[has] |= (raw[starts[has] + k] & np.uint8(127)).astype(np.uint64) << np.uint64(7 * k)
    return out


def varint_sizes(values: np.ndarray) -> np.ndarray:
    """Bytes that each of unsigned 64-bit numbers takes."""
    out = np.ones(len(values), np.int64)
    for k in range(1, 10):
        more = values >= np.uint64(1) << np.uint64(7 * k)
        if not more.any():
            break
        out += more
    return out


def stream_varints(values: np.ndarray) -> bytes:
    """put_varints for many unsigned 64-bit numbers, a byte of all of them at a time."""
    sizes = varint_sizes(values)
    at = np.cumsum(sizes) - sizes
    out = np.empty(int(sizes.sum()), np.uint8)
    for k in range(int(sizes.max(initial=0))):
        has = np.flatnonzero(sizes > k)
        own = (values[has] >> np.uint64(7 * k)) & np.uint64(127)
        out[at[has] + k] = own.astype(np.uint8) | np.where(sizes[has] > k + 1, np.uint8(128), np.uint8(0))
    return out.tobytes()


def varints_at(raw: np.ndarray, at: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """get_varint at many places of the same bytes; none may reach its end."""
    value, at, live = np.zeros(len(at), np.uint64), at.copy(), np.arange(len(at))
    for shift in range(0, 70, 7):
        if not len(live):
            break
        if (at[live] >= ends[live]).any():
            raise WireError("truncated or overlong varint")
        b = raw[at[live]]
        if shift == 63 and (b > 1).any():
            raise WireError("varint exceeds 64 bits")
        value[live] |= (b & np.uint8(127)).astype(np.uint64) << np.uint64(shift)
        at[live] += 1
        live = live[b >= 128]
    return value, at


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Places of all elements of stretches, one stretch after the other."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))


def zigzag(value: int, bits: int = 32) -> int:
    return (value << 1 ^ value >> (bits - 1)) & ((1 << bits) - 1)


def zigzags(values: np.ndarray) -> np.ndarray:
    v = values.astype(np.int64)
    return ((v << 1) ^ (v >> 63)).astype(np.uint64)


def unzigzag(values: np.ndarray | int) -> np.ndarray | int:
    if isinstance(values, int):
        return values >> 1 ^ -(values & 1)
    return (values >> np.uint64(1)).astype(np.int64) ^ -(values & np.uint64(1)).astype(np.int64)


def field(number: int, kind: int, body: bytes) -> bytes:
    return put_varint(number << 3 | kind) + (put_varint(len(body)) if kind == 2 else b"") + body


def fields(data: bytes) -> Iterator[tuple[int, int, int | bytes]]:
    """(number, wire type, value) of each field of a message."""
    for number, kind, value, end in field_places(data, 0, len(data)):
        yield number, kind, data[value:end] if kind else value


def field_places(data: bytes, at: int, n: int) -> Iterator[tuple[int, int, int, int]]:
    """(number, wire type, start, end) of each field of the message from at to n; of a varint its value and 0."""
    while at < n:
        key, at = get_varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = get_varint(data, at)
            if at > n:
                raise WireError("field exceeds message")
            yield key >> 3, kind, value, 0
        elif kind in (1, 2, 5):
            size = 8 if kind == 1 else 4
            if kind == 2:
                size, at = get_varint(data, at)
            if at + size > n:
                raise WireError("field exceeds message")
            yield key >> 3, kind, at, at + size
            at += size
        else:
            raise WireError(f"unknown wire type {kind}")


def bools_encode(values: np.ndarray) -> bytes:
    """Bits, least first, in literal runs of up to 128 bytes, each after a byte 256 - length."""
    raw = np.packbits(values.astype(np.uint8), bitorder="little").tobytes()
    return b"".join(bytes((256 - len(part),)) + part for part in (raw[k : k + 128] for k in range(0, len(raw), 128)))


def bools_decode(data: bytes, n: int) -> np.ndarray:
    """n booleans; a run byte below 128 repeats the next byte run + 3 times; what is missing counts as true."""
    out, at = bytearray(), 0
    while at < len(data) and 8 * len(out) < n:
        run = data[at]
        at += 1
        if run >= 128:
            out += data[at : at + 256 - run]
            at += 256 - run
        elif at < len(data):
            out += data[at : at + 1] * (run + 3)
            at += 1
    bits = np.unpackbits(np.frombuffer(bytes(out), np.uint8), bitorder="little")[:n].astype(bool)
    return np.concatenate([bits, np.ones(n - len(bits), bool)])


def float32(values: np.ndarray) -> bytes:
    return values.astype("<f4").tobytes()


def double_of(raw: bytes) -> float:
    return struct.unpack("<d", raw)[0] if len(raw) == 8 else struct.unpack("<f", raw)[0]
