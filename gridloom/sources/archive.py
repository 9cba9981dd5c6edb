"""Single-file tile archives: header, directories, metadata, and byte-range readers.

Layout: 127-byte header, root directory, metadata (JSON), leaf directories, tile data.
"""

from __future__ import annotations

import bisect
import gzip
import http.client
import json
import struct
import time
import urllib.error
import urllib.request
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import TypeVar

from ..functions.tileid import id_of, zxy_of
from .wire import WireError, get_varint, put_varint

T = TypeVar("T")

#: Fixed values of the format, version 3.
MAGIC, VERSION, HEADER_SIZE = b"PMTiles", 3, 127
LAYOUT = "<7sB11Q6B4iB2i"
NAMES = (
    "root_dir_offset", "root_dir_bytes", "json_metadata_offset", "json_metadata_bytes", "leaf_dirs_offset", "leaf_dirs_bytes", "tile_data_offset", "tile_data_bytes",
    "addressed_tiles_count", "tile_entries_count", "tile_contents_count", "clustered", "internal_compression", "tile_compression", "tile_type", "min_zoom", "max_zoom",
    "min_lon_e7", "min_lat_e7", "max_lon_e7", "max_lat_e7", "center_zoom", "center_lon_e7", "center_lat_e7",
)
COMPRESSION = {"unknown": 0, "none": 1, "gzip": 2}
TILE_TYPES = {"mvt": 1, "mlt": 6}
ROOT_LIMIT = 16384 - HEADER_SIZE
LEAF_START = 4096
#: Directories below one another that readers follow.
DEPTH = 5


class ArchiveError(ValueError):
    """A file that is no archive of the supported kind."""


@dataclass
class Entry:
    """A directory entry; offset is within the tile data. run 0: a pointer to a leaf directory."""

    tile_id: int
    offset: int
    length: int
    run: int = 1


@dataclass
class Archive:
    header: dict[str, int]
    metadata: dict
    entries: list[Entry] = field(default_factory=list)

    def tiles(self) -> list[tuple[int, int, int, int, int, int]]:
        """(z, x, y, tile_id, absolute offset, length) of every addressed tile: by zoom, x, then y from below."""
        start = self.header["tile_data_offset"]
        rows = [(*zxy_of(e.tile_id + k), e.tile_id + k, start + e.offset, e.length) for e in self.entries for k in range(e.run)]
        return sorted(rows, key=lambda r: (r[0], r[1], -r[2]))

    @property
    def codec(self) -> str:
        names = {v: k for k, v in TILE_TYPES.items()}
        if self.header["tile_type"] not in names:
            raise ArchiveError(f"tile type {self.header['tile_type']} is not supported")
        return names[self.header["tile_type"]]


def encode_header(values: dict[str, int]) -> bytes:
    return struct.pack(LAYOUT, MAGIC, VERSION, *[int(values.get(n, 0)) for n in NAMES])


def decode_header(data: bytes) -> dict[str, int]:
    if len(data) < HEADER_SIZE or data[:7] != MAGIC:
        raise ArchiveError("not a tile archive")
    if data[7] != VERSION:
        raise ArchiveError(f"archive version {data[7]} is not supported")
    return dict(zip(NAMES, struct.unpack(LAYOUT, data[:HEADER_SIZE])[2:], strict=True))


def encode_directory(entries: list[Entry]) -> bytes:
    """Columns of varints: count, steps of tile ids, runs, lengths, offsets (0: right after the one before)."""
    out, last = [put_varint(len(entries))], 0
    for e in entries:
        out.append(put_varint(e.tile_id - last))
        last = e.tile_id
    out += [put_varint(e.run) for e in entries]
    out += [put_varint(e.length) for e in entries]
    for k, e in enumerate(entries):
        before = entries[k - 1] if k else None
        out.append(put_varint(0 if before and e.offset == before.offset + before.length else e.offset + 1))
    return b"".join(out)


def decode_directory(data: bytes) -> list[Entry]:
    n, at = get_varint(data, 0)
    if n > len(data):
        raise WireError("directory count exceeds its bytes")
    columns: list[list[int]] = []
    for _ in range(4):
        column = []
        for _ in range(n):
            value, at = get_varint(data, at)
            column.append(value)
        columns.append(column)
    if at != len(data):
        raise WireError("trailing bytes after directory")
    out, tile_id = [], 0
    for step, run, length, offset in zip(*columns, strict=True):
        tile_id += step
        if tile_id >= 1 << 63:
            raise WireError("tile id overflow")
        if not offset and not out:
            raise WireError("first entry has no offset")
        out.append(Entry(tile_id, out[-1].offset + out[-1].length if not offset else offset - 1, length, run))
    return out


def compress(data: bytes, kind: int = COMPRESSION["gzip"]) -> bytes:
    return gzip.compress(data, mtime=0) if kind == COMPRESSION["gzip"] else data


def decompress(data: bytes, kind: int) -> bytes:
    if kind == COMPRESSION["none"]:
        return data
    if kind == COMPRESSION["gzip"]:
        return zlib.decompress(data, 47)
    raise ArchiveError(f"compression {kind} is not supported")


def split_directory(entries: list[Entry], kind: int = COMPRESSION["gzip"]) -> tuple[bytes, bytes]:
    """(root, leaves): one root if it fits, else leaves of so many entries that the root of pointers fits."""
    root = compress(encode_directory(entries), kind)
    if len(root) <= ROOT_LIMIT:
        return root, b""
    size = LEAF_START
    while True:
        pointers, leaves = [], b""
        for k in range(0, len(entries), size):
            leaf = compress(encode_directory(entries[k : k + size]), kind)
            pointers.append(Entry(entries[k].tile_id, len(leaves), len(leaf), 0))
            leaves += leaf
        root = compress(encode_directory(pointers), kind)
        if len(root) <= ROOT_LIMIT:
            return root, leaves
        size *= 2


class RangeReader:
    """Reads bytes [offset, offset + length) of a local file, an http(s) address, an s3 object (anonymously), or a file
    of another file system that pyarrow opens by its address (hdfs://, gs://, ...)."""

    ATTEMPTS, WAIT = 4, 0.15

    def __init__(self, path: str) -> None:
        if path.startswith("s3://"):
            bucket, _, key = path[5:].partition("/")
            path = f"https://{bucket}.s3.amazonaws.com/{key}"
        self.path = path.removeprefix("file://") if path.startswith("file:") else path
        self.remote = path.startswith(("http://", "https://"))
        if self.remote:
            self.file, self.size = None, self._size()
        elif "://" in self.path:
            from pyarrow.fs import FileSystem

            system, place = FileSystem.from_uri(self.path)
            self.file = system.open_input_file(place)
        else:
            self.file = open(self.path, "rb")  # noqa: SIM115

    def read(self, offset: int, length: int) -> bytes:
        if self.file:
            self.file.seek(offset)
            data = self.file.read(length)
        else:
            data = self._get(offset, length)
        if len(data) != length:
            raise ArchiveError(f"{self.path}: {length} bytes at {offset} asked for, {len(data)} read")
        return data

    def _size(self) -> int:
        size = int(self._ask(urllib.request.Request(self.path, method="HEAD"), lambda answer: answer.headers.get("Content-Length") or 0))
        if size <= 0:
            raise ArchiveError(f"{self.path} does not tell its size")
        return size

    def _get(self, offset: int, length: int) -> bytes:
        def take(answer: http.client.HTTPResponse) -> bytes:
            # a server that ignores ranges sends the whole: right only if the whole was asked for
            if answer.status == 200 and (offset or length != self.size):
                raise ArchiveError(f"{self.path} gives no ranges")
            return answer.read(length + 1)

        return self._ask(urllib.request.Request(self.path, headers={"Range": f"bytes={offset}-{offset + length - 1}"}), take)

    def _ask(self, ask: urllib.request.Request, take: Callable[[http.client.HTTPResponse], T]) -> T:
        for attempt in range(self.ATTEMPTS):
            try:
                with urllib.request.urlopen(ask, timeout=60) as answer:
                    return take(answer)
            except urllib.error.HTTPError as e:
                if e.code not in (429, 503) or attempt == self.ATTEMPTS - 1:
                    raise
                time.sleep(self.WAIT * 2**attempt)
        raise ArchiveError(f"{self.path} was not read")

    def close(self) -> None:
        if self.file:
            self.file.close()

    def __enter__(self) -> RangeReader:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()


def with_next(entries: list[Entry]) -> Iterator[tuple[Entry, int]]:
    """Entries with the tile id at which the next one begins: a leaf holds nothing from there on."""
    return zip(entries, [*[e.tile_id for e in entries[1:]], 1 << 63], strict=False)


def open_archive(path: str, first: int = 0, last: int = (1 << 63) - 1) -> Archive:
    """Header, metadata and the directory: all of it, or the part in which the tile ids first to last lie. Leaves that
    hold none of them are not read. For directories that a process can hold; tables of tiles read leaves in tasks."""
    with RangeReader(path) as reader:
        header = decode_header(reader.read(0, HEADER_SIZE))
        kind = header["internal_compression"]
        found: list[Entry] = []

        def walk(offset: int, length: int, depth: int) -> None:
            if depth >= DEPTH:
                raise ArchiveError("directories are nested too deeply")
            here = decode_directory(decompress(reader.read(offset, length), kind))
            for e, after in with_next(here):
                if e.run:
                    if e.tile_id <= last and e.tile_id + e.run > first:
                        found.append(e)
                elif e.tile_id <= last and after > first:
                    walk(header["leaf_dirs_offset"] + e.offset, e.length, depth + 1)

        walk(header["root_dir_offset"], header["root_dir_bytes"], 0)
        metadata = {}
        if header["json_metadata_bytes"]:
            metadata = json.loads(decompress(reader.read(header["json_metadata_offset"], header["json_metadata_bytes"]), kind))
    return Archive(header, metadata, found)


def _last_from(entries: list[Entry], wanted: int) -> Entry | None:
    """The last entry that begins at a tile id or before it."""
    k = bisect.bisect_right(entries, wanted, key=lambda e: e.tile_id)
    return entries[k - 1] if k else None


def lookup(archive: Archive, z: int, x: int, y: int) -> Entry | None:
    """The entry that holds a tile, by binary search."""
    wanted = id_of(z, x, y)
    e = _last_from(archive.entries, wanted)
    return e if e and wanted < e.tile_id + e.run else None


def open_front(path: str) -> Archive:
    """Header, metadata and the root directory alone: tile entries and pointers to leaves (run 0)."""
    with RangeReader(path) as reader:
        return read_front(reader)


def read_front(reader: RangeReader) -> Archive:
    header = decode_header(reader.read(0, HEADER_SIZE))
    kind = header["internal_compression"]
    root = decode_directory(decompress(reader.read(header["root_dir_offset"], header["root_dir_bytes"]), kind))
    metadata = {}
    if header["json_metadata_bytes"]:
        metadata = json.loads(decompress(reader.read(header["json_metadata_offset"], header["json_metadata_bytes"]), kind))
    return Archive(header, metadata, root)


def find_tile(path: str, z: int, x: int, y: int) -> bytes | None:
    """The bytes of a tile as stored, or None. Reads the header, the root, the leaf in which the tile would be, and it."""
    wanted = id_of(z, x, y)
    with RangeReader(path) as reader:
        front = read_front(reader)
        here, header = front.entries, front.header
        for _ in range(DEPTH):
            e = _last_from(here, wanted)
            if e is None or e.run:
                return reader.read(header["tile_data_offset"] + e.offset, e.length) if e and wanted < e.tile_id + e.run else None
            here = decode_directory(decompress(reader.read(header["leaf_dirs_offset"] + e.offset, e.length), header["internal_compression"]))
    raise ArchiveError("directories are nested too deeply")


def front_of(header: dict[str, int], metadata: dict, entries: list[Entry]) -> bytes:
    """All bytes before the tile data."""
    kind = COMPRESSION["gzip"]
    root, leaves = split_directory(entries, kind)
    meta = compress(json.dumps(metadata).encode(), kind)
    at = HEADER_SIZE
    full = dict(header, root_dir_offset=at, root_dir_bytes=len(root), json_metadata_offset=at + len(root), json_metadata_bytes=len(meta), leaf_dirs_offset=at + len(root) + len(meta), leaf_dirs_bytes=len(leaves))
    full |= {"tile_data_offset": at + len(root) + len(meta) + len(leaves), "tile_data_bytes": max((e.offset + e.length for e in entries), default=0)}
    full |= {"addressed_tiles_count": sum(e.run for e in entries), "tile_entries_count": len(entries), "tile_contents_count": len({e.offset for e in entries}), "internal_compression": kind}
    return encode_header(full) + root + meta + leaves
