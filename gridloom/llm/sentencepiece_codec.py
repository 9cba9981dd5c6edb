"""SentencePiece encoding and decoding by a streaming Viterbi search.

The search keeps a window bounded by the longest piece: at each end position one best last piece and its backpointer.
Ids are committed when all backpointer paths from the window have met in one boundary. For a unigram model the best
last piece maximises the sum of scores. For a byte-pair model the library merges pairs by rank, which is no sum of
scores; there a last piece survives if it and the piece before it come out of merging the two alone as these same
two pieces, and exactly one does at each position, so the same search gives the library's ids.

No piece holds certain pairs of characters (a letter and a blank after it, say); all paths meet between those, so
text is cut there, and stretches seen before in a worker are not searched again.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import byte_values, columns_of, hold_only, map_columns, slices, small_batches
from .tokens import tokenizer_path

NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
_BLANK = "▁"


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of a protobuf message."""
    at, n = 0, len(data)

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < n:
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(kind)
            size = varint() if size is None else size
            yield key >> 3, data[at : at + size]
            at += size


class Model:
    """Pieces of a .model file, and the search over them."""

    def __init__(self, path: str, most: int = 800_000) -> None:
        with open(path, "rb") as f:
            top = list(_fields(f.read()))
        self.pieces: list[tuple[str, float, int]] = []
        for number, value in top:
            if number == 1:
                own = dict(_fields(value))
                self.pieces.append((own[1].decode(), struct.unpack("<f", own[2])[0] if 2 in own else 0.0, own.get(3, NORMAL)))
        trainer = dict(_fields(next((v for k, v in top if k == 2), b"")))
        norm = dict(_fields(next((v for k, v in top if k == 3), b"")))
        self.bpe = trainer.get(3, 1) == 2
        self.prefix, self.squeeze, self.charsmap = norm.get(3, 1), norm.get(4, 1), norm.get(2, b"")
        self.path, self.library = path, None
        self.vocab = {p: i for i, (p, _, kind) in enumerate(self.pieces) if kind in (NORMAL, USER)}
        if any(kind == USER and p.strip(_BLANK) for p, _, kind in self.pieces) or any(kind == UNUSED for *_, kind in self.pieces):
            raise ValueError("models with user-defined or unused pieces are not supported")
        self.score = [s for _, s, _ in self.pieces]
        self.bytes_of = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(self.pieces) if kind == BYTE}
        self.unknown = next((i for i, (*_, kind) in enumerate(self.pieces) if kind == UNKNOWN), 0)
        self.longest = max(map(len, self.vocab))
        #: whatever a piece can end with
        self.tails = {p[k:] for p in self.vocab for k in range(len(p))}
        self.least = min((self.score[i] for i in self.vocab.values()), default=0.0) - 10.0
        self.adjacent = {p[k : k + 2] for p in self.vocab for k in range(len(p) - 1)}
        self.blanks_begin = not any(len(p) > 1 and p[1] == _BLANK and p[0] != _BLANK for p in self.adjacent)
        self.alone: dict[str, bool] = {}
        self.fits: dict[tuple[str, str], bool] = {}
        self.known: dict[str, bytes] = {}
        self.most = most
        self.text_of = [self._bytes(p, kind) for p, _, kind in self.pieces]

    @staticmethod
    def _bytes(piece: str, kind: int) -> bytes:
        if kind == BYTE:
            return bytes([int(piece[3:5], 16)])
        if kind == UNKNOWN:
            return " ⁇ ".encode()
        return b"" if kind == CONTROL else piece.replace(_BLANK, " ").encode()

    def merged(self, text: str) -> list[str]:
        """Pieces of a short text by merging neighbours, best score first, then leftmost."""
        parts = list(text)
        while True:
            best, at = None, -1
            for k in range(len(parts) - 1):
                i = self.vocab.get(parts[k] + parts[k + 1])
                if i is not None and (best is None or self.score[i] > best):
                    best, at = self.score[i], k
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def _whole(self, piece: str) -> bool:
        if piece not in self.alone:
            self.alone[piece] = self.merged(piece) == [piece]
        return self.alone[piece]

    def _fit(self, a: str, b: str) -> bool:
        found = self.fits.get((a, b))
        if found is None:
            if len(self.fits) > self.most:
                self.fits.clear()
            found = self.fits[a, b] = self.merged(a + b) == [a, b]
        return found

    def search(self, text: str) -> Iterator[list[str]]:
        """Pieces of text, in committed runs; holds a window of about twice the longest piece."""
        vocab, longest, tails = self.vocab, self.longest, self.tails
        base, last, best = 0, [""], [0.0]  # base: committed up to here; last[k]: the last piece of text[:base + k]
        before = ""  # the piece that ends at base
        n = len(text)
        for i in range(1, n + 1):
            choice, value = None, 0.0
            ends_here, length, most = [], 1, i - base
            while length <= most:
                piece = text[i - length : i]
                if piece not in tails:
                    break
                if piece in vocab:
                    ends_here.append(piece)
                length += 1
            if not ends_here or len(ends_here[0]) > 1:
                ends_here.insert(0, text[i - 1])  # an unknown character stands alone
            for piece in reversed(ends_here):
                at = i - len(piece) - base
                if self.bpe:
                    ahead = last[at] if at else before
                    if len(piece) == 1 and piece not in vocab or self._whole(piece) and (not ahead or self._fit(ahead, piece)):
                        choice = piece
                        break
                else:
                    total = best[at] + (self.score[vocab[piece]] if piece in vocab else self.least)
                    if choice is None or total > value:
                        choice, value = piece, total
            last.append(choice if choice is not None else text[i - 1])
            best.append(value)
            if i - base >= 2 * longest or i == n:
                # where the paths of all positions that a later piece can start from meet
                ends = {i} if i == n else set(range(i - longest + 1, i + 1))
                while len(ends) > 1:
                    top = max(ends)
                    ends.discard(top)
                    ends.add(max(base, top - len(last[top - base])))
                meet = ends.pop()
                if meet > base:
                    run, k = [], meet
                    while k > base:
                        run.append(last[k - base])
                        k -= len(last[k - base])
                    before = run[0]
                    last, best, base = last[meet - base :], best[meet - base :], meet
                    yield run[::-1]

    def _ids_of(self, piece: str) -> list[int]:
        if piece in self.vocab:
            return [self.vocab[piece]]
        if self.bytes_of:
            return [self.bytes_of[b] for b in piece.encode()]
        return [self.unknown]

    def _stretch(self, text: str) -> bytes:
        """Ids of a stretch between cuts, as little-endian 32-bit bytes."""
        out, start = b"", 0
        for k in range(1, len(text) + 1):
            if k == len(text) or text[k - 1 : k + 1] not in self.adjacent:
                part = text[start:k]
                ids = self.known.get(part)
                if ids is None:
                    found = [i for run in self.search(part) for piece in run for i in self._ids_of(piece)]
                    ids = struct.pack(f"<{len(found)}I", *found)
                    if len(part) <= 64:
                        self.known[part] = ids
                out += ids
                start = k
        return out

    def normalise(self, text: str) -> str:
        if self.charsmap:
            if self.library is None:
                import sentencepiece

                self.library = sentencepiece.SentencePieceProcessor(model_file=self.path)
            return self.library.normalize(text)
        if self.squeeze:
            text = re.sub(" +", " ", text.strip(" "))
        return ((" " if self.prefix else "") + text).replace(" ", _BLANK) if text else ""

    def encode(self, text: str | None) -> bytes:
        """Ids as the library gives them, without begin and end, as little-endian 32-bit bytes."""
        if not text:
            return b""
        ids = self._ids_of_text(self.normalise(text))
        if self.bytes_of:
            return ids
        found = memoryview(ids).cast("I").tolist()
        # a run of unknown characters is one unknown piece
        found = [i for k, i in enumerate(found) if i != self.unknown or not k or found[k - 1] != self.unknown]
        return struct.pack(f"<{len(found)}I", *found)

    def _ids_of_text(self, text: str) -> bytes:
        if not self.blanks_begin:
            return self._stretch(text)
        if len(self.known) > self.most:
            self.known.clear()
        known, out = self.known, []
        parts = text.split(_BLANK)
        if "" in parts[1:]:
            parts = re.findall(f"{_BLANK}+[^{_BLANK}]*|[^{_BLANK}]+", text)
        else:
            parts = [*parts[:1], *[_BLANK + p for p in parts[1:]]] if parts[0] else [_BLANK + p for p in parts[1:]]
        for part in parts:
            ids = known.get(part)
            if ids is None:
                ids = self._stretch(part)
                if len(part) <= 64:
                    known[part] = ids
            out.append(ids)
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        """The text of ids; a blank that the encoder put in front is taken off."""
        raw = b"".join(map(self.text_of.__getitem__, memoryview(ids).cast("I")))
        text = raw.decode(errors="replace")
        return text[1:] if self.prefix and text[:1] == " " else text


_MODELS: dict[str, Model] = {}


def model_of(path: str) -> Model:
    hold_only("pieces", _MODELS.clear)
    if path not in _MODELS:
        _MODELS[path] = Model(path)
    return _MODELS[path]


def encode(docs: DataFrame, model: str | None = None, text: str = "text", into: str = "ids") -> DataFrame:
    """docs with the column `into`: the ids (array<int>) of each text. Null and empty texts have no ids, equal rows give
    a row each, an empty table gives an empty table. A column of docs that is called `into` is replaced."""
    path = model or tokenizer_path("piece_bpe_32k.model")
    at, names = docs.columns.index(text), [c for c in docs.columns if c != into]
    places = [docs.columns.index(c) for c in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.Array]]:
        found = model_of(path)
        for batch in slices(batches):
            ids = [memoryview(found.encode(t)).cast("I").tolist() for t in batch.column(at).to_pylist()]
            yield [*[batch.column(k) for k in places], pa.array(ids, pa.list_(pa.int32()))]

    return map_columns(docs, run, docs.select(*columns_of(names)).schema.add(into, T.ArrayType(T.IntegerType())))


def decode(rows: DataFrame, model: str | None = None, ids: str = "ids", into: str = "text") -> DataFrame:
    """rows with the column `into`: the text of each array of ids. Null arrays give null, empty ones an empty text,
    equal rows a row each, an empty table an empty table. A column of rows that is called `into` is replaced."""
    path = model or tokenizer_path("piece_bpe_32k.model")
    at, names = rows.columns.index(ids), [c for c in rows.columns if c != into]
    places = [rows.columns.index(c) for c in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.Array]]:
        found = model_of(path)
        for batch in slices(batches):
            texts = [None if x is None else found.decode(struct.pack(f"<{len(x)}I", *x)) for x in batch.column(at).to_pylist()]
            yield [*[batch.column(k) for k in places], pa.array(texts, pa.string())]

    return map_columns(rows, run, rows.select(*columns_of(names)).schema.add(into, "string"))


def digest_ids(docs: DataFrame, model: str | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_ids, ids_crc32, round_trip (decoding the ids gives the text back) for each row of docs.

    Null texts count as empty: no ids, checksum 0, round_trip true. Equal rows and null ids give a row each; an empty
    table gives an empty table. Texts longer than a batch's share are encoded whole.
    """
    path = model or tokenizer_path("piece_bpe_32k.model")
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = model_of(path)
        for batch in slices(batches):
            n, crc, same = [], [], []
            for raw in byte_values(batch.column(1)):
                value = (raw or b"").decode()
                ids = found.encode(value)
                n.append(len(ids) // 4)
                crc.append(zlib.crc32(ids))
                same.append(found.decode(ids) == value)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(crc, pa.int64()), pa.array(same, pa.bool_())], names=["doc_id", "n_ids", "ids_crc32", "round_trip"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, n_ids long, ids_crc32 long, round_trip boolean")


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest_ids(spark.read.parquet(f"{sf_dir}/documents.parquet"))
