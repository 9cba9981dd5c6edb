"""Document fingerprints: one-permutation MinHash with optimal densification, packed to a few bits a bin.

Every shingle is hashed once. The upper bits of its hash name a bin, and a bin keeps the least hash that fell into it. A
bin that stays empty takes what another bin holds: every bin goes through all bins in an order of its own, the same for
all documents, and borrows from the first that is not empty, so that two documents that share a bin's order agree there
with the chance of their likeness. Of each bin the lowest `bits` bits are stored. Two unrelated hashes agree in those
with chance 2**-bits, which the likeness takes out again: (share of equal bins - 2**-bits) / (1 - 2**-bits).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_values, columns_of, materialise, mix, shingle_hashes, shuffle_partitions, slices, small_batches, words_only

_FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


class Sketcher:
    """Fingerprints of texts: bins is a power of two, bits is 1, 2, 4 or 8, width the number of words of a shingle."""

    _ORDERS: dict[int, np.ndarray] = {}

    def __init__(self, bins: int = 256, bits: int = 4, width: int = 5) -> None:
        if bins & (bins - 1) or not 8 <= bins <= 1 << 12 or bits not in (1, 2, 4, 8):
            raise ValueError("bins is a power of two from 8 to 4096, bits is 1, 2, 4 or 8")
        self.bins, self.bits, self.width = bins, bits, width
        self.shift = np.uint64(64 - bins.bit_length() + 1)
        self.starts = np.arange(bins, dtype=np.uint64) << self.shift
        self.words = words_only()

    @property
    def orders(self) -> np.ndarray:
        """orders[i, b]: bin i looks at the bins b from the least of these numbers on."""
        if self.bins not in self._ORDERS:
            self._ORDERS[self.bins] = mix(np.arange(1, self.bins * self.bins + 1, dtype=np.uint64)).reshape(self.bins, self.bins)
        return self._ORDERS[self.bins]

    def least(self, hashes: np.ndarray) -> np.ndarray:
        """The hash of each bin after densification; hashes holds at least one."""
        ordered = np.sort(hashes)
        at = np.minimum(np.searchsorted(ordered, self.starts), len(ordered) - 1)
        held = ordered[at]
        filled = (held >> self.shift) == np.arange(self.bins, dtype=np.uint64)
        if not filled.all():
            empty, lenders = np.flatnonzero(~filled), np.flatnonzero(filled)
            held[empty] = held[lenders[self.orders[np.ix_(empty, lenders)].argmin(axis=1)]]
        return held

    def shingles(self, text: bytes | None) -> np.ndarray:
        """Hashes of the shingles of a text, A-Z lower-cased; of all words at once if there are fewer than a shingle has."""
        words = (text or b"").translate(_FOLD).split()
        return shingle_hashes(self.words.of(words), min(self.width, len(words))) if words else np.zeros(0, np.uint64)

    def of(self, text: bytes | None) -> bytes:
        """The packed fingerprint; that of a text without words is empty."""
        hashes = self.shingles(text)
        if not len(hashes):
            return b""
        low = (self.least(hashes) & np.uint64((1 << self.bits) - 1)).astype(np.uint8)
        fields = low.reshape(-1, 8 // self.bits) << (np.arange(8 // self.bits, dtype=np.uint8)[::-1] * np.uint8(self.bits))
        return np.bitwise_or.reduce(fields, axis=1).astype(np.uint8).tobytes()


def _equal_fields(bits: int) -> np.ndarray:
    """How many fields of `bits` bits are zero in each byte."""
    fields = (np.arange(256)[:, None] >> np.arange(0, 8, bits)) & ((1 << bits) - 1)
    return (fields == 0).sum(axis=1)


def estimate(pairs: Iterable[tuple[bytes, bytes]], bits: int) -> list[float]:
    """Likeness of each pair of packed fingerprints, from 0 to 1. Two texts without words are equal."""
    zero, by_chance, out = _equal_fields(bits), 2.0**-bits, []
    for a, b in pairs:
        if a == b:
            out.append(1.0)
        elif not a or not b:
            out.append(0.0)
        else:
            same = zero[np.frombuffer(a, np.uint8) ^ np.frombuffer(b, np.uint8)].sum() / (len(a) * 8 // bits)
            out.append(max(0.0, float(same - by_chance) / (1 - by_chance)))
    return out


def likeness(a: Column, b: Column, bits: int = 4) -> Column:
    """Likeness of two fingerprints (hexadecimal text), corrected for chance; null where one of them is null."""

    @F.pandas_udf("double")
    def of(left: pd.Series, right: pd.Series) -> pd.Series:
        there = left.notna() & right.notna()
        found = estimate(((bytes.fromhex(x), bytes.fromhex(y)) for x, y in zip(left[there], right[there], strict=True)), bits)
        out = pd.Series(np.nan, index=left.index)
        out[there] = found
        return out.astype(object).where(there, None)

    return of(a, b)


def fingerprints(docs: DataFrame, bins: int = 256, bits: int = 4, width: int = 5, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_chars (code points), fingerprint (hexadecimal) for each row of docs, whole texts, without a shuffle.

    A null text counts as empty; texts without words have the empty fingerprint; equal texts have equal ones, so do those
    that differ in A-Z and a-z or in white space between words; repeated rows and null ids each give a row; an empty
    table gives an empty one; columns of docs other than the two named are not touched.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketcher = Sketcher(bins, bits, width)
        for batch in slices(batches):
            found = [sketcher.of(t).hex() for t in byte_values(batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.string())], names=["doc_id", "n_chars", "fingerprint"])

    key, value = columns_of([doc_id, text])
    thin = docs.select(key.cast("long").alias("doc_id"), F.coalesce(F.length(value), F.lit(0)).cast("long").alias("n_chars"), value.alias("text"))
    return thin.mapInArrow(run, "doc_id long, n_chars long, fingerprint string")


_DONE, _FIRST, _LAST = 0, 1, 2
_FOUND = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_TYPES = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
_NAMES = [c.split()[0] for c in _FOUND.split(", ")]


def _against_next(sketcher: Sketcher, own: int | None, text: str, sketch: bytes, after: str, after_sketch: bytes) -> tuple:
    """A row of the result: a text and its fingerprint against its edited text and against the text after it."""
    cut = len(text) // 3
    edited = (text[: len(text) - cut] + after[:cut]).encode()
    edited_sketch = sketcher.of(edited)
    near = estimate([(sketch, edited_sketch), (sketch, after_sketch)], sketcher.bits)
    return own, len(text), hashlib.sha256(edited).hexdigest(), sketch.hex(), edited_sketch.hex(), *near


def compare_edited(docs: DataFrame, bins: int = 256, bits: int = 4, width: int = 5, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for each row of docs.

    The edited text has the last third of the code points replaced by the first as many (or all) of the next row's text,
    by descending doc_id (nulls last; rows of one id by hash and text); after the last row comes the first. A single row
    is its own next one. Null texts count as empty; repeated rows stay rows; an empty table gives an empty one.

    Rows are sorted by range once, and a task sees each text and the one after it. What stands at the two ends of a task
    is written aside and put together afterwards: two rows a task.
    """
    small_batches(docs.sparkSession)
    spark = docs.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketcher, part = Sketcher(bins, bits, width), TaskContext.get().partitionId()
        before: tuple | None = None

        def rows(found: list[tuple], kind: int, texts: list[str | None]) -> pa.RecordBatch:
            arrays = [pa.array(list(c), t) for c, t in zip(zip(*found, strict=True), _TYPES, strict=True)] if found else [pa.array([], t) for t in _TYPES]
            return pa.RecordBatch.from_arrays([*arrays, pa.array([kind] * len(found), pa.int32()), pa.array([part] * len(found), pa.int32()), pa.array(texts, pa.string())], names=[*_NAMES, "kind", "part", "text"])

        for batch in slices(batches, 500):
            found = []
            for own, raw in zip(batch.column(0).to_pylist(), byte_values(batch.column(1)), strict=True):
                here = own, (raw or b"").decode(), sketcher.of(raw)
                if before:
                    found.append(_against_next(sketcher, *before, *here[1:]))
                else:
                    yield rows([(own, None, None, here[2].hex(), None, None, None)], _FIRST, [here[1]])
                before = here
            yield rows(found, _DONE, [None] * len(found))
        if before:
            yield rows([(before[0], None, None, before[2].hex(), None, None, None)], _LAST, [before[1]])

    key, value = columns_of([doc_id, text])
    thin = docs.select(key.cast("long").alias("doc_id"), value.alias("text"))
    # rows of one id are dealt by their texts, so that no id fills a task
    order = [F.desc_nulls_last("doc_id"), F.xxhash64("text")]
    ranged = thin.repartitionByRange(shuffle_partitions(spark), *order).sortWithinPartitions(*order, "text")
    table = materialise(ranged.mapInArrow(run, _FOUND + ", kind int, part int, text string"), "fingerprints")

    parts = sorted(r["part"] for r in table.where(F.col("kind") == _FIRST).select("part").collect())  # one number a task
    after = spark.createDataFrame(list(zip(parts, parts[1:] + parts[:1], strict=True)), "part int, after int")
    firsts = table.where(F.col("kind") == _FIRST).select(F.col("part").alias("after"), F.col("text").alias("after_text"), F.col("fingerprint").alias("after_fingerprint"))
    ends = table.where(F.col("kind") == _LAST).select("doc_id", "text", "fingerprint", "part").join(after, "part").join(firsts, "after")

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketcher = Sketcher(bins, bits, width)
        for batch in slices(batches, 500):
            found = [_against_next(sketcher, own, t, bytes.fromhex(f), a, bytes.fromhex(g)) for own, t, f, a, g in zip(*[c.to_pylist() for c in batch.columns], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in found], t) for k, t in enumerate(_TYPES)], names=_NAMES)

    closed = ends.select("doc_id", "text", "fingerprint", "after_text", "after_fingerprint").mapInArrow(close, _FOUND)
    return table.where(F.col("kind") == _DONE).select(*_NAMES).unionByName(closed)


def op11_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """256 bins of 4 bits over five-word shingles, 128 bytes a document."""
    return compare_edited(spark.read.parquet(f"{sf_dir}/documents.parquet"))
