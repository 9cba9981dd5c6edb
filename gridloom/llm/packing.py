"""Best-fit-decreasing packing of token sequences.

Best-fit decreasing looks at nothing but lengths, so it runs exactly on the histogram of lengths (at most `capacity`
entries, however many documents there are). Open bins of equal remaining capacity are kept as runs of bin numbers,
and a segment tree over remaining capacities finds the tightest one. The plan says for each run of ranks within a
length where those pieces lie; a piece then finds its place from its length and its rank alone.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import byte_values, materialise, slices, small_batches
from .tokens import Encoder, tokenizer_path


class CapacityTree:
    """Segment tree over capacities 0..most; tightest(c) is the least capacity >= c that is marked, or -1."""

    def __init__(self, most: int) -> None:
        self.size = 1 << max(1, most.bit_length())
        self.any = bytearray(2 * self.size)

    def mark(self, capacity: int, there: bool) -> None:
        k = capacity + self.size
        self.any[k] = there
        while k > 1:
            k >>= 1
            self.any[k] = self.any[2 * k] | self.any[2 * k + 1]

    def tightest(self, least: int) -> int:
        k, tree = least + self.size, self.any
        if tree[k]:
            return least
        while k > 1:
            if not k & 1 and tree[k + 1]:
                k += 1
                while k < self.size:
                    k = 2 * k if tree[2 * k] else 2 * k + 1
                return k - self.size
            k >>= 1
        return -1


def plan_bins(histogram: dict[int, int], capacity: int) -> tuple[np.ndarray, int]:
    """Rows (length, first rank, pieces, first bin, pieces a bin, offset in the bin) and the number of bins.

    Places pieces as best-fit decreasing does one by one: the tightest open bin takes pieces of a length until it has
    no room for another, since after each it is still the tightest one.
    """
    tree, runs, rows, bins = CapacityTree(capacity), {}, [], 0
    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            room = tree.tightest(length)
            if room < 0:
                room, each = capacity, capacity // length
                first, there = bins, max(1, left // each)
                bins += there
                runs.setdefault(room, []).append((first, there))
                tree.mark(room, True)
            first, there = runs[room].pop()
            each = room // length
            take = min(there, left // each) or 1
            each = min(each, left)
            if take < there:
                runs[room].append((first + take, there - take))
            if not runs[room]:
                tree.mark(room, False)
            rows.append((length, rank, take * each, first, each, capacity - room))
            rest = room - each * length
            if rest:
                runs.setdefault(rest, []).append((first, take))
                tree.mark(rest, True)
            rank, left = rank + take * each, left - take * each
    rows.sort()
    return np.array(rows, np.int64).reshape(-1, 6), bins


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut_pieces(docs: DataFrame, capacity: int = 4096, end_id: int = 1, tokenizer: str | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each piece of each document: the ids of its text, then end_id, cut every `capacity` ids."""
    small_batches(docs.sparkSession)
    path = tokenizer or tokenizer_path()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(path)
        for batch in slices(batches):
            first = 0
            for ids, ends in encoder.runs(byte_values(batch.column(1))):
                raw = memoryview(np.insert(ids, ends, end_id).astype("<u4", copy=False).tobytes())
                n = np.diff(ends, prepend=0) + 1
                pieces = -(-n // capacity)
                row = np.repeat(np.arange(len(n)), pieces)
                piece = np.arange(len(row)) - (np.cumsum(pieces) - pieces)[row]
                start = piece * capacity
                length = np.minimum(n[row] - start, capacity)
                at = 4 * ((np.cumsum(n) - n)[row] + start)
                sums = [zlib.crc32(raw[a:b]) for a, b in zip(at.tolist(), (at + 4 * length).tolist(), strict=True)]
                own = batch.column(0).take(pa.array(first + row))
                yield pa.RecordBatch.from_arrays([own, pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(sums, pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32"])
                first += len(n)

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(cut, PIECES)


def pack(docs: DataFrame, capacity: int = 4096, end_id: int = 1, tokenizer: str | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for each piece of each row of docs.

    A null or empty text is the end id alone. Equal rows, equal and null ids each give their own pieces; ties are
    broken by id and checksum, and rows equal in all of these are alike. An empty table gives an empty table.
    """
    pieces = materialise(cut_pieces(docs, capacity, end_id, tokenizer, doc_id, text), "pieces")
    counted = pieces.groupBy("length").count()
    histogram = {int(r["length"]): int(r["count"]) for r in counted.collect()}  # at most `capacity` rows
    plan, _ = plan_bins(histogram, capacity)
    total = sum(histogram.values())
    salts = int(min(65536, max(1024, total // 100_000)))
    # rank within a length: ranks within (length, salt), then what lies before that salt
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)).cast("int"))
    before = salted.groupBy("length", "salt").count().select("length", "salt", (F.sum("count").over(Window.partitionBy("length").orderBy("salt")) - F.col("count")).alias("before"))
    order = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32", "start")
    ranked = salted.withColumn("nth", F.row_number().over(order)).join(before.hint("merge"), ["length", "salt"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("nth") - 1).alias("rank"))
    keys = (plan[:, 0] << 48) | plan[:, 1]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            length, rank = batch.column(3).to_numpy(zero_copy_only=False), batch.column(5).to_numpy(zero_copy_only=False)
            row = plan[np.searchsorted(keys, (length << 48) | rank, side="right") - 1] if len(rank) else plan[:0]
            nth = rank - row[:, 1]
            sequence, offset = row[:, 3] + nth // np.maximum(row[:, 4], 1), row[:, 5] + nth % np.maximum(row[:, 4], 1) * length
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(place, PIECES + ", sequence_id long, offset long")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
