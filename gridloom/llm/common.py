"""What the operators of this package share: scratch tables, byte columns, word hashing."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

#: Runs of these six bytes separate words: [\x20\x09-\x0D]. bytes.split() splits on the same set.
SPACE_CLASS = r"[\x20\x09-\x0D]"
SPACES = " \t\n\x0b\x0c\r"


def scratch_base(spark: SparkSession) -> str:
    """The shared folder of this session; a folder of our own only where none is set, as in tests."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.conf.get("spark.gridloom.scratch", None)
        if not base:
            base = "file://" + tempfile.mkdtemp(prefix="gridloom-")
            spark.conf.set("spark.gridloom.scratch", base)
    return base.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_base(spark)}/gridloom/{name}-{uuid.uuid4().hex}"


def columns_of(names: Iterable[str]) -> list[Column]:
    """Top-level columns by their names, whatever characters those hold."""
    return [F.col("`" + n.replace("`", "``") + "`") for n in names]


def map_columns(rows: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[list[pa.Array]]], schema: StructType) -> DataFrame:
    """mapInArrow for columns of any names: run gets batches and yields arrays by place, in the order of schema."""
    plain = StructType([StructField(f"c{k}", f.dataType, f.nullable) for k, f in enumerate(schema.fields)])

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for arrays in run(batches):
            yield pa.RecordBatch.from_arrays(arrays, names=plain.names)

    return rows.toDF(*[f"c{k}" for k in range(len(rows.columns))]).mapInArrow(named, plain).toDF(*schema.names)


def unused(taken: Iterable[str], *wanted: str) -> list[str]:
    """The wanted names, with strokes added until no column is called so (in whatever case)."""
    known, out = {n.lower() for n in taken}, []
    for name in wanted:
        while name.lower() in known:
            name += "_"
        known.add(name.lower())
        out.append(name)
    return out


def small_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Arrow batches of documents hold so many rows at most, in this session from now on: the default of 10,000 is
    meant for narrow rows, and takes tens of MB a task on both sides of the socket for texts. Results are lazy and the
    setting is read when they run, so it cannot be put back here."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= rows:
        spark.conf.set(key, rows)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back: cuts the lineage, survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table._scratch = path
    return table


def discard(*tables: DataFrame) -> None:
    """Deletes tables of materialise() that nothing reads any more."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table._scratch)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def byte_values(column: pa.Array | pa.ChunkedArray) -> list[bytes | None]:
    """UTF-8 bytes of each string of an Arrow column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.cast(column, pa.large_binary()).to_pylist()


def slices(batches: Iterator[pa.RecordBatch], rows: int = 2000) -> Iterator[pa.RecordBatch]:
    """Batches in parts of so many rows (one part of an empty one): what is made from a part is small against the batch."""
    for batch in batches:
        for k in range(0, max(1, batch.num_rows), rows):
            yield batch.slice(k, rows)


def split_chunks(texts: list[bytes | None], lower: bool = False, most: int = 1_500_000) -> Iterator[tuple[int, list[list[bytes]]]]:
    """(number of the first text, words of each text) for runs of texts of about `most` bytes: the words of a whole
    batch at once would take many times its own size."""
    start = total = 0
    for k, text in enumerate(texts):
        total += len(text or b"")
        if total >= most or k == len(texts) - 1:
            part = [t or b"" for t in texts[start : k + 1]]
            yield start, [(t.lower() if lower else t).split() for t in part]
            start, total = k + 1, 0


def row_key(*columns: str) -> Column:
    """A 64-bit key of a row's content, independent of where the row lies; equal rows have equal keys."""
    return F.xxhash64(*[F.col(c) for c in columns])


class WordHashes(dict):
    """word bytes -> its 64-bit hash as 8 little-endian bytes; forgets everything at a bound on its size."""

    def __init__(self, most: int = 150_000) -> None:
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= self.most:
            self.clear()
        value = xxhash.xxh3_64_intdigest(word).to_bytes(8, "little")
        self[word] = value
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.__getitem__, words)), "<u8")


#: Of all word hashes in a worker.
WORDS = WordHashes()

_HELD: dict[str, Callable[[], object]] = {}


def hold_only(name: str, drop: Callable[[], object]) -> None:
    """Workers serve one operator after another; the caches of earlier ones go when another begins."""
    others = [n for n in _HELD if n != name]
    for n in others:
        _HELD.pop(n)()
    if others:
        gc.collect()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # not every C library can
            ctypes.CDLL(None).malloc_trim(0)
    _HELD[name] = drop


def words_only() -> WordHashes:
    hold_only("words", WORDS.clear)
    return WORDS


_MUL = np.uint64(0x9E3779B97F4A7C15)
_MUL2 = np.uint64(0xC2B2AE3D27D4EB4F)


def mix(values: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    v = values ^ (values >> np.uint64(33))
    v = v * _MUL
    v = v ^ (v >> np.uint64(29))
    v = v * _MUL2
    return v ^ (v >> np.uint64(32))


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """64-bit hashes of every run of `width` words, in order; no run, no hash. Runs are hashed by halves."""
    if len(words) < width:
        return np.zeros(0, np.uint64)
    h, reach = mix(words), 1
    while reach < width:
        step = min(reach, width - reach)
        h = mix(h[:-step] * _MUL2 + h[step:])
        reach += step
    return h


def sliding_least(values: np.ndarray, span: int) -> np.ndarray:
    """Where the least of each `span` neighbouring values is (by its upper 40 bits, then the leftmost)."""
    if len(values) >= 1 << 24:
        return np.arange(len(values) - span + 1) + np.lib.stride_tricks.sliding_window_view(values >> np.uint64(24), span).argmin(axis=1)
    low = np.uint64((1 << 24) - 1)
    m, reach = (values & ~low) | np.arange(len(values), dtype=np.uint64), 1
    while reach < span:
        step = min(reach, span - reach)
        m = np.minimum(m[:-step], m[step:])
        reach += step
    return (m & low).astype(np.int64)
