"""Substring dedup: words inside windows of `width` words whose word sequence starts more than once in the corpus.

1. Each window has a minimizer: the least hash among its word n-grams, a matter of its content alone, so all copies of
   a window share it. A minimizer seen once in the corpus proves its windows unique; the rest are candidates.
2. The windows of one minimizer occurrence form a segment (under 2 * width words). Segments go to the shard of their
   minimizer, equal ones of a batch as one, so all copies of a window meet in one shard. No other text is moved.
3. Each shard builds an FM-index over its distinct segments, each with the number of its copies, and streams all of
   them through it: backward search from a segment's end gives the longest stretches that occur twice, and windows
   inside them are repeated. Copies within a batch are repeated by themselves; one of them goes to the shard for all.
   Windows of minimizers with very many occurrences (they could fill a shard) are instead dealt out and counted by a
   128-bit digest of the window.
"""

from __future__ import annotations

import hashlib
import pickle
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_values, columns_of, map_columns, materialise, row_key, shingle_hashes, shuffle_partitions, slices, sliding_least, small_batches, split_chunks, unused, words_only
from .fm_index import FMIndex, repeated_windows

_OCCURRENCE = np.dtype([("key", "<u8"), ("row", "<i8")])
_MARK = np.dtype([("at", "<u4"), ("mask", "<u8")])
GRAM = 8
#: Segments that are searched for at a time.
STREAM = 50_000
#: Occurrences of minimizers that meet in a task, about.
BUCKET_BYTES = 32_000_000
_WORD = re.compile(rb"[^\x20\x09-\x0D]+\s*")


def minimizers(words: np.ndarray, lengths: np.ndarray, width: int, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each run of windows with one minimizer in texts that lie one after the other: the minimizer's hash, the
    text's number, the run's first window in that text, and its number of windows."""
    grams = shingle_hashes(words, gram)
    span = width - gram + 1
    if len(grams) < span:
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none, none
    starts = np.cumsum(lengths) - lengths
    own = np.repeat(np.arange(len(lengths)), lengths)
    inside = np.arange(len(words)) - starts[own] <= lengths[own] - width  # windows that end in their own text
    at = np.flatnonzero(inside)
    least = sliding_least(grams, span)[at]
    if not len(at):
        return np.zeros(0, np.uint64), at, at, at
    first = np.flatnonzero(np.concatenate([[True], (least[1:] != least[:-1]) | (own[at[1:]] != own[at[:-1]])]))
    return grams[least[first]], own[at[first]], at[first] - starts[own[at[first]]], np.diff(np.append(first, len(at)))


def _split(text: bytes | None) -> list[bytes]:
    return text.split() if text else []


def _packed(key: np.ndarray, rows: np.ndarray) -> Iterator[tuple[int, bytes]]:
    order = np.argsort(key, kind="stable")
    key, rows = key[order], rows[order]
    cuts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]])) if len(key) else []
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        yield int(key[a]), rows[a:b].tobytes()


def _occurrences(base: DataFrame, width: int, buckets: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            parts = []
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for start, texts in split_chunks(byte_values(batch.column(1))):
                words = words_only().of([w for t in texts for w in t])
                keys, own, _, _ = minimizers(words, np.array([len(t) for t in texts]), width)
                part = np.empty(len(keys), _OCCURRENCE)
                part["key"], part["row"] = keys, ids[start + own]
                parts.append(part)
            if parts:
                rows = np.concatenate(parts)
                out = list(_packed(rows["key"] % np.uint64(buckets), rows))
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.int32()), pa.array([p for _, p in out], pa.binary())], names=["bucket", "payload"])

    return base.select("row", "text").mapInArrow(run, "bucket int, payload binary")


def _repeated_keys(occurrences: DataFrame, hot_from: int) -> DataFrame:
    """row, keys, hot, n: for each row the minimizers it shares with another occurrence (packed), and which of those are hot."""

    def run(table: pa.Table) -> pa.Table:
        rows = np.concatenate([np.frombuffer(p, _OCCURRENCE) for p in table.column("payload").to_pylist()])
        rows = rows[np.argsort(rows["key"], kind="stable")]
        _, inverse, count = np.unique(rows["key"], return_inverse=True, return_counts=True)
        count = count[inverse]
        rows, count = rows[count >= 2], count[count >= 2]
        order = np.lexsort((rows["key"], rows["row"]))
        rows, hot = rows[order], (count > hot_from)[order]
        cuts = np.flatnonzero(np.concatenate([[True], rows["row"][1:] != rows["row"][:-1], [True]])) if len(rows) else np.zeros(1, int)
        names, keys, heats = rows["row"][cuts[:-1]], [], []
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            keys.append(rows["key"][a:b].tobytes())
            heats.append(hot[a:b].tobytes())
        return pa.table({"row": pa.array(names, pa.int64()), "keys": pa.array(keys, pa.binary()), "hot": pa.array(heats, pa.binary()), "n": pa.array(np.diff(cuts), pa.int64())})

    return occurrences.groupBy("bucket").applyInArrow(run, "row long, keys binary, hot binary, n long")


def _marks(found: dict[int, list[tuple[int, int]]]) -> tuple[list[int], list[bytes]]:
    return list(found), [np.array(v, _MARK).tobytes() for v in found.values()]


_STEP = "kind int, doc_id long, row long, text string, n_words long, kept_sha256 string, bucket int, payload binary"


def _segments(joined: DataFrame, width: int, shards: int, buckets: int, results: bool) -> DataFrame:
    """kind 0: results of rows without candidates; 1: rows with candidates; 2: segments for a shard; 3: window digests
    for a bucket; 4: marks already certain, as a segment or window occurs twice in a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1)
        for batch in slices(batches, 4000):
            rows: list[tuple] = []
            segments: dict[bytes, list] = {}
            windows: dict[bytes, list] = {}
            certain: dict[int, list[tuple[int, int]]] = defaultdict(list)
            own, ids, lists, heats = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist(), batch.column(4).to_pylist()
            texts = batch.column(2)
            for k, text in enumerate(byte_values(texts)):
                words = _split(text)
                if not lists[k]:
                    if not results:
                        continue
                    rows.append((0, own[k], None, None, len(words), hashlib.sha256(b" ".join(words)).hexdigest(), None, None))
                    continue
                if results:
                    rows.append((1, own[k], ids[k], texts[k].as_py(), len(words), None, None, None))
                wanted, heat = np.frombuffer(b"".join(lists[k]), "<u8"), np.frombuffer(b"".join(heats[k]), bool)
                order = np.argsort(wanted)
                wanted, heat = wanted[order], heat[order]
                keys, _, firsts, counts = minimizers(words_only().of(words), np.array([len(words)]), width)
                at = np.minimum(np.searchsorted(wanted, keys), len(wanted) - 1)
                for i in np.flatnonzero(wanted[at] == keys).tolist():
                    first, count = int(firsts[i]), int(counts[i])
                    if heat[at[i]]:
                        for p in range(first, first + count):
                            digest = xxhash.xxh3_128_digest(b" ".join(words[p : p + width]))
                            windows.setdefault(digest, []).append((ids[k], p))
                    else:
                        for p in range(first, first + count, 56):  # one mask holds so many
                            more = min(56, first + count - p)
                            body = b" ".join(words[p : p + more - 1 + width])
                            segments.setdefault(xxhash.xxh3_128_digest(body), [int(keys[i]), more, body]).append((ids[k], p))
            # what occurs twice in this batch is repeated; one of its places stands for all of them from here on
            to_shard: dict[int, list] = defaultdict(list)
            for digest, (key, count, body, *places) in segments.items():
                if len(places) > 1:
                    for row, p in places:
                        certain[row].append((p, (1 << count) - 1))
                to_shard[key % shards].append((digest, count, body, len(places), *places[0]))
            for shard, entries in to_shard.items():
                rows.append((2, None, None, None, None, None, shard, pack.compress(pickle.dumps(entries))))
            to_bucket: dict[int, list] = defaultdict(list)
            for digest, places in windows.items():
                if len(places) > 1:
                    for row, p in places:
                        certain[row].append((p, 1))
                to_bucket[int.from_bytes(digest[:8], "little") % buckets].append((digest, len(places), *places[0]))
            for bucket, entries in to_bucket.items():
                rows.append((3, None, None, None, None, None, bucket, pickle.dumps(entries)))
            for row, payload in zip(*_marks(certain), strict=True):
                rows.append((4, None, row, None, None, None, None, payload))
            types = (pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int32(), pa.binary())
            columns = zip(*rows, strict=True) if rows else [[]] * 8
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[c.split()[0] for c in _STEP.split(", ")])

    return joined.select("doc_id", "row", "text", "keys", "hot").mapInArrow(run, _STEP)


def _search(parts: DataFrame, width: int) -> DataFrame:
    """row, payload: marks of repeated windows from the FM-index of each shard."""

    def run(table: pa.Table) -> pa.Table:
        unpack = zstandard.ZstdDecompressor()
        bodies: dict[bytes, list] = {}
        for payload in table.column("payload").to_pylist():
            for digest, count, body, times, row, p in pickle.loads(unpack.decompress(payload)):
                seen = bodies.setdefault(digest, [count, body, 0])
                seen[2] += times
                seen.append((row, p, times))
        words = [b.split() for _, b, *_ in bodies.values()]
        lengths = np.array([len(w) for w in words])
        hashes = words_only().of([x for w in words for x in w])
        starts = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]])
        text = np.zeros(int((lengths + 1).sum()), np.int32)
        text[np.arange(len(hashes)) + np.repeat(np.arange(len(words)), lengths)] = np.unique(hashes, return_inverse=True)[1] + 1
        del words, hashes
        counts = np.array([c for c, *_ in bodies.values()])
        times = np.array([t for _, _, t, *_ in bodies.values()])
        index = FMIndex(text, int(lengths.max()) + 2, np.repeat(times, lengths + 1))
        masks = np.zeros(len(counts), np.uint64)
        for k in range(0, len(counts), STREAM):
            part = slice(k, k + STREAM)
            masks[part] = repeated_windows(index, text, starts[part], counts[part], width)
        found: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for mask, (_, _, _, *places) in zip(masks.tolist(), bodies.values(), strict=True):
            if mask:
                for row, p, n in places:
                    if n == 1:
                        found[row].append((p, mask))
        rows, payloads = _marks(found)
        return pa.table({"row": pa.array(rows, pa.int64()), "payload": pa.array(payloads, pa.binary())})

    return parts.groupBy("bucket").applyInArrow(run, "row long, payload binary")


def _count_windows(parts: DataFrame) -> DataFrame:
    """row, payload: marks of the hot minimizers' windows that occur twice or more."""

    def run(table: pa.Table) -> pa.Table:
        seen: dict[bytes, list] = {}
        for payload in table.column("payload").to_pylist():
            for digest, times, row, p in pickle.loads(payload):
                entry = seen.setdefault(digest, [0])
                entry[0] += times
                if times == 1:
                    entry.append((row, p))
        found: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for times, *places in seen.values():
            if times > 1:
                for row, p in places:
                    found[row].append((p, 1))
        rows, payloads = _marks(found)
        return pa.table({"row": pa.array(rows, pa.int64()), "payload": pa.array(payloads, pa.binary())})

    return parts.groupBy("bucket").applyInArrow(run, "row long, payload binary")


def covered(n_words: int, marks: list[bytes], width: int) -> np.ndarray:
    """Which words lie in a marked window."""
    change = np.zeros(n_words + 1, np.int64)
    for at, mask in np.frombuffer(b"".join(marks), _MARK).tolist():
        i = 0
        while mask:
            skip = (mask & -mask).bit_length() - 1
            mask >>= skip
            i += skip
            run = (~mask & (mask + 1)).bit_length() - 1
            change[at + i] += 1
            change[at + i + run - 1 + width] -= 1
            mask >>= run
            i += run
    return np.cumsum(change[:n_words]) > 0


def _find(base: DataFrame, width: int, hot_from: int, results: bool) -> tuple[DataFrame, DataFrame]:
    """(_segments' table, the marks of each row that has some: row, marks); base: doc_id, text, row."""
    small_batches(base.sparkSession)
    # an occurrence of a minimizer takes 16 bytes and comes about every (width - GRAM) / 2 words
    letters = base.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(2 * shuffle_partitions(base.sparkSession), int(letters / 6 * 32 / (width - GRAM + 2) / BUCKET_BYTES) + 1)
    keys = materialise(_repeated_keys(_occurrences(base, width, buckets), hot_from), "repeated-keys")
    shards = int(max(buckets, (keys.agg(F.sum("n")).first()[0] or 0) * 1.5 * width // 1_600_000))
    by_row = keys.groupBy("row").agg(F.collect_list("keys").alias("keys"), F.collect_list("hot").alias("hot"))
    joined = base.join(by_row.hint("shuffle_hash"), "row", "left" if results else "inner")
    step = materialise(_segments(joined, width, shards, buckets, results), "segments")
    marks = _search(step.where("kind = 2").select("bucket", "payload"), width)
    marks = marks.unionByName(_count_windows(step.where("kind = 3").select("bucket", "payload"))).unionByName(step.where("kind = 4").select("row", "payload"))
    return step, materialise(marks, "marks").groupBy("row").agg(F.collect_list("payload").alias("marks"))


def dedup(docs: DataFrame, width: int = 50, doc_id: str = "doc_id", text: str = "text", hot_from: int = 20_000) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for each row of docs.

    A word goes if a window of `width` words around it starts anywhere else too, in the same document or another;
    windows are judged on the input. kept_sha256 is of the kept words joined by one space. Null and empty texts have
    no words (digest of nothing). Equal rows repeat each other, so both lose all words of repeated windows. Rows with
    null or equal ids give rows of their own. An empty table gives an empty table. Words are compared by 64-bit
    hashes in the index and rows told apart by a 64-bit hash of id and text.
    """
    base = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).withColumn("row", row_key("doc_id", "text"))
    step, marks = _find(base, width, hot_from, True)
    none = step.where("kind = 0").select("doc_id", "n_words", "kept_sha256")
    some = step.where("kind = 1").select("doc_id", "row", "text", "n_words").join(marks.hint("shuffle_hash"), "row", "left").select("doc_id", "text", "n_words", "marks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            gone, digests = [], []
            for text, marks in zip(byte_values(batch.column(1)), batch.column(3).to_pylist(), strict=True):
                words = _split(text)
                out = covered(len(words), marks or [], width)
                gone.append(int(out.sum()))
                digests.append(hashlib.sha256(b" ".join([w for w, o in zip(words, out.tolist(), strict=True) if not o])).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(gone, pa.int64()), pa.array(digests, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    cut = some.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")
    return none.select("doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), "kept_sha256").unionByName(cut)


def cut(text: bytes, out: np.ndarray) -> bytes:
    """text without the words marked in `out` and the white space after each; all else stays as it is."""
    kept, at = [], 0
    for gone, word in zip(out.tolist(), _WORD.finditer(text), strict=True):
        if gone:
            kept.append(text[at : word.start()])
            at = word.end()
    kept.append(text[at:])
    return b"".join(kept)


def cut_repeats(docs: DataFrame, width: int = 50, doc_id: str = "doc_id", text: str = "text", hot_from: int = 20_000) -> DataFrame:
    """docs with repeated words (as dedup() finds them) cut out of the text column, each with the white space after it; all
    rows and columns stay. Equal rows repeat each other, so both lose all words of repeated windows; no copy is preferred,
    so there are no ties. Null and empty texts stay as they are, a text may become empty, an empty table gives an empty one."""
    base = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).withColumn("row", row_key("doc_id", "text"))
    _, found = _find(base, width, hot_from, False)
    row, marked, marks = unused(docs.columns, "row", "marked", "marks")
    key, value = columns_of([doc_id, text])
    rows = docs.withColumn(row, F.xxhash64(key.cast("long"), value))
    found = materialise(found, "row-marks").toDF(marked, marks)
    both = rows.join(found.hint("shuffle_hash"), F.col(row) == F.col(marked), "left").select(*columns_of(docs.columns), marks)
    at, n = docs.columns.index(text), len(docs.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.Array]]:
        for batch in slices(batches):
            texts = []
            for value, marks in zip(byte_values(batch.column(at)), batch.column(n).to_pylist(), strict=True):
                if marks and value:
                    value = cut(value, covered(len(value.split()), marks, width))
                texts.append(None if value is None else value.decode())
            columns = list(batch.columns[:n])
            columns[at] = pa.array(texts, pa.string())
            yield columns

    return map_columns(both, run, docs.schema)


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), width=35)


OP8_SQL = r"""
WITH d AS (SELECT row_number() OVER () rid, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') ws FROM documents),
p AS (SELECT rid, doc_id, ws, unnest(range(1, len(ws) - 33)) i FROM d WHERE len(ws) >= 35),
w AS (SELECT rid, i, md5(array_to_string(ws[i:i+34], ' ')) h FROM p),
r AS (SELECT rid, i FROM w QUALIFY count(*) OVER (PARTITION BY h) > 1),
g AS (SELECT DISTINCT rid, i + k AS i FROM r, range(35) t(k)),
a AS (SELECT rid, list(i) gone FROM g GROUP BY rid),
k AS (SELECT d.doc_id, len(ws)::BIGINT n_words, coalesce(len(gone), 0)::BIGINT n_removed,
  list_filter(ws, lambda x, i: NOT coalesce(list_contains(gone, i), false)) kept FROM d LEFT JOIN a USING (rid))
SELECT doc_id, n_words, n_removed, sha256(coalesce(array_to_string(kept, ' '), '')) kept_sha256 FROM k
"""
