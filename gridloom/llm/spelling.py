"""Spelling variants: words that differ by one letter, and the frequent form that a rare word stands for.

Two words of one length are near if they agree before and after one place, words of neighbouring lengths if they do so
once a letter is put in at one place. Words of a length are points: their rank in forward order and their rank in the
order of the reversed words. What agrees before a place is an interval of the first order, what agrees after it an
interval of the second, and a wavelet matrix over the points reports those in both.

The points are spread over shards. A word is cut in two: an edit touches one half, so near words share the other one and
meet under (length, half, the letters outside it). A key under which very many words lie is cut finer: the half is split
into stretches of two letters, and near words agree outside one of them, so that a key has no more words than there are
ways to write two letters. Every pair is found under one key only, so numbers of near words are sums over shards.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_values, columns_of, discard, materialise, slices, small_batches
from .fm_index import WaveletMatrix

#: Letters of words, and A-Z to a-z.
LETTERS = "[A-Za-zÀ-ÿ]"
_FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def misspelt(docs: DataFrame, one_in: int = 31, shortest: int = 7, doc_id: str = "doc_id", text: str = "text", held: int = 200_000) -> DataFrame:
    """word, n: the runs of letters of all texts in lower case (A-Z only), one in `one_in` of which loses a letter by the
    checksum of its document's id and itself; those of at least `shortest` letters, with how often they occur.

    A null text has no words, a null id counts as an empty one, equal rows count each. Words are summed in each task (the
    sums leave whenever `held` words are known), then over all.
    """
    small_batches(docs.sparkSession)
    runs = re.compile(f"{LETTERS}{{{shortest},}}")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, int] = {}

        def leave() -> pa.RecordBatch:
            words, n = list(total), list(total.values())
            total.clear()
            return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(n, pa.int64())], names=["word", "n"])

        for batch in slices(batches, 200):
            for own, value in zip(batch.column(0).to_pylist(), byte_values(batch.column(1)), strict=True):
                if not value:
                    continue
                seed = zlib.crc32(b"%s:" % (b"" if own is None else str(own).encode()))
                for word, n in Counter(runs.findall(value.translate(_FOLD).decode())).items():
                    h = zlib.crc32(word.encode(), seed)
                    if not h % one_in:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                        if len(word) < shortest:
                            continue
                    total[word] = total.get(word, 0) + n
            if len(total) >= held:
                yield leave()
        yield leave()

    key, value = columns_of([doc_id, text])
    found = docs.select(key.alias("doc_id"), value.alias("text")).mapInArrow(count, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n"))


def _entry(length: Column, kind: int, lo: Column, hi: Column) -> Column:
    """A word as a point among words of a length (kind 0), or as one that asks for the words of a length with a letter
    more (kind 1): lo and hi are the places of edits, in terms of the longer word."""
    outside = F.concat(F.substring(F.col("word"), F.lit(1), lo), F.lit("\n"), F.substring(F.col("word"), hi + 1 - kind, length))
    key = F.xxhash64(length, lo, hi, outside)
    return F.struct(length.alias("length"), F.lit(kind).alias("kind"), lo.alias("lo"), hi.alias("hi"), key.alias("key"))


def entries(words: DataFrame, most: int = 50_000) -> DataFrame:
    """word, n, length, kind, lo, hi, key: each word under its keys. Keys with more than `most` words are cut finer."""
    size = F.length("word")
    halves = []
    for kind in (0, 1):
        length = size + kind
        middle = F.floor(length / 2).cast("int")
        halves += [_entry(length, kind, F.lit(0), middle), _entry(length, kind, middle, length)]
    coarse = words.select("word", "n", F.explode(F.array(*halves)).alias("e")).select("word", "n", "e.*").where("lo < hi")
    heavy = materialise(coarse.groupBy("key").count().where(F.col("count") > most).select(F.col("key").alias("heavy")), "heavy-keys")
    marked = coarse.join(heavy, F.col("key") == F.col("heavy"), "left")
    starts = F.sequence(F.col("lo"), F.col("hi") - 1, F.lit(2))
    own = lambda kind: F.transform(starts, lambda at: _entry(F.col("length"), kind, at, F.least(at + 2, F.col("hi"))))
    finer = marked.where("heavy is not null").select("word", "n", F.explode(F.when(F.col("kind") == 0, own(0)).otherwise(own(1))).alias("e"))
    return marked.where("heavy is null").drop("heavy").unionByName(finer.select("word", "n", "e.*"))


class _Order:
    """Words in order; for each word and length of a prefix the interval, among the points, of what has this prefix."""

    def __init__(self, letters: np.ndarray, point: np.ndarray) -> None:
        self.order = np.lexsort(letters.T[::-1])
        rows = letters[self.order]
        differ = rows[1:] != rows[:-1]
        #: letters that a word shares with the one before
        self.shared = np.concatenate([[-1], np.where(differ.any(axis=1), differ.argmax(axis=1), letters.shape[1])])
        self.place = np.empty(len(letters), np.int64)
        self.place[self.order] = np.arange(len(letters))
        #: points before each place
        self.points = np.concatenate([[0], np.cumsum(point[self.order])])

    def interval(self, word: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        begins = np.flatnonzero(self.shared < length)
        nth = np.searchsorted(begins, self.place[word], side="right")
        return self.points[begins[nth - 1]], self.points[np.append(begins, len(self.order))[nth]]


def near_pairs(words: list[str], kind: np.ndarray, lo: np.ndarray, hi: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """(entry, entry of a near point, whether a letter was put in) for entries under keys of one length, place by place.

    A letter that is put into a run of equal letters could stand at several places; the leftmost counts.
    """
    every, row = np.unique(np.array(words, dtype=f"U{length}"), return_inverse=True)
    if len(every) < 2:
        return
    letters = every.view(np.uint32).reshape(len(every), length)
    sizes = np.char.str_len(every)
    point = sizes == length
    # reversed words, also where a letter is missing: both begin at the first column
    back = np.where(point[:, None], letters[:, ::-1], np.roll(letters, 1, axis=1)[:, ::-1])
    forward, backward = _Order(letters, point), _Order(back, point)
    by_forward = forward.order[point[forward.order]]
    by_backward = backward.order[point[backward.order]]
    if not len(by_forward):
        return
    rank = np.empty(len(every), np.int64)
    rank[by_backward] = np.arange(len(by_backward))
    grid = WaveletMatrix(rank[by_forward], len(by_forward))
    first = np.full(len(every), -1)
    first[row[::-1]] = np.arange(len(row))[::-1]  # an entry of each word
    for at in range(length):
        for put_in in (False, True):
            asks = np.flatnonzero((lo <= at) & (at < hi) & (kind == put_in))
            word = row[asks]
            f_lo, f_hi = forward.interval(word, at)
            b_lo, b_hi = backward.interval(word, length - 1 - at)
            alone = int(not put_in)  # a point is in its own intervals
            some = np.flatnonzero((f_hi - f_lo > alone) & (b_hi - b_lo > alone))
            query, found = grid.report(f_lo[some], f_hi[some], b_lo[some], b_hi[some])
            asking, other = asks[some[query]], by_backward[found]
            good = row[asking] != other
            if put_in and at:
                good = letters[row[asking], at - 1] != letters[other, at]
            yield asking[good], first[other[good]], put_in


def near_words(words: DataFrame, most: int = 50_000, shard_rows: int = 100_000) -> DataFrame:
    """word, n_near, near_n, near_word for the words (word, n; each once) that have a near word: how many, and the one of
    largest n, of equal ones the smallest. Shards hold about shard_rows entries, whatever the number of words."""
    table = materialise(entries(words, most), "spelling-entries")
    total = table.count()
    shards = max(1, -(-total // shard_rows))

    def find(shard: pa.Table) -> pa.Table:
        words, n = np.array(shard.column("word").to_pylist(), dtype=object), shard.column("n").to_numpy()
        length, kind, lo, hi = (shard.column(c).to_numpy() for c in ("length", "kind", "lo", "hi"))
        out: tuple[list, ...] = ([], [], [], [])
        for own in np.unique(length):
            rows = np.flatnonzero(length == own)
            a, b = [], []
            for asking, other, put_in in near_pairs(words[rows].tolist(), kind[rows], lo[rows], hi[rows], int(own)):
                a += [asking, other] if put_in else [asking]
                b += [other, asking] if put_in else [other]
            if not a:
                continue
            a, b = rows[np.concatenate(a)], rows[np.concatenate(b)]
            # the best near word of each word comes first
            place = np.empty(len(words), np.int64)
            names, place[rows] = np.unique(words[rows].astype(str), return_inverse=True)
            order = np.lexsort((place[b], -n[b], place[a]))
            a, b = a[order], b[order]
            heads = np.flatnonzero(np.append(True, place[a][1:] != place[a][:-1])) if len(a) else np.zeros(0, np.int64)
            for column, values in zip(out, (names[place[a[heads]]].tolist(), np.diff(np.append(heads, len(a))).tolist(), n[b[heads]].tolist(), names[place[b[heads]]].tolist()), strict=True):
                column += values
        return pa.table([pa.array(c, t) for c, t in zip(out, (pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["word", "near", "near_n", "near_word"])

    dealt = table.select("word", "n", "length", "kind", "lo", "hi", F.pmod("key", F.lit(shards)).alias("shard"))
    found = dealt.groupBy("shard").applyInArrow(find, "word string, near long, near_n long, near_word string")
    best = found.groupBy("word").agg(F.sum("near").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near_word").alias("word"))).alias("best"))
    return best.select("word", "n_near", (-F.col("best.n")).alias("near_n"), F.col("best.word").alias("near_word"))


def follow(forms: DataFrame, most_rounds: int = 64) -> DataFrame:
    """word, root from word, form: the last word that forms lead to. Each round doubles how far a word has come; a form
    is many times as frequent as its word, so chains are short and have no rings."""
    now = materialise(forms.select("word", F.col("form").alias("root")), "roots")
    for _ in range(most_rounds):
        ahead = now.select(F.col("word").alias("_word"), F.col("root").alias("_root"))
        moved = now.join(ahead, F.col("root") == F.col("_word"), "left").select("word", F.coalesce("_root", "root").alias("root"), F.col("_root").isNotNull().alias("moved"))
        after = materialise(moved, "roots")
        discard(now)
        now = after
        if now.where("moved").isEmpty():
            return now.select("word", "root")
    raise RuntimeError(f"forms lead on after {most_rounds} rounds")


def group(words: DataFrame, times: int = 10, most: int = 50_000, shard_rows: int = 100_000) -> DataFrame:
    """word, form, root, n, n_near, form_n for a table of words (word, n), each once.

    form: the near word of largest n (of equal ones the smallest) if it is at least `times` as frequent, else null; root:
    the last word that forms lead to, the word itself if it has none. Null words and counts are left out; an empty table
    gives an empty one; words repeated in the table are summed; other columns of words are not carried.
    """
    clean = words.where("word is not null and n is not null").groupBy("word").agg(F.sum("n").cast("long").alias("n"))
    clean = materialise(clean, "words")
    near = near_words(clean, most, shard_rows)
    good = F.col("near_n") >= times * F.col("n")
    known = clean.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(good, F.col("near_word")).alias("form"), F.when(good, F.col("near_n")).alias("form_n"))
    known = materialise(known, "forms")
    rooted = known.join(follow(known.where("form is not null")), "word", "left")
    return rooted.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of at least 7 letters that occur at least twice, in groups."""
    words = misspelt(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return group(words.where("n >= 2"))


OP13_SQL = r"""
WITH RECURSIVE t AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, i)) AS crc),
r AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{00C0}-\x{00FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
g AS (SELECT doc_id, run, count(*) AS n FROM r WHERE length(run) >= 7 GROUP BY ALL),
h AS (SELECT run, n, xor(4294967295, list_reduce(flatten(list_transform(string_split(concat(doc_id, ':', run), ''), lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)] ELSE [192 + unicode(x) // 64, 128 + unicode(x) % 64] END)),
  lambda c, b: xor(crc[(xor(c, b::BIGINT) % 256) + 1], c // 256), 4294967295::BIGINT)) AS h FROM g, t),
v AS (SELECT CASE WHEN h % 31 = 0 THEN left(run, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, n FROM h),
w AS (SELECT word, sum(n)::BIGINT AS n FROM v WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
k AS (SELECT word, n, i, left(word, i) || '*' || substr(word, i + 2) AS put, left(word, i) || substr(word, i + 2) AS cut FROM (SELECT *, unnest(range(length(word)))::INT AS i FROM w)),
p AS (SELECT a.word, b.word AS other, b.n AS m FROM k a JOIN k b ON a.put = b.put AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM w a JOIN k b ON a.word = b.cut UNION SELECT b.word, a.word, a.n FROM w a JOIN k b ON a.word = b.cut),
q AS (SELECT word, other, m, count(*) OVER (PARTITION BY word) AS n_near FROM p QUALIFY row_number() OVER (PARTITION BY word ORDER BY m DESC, other) = 1),
f AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 10 * w.n THEN other END AS form, CASE WHEN m >= 10 * w.n THEN m END AS form_n FROM w LEFT JOIN q USING (word)),
s AS (SELECT word, word AS at, form AS next FROM f UNION ALL SELECT s.word, f.word, f.form FROM s JOIN f ON f.word = s.next)
SELECT f.word, f.form, s.at AS root, f.n, f.n_near, f.form_n FROM f JOIN s ON s.word = f.word AND s.next IS NULL
"""
