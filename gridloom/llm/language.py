"""Language identification by cross-parsing entropy.

For each language a suffix automaton of a bounded sample of labelled text gives, from any place of a text, the
longest match with what that language was seen to write, over as many words as it lasts. A text is parsed greedily
into such matches (phrases); a text of N letters that takes c phrases against a sample of n letters has
c * log2(n) / N bits a letter, and the language with the fewest wins. Letters are lower-cased; all else is one blank.
"""

from __future__ import annotations

import math
import re
from array import array
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import columns_of, hold_only, map_columns, slices, small_batches

_WORD = re.compile(r"[^\W\d_]+")
#: Symbol 0 is any letter no sample holds, 1 stands between the texts of a sample; neither takes part in a match.
_UNSEEN, _BETWEEN = 0, 1


def normalise(text: str) -> str:
    """Lower-case letters with one blank for all else, and one at each end; empty without a letter."""
    words = _WORD.findall(text.lower())
    return f" {' '.join(words)} " if any(c.isalpha() for w in words for c in w) else ""


class Alphabet(dict):
    """Letter -> symbol."""

    def __init__(self, samples: list[list[str]]) -> None:
        letters = sorted({c for texts in samples for text in texts for c in text})
        super().__init__({c: k + 2 for k, c in enumerate(letters)})
        self.width = len(letters) + 2

    def __missing__(self, letter: str) -> int:
        return _UNSEEN

    def codes(self, text: str) -> list[int]:
        return list(map(self.__getitem__, text))

    def arrays(self, texts: list[str]) -> np.ndarray:
        """The codes of all texts, one after the other."""
        if not hasattr(self, "by_point"):
            self.by_point = np.full(0x110000, _UNSEEN, np.int32)
            self.by_point[[ord(c) for c in self]] = list(self.values())
        return self.by_point[np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")]


class _Sparse(dict):
    def __missing__(self, key: int) -> int:
        return 0


class _Packed:
    """Sorted steps, read one by one."""

    def __init__(self, keys: np.ndarray, targets: np.ndarray) -> None:
        self.keys, self.targets = memoryview(keys), memoryview(targets)

    def __getitem__(self, place: int) -> int:
        at = bisect_left(self.keys, place)
        return self.targets[at] if at < len(self.keys) and self.keys[at] == place else 0


class SuffixAutomaton:
    """All substrings of some texts. A state is a multiple of the number of symbols; step[state + symbol] is the state
    after that symbol, 0 if there is none. A flat array of at most DENSE places; else, for very large alphabets or very
    many languages, the steps there are in order (16 bytes each, at most three times as many as letters). Symbols are
    numbered anew by those that the texts hold, so that what other languages write does not widen the array."""

    DENSE = 1 << 23

    def __init__(self, texts: list[list[int]], width: int, dense: int | None = None) -> None:
        self.own = np.full(width, _UNSEEN, np.int32)
        there = sorted({x for text in texts for x in text} - {_UNSEEN, _BETWEEN})
        self.own[[_BETWEEN, *there]] = range(1, len(there) + 2)
        self.own_of, width = self.own.tolist(), len(there) + 2
        sample = [self.own_of[x] for text in texts for x in (*text, _BETWEEN)]
        most = 2 * (len(sample) + 1)
        dense = most * width <= (self.DENSE if dense is None else dense)
        self.step = step = array("i", bytes(4 * most * width)) if dense else _Sparse()
        out: list[list[int]] = [[]]  # symbols that leave a state
        link, length, last = [-1], [0], 0
        for x in sample:
            cur = len(link)
            link.append(0)
            length.append(length[last] + 1)
            out.append([])
            p = last
            while p >= 0 and not step[p * width + x]:
                step[p * width + x] = cur * width
                out[p].append(x)
                p = link[p]
            if p >= 0:
                q = step[p * width + x] // width
                if length[q] == length[p] + 1:
                    link[cur] = q
                else:
                    copy = len(link)
                    link.append(link[q])
                    length.append(length[p] + 1)
                    out.append(list(out[q]))
                    for y in out[q]:
                        step[copy * width + y] = step[q * width + y]
                    while p >= 0 and step[p * width + x] == q * width:
                        step[p * width + x] = copy * width
                        p = link[p]
                    link[q] = link[cur] = copy
            last = cur
        self.keys = None
        if dense:
            del step[len(link) * width :]
            return
        keys = np.fromiter(step.keys(), np.int64, len(step))
        order = np.argsort(keys)
        self.keys, self.targets = keys[order], np.fromiter(step.values(), np.int64, len(step))[order]
        self.step = _Packed(self.keys, self.targets)

    def _steps(self, places: np.ndarray) -> np.ndarray:
        """step[places]."""
        if self.keys is None:
            return np.frombuffer(self.step, np.int32)[places]
        at = np.minimum(np.searchsorted(self.keys, places), len(self.keys) - 1)
        return np.where(self.keys[at] == places, self.targets[at], 0)

    def phrases(self, text: list[int], state: int = 0, count: int = 0) -> int:
        """Longest matches, one after the other, that cover text; a symbol never seen is a phrase of its own. A parse
        can go on from a state and a count."""
        step = self.step
        for x in map(self.own_of.__getitem__, text):
            to = step[state + x]
            if not to:
                if state:
                    count += 1
                to = step[x]
                if not to:
                    count += 1
            state = to
        return count + (state != 0)

    #: So many texts at least go in step; fewer are parsed one by one.
    FEW = 64

    def phrases_of(self, flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """phrases() of texts within flat, ordered from the longest on: a symbol of each at a time, while enough of
        them last."""
        n = len(starts)
        state, count, done = np.zeros(n, np.int64), np.zeros(n, np.int64), 0
        if n >= self.FEW:
            at, done = starts.copy(), int(lengths[self.FEW - 1])
            for lasting in np.searchsorted(-lengths, -np.arange(done)).tolist():
                x, before = self.own[flat[at[:lasting]]], state[:lasting]
                after = self._steps(before + x)
                (ended,) = np.nonzero(after == 0)
                if len(ended):
                    anew = self._steps(x[ended])
                    count[ended] += (before[ended] != 0).astype(np.int64) + (anew == 0)
                    after[ended] = anew
                state[:lasting] = after
                at[:lasting] += 1
        longer = int(np.searchsorted(-lengths, -done))
        count[longer:] += state[longer:] != 0
        for k in range(longer):
            rest = flat[starts[k] + done : starts[k] + lengths[k]].tolist()
            count[k] = self.phrases(rest, int(state[k]), int(count[k]))
        return count


class Parser:
    """Phrase counts of texts against each language. Flat tables of all languages take BUDGET bytes at most."""

    kept: dict[int, "Parser"] = {}
    BUDGET = 512 << 20

    def __init__(self, samples: list[tuple[str, list[str]]]) -> None:
        self.langs = [lang for lang, _ in samples]
        self.alphabet = Alphabet([texts for _, texts in samples])
        dense = min(SuffixAutomaton.DENSE, self.BUDGET // 4 // max(1, len(samples)))
        self.automata = [SuffixAutomaton([self.alphabet.codes(t) for t in texts], self.alphabet.width, dense) for _, texts in samples]
        self.weights = [math.log2(max(2, sum(map(len, texts)))) for _, texts in samples]

    @classmethod
    def of(cls, samples: list[tuple[str, list[str]]]) -> "Parser":
        hold_only("language", cls.kept.clear)
        key = hash(tuple((lang, *texts) for lang, texts in samples))
        if key not in cls.kept:
            cls.kept.clear()
            cls.kept[key] = cls(samples)
        return cls.kept[key]

    def predict(self, texts: list[str | None], most: int = 2_000_000) -> list[tuple[str, float]]:
        """Language and score of each text; runs of texts of about `most` letters are parsed together."""
        out: list[tuple[str, float]] = [("und", 0.0)] * len(texts)
        run: list[tuple[int, str]] = []
        total = 0
        for k, text in enumerate(texts):
            letters = normalise(text) if text and self.langs else ""
            if letters:
                run.append((k, letters))
                total += len(letters)
            if run and (total >= most or k == len(texts) - 1):
                for (place, _), found in zip(run, self._best([t for _, t in run]), strict=True):
                    out[place] = found
                run, total = [], 0
        return out

    def _best(self, texts: list[str]) -> list[tuple[str, float]]:
        lengths = np.array([len(t) for t in texts], np.int64)
        flat, starts = self.alphabet.arrays(texts), np.cumsum(lengths) - lengths
        order = np.argsort(-lengths, kind="stable")
        counts = np.zeros((len(texts), len(self.langs)), np.int64)
        for j, a in enumerate(self.automata):
            counts[order, j] = a.phrases_of(flat, starts[order], lengths[order])
        return [self._choose(c, n) for c, n in zip(counts.tolist(), lengths.tolist(), strict=True)]

    def _choose(self, counts: list[int], n: int) -> tuple[str, float]:
        bits = [c * w / n for c, w in zip(counts, self.weights, strict=True)]
        order = sorted(range(len(bits)), key=lambda k: (bits[k], self.langs[k]))
        best = order[0]
        second = bits[order[1]] if len(order) > 1 else 2 * bits[best] + 1
        return self.langs[best], float(min(1.0, max(0.0, 1 - bits[best] / second))) if second else 0.0


def remainder(doc_id: str = "doc_id") -> F.Column:
    """crc32 of the id's text modulo 4; a null id counts as an empty text (remainder 0)."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(4)).cast("int")


def sample_texts(docs: DataFrame, letters: int = 60_000, per_lang: int = 400, held_out: int = 2, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", most_langs: int = 256) -> list[tuple[str, list[str]]]:
    """language and texts: a bounded sample to fit on: for each of the `most_langs` most frequent labels, whole documents in the order
    of a hash of their id until `letters` letters are reached, at most per_lang documents (of each no more than the first
    8 * letters code points leave the tasks, so that one very long text does not fill the driver). Rows of the held-out
    remainder, null labels and null texts take no part; rows of one id and label (null ids are one) count as one
    document, with the least of their texts. Of labels beyond `most_langs` none is learned: that number, like the
    others, bounds the sample that every task holds."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))
    rows = rows.where((remainder() != held_out) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    rows = rows.select("lang", F.xxhash64("doc_id", F.lit(1)).alias("order"), "text")
    ids = rows.select("lang", "order", F.length("text").alias("n"))
    langs = ids.groupBy("lang").agg(F.count(F.lit(1)).alias("rows"), F.approx_count_distinct("order").alias("ids"))
    langs = langs.orderBy(F.desc("rows"), "lang").limit(most_langs)
    # the first per_lang ids lie in the first 8 * per_lang / ids of all hashes, so others leave where they are read
    ahead = (F.col("order") / F.lit(2.0**64) + 0.5) * F.col("ids") < 8 * per_lang
    few = ids.join(F.broadcast(langs), "lang").where(ahead).groupBy("lang", "order").agg(F.max("n").alias("n"))
    by_hash = Window.partitionBy("lang").orderBy("order")
    few = few.withColumn("k", F.row_number().over(by_hash)).where(F.col("k") <= per_lang)
    sofar = F.coalesce(F.sum("n").over(by_hash.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    few = few.withColumn("sofar", sofar).where(F.col("sofar") < letters).select("lang", "order")
    heads = rows.withColumn("text", F.substring("text", 1, 8 * letters))
    got = heads.join(F.broadcast(few), ["lang", "order"]).groupBy("lang", "order").agg(F.min("text").alias("text")).collect()  # at most most_langs * per_lang rows
    out: dict[str, list[str]] = {}
    sizes: dict[str, int] = {}
    for r in sorted(got, key=lambda r: (r["lang"], r["order"])):
        text = normalise(r["text"])[: 2 * letters]
        if text and sizes.get(r["lang"], 0) < letters:
            out.setdefault(r["lang"], []).append(text)
            sizes[r["lang"]] = sizes.get(r["lang"], 0) + len(text)
    return sorted(out.items())


def classify(docs: DataFrame, samples: list[tuple[str, list[str]]], text: str = "text", into: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """docs with a predicted language and a score (0 to 1: how much fewer bits the best takes than the second best).

    Only the text is looked at. `und` with score 0 if the text is null, has no letter, or nothing was learned. Equal
    rows give a row each. Columns of docs that are called as `into` says are replaced.
    """
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(samples)  # bounded by sample_texts
    at = docs.columns.index(text)
    names = [c for c in docs.columns if c not in into]
    places = [docs.columns.index(c) for c in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.Array]]:
        parser = Parser.of(shared.value)
        for batch in slices(batches):
            found = parser.predict(batch.column(at).to_pylist())
            yield [*[batch.column(k) for k in places], pa.array([a for a, _ in found], pa.string()), pa.array([b for _, b in found], pa.float64())]

    schema = docs.select(*columns_of(names)).schema.add(into[0], "string").add(into[1], "double")
    return map_columns(docs, run, schema)


def identify(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", held_out: int = 2, **sampling: int) -> DataFrame:
    """doc_id, held_out, lang_pred, score for each row of docs; equal rows, null and equal ids give a row each, an
    empty table an empty table."""
    samples = sample_texts(docs, held_out=held_out, doc_id=doc_id, text=text, lang=lang, **sampling)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    found = classify(rows, samples)
    return found.select("doc_id", (remainder() == held_out).alias("held_out"), "lang_pred", "score")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet"))
