"""Exact n-gram Jaccard join of documents by set-relation skipping; returns connected components.

1. A document becomes the set of its word n-gram hashes; equal sets become one.
2. Index lists: in one order of all n-grams (those seen often last) two sets that link share one among their first
   |x| - ceil(t |x|) + 1. A list holds blocks of sets of one size, in order of the n-gram's position in them. Where two
   sets meet at their first common n-gram, what is left of the shorter rest bounds their overlap; so of each block only
   the entries up to a position are looked at, the rest and blocks of sizes too far apart are skipped. Sets that may
   link also by their parity bitmaps (a bound on how much they differ) form groups. Lists only serve to group sets, so
   these relations are contracted where they lie and no pair leaves a task.
3. Sets of a group meet in one task (in blocks, by pairs of blocks, where a group is large), which joins them exactly.
   A leader's answers come from lists skipped in the same way, down to a lower threshold: a set that links with the
   leader finds all its own answers among those (triangle inequality of the Jaccard distance), and its overlaps with
   them follow from the leader's by the few n-grams in which the two differ.
   Only links that join two components leave the task.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_values, columns_of, materialise, mix, row_key, shingle_hashes, shuffle_partitions, slices, small_batches, split_chunks, unused, words_only
from .graph import components



def shingle_sets(texts: list[bytes | None], width: int) -> Iterator[np.ndarray]:
    """Of each text the sorted distinct hashes of its runs of `width` words, A-Z in lower case; fewer words are one
    run; without a word there is none."""
    for _, words in split_chunks(texts, lower=True):
        flat = words_only().of([w for t in words for w in t])
        runs, at = shingle_hashes(flat, width), 0
        for t in words:
            n = len(t)
            yield np.unique(runs[at : at + n - width + 1]) if n >= width else shingle_hashes(flat[at : at + n], n) ^ np.uint64(n) if n else flat[:0]
            at += n


def set_id(values: np.ndarray) -> int:
    """A 63-bit name of a set."""
    return xxhash.xxh3_64_intdigest(values.tobytes()) >> 1


def prefix_length(size: int, percent: int) -> int:
    return size - -(-percent * size // 100) + 1


#: So many of an n-gram's chosen places at least tell how often it is found.
LEAST_CHOSEN = 5


def chosen_places(token: np.ndarray, one_in: int, salt: int) -> np.ndarray:
    """The n-grams at about every one_in-th place, chosen by a hash of n-gram, place and salt."""
    return token[mix(token + mix(np.arange(len(token), dtype=np.uint64) + (np.uint64(salt) << np.uint64(32)))) % np.uint64(one_in) == 0]


def _sets(docs: DataFrame, width: int, one_in: int = 1024) -> DataFrame:
    """doc_id, row, n_shingles, set (null if empty); and with doc_id null: n-grams seen often in one run of batches
    (kind 1), and those at one in so many places of it (kind 2), by which n-grams are found that are spread thinly over
    very many runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, np.ndarray] = {}
        total = 0

        def counted(kind: int, token: np.ndarray, count: np.ndarray) -> pa.RecordBatch:
            k = len(token)
            return pa.RecordBatch.from_arrays([pa.array([kind] * k, pa.int32()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.array(count, pa.int64()), pa.array(token.view(np.int64), pa.int64())], names=names)

        def often() -> Iterator[pa.RecordBatch]:
            every = np.concatenate([*seen.values(), np.zeros(0, np.uint64)])
            yield counted(2, *np.unique(chosen_places(every, one_in, next(iter(seen), 0) & 0xFFFFFFFF), return_counts=True))
            token, count = np.unique(every, return_counts=True)
            at = np.flatnonzero(count >= 4)
            if len(at) > 20_000:
                at = at[np.argsort(-count[at], kind="stable")[:20_000]]
            yield counted(1, token[at], count[at])

        for batch in slices(batches):
            sizes, ids = [], []
            for values in shingle_sets(byte_values(batch.column(2)), width):
                name = set_id(values) if len(values) else None
                sizes.append(len(values))
                ids.append(name)
                if name is not None and name not in seen:
                    seen[name] = values
                    total += len(values)
            yield pa.RecordBatch.from_arrays([pa.array([0] * len(ids), pa.int32()), batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(ids, pa.int64())], names=names)
            if total > 1_000_000:
                yield from often()
                seen.clear()
                total = 0
        yield from often()

    names = ["kind", "doc_id", "row", "n_shingles", "set"]
    return docs.select("doc_id", "row", "text").mapInArrow(run, "kind int, doc_id long, row long, n_shingles long, set long")


def _frequent(both: DataFrame, one_in: int = 1024) -> DataFrame:
    """set (an n-gram) and n, about how often it is found, of the n-grams found often: the larger of what runs of batches
    counted and what its chosen places stand for."""
    by_kind = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("n_shingles"))), F.lit(0))
    counts = both.where("kind > 0").groupBy("set").agg(by_kind(1).alias("runs"), by_kind(2).alias("chosen"))
    n = F.greatest("runs", F.when(F.col("chosen") >= LEAST_CHOSEN, F.col("chosen") * one_in).otherwise(0))
    return counts.select("set", n.alias("n")).where("n >= 8")


def _prefix(values: np.ndarray, percent: int, often: np.ndarray, rank: np.ndarray) -> np.ndarray:
    take = prefix_length(len(values), percent)
    if len(often):
        at = np.minimum(np.searchsorted(often, values), len(often) - 1)
        key = np.where(often[at] == values, rank[at], -1)
        if key.max(initial=-1) >= 0:
            values = values[np.argsort(key, kind="stable")]
    return values[:take]


def parity_bits(values: np.ndarray) -> np.ndarray:
    """A bitmap of about one bit for each member (0.7 to 1.3), in 64-bit words, a power of two of them: each member
    flips one bit. Two bitmaps differ in at most as many bits as their sets differ in members; halves fold onto each other."""
    words = 1 << (len(values) // 96 - 1).bit_length() if len(values) >= 96 else 1
    # the bit within a word does not depend on the number of words, so that folding keeps to words
    place = ((values >> np.uint64(26)).astype(np.int64) & (words - 1)) * 64 + ((values >> np.uint64(20)).astype(np.int64) & 63)
    bits = np.bincount(place, minlength=64 * words) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").view("<u8")


def _postings(docs: DataFrame, width: int, percent: int, often: np.ndarray, rank: np.ndarray, heavy: dict[int, int], buckets: int) -> DataFrame:
    """bucket, payload: prefix postings of each batch's distinct sets with the sets' sizes and bitmaps, packed. An
    n-gram in `heavy` has several lists, one for each pair of blocks of its sets."""
    shared = docs.sparkSession.sparkContext.broadcast((often, rank, heavy))  # bounded by most_often

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, rank, heavy = shared.value
        hot = np.array(sorted(heavy), np.uint64)
        for batch in slices(batches):
            sets: dict[int, tuple[np.ndarray, int, np.ndarray]] = {}
            for values in shingle_sets(byte_values(batch.column(0)), width):
                if len(values) and (name := set_id(values)) not in sets:
                    sets[name] = (_prefix(values, percent, often, rank), len(values), parity_bits(values))
            if not sets:
                continue
            names, size = np.array(list(sets), np.int64), np.array([n for _, n, _ in sets.values()], np.int64)
            counts = np.array([len(p) for p, *_ in sets.values()])
            token, own = np.concatenate([p for p, *_ in sets.values()]), np.repeat(np.arange(len(sets)), counts)
            pos = np.arange(len(token)) - np.repeat(np.cumsum(counts) - counts, counts)
            if len(hot):
                split = np.isin(token, hot)
                more_token, more_own, more_pos = [token[~split]], [own[~split]], [pos[~split]]
                for t, d, i in zip(token[split].tolist(), own[split].tolist(), pos[split].tolist(), strict=True):
                    blocks = heavy[t]
                    mine = int(names[d]) % blocks
                    pairs = [min(mine, k) * blocks + max(mine, k) for k in range(blocks)]
                    more_token.append(mix(np.array(pairs, np.uint64) ^ np.uint64(t)))
                    more_own.append(np.full(blocks, d))
                    more_pos.append(np.full(blocks, i))
                token, own, pos = np.concatenate(more_token), np.concatenate(more_own), np.concatenate(more_pos)
            key = (token % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(key, kind="stable")
            token, own, pos, key = token[order], own[order], pos[order].astype(np.int32), key[order]
            cuts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
            bits = [b for *_, b in sets.values()]
            out = []
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                here, index = np.unique(own[a:b], return_inverse=True)
                out.append(pickle.dumps((token[a:b], index.astype(np.int32), pos[a:b], names[here], size[here], np.array([len(bits[i]) for i in here], np.int32), np.concatenate([bits[i] for i in here])), protocol=5))
            yield pa.RecordBatch.from_arrays([pa.array(key[cuts[:-1]].astype(np.int32), pa.int32()), pa.array(out, pa.binary())], names=["bucket", "payload"])

    return docs.select("text").mapInArrow(run, "bucket int, payload binary")


class Bitmaps:
    """Parity bitmaps of many sets, folded to every power of two of words they have."""

    def __init__(self, words: np.ndarray, flat: np.ndarray) -> None:
        self.level = np.array([int(w).bit_length() - 1 for w in words])
        start = np.cumsum(words) - words
        self.tables: list[np.ndarray] = [np.zeros((0, 1), np.uint64)] * (int(self.level.max(initial=0)) + 1)
        above, rows_above = None, np.zeros(0, np.int64)
        self.row = np.full((len(self.tables), len(words)), -1, np.int64)
        for k in range(len(self.tables) - 1, -1, -1):
            own = np.flatnonzero(self.level == k)
            table = flat[start[own][:, None] + np.arange(1 << k)[None, :]] if len(own) else np.zeros((0, 1 << k), np.uint64)
            rows = np.concatenate([rows_above, own])
            if above is not None:
                table = np.concatenate([above[:, : 1 << k] ^ above[:, 1 << k :], table])
            self.tables[k], self.row[k, rows] = table, np.arange(len(rows))
            above, rows_above = table, rows

    def differ(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Bits in which the bitmaps of x and y differ: at most the number of members in which the sets do."""
        out, level = np.empty(len(x), np.int64), np.minimum(self.level[x], self.level[y])
        for k in np.unique(level).tolist():
            at = np.flatnonzero(level == k)
            for i in range(0, len(at), 1 << 15):
                some = at[i : i + (1 << 15)]
                table, row = self.tables[k], self.row[k]
                out[some] = np.bitwise_count(table[row[x[some]]] ^ table[row[y[some]]]).sum(axis=1)
        return out


class Blocks:
    """An index list in order of size and position: entries of one size are a block."""

    def __init__(self, size: np.ndarray, pos: np.ndarray, percent: int) -> None:
        self.percent, self.n = percent, len(size)
        self.sizes, self.starts = np.unique(size, return_index=True)
        self.key = size.astype(np.int64) << 32 | pos

    def open(self, size: int, pos: int, upto: int | None = None, larger: bool = False) -> np.ndarray:
        """Places of the entries that may link with a set of that size which has the n-gram at that position, if it is
        the first in common. Blocks of other sizes and the ends of blocks are never touched. upto: only places before."""
        low = -(-self.percent * size // 100)
        high = size * 100 // self.percent if larger else size
        a, b = np.searchsorted(self.sizes, [low, high + 1])
        if a == b:
            return np.zeros(0, np.int64)
        sizes = self.sizes[a:b]
        need = -(-self.percent * (sizes + size) // (100 + self.percent))
        begin = self.starts[a:b]
        stop = np.searchsorted(self.key, sizes.astype(np.int64) << 32 | np.maximum(sizes - need, 0), side="right")
        stop = np.where((need <= size - pos) & (need <= sizes), stop, begin)
        if upto is not None:
            stop = np.minimum(stop, upto)
        n = np.maximum(stop - begin, 0)
        return np.arange(n.sum()) + np.repeat(begin - (np.cumsum(n) - n), n)


def _may_link(postings: DataFrame, percent: int, small: int = 64) -> DataFrame:
    """Edges a, b between sets that share a prefix n-gram and whose sizes and bitmaps allow a link; contracted in
    each bucket, so that at most one edge for each set leaves it."""

    def run(table: pa.Table) -> pa.Table:
        parts = [pickle.loads(p) for p in table.column("payload").to_pylist()]
        shift = np.cumsum([0, *[len(p[3]) for p in parts[:-1]]])
        token, own = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] + s for p, s in zip(parts, shift, strict=True)])
        pos = np.concatenate([p[2] for p in parts])
        names, first, index = np.unique(np.concatenate([p[3] for p in parts]), return_index=True, return_inverse=True)
        size, words = np.concatenate([p[4] for p in parts]), np.concatenate([p[5] for p in parts])
        begin = np.cumsum(words) - words
        flat = np.concatenate([p[6] for p in parts])
        del parts
        flat = flat[np.concatenate([np.arange(begin[i], begin[i] + words[i]) for i in first.tolist()])]
        bitmaps, size, own = Bitmaps(words[first], flat), size[first], index[own]
        # one posting for each set and n-gram, lists in order of size and position, cut where sizes leave a gap too large to link
        order = np.lexsort((own, pos, size[own], token))
        token, own, pos = token[order], own[order], pos[order]
        fresh = np.concatenate([[True], (token[1:] != token[:-1]) | (own[1:] != own[:-1])])
        token, own, pos = token[fresh], own[fresh], pos[fresh]
        far = (token[1:] != token[:-1]) | (100 * size[own[:-1]] < percent * size[own[1:]])
        start = np.flatnonzero(np.concatenate([[True], far]))
        length = np.diff(np.append(start, len(own)))
        parent = np.arange(len(names))

        def root(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = int(parent[x])
            return x

        def join(x: np.ndarray, y: np.ndarray) -> None:
            good = 100 * size[x] >= percent * size[y]
            x, y = x[good], y[good]
            # |x ^ y| = |x| + |y| - 2 |x & y|, and a link asks for |x & y| >= percent / (100 + percent) * (|x| + |y|)
            good = (100 + percent) * bitmaps.differ(x, y) <= (100 - percent) * (size[x] + size[y])
            for a, b in zip(x[good].tolist(), y[good].tolist(), strict=True):
                a, b = root(a), root(b)
                if a != b:
                    parent[max(a, b)] = min(a, b)

        # short lists all at once, a distance between the two places in the list at a time
        pairs = [np.zeros((0, 2), np.int64)]
        short = start[(length > 1) & (length <= small)], length[(length > 1) & (length <= small)]
        for d in range(1, small):
            s, n = short[0][short[1] > d], short[1][short[1] > d] - d
            if not len(s):
                break
            at = np.arange(n.sum()) + np.repeat(s - (np.cumsum(n) - n), n)
            x, y = own[at], own[at + d]
            rest = np.minimum(size[x] - pos[at], size[y] - pos[at + d])
            good = (100 + percent) * rest >= percent * (size[x] + size[y])
            pairs.append(np.unique(np.stack([x[good], y[good]], axis=1), axis=0))
        pairs = np.unique(np.concatenate(pairs), axis=0)
        join(*np.where((size[pairs[:, :1]] <= size[pairs[:, 1:]]), pairs, pairs[:, ::-1]).T)
        for s, n in zip(start[length > small].tolist(), length[length > small].tolist(), strict=True):
            blocks = Blocks(size[own[s : s + n]], pos[s : s + n], percent)
            for k in range(1, n):
                at = blocks.open(int(size[own[s + k]]), int(pos[s + k]), upto=k)
                ys = own[s + at]
                ys = ys[parent[ys] != root(int(own[s + k]))]
                if len(ys):
                    join(ys, np.full(len(ys), own[s + k]))
        nodes = [k for k in range(len(names)) if parent[k] != k]
        return pa.table({"a": pa.array(names[nodes], pa.int64()), "b": pa.array(names[[root(k) for k in nodes]] if nodes else names[:0], pa.int64())})

    return postings.groupBy("bucket").applyInArrow(run, "a long, b long")


class GroupJoin:
    """Exact join of a group of sets (sorted hashes): links(x, y) that connect what was not connected before."""

    def __init__(self, names: list[int], sets: list[np.ndarray], percent: int, side: np.ndarray | None = None) -> None:
        order = np.argsort([len(s) for s in sets], kind="stable")
        self.names, self.percent = [names[i] for i in order], percent
        self.side = None if side is None else side[order]
        #: per cent down to which a leader's answers go, so that they hold those of all sets it links with
        self.lower = max(1, 2 * percent - 100) if side is None else percent
        self.size = np.array([len(sets[i]) for i in order], np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.size)])
        _, token, count = np.unique(np.concatenate([sets[i] for i in order]), return_inverse=True, return_counts=True)
        own = np.repeat(np.arange(len(order)), self.size)
        # rarest n-grams first, in every set
        token = token[np.lexsort((token, count[token], own))]
        self.token, self.n_tokens = token, len(count)
        pos = np.arange(len(token)) - self.start[own]
        self.take = self.size - -(-self.lower * self.size // 100) + 1
        listed = np.flatnonzero(pos < self.take[own])
        listed = listed[np.lexsort((pos[listed], self.size[own[listed]], token[listed]))]
        self.list_own, self.list_pos = own[listed], pos[listed]
        self.list_start = np.searchsorted(token[listed], np.arange(self.n_tokens + 1))
        self.lists: dict[int, Blocks] = {}
        self.mark = np.zeros(self.n_tokens, bool)
        #: sets whose answers were looked up, and derived
        self.looked = self.derived = 0

    def members(self, x: int) -> np.ndarray:
        return self.token[self.start[x] : self.start[x + 1]]

    def candidates(self, x: int) -> np.ndarray:
        """Sets that may be as similar to x as `lower`, from the parts of index lists that sizes and positions leave."""
        found = []
        for i, t in enumerate(self.members(x)[: self.take[x]].tolist()):
            a, b = int(self.list_start[t]), int(self.list_start[t + 1])
            if b - a < 2:
                continue
            if t not in self.lists:
                self.lists[t] = Blocks(self.size[self.list_own[a:b]], self.list_pos[a:b], self.lower)
            found.append(self.list_own[a + self.lists[t].open(int(self.size[x]), i, larger=True)])
        return np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)

    def overlaps(self, x: int, ys: np.ndarray) -> np.ndarray:
        """Sizes of the intersections of x with each of ys."""
        self.mark[self.members(x)] = True
        out = np.empty(len(ys), np.int64)
        at = 0
        while at < len(ys):  # some at a time, to bound memory
            stop = at + max(1, int(np.searchsorted(np.cumsum(self.size[ys[at:]]), 2_000_000, side="right")))
            part = ys[at:stop]
            lengths = self.size[part]
            ends = np.cumsum(lengths)
            index = np.arange(ends[-1]) + np.repeat(self.start[part] - (ends - lengths), lengths)
            out[at:stop] = np.add.reduceat(self.mark[self.token[index]].astype(np.int64), ends - lengths)
            at = stop
        self.mark[self.members(x)] = False
        return out

    def similar(self, x: int, ys: np.ndarray, both: np.ndarray, percent: int) -> np.ndarray:
        return 100 * both >= percent * (self.size[x] + self.size[ys] - both)

    def derive(self, leader: int, followers: np.ndarray, ys: np.ndarray, both: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(follower, sizes of its intersections with ys), from the leader's and the n-grams in which the two differ."""
        lengths = self.size[ys]
        ends = np.cumsum(lengths)
        token = self.token[np.arange(ends[-1]) + np.repeat(self.start[ys] - (ends - lengths), lengths)]
        order = np.argsort(token, kind="stable")
        token, own = token[order], np.repeat(np.arange(len(ys)), lengths)[order]
        mine = self.members(leader)
        for f in followers.tolist():
            other = self.members(f)
            more, less = np.setdiff1d(other, mine), np.setdiff1d(mine, other)
            change = np.zeros(len(ys), np.int64)
            for part, sign in ((more, 1), (less, -1)):
                lo, hi = np.searchsorted(token, part), np.searchsorted(token, part, side="right")
                n = hi - lo
                at = np.arange(n.sum()) + np.repeat(lo - (np.cumsum(n) - n), n)
                change += sign * np.bincount(own[at], minlength=len(ys))
            yield f, both + change

    def links(self) -> list[tuple[int, int]]:
        n, percent = len(self.names), self.percent
        parent = np.arange(n)
        answered = np.zeros(n, bool)
        out: list[tuple[int, int]] = []

        def root(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = int(parent[x])
            return x

        def link(x: int, ys: np.ndarray) -> None:
            for y in ys.tolist():
                a, b = root(x), root(y)
                if a != b:
                    parent[max(a, b)] = min(a, b)
                    out.append((self.names[x], self.names[y]))

        def apart(x: int, ys: np.ndarray) -> np.ndarray:
            mine = root(x)
            return np.fromiter((root(int(y)) != mine for y in ys), bool, len(ys))

        for x in range(n):
            if answered[x]:
                continue
            answered[x] = True
            self.looked += 1
            ys = self.candidates(x)
            if self.side is not None:
                ys = ys[self.side[ys] != self.side[x]]
            ys = ys[apart(x, ys)]
            if not len(ys):
                continue
            both = self.overlaps(x, ys)
            near = self.similar(x, ys, both, self.lower)
            ys, both = ys[near], both[near]
            linked = self.similar(x, ys, both, percent)
            link(x, ys[linked])
            if self.side is not None:
                continue
            followers = ys[linked & ~answered[ys]]
            answered[followers] = True
            self.derived += len(followers)
            # a follower is linked with its leader, so only answers in other components are left to find
            rest = apart(x, ys)
            if len(followers) and rest.any():
                ys, both = ys[rest], both[rest]
                for f, own in self.derive(x, followers, ys, both):
                    link(f, ys[self.similar(f, ys, own, percent)])
        return out


def _join(sets: DataFrame, percent: int) -> DataFrame:
    """Links a, b among the sets of each task."""

    def run(table: pa.Table) -> pa.Table:
        cluster, side = np.array(table.column("cluster")), np.array(table.column("side"))
        names, values = table.column("set").to_pylist(), table.column("shingles").to_pylist()
        two = table.column("left")[0].as_py() != table.column("right")[0].as_py()
        order = np.argsort(cluster, kind="stable")
        cuts = np.flatnonzero(np.concatenate([[True], cluster[order][1:] != cluster[order][:-1], [True]]))
        out: list[tuple[int, int]] = []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            own = {names[i]: i for i in order[a:b].tolist()}  # equal sets of equal rows count once
            if len(own) > 1:
                rows = list(own.values())
                out += GroupJoin([names[i] for i in rows], [np.frombuffer(values[i], "<u8") for i in rows], percent, side[rows] if two else None).links()
        return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})

    return sets.groupBy("task", "left", "right").applyInArrow(run, "a long, b long")


def _buckets(sets: DataFrame, percent: int, least: int, bucket_bytes: int) -> int:
    """The number of buckets, least or its double, fourfold, ..., from which on a bucket holds bucket_bytes or less. A
    posting takes 20 bytes in its bucket, and a set's name, size and bitmap go once to each bucket that has some of its
    postings: a set of l postings meets b * (1 - exp(-l / b)) of b buckets."""
    length = F.col("n_shingles") - F.ceil(F.col("n_shingles") * percent / 100) + 1
    numbers = [least << k for k in range(30)]
    met = lambda b: F.lit(float(b)) * (1 - F.exp(-length / F.lit(float(b))))
    size = sets.agg(*[F.coalesce(F.sum(20 * length + (16 + F.col("n_shingles") / 8) * met(b)), F.lit(0.0)).alias(f"b{k}") for k, b in enumerate(numbers)]).first()
    return next((b for k, b in enumerate(numbers) if size[f"b{k}"] <= b * bucket_bytes), numbers[-1])


def _classes(docs: DataFrame, width: int, percent: int, doc_id: str, text: str, most_often: int = 200_000, block: int = 1_500_000, salt_from: int = 20_000, bucket_bytes: int = 64_000_000) -> DataFrame:
    """doc_id, row, n_shingles, component_id, first_row (the row that stands for the component).

    most_often bounds the list of frequent n-grams, which only orders prefixes: results do not depend on it. Groups of
    more than `block` shingles are joined by pairs of blocks. An n-gram in over salt_from sets has several
    lists, one for each pair of blocks of its sets. Buckets of lists hold about bucket_bytes, however large the input.
    """
    spark = docs.sparkSession
    small_batches(spark)
    base = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).withColumn("row", row_key("doc_id", "text"))
    both = materialise(_sets(base, width), "jaccard-sets")
    sets = both.where("kind = 0").select("doc_id", "row", "n_shingles", "set")
    frequent = _frequent(both).orderBy(F.desc("n"), "set").limit(most_often).collect()
    often = np.array([r["set"] for r in frequent], np.int64).view(np.uint64)
    heavy = {r["set"] & ((1 << 64) - 1): -(-r["n"] // salt_from) for r in frequent if r["n"] > salt_from}
    order = np.argsort(often)
    rank = np.arange(len(often), 0, -1)[order]  # the most frequent comes last
    often = often[order]
    partitions = shuffle_partitions(spark)
    buckets = _buckets(sets.where("set is not null"), percent, max(64, partitions), bucket_bytes)
    edges = materialise(_may_link(_postings(base, width, percent, often, rank, heavy, buckets), percent), "may-link")
    groups = materialise(components(edges), "groups")  # node: a set that may link
    # the sets of each group meet: one row stands for each set
    one = sets.where("set is not null").groupBy("set").agg(F.min("row").alias("row"), F.max("n_shingles").alias("n"))
    asked = materialise(one.join(groups, one["set"] == groups["node"]).select("row", "set", F.col("component").alias("cluster"), "n"), "asked")
    weight = asked.groupBy("cluster").agg(F.sum("n").alias("total"))
    tasks = max(1, int((asked.agg(F.sum("n")).first()[0] or 0) // 1_000_000) + 1)
    tasks = max(tasks, min(partitions, 4 * tasks))
    blocks = F.ceil(F.col("total") / F.lit(block)).cast("int")
    asked = asked.join(materialise(weight, "weights").hint("merge"), "cluster").withColumn("blocks", blocks).select("row", "set", "cluster", "blocks", F.pmod("set", F.col("blocks")).cast("int").alias("side"))
    got = base.select("row", "text").join(materialise(asked, "asked").hint("shuffle_hash"), "row")

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            values = [s.tobytes() for s in shingle_sets(byte_values(batch.column(0)), width)]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(values, pa.large_binary()).cast(pa.binary())], names=["set", "cluster", "blocks", "side", "shingles"])

    full = got.select("text", "set", "cluster", "blocks", "side").mapInArrow(again, "set long, cluster long, blocks int, side int, shingles binary")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    met = full.withColumn("other", other).select("set", "cluster", "side", "shingles", F.least("side", "other").alias("left"), F.greatest("side", "other").alias("right"), F.pmod(F.xxhash64("cluster"), F.lit(tasks)).cast("int").alias("task"), (F.col("blocks") > 1).alias("large"))
    met = met.withColumn("task", F.when(F.col("large"), -1 - F.pmod(F.xxhash64("cluster", F.lit(7)), F.lit(1 << 30)).cast("int")).otherwise(F.col("task"))).drop("large")
    links = materialise(_join(met, percent), "links")
    joined = components(links)
    # the first document of a set and of a component: the least id that is not null, then the least row
    first = F.struct(F.col("doc_id").isNull().alias("nameless"), F.col("doc_id"), F.col("row"))
    least = sets.where("set is not null").groupBy("set").agg(F.min(first).alias("first"))
    named = materialise(joined.join(least, F.col("node") == F.col("set")).select("set", "component", "first"), "linked-sets")
    roots = materialise(named.groupBy("component").agg(F.min("first").alias("root")), "roots")
    linked = named.join(roots.hint("merge"), "component").select("set", "root")
    alone = least.join(named, "set", "left_anti").select("set", F.col("first").alias("root"))
    of_set = materialise(linked.unionByName(alone), "set-components")
    found = sets.where("set is not null").select("doc_id", "row", "n_shingles", "set").join(of_set.hint("merge"), "set")
    found = found.select("doc_id", "row", "n_shingles", F.col("root.doc_id").alias("component_id"), F.col("root.row").alias("first_row"))
    return found.unionByName(sets.where("set is null").select("doc_id", "row", "n_shingles", F.col("doc_id").alias("component_id"), F.col("row").alias("first_row")))


def components_of(docs: DataFrame, width: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text", **options: int) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of docs: documents whose sets of `width`-word shingles have
    100 * |x & y| >= percent * |x | y| are linked; component_id is the least id reachable by links.

    Null texts and texts without a word have an empty set and link with nothing (component_id is the row's own id).
    Rows with equal sets link. Null ids give rows; a component with null ids only has a null component_id. An empty
    table gives an empty table. Shingles and sets are compared by 64-bit hashes.
    """
    return _classes(docs, width, percent, doc_id, text, **options).select("doc_id", "n_shingles", "component_id")


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text", **options: int) -> DataFrame:
    """The rows of docs, with their own columns, less all but the first of each component (the least id, then the
    least hash of id and text). Of rows that agree in id and text one stays; rows without words all stay."""
    classes = _classes(docs, width, percent, doc_id, text, **options)
    first = classes.where((F.col("n_shingles") > 0) & (F.col("row") == F.col("first_row"))).select(F.col("row").alias("_kept")).distinct()
    row, kept = unused(docs.columns, "row", "kept")
    key, value = columns_of([doc_id, text])
    rows = docs.withColumn(row, F.xxhash64(key.cast("long"), value))
    one = rows.join(materialise(first.toDF(kept), "kept-rows").hint("shuffle_hash"), F.col(row) == F.col(kept), "left_semi").dropDuplicates([row])
    wordless = rows.where(F.coalesce(~value.rlike(r"[^\x20\x09-\x0D]"), F.lit(True)))
    return one.select(*columns_of(docs.columns)).unionByName(wordless.select(*columns_of(docs.columns)))


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components_of(spark.read.parquet(f"{sf_dir}/documents.parquet"), width=4, percent=85)


OP7_SQL = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () rid, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') ws FROM documents),
s AS (SELECT DISTINCT rid, CASE WHEN len(ws) < 4 THEN array_to_string(ws, ' ') ELSE array_to_string(ws[i:i+3], ' ') END g FROM (SELECT rid, ws, unnest(range(1, greatest(len(ws) - 2, 2))) i FROM d WHERE len(ws) > 0)),
z AS (SELECT rid, count(*) n FROM s GROUP BY rid),
c AS (SELECT a.rid x, b.rid y, count(*) n FROM s a JOIN s b USING (g) WHERE a.rid < b.rid GROUP BY ALL),
l AS (SELECT x, y FROM c JOIN z p ON p.rid = x JOIN z q ON q.rid = y WHERE 100 * c.n >= 85 * (p.n + q.n - c.n)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT rid, rid AS o FROM d UNION SELECT r.rid, e.y FROM r JOIN e ON e.x = r.o)
SELECT d.doc_id, coalesce(any_value(z.n), 0)::BIGINT n_shingles, min(t.doc_id) component_id
FROM d JOIN r ON r.rid = d.rid JOIN d t ON t.rid = r.o LEFT JOIN z ON z.rid = d.rid GROUP BY d.rid, d.doc_id
"""
