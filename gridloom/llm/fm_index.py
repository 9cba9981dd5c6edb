"""A compressed full-text index over word numbers: a wavelet matrix of the Burrows-Wheeler transform.

Searches run for many patterns at once; a pattern is a stretch of the indexed text itself.
"""

from __future__ import annotations

import numpy as np

_ONE = np.uint64(1)


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes in the order of their first `depth` symbols or more, by prefix doubling."""
    n = len(text)
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64) + 1
    order, h = np.argsort(rank), 1
    while h < depth:
        key = rank * (n + 2)
        key[: n - h] += rank[h:]
        order = np.argsort(key)
        ordered = key[order]
        fresh = np.concatenate([[1], (ordered[1:] != ordered[:-1]).astype(np.int64)])
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(fresh)
        if rank[order[-1]] == n:
            break
        h *= 2
    return order


class WaveletMatrix:
    """Rank queries over numbers below 2**levels, in bit-packed levels with a count for each 64 bits."""

    def __init__(self, values: np.ndarray, sigma: int) -> None:
        self.levels = max(1, int(sigma - 1).bit_length())
        n = len(values)
        n_words = n // 64 + 1
        self.bits, self.counts, self.zeros = [], [], []
        now = values.astype(np.uint32)
        for level in range(self.levels - 1, -1, -1):
            bit = (now >> np.uint32(level)) & np.uint32(1)
            packed = np.zeros(n_words * 8, np.uint8)
            raw = np.packbits(bit.astype(np.uint8), bitorder="little")
            packed[: len(raw)] = raw
            words = packed.view("<u8")
            self.bits.append(words)
            self.counts.append(np.concatenate([[0], np.cumsum(np.bitwise_count(words))])[:-1].astype(np.int32))
            self.zeros.append(int(n - bit.sum()))
            now = np.concatenate([now[bit == 0], now[bit == 1]])
        #: where each number's run begins after the last level
        self.run_start = np.zeros(sigma + 1, np.int64)
        present, first = np.unique(now, return_index=True)
        self.run_start[present] = first

    def descend(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where a prefix of length `at` ends among the occurrences of its symbol, counted from run_start."""
        at = at.astype(np.int64)
        for k, level in enumerate(range(self.levels - 1, -1, -1)):
            word = at >> 6
            ones = self.counts[k][word] + np.bitwise_count(self.bits[k][word] & ((_ONE << (at & 63).astype(np.uint64)) - _ONE))
            at = np.where((symbols >> level) & 1, self.zeros[k] + ones, at - ones)
        return at

    def _ones(self, k: int, at: np.ndarray) -> np.ndarray:
        """How many of the first `at` numbers have a one in level k."""
        return self.counts[k][at >> 6] + np.bitwise_count(self.bits[k][at >> 6] & ((_ONE << (at & 63).astype(np.uint64)) - _ONE))

    def report(self, lo: np.ndarray, hi: np.ndarray, least: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, number) for every distinct number in [least, most) at the places [lo, hi) of each query. All queries
        go down the levels together; branches without places or without wanted numbers are left."""
        query = np.flatnonzero((hi > lo) & (most > least))
        lo, hi, base = lo[query].astype(np.int64), hi[query].astype(np.int64), np.zeros(len(query), np.int64)
        for k, level in enumerate(range(self.levels - 1, -1, -1)):
            ones_lo, ones_hi, half = self._ones(k, lo), self._ones(k, hi), base + (1 << level)
            zero = (hi - ones_hi > lo - ones_lo) & (least[query] < half)
            one = (ones_hi > ones_lo) & (most[query] > half)
            lo, hi = np.concatenate([(lo - ones_lo)[zero], self.zeros[k] + ones_lo[one]]), np.concatenate([(hi - ones_hi)[zero], self.zeros[k] + ones_hi[one]])
            base, query = np.concatenate([base[zero], half[one]]), np.concatenate([query[zero], query[one]])
            wanted = (base < most[query]) & (base + (1 << level) > least[query])
            lo, hi, base, query = lo[wanted], hi[wanted], base[wanted], query[wanted]
        return query, base


class FMIndex:
    """How often stretches of words occur in a text (numbers from 0; 0 separates), exact for stretches of up to `depth`
    symbols. Holds the wavelet matrix and, in suffix order, the running sum of the places' weights: a text may stand
    for several equal ones. The text itself is not kept; what is searched for comes from outside, in streams."""

    def __init__(self, text: np.ndarray, depth: int, weight: np.ndarray | None = None) -> None:
        sigma = int(text.max(initial=0)) + 1
        order = suffix_order(text, depth)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=sigma))])
        self.matrix = WaveletMatrix(text[order - 1], sigma)
        self.shift = self.first[:-1] - self.matrix.run_start[:sigma]
        self.upto = np.arange(len(text) + 1) if weight is None else np.concatenate([[0], np.cumsum(weight[order])])

    def repeated_from(self, text: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """For each stretch text[start:end] of a stream the least j for which text[j:end] occurs twice or more in the
        indexed text (end itself if no symbol does), by backward search from its end."""
        out = ends.copy()
        lane = np.flatnonzero(ends > starts)
        at = ends[lane] - 1
        symbol = text[at]
        lo, hi = self.first[symbol], self.first[symbol + 1]
        while len(lane):
            good = self.upto[hi] - self.upto[lo] >= 2
            out[lane[good]] = at[good]
            good &= at > starts[lane]
            lane, at, lo, hi = lane[good], at[good] - 1, lo[good], hi[good]
            symbol = text[at]
            both = self.matrix.descend(np.concatenate([symbol, symbol]), np.concatenate([lo, hi]))
            lo, hi = self.shift[symbol] + both[: len(lane)], self.shift[symbol] + both[len(lane) :]
        return out


def repeated_windows(index: FMIndex, text: np.ndarray, starts: np.ndarray, windows: np.ndarray, width: int) -> np.ndarray:
    """Bit masks: bit i of a stretch of the streamed text is set if the window of `width` symbols at start + i occurs
    twice or more in the index.

    Takes the longest repeated stretch that ends where the last open window ends; where it breaks off at a symbol f,
    every window that holds f and some symbols after it is out, and the search goes on with windows that end sooner.
    """
    mask = np.zeros(len(starts), np.uint64)
    ends = starts + windows - 1 + width
    lane = np.arange(len(starts))
    while len(lane):
        s, e = starts[lane], ends[lane]
        j = index.repeated_from(text, s, e)
        # windows that start in [j, e - width]
        count = np.maximum(e - width - j + 1, 0).astype(np.uint64)
        run = np.where(count >= 64, ~np.uint64(0), (_ONE << np.minimum(count, np.uint64(63))) - _ONE)
        mask[lane] |= np.where(count > 0, run << np.minimum(j - s, 63).astype(np.uint64), np.uint64(0))
        open_ = j > s
        lane, s, e, f = lane[open_], s[open_], e[open_], j[open_] - 1
        # the shortest doubled stretch from f that does not repeat
        stop, left, reach = np.minimum(f + 1, e), np.arange(len(lane)), 1
        while len(left):
            stop[left] = np.minimum(f[left] + reach, e[left])
            bad = index.repeated_from(text, f[left], stop[left]) > f[left]
            left = left[~bad & (stop[left] < e[left])]
            reach *= 2
        ends[lane] = stop - 1
        lane = lane[stop - 1 - width >= s]
    return mask
