"""Compressed FM-index over a sequence of integers, searched backwards from many places at once."""

from __future__ import annotations

import numpy as np


class WaveletMatrix:
    """Rank queries over integers below `sigma`, in packed bits with a count for each 64 of them."""

    def __init__(self, values: np.ndarray, sigma: int):
        self.levels = max(1, int(sigma - 1).bit_length())
        self.words, self.counts, self.zeros = [], [], []
        seq = values.astype(np.uint32)
        n = len(seq)
        for level in range(self.levels):
            bit = (seq >> np.uint32(self.levels - 1 - level)) & np.uint32(1) == 1
            packed = np.zeros((n // 64 + 1) * 8, np.uint8)
            small = np.packbits(bit, bitorder="little")
            packed[: len(small)] = small
            words = packed.view("<u8")
            self.words.append(words)
            self.counts.append(np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)[:-1]]).astype(np.uint32))
            self.zeros.append(int(n - bit.sum()))
            seq = np.concatenate([seq[~bit], seq[bit]])
        self.begin = self._descend(np.arange(sigma), np.zeros(sigma, np.int64))

    def _descend(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for level in range(self.levels):
            bit = (symbol >> (self.levels - 1 - level)) & 1 == 1
            word = at >> 6
            mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
            ones = self.counts[level][word].astype(np.int64) + np.bitwise_count(self.words[level][word] & mask)
            at = np.where(bit, self.zeros[level] + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each place."""
        return self._descend(symbol, at) - self.begin[symbol]

    def access(self, at: np.ndarray) -> np.ndarray:
        """The symbol at each place."""
        symbol = np.zeros(len(at), np.int64)
        for level in range(self.levels):
            word, place = at >> 6, (at & 63).astype(np.uint64)
            own = self.words[level][word]
            bit = (own >> place) & np.uint64(1) == 1
            ones = self.counts[level][word].astype(np.int64) + np.bitwise_count(own & ((np.uint64(1) << place) - np.uint64(1)))
            symbol = symbol * 2 + bit
            at = np.where(bit, self.zeros[level] + ones, at - ones)
        return symbol


def sorted_suffixes(text: np.ndarray, depth: int) -> np.ndarray:
    """Places of the suffixes of `text` sorted by their first `depth` symbols, by doubling."""
    n = len(text)
    rank, known = text.astype(np.int64), 1
    while known < depth:
        step = min(known, depth - known)
        later = np.zeros(n, np.int64)
        later[: n - step] = rank[step:] + 1
        _, rank = np.unique(rank * (int(later.max()) + 1) + later, return_inverse=True)
        known += step
    return np.argsort(rank, kind="stable")


class FMIndex:
    """Index of a text (integers below sigma, 0 last) for matches of at most `depth` symbols.

    Kept are the wavelet matrix of the Burrows-Wheeler transform, the counts of the symbols and the places of one
    suffix in `SAMPLE`. Suffixes are ordered by their first `depth` symbols, which orders all intervals of such matches."""

    SAMPLE = 32

    def __init__(self, text: np.ndarray, suffixes: np.ndarray, sigma: int, depth: int):
        self.depth = depth
        self.wavelet = WaveletMatrix(text[suffixes - 1], sigma)
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=sigma))])
        self.rows = np.flatnonzero(suffixes % self.SAMPLE == 0)
        self.places = suffixes[self.rows].astype(np.uint32)

    def matches(self, text: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Matching statistics of a streamed text: how many symbols up to each of `ends`, at most depth, occur in more
        than one suffix of the index, and the interval of those suffixes. The search of an end stops where it is alone."""
        n = len(ends)
        length, low, high = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
        live = np.arange(n)
        lo, hi = np.zeros(n, np.int64), np.full(n, self.before[-1])
        for k in range(self.depth):
            symbol = text[ends[live] - k]
            if k:
                both = self.wavelet.rank(np.concatenate([symbol, symbol]), np.concatenate([lo, hi]))
                lo, hi = self.before[symbol] + both[: len(live)], self.before[symbol] + both[len(live) :]
            else:
                lo, hi = self.before[symbol], self.before[symbol + 1]
            go = hi - lo > 1
            live, lo, hi = live[go], lo[go], hi[go]
            if not len(live):
                break
            length[live], low[live], high[live] = k + 1, lo, hi
        return length, low, high
