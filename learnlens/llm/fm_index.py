"""An FM-index over a sequence of small integers, in numpy: many patterns are searched, and many occurrences located, at a time."""

from __future__ import annotations

import numpy as np


def suffix_array(text: np.ndarray, sigma: int) -> np.ndarray:
    """The sorted order of all suffixes of `text`, whose last symbol is 0 and occurs nowhere else; symbols are below `sigma`.

    Prefix doubling from as many symbols as fit one 62-bit key; only suffixes that still tie are sorted again.
    """
    n, bits = len(text), max(1, int(sigma - 1).bit_length())
    depth = 62 // bits
    key = np.zeros(n, dtype=np.int64)
    for k in range(depth):
        key <<= bits
        key[: max(n - k, 0)] |= text[k:]
    order = np.argsort(key, kind="stable")
    key = key[order]
    head = np.append(True, key[1:] != key[:-1])
    start = np.maximum.accumulate(np.where(head, np.arange(n), 0))  # of each place's group of equal prefixes
    rank = np.empty(n, dtype=np.int64)
    rank[order] = start
    tied = np.flatnonzero(~head | ~np.append(head[1:], True))
    while len(tied):
        some = order[tied]
        # A suffix that ends within `depth` symbols holds the final 0 and ties with none, so the place below exists.
        key = rank[some] * n + rank[some + depth]
        again = np.argsort(key, kind="stable")
        key, some = key[again], some[again]
        order[tied] = some
        head = np.append(True, key[1:] != key[:-1])
        rank[some] = np.maximum.accumulate(np.where(head, tied, 0))
        tied = tied[~head | ~np.append(head[1:], True)]
        depth *= 2
    return order


class Bits:
    """A bit vector with rank in constant time: 64-bit words and the number of ones before each."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        self.words = np.zeros(len(bits) // 64 + 1, dtype=np.uint64)
        self.words.view(np.uint8)[: len(packed)] = packed
        self.before = np.append(0, np.cumsum(np.bitwise_count(self.words), dtype=np.int64))

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        word, bit = at >> 6, (at & 63).astype(np.uint64)
        return self.before[word] + np.bitwise_count(self.words[word] & ((np.uint64(1) << bit) - np.uint64(1)))

    def get(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) != 0


class Wavelet:
    """A wavelet tree in matrix form, one bit vector per bit of the symbols."""

    def __init__(self, symbols: np.ndarray, sigma: int):
        self.levels: list[tuple[int, Bits, int]] = []
        for shift in reversed(range(max(1, int(sigma - 1).bit_length()))):
            ones = (symbols >> shift) & 1 == 1
            self.levels.append((shift, Bits(ones), int(len(ones) - ones.sum())))
            symbols = np.concatenate([symbols[~ones], symbols[ones]])
        self.first = self._down(np.arange(sigma), np.zeros(sigma, dtype=np.int64))

    def _down(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for shift, bits, zeros in self.levels:
            ones = bits.rank(at)
            at = np.where((symbol >> shift) & 1 == 1, zeros + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before its place."""
        return self._down(symbol, at) - self.first[symbol]

    def access(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each place, and how often it occurs before."""
        symbol = np.zeros(len(at), dtype=np.int64)
        for shift, bits, zeros in self.levels:
            one, ones = bits.get(at), bits.rank(at)
            symbol |= one.astype(np.int64) << shift
            at = np.where(one, zeros + ones, at - ones)
        return symbol, at - self.first[symbol]


class FMIndex:
    """`text` ends with its only 0; every `sample`-th place of the text keeps its place in the suffix order."""

    def __init__(self, text: np.ndarray, sigma: int, sample: int = 8):
        order = suffix_array(text, sigma)
        self.size = len(text)
        self.below = np.append(0, np.cumsum(np.bincount(text, minlength=sigma)))
        self.tree = Wavelet(text[order - 1], sigma)
        kept = order % sample == 0
        self.marked, self.places = Bits(kept), order[kept]

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The range [low, high) of suffixes that begin with each pattern (a row of symbols, padded on the right), from its last symbol to its first."""
        low, high = np.zeros(len(patterns), dtype=np.int64), np.full(len(patterns), self.size)
        for step in range(int(lengths.max(initial=0))):
            live = np.flatnonzero((lengths > step) & (low < high))
            symbol = patterns[live, lengths[live] - 1 - step]
            low[live] = self.below[symbol] + self.tree.rank(symbol, low[live])
            high[live] = self.below[symbol] + self.tree.rank(symbol, high[live])
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The place in the text of each suffix: steps back to a sampled one are counted."""
        out, at, which, steps = np.zeros(len(rows), dtype=np.int64), rows.copy(), np.arange(len(rows)), 0
        while len(which):
            found = self.marked.get(at)
            out[which[found]] = self.places[self.marked.rank(at[found])] + steps
            which, at = which[~found], at[~found]
            symbol, before = self.tree.access(at)
            at = self.below[symbol] + before
            steps += 1
        return out
