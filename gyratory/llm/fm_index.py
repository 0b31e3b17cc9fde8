"""FM-index over word numbers: suffix order, wavelet matrix, backward search and sampled suffix positions."""

from __future__ import annotations

import numpy as np

_ONE = np.uint64(1)


def suffix_order(symbols: np.ndarray, bits: int) -> np.ndarray:
    """Positions in order of their suffixes. Symbol 0 separates; separators differ and sort by position.

    Several symbols are packed into one key for the first sort; then rank pairs double the compared length, for
    suffixes still tied only.
    """
    n, depth = len(symbols), max(1, 62 // bits)
    key, ended = np.zeros(n, np.int64), np.zeros(n, bool)
    for i in range(depth):
        ahead = np.zeros(n, np.int64)
        ahead[: max(0, n - i)] = symbols[i:]
        key = (key << bits) | np.where(ended, 0, ahead)
        ended |= ahead == 0
    order = np.argsort(key, kind="stable")
    fresh = np.ones(n, bool)
    fresh[1:] = (key[order][1:] != key[order][:-1]) | ended[order][1:]
    del key, ended
    rank = np.empty(n, np.int64)
    while True:
        starts = np.flatnonzero(fresh)
        sizes = np.diff(np.append(starts, n))
        rank[order] = np.repeat(starts, sizes)
        tied = np.flatnonzero(np.repeat(sizes > 1, sizes))
        if not len(tied):
            return order
        at = order[tied]
        pair = rank[at] * (n + 1) + rank[at + depth]
        moved = np.argsort(pair, kind="stable")
        order[tied], pair = at[moved], pair[moved]
        fresh[tied[1:]] = (pair[1:] != pair[:-1])
        fresh[tied[0]] = True
        depth *= 2


class Bits:
    """A bit vector with rank: number of ones before a position."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        self.words = np.zeros(len(bits) // 64 + 1, np.uint64)
        self.words.view(np.uint8)[: len(packed)] = packed
        ones = np.bitwise_count(self.words).astype(np.int64)
        self.before = np.cumsum(ones) - ones
        self.zeros = len(bits) - int(ones.sum())

    def rank(self, at: np.ndarray) -> np.ndarray:
        word, bit = self.words[at >> 6], (at & 63).astype(np.uint64)
        return self.before[at >> 6] + np.bitwise_count(word & ((_ONE << bit) - _ONE))

    def get(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64)) & _ONE


class FMIndex:
    """Index of a sequence of symbols 0..largest, where 0 separates and is never searched for."""

    def __init__(self, symbols: np.ndarray, largest: int, sample: int = 8):
        symbols = np.append(symbols, 0).astype(np.int64)
        self.n, bits = len(symbols), max(1, int(largest).bit_length())
        order = suffix_order(symbols, bits)
        last = symbols[order - 1]  # position 0 is preceded by the final separator
        self.less = np.concatenate(([0], np.cumsum(np.bincount(symbols, minlength=largest + 1))))[:-1]
        # text positions that are multiples of `sample`, and those after a separator, where walking back has to end
        held = (order % sample == 0) | (last == 0)
        self.held, self.positions = Bits(held), order[held]
        self.levels, row = [], last
        self.base = np.zeros(largest + 1, np.int64)
        symbol = np.arange(largest + 1)
        for bit in range(bits - 1, -1, -1):
            ones = (row >> bit & 1).astype(bool)
            level = Bits(ones)
            self.levels.append(level)
            row = np.concatenate((row[~ones], row[ones]))
            up = (symbol >> bit & 1).astype(bool)
            rank = level.rank(self.base)
            self.base = np.where(up, level.zeros + rank, self.base - rank)

    def _before(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of a symbol among the first `at` of the transformed text, plus the smaller symbols of the text."""
        for i, level in enumerate(self.levels):
            up = (symbol >> (len(self.levels) - 1 - i) & 1).astype(bool)
            rank = level.rank(at)
            at = np.where(up, level.zeros + rank, at - rank)
        return at - self.base[symbol] + self.less[symbol]

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges of the phrases (one a row, aligned to the right), by backward search of all of them together."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        for step in range(1, phrases.shape[1] + 1):
            live = np.flatnonzero((lengths >= step) & (low < high))
            if not len(live):
                break
            symbol = phrases[live, -step]
            low[live], high[live] = self._before(symbol, low[live]), self._before(symbol, high[live])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows, by walking back to the next sampled one."""
        out, steps = np.zeros(len(rows), np.int64), 0
        rest, at = np.arange(len(rows)), rows.astype(np.int64)
        while len(rest):
            hit = self.held.get(at).astype(bool)
            out[rest[hit]] = self.positions[self.held.rank(at[hit])] + steps
            rest, at = rest[~hit], at[~hit]
            symbol = np.zeros(len(at), np.int64)
            for level in self.levels:
                up, rank = level.get(at).astype(bool), level.rank(at)
                symbol = symbol << 1 | up
                at = np.where(up, level.zeros + rank, at - rank)
            at = at - self.base[symbol] + self.less[symbol]
            steps += 1
        return out
