"""An FM-index over a sequence of numbers: suffix order, wavelet matrix with rank, backward search, and location by sampled suffix positions. Number 0 separates
runs; patterns never hold it. All calls take arrays of queries."""

from __future__ import annotations

import numpy as np

_ONE = np.uint64(1)


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Starts of the suffixes in their order, by prefix doubling. Each 0 is less than any other number and unlike the other zeros, so no comparison passes one."""
    n = len(symbols)
    zeros = np.flatnonzero(symbols == 0)
    rank = symbols.astype(np.int64) + len(zeros)
    rank[zeros] = np.arange(len(zeros))
    width = 1
    while True:
        after = np.zeros(n, dtype=np.int64)
        after[: n - width] = rank[width:] + 1
        key = rank * (int(rank.max()) + 2) + after if int(rank.max()) < 2**31 else None
        order = np.argsort(key, kind="stable") if key is not None else np.lexsort((after, rank))
        new = np.ones(n, dtype=np.int64)
        new[0] = 0
        same = (rank[order[1:]] == rank[order[:-1]]) & (after[order[1:]] == after[order[:-1]])
        new[1:][same] = 0
        rank = np.empty(n, dtype=np.int64)
        rank[order] = np.cumsum(new)
        width *= 2
        if int(rank.max()) == n - 1 or width > n:
            return order


class Bits:
    """Bits with rank: how many are set before a place."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        self.words = np.zeros(len(bits) // 64 + 1, dtype=np.uint64)
        self.words.view(np.uint8)[: len(packed)] = packed
        self.before = np.zeros(len(self.words) + 1, dtype=np.int64)
        np.cumsum(np.bitwise_count(self.words), out=self.before[1:])

    def rank(self, at: np.ndarray) -> np.ndarray:
        word = at >> 6
        mask = (_ONE << (at & 63).astype(np.uint64)) - _ONE
        return self.before[word] + np.bitwise_count(self.words[word] & mask)

    def get(self, at: np.ndarray) -> np.ndarray:
        return ((self.words[at >> 6] >> (at & 63).astype(np.uint64)) & _ONE).astype(bool)


class Wavelet:
    """The wavelet matrix of a sequence: a bit plane per binary digit, highest first, each stably parted by the planes above."""

    def __init__(self, values: np.ndarray, most: int):
        self.digits = max(1, int(most).bit_length())
        self.planes: list[Bits] = []
        self.zeros: list[int] = []
        for d in reversed(range(self.digits)):
            bits = ((values >> d) & 1).astype(bool)
            self.planes.append(Bits(bits))
            self.zeros.append(int(len(bits) - bits.sum()))
            values = np.concatenate([values[~bits], values[bits]])

    def rank(self, value: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each value stands before each place."""
        start = np.zeros_like(at)
        for d, plane, zeros in zip(reversed(range(self.digits)), self.planes, self.zeros, strict=True):
            one = ((value >> d) & 1).astype(bool)
            r, s = plane.rank(at), plane.rank(start)
            at = np.where(one, zeros + r, at - r)
            start = np.where(one, zeros + s, start - s)
        return at - start

    def get(self, at: np.ndarray) -> np.ndarray:
        value = np.zeros_like(at)
        for plane, zeros in zip(self.planes, self.zeros, strict=True):
            one = plane.get(at)
            r = plane.rank(at)
            at = np.where(one, zeros + r, at - r)
            value = value * 2 + one
        return value


class FmIndex:
    """symbols: runs of numbers from 1 up, a 0 behind each run. Every `step`th place and the first place of each run are sampled."""

    def __init__(self, symbols: np.ndarray, step: int = 16):
        symbols = symbols.astype(np.int64)
        self.length = len(symbols)
        order = suffix_order(symbols)
        self.last = Wavelet(symbols[order - 1], int(symbols.max()))  # the symbol before the first is the closing 0
        self.first = np.concatenate([[0], np.cumsum(np.bincount(symbols))])
        sampled = (order % step == 0) | (symbols[order - 1] == 0)
        self.sampled = Bits(sampled)
        self.positions = order[sampled]

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search of all patterns at once (a line each, filled up at the end): the range of suffixes that begin with each."""
        low, high = np.zeros(len(patterns), dtype=np.int64), np.full(len(patterns), self.length, dtype=np.int64)
        for k in range(int(lengths.max(initial=0))):
            live = np.flatnonzero((lengths > k) & (low < high))
            symbol = patterns[live, lengths[live] - 1 - k]
            known = symbol + 1 < len(self.first)
            high[live[~known]] = low[live[~known]] = 0
            live, symbol = live[known], symbol[known]
            low[live] = self.first[symbol] + self.last.rank(symbol, low[live])
            high[live] = self.first[symbol] + self.last.rank(symbol, high[live])
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The places of suffixes by their rank: steps back to a sampled place, and its position plus the steps."""
        out = np.zeros(len(rows), dtype=np.int64)
        left, at, steps = np.arange(len(rows)), rows.astype(np.int64), 0
        while len(left):
            hit = self.sampled.get(at)
            out[left[hit]] = self.positions[self.sampled.rank(at[hit])] + steps
            left, at = left[~hit], at[~hit]
            symbol = self.last.get(at)
            at = self.first[symbol] + self.last.rank(symbol, at)
            steps += 1
        return out
