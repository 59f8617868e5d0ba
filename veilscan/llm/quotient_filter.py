"""Counting quotient filters over packed word-number n-grams: an invertible permutation, quotients as bit vectors, whole remainders, short counters. Nothing is lost, so they can be unpacked and merged."""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np

from .arrays import mix64

_ROUNDS = (0x243F6A8885A308D3, 0x13198A2E03707344, 0xA4093822299F31D0, 0x082EFA98EC4E6C89)
_HEAD = struct.Struct("<BBBQQ")


def halves(n: int) -> tuple[int, int]:
    """How many of n words stand in the left and in the right half of the packed n-gram."""
    return n // 2, n - n // 2


def packed_ngrams(words: list[np.ndarray], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Columns of word numbers below 2 ** bits (32 at most) -> the two halves of the packed n-grams."""
    left, _ = halves(len(words))
    out = []
    for part in (words[:left], words[left:]):
        value = np.zeros(len(words[0]), dtype=np.uint64)
        for w in part:
            value = (value << np.uint64(bits)) | w.astype(np.uint64)
        out.append(value)
    return out[0], out[1]


def unpacked_ngrams(left: np.ndarray, right: np.ndarray, n: int, bits: int) -> list[np.ndarray]:
    words: list[np.ndarray] = []
    for value, count in zip((left, right), halves(n), strict=True):
        words += [((value >> np.uint64(bits * k)) & _mask(bits)).astype(np.int64) for k in reversed(range(count))]
    return words


def _mask(bits: int) -> np.uint64:
    return np.uint64((1 << bits) - 1)


def permuted(left: np.ndarray, right: np.ndarray, left_bits: int, right_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """A bijection of pairs (a number of left_bits, one of right_bits): each half in turn takes up a hash of the other."""
    for k, seed in enumerate(_ROUNDS):
        if k % 2:
            right = right ^ (mix64(left + np.uint64(seed)) & _mask(right_bits))
        else:
            left = left ^ (mix64(right + np.uint64(seed)) & _mask(left_bits))
    return left, right


def restored(left: np.ndarray, right: np.ndarray, left_bits: int, right_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The inverse of permuted."""
    for k, seed in reversed(list(enumerate(_ROUNDS))):
        if k % 2:
            right = right ^ (mix64(left + np.uint64(seed)) & _mask(right_bits))
        else:
            left = left ^ (mix64(right + np.uint64(seed)) & _mask(left_bits))
    return left, right


def summed(left: np.ndarray, right: np.ndarray, counts: np.ndarray | None, left_bits: int, right_bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct pairs and the sums of their counts (1 each where None). All left halves agree above their left_bits low bits; pairs of 64 bits at most are sorted as one number each."""
    if not len(left):
        return left, right, np.zeros(0, dtype=np.int64)
    if left_bits + right_bits <= 64:
        above = left[0] & ~_mask(left_bits)
        key = ((left & _mask(left_bits)) << np.uint64(right_bits)) | right if right_bits < 64 else right
        if counts is None:
            key = np.sort(key)
        else:
            order = np.argsort(key)
            key, counts = key[order], counts[order]
        at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size = len(key)
        key = key[at]
        left, right = above | (key >> np.uint64(right_bits) if right_bits < 64 else np.uint64(0)), key & _mask(right_bits)
        left = np.broadcast_to(left, right.shape)
    else:
        order = np.lexsort((right, left))
        left, right = left[order], right[order]
        counts = None if counts is None else counts[order]
        at = np.flatnonzero(np.concatenate([[True], (left[1:] != left[:-1]) | (right[1:] != right[:-1])]))
        size = len(left)
        left, right = left[at], right[at]
    sums = np.diff(np.append(at, size)) if counts is None else np.add.reduceat(counts, at)
    return left, right, sums.astype(np.int64)


def _planes(values: np.ndarray, size: int) -> bytes:
    """The low `size` bytes of each number, byte by byte of all numbers."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size].T).tobytes()


def _from_planes(data: memoryview, n: int, size: int) -> np.ndarray:
    out = np.zeros((n, 8), dtype=np.uint8)
    out[:, :size] = np.frombuffer(data, dtype=np.uint8, count=n * size).reshape(size, n).T
    return out.reshape(-1).view("<u8").astype(np.uint64)


@dataclass(frozen=True)
class CountingFilter:
    """Sorted distinct permuted n-grams with counts, and their packed form.

    Of the left half's bits the part number takes the top ones (all entries of a filter share it), the quotient the next ones, the rest and the right half are the remainder. Packed: a bit per quotient
    that occurs, a bit per entry that ends the run of its quotient, the remainders in whole bytes, a bit per entry with a count above one, and those counts in as few bytes as the largest needs."""

    left: np.ndarray
    right: np.ndarray
    counts: np.ndarray

    def pack(self, left_bits: int, right_bits: int, part_bits: int) -> bytes:
        n, own = len(self.left), left_bits - part_bits
        choices = [q for q in range(own + 1) if q <= 40 and (own - q) % 8 == 0 or q == own]
        quotient_bits = min((q for q in choices if q <= 40), key=lambda q: (1 << q) + n * 8 * -(-(own - q) // 8), default=0)
        rest_bits = own - quotient_bits
        low = self.left & _mask(own) if own < 64 else self.left
        quotient = (low >> np.uint64(rest_bits)).astype(np.int64) if rest_bits < 64 else np.zeros(n, dtype=np.int64)
        occupied = np.zeros(1 << quotient_bits, dtype=bool)
        occupied[quotient] = True
        ends = np.ones(n, dtype=bool)
        ends[:-1] = quotient[1:] != quotient[:-1]
        many = self.counts > 1
        more = self.counts[many].astype(np.uint64)
        width = max(1, -(-int(more.max(initial=0)).bit_length() // 8))
        head = _HEAD.pack(quotient_bits, width, part_bits, n, len(more))
        remainder = _planes(low & _mask(rest_bits) if rest_bits < 64 else low, -(-rest_bits // 8)) + _planes(self.right, -(-right_bits // 8))
        return b"".join([head, np.packbits(occupied).tobytes(), np.packbits(ends).tobytes(), np.packbits(many).tobytes(), remainder, _planes(more, width)])

    @staticmethod
    def unpack(data: bytes, left_bits: int, right_bits: int, part: int) -> CountingFilter:
        quotient_bits, width, part_bits, n, more = _HEAD.unpack_from(data)
        own = left_bits - part_bits
        rest_bits = own - quotient_bits
        view, at = memoryview(data), _HEAD.size

        def take(size: int) -> memoryview:
            nonlocal at
            at += size
            return view[at - size : at]

        def bits(count: int) -> np.ndarray:
            return np.unpackbits(np.frombuffer(take(-(-count // 8)), dtype=np.uint8), count=count).astype(bool)

        occupied, ends, many = bits(1 << quotient_bits), bits(n), bits(n)
        run = np.zeros(n, dtype=np.int64)
        run[1:] = np.cumsum(ends[:-1])
        quotient = np.flatnonzero(occupied)[run].astype(np.uint64)
        low = _from_planes(take(n * -(-rest_bits // 8)), n, -(-rest_bits // 8))
        right = _from_planes(take(n * -(-right_bits // 8)), n, -(-right_bits // 8))
        if rest_bits < 64:
            low |= quotient << np.uint64(rest_bits)
        if own < 64:
            low |= np.uint64(part << own)
        counts = np.ones(n, dtype=np.int64)
        counts[many] = _from_planes(take(more * width), more, width).astype(np.int64)
        return CountingFilter(low, right, counts)

    @staticmethod
    def merged(filters: list[CountingFilter], left_bits: int, right_bits: int, part_bits: int) -> CountingFilter:
        """One filter of all entries of filters of one part."""
        both = (np.concatenate(columns) for columns in zip(*((f.left, f.right, f.counts) for f in filters), strict=True))
        return CountingFilter(*summed(*both, left_bits - part_bits, right_bits))
