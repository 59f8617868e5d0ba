"""Words and hashes of whole texts as NumPy arrays over Arrow buffers. A word is what the pattern
`[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` finds after lower-casing A-Z; on UTF-8 bytes that is any run of 0-9, a-z and bytes from 0x80."""

from __future__ import annotations

import ctypes
import functools
import hashlib
import sys
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WORD_REGEX = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_WORD = np.zeros(256, dtype=bool)
IS_WORD[48:58] = IS_WORD[65:91] = IS_WORD[97:123] = IS_WORD[128:] = True

_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_PIECE = 1 << 20
_powers: dict[int, np.ndarray] = {}


def tidy(run):
    """A function of batches that gives freed memory back to the system when its task ends; else idle Python workers hold what their largest task took."""

    @functools.wraps(run)
    def tidied(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if sys.platform == "linux":
                getattr(ctypes.CDLL(None), "malloc_trim", int)(0)

    return tidied


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), modulo 2 ** 64."""
    known = _powers.get(base)
    if known is None or len(known) < n:
        steps = np.full(max(n, _PIECE), base, dtype=np.uint64)
        steps[0] = 1
        known = _powers[base] = np.cumprod(steps, dtype=np.uint64)
    return known


def constants(n: int, seed: int) -> np.ndarray:
    """n odd 64-bit constants."""
    return mix64(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(_BASE) + np.uint64(seed)) | np.uint64(1)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts of a column behind one another, and the n + 1 offsets of the texts; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, dtype=np.int64)
    whole = np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, dtype=np.uint8)
    return whole, at - at[0]


@dataclass
class Words:
    """Byte ranges and hashes of the words of a column of texts; text i has the words bounds[i] .. bounds[i + 1]."""

    start: np.ndarray
    stop: np.ndarray
    hash: np.ndarray
    bounds: np.ndarray

    @property
    def per_text(self) -> np.ndarray:
        return np.diff(self.bounds)

    @property
    def text(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), self.per_text)


def words_of(data: np.ndarray, offsets: np.ndarray, hashes: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray] | None = None) -> Words:
    """The words of texts; hashes: word_hashes where equal hashes are to mean equal words, else run_hashes, which unlike words of a thousand characters may share."""
    inside = IS_WORD[data]
    n = len(data)
    edges = offsets[(offsets > 0) & (offsets < n)]
    before = np.zeros(n, dtype=bool)
    before[1:] = inside[:-1]
    before[edges] = False
    start = np.flatnonzero(inside & ~before)
    after = np.zeros(n, dtype=bool)
    after[:-1] = inside[1:]
    after[edges - 1] = False
    stop = np.flatnonzero(inside & ~after) + 1
    return Words(start, stop, (hashes or run_hashes)(LOWER[data], start, stop), np.searchsorted(start, offsets))


def run_hashes(data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte range; the ranges are in order and don't overlap."""
    out = np.empty(len(start), dtype=np.uint64)
    at = 0
    while at < len(start):
        first = start[at]
        to = max(at + 1, int(np.searchsorted(stop, first + _PIECE, side="right")))
        piece = data[first : stop[to - 1]].astype(np.uint64) + np.uint64(1)
        piece *= powers(_BASE, len(piece))[: len(piece)]
        sums = np.zeros(len(piece) + 1, dtype=np.uint64)
        np.cumsum(piece, out=sums[1:])
        s, e = start[at:to] - first, stop[at:to] - first
        out[at:to] = (sums[e] - sums[s]) * powers(_BASE_INVERSE, len(piece) + 1)[s] + (e - s).astype(np.uint64)
        at = to
    return mix64(out)


def word_hashes(data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte range, in which every eight bytes are mixed into what stands before them; ranges of up to eight bytes without zeros never share one, others by chance alone."""
    sizes = stop - start
    out = np.full(len(start), _BASE, dtype=np.uint64)
    for k in np.flatnonzero(sizes > 256):
        out[k] = int.from_bytes(hashlib.blake2b(data[start[k] : stop[k]].tobytes(), digest_size=8).digest(), "little")
    eights = np.ndarray(len(data) + 1, dtype="<u8", buffer=np.concatenate([data, np.zeros(8, dtype=np.uint8)]), strides=(1,))
    left = np.flatnonzero((sizes > 0) & (sizes <= 256))
    at = 0
    while len(left):
        unused = np.maximum(at + 8 - sizes[left], 0).astype(np.uint64) * np.uint64(8)
        out[left] = mix64(out[left] ^ ((eights[start[left] + at] << unused) >> unused)) + np.uint64(_BASE)
        at += 8
        left = left[sizes[left] > at]
    return out


def ngram_hashes(words: Words, n: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n consecutive words at each place, and the bounds by text. A text of fewer words, but not none, has one: all of its words."""
    counts = words.per_text
    grams = np.where(counts >= n, counts - n + 1, (counts > 0).astype(np.int64))
    bounds = np.zeros(len(counts) + 1, dtype=np.int64)
    np.cumsum(grams, out=bounds[1:])
    first = np.arange(bounds[-1]) - np.repeat(bounds[:-1] - words.bounds[:-1], grams)
    have = np.repeat(np.minimum(counts, n), grams)
    weights = constants(n, seed)
    short = bool((have < n).any())
    out = have.astype(np.uint64)
    for k in range(n):
        at = np.minimum(first + k, max(len(words.hash) - 1, 0))
        part = words.hash[at] * weights[k]
        out += np.where(have > k, part, np.uint64(0)) if short else part
    return mix64(out), bounds


def slices(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about `most` units each; a larger text stands alone."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1)
        yield at, to
        at = to


def pieces(batch: pa.RecordBatch, most: int, column: str = "text") -> Iterator[pa.RecordBatch]:
    """A batch in parts of about `most` bytes of text each, so that what is computed beside the texts stays small; a larger text stands alone."""
    offsets = np.zeros(batch.num_rows + 1, dtype=np.int64)
    np.cumsum(pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False), out=offsets[1:])
    for at, to in slices(offsets, most):
        yield batch.slice(at, to - at)


def distinct_by_text(values: np.ndarray, bounds: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of values below 2 ** bits: the distinct ones of each text, how often they stand there, and the new bounds."""
    texts = np.repeat(np.arange(len(bounds) - 1, dtype=np.int64), np.diff(bounds))
    keys, counts = np.unique((texts << bits) | values.astype(np.int64), return_counts=True)
    return keys & ((1 << bits) - 1), counts, np.searchsorted(keys >> bits, np.arange(len(bounds)))


def binary_lists(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """A binary value per text, with the bytes of its values."""
    values = np.ascontiguousarray(values)
    at = (np.asarray(bounds, dtype=np.int64) * values.dtype.itemsize).astype(np.int64)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at.tobytes()), pa.py_buffer(values.tobytes())]).cast(pa.binary())


def with_columns(batch: pa.RecordBatch, keep: list[str], **new: pa.Array) -> pa.RecordBatch:
    """The kept columns of a batch, and new ones behind them."""
    return pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + list(new.values()), names=[*keep, *new])
