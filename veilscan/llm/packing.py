"""Packing of documents into sequences of a fixed number of tokens: best fit, then a local search that swaps documents between underfull bins until bins empty."""

from __future__ import annotations

import functools
import os
import re
import struct
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import pieces, tidy
from .groups import by_key
from .storage import plain_columns, settled, small_batches

RESULT = ("piece", "start", "length", "ids_crc32", "sequence_id", "offset")
TEXT_PIECE = 1 << 20
KNOWN_WORDS = 700_000
TRAILING = re.compile(rb"(?<=[A-Za-z0-9])[.,;:!?]+(?=\s)")


@dataclass(frozen=True)
class PackSettings:
    """capacity: tokens of a sequence; end_id: put behind each document; block: pieces that one group packs; loose: share of free space from which a bin is packed again
    with those of other groups; rounds: of such packing at most; patience: bins in a row that the search fails to empty before it stops."""

    capacity: int = 4096
    end_id: int = 1
    block: int = 1 << 14
    loose: float = 1 / 64
    rounds: int = 4
    patience: int = 32


class WordIds:
    """Ids of texts as little-endian 32-bit numbers, from those of the parts between ASCII white space: the vocabulary drops white space and none of its tokens spans any. Punctuation
    behind an ASCII letter or digit and ahead of white space is a part of its own, as it is for the vocabulary. Parts are remembered until KNOWN_WORDS newer ones are known, so the size is bounded."""

    def __init__(self, tokenizer_json: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the cores belong to Spark's tasks
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def of(self, texts: list[str]) -> Iterator[bytes]:
        parts = []
        for text in texts:
            data = TRAILING.sub(_apart, text.encode())
            parts.append((data.lower() if data.isascii() else data).split())
        new = [w for w in set().union(*parts) if w not in self.known]
        if len(self.known) + len(new) > KNOWN_WORDS:
            self.known, self.older = {}, self.known
            new = list(set().union(*parts))
        again = [w for w in new if w in self.older]
        self.known.update((w, self.older[w]) for w in again)
        if again:
            new = [w for w in new if w not in self.known]
        for at in range(0, len(new), 4096):
            some = new[at : at + 4096]
            found = self.tokenizer.encode_batch_fast([w.decode() for w in some], add_special_tokens=False)
            self.known.update((w, struct.pack(f"<{len(ids)}I", *ids)) for w, ids in zip(some, (e.ids for e in found), strict=True))
        return (b"".join(map(self.known.__getitem__, words)) for words in parts)


def _apart(found: re.Match[bytes]) -> bytes:
    return b" " + found[0]


@functools.lru_cache(maxsize=1)
def word_ids(tokenizer_json: str) -> WordIds:
    """One per vocabulary and Python worker, so that the tasks of a worker share what they know."""
    return WordIds(tokenizer_json)


def _cut(tokenizer, settings: PackSettings, keep: list[str]):
    """A row per piece: documents of more than `capacity` ids are cut into pieces of that many."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, end, width = word_ids(tokenizer.value), settings.end_id.to_bytes(4, "little"), 4 * settings.capacity
        for batch in batches:
            for part in pieces(batch, TEXT_PIECE):
                rows, piece, length, crc = [], [], [], []
                for row, ids in enumerate(words.of([t or "" for t in part.column("text").to_pylist()])):
                    ids += end
                    for k, at in enumerate(range(0, len(ids), width)):
                        own = ids[at : at + width]
                        rows.append(row)
                        piece.append(k)
                        length.append(len(own) // 4)
                        crc.append(zlib.crc32(own))
                at = pa.array(rows, pa.int64())
                start = np.array(piece, dtype=np.int64) * settings.capacity
                new = [pa.array(piece, pa.int32()), pa.array(start), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays([*(part.column(c).take(at) for c in keep), *new], names=[*keep, "piece", "start", "length", "ids_crc32"])

    return run


def least_bins(sizes: np.ndarray, capacity: int) -> int:
    """A number of bins that no packing goes below: for each k, pieces over capacity - k stand alone, those over half never share, and the rest down to k fill what is left."""
    counts = np.bincount(sizes, minlength=capacity + 1)
    weight = counts * np.arange(capacity + 1)
    number, sums = np.cumsum(counts), np.cumsum(weight)
    half = capacity // 2
    best = -(-int(sums[-1]) // capacity)
    for k in range(half + 1):
        alone = int(number[capacity] - number[capacity - k])
        middle = int(number[capacity - k] - number[half])
        room = middle * capacity - int(sums[capacity - k] - sums[half])
        rest = int(sums[half] - (sums[k - 1] if k else 0))
        best = max(best, alone + middle + max(0, -(-(rest - room) // capacity)))
    return best


class Bins:
    """Bins of pieces, found by their free space. Any change raises the sum of squared fills, or adds a piece."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.members: list[list[tuple[int, int]]] = []  # (size, piece) in ascending order
        self.fill: list[int] = []
        self.by_free: list[dict[int, None]] = [{} for _ in range(capacity + 1)]
        self.frees = 0  # bit f: some bin has f free
        self.moves = [0, 0, 0]  # documents moved, one-for-one and two-for-one exchanges

    @property
    def used(self) -> int:
        return sum(map(bool, self.members))

    def _free(self, b: int, add: bool) -> None:
        f = self.capacity - self.fill[b]
        if add:
            self.by_free[f][b] = None
            self.frees |= 1 << f
        else:
            del self.by_free[f][b]
            if not self.by_free[f]:
                self.frees &= ~(1 << f)

    def open(self, members: list[tuple[int, int]]) -> int:
        self.members.append(sorted(members))
        self.fill.append(sum(s for s, _ in members))
        self._free(len(self.fill) - 1, True)
        return len(self.fill) - 1

    def best_fit(self, size: int) -> int | None:
        """The bin with the least free space that takes the size."""
        fit = self.frees >> size
        return next(iter(self.by_free[size + (fit & -fit).bit_length() - 1])) if fit else None

    def exchange(self, a: int, out: list[tuple[int, int]], b: int, back: list[tuple[int, int]]) -> None:
        """Pieces `out` of bin a go to bin b, pieces `back` of b to a."""
        for x in (a, b):
            self._free(x, False)
        for x, gone, come in ((a, out, back), (b, back, out)):
            for m in gone:
                self.members[x].remove(m)
            self.members[x] = sorted(self.members[x] + come)
            self.fill[x] += sum(s for s, _ in come) - sum(s for s, _ in gone)
            self._free(x, True)

    def put(self, size: int, piece: int) -> None:
        b = self.best_fit(size)
        if b is None:
            self.open([(size, piece)])
        else:
            self._free(b, False)
            self.members[b] = sorted([*self.members[b], (size, piece)])
            self.fill[b] += size
            self._free(b, True)

    def _move_out(self, a: int) -> None:
        """Moves pieces of bin a, large ones first, to the bins they fit best."""
        self._free(a, False)
        left = []
        for m in reversed(self.members[a]):
            b = self.best_fit(m[0])
            if b is None:
                left.append(m)
                continue
            self._free(b, False)
            self.members[b] = sorted([*self.members[b], m])
            self.fill[b] += m[0]
            self._free(b, True)
            self.moves[0] += 1
        self.members[a] = left[::-1]
        self.fill[a] = sum(s for s, _ in left)
        self._free(a, True)

    def _swap_one(self, a: int, b: int) -> bool:
        """The one-for-one exchange that moves most from bin a to bin b."""
        free, theirs, best = self.capacity - self.fill[b], self.members[b], (0, None, None)
        for m in self.members[a]:
            k = bisect_left(theirs, (m[0] - free, -1))
            if k < len(theirs) and m[0] - theirs[k][0] > best[0]:
                best = (m[0] - theirs[k][0], m, theirs[k])
        if best[0]:
            self.exchange(a, [best[1]], b, [best[2]])
            self.moves[1] += 1
        return best[0] > 0

    def _swap_two(self, a: int, b: int, pairs: list[tuple[int, tuple[int, int], tuple[int, int]]]) -> bool:
        """The two-for-one exchange, either way round, that moves most from bin a to bin b; pairs: of bin a, ascending."""
        free, best = self.capacity - self.fill[b], (0, None, None)
        for y in self.members[b]:
            k = bisect_right(pairs, (y[0] + free, (self.capacity + 1, 0))) - 1
            if k >= 0 and pairs[k][0] - y[0] > best[0]:
                best = (pairs[k][0] - y[0], list(pairs[k][1:]), [y])
        sizes = self.members[a]
        for two in combinations(_distinct(self.members[b], 2), 2):
            small = two[0][0] + two[1][0]
            k = bisect_right(sizes, (small + free, self.capacity << 40)) - 1
            if k >= 0 and sizes[k][0] - small > best[0]:
                best = (sizes[k][0] - small, [sizes[k]], list(two))
        if best[0]:
            self.exchange(a, best[1], b, best[2])
            self.moves[2] += 1
        return best[0] > 0

    def drain(self, a: int) -> bool:
        """Empties bin a, the least filled, as far as moves and exchanges go; each makes a fuller bin fuller."""
        while True:
            self._move_out(a)
            if not self.members[a]:
                self._free(a, False)
                return True
            others = [b for f in range(self.capacity, 0, -1) for b in self.by_free[f] if b != a and self.members[b]]
            if sum([self._swap_one(a, b) for b in others]):
                continue
            found = False
            for b in others:
                pairs = sorted((x[0] + y[0], x, y) for x, y in combinations(_distinct(self.members[a], 2), 2))
                found |= self._swap_two(a, b, pairs)
            if not found:
                return False

    def squeeze(self, least: int, patience: int) -> None:
        """Drains bins, the least filled first, until `least` are left or `patience` bins in a row resist."""
        again, alive = True, self.used
        while again and alive > least:
            again, failed, tried = False, 0, set()
            for a in sorted((b for b, m in enumerate(self.members) if m), key=lambda b: self.fill[b]):
                if alive <= least or failed >= patience:
                    break
                if a in tried or not self.members[a]:
                    continue
                tried.add(a)
                if self.drain(a):
                    alive, again, failed = alive - 1, True, 0
                else:
                    failed += 1


def _distinct(members: list[tuple[int, int]], most: int) -> list[tuple[int, int]]:
    """Sorted members with at most `most` of each size: more of one size offer no other exchange. A bin has fewer distinct sizes than the square root of twice its capacity."""
    return [m for k, m in enumerate(members) if k < most or members[k - most][0] != m[0]]


def filled(sizes: list[int], order: list[int], capacity: int) -> Bins:
    """All pieces in bins by best fit, in the given order."""
    bins = Bins(capacity)
    for k in order:
        bins.put(sizes[k], k)
    return bins


def pack(sizes: list[int], given: list[int] | None, settings: PackSettings) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[int]]:
    """The bin of each piece, its offset there, the fill of its bin, and the numbers of moves and exchanges.

    `given`: a bin number per piece to search from. Without, the search starts from a best fit of the pieces by descending size, and where that ends above the bound once more from a best fit in their own order."""
    least = least_bins(np.array(sizes, dtype=np.int64), settings.capacity)
    if given is None:
        bins = filled(sizes, sorted(range(len(sizes)), key=lambda k: -sizes[k]), settings.capacity)
        bins.squeeze(least, settings.patience)
        if bins.used > least:
            other = filled(sizes, list(range(len(sizes))), settings.capacity)
            other.squeeze(least, settings.patience)
            bins = min(bins, other, key=lambda b: b.used)
    else:
        bins = Bins(settings.capacity)
        start: dict[int, list[tuple[int, int]]] = {}
        for k, (s, g) in enumerate(zip(sizes, given, strict=True)):
            start.setdefault(g, []).append((s, k))
        for members in start.values():
            bins.open(members)
        bins.squeeze(least, settings.patience)
    where, offset, fill = (np.zeros(len(sizes), dtype=np.int64) for _ in range(3))
    for number, members in enumerate(m for m in bins.members if m):
        at = 0
        for size, k in members:
            where[k], offset[k] = number, at
            at += size
        fill[[k for _, k in members]] = at
    return where, offset, fill, bins.moves


def _pack_blocks(settings: PackSettings, round_number: int, carried: list[str]):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in by_key(batches, ["block"]):
            given = rows["sequence_id"].to_pylist() if round_number else None
            where, offset, fill, _ = pack(rows["length"].to_pylist(), given, settings)
            name = (round_number << 58) + (rows["block"][0].as_py() << 20)
            yield pa.RecordBatch.from_arrays([*(rows[c] for c in carried), pa.array(where + name), pa.array(offset), pa.array(fill)], names=[*carried, "sequence_id", "offset", "_fill"])

    return run


def packed(docs: DataFrame, tokenizer_json: str, settings: PackSettings = PackSettings()) -> DataFrame:
    """docs (text, ...) -> a row per piece: the columns of docs without text, and piece, start, length, ids_crc32, sequence_id, offset.

    A document is its ids and end_id behind them; one longer than a sequence is cut into pieces of that length, all others stay whole. tokenizer_json is the content of a vocabulary file.

    Texts don't travel: pieces are written as slim rows and dealt to blocks of about `block` pieces by their place in that table, so no key makes a large block. A block puts its pieces in by best
    fit, large ones first, and then searches locally: the least filled bin gives documents to bins they fit, changes one for one, then two for one (either way round), each time so that the fuller bin gets fuller and the sum
    of squared fills grows; when it is empty it is gone. The search ends at a bound that no packing beats, or when `patience` bins in a row resist. Bins that are still loose then meet those
    of other blocks, in fewer blocks, as long as a round saves bins.

    A null or empty text is end_id alone. Repeated rows and ids are packed each for itself; a null id stays null. sequence_id is any number, unique per sequence; offsets are gapless from 0. An empty
    table gives no rows. Columns named like a result are replaced.
    """
    keep = [c for c in plain_columns(docs, *RESULT) if c != "text"]
    small_batches(docs)
    given = docs.sparkSession.sparkContext.broadcast(tokenizer_json)
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema]
    cut = settled(docs.select(*keep, "text").mapInArrow(_cut(given, settings, keep), ", ".join([*kinds, "piece int, start long, length long, ids_crc32 long"])), "pieces")
    carried = cut.columns
    rows, done, blocks, bins = cut, [], max(1, -(-cut.count() // settings.block)), None
    for round_number in range(settings.rounds):
        name = F.xxhash64(F.lit(round_number), "sequence_id" if round_number else F.monotonically_increasing_id())
        dealt = rows.withColumn("block", F.pmod(name, F.lit(blocks)).cast("int")).repartition("block").sortWithinPartitions("block")
        kind = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema), "sequence_id long, offset long, _fill long"])
        found = settled(dealt.mapInArrow(_pack_blocks(settings, round_number, carried), kind), "packed")
        loose = found.where(F.col("_fill") < F.lit(int(settings.capacity * (1 - settings.loose))))
        left = loose.agg(F.count("*").alias("pieces"), F.count_if(F.col("offset") == 0).alias("bins")).first()
        now = found.where("offset = 0").count()
        saved = bins is None or now < bins
        if blocks == 1 or not saved or left["bins"] < 2 or round_number == settings.rounds - 1:
            done.append(found)
            break
        done.append(found.where(F.col("_fill") >= F.lit(int(settings.capacity * (1 - settings.loose)))))
        rows, blocks, bins = loose.select(*carried, "sequence_id"), max(1, -(-left["pieces"] // settings.block)), left["bins"]
    result = done[0]
    for more in done[1:]:
        result = result.unionByName(more)
    return result.select(*keep, *RESULT)
