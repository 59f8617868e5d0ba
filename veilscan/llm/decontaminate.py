"""Benchmark decontamination: an FM-index per shard of training documents, searched backward for the phrases of the benchmark."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import binary_lists, pieces, text_bytes, tidy, with_columns, word_hashes, words_of
from .fm_index import FmIndex
from .storage import plain_columns, small_batches

RESULT = ("n_words", "n_hit", "hits", "items", "spans")
SHARD_BYTES = 1 << 22


@dataclass
class Phrases:
    """Distinct phrases of a block of the benchmark as lines of word numbers, and the items each comes from."""

    vocabulary: np.ndarray  # sorted word hashes; word number = place + 1
    patterns: np.ndarray
    lengths: np.ndarray
    items: np.ndarray  # places, in item_ids, of the items of all phrases behind one another
    item_bounds: np.ndarray
    item_ids: list  # of any type; null where an item has none


def phrases_of(item_ids: list, texts: list[str | None], width: int) -> Phrases:
    """Every `width` consecutive words of an item; an item of fewer, but not none, is one phrase."""
    words = words_of(*text_bytes(pa.array(texts, pa.string())), word_hashes)
    vocabulary, numbers = np.unique(words.hash, return_inverse=True)
    counts = words.per_text
    starts, lengths, owners = [], [], []
    for i in np.flatnonzero(counts):
        n = max(1, int(counts[i]) - width + 1)
        starts.append(words.bounds[i] + np.arange(n))
        lengths.append(np.full(n, min(width, counts[i])))
        owners.append(np.full(n, i))
    if not starts:
        return Phrases(vocabulary, np.zeros((0, width), dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(1, dtype=np.int64), [])
    start, length, owner = map(np.concatenate, (starts, lengths, owners))
    columns = np.arange(width)
    table = np.where(columns < length[:, None], numbers[np.minimum(start[:, None] + columns, len(numbers) - 1)] + 1, 0)
    patterns, which = np.unique(table, axis=0, return_inverse=True)
    pairs = np.unique(np.stack([which.ravel(), owner], axis=1), axis=0)
    return Phrases(vocabulary, patterns, (patterns > 0).sum(axis=1), pairs[:, 1], np.searchsorted(pairs[:, 0], np.arange(len(patterns) + 1)), item_ids)


def hits_of_shard(numbers: np.ndarray, bounds: np.ndarray, phrases: Phrases) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """numbers: of the words of a shard's texts, 0 for words that no phrase has -> places and lengths of all occurrences, and the phrase of each.

    Words of no phrase, and text ends, part the shard into runs. A run shorter than the shortest phrase can't hold one and is left out of the index; all others are indexed whole."""
    nothing = np.zeros(0, dtype=np.int64)
    if not len(phrases.patterns) or not len(numbers):
        return nothing, nothing, nothing
    known = numbers > 0
    begins = known.copy()
    begins[1:] &= ~known[:-1]
    heads = bounds[:-1][bounds[:-1] < len(numbers)]
    begins[heads] = known[heads]
    start = np.flatnonzero(begins)
    if not len(start):
        return nothing, nothing, nothing
    ends = known.copy()
    ends[:-1] &= ~known[1:]
    tails = bounds[1:][bounds[1:] > 0] - 1
    ends[tails] = known[tails]
    stop = np.flatnonzero(ends) + 1
    long = stop - start >= phrases.lengths.min()
    start, stop = start[long], stop[long]
    if not len(start):
        return nothing, nothing, nothing
    sizes = stop - start + 1
    into = np.concatenate([[0], np.cumsum(sizes)])
    symbols = np.zeros(into[-1], dtype=np.int64)
    origin = np.arange(into[-1]) - np.repeat(into[:-1] - start, sizes)
    inside = np.ones(into[-1], dtype=bool)
    inside[into[1:] - 1] = False
    symbols[inside] = numbers[origin[inside]]
    index = FmIndex(symbols)
    low, high = index.search(phrases.patterns, phrases.lengths)
    found = high - low
    which = np.repeat(np.arange(len(found)), found)
    rows = np.arange(found.sum()) - np.repeat(np.cumsum(found) - found, found) + np.repeat(low, found)
    return origin[index.locate(rows)], phrases.lengths[which], which


def merged(start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of ranges, as ranges apart from each other."""
    if not len(start):
        return start, stop
    order = np.argsort(start, kind="stable")
    start, reach = start[order], np.maximum.accumulate(stop[order])
    first = np.ones(len(start), dtype=bool)
    first[1:] = start[1:] > reach[:-1]
    return start[first], reach[np.append(np.flatnonzero(first)[1:] - 1, len(reach) - 1)]


def _search(phrases, keep: list[str]):
    """Adds the occurrences of one block of phrases to those found before."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, SHARD_BYTES):
                words = words_of(*text_bytes(part.column("text")), word_hashes)
                p = phrases.value
                place = np.minimum(np.searchsorted(p.vocabulary, words.hash), max(len(p.vocabulary) - 1, 0))
                numbers = np.where(p.vocabulary[place] == words.hash, place + 1, 0) if len(p.vocabulary) else np.zeros(len(words.hash), dtype=np.int64)
                where, length, which = hits_of_shard(numbers, words.bounds, p)
                text = np.searchsorted(words.bounds, where, side="right") - 1
                order = np.argsort(text, kind="stable")
                where, length, which, cuts = where[order], length[order], which[order], np.searchsorted(text[order], np.arange(part.num_rows + 1))
                hits, items = part.column("hits").to_pylist(), part.column("items").to_pylist()
                for i in np.flatnonzero(np.diff(cuts)):
                    here = slice(cuts[i], cuts[i + 1])
                    old = np.frombuffer(hits[i], dtype=np.int64).reshape(-1, 2)
                    first = where[here] - words.bounds[i]
                    s, e = merged(np.concatenate([old[:, 0], first]), np.concatenate([old[:, 1], first + length[here]]))
                    hits[i] = np.stack([s, e], axis=1).astype(np.int64).tobytes()
                    distinct = np.unique(which[here])
                    new = np.unique(np.concatenate([p.items[p.item_bounds[w] : p.item_bounds[w + 1]] for w in distinct]))
                    items[i] = sorted({*items[i], *(p.item_ids[k] for k in new)} - {None})
                n_hit = [int(np.diff(np.frombuffer(h, dtype=np.int64).reshape(-1, 2), axis=1).sum()) for h in hits]
                yield with_columns(part, keep, n_words=pa.array(words.per_text), n_hit=pa.array(n_hit, pa.int64()), hits=pa.array(hits, pa.binary()), items=pa.array(items, part.schema.field("items").type))

    return run


def _spans(keep: list[str]):
    """Word ranges -> byte ranges of the text, from the first byte of the first word to the last byte of the last."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits = [np.frombuffer(h, dtype=np.int64).reshape(-1, 2) for h in batch.column("hits").to_pylist()]
            flat, bounds = [np.zeros((0, 2), dtype=np.int64)], np.zeros(len(hits) + 1, dtype=np.int64)
            texts = batch.column("text")
            for i, h in enumerate(hits):
                if len(h):
                    words = words_of(*text_bytes(texts.slice(i, 1)))
                    flat.append(np.stack([words.start[h[:, 0]], words.stop[h[:, 1] - 1]], axis=1))
                bounds[i + 1] = bounds[i] + len(h)
            yield with_columns(batch, keep, spans=binary_lists(np.concatenate(flat).ravel(), bounds * 2))

    return run


def benchmark_blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[tuple[list, list[str]]]:
    """The items of the benchmark in blocks of about block_bytes, so that each is a bounded broadcast."""
    total = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    items = benchmark.where("text IS NOT NULL").select("item_id", "text").distinct()
    for k in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).collect()
        yield [r["item_id"] for r in rows], [r["text"] for r in rows]


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, width: int = 10, block_bytes: int = 1 << 24) -> DataFrame:
    """docs (doc_id, text), benchmark (item_id, text) -> the columns of docs, and n_words, n_hit (words hit), hits (pairs of 64-bit word numbers, from and to), items (ids of items with an occurring phrase).

    A phrase is `width` consecutive lower-case words of an item; an item of fewer words is one phrase. Each shard (documents of some 4 MB that lie together in a partition) gets an FM-index over its word
    numbers; all phrases are searched backward at once through the wavelet matrix, their occurrences located by sampled suffix positions and their word ranges merged.
    Nothing is shuffled. The benchmark, a stated query set, is taken in blocks of about block_bytes, each one broadcast and one pass in the same stage.

    Null and empty texts have no words and no hits; items without words have no phrases; an item id may repeat (its phrases add up) and be of any type that sorts; an item without an id hits and is cut as any other, but stands in no list. Repeated documents each
    have their own hits. Empty tables give no rows or no hits. Columns named like a result are replaced.
    """
    keep = plain_columns(docs, *RESULT)
    small_batches(docs)
    frame = docs.select(*keep, F.lit(0).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_hit"), F.expr("cast('' as binary)").alias("hits"), F.expr(f"cast(array() as array<{benchmark.schema['item_id'].dataType.simpleString()}>)").alias("items"))
    for ids, texts in benchmark_blocks(benchmark, block_bytes):
        phrases = docs.sparkSession.sparkContext.broadcast(phrases_of(ids, texts, width))
        frame = frame.mapInArrow(_search(phrases, keep), frame.schema)
    return frame


def decontaminated(docs: DataFrame, benchmark: DataFrame, width: int = 10) -> DataFrame:
    """The columns of docs with the merged spans of benchmark phrases cut out of the texts; texts without a hit stay as they are. A cut leaves a line break, so that words around it don't run together."""
    keep = plain_columns(docs, *RESULT)
    found = benchmark_hits(docs, benchmark, width)

    @tidy
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _spans([*keep])(batches):
            texts, spans = batch.column("text").to_pylist(), batch.column("spans").to_pylist()
            for i, s in enumerate(spans):
                if s:
                    data, at, parts = texts[i].encode(), 0, []
                    for start, stop in np.frombuffer(s, dtype=np.int64).reshape(-1, 2):
                        parts.append(data[at:start])
                        at = stop
                    texts[i] = b"\n".join([*parts, data[at:]]).decode()
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if c == "text" else batch.column(c) for c in keep], names=keep)

    return found.mapInArrow(cut, docs.select(*keep).schema)
