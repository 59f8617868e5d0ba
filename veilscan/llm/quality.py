"""Quality by logistic regression on hashed word n-grams, learnt with follow-the-regularised-leader updates and scored as sparse dot products."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import binary_lists, constants, distinct_by_text, mix64, pieces, text_bytes, tidy, with_columns, words_of
from .linear import Ftrl, FtrlModel, dots, sigmoid
from .storage import plain_columns, small_batches

RESULT = ("score", "predicted")
PIECE = 1 << 19


@dataclass(frozen=True)
class QualitySettings:
    """sample: labelled rows to learn from, at most; bits: n-grams are hashed to 2 ** bits features."""

    sample: int = 8192
    bits: int = 18
    ftrl: Ftrl = field(default_factory=lambda: Ftrl(alpha=0.3, beta=1.0, l1=0.3, l2=1.0, epochs=4))


def _shapes(data: np.ndarray, offsets: np.ndarray, words) -> np.ndarray:
    """A small number for the form of each word: its length, its capitals, what follows it, and whether it stood in the text before."""
    size = words.stop - words.start
    upper = np.concatenate([[0], np.cumsum((data >= 65) & (data <= 90))])
    capitals = upper[words.stop] - upper[words.start]
    case = np.where(capitals == 0, 0, np.where(capitals == size, 2, 1))
    after = np.minimum(np.append(words.start[1:], len(data)), offsets[words.text + 1]) if len(size) else size
    gap = after - words.stop
    follows = np.append(data, 32)[words.stop]
    kind = np.select([gap == 0, follows == 32, follows == 10, (follows == 44) | (follows == 46)], [0, 1, 2, 3], 4)
    again = np.ones(len(size), dtype=np.int64)
    again[np.unique(words.hash ^ mix64(words.text.astype(np.uint64)), return_index=True)[1]] = 0
    return (((np.minimum(size, 15) // 2 * 3 + case) * 5 + kind) * 3 + np.minimum(gap, 3) // 2) * 2 + again


def text_features(data: np.ndarray, offsets: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature numbers, values and bounds by text: hashed 1- and 2-grams of words, and of word forms, and a feature each for the size class of some
    shares of the text (words, distinct words, capitals, digits, other characters, word length). Every text has the latter, an empty one too."""
    words = words_of(data, offsets)
    n, text, counts = len(offsets) - 1, words.text, words.per_text
    shape = _shapes(data, offsets, words).astype(np.uint64)
    c = constants(4, 606)
    pair = np.flatnonzero(text[1:] == text[:-1]) if len(text) else np.zeros(0, dtype=np.int64)
    forms = mix64(shape + np.uint64(1 << 40))
    grams = [(words.hash, text), (mix64(words.hash[pair] * c[0] + words.hash[pair + 1] * c[1]), text[pair]), (forms, text), (mix64(forms[pair] * c[2] + forms[pair + 1] * c[3]), text[pair])]
    features, values, texts = [], [], []
    for k, (hashes, owner) in enumerate(grams):
        found, times, bounds = distinct_by_text(hashes >> np.uint64(64 - bits), np.searchsorted(owner, np.arange(n + 1)), bits)
        own = np.repeat(np.arange(n), np.diff(bounds))
        total = np.maximum(np.bincount(owner, minlength=n), 1)[own]
        features.append(found)
        values.append(np.sqrt(times / total) * (1.0 if k < 2 else 2.0))
        texts.append(own)
    total = np.maximum(counts, 1)
    size = np.maximum(np.diff(offsets), 1)
    share = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[offsets]) / size
    distinct = np.bincount(texts[0], minlength=n)  # of hashed words: enough for a share
    letters = np.bincount(text, weights=words.stop - words.start, minlength=n)
    levels = [
        np.log2(counts + 1.0),
        10 * distinct / total,
        20 * np.bincount(text, weights=shape % np.uint64(2) == 0, minlength=n) / total,
        20 * share((data >= 65) & (data <= 90)),
        20 * share((data >= 48) & (data <= 57)),
        20 * (1 - letters / size),
        letters / total,
    ]
    for k, level in enumerate(levels):
        features.append((mix64((np.floor(level).astype(np.uint64) + np.uint64(k << 20)) + np.uint64(1 << 41)) >> np.uint64(64 - bits)).astype(np.int64))
        values.append(np.ones(n))
        texts.append(np.arange(n))
    # Unlike grams may share a feature; a text has each feature once, with the sum of its values.
    keys, place = np.unique((np.concatenate(texts) << bits) | np.concatenate(features), return_inverse=True)
    return keys & ((1 << bits) - 1), np.bincount(place, weights=np.concatenate(values), minlength=len(keys)), np.searchsorted(keys >> bits, np.arange(n + 1))


def _examples(settings: QualitySettings):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, PIECE):
                found, values, bounds = text_features(*text_bytes(part.column("text")), settings.bits)
                yield with_columns(part, ["doc_id", "label"], features=binary_lists(found.astype(np.uint32), bounds), amounts=binary_lists(values.astype(np.float32), bounds))

    return run


def _train(settings: QualitySettings):
    """One task over the bounded sample."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, labels = [], []
        for batch in batches:
            labels += batch.column("label").to_pylist()
            for found, amounts in zip(batch.column("features").to_pylist(), batch.column("amounts").to_pylist(), strict=True):
                rows.append((np.frombuffer(found, dtype=np.uint32), np.frombuffer(amounts, dtype=np.float32)))
        weights = FtrlModel(1 << settings.bits, settings=settings.ftrl).fit(rows, np.array(labels, dtype=np.float64)).weights()
        used = np.flatnonzero(weights)
        yield pa.RecordBatch.from_pydict({"at": [used.astype(np.int64).tobytes()], "weight": [weights[used].tobytes()]})

    return run


def fit_quality(docs: DataFrame, labels: DataFrame, settings: QualitySettings = QualitySettings()) -> np.ndarray:
    """Weights of 2 ** bits features and the bias, learnt from at most settings.sample labelled documents in the order of a hash of their id.

    labels (doc_id, quality); null ids and labels are no examples. No examples give a score of one half to every text."""
    slim = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.max((F.col("quality") > 0).cast("int")).alias("label"))
    chosen = slim.orderBy(F.xxhash64("doc_id"), "doc_id").limit(settings.sample)
    examples = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").mapInArrow(_examples(settings), "doc_id long, label int, features binary, amounts binary")
    bounded = examples.orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("features")).limit(settings.sample)
    weights = np.zeros((1 << settings.bits) + 1)
    for row in bounded.repartition(1).mapInArrow(_train(settings), "at binary, weight binary").collect():
        weights[np.frombuffer(row["at"], dtype=np.int64)] = np.frombuffer(row["weight"])
    return weights


def quality_scores(docs: DataFrame, labels: DataFrame, settings: QualitySettings = QualitySettings()) -> DataFrame:
    """docs (doc_id, text) -> the columns of docs, score (0 to 1, the chance of label 1) and predicted (1 from one half up).

    Inputs of a score are the words of the whole text and their form, nothing else. Null counts as the empty text, which has a score of its own. Repeated rows score alike. An empty table gives
    no rows. Columns named like a result are replaced.
    """
    small_batches(docs)
    model = docs.sparkSession.sparkContext.broadcast(fit_quality(docs, labels, settings))
    keep = plain_columns(docs, *RESULT)

    @tidy
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, PIECE):
                found, values, bounds = text_features(*text_bytes(part.column("text")), settings.bits)
                p = sigmoid(dots(model.value, found, values, bounds) + model.value[-1])
                yield with_columns(part, keep, score=pa.array(p), predicted=pa.array((p >= 0.5).astype(np.int32)))

    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema]
    return docs.mapInArrow(score, ", ".join([*kinds, "score double, predicted int"]))
