"""Toxicity by a classifier chain: each category's linear model also sees the probabilities of the categories before it."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import LOWER, Words, binary_lists, distinct_by_text, mix64, pieces, run_hashes, text_bytes, tidy, with_columns, words_of
from .linear import Ftrl, FtrlModel, dots, sigmoid
from .storage import plain_columns, small_batches

# Seed words of the categories that the label table doesn't mark. A labelled text is an example of such a category if it is
# labelled toxic and holds one of the words.
SEED_WORDS = {
    "insult": ("clown", "fool", "idiot", "loser", "moron", "stupid"),
    "contempt": ("disgusting", "filth", "garbage", "pathetic", "scum", "trash", "worthless"),
}
LAST = "toxic"
PIECE = 1 << 19


@dataclass(frozen=True)
class ChainSettings:
    """sample: labelled rows to learn from, at most; bits: features are hashed to 2 ** bits; prefixes: word beginnings of so many bytes are features beside whole words;
    min_rows: a feature in fewer rows of the sample is not learnt; folds: for the out-of-fold probabilities."""

    sample: int = 8192
    bits: int = 20
    prefixes: tuple[int, ...] = (5, 6, 7, 8, 9)
    min_rows: int = 3
    folds: int = 4
    threshold: float = 0.5
    ftrl: Ftrl = field(default_factory=lambda: Ftrl(alpha=0.3, beta=1.0, l1=2.0, l2=0.5, epochs=3))

    @property
    def categories(self) -> tuple[str, ...]:
        return (*SEED_WORDS, LAST)


def _features(data: np.ndarray, offsets: np.ndarray, settings: ChainSettings) -> tuple[np.ndarray, np.ndarray, np.ndarray, Words]:
    """The distinct hashed words and word beginnings of each text, a value that grows with the logarithm of their count, and their bounds."""
    words, lower = words_of(data, offsets), LOWER[data]
    hashes, texts = [words.hash], [words.text]
    for k in settings.prefixes:
        longer = np.flatnonzero(words.stop - words.start > k)
        hashes.append(mix64(run_hashes(lower, words.start[longer], words.start[longer] + k) + np.uint64(k)))
        texts.append(texts[0][longer])
    order = np.argsort(np.concatenate(texts), kind="stable")
    bounds = np.searchsorted(np.concatenate(texts)[order], np.arange(len(offsets)))
    found, counts, bounds = distinct_by_text(np.concatenate(hashes)[order] >> np.uint64(64 - settings.bits), bounds, settings.bits)
    return found, np.log2(1.0 + counts), bounds, words


def _seed_hashes() -> dict[str, np.ndarray]:
    hashes = {}
    for name, words in SEED_WORDS.items():
        data = np.frombuffer("".join(words).encode(), dtype=np.uint8)
        stop = np.cumsum([len(w) for w in words])
        hashes[name] = run_hashes(LOWER[data], stop - [len(w) for w in words], stop)
    return hashes


def _examples(settings: ChainSettings):
    """Maps (doc_id, text, toxic) to feature numbers and a label per category."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds = _seed_hashes()
        for batch in (part for whole in batches for part in pieces(whole, PIECE)):
            found, values, bounds, words = _features(*text_bytes(batch.column("text")), settings)
            toxic = np.array(batch.column("toxic").to_pylist(), dtype=np.int64)
            labels = [toxic * (np.bincount(words.text[np.isin(words.hash, s)], minlength=len(toxic)) > 0) for s in seeds.values()] + [toxic]
            flat, at = np.stack(labels, axis=1).astype(np.uint8).ravel(), np.arange(len(toxic) + 1) * len(labels)
            yield with_columns(batch, ["doc_id"], features=binary_lists(found.astype(np.uint32), bounds), amounts=binary_lists(values.astype(np.float32), bounds), marks=binary_lists(flat, at))

    return run


def _train(settings: ChainSettings):
    """One task over the bounded sample: the full chain, one row of weights per category."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = 1 << settings.bits
        rows, marks, seen = [], [], np.zeros(size, dtype=np.int32)
        for batch in batches:
            marks += [np.frombuffer(x, dtype=np.uint8) for x in batch.column("marks").to_pylist()]
            for found, amounts in zip(batch.column("features").to_pylist(), batch.column("amounts").to_pylist(), strict=True):
                rows.append((np.frombuffer(found, dtype=np.uint32), np.frombuffer(amounts, dtype=np.float32)))
                seen[rows[-1][0]] += 1
        names = settings.categories
        y = np.array(marks, dtype=np.float64).reshape(len(rows), len(names))
        learnt = np.flatnonzero(seen >= settings.min_rows)
        number = np.full(size, -1, dtype=np.int32)
        number[learnt] = np.arange(len(learnt))
        for i, (found, amounts) in enumerate(rows):
            at = number[found]
            rows[i] = at[at >= 0], amounts[at >= 0]
        fold = np.random.default_rng(11).permutation(len(rows)) % settings.folds
        earlier = np.zeros((len(rows), 0))
        for j, name in enumerate(names):
            if not len(rows) or y[:, j].min() == y[:, j].max():  # nothing to tell apart: the share, or none
                weights = np.zeros(len(learnt) + j + 1)
                weights[-1] = 35.0 if len(rows) and y[0, j] else -35.0
                outside = y[:, j]
            else:
                fit = lambda at: FtrlModel(len(learnt), j, settings.ftrl).fit([rows[i] for i in at], y[at, j], earlier[at]).weights()  # noqa: B023, E731
                outside = np.zeros(len(rows))
                for k in range(settings.folds):
                    w = fit(np.flatnonzero(fold != k))
                    for i in np.flatnonzero(fold == k):
                        outside[i] = sigmoid(w[rows[i][0]] @ rows[i][1] + earlier[i] @ w[len(learnt) : -1] + w[-1])
                weights = fit(np.arange(len(rows)))
            earlier = np.column_stack([earlier, outside])
            at = np.concatenate([learnt, size + np.arange(j + 1)])[weights != 0]
            yield pa.RecordBatch.from_pydict({"category": [j], "at": [at.astype(np.int64).tobytes()], "weight": [weights[weights != 0].tobytes()]})

    return run


def fit_chain(docs: DataFrame, labels: DataFrame, settings: ChainSettings = ChainSettings()) -> list[np.ndarray]:
    """The weights of each category's model, learnt from at most settings.sample labelled documents in the order of a hash of their id.

    The sample is taken from the slim label rows and joined to the texts where they lie. Rows with null ids or labels are no examples. The models
    are sparse; what the driver gets is at most 2 ** bits weights per category.
    """
    slim = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    chosen = slim.orderBy(F.xxhash64("doc_id"), "doc_id").limit(settings.sample)
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    examples = texts.mapInArrow(_examples(settings), "doc_id long, features binary, amounts binary, marks binary")
    bounded = examples.orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("features")).limit(settings.sample)
    models = [np.zeros((1 << settings.bits) + j + 1) for j in range(len(settings.categories))]
    for row in bounded.repartition(1).mapInArrow(_train(settings), "category long, at binary, weight binary").collect():
        models[row["category"]][np.frombuffer(row["at"], dtype=np.int64)] = np.frombuffer(row["weight"])
    return models


def chain_probabilities(models: list[np.ndarray], data: np.ndarray, offsets: np.ndarray, settings: ChainSettings) -> np.ndarray:
    """A line per text, a column per category."""
    found, values, bounds, _ = _features(data, offsets, settings)
    known = np.zeros((len(bounds) - 1, 0))
    for w in models:
        known = np.column_stack([known, sigmoid(dots(w, found, values, bounds) + known @ w[1 << settings.bits : -1] + w[-1])])
    return known


def toxicity(docs: DataFrame, labels: DataFrame, settings: ChainSettings = ChainSettings()) -> DataFrame:
    """docs (doc_id, text) -> the columns of docs, a probability p_<category> per category, and rejected (the last category's is at the threshold or above).

    A text is seen as its hashed words and word beginnings with their counts, all of them, however long it is; a null text has none. Word order and case don't count.
    Repeated rows score alike. No usable labels, or only one kind, make every probability of that category 0 or 1. An empty table gives no rows.
    """
    small_batches(docs)
    models = docs.sparkSession.sparkContext.broadcast(fit_chain(docs, labels, settings))
    names = [f"p_{c}" for c in settings.categories]
    keep = plain_columns(docs, *names, "rejected")

    @tidy
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, PIECE):
                p = chain_probabilities(models.value, *text_bytes(part.column("text")), settings)
                yield with_columns(part, keep, **{n: pa.array(p[:, j]) for j, n in enumerate(names)}, rejected=pa.array(p[:, -1] >= settings.threshold))

    schema = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema] + [f"{n} double" for n in names] + ["rejected boolean"]
    return docs.mapInArrow(score, ", ".join(schema))
