"""The classifiers against plain Python: updates on dicts, one text at a time, word by word."""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilscan.llm.quality import QualitySettings, fit_quality, quality_scores, text_features
from veilscan.llm.toxicity import LAST, SEED_WORDS, ChainSettings, fit_chain, toxicity

SF = "/root/testdata/sf0.001"
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
FULL = (1 << 64) - 1
ODD = 0x9E3779B97F4A7C15


def mixed(x):
    x ^= x >> 30
    x = x * 0xBF58476D1CE4E5B9 & FULL
    x ^= x >> 27
    x = x * 0x94D049BB133111EB & FULL
    return x ^ (x >> 31)


def hashed(word):
    return mixed((sum((b + 1) * pow(ODD, i, 1 << 64) for i, b in enumerate(word)) + len(word)) & FULL)


def chance(x):
    return 1 / (1 + math.exp(-min(max(x, -35), 35)))


class Plain:
    """Follow-the-regularised-leader on dicts; a row is a dict of features, the bias has the name None and no penalty."""

    def __init__(self, s):
        self.s, self.z, self.n = s, defaultdict(float), defaultdict(float)

    def weight(self, f):
        z, l1 = self.z[f], 0.0 if f is None else self.s.l1
        return 0.0 if abs(z) <= l1 else -(z - math.copysign(l1, z)) / ((self.s.beta + math.sqrt(self.n[f])) / self.s.alpha + self.s.l2)

    def score(self, row):
        return sum(self.weight(f) * v for f, v in row.items()) + self.weight(None)

    def fit(self, rows, labels):
        order = np.random.default_rng(5)
        for _ in range(self.s.epochs):
            for i in order.permutation(len(rows)):
                row = {**rows[i], None: 1.0}
                old = {f: self.weight(f) for f in row}
                off = chance(sum(old[f] * v for f, v in row.items())) - labels[i]
                for f, v in row.items():
                    g = off * v
                    self.z[f] += g - (math.sqrt(self.n[f] + g * g) - math.sqrt(self.n[f])) / self.s.alpha * old[f]
                    self.n[f] += g * g
        return self


def sample(spark, label):
    """Documents and the labels of two thirds of them; the examples (id, text, label) in the order of learning."""
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    labels = labels.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1).where(f"{label} IS NOT NULL")
    rows = docs.select("doc_id", "text").join(labels.select("doc_id", label), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").collect()
    assert len(rows) > 20 and len({r[2] for r in rows}) == 2 and len({r[0] for r in rows}) == len(rows)
    return docs, labels, rows


def test_quality_against_plain_updates(spark):
    docs, labels, rows = sample(spark, "quality")
    settings = QualitySettings()

    def row(text):
        raw = (text or "").encode()
        found, values, _ = text_features(np.frombuffer(raw, dtype=np.uint8), np.array([0, len(raw)]), settings.bits)
        out = defaultdict(list)
        for f, v in zip(found.tolist(), values.tolist(), strict=True):
            out[f].append(v)
        assert all(len(v) == 1 for v in out.values()), "a feature stands twice in a row"
        return {f: v[0] for f, v in out.items()}

    plain = Plain(settings.ftrl).fit([row(r["text"]) for r in rows], [r["quality"] for r in rows])
    weights = fit_quality(docs, labels, settings)
    assert weights[-1] == pytest.approx(plain.weight(None), abs=1e-4)
    assert {f: w for f, w in enumerate(weights[:-1].tolist()) if w} == pytest.approx({f: w for f in plain.z if f is not None and (w := plain.weight(f))}, abs=1e-4)
    for r in quality_scores(docs, labels, settings).select("text", "score").collect():
        assert r["score"] == pytest.approx(chance(plain.score(row(r["text"]))), abs=1e-4)


def test_chain_against_plain_updates(spark):
    docs, labels, rows = sample(spark, "toxic")
    settings = ChainSettings()

    def words(text):
        return WORD.findall((text or "").encode().lower())

    def row(text):
        parts = Counter(hashed(w) >> (64 - settings.bits) for w in words(text))
        for k in settings.prefixes:
            parts.update(mixed((hashed(w[:k]) + k) & FULL) >> (64 - settings.bits) for w in words(text) if len(w) > k)
        return {f: math.log2(1 + n) for f, n in parts.items()}

    data = [row(r["text"]) for r in rows]
    seen = Counter(f for x in data for f in x)
    data = [{f: v for f, v in x.items() if seen[f] >= settings.min_rows} for x in data]
    toxic = [r["toxic"] for r in rows]
    marks = {n: [t * any(w.decode(errors="replace") in seeds for w in words(r["text"])) for t, r in zip(toxic, rows, strict=True)] for n, seeds in SEED_WORDS.items()} | {LAST: toxic}
    folds = np.random.default_rng(11).permutation(len(rows)) % settings.folds
    chain = []
    for name, y in marks.items():
        if len(set(y)) == 1:
            chain.append((name, None, y[0]))
            outside = [float(v) for v in y]
        else:
            outside = [0.0] * len(rows)
            for k in range(settings.folds):
                inner = np.flatnonzero(folds != k)
                model = Plain(settings.ftrl).fit([data[i] for i in inner], [y[i] for i in inner])
                for i in np.flatnonzero(folds == k):
                    outside[i] = chance(model.score(data[i]))
            chain.append((name, Plain(settings.ftrl).fit(data, y), None))
        for x, p in zip(data, outside, strict=True):
            x[name] = p  # what the later models see is out of fold
    assert sum(model is not None for _, model, _ in chain) >= 2
    models = fit_chain(docs, labels, settings)
    for (_, model, _), weights, j in zip(chain, models, range(9), strict=False):
        if model:
            before = dict(zip(marks, weights[1 << settings.bits : -1], strict=False))
            assert len(before) == j and before == pytest.approx({n: model.weight(n) for n in before}, abs=1e-4)
            assert {f: w for f, w in enumerate(weights[: 1 << settings.bits].tolist()) if w} == pytest.approx({f: w for f in model.z if isinstance(f, int) and (w := model.weight(f))}, abs=1e-4)
    for r in toxicity(docs, labels, settings).collect():
        x = {f: v for f, v in row(r["text"]).items() if seen[f] >= settings.min_rows}
        for name, model, always in chain:
            x[name] = chance(model.score(x)) if model else chance(35 if always else -35)
            assert r[f"p_{name}"] == pytest.approx(x[name], abs=1e-4)
