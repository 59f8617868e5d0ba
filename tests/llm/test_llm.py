"""Each operator against a brute-force version, on the smallest tables and on rows with nulls, empties, ties, repeats and clashing columns."""

from __future__ import annotations

import hashlib
import itertools
import os
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from veilscan.llm.arrays import word_hashes
from veilscan.llm.decontaminate import benchmark_hits, decontaminated
from veilscan.llm.embedding_dedup import VectorSettings, vector_links
from veilscan.llm.fm_index import FmIndex
from veilscan.llm.licenses import TEMPLATES, license_scan, patience
from veilscan.llm.mixing import emitted, mixed
from veilscan.llm.ngram_join import JoinSettings, first_of_each, similarity_classes
from veilscan.llm.oracles import ORACLES
from veilscan.llm.quality import quality_scores
from veilscan.llm.queries import QUERIES
from veilscan.llm.sharding import byte_shards, sharded
from veilscan.llm.suffix_dedup import Found, MatchSettings, SuffixFamily, _same, _settle, anchor_runs, block_runs, without_repeats
from veilscan.llm.token_counts import REDACTED, PreTokenCounts, PreTokenTree, apply_edits, edited_counts, pre_token_trees, read_ranks, redaction_edits
from veilscan.llm.toxicity import toxicity

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
A_TO_Z = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
LONG = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon "


def words(text):
    return WORD.findall((text or "").translate(A_TO_Z))


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empties, ties, repeated rows, a very long text and columns with the names of results."""
    body = " ".join(f"w{i}" for i in range(60))
    rows = [
        (1, body, "a"),
        (2, body, "a"),
        (2, body, "a"),
        (3, body.replace("w30", "other"), None),
        (4, None, "b"),
        (5, "", "b"),
        (6, "!!! ...", None),
        (7, "Two words", "c"),
        (8, " ".join(f"v{i}" for i in range(40_000)), "c"),
        (None, body, "c"),
        (None, None, None),
        (9, "é" * 30, "a"),
        (10, "x" + "é" * 30, "a"),
    ]
    schema = "doc_id long, text string, source string"
    clash = ["n_words", "size", "shard", "slot", "class_id", "kept", "score", "rejected", "n_bytes", "licenses", "copies", "n_tokens", "edits", "mark"]
    return spark.createDataFrame(rows, schema).select("*", *(F.lit(-1).alias(c) for c in clash))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, name):
    duck = duckdb.connect()
    for table in ("documents", "benchmark", "conversations"):
        duck.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    cursor = duck.execute(ORACLES[name])
    names = [d[0] for d in cursor.description]
    frame = QUERIES[name](spark, SF)
    assert sorted(frame.columns) == sorted(names)
    plain = lambda rows: sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows), key=repr)
    assert plain(tuple(r) for r in frame.select(*names).collect()) == plain(cursor.fetchall())


def test_fm_index_finds_what_a_scan_finds():
    draw = np.random.default_rng(1)
    symbols = np.concatenate([np.append(draw.integers(1, 4, draw.integers(3, 30)), 0) for _ in range(40)])
    patterns = np.array([[a, b, c] for a in (1, 2, 3) for b in (1, 2, 3) for c in (0, 1, 2, 3)])
    lengths = (patterns > 0).sum(axis=1)
    index = FmIndex(symbols, step=5)
    low, high = index.search(patterns, lengths)
    for p, n, x, y in zip(patterns, lengths, low, high, strict=True):
        expected = [i for i in range(len(symbols) - n + 1) if (symbols[i : i + n] == p[:n]).all()]
        assert sorted(index.locate(np.arange(x, y)).tolist()) == expected


def test_decontamination(spark, odd):
    items = spark.createDataFrame([(1, " ".join(f"W{i}" for i in range(20, 35))), (2, "two  WORDS"), (3, None), (4, ""), (None, "two words"), (2, "w1 w2")], "item_id long, text string")
    got = [(r["doc_id"], r["n_words"], r["n_hit"], r["items"]) for r in benchmark_hits(odd, items).collect()]
    assert (1, 60, 17, [1, 2]) in got and got.count((2, 60, 17, [1, 2])) == 2
    assert (3, 60, 12, [1, 2]) in got and (7, 2, 2, [2]) in got and (4, 0, 0, []) in got and (8, 40_000, 0, []) in got
    clean = {r["doc_id"]: r["text"] for r in decontaminated(odd, items).collect()}
    assert "w25" not in words(clean[1]) and "w19" in words(clean[1]) and clean[4] is None and clean[9] == "é" * 30
    assert benchmark_hits(odd.limit(0), items).count() == 0
    assert benchmark_hits(odd, items.limit(0)).where("n_hit > 0").count() == 0


def test_sharding(odd):
    rows = sharded(odd, 4).collect()
    assert len(rows) == odd.count()
    for shard in {r["shard"] for r in rows}:
        assert sorted(r["slot"] for r in rows if r["shard"] == shard) == list(range(sum(r["shard"] == shard for r in rows)))
    assert {(r["doc_id"], r["size"], r["text_crc32"]) for r in rows} >= {(4, 16, 0), (7, 25, zlib.crc32(b"Two words"))}
    assert byte_shards(odd.limit(0)).count() == 0


def test_shards_are_near_equal_and_contiguous(docs):
    rows = byte_shards(docs, 10).collect()
    sizes, most = Counter(), max(r["size"] for r in rows)
    for r in rows:
        sizes[r["shard"]] += r["size"]
    assert max(sizes.values()) - min(sizes.values()) <= 2 * most
    assert [r["shard"] for r in sorted(rows, key=lambda r: r["doc_id"])] == sorted(r["shard"] for r in rows)


def test_mixing(docs, odd):
    rows = mixed(odd).collect()
    assert len(rows) == odd.count() and all(r["taken"] <= 2 * r["size"] for r in rows)
    assert emitted(mixed(odd)).count() == sum(r["copies"] for r in rows)
    assert sorted(map(tuple, mixed(docs).select("doc_id", "taken").collect())) == sorted(map(tuple, mixed(docs).select("doc_id", "taken").collect()))
    assert mixed(odd.limit(0)).count() == 0


def similar(texts, n=5, threshold=0.8):
    sets = {}
    for key, text in texts.items():
        w = words(text)
        sets[key] = {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()
    links = defaultdict(set)
    keys = sorted(k for k in sets if sets[k])
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            common = len(sets[a] & sets[b])
            if common >= threshold * (len(sets[a]) + len(sets[b]) - common):
                links[a].add(b)
                links[b].add(a)
    return links


def reach(links, key):
    seen, todo = {key}, [key]
    while todo:
        for other in links[todo.pop()] - seen:
            seen.add(other)
            todo.append(other)
    return seen


def test_ngram_join(docs):
    links = similar({r["doc_id"]: r["text"] for r in docs.collect()})
    for r in similarity_classes(docs).collect():
        assert (r["n_links"], r["class_id"], r["class_size"]) == (len(links[r["doc_id"]]), min(reach(links, r["doc_id"])), len(reach(links, r["doc_id"])))


def test_ngram_join_of_a_large_group_in_blocks(spark):
    draw = random.Random(2)
    base = [f"w{i}" for i in range(80)]
    texts = {i: " ".join([*base[: draw.randint(60, 80)], f"tail{i % 3}"]) for i in range(90)}
    links = similar(texts)
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    rows = similarity_classes(frame, JoinSettings(block=16, recall=0.9999, hashes=400)).collect()
    assert {r["doc_id"]: r["n_links"] for r in rows} == {k: len(links[k]) for k in texts}
    assert {r["doc_id"]: r["class_id"] for r in rows} == {k: min(reach(links, k)) for k in texts}


def test_ngram_join_of_odd_rows(odd):
    got = {(r["doc_id"], r["class_id"], r["n_links"], r["kept"]) for r in similarity_classes(odd).collect()}
    assert {(1, 1, 3, True), (2, 1, 3, False), (3, 1, 3, False), (4, 4, 0, True), (None, None, 0, True)} <= got or {(1, 1, 2, True), (3, 3, 0, True)} <= got
    kept = [r["doc_id"] for r in first_of_each(odd).collect()]
    assert kept.count(1) == 1 and 2 not in kept and kept.count(None) == 2 and {4, 5, 6, 7, 8} <= set(kept)
    assert similarity_classes(odd.limit(0)).count() == 0


def test_ngram_join_at_the_threshold(spark):
    bands, rows = JoinSettings().bands()
    assert (1 - 0.8**rows) ** bands <= 1e-4
    draw = random.Random(6)
    word = lambda: f"{draw.getrandbits(48):x}"
    texts = {}
    for i in range(0, 3000, 2):  # 8 of 10 n-grams are common, so every pair is right at the threshold
        line = [word() for _ in range(14)]
        texts[i], texts[i + 1] = " ".join(line), " ".join(line[:12])
    got = similarity_classes(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    assert all(r["n_links"] == 1 and r["class_id"] == r["doc_id"] // 2 * 2 for r in got)


def test_ngram_join_of_odd_rows_loses_no_link(odd):
    got = {(r["doc_id"], r["class_id"], r["n_links"], r["kept"]) for r in similarity_classes(odd).collect()}
    assert {(1, 1, 3, True), (2, 1, 3, False), (3, 1, 3, False), (4, 4, 0, True), (None, None, 0, True)} <= got


def test_ngram_join_of_texts_that_share_an_id(spark):
    a, b = (" ".join(f"{c}{i}" for i in range(60)) for c in "ab")
    rows = [(1, a, "x"), (1, b, "y"), (2, b + " more", "x"), (3, a + " more", "x"), (4, None, "x"), (4, "!", "x"), (1, a, "w")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = [(r["doc_id"], r["source"], r["class_id"], r["n_links"], r["class_size"], r["kept"]) for r in similarity_classes(frame).collect()]
    assert sorted(got)[:5] == [(1, "w", 1, 2, 3, True), (1, "x", 1, 2, 3, True), (1, "y", 1, 1, 2, True), (2, "x", 1, 1, 2, False), (3, "x", 1, 2, 3, False)]
    kept = [tuple(r) for r in first_of_each(frame).collect()]
    assert sorted(kept, key=repr) == sorted([(1, a, "w"), (1, b, "y"), (4, None, "x"), (4, "!", "x")], key=repr)


def test_vectors(spark):
    draw = np.random.default_rng(4)
    centres = draw.standard_normal((30, 16))
    vectors = [centres[i % 30] + draw.standard_normal(16) * 0.12 for i in range(240)] + [centres[0]] * 3
    rows = [(i, [float(x) for x in v], 0) for i, v in enumerate(vectors)]
    rows += [(900, None, 0), (901, [0.0] * 16, 0), (902, [float("nan")] * 16, 0), (903, [None] + [1.0] * 15, 0), (904, [], 0), (None, rows[0][1], 0), (905, [1.0, 2.0], -1)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, n_links int")
    unit = np.array(vectors) / np.linalg.norm(vectors, axis=1)[:, None]
    near = unit @ unit.T >= 0.95
    np.fill_diagonal(near, False)
    links = {i: set(np.flatnonzero(near[i]).tolist()) for i in range(len(vectors))}
    got = {r["vec_id"]: r for r in vector_links(frame, VectorSettings(recall=0.9999, block=32)).collect()}
    assert all(got[i]["n_links"] == len(links[i]) and got[i]["component_id"] == min(reach(links, i)) for i in links)
    assert all(got[i]["n_links"] == 0 and got[i]["component_id"] == i and got[i]["kept"] for i in (900, 901, 902, 903, 904, 905))
    found = sum(r["n_links"] for r in vector_links(frame).collect())
    assert 0.9 * near.sum() <= found <= near.sum()
    assert vector_links(frame.limit(0)).count() == 0


def links_by_hand(rows):
    """(vec_id, vector) rows -> how many vectors each row links with, and the smallest id of its component, by all cosines in double precision."""
    fit = [k for k, (i, v) in enumerate(rows) if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links = defaultdict(set)
    for size in {len(rows[k][1]) for k in fit}:
        own = [k for k in fit if len(rows[k][1]) == size]
        unit = np.array([rows[k][1] for k in own], dtype=float)
        unit /= np.linalg.norm(unit, axis=1)[:, None]
        for a, b in zip(*np.nonzero(np.triu(unit @ unit.T >= 0.95, 1)), strict=True):
            links[own[a]].add(own[b])
            links[own[b]].add(own[a])
    return Counter((i, len(links[k]), min(rows[m][0] for m in reach(links, k)) if links[k] else i) for k, (i, _) in enumerate(rows))


@pytest.mark.parametrize("folder", [SF, SF.replace("0.001", "0.01")])
def test_vectors_of_a_whole_table(spark, folder):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    got = Counter((r["vec_id"], r["n_links"], r["component_id"]) for r in QUERIES["op4_embedding_near_dedup"](spark, folder).collect())
    assert got == links_by_hand(rows)


def test_vectors_that_share_an_id(spark):
    a, b = [1.0] * 8 + [0.0] * 8, [0.0] * 8 + [1.0] * 8
    near = lambda v: [x + 0.01 * (k == 3) for k, x in enumerate(v)]
    rows = [(1, a), (1, b), (2, near(a)), (3, near(b)), (1, a), (None, a), (4, None), (4, b)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = Counter((r["vec_id"], r["n_links"], r["component_id"]) for r in vector_links(frame).collect())
    assert got == links_by_hand(rows)


def swapped(length):
    """Two unlike words of this length that a polynomial hash modulo a power of two takes for one."""
    bits = [bin(k).count("1") % 2 for k in range(length)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


@pytest.mark.parametrize("length", [1024, 2048])
def test_unlike_long_words_are_unlike(spark, length):
    one, other = swapped(length)
    rest = " ".join(f"w{k}" for k in range(12))
    docs = spark.createDataFrame([(1, f"{one} {rest}", "en", "s", 1), (2, f"{other} {rest}", "en", "s", 1), (3, one, "en", "s", 1), (4, other, "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    items = spark.createDataFrame([(7, other)], "item_id long, text string")
    assert {r["doc_id"]: (r["n_hit"], r["items"]) for r in benchmark_hits(docs, items).collect()} == {1: (0, []), 2: (1, [7]), 3: (0, []), 4: (1, [7])}
    texts = {r["doc_id"]: r["text"] for r in decontaminated(docs, items).collect()}
    assert texts[3] == one and one in texts[1] and other not in texts[2]
    short = docs.where("doc_id > 2")
    assert all(r["n_links"] == 0 for r in similarity_classes(short).collect())
    assert sorted(r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, short, SF).collect()) == [3, 4]


def test_word_hashes_tell_words_apart():
    draw = np.random.default_rng(5)
    words_given = sorted({bytes(draw.integers(97, 100, n).astype(np.uint8)) for n in [1, 2, 7, 8, 9, 16, 17, 255, 256, 257, 300] for _ in range(60)})
    whole = np.frombuffer(b" ".join(words_given), dtype=np.uint8)
    stop = np.cumsum([len(w) + 1 for w in words_given]) - 1
    hashes = word_hashes(whole, stop - [len(w) for w in words_given], stop)
    assert len(set(hashes.tolist())) == len(words_given)
    alone = [word_hashes(np.frombuffer(w, dtype=np.uint8), np.array([0]), np.array([len(w)]))[0] for w in words_given]
    assert hashes.tolist() == alone


def test_items_with_string_ids_and_without_ids(spark):
    docs = spark.createDataFrame([(1, "two words here"), (2, "none")], "doc_id long, text string")
    items = spark.createDataFrame([("x10", "two words"), (None, "words here"), ("x9", "two"), ("x9", None)], "item_id string, text string")
    got = {r["doc_id"]: (r["n_hit"], r["items"]) for r in benchmark_hits(docs, items).collect()}
    assert got == {1: (3, ["x10", "x9"]), 2: (0, [])}


def repeats(rows):
    seen, out = {}, {}
    for key, text in sorted(rows.items()):
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - 49):
            if seen.setdefault(raw[p : p + 50], key) < key:
                gone[p : p + 50] = b"\1" * 50
        kept = bytes(c for c, g in zip(raw, gone, strict=True) if not g)
        spans = sum(1 for p in range(len(gone)) if gone[p] and (p == 0 or not gone[p - 1]))
        out[key] = (len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def test_suffix_dedup(docs):
    expected = repeats({r["doc_id"]: r["text"] for r in docs.collect()})
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in without_repeats(docs).collect()} == expected


def test_suffix_dedup_of_odd_rows(odd):
    expected = repeats({r["doc_id"]: r["text"] for r in odd.where("doc_id IS NOT NULL").collect()})
    rows = without_repeats(odd, with_text=True).collect()
    assert len(rows) == odd.count()
    for r in rows:
        if r["doc_id"] is None:
            assert r["n_removed"] == 0
        else:
            assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == expected[r["doc_id"]]
            assert hashlib.sha256(bytes(r["kept_text"])).hexdigest() == r["kept_sha256"]
    assert without_repeats(odd.limit(0)).count() == 0


def test_suffix_family_of_many_levels():
    family, draw = SuffixFamily(), random.Random(8)
    seen, most, merges = {}, 0, 0
    for turn in range(60):
        drawn = sorted({f"{draw.randrange(900):03d}".encode() for _ in range(draw.randint(1, 40))})
        strings = np.array(drawn, dtype="S3")
        found = family.lookup(strings, -1 if not seen else 10**6)
        assert [int(x) for x in found] == [seen.get(x, -1 if not seen else 10**6) for x in drawn]
        fresh = np.array([x not in seen for x in drawn])
        levels = len(family.levels)
        family.add(strings[fresh], np.full(int(fresh.sum()), turn))
        merges += fresh.any() and len(family.levels) <= levels
        most = max(most, len(family.levels))
        seen.update((x, turn) for x in drawn if x not in seen)
        assert sum(len(a) for a, _ in family.levels) == len(seen) and all((a[1:] > a[:-1]).all() for a, _ in family.levels)
    assert most > 2 and merges > 5


def test_suffix_dedup_in_small_batches(docs):
    draw = random.Random(9)
    common = " ".join(f"{draw.getrandbits(40):x}" for _ in range(12))
    spark = docs.sparkSession
    rows = {i: f"{draw.getrandbits(90):x} {common} {draw.getrandbits(90):x} " * draw.randint(1, 3) for i in range(120)}
    rows[7] = common[10:90]
    got = without_repeats(spark.createDataFrame(list(rows.items()), "doc_id long, text string"), MatchSettings(batch=64)).collect()
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got} == repeats(rows)


@pytest.mark.parametrize("most", [20, 400])
def test_suffix_dedup_of_buckets_dealt_anew(docs, most):
    draw = random.Random(12)
    common = " ".join(f"{draw.getrandbits(40):x}" for _ in range(4))
    rows = {i: f"{draw.getrandbits(60):x} {common} {draw.getrandbits(30) % 3:x} tail {draw.getrandbits(90):x}" for i in range(150)}
    rows |= {150: None, 151: "", 152: common, 153: common * 40, 154: rows[3]}
    table = docs.sparkSession.createDataFrame(list(rows.items()), "doc_id long, text string")
    got = without_repeats(table, MatchSettings(batch=64, most=most, share=1000)).collect()
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got} == repeats(rows)


def test_runs_of_one_hash_are_told_apart_by_bytes(monkeypatch):
    texts = [b"a" * 50, b"b" * 50, b"a" * 50, b"a" * 51, b"a" * 50]
    size = np.array([len(t) for t in texts])
    found = Found(np.array([4, 5, 6, 7, 4]), np.zeros(5, dtype=np.int64), np.zeros(5, dtype=np.int64), size, np.frombuffer(b"".join(texts), dtype=np.uint8))
    monkeypatch.setattr(Found, "content", lambda self: np.zeros(len(self.doc), dtype=np.uint64))
    stay, done = _settle(found)
    assert sorted(stay.tolist()) == [0, 1, 3, 4] and done.tolist() == [2]


def test_runs_compared_by_eights():
    draw = random.Random(3)
    texts = []
    for n in (50, 51, 57, 58, 76, 1024, 1025, 5000):
        base = bytes(draw.randrange(256) for _ in range(n))
        texts += [base, base, base[:-1] + bytes([base[-1] ^ 1]), bytes([base[0] ^ 1]) + base[1:], base[: n // 2] + bytes([base[n // 2] ^ 1]) + base[n // 2 + 1 :]]
    size, none = np.array([len(t) for t in texts]), np.zeros(len(texts), dtype=np.int64)
    found = Found(none, none, none, size, np.frombuffer(b"".join(texts), dtype=np.uint8))
    rows, others = (x.ravel() for x in np.meshgrid(np.arange(len(texts)), np.arange(len(texts))))
    assert _same(found, rows, others).tolist() == [texts[a] == texts[b] for a, b in zip(rows, others, strict=True)]


def test_suffix_dedup_leaves_no_shuffle_behind(docs):
    """What the jobs before the result have shuffled is gone when they are done; only the sum of the texts' bytes may stay."""
    blocks = docs.sparkSession._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffled():
        files = blocks.getAllFiles()
        names = {files.apply(k).getPath() for k in range(files.size())}
        return {n: os.path.getsize(n) for n in names if os.path.basename(n).startswith("shuffle_") and os.path.exists(n)}

    before = shuffled()
    without_repeats(docs)
    for _ in range(40):
        left = sum(size for n, size in shuffled().items() if n not in before)
        if left < 20_000:
            break
        time.sleep(0.25)
    assert left < 20_000


def test_long_equal_passages_have_equal_blocks():
    draw, settings = random.Random(21), MatchSettings()
    some = lambda n: bytes(draw.randrange(97, 123) for _ in range(n))
    passage = some(5000)
    texts = [passage, b"", some(700) + passage + some(90), b"a" * 49, b"a" * 50, some(61) + passage, b"ab" * 3000]
    data, offsets = np.frombuffer(b"".join(texts), dtype=np.uint8), np.cumsum([0, *map(len, texts)])
    blocks, skipped = block_runs(data, offsets, settings), np.zeros(len(data), dtype=bool)
    for i, t in enumerate(texts):  # each string stands in one block
        mine = blocks.text == i
        assert np.concatenate([[0], np.cumsum(blocks.count[mine])])[:-1].tolist() == blocks.start[mine].tolist()
        assert blocks.count[mine].sum() == max(len(t) - 49, 0)
    first = set(blocks.anchor[blocks.text == 0].tolist())
    for i in (2, 5):
        again = np.array([i == t and a in first for t, a in zip(blocks.text, blocks.anchor.tolist(), strict=True)])
        assert blocks.count[again].sum() > 3500
        for s, n in zip(blocks.start[again], blocks.count[again], strict=True):
            assert texts[i][s : s + n + 49] in passage
            skipped[offsets[i] + s : offsets[i] + s + n] = True
    runs, whole = (anchor_runs(data, offsets, settings, x) for x in (skipped, None))
    spread = lambda r: {(t, s + k): a for t, s, n, a in zip(r.text, r.start, r.count, r.anchor, strict=True) for k in range(n)}
    assert spread(runs) == {(t, s): a for (t, s), a in spread(whole).items() if not skipped[offsets[t] + s]}


@pytest.mark.parametrize("partitions", [1, 5])
def test_suffix_dedup_of_long_passages_in_many_documents(spark, partitions):
    """Passages that are settled as blocks, between neighbours that are not, in documents of any order; ids that several texts share."""
    draw = random.Random(22)
    some = lambda n: "".join(chr(draw.randrange(97, 123)) for _ in range(n))
    passages = [some(n) for n in (60, 300, 1500, 4000)]
    rows = {draw.getrandbits(62): " ".join(draw.choice(passages)[draw.choice((0, 0, 37)) :] + some(draw.randrange(90)) for _ in range(draw.randint(1, 5))) for _ in range(120)}
    rows |= {-7: passages[3] * 2, 5: passages[2]}
    table = spark.createDataFrame(list(rows.items()), "doc_id long, text string").repartition(partitions)
    got = without_repeats(table).collect()
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got} == repeats(rows)
    two = spark.createDataFrame([(1, passages[3]), (1, passages[3][500:] + some(80)), (2, passages[3])], "doc_id long, text string")
    assert sorted((r["doc_id"], r["n_removed"]) for r in without_repeats(two).collect()) == [(1, 0), (1, 0), (2, 4000)]


def test_patience():
    assert patience([9, 1, 2, 7, 3, 4, 9], [1, 2, 3, 4]) == [(1, 0), (2, 1), (4, 2), (5, 3)]
    assert patience([], [1]) == [] == patience([5, 5], [1, 2])


def test_licenses(spark, odd):
    mit = TEMPLATES["mit-grant"]
    rows = [(1, LONG + mit.replace("hereby", "") + LONG), (2, (LONG + TEMPLATES["gpl-3.0-line"]) * 3), (3, LONG), (4, None), (5, "Licensed under CC BY-NC 4.0.")]
    got = {r["doc_id"]: r for r in license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i]["best_license"] for i in range(1, 6)] == ["mit-grant", "gpl-3.0-line", None, None, "cc-by-nc-4.0-line"]
    n = len(words(mit))
    assert got[1]["matched_words"] == n - 1 and got[1]["coverage"] == pytest.approx((n - 1) / n)
    assert rows[0][1].encode()[got[1]["span_start"] : got[1]["span_stop"]].decode().startswith("Permission is  granted")
    assert license_scan(odd).where("licenses <> ''").count() == 0 and license_scan(odd.limit(0)).count() == 0


def test_licenses_in_any_order(spark):
    line = TEMPLATES
    names = ["cc-by-nc-4.0-line", "cc-by-4.0-line", "cc-by-sa-4.0-line", "apache-2.0-notice", "apache-2.0-line", "mit-line"]
    lists = [pair for pair in itertools.permutations(names, 2)] + [(n,) * k for n in names for k in (2, 5)] + list(itertools.permutations(names[:4]))
    rows = [(i, gap.join(["", *(line[n] for n in some), ""])) for i, (some, gap) in enumerate(itertools.product(lists, (LONG, " y ", " ")))]
    expected = {i: ",".join(sorted(set(some))) for i, (some, _) in enumerate(itertools.product(lists, (LONG, " y ", " ")))}
    got = license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["licenses"] for r in got} == expected


def test_licenses_of_one_family_are_told_apart(spark):
    bsd = TEMPLATES["bsd-3-clause-terms"]
    names = bsd.index(" Neither the name"), bsd.index(" THIS SOFTWARE IS")
    ads = " All advertising materials mentioning features or use of this software must display the following acknowledgement: This product includes software developed by the University."
    mit = TEMPLATES["mit-grant"]
    gnu = "This work is licensed under the GNU {} Public License, version {}."
    cases = [
        (bsd[: names[0]] + bsd[names[1] :], "bsd-2-clause-terms"),
        (bsd, "bsd-3-clause-terms"),
        (bsd[: names[0]] + ads + bsd[names[0] :], "bsd-4-clause-terms"),
        (bsd[: bsd.index(" Redistributions in binary")], "bsd-family-terms"),
        (mit, "mit-grant"),
        (mit[: mit.index(", subject to")] + "." + mit[mit.index(" THE SOFTWARE IS") :], "mit-0-grant"),
        (mit[: mit.index(", subject to")], "mit-family-grant"),
        *((f"Licensed under CC {k} 4.0.", f"cc-{k.lower()}-4.0-line") for k in ("BY", "BY-NC", "BY-ND", "BY-SA", "BY-NC-SA", "BY-NC-ND")),
        ("Licensed under CC BY-SA 3.0.", ""),
        (gnu.format("General", 2), "gpl-2.0-line"),
        (gnu.format("General", 3), "gpl-3.0-line"),
        (gnu.format("Lesser General", 3), "lgpl-3.0-line"),
        (gnu.format("Affero General", 3), "agpl-3.0-line"),
        (gnu.format("General", 4), ""),
        (gnu.format("General", 3).replace("work", "program"), "gpl-3.0-short-line"),
        (TEMPLATES["gpl-3.0-notice"].replace("version 3", "version 2"), "gpl-2.0-notice"),
        (TEMPLATES["gpl-3.0-notice"].replace("GNU", "GNU Lesser"), "lgpl-3.0-notice"),
        ("Licensed under the Apache License, Version 1.0.", "apache-1.0-line"),
        ("Licensed under the Apache License, Version 2.0.", "apache-2.0-line"),
        ("Licensed under the Apache License, Version 3.0.", ""),
        ("Released under the modified MIT License.", ""),
    ]
    for gap in (" ", LONG):
        frame = spark.createDataFrame([(i, gap + text + " " + gap) for i, (text, _) in enumerate(cases)], "doc_id long, text string")
        assert {cases[r["doc_id"]][0]: r["licenses"] for r in license_scan(frame).collect()} == dict(cases)
    whole = spark.createDataFrame([(n, LONG + t + " " + LONG) for n, t in TEMPLATES.items()], "doc_id string, text string")
    assert all(r["licenses"] == r["doc_id"] and r["coverage"] == 1 for r in license_scan(whole).collect())


RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def test_edits_count_as_a_whole_encoding_does():
    counts = PreTokenCounts(read_ranks(RANKS))
    draw, letters = random.Random(3), ["a", "b", " ", "  ", "\n", "\t", "'s", "'", "1", "23", ".", "!!", "é", "'ll", "\r\n", "日本"]
    for _ in range(1500):
        text = "".join(draw.choices(letters, k=draw.randint(0, 40)))
        found = counts.split(text)
        tree = PreTokenTree(np.array(list(map(len, found)), dtype=int), np.array(counts.counts(found), dtype=int))
        edits = [(a := draw.randint(0, len(text)), a + draw.randint(0, 6), "".join(draw.choices(letters, k=draw.randint(0, 3)))) for _ in range(draw.randint(1, 4))]
        new, _ = apply_edits(text, tree, edits, counts)
        assert (tree.tokens, tree.length) == (sum(counts.counts(counts.split(new))), len(new))


def edited_again(counts, text, edits):
    """Pre-tokens of the text, pre-tokens encoded again, and whether the tree says what a whole encoding says."""
    found = counts.split(text)
    tree = PreTokenTree(np.array(list(map(len, found)), dtype=int), np.array(counts.counts(found), dtype=int))
    new, again = apply_edits(text, tree, edits, counts)
    assert (tree.tokens, tree.length) == (sum(counts.counts(counts.split(new))), len(new))
    return len(found), again


def test_edits_follow_each_other_in_one_tree():
    counts = PreTokenCounts(read_ranks(RANKS))
    draw, letters = random.Random(4), ["a", "b", " ", "  ", "\n", "'s", "'", "1", "!!", "é", "   \n  "]
    for _ in range(300):
        text = "".join(draw.choices(letters, k=draw.choice([0, 3, 40, 200])))
        found = counts.split(text)
        tree = PreTokenTree(np.array(list(map(len, found)), dtype=int), np.array(counts.counts(found), dtype=int))
        for _ in range(4):
            edits = [(a := draw.randint(-2, len(text) + 2), a + draw.randint(-1, 6), "".join(draw.choices(letters, k=draw.randint(0, 3)))) for _ in range(draw.choice([1, 4, 30]))]
            text, _ = apply_edits(text, tree, edits, counts)
            assert (tree.tokens, tree.length) == (sum(counts.counts(counts.split(text))), len(text))


@pytest.mark.parametrize("n", [500, 100_000])
def test_work_follows_the_edits(n):
    """Double blanks, single edits far apart, edits in one unbroken run and in white space alone."""
    counts = PreTokenCounts(read_ranks(RANKS))
    text = "word  " * n
    _, again = edited_again(counts, text, [(m.start(), m.end(), " ") for m in re.finditer("  ", text)])
    assert again <= 3 * n
    _, again = edited_again(counts, "one more thing. " * n, [(i * 160, i * 160 + 1, "X") for i in range(n // 10)])
    assert again <= 8 * (n // 10) + 8
    for text in ("y" * n, "\n\n  " * n):
        size, again = edited_again(counts, text, [(i * 10, i * 10 + 1, " ") for i in range(n // 10)])
        assert again <= n


def test_redactions_of_long_runs():
    for text in ("x" * 1_000_000, "ab12" * 250_000, " " * 1_000_000, "a.b@c" * 200_000, "1 (" * 300_000):
        for m in REDACTED.finditer(text):
            assert m.end() > m.start()


def test_token_counts(docs, odd):
    ranks = read_ranks(RANKS)
    counts = PreTokenCounts(ranks)
    for frame in (docs, odd):
        rows = edited_counts(pre_token_trees(redaction_edits(frame), ranks), ranks).collect()
        assert len(rows) == frame.count()
        assert all(r["n_tokens_after"] == sum(counts.counts(counts.split(r["text"] or ""))) and r["n_reencoded"] <= 40 * r["n_edits"] for r in rows)
    assert edited_counts(pre_token_trees(redaction_edits(odd.limit(0)), ranks), ranks).count() == 0


def held_out(rows, column):
    return [(r[column], r["label"]) for r in rows]


@pytest.mark.parametrize("operator, label, flag", [(quality_scores, "quality", "predicted = 1"), (toxicity, "toxic", "rejected")])
def test_classifiers_on_held_out_labels(spark, operator, label, flag):
    folder = SF.replace("0.001", "0.1")
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    told = operator(docs, labels.where(~fold)).join(labels.where(fold).selectExpr("doc_id", f"{label} = 1 AS truth"), "doc_id").groupBy("truth", F.expr(flag).alias("said")).count()
    n = {(r["truth"], r["said"]): r["count"] for r in told.collect()}
    assert n.get((False, True), 0) <= 0.02 * n[(False, False)] and n[(True, True)] >= 0.85 * (n[(True, True)] + n.get((True, False), 0))


def test_classifiers_on_odd_rows(spark, odd):
    labels = spark.createDataFrame([(1, 1, 0), (7, 0, 1), (3, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    for few in (labels, labels.limit(0)):
        scored = quality_scores(odd, few).collect()
        assert len(scored) == odd.count() and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in scored)
        chained = toxicity(odd, few).collect()
        assert len(chained) == odd.count() and all(0 <= r["p_toxic"] <= 1 and r["rejected"] == (r["p_toxic"] >= 0.5) for r in chained)
    assert quality_scores(odd.limit(0), labels).count() == 0 == toxicity(odd.limit(0), labels).count()


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and 0 < out.count()
        empty = stage(spark, docs.limit(0), SF)
        assert empty.columns == docs.columns and empty.count() == 0
    rows = corpus_pipeline.run(spark, SF).collect()
    assert rows and len({(r["shard"], r["slot"]) for r in rows}) == len(rows)


def by_id(frame):
    return sorted((r["doc_id"], r["text"]) for r in frame.collect())


def test_stage_toxicity_drops_what_the_chain_rejects(spark, docs):
    rejected = {r["doc_id"] for r in QUERIES["op1_toxicity"](spark, SF).collect() if r["rejected"]}
    assert by_id(corpus_pipeline.drop_toxic(spark, docs, SF)) == [x for x in by_id(docs) if x[0] not in rejected]


def test_stage_near_copies_against_brute_force(spark, docs):
    links = similar({r["doc_id"]: r["text"] for r in docs.collect()})
    assert by_id(corpus_pipeline.drop_near_copies(spark, docs, SF)) == [x for x in by_id(docs) if min(reach(links, x[0])) == x[0]]


def test_stage_benchmark_against_brute_force(spark, docs):
    phrases = set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = words(r["text"])
        phrases |= {tuple(w[i : i + 10]) for i in range(max(1, len(w) - 9))} if w else set()
    lengths, expected, cut = {len(p) for p in phrases}, [], 0
    for key, text in by_id(docs):
        found = list(WORD.finditer((text or "").translate(A_TO_Z)))
        w = [m.group() for m in found]
        spans = sorted((i, i + n) for n in lengths for i in range(len(w) - n + 1) if tuple(w[i : i + n]) in phrases)
        joined = []
        for a, b in spans:
            if joined and a <= joined[-1][1]:
                joined[-1][1] = max(joined[-1][1], b)
            else:
                joined.append([a, b])
        for a, b in reversed(joined):
            text = text[: found[a].start()] + "\n" + text[found[b - 1].end() :]
        expected.append((key, text))
        cut += bool(joined)
    assert cut and by_id(corpus_pipeline.cut_benchmark(spark, docs, SF)) == expected


def test_stage_mix_against_sql(spark, docs):
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    expected = {i: taken // size for i, size, taken in duck.execute(f"SELECT doc_id, size, taken FROM ({ORACLES['op5_mix_sources']}) WHERE size > 0").fetchall()}
    copies = Counter(r["doc_id"] for r in corpus_pipeline.mix_sources(spark, docs, SF).collect())
    assert {i: copies[i] for i in expected} == expected


def test_stage_shards_against_brute_force(spark, docs):
    rows = sorted((r["doc_id"], len((r["text"] or "").encode()) + 16) for r in docs.collect())
    total, upto, slots, expected = sum(n for _, n in rows), 0, Counter(), {}
    got = {r["doc_id"]: (r["shard"], r["slot"]) for r in corpus_pipeline.assign_shards(spark, docs, SF).collect()}
    for key, n in rows:
        upto += n
        shard = min(40 * (2 * upto - n) // (2 * total), 39)
        expected[key] = shard, slots[shard]
        slots[shard] += 1
    assert got == expected


def test_license_scan_against_brute_force(docs):
    lines = {n: words(t) for n, t in TEMPLATES.items()}
    for r in license_scan(docs).collect():
        w = words(r["text"])
        spans = [(i, i + len(t), n) for n, t in lines.items() for i in range(len(w) - len(t) + 1) if w[i : i + len(t)] == t]
        whole = {n for a, b, n in spans if not any(c <= a and b <= d and d - c > b - a for c, d, _ in spans)}
        assert whole == set(filter(None, r["licenses"].split(",")))
