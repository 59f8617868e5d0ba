"""Conversation repair, phrase collocations and packing against brute force, on whole small tables and on rows with nulls, ties, repeats, clashing columns and long groups."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import pairwise

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from veilscan.llm.collocations import SCORE, PhraseSettings, collocations
from veilscan.llm.conversation_repair import ASSISTANT, NEXT, START, RepairCosts, arcs_of, cheapest_edits, conversation_repairs, repaired_turns
from veilscan.llm.oracles import ORACLES
from veilscan.llm.packing import Bins, PackSettings, WordIds, least_bins, pack, packed
from veilscan.llm.queries import QUERIES, damaged
from veilscan.llm.quotient_filter import CountingFilter, halves, packed_ngrams, permuted, restored, summed, unpacked_ngrams

SF = "/root/testdata/sf0.001"
A_TO_Z = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
VOCABULARY = "/opt/tokenizers/word_bpe_49k.json"


def least_edits(symbols):
    """A dynamic program over whole strings: the least (cost, audit)."""
    best = {START: (0, "")}

    def inserted(found):
        for _ in range(3):
            for state, (cost, audit) in list(found.items()):
                new = (cost + 2, audit + "I")
                if NEXT[state] not in found or new < found[NEXT[state]]:
                    found[NEXT[state]] = new
        return found

    for symbol in symbols:
        after = {}
        for state, (cost, audit) in inserted(best).items():
            for letter, price, taken, to in arcs_of(symbol, state, RepairCosts()):
                new = (cost + price, audit + letter)
                if taken and (to not in after or new < after[to]):
                    after[to] = new
        best = after
    return min(v for k, v in inserted(best).items() if k in (START, ASSISTANT))


@pytest.mark.parametrize("block", [1, 3, 32])
def test_auction_finds_the_least_audit(block):
    draw = random.Random(block)
    for length in [0, 1, 2, 3, 4, 5, 8, 30, 150] * 30:
        symbols = bytes(draw.randrange(16) if draw.random() < 0.4 else draw.choice([4, 8, 12]) for _ in range(length))
        assert cheapest_edits(symbols, RepairCosts(block=block)) == least_edits(symbols)


def repaired_by_hand(rows):
    """rows (turn, role, text) of one conversation -> its line of results, from the statement of the operator."""
    space = lambda x: " " if x is None else x
    rows = sorted(((t is not None, t or 0), space(r), space(x)) for t, r, x in rows)
    seen, symbols, faults = set(), [], []
    for _, role, text in rows:
        bare = text.strip(" \t\n\x0b\x0c\r")
        fault = 2 if not bare else 3 if (role, text) in seen else 0 if bare[-1] in ".!?" else 1
        seen.add((role, text))
        faults.append(fault)
        symbols.append({"s": 1, "u": 2, "a": 3}.get(role[:1], 0) * 4 + fault)
    turns = {t for (known, t), _, _ in rows if known}
    cost, audit = least_edits(symbols)
    lines, at, state, need = [], 0, 0, {0: "user", 1: "user", 2: "assistant", 3: "user"}
    for letter in audit:
        if letter == "I":
            lines.append(need[state] + ":")
            state = NEXT[state]
            continue
        _, role, text = rows[at]
        at += 1
        if letter != "D":
            lines.append(f"{role if letter == 'K' else need[state]}:{text}")
            state = 1 if letter == "K" and role[0] == "s" else NEXT[state]
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in pairwise(rows))
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    return gaps, faults.count(2), faults.count(3), faults.count(1), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()


COLUMNS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def check_repairs(frame):
    given = defaultdict(list)
    for r in frame.collect():
        given[r["conv_id"]].append((r["turn"], r["role"], r["text"]))
    got = {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in conversation_repairs(frame).collect()}
    assert got == {k: repaired_by_hand(v) for k, v in given.items()}


@pytest.fixture(scope="module")
def talks(spark):
    draw = random.Random(8)
    roles, texts = ["user", "assistant", "system", "u", "User", "", None, "tool"], ["Yes.", "No", " ", None, "", "Why?\n", "é! ", "Yes.", "x" * 300_000 + "."]
    rows = [(c, draw.choice([None, 0, 1, 2, 5, 9]), draw.choice(roles[:3] if draw.random() < 0.7 else roles), draw.choice(texts), -1) for c in [None, 1, 2, 3, 4, 5] for _ in range(draw.randrange(1, 12))]
    rows += [(7, -(1 << 63), "user", "a.", 0), (7, (1 << 63) - 1, "assistant", "b.", 0)]
    rows += [(8, k // 2, ("user", "assistant")[k % 3 % 2], f"line {k % 400}{'.' * (k % 5 > 0)}", 0) for k in range(1500)] + [(9, 3, "user", "same.", 1)] * 70
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, gaps int")


def test_repairs_of_odd_rows(talks):
    assert conversation_repairs(talks.where("conv_id = 7")).first()["gaps"] == (1 << 63) - 1
    check_repairs(talks.where("conv_id IS NULL OR conv_id <> 7"))
    assert conversation_repairs(talks.limit(0)).count() == 0


def test_repaired_turns_alternate(talks):
    rows = repaired_turns(talks.withColumn("place", F.lit("clash")).where("conv_id IS NULL OR conv_id < 9")).collect()
    by_conv = defaultdict(list)
    for r in sorted(rows, key=lambda r: r["place"]):
        by_conv[r["conv_id"]].append(r)
    for own in by_conv.values():
        assert [r["place"] for r in own] == list(range(len(own)))
        assert re.fullmatch("(s?(ua)+)?", "".join(r["role"][0] for r in own))
        assert all(r["text"] == "" for r in own if r["edit"] == "I")


def test_damaged_tables_repaired(spark):
    conversations = spark.read.parquet(f"{SF}/conversations.parquet")
    check_repairs(damaged(conversations))
    every = {r["conv_id"] for r in conversations.select("conv_id").distinct().collect()}
    rows = QUERIES["op11_conversation_repair"](spark, SF).collect()
    assert {r["conv_id"] for r in rows} == every and len(rows) == len(every)


@pytest.mark.parametrize("folder", [SF, SF.replace("0.001", "0.01")])
def test_repairs_by_sql(spark, folder):
    """Whole tables; adjacent equal rows among them, of which the later one is the duplicate."""
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW conversations AS SELECT * FROM '{folder}/conversations.parquet'")
    cursor = duck.execute(ORACLES["op11_conversation_repair"])
    names = [d[0] for d in cursor.description]
    assert sorted(map(tuple, QUERIES["op11_conversation_repair"](spark, folder).select(*names).collect())) == sorted(cursor.fetchall())


def test_damage(spark):
    rows = [(c, t, None if t == 3 else "assistant", None if t == 4 else f"Text {t}. Ok! {c}") for c in [None, 0, 1, 2] for t in [None, *range(40)]]
    got = Counter(tuple(r) for r in damaged(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect())
    want = Counter()
    for c, t, role, text in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = "user" if kind == 4 else role or " ", "" if kind == 1 else re.sub("[.!?]", "", text or " ") if kind == 2 else text or " "
        want[(c, t, role, text)] += {0: 0, 3: 2}.get(kind, 1)
    assert got == +want


@pytest.mark.parametrize(("name", "table"), [("op11_conversation_repair", "conversations"), ("op12_phrase_collocations", "documents")])
def test_sql_of_odd_tables(spark, tmp_path, name, table):
    """The query and its SQL agree on rows with nulls as well; the other tests compare them on the given tables."""
    draw = random.Random(4)
    if table == "conversations":
        rows = [(draw.choice([None, 1, 2, 3]), draw.choice([None, 0, 1, 2, 3]), draw.choice([None, "user", "assistant", "system", ""]), draw.choice([None, "", "Yes.", "no", "? "])) for _ in range(40)]
        frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    else:
        rows = [(k, draw.choice([None, "", "A b\tc D, a B c d. e"]) if k % 3 else "a b c. a b c d é\x0bA b " * 5, draw.choice([None, "en", "und"])) for k in range(90)]
        frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    frame.write.parquet(f"{tmp_path}/{table}.parquet")
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet/*.parquet'")
    cursor = duck.execute(ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(map(repr, map(tuple, QUERIES[name](spark, str(tmp_path)).select(*names).collect()))) == sorted(map(repr, cursor.fetchall()))


def phrases_by_hand(rows, settings=PhraseSettings()):
    counts, totals, out = defaultdict(Counter), Counter(), []
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(A_TO_Z)):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for n in range(1, 5):
                counts[lang].update(tuple(words[i : i + n]) for i in range(len(words) - n + 1))
    for lang, f in counts.items():
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= settings.least}
        dropped = {p[i : i + m] for p, a in candidates.items() for m in range(2, len(p)) for i in range(len(p) - m + 1) if 100 * a >= settings.covered * f[p[i : i + m]]}
        lines = []
        for p, a in candidates.items():
            if p not in dropped:
                score, k = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
                lines.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, p, left, right) in enumerate(sorted(lines)[: settings.top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, totals[lang], -score))
    return sorted(out)


def test_collocations(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").unionByName(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    want = phrases_by_hand([(r["lang"], r["text"]) for r in docs.collect()])
    assert want and sorted(tuple(r) for r in collocations(docs).collect()) == want


@pytest.mark.parametrize("settings", [PhraseSettings(), PhraseSettings(least=2, top=7, shard=500, part=100, salts=3)])
def test_collocations_of_odd_rows(spark, settings):
    """Nulls, empties, ties, repeated rows, a long text, a clash of names; small shards and parts, so that filters are cut and merged."""
    draw = random.Random(2)
    rows = [(draw.choice(["en", None, "de"]), " ".join(draw.choice("a b C d é. ü, the of\tx".split(" ")) for _ in range(40)), 0) for _ in range(60)]
    rows += [("en", None, 1), ("fr", "", 1), ("fr", None, 1), (None, "!!", 1), ("en", "One two three four " * 5000, 2)] + [("xx", "same words again", 3)] * 40
    docs = spark.createDataFrame(rows, "lang string, text string, n int")
    assert sorted(tuple(r) for r in collocations(docs, settings).collect()) == phrases_by_hand([r[:2] for r in rows], settings)
    assert collocations(docs.limit(0)).count() == 0


def test_scores_beyond_64_bits(spark):
    frame = spark.sql("SELECT 9000000000000000000L AS a, 9000000000000000000L AS l, 9000000000000000001L AS r")
    assert frame.selectExpr(f"{SCORE} AS s").first()["s"] == 2_000_000 * 9 * 10**18 // (18 * 10**18 + 1)


@pytest.mark.parametrize("bits", [2, 7, 16, 21, 32])
@pytest.mark.parametrize("n", [2, 3, 4])
def test_filters_lose_nothing(n, bits):
    draw = np.random.default_rng([n, bits])
    words = [draw.integers(0, 1 << bits, 3000).astype(np.uint64) for _ in range(n)]
    for w in words:
        w[1000:2000] = w[:1000]
    want = Counter(zip(*(w.tolist() for w in words), strict=True))
    left_bits, right_bits = (bits * k for k in halves(n))
    part_bits = min(2, left_bits)
    merged = {}
    for at in range(0, 3000, 600):
        left, right, counts = summed(*permuted(*packed_ngrams([w[at : at + 600] for w in words], bits), left_bits, right_bits), None, left_bits, right_bits)
        parts = (left >> np.uint64(left_bits - part_bits)).astype(np.int64)
        for part in np.unique(parts):
            own = parts == part
            packed_filter = CountingFilter(left[own], right[own], counts[own]).pack(left_bits, right_bits, part_bits)
            again = CountingFilter.unpack(packed_filter, left_bits, right_bits, int(part))
            assert (again.left == left[own]).all() and (again.right == right[own]).all() and (again.counts == counts[own]).all()
            merged[part] = CountingFilter.merged([merged[part], again], left_bits, right_bits, part_bits) if part in merged else again
    got = Counter()
    for one in merged.values():
        for *gram, count in zip(*unpacked_ngrams(*restored(one.left, one.right, left_bits, right_bits), n, bits), one.counts, strict=True):
            got[tuple(map(int, gram))] += int(count)
    assert got == want


def test_filters_are_compact():
    draw = np.random.default_rng(0)
    words = [draw.integers(1, 1 << 16, 1 << 20).astype(np.uint64) for _ in range(4)]
    left, right, counts = summed(*permuted(*packed_ngrams(words, 16), 32, 32), None, 32, 32)
    assert len(CountingFilter(left, right, counts).pack(32, 32, 0)) < 6.6 * len(left)


@pytest.fixture(scope="module")
def vocabulary():
    with open(VOCABULARY, encoding="utf-8") as file:
        return file.read()


def test_word_ids_are_those_of_whole_texts(vocabulary):
    from tokenizers import Tokenizer

    whole, draw = Tokenizer.from_str(vocabulary), random.Random(3)
    alphabet = "aB9 .,'\"é́̌JΣ\t\n\x1c !?-İ<|>s"
    texts = ["".join(draw.choice(alphabet) for _ in range(60)) for _ in range(2000)] + ["", "  ", "J̌ q. <|endoftext|>. x", "don't 'S."]
    for text, ids in zip(texts, WordIds(vocabulary).of(texts), strict=True):
        assert np.frombuffer(ids, dtype="<u4").tolist() == whole.encode(text, add_special_tokens=False).ids


def check_packing(rows, docs, vocabulary, capacity):
    """Every piece by whole encoding, sequences without gaps or overflow -> number of sequences and the bound."""
    from tokenizers import Tokenizer

    whole, want = Tokenizer.from_str(vocabulary), Counter()
    for doc_id, text in docs:
        ids = [*whole.encode(text or "", add_special_tokens=False).ids, 1]
        for k, at in enumerate(range(0, len(ids), capacity)):
            own = ids[at : at + capacity]
            want[(doc_id, k, at, len(own), zlib.crc32(np.array(own, dtype="<u4").tobytes()))] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    sequences = defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences), least_bins(np.array([r["length"] for r in rows]), capacity)


def test_packing_of_a_whole_table(spark, vocabulary):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    rows = QUERIES["op13_best_fit_packing"](spark, "/root/testdata/sf0.01").collect()
    used, bound = check_packing(rows, docs, vocabulary, 4096)
    assert used <= bound + 1


@pytest.mark.parametrize("block", [1 << 14, 50])
def test_packing_of_odd_rows(spark, vocabulary, block):
    """Nulls, empties, repeats, a text of many sequences, names that clash; small blocks, so that loose bins meet in later rounds."""
    draw = random.Random(block)
    rows = [(draw.choice([None, k]), " ".join("word" for _ in range(draw.randrange(60))), 1) for k in range(400)]
    rows += [(1, None, 2), (2, "", 2), (2, "", 2), (3, "long text, " * 3000, 3)] + [(4, "copy " * 20, 4)] * 300
    docs = spark.createDataFrame(rows, "doc_id long, text string, length int")
    got = packed(docs, vocabulary, PackSettings(capacity=64, block=block)).collect()
    used, bound = check_packing(got, [r[:2] for r in rows], vocabulary, 64)
    assert used <= bound * (1.01 if block > 1000 else 1.03) + 1
    assert packed(docs.limit(0), vocabulary).count() == 0


def test_rounds_save_bins(spark, vocabulary):
    rows = [(k, " ".join("word" for _ in range(20 + k * 7 % 40))) for k in range(1000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bins = [packed(docs, vocabulary, PackSettings(capacity=256, block=20, rounds=n)).select("sequence_id").distinct().count() for n in (1, 4)]
    assert bins[1] < bins[0]


def test_search_empties_bins():
    """From one piece per bin, moves and both exchanges are made, and pieces stay whole."""
    made = np.zeros(3, dtype=int)
    for seed in range(6):
        draw = random.Random(seed)
        sizes = [draw.choice([1366, 1365, 2731, 2000, 700, 3, 1200]) if seed % 2 else draw.randrange(600, 1900) for _ in range(300)]
        where, _, fill, moves = pack(sizes, list(range(300)), PackSettings())
        made += moves
        sums = Counter()
        for bin_number, size in zip(where, sizes, strict=True):
            sums[bin_number] += size
        assert max(sums.values()) <= 4096 and [sums[b] for b in where] == fill.tolist()
        assert len(set(where)) <= 1.1 * least_bins(np.array(sizes), 4096)
    assert made.all()


def test_exchanges_raise_squared_fill():
    """Each kind of exchange, on bins where no other helps."""
    for start, kind in [([[700, 600], [550, 3400]], 1), ([[700, 600], [1200, 2700]], 2), ([[1300], [600, 600, 2700]], 2)]:
        bins = Bins(4096)
        for number, members in enumerate(start):
            bins.open([(size, 10 * number + k) for k, size in enumerate(members)])
        before = sum(f * f for f in bins.fill)
        bins.drain(0)
        assert bins.moves[kind] and sum(f * f for f in bins.fill) > before and sum(bins.fill) == sum(map(sum, start))


def test_bound_of_bins():
    assert least_bins(np.array([4096, 1, 2049, 2049]), 4096) == 3
    assert least_bins(np.array([3000, 3000, 1500, 1500]), 4096) == 3
    assert least_bins(np.zeros(0, dtype=np.int64), 4096) == 0
