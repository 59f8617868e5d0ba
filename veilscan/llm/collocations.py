"""Phrase collocations: n-grams of two to four words, counted without loss in quotient filters that are merged across shards, scored by their weakest cut."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrays import tidy
from .groups import by_key
from .quotient_filter import CountingFilter, halves, packed_ngrams, permuted, restored, summed, unpacked_ngrams
from .storage import settled, small_batches

# A-Z become a-z; every character that ends a piece becomes a full stop, tabs become spaces.
_PLAIN = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ,;:!?\n\x0b\x0c\r\t", b"abcdefghijklmnopqrstuvwxyz" + b"." * 9 + b" ")
_NULL_LANG = "und"
# Twice a phrase's share of its parts, in millionths; the product passes 64 bits.
SCORE = "cast((cast(2000000 as decimal(10,0)) * cast(a as decimal(19,0))) div (cast(l as decimal(19,0)) + cast(r as decimal(19,0))) as bigint)"


@dataclass(frozen=True)
class PhraseSettings:
    """least: occurrences of a candidate; widest: words of a phrase at most; covered: percent of a phrase's occurrences that a longer one may have before it drops; top: phrases per language;
    shard: bytes of text that one dictionary covers; part: n-grams that one merge takes, about; salts: of a language before its ranking."""

    least: int = 30
    widest: int = 4
    covered: int = 80
    top: int = 2000
    shard: int = 1 << 23
    part: int = 1 << 22
    salts: int = 64


def words_and_breaks(text: str) -> list[bytes]:
    """The words of a text, with a full stop wherever a piece ends."""
    return text.encode().translate(_PLAIN).replace(b".", b" . ").split()


class _Numbers(dict):
    """Words -> numbers from 0 in order of appearance; -1 ends a piece."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self) - 1
        return n


def _shards(settings: PhraseSettings):
    """Texts -> a row per shard and language: word numbers of the shard's own dictionary, -1 between pieces, and that dictionary with counts."""

    def row(name: str, lang: str, codes: list[np.ndarray], numbers: _Numbers) -> pa.RecordBatch:
        whole = np.concatenate(codes)
        words = list(numbers)[1:]
        counts = np.bincount(whole[whole >= 0], minlength=len(words))
        values = [[name], [lang], [whole.tobytes()], [[w.decode() for w in words]], [counts.tolist()]]
        kinds = [pa.string(), pa.string(), pa.binary(), pa.list_(pa.string()), pa.list_(pa.int64())]
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], names=["shard", "lang", "codes", "words", "counts"])

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made = TaskContext.get().partitionId(), 0
        open_shards: dict[str, tuple[list[np.ndarray], _Numbers, list[int]]] = {}
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                codes, numbers, size = open_shards.setdefault(lang, ([], _Numbers({b".": -1}), [0]))
                found = words_and_breaks(text)
                codes.append(np.array([*map(numbers.__getitem__, found), -1], dtype=np.int32))
                size[0] += len(text)
                if size[0] >= settings.shard:
                    yield row(f"{task}-{made}", lang, codes, numbers)
                    made += 1
                    del open_shards[lang]
        for lang, (codes, numbers, _) in open_shards.items():
            yield row(f"{task}-{made}", lang, codes, numbers)
            made += 1

    return run


def _count(settings: PhraseSettings, bits: int, part_bits: int):
    """Shards with the global numbers of their words -> packed filters of their n-grams, cut by the top bits of the permuted n-gram."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for codes, words, own, number in zip(*(batch.column(c) for c in ("codes", "n_words", "own", "number")), strict=True):
                table = np.zeros(words.as_py() + 1, dtype=np.uint64)  # the last place is for -1; 0 is no word
                table[np.array(own.as_py() or [], dtype=np.int64)] = np.array(number.as_py() or [], dtype=np.uint64)
                ids = table[np.frombuffer(codes.as_buffer(), dtype=np.int32)]
                whole, out = ids > 0, []
                for n in range(2, settings.widest + 1):
                    if len(ids) < n:
                        break
                    whole = (ids > 0)[: len(ids) - n + 1] & whole[1:] if n > 2 else (ids > 0)[:-1] & (ids > 0)[1:]
                    at = np.flatnonzero(whole)
                    left_bits, right_bits = (bits * k for k in halves(n))
                    left, right = permuted(*packed_ngrams([ids[at + k] for k in range(n)], bits), left_bits, right_bits)
                    parts = (left >> np.uint64(left_bits - part_bits)).astype(np.uint16 if part_bits <= 16 else np.uint32)
                    order = np.argsort(parts, kind="stable")
                    left, right, parts = left[order], right[order], parts[order]
                    for a, b in pairwise(np.append(np.flatnonzero(np.concatenate([[True], parts[1:] != parts[:-1]])), len(parts)) if len(parts) else []):
                        one = CountingFilter(*summed(left[a:b], right[a:b], None, left_bits - part_bits, right_bits))
                        out.append((n, int(parts[a]), one.pack(left_bits, right_bits, part_bits)))
                if out:
                    n, part, filters = zip(*out, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(n, pa.int32()), pa.array(part, pa.int64()), pa.array(filters, pa.binary())], names=["n", "part", "filter"])

    return run


def _merge(settings: PhraseSettings, bits: int, part_bits: int):
    """The filters of a part, from all shards -> the n-grams that occur often enough. Some filters at a time are merged into one, and those into others of like size, so the part is never unpacked whole."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, levels, loose = None, [], []

        def widths(n: int) -> tuple[int, int, int]:
            left, right = halves(n)
            return bits * left, bits * right, part_bits

        def lift() -> None:
            if loose:
                levels.append(CountingFilter.merged(loose, *widths(key[0])))
                loose.clear()
            while len(levels) > 1 and len(levels[-2].left) <= 2 * len(levels[-1].left):
                levels[-2:] = [CountingFilter.merged(levels[-2:], *widths(key[0]))]

        def done() -> pa.RecordBatch:
            lift()
            n, whole = key[0], CountingFilter.merged(levels, *widths(key[0]))
            levels.clear()
            often = np.flatnonzero(whole.counts >= settings.least)
            words = unpacked_ngrams(*restored(whole.left[often], whole.right[often], *widths(n)[:2]), n, bits)
            ids = np.stack(words, axis=1).ravel()
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(often) + 1, dtype=np.int32) * n), pa.array(ids, pa.int64()))
            return pa.RecordBatch.from_arrays([lists, pa.array(whole.counts[often])], names=["ids", "f"])

        for rows in by_key(batches, ["n", "part"], 256):
            now = rows["n"][0].as_py(), rows["part"][0].as_py()
            if key not in (None, now):
                yield done()
            key = now
            for data in rows["filter"]:
                loose.append(CountingFilter.unpack(data.as_py(), *widths(key[0])[:2], key[1]))
                if sum(len(f.left) for f in loose) >= settings.part:
                    lift()
        if key is not None:
            yield done()

    return run


def _numbered(words: DataFrame, buckets: int) -> DataFrame:
    """Numbers from 1 without gaps, in a column number: rows are numbered within buckets, each behind the buckets before it."""
    dealt = words.withColumn("_bucket", F.pmod(F.xxhash64("lang", "word"), F.lit(buckets)).cast("int"))
    sizes = dealt.groupBy("_bucket").agg(F.count("*").alias("_n"))
    before = sizes.select("_bucket", (F.sum("_n").over(Window.orderBy("_bucket")) - F.col("_n")).alias("_before"))
    placed = dealt.withColumn("_place", F.row_number().over(Window.partitionBy("_bucket").orderBy("lang", "word")))
    return placed.join(F.broadcast(before), "_bucket").withColumn("number", F.col("_before") + F.col("_place")).drop("_bucket", "_before", "_place")


def collocations(docs: DataFrame, settings: PhraseSettings = PhraseSettings()) -> DataFrame:
    """docs (text, lang) -> lang, rank, phrase, a, l, r, n, score: the best phrases of each language.

    Texts are lower-cased (A-Z), cut into pieces at `[.,;:!?]` and line breaks, pieces into words at spaces and tabs. A phrase of 2 to `widest` words that occurs `least` times and more is scored by its weakest cut
    into two (f: occurrences): floor(2000000 * f(phrase) / (f(first part) + f(rest))), of equal cuts the first; it drops where one longer phrase has `covered` percent of its occurrences.

    Shards (about 8 MB of texts of one language) are coded once with a dictionary of their own; the dictionaries are summed over the corpus, words that occur `least` times get dense numbers, and
    each shard receives those of its own words only. A phrase has no rarer word, so rarer ones part pieces. Packed n-grams are permuted, counted per shard in quotient filters, cut by
    their top bits into parts whose number follows the corpus, and merged by part; what is sent is a filter, an entry per different n-gram of a shard. Scores are decimals of 38 digits divided as whole numbers.
    The ranking first takes the best of salted groups of each language, ties included, then of the language; phrases are spelled out only for those.

    A null text is empty, a null language `und`. Repeated rows count each. Texts without words add nothing; an empty table gives no rows. Other columns are not looked at.
    """
    small_batches(docs)
    source = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(_NULL_LANG)).alias("lang"), "text").where("text IS NOT NULL")
    shards = settled(source.mapInArrow(_shards(settings), "shard string, lang string, codes binary, words array<string>, counts array<bigint>"), "shards")
    own = shards.select("shard", "lang", F.posexplode(F.arrays_zip(F.col("words").alias("word"), F.col("counts").alias("count"))).alias("own", "_pair"))
    own = own.select("shard", "lang", "own", F.col("_pair.word").alias("word"), F.col("_pair.count").alias("count"))
    summed_up = own.groupBy("lang", "word").agg(F.sum("count").alias("f"))
    words = settled(_numbered(summed_up.where(F.col("f") >= settings.least), 256), "words")
    sizes = shards.select("lang", F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x).alias("n")).groupBy("lang").agg(F.sum("n").alias("n"))
    vocabulary, occurrences = words.count(), sizes.agg(F.sum("n")).first()[0] or 0
    bits = max(2, int(vocabulary).bit_length())
    part_bits = min(bits, max(0, int(occurrences // settings.part).bit_length()))

    wanted = own.join(words.select("lang", "word", "number"), ["lang", "word"]).groupBy("shard").agg(F.collect_list(F.struct("own", "number")).alias("_pairs"))
    coded = shards.select("shard", "codes", F.size("words").alias("n_words")).join(wanted, "shard")
    counted = coded.select("codes", "n_words", F.col("_pairs.own").alias("own"), F.col("_pairs.number").alias("number"))
    filters = counted.mapInArrow(_count(settings, bits, part_bits), "n int, part long, filter binary")
    merged = filters.repartition("n", "part").sortWithinPartitions("n", "part")
    phrases = settled(merged.mapInArrow(_merge(settings, bits, part_bits), "ids array<bigint>, f long"), "phrases")

    grams = phrases.unionByName(words.select(F.array(F.col("number").cast("long")).alias("ids"), "f"))
    size = F.size("ids")
    cuts = phrases.select("ids", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    cuts = cuts.select("ids", "a", "k", F.slice("ids", F.lit(1), F.col("k")).alias("first"), F.slice("ids", F.col("k") + 1, size - F.col("k")).alias("rest"))
    cuts = cuts.join(grams.select(F.col("ids").alias("first"), F.col("f").alias("l")), "first").join(grams.select(F.col("ids").alias("rest"), F.col("f").alias("r")), "rest")
    weakest = cuts.withColumn("score", F.expr(SCORE)).groupBy("ids", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("_cut"))
    longer = phrases.where(size > 2).select(F.explode(F.array(F.slice("ids", F.lit(1), size - 1), F.slice("ids", F.lit(2), size - 1))).alias("ids"), "f")
    longer = longer.groupBy("ids").agg(F.max("f").alias("longer"))
    uncovered = weakest.join(longer, "ids", "left").where(F.col("longer").isNull() | (100 * F.col("longer").cast("decimal(20,0)") < settings.covered * F.col("a").cast("decimal(20,0)")))
    named = uncovered.join(words.select("lang", "number"), F.get("ids", F.lit(0)) == F.col("number"))
    scored = named.select("lang", "ids", "a", F.col("_cut.l").alias("l"), F.col("_cut.r").alias("r"), F.col("_cut.score").alias("score"))
    best = [F.desc("score"), F.desc("a")]
    salted = scored.withColumn("_salt", F.pmod(F.xxhash64("ids"), F.lit(settings.salts)))
    near = salted.withColumn("_at", F.rank().over(Window.partitionBy("lang", "_salt").orderBy(*best))).where(F.col("_at") <= settings.top).drop("_salt")
    near = near.withColumn("_at", F.rank().over(Window.partitionBy("lang").orderBy(*best))).where(F.col("_at") <= settings.top).drop("_at")
    spelled = near.select("*", F.posexplode("ids").alias("_place", "number")).join(words.select("number", "word"), "number")
    spelled = spelled.groupBy("lang", "ids", "a", "l", "r", "score").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_place", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    ranked = spelled.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best, "phrase")).cast("long")).where(F.col("rank") <= settings.top)
    return ranked.join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
