"""Similarity join on word n-grams: MinHash bands find candidates, full n-gram sets decide."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import binary_lists, constants, mix64, ngram_hashes, pieces, slices, text_bytes, tidy, word_hashes, words_of
from .components import components
from .groups import block_pairs, by_key, local_roots
from .storage import plain_columns, settled, small_batches


@dataclass(frozen=True)
class JoinSettings:
    """n: words per n-gram; threshold: least Jaccard similarity of a link; recall: share of pairs right at the threshold that some band must catch;
    hashes: MinHash values at most; block, block_grams: texts, and n-grams, that one task compares with as many others at once."""

    n: int = 5
    threshold: float = 0.8
    recall: float = 0.9999
    hashes: int = 256
    block: int = 1024
    block_grams: int = 1 << 20

    def bands(self) -> tuple[int, int]:
        """(bands, rows per band): the most rows per band, so the fewest false candidates, with which the bands that the recall needs fit into the hashes."""
        best = (math.ceil(math.log(1 - self.recall) / math.log(1 - self.threshold)), 1)
        for rows in range(2, 33):
            bands = math.ceil(math.log(1 - self.recall) / math.log(1 - self.threshold**rows))
            if bands * rows <= self.hashes:
                best = (bands, rows)
        return best


PIECE = 1 << 20
RESULT = ("class_id", "n_links", "class_size", "kept")


def ngram_sets(column: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct n-gram hashes of each text, and their bounds."""
    grams, bounds = ngram_hashes(words_of(*text_bytes(column), word_hashes), n)
    order = np.lexsort((grams, np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))))
    texts, grams = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds)), grams[order]
    first = np.ones(len(grams), dtype=bool)
    first[1:] = (grams[1:] != grams[:-1]) | (texts[1:] != texts[:-1])
    return grams[first], np.searchsorted(texts[first], np.arange(len(bounds)))


def min_hashes(grams: np.ndarray, bounds: np.ndarray, hashes: int) -> np.ndarray:
    """A line per text, a column per hash function; all texts have n-grams."""
    out = np.empty((len(bounds) - 1, hashes), dtype=np.uint64)
    multiply, add = constants(hashes, 101), constants(hashes, 202)
    for at, to in slices(bounds, 1 << 15):
        part, starts = grams[bounds[at] : bounds[to]], bounds[at:to] - bounds[at]
        for k in range(hashes):
            out[at:to, k] = np.minimum.reduceat(part * multiply[k] + add[k], starts)
    return out


def _sign(settings: JoinSettings):
    """(doc_id, mark, text) -> doc_id, mark, the digest of the n-gram set and the band keys; no row for a text without words or id."""
    bands, rows = settings.bands()

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = mix64(np.arange(1, bands + 1, dtype=np.uint64))
        weights = constants(rows, 303)
        for batch in batches:
            for part in pieces(batch, PIECE):
                grams, bounds = ngram_sets(part.column("text"), settings.n)
                has = np.flatnonzero(np.diff(bounds))
                signed = min_hashes(grams, np.append(bounds[has], bounds[-1]), bands * rows).reshape(-1, bands, rows)
                keys = mix64((signed * weights).sum(axis=2, dtype=np.uint64) ^ place).astype(np.int64)
                digests = [hashlib.blake2b(grams[bounds[i] : bounds[i + 1]].tobytes(), digest_size=16).digest() for i in has]
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": part.column("doc_id").take(pa.array(has)),
                        "mark": part.column("mark").take(pa.array(has)),
                        "set_key": pa.array(digests, pa.binary()),
                        "n_grams": pa.array(np.diff(bounds)[has]),
                        "bands": pa.ListArray.from_arrays(pa.array(np.arange(len(has) + 1, dtype=np.int32) * bands), pa.array(keys.ravel())),
                    }
                )

    return run


def _needed(settings: JoinSettings):
    """Of the members of a bucket, those that share no earlier bucket with some other member: only their pairs are compared here."""
    bands, _ = settings.bands()

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in by_key(batches, ["key"], settings.block * 4):
            keys = rows["bands"].flatten().to_numpy().reshape(-1, bands)
            here = int(np.flatnonzero(keys[0] == rows["key"][0].as_py())[0])
            n = len(keys)
            if rows["size"][0].as_py() > n:  # a part of a large bucket, whose other parts aren't seen here: all stay
                stay = np.ones(n, dtype=bool)
            else:
                shared = np.zeros((n, n), dtype=bool)
                for t in range(here):
                    if (keys[:, t] == keys[0, t]).all():
                        shared[:] = True
                        break
                    shared |= keys[:, t, None] == keys[None, :, t]
                np.fill_diagonal(shared, True)
                stay = ~shared.all(axis=1)
            if stay.any():
                kept = pa.array(np.flatnonzero(stay))
                size = int(rows["size"][0].as_py()) if rows["size"][0].as_py() > n else int(stay.sum())
                yield pa.RecordBatch.from_pydict({"key": rows["key"].take(kept), "rep": rows["rep"].take(kept), "size": pa.array(np.full(len(kept), size)), "grams_here": rows["grams_here"].take(kept)})

    return run


def _verify(settings: JoinSettings):
    """Rows of a block pair of one bucket -> (node, links, root): the texts linked to node by pairs that meet here first, and the smallest node of what they link here."""
    bands, _ = settings.bands()

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in by_key(batches, ["key", "i", "j"]):
            key, i, j = (rows[c][0].as_py() for c in ("key", "i", "j"))
            nodes, weight, side = (rows[c].to_numpy(zero_copy_only=False) for c in ("rep", "copies", "side"))
            sets = [np.frombuffer(x, dtype=np.uint64) for x in rows["grams"].to_pylist()]
            keys = rows["bands"].flatten().to_numpy().reshape(-1, bands)
            here = int(np.flatnonzero(keys[0] == key)[0])
            a, b = np.flatnonzero(side == i), np.flatnonzero(side == j)
            sizes = np.array([len(s) for s in sets])
            names, ids = np.unique(np.concatenate(sets), return_inverse=True)
            bounds = np.concatenate([[0], np.cumsum(sizes)])
            marked = np.zeros(len(names), dtype=bool)
            found_a, found_b = [], []
            for x in a:
                others = b[b > x] if i == j else b
                fresh = others[~(keys[others, :here] == keys[x, :here]).any(axis=1)]
                low, high = np.minimum(sizes[fresh], sizes[x]), np.maximum(sizes[fresh], sizes[x])
                fresh = fresh[low >= settings.threshold * high]  # sets of such unlike sizes can't be alike enough
                if not len(fresh):
                    continue
                own = ids[bounds[x] : bounds[x + 1]]
                marked[own] = True
                if len(fresh) * 4 >= len(sets):
                    common = np.add.reduceat(marked[ids], bounds[:-1], dtype=np.int64)[fresh]
                else:
                    common = np.array([np.count_nonzero(marked[ids[bounds[y] : bounds[y + 1]]]) for y in fresh])
                marked[own] = False
                near = fresh[common >= settings.threshold * (sizes[fresh] + sizes[x] - common)]
                found_a.append(np.full(len(near), x))
                found_b.append(near)
            if found_a and len(left := np.concatenate(found_a)):
                right = np.concatenate(found_b)
                links = np.bincount(left, weights=weight[right], minlength=len(nodes)) + np.bincount(right, weights=weight[left], minlength=len(nodes))
                used = np.flatnonzero(links)
                roots = local_roots(nodes, left, right)
                yield pa.RecordBatch.from_pydict({"node": pa.array(nodes[used]), "links": pa.array(links[used].astype(np.int64)), "root": pa.array(roots[used])})

    return run


def _payload(settings: JoinSettings):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, PIECE):
                grams, bounds = ngram_sets(part.column("text"), settings.n)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("rep", "copies", "bands")), binary_lists(grams, bounds)], names=["rep", "copies", "bands", "grams"])

    return run


def similarity_classes(docs: DataFrame, settings: JoinSettings = JoinSettings()) -> DataFrame:
    """docs (doc_id, text) -> the columns of docs without text, and class_id, n_links, class_size, kept.

    Two texts are linked if the Jaccard similarity of their sets of n consecutive lower-case words is at least the threshold; n_links counts all texts linked directly, copies
    included; class_id is the smallest doc_id that links reach, class_size the rows of the class, kept says that a row is the first of its class.

    Texts with one set are one node, weighted by their number, so copies are never compared or expanded. Band keys of the nodes are shuffled, eight bytes a band; buckets of one are dropped. In a bucket only
    members with a partner that no earlier bucket shares stay, so a pair of near copies travels once, not once per band. Their full n-gram sets are then compared within the bucket, a pair only in its
    first common bucket, so that links are counted without emitting a row per pair; a bucket of more than `block` members or `block_grams` n-grams is split into block pairs, each a group of its own.
    What is emitted is a line per member and bucket. Links become classes by rounds of joins.

    A text of fewer than n words has one n-gram: all of them. Null texts, texts without words and null ids link with nothing; such a row has itself as class. Each different text of an id is
    a text of its own: rows that share an id are linked only if their texts are, and classes with one smallest id have one class_id. All rows of the smallest id of a class have kept true (first_of_each leaves one). An empty table gives no rows. Columns named like a result are replaced.
    """
    return _classes(docs, settings).drop("_its_class", "_its_mark")


def _classes(docs: DataFrame, settings: JoinSettings) -> DataFrame:
    """similarity_classes, with a name of the class and a hash of the text."""
    keep = [c for c in plain_columns(docs, *RESULT) if c != "text"]
    small_batches(docs)
    source = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("mark"), "text")
    signed = settled(source.mapInArrow(_sign(settings), "doc_id long, mark long, set_key binary, n_grams long, bands array<bigint>"), "signed")
    nodes = signed.groupBy("set_key").agg(F.min(F.struct("doc_id", "mark")).alias("first"), F.count("*").alias("copies"))
    nodes = nodes.select("set_key", F.xxhash64("set_key").alias("rep"), F.col("first.doc_id").alias("first_id"), F.col("first.mark").alias("first_mark"), "copies")
    reps = signed.join(nodes, "set_key").where("doc_id = first_id AND mark = first_mark").dropDuplicates(["set_key"]).select("rep", "first_id", "first_mark", "copies", "n_grams", "bands")
    reps = settled(reps, "nodes")
    members = reps.select("rep", "n_grams", F.explode("bands").alias("key"))
    shared = members.groupBy("key").agg(F.count("*").alias("size"), F.sum("n_grams").alias("grams_here")).where("size > 1")
    candidates = members.drop("n_grams").join(shared, "key").join(reps.select("rep", "bands"), "rep")
    grouped = candidates.repartition("key").sortWithinPartitions("key")
    needed = settled(grouped.mapInArrow(_needed(settings), "key long, rep long, size long, grams_here long"), "needed")
    matched = reps.join(needed.select("rep").distinct(), "rep")
    texts = source.withColumnsRenamed({"doc_id": "first_id", "mark": "first_mark"}).join(matched, ["first_id", "first_mark"]).dropDuplicates(["rep"])
    payload = texts.mapInArrow(_payload(settings), "rep long, copies long, bands array<bigint>, grams binary")
    blocks = F.ceil(F.greatest(F.col("size") / settings.block, F.least(F.col("size"), F.col("grams_here") / settings.block_grams))).cast("int")
    dealt = block_pairs(needed.withColumn("blocks", blocks).drop("size", "grams_here").join(payload, "rep"), "rep")
    verified = dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    found = settled(verified.mapInArrow(_verify(settings), "node long, links long, root long"), "found")
    classes = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    per_node = reps.select("rep", "first_id", "copies").join(links.withColumnRenamed("node", "rep"), "rep", "left").join(classes.withColumnRenamed("node", "rep"), "rep", "left")
    per_node = per_node.select("rep", "first_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("_its_class"), "copies")
    sizes = per_node.groupBy("_its_class").agg(F.min("first_id").alias("class_id"), F.sum("copies").alias("class_size"))
    by_set = nodes.select("set_key", "rep").join(per_node.drop("first_id", "copies"), "rep").join(sizes, "_its_class")
    by_text = signed.select(F.col("doc_id").alias("_its_id"), F.col("mark").alias("_of_mark"), "set_key").distinct().join(by_set.drop("rep"), "set_key").drop("set_key")
    return (
        docs.select(*keep, F.xxhash64("text").alias("_its_mark"))
        .join(by_text, (F.col("doc_id") == F.col("_its_id")) & (F.col("_its_mark") == F.col("_of_mark")), "left")
        .select(
            *keep,
            F.coalesce("class_id", "doc_id").alias("class_id"),
            F.coalesce("n_links", F.lit(0)).alias("n_links"),
            F.coalesce("class_size", F.lit(1)).alias("class_size"),
            F.coalesce(F.col("class_id") == F.col("doc_id"), F.lit(True)).alias("kept"),
            F.coalesce("_its_class", "_its_mark").alias("_its_class"),
            "_its_mark",
        )
    )


def first_of_each(docs: DataFrame, settings: JoinSettings = JoinSettings()) -> DataFrame:
    """The rows of docs with one document of each class left, the one with the smallest id; of several texts of that id in the class the one of the smallest hash, of rows that repeat
    a text and its id the first by content. Rows without an id all stay."""
    classes = _classes(docs.select("doc_id", "text"), settings).where("kept AND doc_id IS NOT NULL")
    per_class = classes.groupBy(F.col("doc_id").alias("_its_id"), "_its_class", "_its_mark").agg(F.count("*").alias("_n"))
    stay = per_class.groupBy("_its_id", "_its_class").agg(F.min(F.struct("_its_mark", "_n")).alias("_first"))
    stay = settled(stay.select("_its_id", F.col("_first._its_mark").alias("_its_mark"), F.col("_first._n").alias("_n")), "stay")
    same = (F.col("doc_id") == F.col("_its_id")) & (F.xxhash64("text") == F.col("_its_mark"))
    kept = docs.join(stay.where("_n = 1"), same, "left_semi")
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    repeated = docs.join(stay.where("_n > 1"), same, "left_semi").groupBy(F.col("doc_id").alias("_its_id"), F.xxhash64("text").alias("_its_mark")).agg(F.min_by(row, F.to_json(row)).alias("_row"))
    return kept.unionByName(repeated.select("_row.*")).unionByName(docs.where("doc_id IS NULL"))
