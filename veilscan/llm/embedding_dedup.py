"""Near-duplicate vectors: p-stable Euclidean hashing of normalised vectors into several tables, then exact cosines."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import constants, mix64, tidy
from .components import components
from .groups import block_pairs, by_key, local_roots
from .storage import plain_columns, settled, small_batches

RESULT = ("n_links", "component_id", "kept")


@dataclass(frozen=True)
class VectorSettings:
    """threshold: least cosine of a link; recall: share of pairs right at the threshold that some table must catch; width: of a quantised projection;
    load: unrelated vectors that a vector may meet in a table, on average; block: vectors that one task compares with as many others at once."""

    threshold: float = 0.95
    recall: float = 0.9999
    width: float = 2.0
    load: float = 0.1
    block: int = 1024
    seed: int = 20

    def collision(self, distance: float) -> float:
        """The chance that one quantised Gaussian projection of two vectors at this distance is equal."""
        r = self.width / distance
        return math.erf(r / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))

    def tables(self, vectors: int) -> tuple[int, int]:
        """(tables, projections per table): enough projections to part unrelated vectors (distance sqrt 2), enough tables for the recall."""
        near, far = self.collision(math.sqrt(2 * (1 - self.threshold))), self.collision(math.sqrt(2))
        projections = max(1, math.ceil(math.log(max(vectors, 2) / self.load) / -math.log(far)))
        return math.ceil(math.log(1 - self.recall) / math.log(1 - near**projections)), projections


def unit_vectors(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each length of vector that occurs: the rows that have it and can be compared, and their unit vectors in double precision."""
    lengths = pc.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False)
    flat = pc.list_flatten(column).cast(pa.float64()).to_numpy(zero_copy_only=False)
    ends = np.cumsum(lengths)
    found = []
    for n in np.unique(lengths[lengths > 0]):
        rows = np.flatnonzero(lengths == n)
        values = flat[(ends[rows] - n)[:, None] + np.arange(n)]
        largest = np.abs(values).max(axis=1)
        fit = np.isfinite(largest) & (largest > 0)
        rows, values = rows[fit], values[fit] / largest[fit, None]
        found.append((rows, values / np.sqrt((values * values).sum(axis=1))[:, None] + 0.0))
    return found


def _sign(settings: VectorSettings, tables: int, projections: int):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        random: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        weights = constants(projections, 505)
        for batch in batches:
            for rows, unit in unit_vectors(batch.column("embedding")):
                if not len(rows):
                    continue
                n = unit.shape[1]
                if n not in random:
                    draw = np.random.default_rng([settings.seed, n])
                    random[n] = draw.standard_normal((n, tables * projections)), draw.uniform(0, settings.width, tables * projections)
                directions, shifts = random[n]
                place = mix64(np.arange(1, tables + 1, dtype=np.uint64) + np.uint64(n << 32))
                cells = np.floor((unit @ directions + shifts) / settings.width).astype(np.int64).view(np.uint64).reshape(-1, tables, projections)
                keys = mix64((mix64(cells) * weights).sum(axis=2, dtype=np.uint64) ^ place).astype(np.int64)
                yield pa.RecordBatch.from_pydict(
                    {
                        "vec_id": batch.column("vec_id").take(pa.array(rows)),
                        "mark": batch.column("mark").take(pa.array(rows)),
                        "same": pa.array([hashlib.blake2b(u.tobytes(), digest_size=16).digest() for u in unit], pa.binary()),
                        "unit": pa.array([u.tobytes() for u in unit], pa.binary()),
                        "keys": pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * tables), pa.array(keys.ravel())),
                    }
                )

    return run


def _verify(settings: VectorSettings, tables: int):
    """Rows of a block pair of one bucket -> (node, links, root): the vectors linked to node by pairs whose first common bucket this is, and the smallest node of what they link here."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in by_key(batches, ["key", "i", "j"]):
            key, i, j = (rows[c][0].as_py() for c in ("key", "i", "j"))
            nodes, copies, side = (rows[c].to_numpy(zero_copy_only=False) for c in ("rep", "copies", "side"))
            keys = rows["keys"].flatten().to_numpy().reshape(-1, tables)
            units = rows["unit"].to_pylist()
            if len({len(u) for u in units}) > 1:  # unlike lengths in one bucket, by a clash of hashes: too few to pair
                units = [u if len(u) == len(units[0]) else bytes(len(units[0])) for u in units]
            unit = np.frombuffer(b"".join(units)).reshape(len(nodes), -1)
            here = int(np.flatnonzero(keys[0] == key)[0])
            a, b = np.flatnonzero(side == i), np.flatnonzero(side == j)
            near = unit[a] @ unit[b].T >= settings.threshold
            if i == j:
                near = np.triu(near, 1)
            left, right = np.nonzero(near)
            left, right = a[left], b[right]
            for t in range(here):
                new = keys[left, t] != keys[right, t]
                left, right = left[new], right[new]
            if len(left):
                links = np.bincount(left, weights=copies[right], minlength=len(nodes)) + np.bincount(right, weights=copies[left], minlength=len(nodes))
                used = np.flatnonzero(links)
                yield pa.RecordBatch.from_pydict({"node": pa.array(nodes[used]), "links": pa.array(links[used].astype(np.int64)), "root": pa.array(local_roots(nodes, left, right)[used])})

    return run


def vector_links(embeddings: DataFrame, settings: VectorSettings = VectorSettings()) -> DataFrame:
    """embeddings (vec_id, embedding) -> the columns of embeddings without embedding, and n_links, component_id, kept.

    Equal unit vectors are one node, weighted by their number. Each node's unit vector is projected on Gaussian directions, shifted and cut into cells; the cells of a table's projections make its bucket
    key. Buckets of one are dropped before vectors travel. Within a bucket cosines are computed in double precision, a pair only in its first common bucket, so links are counted without a row per pair;
    a bucket of more than `block` vectors is split into block pairs, each a group of its own, and none is capped. Projections grow with the logarithm of the number of vectors. A link
    below the threshold is never made; about 1 - recall of those right at it are missed, fewer of closer ones.

    Vectors that are null, empty, zero, or hold null or non-finite components, and rows with a null id, link with nothing; vectors of unlike length don't link. Each different vector of an id is a vector of
    its own: rows that share an id have the links of their own vectors, and reach each other by links only. component_id is the smallest vec_id that links reach; kept: vec_id = component_id (true for a null id).
    Labels and other columns are not looked at. An empty table gives no rows. Columns named like a result are replaced.
    """
    tables, projections = settings.tables(embeddings.count())
    keep = [c for c in plain_columns(embeddings, *RESULT) if c != "embedding"]
    small_batches(embeddings)
    source = embeddings.where("vec_id IS NOT NULL AND embedding IS NOT NULL").select(F.col("vec_id").cast("long").alias("vec_id"), F.xxhash64("embedding").alias("mark"), "embedding")
    signed = settled(source.mapInArrow(_sign(settings, tables, projections), "vec_id long, mark long, same binary, unit binary, keys array<bigint>"), "vectors")
    nodes = signed.groupBy("same").agg(F.xxhash64("same").alias("rep"), F.min("vec_id").alias("first_id"), F.count("*").alias("copies"))
    reps = settled(signed.dropDuplicates(["same"]).join(nodes, "same").select("rep", "copies", "unit", "keys"), "nodes")
    members = reps.select("rep", F.explode("keys").alias("key"))
    shared = members.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    buckets = members.join(shared, "key").withColumn("blocks", F.ceil(F.col("size") / settings.block).cast("int")).drop("size")
    dealt = block_pairs(buckets.join(reps, "rep"), "rep").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    found = settled(dealt.mapInArrow(_verify(settings, tables), "node long, links long, root long"), "found")
    classes = components(found.select(F.col("node").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "rep")
    links = found.groupBy(F.col("node").alias("rep")).agg(F.sum("links").alias("links"))
    per_node = nodes.join(links, "rep", "left").join(classes, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    first = per_node.groupBy("component").agg(F.min("first_id").alias("component_id"))
    per_node = per_node.join(first, "component").select("same", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    by_row = signed.select(F.col("vec_id").alias("_its_id"), F.col("mark").alias("_its_mark"), "same").distinct().join(per_node, "same").drop("same")
    marked = embeddings.select(*keep, F.xxhash64("embedding").alias("_mark"))
    joined = marked.join(by_row, (F.col("vec_id") == F.col("_its_id")) & (F.col("_mark") == F.col("_its_mark")), "left")
    result = joined.select(*keep, F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", F.col("vec_id").cast("long")).alias("component_id"))
    return result.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
