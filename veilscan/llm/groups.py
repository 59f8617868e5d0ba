"""Groups of rows inside tasks: streams of sorted rows cut at key changes, pairs of blocks of large groups, links within a group."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def by_key(batches: Iterator[pa.RecordBatch], keys: list[str], most: int | None = None) -> Iterator[dict[str, pa.Array]]:
    """The groups of rows with equal keys, of rows that come sorted by them; with `most`, a larger group comes in parts of that many rows."""
    rest: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        rest = table if rest is None else pa.concat_tables([rest, table]).combine_chunks()
        ends = _ends(rest, keys)
        at = 0
        for end in ends[:-1]:
            yield from _parts(rest, at, end, most)
            at = end
        while most and rest.num_rows - at > most:
            yield from _parts(rest, at, at + most, most)
            at += most
        rest = rest.slice(at)
    if rest is not None and rest.num_rows:
        yield from _parts(rest, 0, rest.num_rows, most)


def _ends(table: pa.Table, keys: list[str]) -> np.ndarray:
    change = np.zeros(table.num_rows - 1, dtype=bool)
    for k in keys:
        values = table.column(k).to_numpy()
        change |= values[1:] != values[:-1]
    return np.append(np.flatnonzero(change) + 1, table.num_rows)


def _parts(table: pa.Table, at: int, end: int, most: int | None) -> Iterator[dict[str, pa.Array]]:
    step = most or end - at
    for start in range(at, end, step):
        part = table.slice(start, min(step, end - start)).combine_chunks()
        yield {c: part.column(c).chunk(0) for c in part.column_names}


def block_pairs(rows: DataFrame, node: str) -> DataFrame:
    """Rows (key, blocks, node, ...) -> a copy for each pair of blocks that the row belongs to, with the blocks i <= j and the row's own as side.

    A group is cut into its number of blocks by a hash of the node, so every pair of rows meets in exactly one pair of blocks and no task gets more than two blocks."""
    own = F.pmod(F.xxhash64(F.lit(7), F.col(node)), F.col("blocks")).cast("int")
    dealt = rows.withColumn("side", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return dealt.withColumn("i", F.least("side", "other")).withColumn("j", F.greatest("side", "other")).drop("blocks", "other")


def local_roots(nodes: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """For links between places of a group: the smallest node that links within the group reach from each place."""
    root = np.array(nodes)
    while True:
        low = np.minimum(root[left], root[right])
        new = root.copy()
        np.minimum.at(new, left, low)
        np.minimum.at(new, right, low)
        if (new == root).all():
            return root
        root = new
