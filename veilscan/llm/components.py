"""Connected components of links, by rounds of joins and map-side combined minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import settled


def components(links: DataFrame) -> DataFrame:
    """(a long, b long) links -> (node, component): component is the smallest node that links reach, itself included.

    A round gives every node the smallest of itself and its neighbours, follows that pointer twice and replaces the ends of the links
    by what it finds, so links vanish or shrink to those between fewer nodes; nothing is gathered by component. Nulls and links to
    itself are left out; no links give no rows.
    """
    left = settled(links.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a IS NOT NULL AND b IS NOT NULL AND a <> b").distinct(), "links")
    found = None
    while not left.isEmpty():
        both = left.select(F.col("a").alias("node"), F.col("b").alias("near")).unionByName(left.select(F.col("b").alias("node"), F.col("a").alias("near")))
        first = settled(both.groupBy("node").agg(F.min("near").alias("near")).select("node", F.least("node", "near").alias("to")), "nearest")
        second = first.select(F.col("node").alias("to"), F.col("to").alias("to2"))
        third = first.select(F.col("node").alias("to2"), F.col("to").alias("to3"))
        step = settled(first.join(second, "to").join(third, "to2").select("node", F.col("to3").alias("component")), "step")
        if found is None:
            found = step
        else:
            then = step.select(F.col("node").alias("component"), F.col("component").alias("next"))
            found = settled(found.join(then, "component", "left").select("node", F.coalesce("next", "component").alias("component")), "found")
        at_a = step.select(F.col("node").alias("a"), F.col("component").alias("to_a"))
        at_b = step.select(F.col("node").alias("b"), F.col("component").alias("to_b"))
        moved = left.join(at_a, "a").join(at_b, "b").where("to_a <> to_b")
        left = settled(moved.select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b")).distinct(), "links")
    if found is None:
        return left.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return found
