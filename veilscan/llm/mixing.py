"""Mixing sources to target weights by systematic sampling. DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import plain_columns, settled

WORD = r"[^\x20\x09-\x0D]+"
RESULT = ("size", "source_size", "target", "copies", "taken")


def word_count(text: str = "text") -> F.Column:
    """Runs of characters other than space, tab, line feed, vertical tab, form feed and carriage return; null has none."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, weights: tuple[int, ...], share: float, cap: float) -> DataFrame:
    """(source, size) rows -> one row per source: source, n_rows, source_size, target.

    Sources by code point, null last, weigh `weights` in turn and share `share` times all sizes; a target stops at `cap` times its source's size and the excess is shared anew by weight until none is above.
    That ends at one water level: a source gets min(cap * size, level * weight). Ordered by size per weight, the sources up to some place are full and the level is what
    is left by the weight that is left; that place is the last one whose cap lies below the level reached with it. Sums are of whole numbers, so the targets
    don't depend on the order of summing.
    """
    by_source = sized.groupBy("source").agg(F.count("*").alias("n_rows"), F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))  # one row per source
    weight = F.element_at(F.array(*map(F.lit, weights)), (place - 1) % len(weights) + 1)
    weighed = by_source.withColumn("weight", weight.cast("long"))
    order = [(F.col("source_size") / F.col("weight")).asc(), F.col("source").asc_nulls_last()]
    before = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    left = F.lit(share) * F.sum("source_size").over(whole) - F.lit(cap) * F.coalesce(F.sum("source_size").over(before), F.lit(0))
    level = left / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    full = F.lit(cap) * F.col("source_size")
    at = weighed.withColumn("level", level).withColumn("open_level", F.when(full > F.col("level") * F.col("weight"), F.col("level")))
    final = F.max("open_level").over(whole)  # the level falls with each source behind the first open one
    return at.withColumn("final", final).select(
        "source", "n_rows", "source_size", F.when(F.col("open_level").isNull() | F.col("final").isNull(), full).otherwise(F.col("final") * F.col("weight")).alias("target")
    )


def mixed(
    docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, seed: int = 17, carry: tuple[str, ...] | None = None
) -> DataFrame:
    """docs (doc_id, text, source) -> the columns of docs (or only doc_id, source and those named in carry), and size, source_size, target, copies, taken.

    Every document of a source has the same expected copies, target / source_size, at most `cap`. Within its source, documents are ordered by size, then doc_id and a
    checksum; the prefix sum of expected copies starts at one offset in [0, 1), drawn from the seed and the source's name, and a document is emitted
    once for each whole number that its interval crosses. Neighbours in that order have like sizes, so the words taken miss the target by about one of the largest documents.

    The prefix sum has two levels, so that a source with a third of all rows is no task of its own: rows are range-partitioned by (source, size, doc_id) and sorted,
    which numbers them within their partition; the rows of each source and partition are counted, and a document's place is the count before its partition plus its place in it. That is
    one shuffle of the rows; what is joined to them has a row per source and partition. The expected copies before a document are its place times the rate, which is exact and
    the same in every run.

    A null text has size 0; null sources are one source, the last. A source without words has target 0 and takes nothing. Repeated rows are documents of
    their own. An empty table gives no rows. Columns named like a result are replaced.
    """
    keep = plain_columns(docs, *RESULT) if carry is None else ["doc_id", "source", *carry]
    sized = docs.select(*keep, word_count().alias("size"), F.xxhash64("text").alias("_mix_checksum"))
    order = ["source", "size", "doc_id", "_mix_checksum"]
    numbered = sized.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_mix_row", F.monotonically_increasing_id())
    dealt = settled(numbered.withColumn("_mix_part", F.spark_partition_id()), "mix")
    targets = source_targets(dealt.select("source", "size"), weights, share, cap)
    counts = dealt.groupBy("source", "_mix_part").agg(F.count("*").alias("n"), F.min("_mix_row").alias("first_row"))
    earlier = Window.partitionBy("source").orderBy("_mix_part").rowsBetween(Window.unboundedPreceding, -1)
    places = counts.withColumn("n_before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    places = places.join(targets.withColumnRenamed("source", "_its"), F.col("source").eqNullSafe(F.col("_its")))
    # written first, so that Spark knows its size when it chooses how to join; the partition alone is the key where a source can be null
    places = settled(places.select("_mix_part", F.col("source").alias("_its"), (F.col("n_before") - F.col("first_row")).alias("_shift"), "source_size", "target"), "places")
    rows = dealt.join(places.withColumnRenamed("_mix_part", "_its_part"), (F.col("_mix_part") == F.col("_its_part")) & F.col("source").eqNullSafe(F.col("_its")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("null")))
    offset = F.conv(F.substring(F.md5(name), 1, 13), 16, 10).cast("long") / F.lit(float(16**13))
    place = F.col("_mix_row") + F.col("_shift") + 1
    copies = (F.floor(offset + rate * place) - F.floor(offset + rate * (place - 1))).cast("long")
    return rows.withColumn("copies", copies).select(*keep, "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def emitted(mix: DataFrame) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mix.where("copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).drop("_copy")
