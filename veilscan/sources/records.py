"""Record rows: text columns of tables, and literal status rows."""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import FILE_METADATA, SOURCE

RECORD_COLUMNS = [
    "source_id", "record_type", "plugin_name", "source_type", "source_path", "text", "content_hash", "metadata", "reason",
]


# Slim rows to a task: some seconds of a whole scan. A table of more rows than tasks can be listed for gets fuller tasks.
SLIM_ROWS = 25_000
MOST_TASKS = 20_000


def spread(table: DataFrame) -> DataFrame:
    """Use all cores on a table that comes in fewer splits than cores; larger tables keep their partitions."""
    cores = table.sparkSession.sparkContext.defaultParallelism
    return table.repartition(cores) if table.rdd.getNumPartitions() < cores else table


def spread_slim(table: DataFrame, *keys: str) -> DataFrame:
    """The same for a table of slim rows, with a task for each SLIM_ROWS of them: by size alone a split may hold millions.

    Rows are dealt by their ``keys``, so what groups them by these later (also with more columns) needs no other shuffle, and no
    partition is sorted to be dealt. The keys must tell most rows apart. Counting the rows is a job of its own, on file footers for Parquet.
    """
    cores = table.sparkSession.sparkContext.defaultParallelism
    tasks = max(cores, min(-(-table.count() // SLIM_ROWS), MOST_TASKS))
    return table.repartition(tasks, *keys) if table.rdd.getNumPartitions() < tasks else table


PYTHON_BATCH = 4 << 20


def small_batches(table: DataFrame) -> DataFrame:
    """Lets at most PYTHON_BATCH bytes of rows, or one row, travel to a Python worker at once: Spark's own bounds are 10,000 rows and 64 MB, of which a worker holds several forms."""
    conf = table.sparkSession.conf
    number, unit = re.fullmatch(r"(\d+)\s*([kmgtp]?)(?:i?b)?", conf.get("spark.sql.execution.arrow.maxBytesPerBatch").strip().lower()).groups()
    if int(number) << 10 * " kmgtp".index(unit or " ") > PYTHON_BATCH:
        conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(PYTHON_BATCH))
    return table


def text_records(table: DataFrame, name: str, id_column: str, text_column: str, hash_text: bool = False) -> DataFrame:
    """One record per row of a table, its text taken whole from one column. ``id_column`` must be unique."""
    path = F.concat(F.lit(f"table://{name}/"), F.col(id_column).cast("string"))
    text = F.col(text_column)
    return table.select(
        path.alias("source_id"),
        F.lit(SOURCE).alias("record_type"),
        F.lit("table").alias("plugin_name"),
        F.lit("table").alias("source_type"),
        path.alias("source_path"),
        text.alias("text"),
        (F.sha2(text, 256) if hash_text else F.lit(None).cast("string")).alias("content_hash"),
        F.lit(None).cast(FILE_METADATA).alias("metadata"),
        F.lit(None).cast("string").alias("reason"),
    )


def _status_columns(kind: str, plugin: str, source_type: str, path: str, reason: str) -> list[Column]:
    values = {
        "source_id": f"{kind}:{plugin}:{path}",
        "record_type": kind,
        "plugin_name": plugin,
        "source_type": source_type,
        "source_path": path,
        "reason": reason,
    }
    types = {"metadata": FILE_METADATA}
    return [F.lit(values.get(c)).cast(types.get(c, "string")).alias(c) for c in RECORD_COLUMNS]


def status_row(spark: SparkSession, kind: str, plugin: str, source_type: str, path: str, reason: str) -> DataFrame:
    """One literal skip or error row."""
    return spark.range(1).select(*_status_columns(kind, plugin, source_type, path, reason))


def status_row_if_empty(emitted: DataFrame, kind: str, plugin: str, source_type: str, path: str, reason: str) -> DataFrame:
    """The literal row only when ``emitted`` has no row, decided when the plan runs."""
    empty = emitted.limit(1).agg(F.count("*").alias("n")).filter("n = 0")
    return empty.select(*_status_columns(kind, plugin, source_type, path, reason))


def union_all(parts: Iterable[DataFrame]) -> DataFrame:
    """Concatenate sources, keeping duplicates; struct fields a source lacks become null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
