"""Status per source and the summary counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import ERROR, SKIP, SOURCE


def findings_per_source(findings: DataFrame) -> DataFrame:
    """Counts combine on the map side, so a source with most of the findings is no hot spot."""
    return findings.groupBy("source_id").agg(F.count("*").alias("findings_count"))


def source_rows(records: DataFrame) -> DataFrame:
    """One row per record: scanned, skipped with a reason, or failed with an error."""
    kind = F.col("record_type")
    status = F.when(kind == SOURCE, "scanned").when(kind == SKIP, "skipped").otherwise("failed")
    unknown = F.concat(F.lit("Unknown source record type: "), kind)
    return records.select(
        "source_id",
        F.col("source_path").alias("file_path"),
        status.alias("status"),
        F.when(kind == SKIP, F.col("reason")).alias("reason"),
        F.when(kind == ERROR, F.col("reason")).when(~kind.isin(SOURCE, SKIP), unknown).alias("error"),
        "source_type",
        F.col("plugin_name").alias("source_plugin"),
        F.col("metadata").alias("source_metadata"),
    )


def sources_report(records: DataFrame, findings: DataFrame) -> DataFrame:
    """The source rows with the findings count of their id."""
    counted = source_rows(records).join(findings_per_source(findings), "source_id", "left")
    # Skipped sources carry no count.
    count = F.when(F.col("status") != "skipped", F.coalesce("findings_count", F.lit(0)))
    return counted.withColumn("findings_count", count)


def _status_counts() -> list:
    return [F.count_if(F.col("status") == s).alias(f"sources_{s}") for s in ("scanned", "skipped", "failed")]


def _with_findings(rows: DataFrame, findings: DataFrame) -> DataFrame:
    """Source rows and a row per finding, added up without a join, so that a repeated source id does no harm."""
    statuses = rows.select(F.col("source_plugin").alias("plugin"), "status", F.lit(0).alias("finding"))
    found = findings.select(F.col("source_plugin").alias("plugin"), F.lit(None).cast("string").alias("status"), F.lit(1).alias("finding"))
    return statuses.unionByName(found)


def global_stats(rows: DataFrame, findings: DataFrame) -> DataFrame:
    """One row: the source counts, the same counts under their file names, and the number of findings."""
    total = F.coalesce(F.sum("finding"), F.lit(0)).alias("total_findings")
    stats = _with_findings(rows, findings).agg(*_status_counts(), total)
    files = [F.col(f"sources_{s}").alias(f"files_{s}") for s in ("scanned", "skipped", "failed")]
    return stats.select(*files, *stats.columns)


def plugin_summary(spark: SparkSession, rows: DataFrame, findings: DataFrame, plugins: list[str]) -> DataFrame:
    """Counts per plugin; a configured plugin without any source is listed with zeros."""
    total = F.coalesce(F.sum("finding"), F.lit(0)).alias("findings")
    per_plugin = _with_findings(rows, findings).groupBy("plugin").agg(*_status_counts(), total)
    configured = spark.createDataFrame([(p,) for p in plugins], "plugin string")
    return per_plugin.join(configured, "plugin", "full").na.fill(0)


def entity_profile(findings: DataFrame) -> DataFrame:
    """Findings, distinct sources and best score per entity and category."""
    per_source = findings.groupBy("entity_type", "category", "source_id").agg(
        F.count("*").alias("n"), F.max("score").alias("best")
    )
    return per_source.groupBy("entity_type", "category").agg(
        F.sum("n").alias("findings"), F.count("*").alias("sources"), F.max("best").alias("max_score")
    )
