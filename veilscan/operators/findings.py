"""From spans to finding rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: the entity types reported as sensitive; all others are personal.
SENSITIVE_ENTITIES = (
    "IN_AADHAAR",
    "IN_PAN",
    "IN_PASSPORT",
    "CREDIT_CARD",
    "IBAN_CODE",
    "CRYPTO",
    "US_BANK_NUMBER",
)


def category_of(entity: str | Column) -> Column:
    column = F.col(entity) if isinstance(entity, str) else entity
    return F.when(column.isin(*SENSITIVE_ENTITIES), "SENSITIVE_PERSONAL").otherwise("PERSONAL")


def to_findings(spans: DataFrame, *more: str) -> DataFrame:
    """``spans`` are rows of :func:`detect` over records; the record columns become the provenance. ``more`` columns stay."""
    return spans.select(
        "source_id",
        "entity_type",
        category_of("entity_type").alias("category"),
        F.round("score", 4).alias("score"),
        F.col("value").alias("text"),
        "start",
        "end",
        F.col("source_path").alias("file_path"),
        F.col("content_hash").alias("file_hash"),
        "source_type",
        F.col("plugin_name").alias("source_plugin"),
        F.col("metadata").alias("source_metadata"),
        F.col("recogniser").alias("recognizer_name"),
        "snippet",
        *more,
    )


def in_report_order(findings: DataFrame) -> DataFrame:
    """Path, start, end, best score first. A range-partitioned sort, meant for the sink only."""
    return findings.orderBy("file_path", "start", "end", F.desc("score"), "entity_type")
