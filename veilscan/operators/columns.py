"""Column-level discovery: which table columns hold personal data, with sample values and finding rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass
from functools import reduce
from typing import Any

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType

from ..functions.checks import digits_of
from ..functions.regexes import PLAIN_FLAGS
from ..functions.sqltext import any_of, let, text_literal
from ..functions.urls import column_path
from ..schemas import COLUMN_METADATA, SOURCE
from .detect import gate_columns, gate_of
from .recognisers import Recogniser

PLUGIN = "database"
DETECTOR = "column_scan"

# Our own name words, after the context words of the recognisers and common column names.
COLUMN_NAME_PATTERNS = {
    "IN_AADHAAR": r"aadhaar|uidai",
    "IN_PAN": r"(^|_)pan(_|$)|income_?tax",
    "IN_IFSC": r"ifsc",
    "IN_UPI_ID": r"(^|_)(upi|vpa)(_|$)",
    "IN_PASSPORT": r"passport",
    "IN_BANK_ACCOUNT": r"(bank_?)account|(^|_)acct_?(no|num|number)(_|$)",
    "EMAIL_ADDRESS": r"e_?mail",
    "PHONE_NUMBER": r"phone|mobile|whatsapp",
    "CREDIT_CARD": r"(credit|card)_?(no|num|number)",
    "IBAN_CODE": r"iban",
    "IP_ADDRESS": r"(^|_)ip(_?address)?(_|$)",
    "PERSON": r"(^|_)(full_?|first_?|last_?|employee_?|customer_?)?name(_|$)|card_?holder",
    "IN_ADDRESS": r"(home|postal|street|billing)_?address|(^|_)address(_|$)",
}


def name_matches(column: str, entity: str) -> Column:
    """True when a column name suggests the entity."""
    return F.lower(F.col(column)).rlike(PLAIN_FLAGS + COLUMN_NAME_PATTERNS[entity])


def column_names_pii(names: DataFrame, column: str = "column") -> DataFrame:
    """One row per (input row, entity) whose column name suggests the entity; adds ``pii_type``."""
    tests = [F.when(name_matches(column, e), F.lit(e)) for e in COLUMN_NAME_PATTERNS]
    return names.withColumn("pii_type", F.explode(F.array_compact(F.array(*tests))))


def value_hits(recognisers: list[Recogniser], gates: dict[str, str]) -> str:
    """SQL test of a row with a value ``body`` and gate columns: any recogniser finds a valid span in the value."""
    tests = []
    for rec in recognisers:
        for pattern in rec.patterns:
            regex = text_literal(pattern.jvm_regex)
            if rec.validator is None:
                test = f"body RLIKE {regex}"
            else:
                valid = let(digits_of("v"), "num", rec.validator("v", "num"))
                test = f"exists(regexp_extract_all(body, {regex}, 0), v -> {valid})"
            gate = gate_of(pattern, gates)
            tests.append(test if gate is None else f"({gate} AND {test})")
    return any_of(tests)


def value_profile(table: DataFrame, name: str, recognisers: list[Recogniser], schema: str = "") -> DataFrame:
    """Per string column and entity: non-null values and values with a span.

    The columns are turned into rows once, values pass the gates of the scan, and one aggregate by column counts a flag per entity, so the plan holds each pattern once
    whatever the number of columns. Counts combine on the map side. A column without values has zeros.
    """
    spark, columns = table.sparkSession, [f.name for f in table.schema if isinstance(f.dataType, StringType)]
    by_entity: dict[str, list[Recogniser]] = {}
    for rec in recognisers:
        by_entity.setdefault(rec.entity, []).append(rec)
    if not columns or not by_entity:
        return spark.createDataFrame([], "schema string, table string, column string, pii_type string, non_null bigint, hits bigint")
    gates = gate_columns([p for rec in recognisers for p in rec.patterns])
    pairs = F.array(*(F.struct(F.lit(c).alias("_column"), F.col(f"`{c}`").alias("body")) for c in columns))
    values = table.select(F.inline(pairs)).filter("body IS NOT NULL").select("*", *(F.expr(sql).alias(gate) for gate, sql in gates.items()))
    flags = [F.expr(f"count_if({value_hits(recs, gates)})").alias(f"_h{e}") for e, recs in enumerate(by_entity.values())]
    counted = values.groupBy("_column").agg(F.count("*").alias("_n"), *flags)
    rows = ", ".join(f"struct({text_literal(entity)} AS pii_type, coalesce(_n, 0) AS non_null, coalesce(_h{e}, 0) AS hits)" for e, entity in enumerate(by_entity))
    every = spark.createDataFrame([(c,) for c in columns], "column string")
    known = every.join(counted, F.col("column") == F.col("_column"), "left")
    return known.select(F.lit(schema).alias("schema"), F.lit(name).alias("table"), "column", F.expr(f"inline(array({rows}))"))


def discover_columns(
    tables: Mapping[str, DataFrame], recognisers: list[Recogniser], min_hit_rate: float = 0.5
) -> DataFrame:
    """Flagged (schema, table, column, pii_type): the name suggests it or enough non-null values hold it.

    Table keys are ``table`` or ``schema.table``. Values are tested in string columns, names in all columns.
    """
    profiles, names = [], []
    for key, table in tables.items():
        schema, _, name = key.rpartition(".")
        profiles.append(value_profile(table, name, recognisers, schema))
        names.extend((schema, name, column) for column in table.columns)
    profile = reduce(DataFrame.unionByName, profiles)
    rate = F.when(F.col("non_null") > 0, F.col("hits") / F.col("non_null")).otherwise(0.0)
    by_value = profile.withColumn("hit_rate", F.round(rate, 4)).withColumn("by_value", rate >= min_hit_rate)
    # Both sides have a row per column and entity at most.
    by_name = column_names_pii(profile.sparkSession.createDataFrame(names, "schema string, table string, column string"))
    keys = ["schema", "table", "column", "pii_type"]
    both = by_value.join(by_name.withColumn("by_name", F.lit(True)), keys, "full")
    return both.na.fill(False, ["by_name", "by_value"]).filter("by_name OR by_value")


# The names a detector may give each output column, in order of preference.
OUTPUT_ALIASES = {
    "schema": ("schema_name", "schema"),
    "table": ("table_name", "table"),
    "column": ("column_name", "column"),
    "pii_type": ("pii_type", "entity_type", "detected_type", "detector", "detection_type", "check_result"),
}


def normalise_detections(rows: DataFrame) -> DataFrame:
    """Detector output under any of the alias names as (schema, table, column, pii_type).

    The first non-blank alias counts; schema, table and column are lower-cased; rows without table or column
    are dropped.
    """

    def pick(name: str) -> Column:
        present = [F.nullif(F.trim(F.col(a).cast("string")), F.lit("")) for a in OUTPUT_ALIASES[name] if a in rows.columns]
        return F.coalesce(*present, F.lit(""))

    out = rows.select(*(F.lower(pick(c)).alias(c) for c in ("schema", "table", "column")), pick("pii_type").alias("pii_type"))
    return out.filter("`table` != '' AND `column` != ''")


def detection_catalog(detections: DataFrame) -> DataFrame:
    """One row per column with its sorted types. There are only as many types as recognised entities."""
    types = F.sort_array(F.collect_set(F.nullif("pii_type", F.lit(""))))
    return detections.groupBy("schema", "table", "column").agg(types.alias("pii_types"))


def detection_counts(detections: DataFrame) -> DataFrame:
    """Distinct tables and distinct columns with personal data."""
    columns = detections.groupBy("schema", "table", "column").agg(F.count("*").alias("n"))
    tables = columns.groupBy("schema", "table").agg(F.count("*").alias("columns"))
    return tables.agg(F.count("*").alias("table_count"), F.coalesce(F.sum("columns"), F.lit(0)).alias("pii_column_count"))


@dataclass(frozen=True)
class SampleOptions:
    enabled: bool = True
    limit_per_column: int = 5
    max_value_length: int = 120
    distinct: bool = True
    exclude_null: bool = True
    exclude_empty_strings: bool = True

    @classmethod
    def from_config(cls, *layers: Any) -> SampleOptions:
        """Later layers win; a plain boolean only switches sampling on or off. Limits are clamped."""
        merged: dict[str, Any] = {}
        for layer in layers:
            if isinstance(layer, bool):
                merged["enabled"] = layer
            elif isinstance(layer, Mapping):
                merged.update(layer)

        def flag(key: str) -> bool:
            text = str(merged.get(key, True)).strip().lower()
            return True if text in ("1", "true", "yes", "y", "on") else text not in ("0", "false", "no", "n", "off")

        def clamp(names: tuple[str, ...], default: int, low: int, high: int) -> int:
            raw = next((merged[n] for n in names if n in merged), default)
            try:
                return max(low, min(high, int(raw)))
            except (TypeError, ValueError):
                return default

        return cls(
            enabled=flag("enabled"),
            limit_per_column=clamp(("limit_per_column", "limit"), 5, 1, 1000),
            max_value_length=clamp(("max_value_length", "max_chars"), 120, 8, 10000),
            distinct=flag("distinct"),
            exclude_null=flag("exclude_null"),
            exclude_empty_strings=flag("exclude_empty_strings"),
        )


def shown_value(value: Column, max_chars: int) -> Column:
    """Trimmed and cut to ``max_chars`` with an ellipsis; null shows as the empty string."""
    text = F.regexp_replace(F.coalesce(value, F.lit("")), r"(?U)^\s+|\s+$", "")
    return F.when(F.length(text) > max_chars, F.concat(F.substring(text, 1, max_chars), F.lit("..."))).otherwise(text)


def column_values(table: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value) rows of the named columns as text; binary is decoded with replacement characters."""

    def as_text(column: str) -> Column:
        raw = F.col(column)
        is_binary = isinstance(table.schema[column].dataType, BinaryType)
        return F.make_valid_utf8(raw.cast("string")) if is_binary else raw.cast("string")

    pairs = F.array(*[F.struct(F.lit(c).alias("column"), as_text(c).alias("value")) for c in columns])
    return table.select(F.inline(pairs))


def _first_distinct(limit: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Per partition, the first ``limit`` distinct values of each column in value order (of UTF-8 bytes), null first. Arrow's kernels look at the values, a batch at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first: dict[str, pa.Array] = {}
        for batch in batches:
            names, values = batch.column("column"), batch.column("value")
            for name in pc.unique(names).to_pylist():
                own = values.filter(pc.equal(names, name))
                distinct = pc.unique(pa.concat_arrays([own, first[name]]) if name in first else own)
                first[name] = distinct.take(pc.array_sort_indices(distinct, null_placement="at_start")[:limit])
        rows = pa.concat_arrays(list(first.values())) if first else pa.array([], pa.string())
        names = [name for name, kept in first.items() for _ in range(len(kept))]
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), rows], names=["column", "value"])

    return run


def column_samples(table: DataFrame, columns: list[str], options: SampleOptions = SampleOptions()) -> DataFrame:
    """The first values of each column in value order, limited before formatting as (column, rank, value).

    Each partition keeps at most the limit of distinct values per column before anything is shuffled, so no
    task receives a whole column and no other value is moved.
    """
    values = column_values(table, columns)
    if options.exclude_null:
        values = values.filter(F.col("value").isNotNull())
    if options.distinct:
        slim = values.mapInArrow(_first_distinct(options.limit_per_column), "column string, value string")
        values = slim.distinct()
    rank = F.row_number().over(W.partitionBy("column").orderBy("value"))
    limited = values.withColumn("rank", rank).filter(F.col("rank") <= options.limit_per_column)
    shown = limited.withColumn("value", shown_value(F.col("value"), options.max_value_length))
    return shown.filter("value != ''") if options.exclude_empty_strings else shown


def sample_lists(samples: DataFrame) -> DataFrame:
    """One row per column with its at most ``limit`` sample values."""
    ordered = F.array_sort(F.collect_list(F.struct("rank", "value")))
    return samples.groupBy("column").agg(F.transform(ordered, lambda s: s["value"]).alias("sample_values"))


def column_records(
    catalog: DataFrame,
    connection: str,
    connection_type: str = "",
    endpoint: str = "",
    database: str = "",
    options: SampleOptions | None = None,
    flagged: list[tuple[str, str, str]] | None = None,
) -> DataFrame:
    """A source record per flagged column. ``catalog`` has schema, table, column, pii_types and, with sampling
    on, sample_values. ``flagged`` lists its (schema, table, column) when the driver knows them."""
    label = "CASE WHEN coalesce(schema, '') = '' THEN `table` ELSE concat(schema, '.', `table`) END"
    path = F.expr(column_path(text_literal(connection), label, "`column`"))
    types = F.when(F.size("pii_types") == 0, F.array(F.lit("PII"))).otherwise(F.col("pii_types"))
    run = F.struct(
        F.lit(connection).alias("source_name"),
        F.lit(connection_type).alias("source_type"),
        F.lit(None if flagged is None else len({c[:2] for c in flagged})).cast("bigint").alias("table_count"),
        F.lit(None if flagged is None else len(flagged)).cast("bigint").alias("pii_column_count"),
    )
    sampled = options is not None and options.enabled and "sample_values" in catalog.columns
    samples = F.coalesce(F.col("sample_values"), F.array().cast("array<string>")) if sampled else F.lit(None).cast("array<string>")
    metadata = F.struct(
        F.lit(connection).alias("connection"),
        F.lit(connection_type).alias("connection_type"),
        F.lit(endpoint).alias("connection_endpoint"),
        F.lit(database).alias("database"),
        F.coalesce("schema", F.lit("")).alias("schema"),
        F.col("table"),
        F.col("column"),
        types.alias("pii_types"),
        F.lit(DETECTOR).alias("detector"),
        run.alias("run"),
        samples.alias("sample_values"),
        F.when(samples.isNotNull(), F.size(samples)).alias("sample_values_count"),
        F.lit(options.limit_per_column if sampled else None).cast("int").alias("sample_values_limit"),
        F.get(samples, F.lit(0)).alias("sample_value_preview"),
        F.lit(None).cast("string").alias("sample_values_error"),
    ).cast(COLUMN_METADATA)
    return catalog.select(
        path.alias("source_id"),
        F.lit(SOURCE).alias("record_type"),
        F.lit(PLUGIN).alias("plugin_name"),
        F.lit("database").alias("source_type"),
        path.alias("source_path"),
        F.lit("").alias("text"),
        F.lit(None).cast("string").alias("content_hash"),
        metadata.alias("metadata"),
        F.lit(None).cast("string").alias("reason"),
    )


def column_findings(records: DataFrame) -> DataFrame:
    """One finding per type of a flagged column: score one, the qualified column name as text."""
    text = F.concat_ws(".", F.nullif(F.col("metadata.schema"), F.lit("")), "metadata.table", "metadata.column")
    return records.select(
        "source_id",
        F.explode("metadata.pii_types").alias("entity_type"),
        F.lit("PERSONAL").alias("category"),
        F.lit(1.0).alias("score"),
        text.alias("text"),
        F.lit(0).alias("start"),
        F.length(text).alias("end"),
        F.col("source_path").alias("file_path"),
        F.lit(None).cast("string").alias("file_hash"),
        "source_type",
        F.col("plugin_name").alias("source_plugin"),
        F.col("metadata").alias("source_metadata"),
        F.lit(DETECTOR).alias("recognizer_name"),
        F.lit(None).cast("string").alias("snippet"),
    )
