"""The end-to-end scan: records to findings, per-source status and counts."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.detect import detect
from ..operators.findings import in_report_order, to_findings
from ..operators.recognisers import select_recognisers
from ..operators.report import global_stats, plugin_summary, source_rows, sources_report
from ..schemas import ERROR, FINDING_COLUMNS, SOURCE
from ..sources.databases import DatabaseLister, TableReader, catalog_tables, database_findings, read_databases
from ..sources.files import read_files
from ..sources.records import status_row, union_all
from .config import ScanSpec


def _detect(table: DataFrame, text: str, spec: ScanSpec, markers: bool = False) -> DataFrame:
    # A core is never shorter than the margin, which must hold the widest window of any rule.
    size = max(spec.segment_chars, spec.margin_chars) if spec.segment_chars > 0 else 0
    recognisers = select_recognisers(spec.rules, spec.extra_recognisers)
    return detect(table, text, recognisers, spec.rules, spec.detect, spec.models, size, spec.margin_chars, markers, spec.exact_cuts)


def scan_text(table: DataFrame, text: str, spec: ScanSpec) -> DataFrame:
    """Spans of one text column; the other columns of the table are carried along."""
    return _detect(table, text, spec)


def find_in_records(records: DataFrame, spec: ScanSpec) -> DataFrame:
    """Finding rows of the source records; skip and error records have none. No shuffle."""
    sources = records.filter(F.col("record_type") == SOURCE).drop("record_type", "reason")
    findings = to_findings(scan_text(sources, "text", spec))
    return findings if spec.keep_source_metadata else findings.drop("source_metadata")


def find_with_status(records: DataFrame, spec: ScanSpec) -> DataFrame:
    """The findings of the records and a row per record, from one pass: finding rows have an entity type, record rows don't; all carry record_type and reason."""
    scanned = records.withColumn("text", F.when(F.col("record_type") == SOURCE, F.col("text")))
    spans = _detect(scanned, "text", spec, markers=True)
    return to_findings(spans, "record_type", "reason")


Precomputed = DataFrame | Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class ScanResult:
    """Lazy frames. ``findings`` is read again for the counts, so save it first on big inputs. ``precomputed``: the part of the findings that isn't from texts, or a function of the records that gives it."""

    spec: ScanSpec
    records: DataFrame
    findings: DataFrame
    precomputed: Precomputed | None = None

    @property
    def sources(self) -> DataFrame:
        return sources_report(self.records, self.findings)

    @property
    def stats(self) -> DataFrame:
        return global_stats(source_rows(self.records), self.findings)

    def plugins(self) -> DataFrame:
        return plugin_summary(self.records.sparkSession, source_rows(self.records), self.findings, list(self.spec.plugins))

    def save(self, path: str, fmt: str = "json", ordered: bool = False) -> ScanResult:
        """Write ``findings``, ``sources``, ``stats``, ``plugins`` and ``run`` as datasets below ``path``.

        Sources are read, extracted and scanned once: one write beside the report holds the findings and a slim row per source, and all else
        is read from it. ``ordered`` sorts the findings in report order, which costs a range shuffle. On a cluster ``path`` must be on shared storage.
        """
        spark = self.records.sparkSession
        started = _utc_now(spark)
        once = f"{path.rstrip('/')}/_scan-{uuid.uuid4().hex}"
        staged = find_with_status(self.records, self.spec).withColumn("_of_record", F.col("entity_type").isNull())
        staged.write.partitionBy("_of_record").parquet(once)
        both = spark.read.schema(staged.schema).parquet(once)
        records = both.filter("_of_record").select(
            "source_id", "record_type", F.col("source_plugin").alias("plugin_name"), "source_type", F.col("file_path").alias("source_path"), F.col("source_metadata").alias("metadata"), "reason"
        )
        found = both.filter("NOT _of_record").select(*FINDING_COLUMNS)
        if self.precomputed is not None:
            found = union_all([found, self.precomputed(records) if callable(self.precomputed) else self.precomputed])
        found = found.select(*self.findings.columns)
        findings = in_report_order(found) if ordered else found
        findings.write.mode("overwrite").format(fmt).save(f"{path}/findings")
        written = spark.read.schema(self.findings.schema).format(fmt).load(f"{path}/findings")
        saved = ScanResult(self.spec, records, written)
        saved.sources.write.mode("overwrite").format(fmt).save(f"{path}/sources")
        report = spark.read.schema(saved.sources.schema).format(fmt).load(f"{path}/sources")
        global_stats(report, written).write.mode("overwrite").format(fmt).save(f"{path}/stats")
        plugin_summary(spark, report, written, list(self.spec.plugins)).write.mode("overwrite").format(fmt).save(f"{path}/plugins")
        run_frame(spark, self.spec, started).write.mode("overwrite").format(fmt).save(f"{path}/run")
        _remove(spark, once)
        return ScanResult(self.spec, self.records, written)


def _remove(spark: SparkSession, path: str) -> None:
    """Deletes a dataset that this scan wrote for itself."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(place, True)


def _utc_now(spark: SparkSession) -> str:
    now = F.to_utc_timestamp(F.current_timestamp(), F.current_timezone())
    return spark.range(1).select(F.date_format(now, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("t")).first()["t"]


def run_frame(spark: SparkSession, spec: ScanSpec, started: str) -> DataFrame:
    """One row about the run: times and the effective rule settings."""
    rules = spec.rules
    row = {
        "scan_started_at": started,
        "scan_completed_at": _utc_now(spark),
        "region": rules.region,
        "environment": rules.environment,
        "score_threshold": rules.score_threshold,
        "entities": json.dumps(list(rules.entities)),
        "include_entities": json.dumps(list(rules.include_entities)),
        "exclude_entities": json.dumps(list(rules.exclude_entities)),
        "locations": json.dumps([[loc.name, loc.provider, loc.enabled, len(loc.input_paths)] for loc in spec.locations]),
        "plugins": json.dumps(list(spec.plugins)),
        "connections": json.dumps(connection_summary(spec)),
    }
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in row.items()))


def connection_summary(spec: ScanSpec) -> list[dict[str, object]]:
    """What the config says about each database connection; credentials are left out."""
    listed = [c for c in spec.database.get("connections") or [] if isinstance(c, Mapping)]
    return [
        {
            "name": str(c.get("name") or f"database_{i}"),
            "enabled": bool(c.get("enabled", True)),
            "type": str(c.get("type") or ""),
            "tables": [t.get("name", "") if isinstance(t, Mapping) else str(t) for t in c.get("include_tables") or c.get("tables") or []],
            "query_names": [str(q.get("name", "")) if isinstance(q, Mapping) else "" for q in c.get("queries") or []],
        }
        for i, c in enumerate(listed, start=1)
    ]


def scan_records(records: DataFrame, spec: ScanSpec, precomputed: Precomputed | None = None) -> ScanResult:
    """Scan any record frame. ``precomputed`` findings, of flagged columns, join those from the texts; a function gives them from the records."""
    findings = find_in_records(records, spec)
    if precomputed is not None:
        findings = union_all([findings, precomputed(records) if callable(precomputed) else precomputed])
    return ScanResult(spec, records, findings, precomputed)


def scan_files(spark: SparkSession, spec: ScanSpec) -> ScanResult:
    return scan_records(read_files(spark, list(spec.locations), spec.files), spec)


def scan_all(spark: SparkSession, spec: ScanSpec, read_tables: TableReader | None = None, list_databases: DatabaseLister | None = None) -> ScanResult:
    """All enabled sources of the config. A source that fails as a whole becomes one error row."""
    parts: list[DataFrame] = []
    precomputed: Precomputed | None = None
    for plugin in spec.plugins:
        try:
            if plugin == "filesystem":
                parts.append(read_files(spark, list(spec.locations), spec.files))
            else:
                reader = read_tables or catalog_tables(spark)
                records = read_databases(spark, spec.database, select_recognisers(spec.rules), reader, list_databases)
                precomputed = database_findings
                parts.append(records)
        except Exception as exc:  # noqa: BLE001 - one broken source must not stop the others
            kind = "database" if plugin == "database" else "filesystem"
            parts.append(status_row(spark, ERROR, plugin, kind, f"{kind}://{plugin}", f"{type(exc).__name__}: {exc}").drop("metadata"))
    return scan_records(union_all(parts), spec, precomputed)
