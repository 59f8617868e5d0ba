"""The database source: connections to tables, flagged columns, samples and findings.

Tables come from a reader function, so JDBC, catalog tables and files are all read the same way.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.sqltext import text_literal
from ..functions.urls import database_of, endpoint, source_type
from ..operators.columns import (
    PLUGIN,
    SampleOptions,
    column_findings,
    column_records,
    column_samples,
    detection_catalog,
    discover_columns,
    sample_lists,
)
from ..operators.recognisers import Recogniser
from ..schemas import ERROR, SKIP
from .records import status_row, union_all
from .tables import TableFilter, database_targets

# (connection settings, database) -> frames by ``table`` or ``schema.table``
TableReader = Callable[[Mapping[str, Any], str], Mapping[str, DataFrame]]
DatabaseLister = Callable[[Mapping[str, Any]], list[str]]


def connection_url(connection: Mapping[str, Any]) -> str:
    """The first of the four URL settings that is not blank."""
    urls = (str(connection.get(k) or "").strip() for k in ("url", "uri", "connection_string", "dsn"))
    return next((u for u in urls if u), "")


def catalog_tables(spark: SparkSession) -> TableReader:
    """Reads every table of the named database in the session catalog, for connections whose URL begins with ``catalog:``.

    Any other URL is refused, since the catalog's tables are not those it names.
    """

    def read(connection: Mapping[str, Any], database: str) -> Mapping[str, DataFrame]:
        if not connection_url(connection).startswith("catalog:"):
            raise ValueError("no reader for this URL; pass read_tables, or a URL that begins with catalog:")
        names = [t.name for t in spark.catalog.listTables(database) if not t.isTemporary]
        return {name: spark.table(f"`{database}`.`{name}`") for name in names}

    return read


def _names(value: Any) -> tuple[str, ...]:
    items = [value] if isinstance(value, str) else value or []
    named = (str(v.get("name") or "") if isinstance(v, Mapping) else str(v) for v in items)
    return tuple(n.strip() for n in named if n.strip())


def table_filter(connection: Mapping[str, Any]) -> TableFilter:
    return TableFilter(
        include=_names(connection.get("tables")) + _names(connection.get("include_tables")),
        exclude=_names(connection.get("exclude_tables")),
        include_schemas=_names(connection.get("include_schemas") or connection.get("include_schema")),
        exclude_schemas=_names(connection.get("exclude_schemas") or connection.get("exclude_schema")),
    )


def _settled(catalog: DataFrame) -> tuple[DataFrame, list[tuple[str, str, str]]]:
    """The catalog as a literal frame and its column names, so that tables are profiled once.

    It has at most one row per column of the connection's schema, whatever the tables hold.
    """
    rows = catalog.collect()
    return catalog.sparkSession.createDataFrame(rows, catalog.schema), [(r["schema"], r["table"], r["column"]) for r in rows]


def _samples(tables: Mapping[str, DataFrame], columns: list[tuple[str, str, str]], options: SampleOptions) -> DataFrame:
    """Sample lists of the flagged columns, one pass per table."""
    by_table: dict[tuple[str, str], list[str]] = {}
    for schema, table, column in columns:
        by_table.setdefault((schema, table), []).append(column)
    parts = []
    for (schema, table), names in by_table.items():
        lists = sample_lists(column_samples(tables[f"{schema}.{table}" if schema else table], names, options))
        parts.append(lists.select(F.lit(schema).alias("schema"), F.lit(table).alias("table"), "column", "sample_values"))
    return union_all(parts)


def scan_tables(
    tables: Mapping[str, DataFrame],
    recognisers: list[Recogniser],
    connection: str,
    kind: str = "",
    endpoint_name: str = "",
    database: str = "",
    wanted: TableFilter = TableFilter(),
    samples: SampleOptions = SampleOptions(),
) -> DataFrame | None:
    """Records of the flagged columns, or ``None`` when there are none."""
    chosen = {key: table for key, table in tables.items() if wanted.accepts(key)}
    if not chosen:
        return None
    catalog, columns = _settled(detection_catalog(discover_columns(chosen, recognisers)))
    if not columns:
        return None
    if samples.enabled:
        catalog = catalog.join(_samples(chosen, columns, samples), ["schema", "table", "column"], "left")
    return column_records(catalog, connection, kind, endpoint_name, database, samples, columns)


def _url_facts(spark: SparkSession, connection: Mapping[str, Any], url: str) -> Mapping[str, str]:
    host = text_literal(str(connection.get("host") or ""))
    explicit = text_literal(str(connection.get("type") or connection.get("source_type") or ""))
    engine = text_literal(str(connection.get("engine") or connection.get("rds_engine") or ""))
    literal = text_literal(url)
    return spark.range(1).selectExpr(
        f"{source_type(explicit, engine, literal)} AS kind",
        f"{endpoint(host, literal)} AS endpoint",
        f"{database_of(literal)} AS database",
    ).first().asDict()


def read_databases(
    spark: SparkSession,
    settings: Mapping[str, Any],
    recognisers: list[Recogniser],
    read_tables: TableReader,
    list_databases: DatabaseLister | None = None,
) -> DataFrame:
    """Records of all enabled connections. A connection that fails becomes one error row and the rest goes on."""

    def row(kind: str, path: str, reason: str) -> DataFrame:
        return status_row(spark, kind, PLUGIN, "database", path, reason).drop("metadata")

    connections = [c for c in settings.get("connections") or [] if isinstance(c, Mapping)]
    if not connections:
        return row(SKIP, "db://", "Database plugin enabled but no connections configured.")
    parts: list[DataFrame] = []
    enabled = [(i, c) for i, c in enumerate(connections, start=1) if c.get("enabled", True)]
    if not enabled:
        return row(SKIP, "db://", "No enabled database connections configured.")
    for index, connection in enabled:
        name = str(connection.get("name") or "").strip() or f"database_{index}"
        try:
            parts.extend(_connection_parts(spark, settings, connection, name, recognisers, read_tables, list_databases, row))
        except Exception as exc:  # one broken connection must not stop the scan
            parts.append(row(ERROR, f"db://{name}", f"{type(exc).__name__}: {exc}"))
    return union_all(parts)


def _connection_parts(
    spark: SparkSession,
    settings: Mapping[str, Any],
    connection: Mapping[str, Any],
    name: str,
    recognisers: list[Recogniser],
    read_tables: TableReader,
    list_databases: DatabaseLister | None,
    row: Callable[[str, str, str], DataFrame],
) -> list[DataFrame]:
    def setting(key: str, default: Any) -> Any:
        own = connection.get(key)
        return settings.get(key, default) if own is None else own

    url = connection_url(connection)
    if not url:
        return [row(ERROR, f"db://{name}", "Missing connection URL (url/uri/connection_string/dsn).")]
    wanted = table_filter(connection)
    if not wanted.include and not setting("include_all_tables", True):
        return [row(SKIP, f"db://{name}", "No tables configured and include_all_tables is disabled.")]
    facts = _url_facts(spark, connection, url)
    targets, error = database_targets(
        _names(connection.get("include_databases") or connection.get("databases")),
        str(connection.get("database") or ""),
        facts["database"],
        bool(setting("include_all_databases", True)),
        _names(connection.get("exclude_databases") or settings.get("exclude_databases")),
    )
    if error:
        return [row(ERROR, f"db://{name}", error)]
    if targets is None:
        if list_databases is None:
            return [row(ERROR, f"db://{name}", f"database discovery is not supported for source type '{facts['kind']}'.")]
        excluded = {n.lower() for n in _names(connection.get("exclude_databases") or settings.get("exclude_databases"))}
        targets = [d for d in list_databases(connection) if d.lower() not in excluded]
    if not targets:
        return [row(SKIP, f"db://{name}", "No databases selected for scanning.")]

    samples = SampleOptions.from_config(settings.get("sample_values"), connection.get("sample_values"))
    parts = []
    for database in targets:
        shown = f"{name}:{database}" if len(targets) > 1 else name
        detector = {**(settings.get("detector") or {}), **(connection.get("detector") or {})}
        if not detector.get("enabled", True):
            parts.append(row(SKIP, f"db://{shown}", "Column detection is disabled for this connection."))
            continue
        tables = read_tables(connection, database)
        found = scan_tables(tables, recognisers, shown, facts["kind"], facts["endpoint"], database, wanted, samples)
        parts.append(row(SKIP, f"db://{shown}", "No pii columns detected.") if found is None else found)
        if connection.get("queries"):
            parts.append(row(SKIP, f"db://{shown}/queries", "Custom SQL query scanning is not supported."))
    return parts


def database_findings(records: DataFrame) -> DataFrame:
    """Findings of the flagged columns among database records."""
    if "metadata" not in records.columns or "pii_types" not in records.schema["metadata"].dataType.names:
        records = records.withColumn("metadata", F.lit(None).cast("struct<schema:string,table:string,column:string,pii_types:array<string>>"))
    return column_findings(records.filter(F.col("record_type") == "source"))
