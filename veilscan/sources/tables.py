"""Tables as sources: JDBC reads, database listing, and the selection of databases, schemas and tables."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# How each engine lists its databases.
DATABASE_QUERIES = {
    "mysql": "SELECT schema_name AS name FROM information_schema.schemata",
    "postgresql": "SELECT datname AS name FROM pg_database WHERE datistemplate = false",
    "mssql": "SELECT name FROM sys.databases",
}


def jdbc_table(spark: SparkSession, url: str, table: str, options: Mapping[str, str] | None = None) -> DataFrame:
    """A table over JDBC. Give ``partitionColumn``, bounds and ``numPartitions`` in ``options`` for big tables."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, **(options or {})).load()


def jdbc_databases(spark: SparkSession, kind: str, url: str, options: Mapping[str, str] | None = None) -> DataFrame:
    """The database names of a server, one column ``name``."""
    if kind not in DATABASE_QUERIES:
        raise ValueError(f"database discovery is not supported for source type '{kind}'.")
    reader = spark.read.format("jdbc").options(url=url, query=DATABASE_QUERIES[kind], **(options or {}))
    return reader.load().select(F.trim("name").alias("name")).filter("name != ''")


def catalog_databases(spark: SparkSession) -> DataFrame:
    return spark.sql("SHOW DATABASES").select(F.col("namespace").alias("name"))


def _lowered(names: Iterable[str]) -> list[str]:
    return [n.strip().lower() for n in names if n.strip()]


def select_databases(found: DataFrame, include: Iterable[str] = (), exclude: Iterable[str] = (), name: str = "name") -> DataFrame:
    """Named databases, or all when none are named, less the excluded ones; letter case does not matter."""
    key = F.lower(F.trim(name))
    included, excluded = _lowered(include), _lowered(exclude)
    kept = found.filter(key.isin(included)) if included else found
    return kept.filter(~key.isin(excluded)) if excluded else kept


def database_targets(
    include: Iterable[str], configured: str, from_url: str, include_all: bool, exclude: Iterable[str]
) -> tuple[list[str] | None, str | None]:
    """The databases of one connection as (names, error). ``None`` for the names means list them on the server."""
    excluded = set(_lowered(exclude))
    named = [n.strip() for n in include if n.strip()] or [n for n in [configured.strip() or from_url.strip()] if n]
    if named:
        return [n for n in named if n.lower() not in excluded], None
    if include_all:
        return None, None
    return [], "No database specified and include_all_databases is false."


@dataclass(frozen=True)
class TableFilter:
    """Include and exclude lists; entries are ``table`` or ``schema.table`` in any letter case."""

    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    include_schemas: tuple[str, ...] = ()
    exclude_schemas: tuple[str, ...] = ()

    def accepts(self, key: str) -> bool:
        """The test of :func:`table_wanted` for one ``table`` or ``schema.table`` key, to leave tables unread."""
        full = key.strip().lower()
        schema, _, table = full.rpartition(".")
        names = {full, table}
        return (
            (not self.include or bool(names & set(_lowered(self.include))))
            and not names & set(_lowered(self.exclude))
            and (not self.include_schemas or schema in _lowered(self.include_schemas))
            and schema not in _lowered(self.exclude_schemas)
        )


def table_wanted(schema: Column, table: Column, wanted: TableFilter) -> Column:
    short = F.lower(F.trim(table))
    owner = F.lower(F.trim(F.coalesce(schema, F.lit(""))))
    full = F.when(owner == "", short).otherwise(F.concat(owner, F.lit("."), short))

    def listed(names: tuple[str, ...]) -> Column:
        return short.isin(_lowered(names)) | full.isin(_lowered(names))

    test = F.lit(True)
    if wanted.include:
        test = test & listed(wanted.include)
    if wanted.exclude:
        test = test & ~listed(wanted.exclude)
    if wanted.include_schemas:
        test = test & owner.isin(_lowered(wanted.include_schemas))
    if wanted.exclude_schemas:
        test = test & ~owner.isin(_lowered(wanted.exclude_schemas))
    return test


def filter_tables(catalog: DataFrame, wanted: TableFilter) -> DataFrame:
    """Rows of a frame with columns ``schema`` and ``table`` that pass the lists."""
    return catalog.filter(table_wanted(F.col("schema"), F.col("table"), wanted))


def filter_tables_by_frame(catalog: DataFrame, include: DataFrame, exclude: DataFrame) -> DataFrame:
    """The same test with the lists as frames of one column ``name``, for lists of any length: names are tagged once and joined by table and by schema and table."""
    short = F.lower(F.trim("table"))
    owner = F.lower(F.trim(F.coalesce("schema", F.lit(""))))
    keyed = catalog.withColumn("_t", short).withColumn("_st", F.concat_ws(".", F.nullif(owner, F.lit("")), short))
    listed = include.select(F.lower(F.trim("name")).alias("_name"), F.lit(True).alias("_in"), F.lit(False).alias("_out"))
    tagged = listed.unionByName(exclude.select(F.lower(F.trim("name")).alias("_name"), F.lit(False).alias("_in"), F.lit(True).alias("_out")))
    tagged = tagged.groupBy("_name").agg(F.bool_or("_in").alias("_in"), F.bool_or("_out").alias("_out"))
    by_table = tagged.withColumnsRenamed({"_name": "_t", "_in": "_in_t", "_out": "_out_t"})
    by_both = tagged.withColumnsRenamed({"_name": "_st", "_in": "_in_st", "_out": "_out_st"})
    known = keyed.join(by_table, "_t", "left").join(by_both, "_st", "left")
    wanted = known.filter("coalesce(_in_t, false) OR coalesce(_in_st, false)").filter("NOT (coalesce(_out_t, false) OR coalesce(_out_st, false))")
    return wanted.select(*catalog.columns)
