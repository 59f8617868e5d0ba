"""Connection URLs and names, as SQL text."""

from __future__ import annotations

from .sqltext import text_literal

# Fixed value: source type aliases.
SOURCE_TYPE_ALIASES = {
    "postgres": "postgresql",
    "postgresql": "postgresql",
    "pgsql": "postgresql",
    "mariadb": "mysql",
    "mysql": "mysql",
    "sqlserver": "mssql",
    "mssql": "mssql",
    "oracle": "oracle",
    "rds_mysql": "mysql",
    "rds_postgresql": "postgresql",
    "rds_postgres": "postgresql",
    "dynamodb": "dynamodb",
    "aws_dynamodb": "dynamodb",
    "sqlite3": "sqlite",
}


def normalised_type(name: str) -> str:
    """Canonical source type; unknown names stay, lower-cased and trimmed."""
    pairs = ", ".join(f"{text_literal(k)}, {text_literal(v)}" for k, v in SOURCE_TYPE_ALIASES.items())
    clean = f"lower(trim({name}))"
    return f"coalesce(try_element_at(map({pairs}), {clean}), {clean})"


def scheme(url: str) -> str:
    """The URL scheme before any ``+driver`` part."""
    return f"lower(regexp_extract({url}, '^([A-Za-z][A-Za-z0-9.-]*)(?:[+][^:]*)?:', 1))"


def source_type(explicit: str, engine: str, url: str) -> str:
    """An explicit type, else the URL scheme. The type ``rds`` stands for its engine, else for the scheme."""
    from_url = normalised_type(scheme(url))
    named = f"nullif(trim({explicit}), '')"
    by_engine = f"coalesce({normalised_type(f'''nullif(trim({engine}), '')''')}, {from_url})"
    return (
        f"CASE WHEN {named} IS NULL THEN {from_url} WHEN lower({named}) = 'rds' THEN {by_engine} "
        f"ELSE {normalised_type(named)} END"
    )


def endpoint(host: str, url: str) -> str:
    """The configured host, else what follows the first ``@`` of the URL, so never the credentials."""
    return f"coalesce(nullif(trim({host}), ''), nullif(regexp_extract({url}, '(?s)@(.*)$', 1), ''), {url})"


# scheme, authority, path and the rest of a URL
_URL_PARTS = "^([A-Za-z][A-Za-z0-9+.-]*:)?(//[^/?#]*)?([^?#]*)(.*)$"


def database_of(url: str) -> str:
    return f"ltrim('/', regexp_extract({url}, '{_URL_PARTS}', 3))"


def with_database(url: str, database: str) -> str:
    """The URL with its path replaced; an empty name leaves it unchanged."""
    parts = [f"regexp_extract({url}, '{_URL_PARTS}', {i})" for i in (1, 2, 4)]
    return f"CASE WHEN {database} = '' THEN {url} ELSE concat({parts[0]}, {parts[1]}, '/', {database}, {parts[2]}) END"


def discovery_url(kind: str, url: str) -> str:
    """Where to list databases: a PostgreSQL URL without database goes to ``postgres``."""
    empty = f"trim(BOTH '/' FROM regexp_extract({url}, '{_URL_PARTS}', 3)) = ''"
    return f"CASE WHEN {kind} = 'postgresql' AND {empty} THEN {with_database(url, text_literal('postgres'))} ELSE {url} END"


def schema_part(table_key: str) -> str:
    return f"regexp_extract({table_key}, '^(.*)[.][^.]*$', 1)"


def table_part(table_key: str) -> str:
    return f"regexp_extract({table_key}, '([^.]*)$', 1)"


def column_path(connection: str, table_label: str, column: str) -> str:
    return f"concat('db://', {connection}, '/table:', {table_label}, '/column:', {column})"
