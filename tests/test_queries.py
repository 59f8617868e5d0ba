"""Every registered query against its DuckDB counterpart at the smallest scale."""

import duckdb
import pytest

import __spark_entry__ as entry
from suite.oracles import ORACLES
from suite.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
SPARK_TO_DUCK = {"string": "VARCHAR", "int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for table in TABLES.split():
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF_DIR}/{table}.parquet'")
    return connection


def plain(rows, names, order):
    at = [names.index(c) for c in order]
    return sorted((tuple(round(r[i], 6) if isinstance(r[i], float) else r[i] for i in at) for r in rows), key=repr)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_oracle(spark, duck, name):
    frame = entry.queries()[name](spark, SF_DIR)
    got = frame.collect()
    cursor = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    types = {d[0]: str(d[1]) for d in cursor.description}
    order = sorted(frame.columns)
    assert order == sorted(names)
    assert {f.name: SPARK_TO_DUCK[f.dataType.simpleString()] for f in frame.schema} == types
    assert plain(got, frame.columns, order) == plain(cursor.fetchall(), names, order)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
