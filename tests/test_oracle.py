"""Every query against its SQL in DuckDB, as whole row multisets."""

from __future__ import annotations

from collections import Counter

import duckdb
import pytest

from __spark_entry__ import entry
from ledgermill.contracts import SOURCE_TABLES
from ledgermill.oracle import ORACLE_SQL
from ledgermill.registry import QUERIES

# Spark type of a column -> DuckDB type.
TYPES = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "string": "VARCHAR",
    "date": "DATE",
    "boolean": "BOOLEAN",
    "double": "DOUBLE",
    "timestamp_ntz": "TIMESTAMP",
}


@pytest.fixture(scope="module")
def duck(oracle_dir):
    connection = duckdb.connect()
    for table in SOURCE_TABLES:
        connection.execute(
            f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{oracle_dir}/{table}.parquet')"
        )
    yield connection
    connection.close()


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE_SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, duck, oracle_dir, name):
    df = QUERIES[name](spark, oracle_dir)
    result = duck.execute(ORACLE_SQL[name])
    sql_types = {column[0]: str(column[1]) for column in result.description}
    columns = sorted(df.columns)
    assert columns == sorted(sql_types)

    kinds = {
        field.name: TYPES.get(
            field.dataType.simpleString(), field.dataType.simpleString().upper()
        )
        for field in df.schema
    }
    assert kinds == sql_types

    order = [list(sql_types).index(column) for column in columns]
    want = Counter(tuple(row[i] for i in order) for row in result.fetchall())
    have = Counter(tuple(row) for row in df.select(*(f"`{c}`" for c in columns)).collect())
    assert have == want


def test_entry(spark):
    assert entry(spark).count() > 0
