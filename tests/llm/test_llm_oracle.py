"""Every query that SQL can express against its SQL in DuckDB, as whole row multisets."""

from __future__ import annotations

from collections import Counter

import duckdb
import pytest

from ledgermill.llm.oracle import ORACLE_SQL
from ledgermill.llm.queries import QUERIES

TABLES = ("documents", "pages", "benchmark", "embeddings")
TYPES = {"bigint": "BIGINT", "string": "VARCHAR", "boolean": "BOOLEAN", "double": "DOUBLE", "date": "DATE"}


@pytest.fixture(scope="module")
def duck(oracle_dir):
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(
            f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{oracle_dir}/{table}.parquet')"
        )
    yield connection
    connection.close()


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(llm_spark, duck, oracle_dir, name):
    df = QUERIES[name](llm_spark, oracle_dir)
    result = duck.execute(ORACLE_SQL[name])
    sql_types = {column[0]: str(column[1]) for column in result.description}
    assert {f.name: TYPES[f.dataType.simpleString()] for f in df.schema} == sql_types
    want = Counter(result.fetchall())
    assert Counter(map(tuple, df.select(*sql_types).collect())) == want
