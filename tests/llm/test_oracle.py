"""The queries that SQL can express, against DuckDB."""

import duckdb
import pytest

from loomlog.llm import queries
from tests.conftest import SF


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_matches_sql(spark, name):
    db = duckdb.connect()
    for table in ("documents", "pages", "benchmark", "labels"):
        db.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    made, want = queries.QUERIES[name](spark, SF), db.sql(queries.ORACLE[name])
    assert sorted(made.columns) == sorted(want.columns)
    columns = sorted(made.columns)
    got = [tuple(r[c] for c in columns) for r in made.collect()]
    assert sorted(got, key=repr) == sorted((tuple(r[want.columns.index(c)] for c in columns) for r in want.fetchall()), key=repr)
