"""Every registered query of the engine against its SQL in DuckDB."""

import duckdb
import pytest

from loomlog import queries as q
from tests.conftest import SF


@pytest.fixture(scope="module")
def oracle():
    db = duckdb.connect()
    for name in q.TABLES:
        db.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return db


def plain(value):
    return None if value is None or value != value else float(value) if hasattr(value, "as_tuple") else value


def table(names, found):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in found), key=repr)


@pytest.mark.parametrize("name", sorted(q.ORACLE))
def test_query_matches_sql(spark, oracle, name):
    made = q.QUERIES[name](spark, SF)
    want = oracle.sql(q.ORACLE[name])
    assert sorted(made.columns) == sorted(want.columns)
    assert table(made.columns, made.collect()) == table(want.columns, want.fetchall())


def test_every_query_has_sql():
    assert set(q.QUERIES) == set(q.ORACLE)
