"""Every registered query against its SQL, and those without SQL for rows."""

import duckdb
import pytest

from docloom.operators import registry
from tests.compare import same

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def db(data):
    out = duckdb.connect()
    for t in TABLES:
        out.sql(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return out


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, data, db, name):
    same(QUERIES[name](spark, data), db.sql(SQL[name]))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_has_rows(spark, data, name):
    out = QUERIES[name](spark, data)
    assert out.count() > 0 and len(set(out.columns)) == len(out.columns)
