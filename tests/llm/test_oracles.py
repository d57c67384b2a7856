import duckdb
import pytest

from docloom.llm import oracles, queries
from tests.compare import same

TABLES = ("documents", "pages", "labels", "benchmark")


@pytest.mark.parametrize("name", sorted(oracles.oracle_sql()))
def test_query_equals_its_sql(spark, data, name):
    db = duckdb.connect()
    for t in TABLES:
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    same(queries.queries()[name](spark, data), db.sql(oracles.oracle_sql()[name]))
