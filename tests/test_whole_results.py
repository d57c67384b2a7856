"""Queries over whole tables, in their order."""

import duckdb
import pytest

from docloom.operators import registry

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def db(data):
    out = duckdb.connect()
    for t in ("documents", "orders"):
        out.sql(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return out


@pytest.mark.parametrize("name", ["g7_newest_versions", "g8_numeric_version_order", "g9_explorer_sort"])
def test_orders_return_every_row_in_order(spark, data, db, name):
    assert "LIMIT" not in SQL[name]
    assert [tuple(r) for r in QUERIES[name](spark, data).collect()] == db.sql(SQL[name]).fetchall()


def test_i56_encodes_whole_texts(spark, data, db):
    texts = dict(db.sql("SELECT doc_id, text FROM documents").fetchall())
    got = {r["doc_id"]: (r["hexed"], r["back"]) for r in QUERIES["i56_hex"](spark, data).collect()}
    assert got == {k: (t and t.encode().hex(), t) for k, t in texts.items()}
