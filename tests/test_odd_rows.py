"""Queries against their SQL on small tables of rows that the test tables lack."""

import duckdb

from docloom.operators import registry
from tests.compare import same

QUERIES, SQL = registry.queries(), registry.oracle_sql()


def compare(spark, folder, name, tables):
    """tables: the frames by name; they are written to the folder, where both engines read them."""
    db = duckdb.connect()
    for table, frame in tables.items():
        frame.coalesce(1).write.mode("overwrite").parquet(f"{folder}/{table}.parquet")
        db.sql(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    same(QUERIES[name](spark, str(folder)), db.sql(SQL[name]))


def test_d1_ranks_by_four_digits(spark, data, tmp_path):
    """Products that agree in four digits are ties, halves go up, and the smaller id is first."""
    products = [1.0, 0.50001, 0.50002, 0.50003, 0.50004, 0.50004, 0.50001, 0.49995, 0.5, 0.50004, 0.50003125, 0.50006103515625, -0.5]
    embeddings = spark.createDataFrame([(k, [x, 0.0]) for k, x in enumerate(products)], "vec_id long, embedding array<float>")
    documents = spark.read.parquet(f"{data}/documents.parquet").where(f"doc_id < {len(products)}")
    compare(spark, tmp_path, "d1_hits_with_files", {"embeddings": embeddings, "documents": documents})


def test_i39_ends_words_where_sql_does(spark, tmp_path):
    """Only ASCII letters and digits belong to words; a long s and a Kelvin sign are letters like any other case."""
    texts = "émay xmay may éjan _may é2019 2019é 12019 2019_ todayé étoday yeſterday laſt\tweeK last\x0bweek last week thiſ\nyear ſept xſept AUGUſT ıunı İ ٢٠١٩ 日2019日 𝔘may".split(" ")
    rows = [(1, k, "user", t) for k, t in enumerate([*texts, "last  month", "this week", "", None])]
    conversations = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    compare(spark, tmp_path, "i39_date_badge", {"conversations": conversations})
