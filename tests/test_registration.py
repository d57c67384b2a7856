import numpy as np
from pyspark.sql import functions as F

from docloom.functions import embed, udfs


def test_sql_functions(spark):
    names = udfs.register(spark, 1735603200)
    assert "diff_lines" in names
    row = spark.sql("SELECT chunk_text('One. Two.') AS c, fts_tokens('Running CAFÉ') AS t, seq_ratio('abc', 'abd') AS r, parse_nl_date('notes from june 2024').date_from AS d").first()
    assert row["c"] == ["One. Two."] and row["t"] == ["run", "cafe"] and abs(row["r"] - 2 / 3) < 1e-9 and row["d"] == 1717200000
    lines = spark.sql("SELECT * FROM diff_lines('a\nb', 'a\nc')").collect()
    assert [tuple(r) for r in lines] == [("delete", 1, "b"), ("insert", 2, "c")]


def test_embeddings(spark):
    texts = spark.createDataFrame([(k, f"text number {k}") for k in range(100)] + [(100, None)], "k int, t string")
    rows = texts.select("k", embed.embedder()("t").alias("v")).collect()
    assert all(len(r["v"]) == 384 for r in rows)
    assert all(abs(np.linalg.norm(r["v"]) - (r["k"] < 100)) < 1e-5 for r in rows)
    plugged = embed.embedder(lambda batch: np.ones((len(batch), 3)), batch=7)
    assert texts.select(F.size(plugged("t")).alias("n")).distinct().collect()[0]["n"] == 3
