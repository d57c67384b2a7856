"""Queries: retrieval and chat context."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.functions import vector as V
from docloom.operators import search as S
from docloom.operators.registry import query
from docloom.plans.fixtures import cte, view

_TERMS = r"list_filter(regexp_split_to_array(lower({0}), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '')"


_GAP = r"[\s\x1c-\x1f\x85\p{Z}]+"


def phrases_sql(queries: str) -> str:
    """query_id, phrase, times: the words of each query between white space as lists of tokens."""
    words = f"unnest(list_filter(regexp_split_to_array(query_text, '{_GAP}'), lambda w: w <> ''))"
    return f"""SELECT query_id, phrase, count(*) AS times FROM (SELECT query_id, {_TERMS.format("word")} AS phrase FROM (SELECT query_id, {words} AS word FROM {queries} WHERE query_text NOT LIKE '%"%'))
             WHERE len(phrase) > 0 GROUP BY query_id, phrase"""


def bm25_sql(most: int, queries: str = "fx_queries", chunks: str = "fx_chunks") -> str:
    return f"""
    terms AS (SELECT chunk_id, {_TERMS.format("text")} AS t FROM {chunks}),
    stats AS (SELECT count(*) AS n_all, avg(coalesce(len(t), 0)) AS avgdl FROM terms),
    wanted AS ({phrases_sql(queries)}),
    phrases AS (SELECT DISTINCT phrase, phrase[1] AS term FROM wanted),
    places AS (SELECT chunk_id, len(t) AS dl, unnest(t) AS term, unnest(generate_series(1, len(t))) AS pos FROM terms),
    hits AS (SELECT phrase, chunk_id, count(*) AS tf, any_value(dl) AS dl FROM (
               SELECT phrase, chunk_id, dl FROM places JOIN phrases USING (term) WHERE len(phrase) = 1
               UNION ALL SELECT phrase, chunk_id, dl FROM places JOIN phrases USING (term) JOIN terms USING (chunk_id) WHERE len(phrase) > 1 AND t[pos : pos + len(phrase) - 1] = phrase)
             GROUP BY phrase, chunk_id),
    freq AS (SELECT phrase, count(*) AS df FROM hits GROUP BY phrase),
    full_bm AS (SELECT query_id, chunk_id, round(sum(times * CASE WHEN ln((n_all - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE ln((n_all - df + 0.5) / (df + 0.5)) END
                  * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 9) AS full_score
           FROM hits JOIN freq USING (phrase) JOIN wanted USING (phrase), stats GROUP BY query_id, chunk_id),
    keyword AS (SELECT query_id, chunk_id, round(full_score, 4) AS score, place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY full_score DESC, chunk_id) AS place FROM full_bm) WHERE place <= {most})"""


def near_sql(name: str, queries: str, most: int, least: float | None, vectors: str = "embeddings", key: str = "vec_id") -> str:
    kept = "" if least is None else f" AND score >= {least}"
    return f"""
    {name} AS (SELECT query_id, vec_id, score, place FROM (
        SELECT query_id, vec_id, round(full_score, 4) AS score, row_number() OVER (PARTITION BY query_id ORDER BY full_score DESC, vec_id) AS place FROM (
            SELECT query_id, {key} AS vec_id, round(list_dot_product(CAST(query_embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])), 9) AS full_score
            FROM {queries}, {vectors})) WHERE place <= {most}{kept})"""


def _queries(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "fx_queries")


def _asked(spark: SparkSession, d: str) -> DataFrame:
    """Query texts with a vector each: the row of the embeddings with the query's number."""
    vectors = view(spark, d, "embeddings").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_embedding"))
    return vectors.join(_queries(spark, d), "query_id").select("query_id", "query_text", "query_embedding")


def _chunk_vectors(spark: SparkSession, d: str) -> DataFrame:
    """The embeddings stand for the meta chunks of the files with their numbers."""
    return view(spark, d, "embeddings").select((F.col("vec_id") * T.CHUNK_IDS).alias("vec_id"), "embedding")


_ASKED_SQL = "asked AS (SELECT query_id, query_text, embedding AS query_embedding FROM fx_queries JOIN embeddings ON vec_id = query_id)"


@query("WITH " + "q AS (SELECT vec_id AS query_id, embedding AS query_embedding FROM embeddings WHERE vec_id % 50 = 0)," + near_sql("top", "q", 10, None) + " SELECT query_id, vec_id, score, place FROM top")
def j1_vector_topk(spark, d):
    return V.nearest(view(spark, d, "fx_query_vectors"), view(spark, d, "embeddings"), 10)


@query(
    cte("fx_files", "fx_query_vectors")
    + "," + near_sql("top", "fx_query_vectors", 100, 0.15)
    + " SELECT query_id, vec_id, path, score FROM top JOIN fx_files ON file_id = vec_id WHERE lower(path) = '/vault/src2' OR starts_with(lower(path), '/vault/src2/')"
)
def j1_vector_search_in_root(spark, d):
    """The root filter comes after the top k, so a scoped search can find fewer."""
    near = V.nearest(view(spark, d, "fx_query_vectors"), view(spark, d, "embeddings"), 100, S.MIN_SIMILARITY)
    files = view(spark, d, "fx_files").where(S.in_root(F.col("path"), "/vault/src2")).select(F.col("file_id").alias("vec_id"), "path")
    return near.join(files, "vec_id").select("query_id", "vec_id", "path", "score")


@query(cte("fx_chunks", "fx_queries") + "," + bm25_sql(20) + " SELECT query_id, chunk_id, score, place FROM keyword")
def j2_bm25_topk(spark, d):
    return S.bm25(view(spark, d, "fx_chunks"), _queries(spark, d), 20)


@query()
def i10_bm25_porter_topk(spark, d):
    """The same with folded, stemmed terms."""
    return S.bm25(view(spark, d, "fx_chunks"), _queries(spark, d), 20, T.keyword_terms)


#: Addresses, dates, numbers with points and hyphenated words of a document, twice each, and its first word.
_PHRASE_QUERIES = """SELECT doc_id AS query_id, concat_ws(' ', p, p, regexp_extract(text, '[A-Za-z]+', 0)) AS query_text
    FROM (SELECT doc_id, text, regexp_extract(text, '[A-Za-z0-9]+[@.:_-][A-Za-z0-9@.:_-]*[A-Za-z0-9]', 0) AS p FROM documents WHERE doc_id % 50 = 0)"""


@query(cte("fx_chunks") + f", asked_phrases AS ({_PHRASE_QUERIES})," + bm25_sql(20, "asked_phrases") + " SELECT query_id, chunk_id, score, place FROM keyword")
def j3_phrase_search(spark, d):
    asked = spark.sql(_PHRASE_QUERIES.replace("FROM documents", "FROM {documents}"), documents=view(spark, d, "documents"))
    return S.bm25(view(spark, d, "fx_chunks"), asked, 20)


@query(
    cte("fx_chunks")
    + f"SELECT term, count(*) AS df, sum(tf) AS cf FROM (SELECT term, chunk_id, count(*) AS tf FROM (SELECT chunk_id, unnest({_TERMS.format('text')}) AS term FROM fx_chunks) GROUP BY ALL) GROUP BY term"
)
def e11_term_statistics(spark, d):
    counted, _ = S.postings(view(spark, d, "fx_chunks"))
    return counted.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


_PATH_ORDER = "created_time DESC NULLS LAST, modified_time DESC, file_id"


@query(
    cte("fx_files")
    + f"""SELECT query_id, file_id, path, place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {_PATH_ORDER}) AS place
    FROM fx_files, (VALUES (1, 'src1_'), (2, 'DOC_7'), (3, '/fr/'), (4, 'doc%.pdf')) q(query_id, query_text)
    WHERE path ILIKE concat('%', query_text, '%') OR filename ILIKE concat('%', query_text, '%')) WHERE place <= 20"""
)
def j4_filename_search(spark, d):
    asked = spark.createDataFrame([(1, "src1_"), (2, "DOC_7"), (3, "/fr/"), (4, "doc%.pdf")], "query_id int, query_text string")
    return S.path_matches(view(spark, d, "fx_files"), asked, 20)


@query(cte("fx_files") + f"SELECT file_id, path, created_time FROM fx_files ORDER BY {_PATH_ORDER} LIMIT 20")
def j4_newest_files(spark, d):
    files = view(spark, d, "fx_files")
    return files.orderBy(F.col("created_time").desc_nulls_last(), F.desc("modified_time"), "file_id").limit(20).select("file_id", "path", "created_time")


@query(
    cte("fx_files")
    + f"SELECT file_id, path, created_time, 1.0::DOUBLE AS score FROM fx_files WHERE created_time >= 1672617600 AND created_time <= 1675123200 AND lower(path) LIKE '/vault/src1%' ORDER BY {_PATH_ORDER} LIMIT 50"
)
def j5_date_range_search(spark, d):
    found = S.date_range(view(spark, d, "fx_files"), 1672617600, 1675123200, 50, "/vault/src1")
    return found.select("file_id", "path", "created_time", "score")


_HYBRID = (
    cte("fx_chunks", "fx_queries") + "," + _ASKED_SQL + "," + bm25_sql(100) + ","
    + near_sql("semantic", "asked", 100, 0.15, "(SELECT vec_id * 1000000 AS chunk, embedding FROM embeddings)", "chunk")
    + f""",
    signals AS (SELECT query_id, vec_id AS chunk_id, 'semantic' AS signal, place FROM semantic UNION ALL SELECT k.query_id, chunk_id, 'keyword', place FROM keyword k JOIN asked USING (query_id)),
    fused AS (SELECT query_id, chunk_id, sum(1.0::DOUBLE / (60 + place)) AS rrf, list(signal) AS s FROM signals GROUP BY query_id, chunk_id),
    by_chunk AS (SELECT query_id, file_id, max(rrf) AS rrf, flatten(list(s)) AS s FROM fused JOIN fx_chunks USING (chunk_id) GROUP BY query_id, file_id),
    by_name AS (SELECT query_id, file_id, 1.0::DOUBLE / (60 + place) AS rrf, ['filename'] AS s FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {_PATH_ORDER}) AS place
                FROM fx_files, asked WHERE path ILIKE concat('%', query_text, '%') OR filename ILIKE concat('%', query_text, '%')) WHERE place <= 100),
    total AS (SELECT query_id, file_id, round(sum(rrf), 8) AS rrf, len(list_distinct(flatten(list(s)))) AS n_signals FROM (SELECT * FROM by_chunk UNION ALL SELECT * FROM by_name) GROUP BY query_id, file_id),
    """
)
_HYBRID_END = """
    top AS (SELECT * FROM (SELECT t.*, path, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, path) AS place FROM total t JOIN fx_files USING (file_id) {where}) WHERE place <= 20)
    SELECT query_id, file_id, path, rrf, CAST(n_signals AS INT) AS n_signals, place,
           round(least(0.99, 0.40 + (CASE WHEN max(rrf) OVER w > min(rrf) OVER w THEN (rrf - min(rrf) OVER w) / (max(rrf) OVER w - min(rrf) OVER w) ELSE 1.0 END) * 0.52
                 + CASE WHEN n_signals >= 3 THEN 0.08 WHEN n_signals = 2 THEN 0.05 ELSE 0 END), 3) AS score
    FROM top WINDOW w AS (PARTITION BY query_id)"""


@query(_HYBRID + _HYBRID_END.format(where=""))
def j6_hybrid_search(spark, d):
    return S.hybrid(view(spark, d, "fx_files"), view(spark, d, "fx_chunks"), _chunk_vectors(spark, d), _asked(spark, d))


@query(_HYBRID + _HYBRID_END.format(where="WHERE created_time IS NULL OR created_time BETWEEN 1672617600 AND 1675123200"))
def j7_hybrid_search_dates(spark, d):
    return S.hybrid(
        view(spark, d, "fx_files"), view(spark, d, "fx_chunks"), _chunk_vectors(spark, d), _asked(spark, d), low=1672617600, high=1675123200
    )


@query(
    _HYBRID[:-6].rstrip(" ,\n")
    + " SELECT query_id, count(*) AS n_chunks, round(sum(rrf), 6) AS rrf_sum, count(*) FILTER (len(list_distinct(s)) = 2) AS n_both FROM fused GROUP BY query_id"
)
def e5_rrf_fusion(spark, d):
    asked, chunks = _asked(spark, d), view(spark, d, "fx_chunks")
    semantic = V.nearest(asked, _chunk_vectors(spark, d), 100, S.MIN_SIMILARITY).select("query_id", F.col("vec_id").alias("chunk_id"), F.lit("semantic").alias("signal"), "place")
    keyword = S.bm25(chunks, asked, 100).select("query_id", "chunk_id", F.lit("keyword").alias("signal"), "place")
    return S.fuse([semantic, keyword]).groupBy("query_id").agg(
        F.count("*").alias("n_chunks"), F.round(F.sum("rrf"), 6).alias("rrf_sum"), F.count_if(F.size("signals") == 2).alias("n_both")
    )


_CHAT = cte("fx_chunks", "fx_query_vectors") + "," + near_sql("near", "fx_query_vectors", 10, 0.18, "(SELECT vec_id * 1000000 AS chunk, embedding FROM embeddings)", "chunk") + """,
    hits AS (SELECT * FROM (SELECT query_id, chunk_id, text, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS place
             FROM near JOIN fx_chunks ON chunk_id = vec_id WHERE trim(text) <> '') WHERE place <= 5)"""


def _hits(spark, d):
    return S.chat_hits(view(spark, d, "fx_query_vectors"), view(spark, d, "fx_chunks"), _chunk_vectors(spark, d))


@query(_CHAT + " SELECT query_id, chunk_id, text, score, place FROM hits")
def j9_chat_retrieval(spark, d):
    return _hits(spark, d).select("query_id", "chunk_id", "text", "score", "place")


@query(
    _CHAT
    + """, once AS (SELECT query_id, text, max(score) AS score FROM hits GROUP BY query_id, text),
    top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, text) AS place FROM once) WHERE place <= 3)
    SELECT query_id, string_agg(text, chr(10) || '---' || chr(10) ORDER BY place) AS context, count(*) AS n_passages FROM top GROUP BY query_id"""
)
def j11_chat_context(spark, d):
    return S.chat_context(_hits(spark, d))


@query(
    cte("fx_chunks")
    + "SELECT file_id, chunk_id, md5(text) AS text_md5, 1.0::DOUBLE AS score FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY chunk_index) AS place FROM fx_chunks) WHERE place <= 3"
)
def j10_chat_first_chunks(spark, d):
    return S.first_chunks(view(spark, d, "fx_chunks"), 3).select("file_id", "chunk_id", F.md5("text").alias("text_md5"), "score")


@query(
    """SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place FROM (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations WHERE role <> 'system') WHERE back <= 6"""
)
def f6_chat_history(spark, d):
    return S.history(view(spark, d, "conversations")).select("conv_id", "turn", "role", "text", "place")


@query(
    r"""SELECT conv_id, turn, CASE WHEN before IS NULL THEN text ELSE concat_ws(' ', array_to_string(regexp_split_to_array(trim(before), '[\s]+')[1:10], ' '), text) END AS expanded
    FROM (SELECT *, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations WHERE role = 'user')"""
)
def i18_followup_hint(spark, d):
    return S.follow_up(view(spark, d, "conversations"))


@query(
    "SELECT conv_id, turn, (lower(text) LIKE '%summar%' OR lower(text) LIKE '%overview%' OR (lower(text) LIKE '%what%' AND (lower(text) LIKE '%file%' OR lower(text) LIKE '%document%'))) AS summary FROM conversations WHERE role = 'user'"
)
def j10_summary_intent(spark, d):
    return view(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn", S.wants_summary(F.col("text")).alias("summary"))


@query(
    """SELECT conv_id, CAST(to_json(list_concat([{'role': 'system', 'content': 'Answer from the passages of the document.'}], list({'role': role, 'content': text} ORDER BY turn))) AS VARCHAR) AS messages
    FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations WHERE role <> 'system') WHERE back <= 6 GROUP BY conv_id"""
)
def j12_prompt_messages(spark, d):
    return S.prompt_messages(view(spark, d, "conversations"), "Answer from the passages of the document.")


@query(
    """WITH p AS (SELECT a.vec_id AS q, list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS good, list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])) AS bad
    FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1 JOIN embeddings c ON c.vec_id = a.vec_id + 2)
    SELECT count(*) AS n, round(avg(CASE WHEN good > bad THEN 1.0 ELSE 0.0 END), 4) AS accuracy, round(avg(good - bad), 4) AS margin FROM p"""
)
def e23_retrieval_accuracy(spark, d):
    """Triples of (query, relevant, irrelevant): a row and the two after it."""
    e = view(spark, d, "embeddings")
    a, b, c = (e.select((F.col("vec_id") - k).alias("q"), F.col("embedding").alias(n)) for k, n in enumerate("abc"))
    rows = a.join(b, "q").join(c, "q").select(V.dot(F.col("a"), F.col("b")).alias("good"), V.dot(F.col("a"), F.col("c")).alias("bad"))
    return rows.agg(
        F.count("*").alias("n"), F.round(F.avg(F.when(F.col("good") > F.col("bad"), 1.0).otherwise(0.0)), 4).alias("accuracy"), F.round(F.avg(F.col("good") - F.col("bad")), 4).alias("margin")
    )


@query("SELECT vec_id, round(sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x))), 4) AS norm, round(CAST(embedding[1] AS DOUBLE) / sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x))), 4) AS first FROM embeddings")
def i40_normalize(spark, d):
    e = view(spark, d, "embeddings")
    return e.select("vec_id", F.round(V.norm(F.col("embedding")), 4).alias("norm"), F.round(V.normalized(F.col("embedding"))[0], 4).alias("first"))
