"""Queries over stored, incremental tables: each brings a store to a state in several commits and asks it."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions.embed import embedder
from docloom.operators import search as S
from docloom.operators.inverted import KeywordIndex
from docloom.operators.library import Library
from docloom.operators.registry import query
from docloom.operators.vector_index import VectorIndex
from docloom.plans.fixtures import cte, view
from docloom.plans.retrieval import bm25_sql, near_sql
from docloom.session import reliable, shared_folder
from docloom.sources.store import Store
from docloom.sources.version_store import VersionStore


@contextmanager
def _store(spark: SparkSession, name: str) -> Iterator[Store]:
    """A store in the shared folder, removed when the query has its rows."""
    store = Store(spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}")
    try:
        yield store
    finally:
        store.delete()


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunks with the path of their file."""
    files = view(spark, d, "fx_files").select("file_id", "path")
    return view(spark, d, "fx_chunks").join(files, "file_id").select("chunk_id", "text", "path")


_REVISED = """revised AS (SELECT chunk_id, CASE WHEN starts_with(path, '/vault/src3/') THEN concat(text, ' revised re-read') ELSE text END AS text
    FROM fx_chunks JOIN fx_files USING (file_id) WHERE NOT starts_with(path, '/vault/src5/'))"""


@query(cte("fx_chunks", "fx_queries") + "," + _REVISED + "," + bm25_sql(20, "fx_queries", "revised") + " SELECT query_id, chunk_id, score, place FROM keyword")
def b3_stored_index(spark, d):
    """Chunks of one source come later, those of one change, those of one go; then shards are merged."""
    with _store(spark, "keywords") as store:
        index, chunks = KeywordIndex(), _chunks(spark, d)
        store.transact(lambda c: index.update(c, chunks.where("NOT startswith(path, '/vault/src7/')")))
        later = chunks.where("startswith(path, '/vault/src7/') OR startswith(path, '/vault/src3/')")
        later = later.withColumn("text", F.when(F.col("path").startswith("/vault/src3/"), F.concat("text", F.lit(" revised re-read"))).otherwise(F.col("text")))
        snapshot = store.transact(lambda c: index.update(c, later, chunks.where("startswith(path, '/vault/src5/')")))
        return reliable(index.search(snapshot, view(spark, d, "fx_queries"), 20))


@query(
    "WITH q AS (SELECT vec_id AS query_id, embedding AS query_embedding FROM embeddings WHERE vec_id % 50 = 0), held AS (SELECT vec_id, CASE WHEN label = 2 THEN list_reverse(embedding) ELSE embedding END AS embedding FROM embeddings WHERE label <> 3),"
    + near_sql("top", "q", 10, None, "held") + " SELECT query_id, vec_id, score, place FROM top"
)
def b2_stored_vectors(spark, d):
    """Vectors of one label come later, those of one change, those of one go."""
    with _store(spark, "vectors") as store:
        index, vectors = VectorIndex(), view(spark, d, "embeddings").select("vec_id", "embedding", "label")
        store.transact(lambda c: index.update(c, vectors.where("label <> 1")))
        later = vectors.where("label IN (1, 2)").withColumn("embedding", F.when(F.col("label") == 2, F.reverse("embedding")).otherwise(F.col("embedding")))
        snapshot = store.transact(lambda c: index.update(c, later, vectors.where("label = 3")))
        return reliable(index.search(snapshot, view(spark, d, "fx_query_vectors"), 10))


_SCANNED = """scanned AS (SELECT s.path, s.filename, s.modified_time, s.created_time, CASE WHEN s.modified_time <> coalesce(f.modified_time, -1) THEN concat(coalesce(d.text, 'a new file'), ' seen again') ELSE d.text END AS text
    FROM fx_scan s LEFT JOIN fx_files f ON s.path = f.path LEFT JOIN documents d ON d.doc_id = f.file_id)"""


@query(
    cte("fx_files", "fx_scan")
    + "," + _SCANNED
    + r""" SELECT path, modified_time, CASE WHEN f.path IS NULL THEN s.created_time ELSE f.created_time END AS created_time, 1 + CASE WHEN n = 0 THEN 0 ELSE 1 + greatest(CAST(ceil((n - 200) / 170.0) AS BIGINT), 0) END AS n_chunks
    FROM (SELECT *, len(list_filter(regexp_split_to_array(text, '[\s]+'), lambda w: w <> '')) AS n FROM scanned WHERE text IS NOT NULL) s LEFT JOIN (SELECT path, created_time FROM fx_files f JOIN documents d ON d.doc_id = f.file_id WHERE d.text IS NOT NULL) f USING (path)"""
)
def b1_library_refresh(spark, d):
    """Files, chunks, postings and vectors after a first scan and a second one, each in one commit."""
    with _store(spark, "library") as store:
        library = Library(store, embedder())
        files, texts = view(spark, d, "fx_files"), view(spark, d, "documents").select(F.col("doc_id").alias("file_id"), "text")
        first = files.join(texts, "file_id")
        library.refresh(first.select("path", "filename", "modified_time", "created_time", "text"))
        old = first.select("path", F.col("modified_time").alias("_old"), "text")
        scanned = view(spark, d, "fx_scan").join(old, "path", "left")
        again = F.when(F.col("modified_time") != F.coalesce("_old", F.lit(-1)), F.concat(F.coalesce("text", F.lit("a new file")), F.lit(" seen again"))).otherwise(F.col("text"))
        snapshot = library.refresh(scanned.select("path", "filename", "modified_time", "created_time", again.alias("text")))
        n = library.chunks(snapshot).groupBy("file_id").agg(F.count("*").alias("n_chunks"))
        return reliable(library.files(snapshot).join(n, "file_id").select("path", "modified_time", "created_time", "n_chunks"))


@query(
    cte("fx_versions")
    + """SELECT file_id, version, CAST(CASE WHEN first < version THEN first END AS INT) AS reused, md5(content) AS content_md5
    FROM (SELECT file_id, version, content, min(version) OVER (PARTITION BY file_id, content) AS first FROM fx_versions WHERE content IS NOT NULL)"""
)
def b7_version_store(spark, d):
    """Three saves of all files; numbers come from the store, repeated contents name their twin, contents are read back from blocks."""
    with _store(spark, "versions") as store:
        versions = VersionStore(store)
        for n in (1, 2, 3):
            own = view(spark, d, "fx_versions").where(f"version = {n} AND content IS NOT NULL")
            versions.save(own.select("file_id", F.col("content").cast("binary").alias("content")))
        snapshot = store.at()
        held = versions.versions(snapshot).select("file_id", "version", "reused")
        loaded = versions.load(snapshot=snapshot, of=F.md5).withColumnRenamed("content", "content_md5")
        return reliable(held.join(loaded, ["file_id", "version"]).select("file_id", "version", "reused", "content_md5"))


@query(
    cte("fx_chunks", "fx_queries") + "," + bm25_sql(100)
    + " SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY k.place) AS place FROM keyword k JOIN fx_chunks USING (chunk_id) JOIN fx_files USING (file_id) WHERE lower(path) = '/vault/src2' OR starts_with(lower(path), '/vault/src2/') QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY k.place) <= 20"
)
def g2_keyword_search_in_root(spark, d):
    """Five times the wanted hits are fetched, those outside the root go, the first twenty stay."""
    return S.bm25_in_root(view(spark, d, "fx_files"), view(spark, d, "fx_chunks"), view(spark, d, "fx_queries"), 20, "/vault/src2")
