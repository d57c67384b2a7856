"""Queries: scanning, indexing and table upkeep."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.functions import classify as C
from docloom.functions import text as T
from docloom.operators import indexing as I
from docloom.operators.registry import query
from docloom.plans.fixtures import cte, view

_SUPPORTED = "|".join(C.SUPPORTED)


@query(
    cte("fx_files")
    + f"""SELECT file_id, filename, (NOT (lower(filename) IN ('thumbs.db', 'desktop.ini', '.ds_store') OR filename LIKE '.%' OR filename LIKE '~$%' OR filename LIKE '%~'
    OR regexp_matches(lower(filename), '\\.({"|".join(C.SKIPPED)})$')) AND regexp_matches(lower(filename), '\\.({_SUPPORTED})$')) AS indexable FROM fx_files"""
)
def a3_supported_files(spark, d):
    return view(spark, d, "fx_files").select("file_id", "filename", C.supported_file(F.col("filename")).alias("indexable"))


@query(
    cte("fx_files")
    + """SELECT file_id, size_chars * 100 AS size, (size_chars * 100 <= 52428800 AND (NOT regexp_matches(name, '\\.(png|jpg|jpeg)$') OR size_chars * 100 BETWEEN 51200 AND 15728640)) AS ok
    FROM (SELECT *, replace(filename, '.txt', '.png') AS name FROM fx_files)"""
)
def a5_size_filter(spark, d):
    """Text files stand for images here, a hundred bytes per character."""
    size = F.col("size_chars") * 100
    name = F.replace("filename", F.lit(".txt"), F.lit(".png"))
    return view(spark, d, "fx_files").select("file_id", size.alias("size"), C.valid_size(name, size).alias("ok"))


_DIRS = ", ".join(f"'{x}'" for x in C.IGNORED_DIRS)


@query(
    f"""SELECT page_id, len(list_filter(p[1 : len(p) - 1], lambda x: starts_with(x, '.') OR x IN ({_DIRS}))) > 0 AS ignored
    FROM (SELECT page_id, string_split(replace(lower(regexp_replace(url, '^[a-z]+://', '/')), chr(92), '/'), '/') AS p FROM pages)"""
)
def a6_ignored_dirs(spark, d):
    path = F.regexp_replace("url", "^[a-z]+://", "/")
    return view(spark, d, "pages").select("page_id", C.ignored_dir(path).alias("ignored"))


@query("SELECT doc_id, length(substring(text, 1, 20000)) AS kept, length(text) > 20000 AS truncated, md5(substring(text, 1, 20000)) AS preview FROM documents")
def a14_text_preview(spark, d):
    cut = F.substring("text", 1, 20000)
    return view(spark, d, "documents").select("doc_id", F.length(cut).alias("kept"), (F.length("text") > 20000).alias("truncated"), F.md5(cut).alias("preview"))


@query("SELECT doc_id, substring(sha256(text), 1, 16) || '_' || CAST(doc_id AS VARCHAR) || '.txt' AS stored_name FROM documents WHERE length(trim(text)) > 0")
def a24_upload_names(spark, d):
    docs = view(spark, d, "documents").where(F.length(F.trim("text")) > 0)
    return docs.select("doc_id", F.concat(F.substring(F.sha2("text", 256), 1, 16), F.lit("_"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("stored_name"))


_DIFF = cte("fx_files", "fx_scan") + """, diff AS (SELECT coalesce(o.path, n.path) AS path, CASE WHEN o.path IS NULL THEN 'new' WHEN n.path IS NULL THEN 'deleted'
    WHEN o.modified_time IS NOT DISTINCT FROM n.modified_time THEN 'unchanged' ELSE 'modified' END AS status, o.modified_time AS old_stamp, n.modified_time AS new_stamp
    FROM fx_files o FULL JOIN fx_scan n ON o.path = n.path)"""


def _diff(spark, d):
    return I.snapshot_diff(view(spark, d, "fx_files"), view(spark, d, "fx_scan"))


@query(_DIFF + " SELECT * FROM diff")
def k1_snapshot_diff(spark, d):
    return _diff(spark, d)


@query(_DIFF + " SELECT status, count(*) AS n FROM diff GROUP BY status")
def e9_snapshot_counts(spark, d):
    return I.status_counts(_diff(spark, d))


@query(
    cte("fx_files", "fx_scan")
    + """SELECT coalesce(n.path, o.path) AS path, coalesce(n.modified_time, o.modified_time) AS modified_time,
    CASE WHEN o.path IS NOT NULL THEN o.created_time ELSE n.created_time END AS created_time FROM fx_files o FULL JOIN fx_scan n ON o.path = n.path
    WHERE NOT (n.path IS NULL AND starts_with(lower(o.path), '/vault/src11'))"""
)
def k2_refresh_files(spark, d):
    return I.refresh_files(view(spark, d, "fx_files"), view(spark, d, "fx_scan"), "/vault/src11").select("path", "modified_time", "created_time")


@query(
    _DIFF.replace("WITH fx_files", "WITH fx_files", 1)
    + ", ch AS (" + cte("fx_chunks").split("fx_chunks AS (", 1)[1].rstrip()[:-1] + ")"
    + """, hit AS (SELECT chunk_id, file_id, status FROM ch JOIN fx_files USING (file_id) JOIN diff USING (path) WHERE status IN ('modified', 'deleted'))
    SELECT chunk_id FROM hit UNION SELECT max(chunk_id) + 1 FROM hit WHERE status = 'modified' GROUP BY file_id"""
)
def k4_affected_chunks(spark, d):
    """Modified files have grown by a chunk, deleted ones have none any more."""
    changed = _diff(spark, d).where("status IN ('modified', 'deleted')").join(view(spark, d, "fx_files").select("path", "file_id"), "path")
    old = view(spark, d, "fx_chunks").select("chunk_id", "file_id")
    kept = old.join(changed.where("status = 'deleted'").select("file_id"), "file_id", "left_anti")
    grown = old.join(changed.where("status = 'modified'").select("file_id"), "file_id", "left_semi").groupBy("file_id").agg((F.max("chunk_id") + 1).alias("chunk_id"))
    return I.affected_chunks(old, kept.unionByName(grown), changed)


@query(
    _DIFF + ", ch AS (" + cte("fx_chunks").split("fx_chunks AS (", 1)[1].rstrip()[:-1] + ")"
    + """, gone AS (SELECT file_id FROM diff JOIN fx_files USING (path) WHERE status = 'deleted')
    SELECT file_id, count(*) AS n_chunks FROM (SELECT * FROM ch WHERE file_id NOT IN (SELECT file_id FROM gone)) GROUP BY file_id"""
)
def k3_drop_deleted_chunks(spark, d):
    gone = _diff(spark, d).where("status = 'deleted'").join(view(spark, d, "fx_files").select("path", "file_id"), "path")
    chunks = view(spark, d, "fx_chunks")
    return I.refresh_chunks(chunks, gone, chunks.limit(0)).groupBy("file_id").agg(F.count("*").alias("n_chunks"))


@query("SELECT vec_id, label FROM (SELECT vec_id, label FROM embeddings WHERE label <> 3 UNION ALL SELECT vec_id + 1000000, label FROM embeddings WHERE label = 3)")
def b2_refresh_vectors(spark, d):
    """Vectors of one label are removed and come back under new ids."""
    e = view(spark, d, "embeddings").select("vec_id", "label")
    old = e.where("label = 3")
    return I.refresh_vectors(e, old, old.select((F.col("vec_id") + 1000000).alias("vec_id"), "label"))


@query(cte("fx_chunks") + "SELECT file_id, text FROM fx_chunks WHERE chunk_index = 0")
def i3_meta_chunks(spark, d):
    return view(spark, d, "fx_files").select("file_id", T.meta_text(F.col("filename"), F.col("path")).alias("text"))


@query(cte("fx_chunks") + "SELECT file_id, chunk_index, md5(text) AS text_md5 FROM fx_chunks WHERE chunk_index > 0")
def i2_word_chunks(spark, d):
    return view(spark, d, "fx_chunks").where("chunk_index > 0").select("file_id", "chunk_index", F.md5("text").alias("text_md5"))


@query()
def i2_sentence_chunks(spark, d):
    docs = view(spark, d, "documents")
    return docs.select("doc_id", F.posexplode(T.chunk_text("text")).alias("chunk_index", "chunk")).select("doc_id", "chunk_index", F.md5("chunk").alias("chunk_md5"))


@query(
    r"""SELECT doc_id, len(list_filter(regexp_split_to_array(regexp_replace(trim(text), '([.!?;])\s+', '\1' || chr(1), 'g'), chr(1) || '|\n{2,}'), lambda s: trim(s) <> '')) AS n_sentences FROM documents"""
)
def i1_sentence_split(spark, d):
    parts = F.filter(F.split(F.trim("text"), r"(?<=[.!?;])\s+|\n{2,}"), lambda s: F.trim(s) != "")
    return view(spark, d, "documents").select("doc_id", F.size(parts).cast("long").alias("n_sentences"))


@query(
    """SELECT source, doc_id FROM (SELECT source, doc_id, n, i, CAST(ceil(i * 40.0::DOUBLE / n) AS BIGINT) AS k FROM (
    SELECT source, doc_id, count(*) OVER (PARTITION BY source) AS n, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i FROM documents))
    WHERE n <= 40 OR (k < 40 AND floor(k * n / 40.0::DOUBLE) = i)"""
)
def f9_evenly_spaced(spark, d):
    """At most forty documents of each source, as a file's chunks are spread."""
    return T.spread(view(spark, d, "documents").select("source", "doc_id"), "source", "doc_id")


_REASON = "CASE WHEN length(text) < 50 THEN 'too_short' WHEN lang = 'de' THEN 'permission_denied' WHEN lang = 'es' THEN 'password_protected' ELSE 'extract_error' END"


@query(f"SELECT reason, count(*) AS n, CASE WHEN reason IN ('permission_denied', 'not_found', 'file_locked', 'password_protected', 'access_error') THEN 'unreadable' ELSE 'other' END AS family FROM (SELECT {_REASON} AS reason FROM documents) GROUP BY reason")
def e8_skip_reasons(spark, d):
    return I.skip_counts(view(spark, d, "documents").select(F.expr(_REASON).alias("reason")))


@query("SELECT doc_id, length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) >= 50 AS enough FROM documents")
def c15_min_text(spark, d):
    return view(spark, d, "documents").select("doc_id", (F.length(F.regexp_replace("text", r"^\s+|\s+$", "")) >= 50).alias("enough"))


_MOVES = "SELECT path AS old_path, replace(path, '/vault/', '/archive/') AS new_path, modified_time + 5 AS moved_at FROM {f} WHERE path LIKE '/vault/src4/%' OR path LIKE '/vault/src17/%'"


@query(cte("fx_files") + ", m AS (" + _MOVES.format(f="fx_files") + """) SELECT file_id, coalesce(new_path, path) AS path, filename,
    CASE WHEN new_path IS NOT NULL THEN coalesce(created_time, moved_at) ELSE created_time END AS created_time FROM fx_files LEFT JOIN m ON old_path = path""")
def k7_moved_files(spark, d):
    files = view(spark, d, "fx_files")
    return I.move_files(files, spark.sql(_MOVES.format(f="{f}"), f=files))


@query(
    """SELECT file_id, CASE WHEN n = 0 THEN new_path ELSE replace(new_path, '.pdf', concat(' (', CAST(n AS VARCHAR), ').pdf')) END AS target
    FROM (SELECT o_orderkey AS file_id, concat('/sorted/', CAST(o_custkey AS VARCHAR), '.pdf') AS new_path, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS n FROM orders)"""
)
def i17_unique_targets(spark, d):
    moves = view(spark, d, "orders").select(F.col("o_orderkey").alias("file_id"), F.concat(F.lit("/sorted/"), F.col("o_custkey").cast("string"), F.lit(".pdf")).alias("new_path"))
    return I.unique_targets(moves).select("file_id", "target")


@query("SELECT sha256(text) AS content_hash, count(*) AS n_files, min(doc_id) AS kept_id FROM documents GROUP BY 1")
def k9_content_copies(spark, d):
    return I.content_copies(view(spark, d, "documents"))


@query(
    """SELECT key, value FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY late DESC, stamp DESC) AS place FROM (
    SELECT c_mktsegment AS key, CAST(max(c_custkey) AS VARCHAR) AS value, CAST(0 AS BIGINT) AS stamp, 0 AS late FROM customer GROUP BY c_mktsegment
    UNION ALL SELECT CASE o_orderpriority WHEN '1-URGENT' THEN 'BUILDING' ELSE o_orderpriority END, CAST(o_orderkey AS VARCHAR), o_orderkey, 1 FROM orders)) WHERE place = 1"""
)
def b4_upsert_settings(spark, d):
    stored = view(spark, d, "customer").groupBy(F.col("c_mktsegment").alias("key")).agg(F.max("c_custkey").cast("string").alias("value"), F.lit(0).cast("long").alias("stamp"))
    key = F.when(F.col("o_orderpriority") == "1-URGENT", "BUILDING").otherwise(F.col("o_orderpriority"))
    changes = view(spark, d, "orders").select(key.alias("key"), F.col("o_orderkey").cast("string").alias("value"), F.col("o_orderkey").alias("stamp"))
    return I.upsert(stored, changes, "key", "stamp").select("key", "value")


@query("SELECT c_mktsegment AS key, 'set' AS value FROM customer GROUP BY 1 UNION ALL SELECT o_orderpriority, 'default' FROM orders WHERE o_orderpriority NOT IN (SELECT c_mktsegment FROM customer) GROUP BY 1")
def b6_insert_missing(spark, d):
    stored = view(spark, d, "customer").select(F.col("c_mktsegment").alias("key"), F.lit("set").alias("value")).distinct()
    defaults = view(spark, d, "orders").select(F.col("o_orderpriority").alias("key"), F.lit("default").alias("value")).distinct()
    return I.insert_missing(stored, defaults, "key")


_FOUND = """SELECT path, NOT path LIKE '%.md' AS supported, modified_time, CASE WHEN path LIKE '%/de/%' THEN 'file_locked' WHEN path LIKE '%/es/%' THEN 'extract_error' END AS reason,
    size_chars % 7 + 1 AS n_chunks FROM {fx_scan}"""


@query(
    cte("fx_files", "fx_scan") + ", found AS (" + _FOUND.replace("{fx_scan}", "fx_scan") + """)
    SELECT path, CASE WHEN why IS NULL THEN 'indexed' ELSE 'skipped' END AS status, why AS reason, CASE WHEN why IS NULL THEN n_chunks ELSE 0 END AS new_chunks FROM (
        SELECT f.path, f.n_chunks, CASE WHEN NOT supported THEN 'unsupported_file_type' WHEN o.modified_time = f.modified_time THEN 'unchanged' WHEN f.reason = 'file_locked' THEN f.reason END AS why
        FROM found f LEFT JOIN fx_files o ON o.path = f.path)"""
)
def k5_ingest_files(spark, d):
    """Markdown is no supported kind, German files are locked, Spanish ones give no text and are indexed by name."""
    return I.ingest_files(view(spark, d, "fx_files"), spark.sql(_FOUND, fx_scan=view(spark, d, "fx_scan")))


@query(
    cte("fx_files", "fx_chunks") + """, gone AS (SELECT file_id FROM fx_files WHERE path LIKE '/vault/src11/%')
    SELECT 'files' AS kind, count(*) AS n FROM fx_files WHERE file_id NOT IN (SELECT file_id FROM gone)
    UNION ALL SELECT 'chunks', count(*) FROM fx_chunks WHERE file_id NOT IN (SELECT file_id FROM gone)
    UNION ALL SELECT 'vectors', count(*) FROM embeddings WHERE vec_id NOT IN (SELECT file_id FROM gone)
    UNION ALL SELECT 'after a reset', 0"""
)
def k6_remove_files(spark, d):
    files, chunks = view(spark, d, "fx_files"), view(spark, d, "fx_chunks").select("chunk_id", "file_id")
    vectors = view(spark, d, "embeddings").select((F.col("vec_id") * T.CHUNK_IDS).alias("vec_id"))
    left = I.remove_files(files, chunks, vectors, files.where("path LIKE '/vault/src11/%'"))
    counted = [x.agg(F.lit(n).alias("kind"), F.count("*").alias("n")) for n, x in zip(("files", "chunks", "vectors", "after a reset"), (*left, *I.reset(files)), strict=True)]
    return counted[0].union(counted[1]).union(counted[2]).union(counted[3])


_STORES = "SELECT concat(split_part(path, '/', 3), '/', CAST(file_id % 50 AS STRING)) AS store, path, modified_time, size_chars % 3 AS n_chunks FROM {fx_files} WHERE path NOT LIKE '/vault/src7/%'"
_UPLOADS = "SELECT concat(split_part(path, '/', 3), '/', CAST(file_id % 50 AS STRING)) AS store, path, modified_time + CASE WHEN path LIKE '%/fr/%' THEN 60 ELSE 0 END AS modified_time FROM {fx_files}"


@query(
    cte("fx_files") + ", s AS (" + _STORES.replace("{fx_files}", "fx_files") + "), u AS (" + _UPLOADS.replace("{fx_files}", "fx_files") + """),
    t AS (SELECT store, count(*) AS n FROM s GROUP BY store)
    SELECT store, path, CASE WHEN same THEN 'skipped' ELSE 'indexed' END AS status, CASE WHEN same THEN 'unchanged' ELSE 'chat_isolated' END AS reason FROM (
        SELECT u.store, u.path, coalesce(t.n = 1 AND s.modified_time = u.modified_time AND s.n_chunks > 0, false) AS same
        FROM u LEFT JOIN t ON t.store = u.store LEFT JOIN s ON s.store = u.store AND s.path = u.path)"""
)
def k8_chat_ingest(spark, d):
    """Stores of one or more files; French files have changed, some stores have no chunks."""
    files = view(spark, d, "fx_files")
    return I.chat_ingest(spark.sql(_STORES, fx_files=files), spark.sql(_UPLOADS, fx_files=files))


_EXISTING = "SELECT new_path AS path FROM {fx_sorts} WHERE category <> '2-HIGH' AND day(sorted_at) > 3 UNION ALL SELECT original_path FROM {fx_sorts} WHERE day(sorted_at) > 25"


@query(
    cte("fx_sorts") + ", e AS (" + _EXISTING.replace("{fx_sorts}", "fx_sorts") + """)
    SELECT sort_id, ok AS undone, CASE WHEN ok THEN new_path END AS from_path, CASE WHEN ok THEN original_path END AS to_path FROM (
        SELECT *, undone <> 1 AND new_path IN (SELECT path FROM e) AND original_path NOT IN (SELECT path FROM e) AS ok FROM fx_sorts WHERE category <> '5-LOW')"""
)
def q_undo_sorts(spark, d):
    log = view(spark, d, "fx_sorts")
    return I.undo_sorts(log, log.where("category <> '5-LOW'"), spark.sql(_EXISTING, fx_sorts=log))
