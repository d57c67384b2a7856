"""Queries: listings, logs of sorted files and releases."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.functions import classify as C
from docloom.functions.text import log_level, log_prefix, suffix
from docloom.operators import events as E
from docloom.operators import explorer as X
from docloom.operators.registry import query
from docloom.plans.fixtures import cte, view

_ITEMS = "items AS (SELECT filename AS name, path, regexp_extract(filename, '(\\.[^.]+)$', 1) AS ext, size_chars AS size, modified_time AS modified, created_time AS created, CASE WHEN path LIKE '%/de/%' THEN 'folder' ELSE 'file' END AS type FROM fx_files)"


def _items(spark, d):
    """German files stand for folders."""
    f = view(spark, d, "fx_files")
    kind = F.when(F.col("path").like("%/de/%"), "folder").otherwise("file")
    return f.select(F.col("filename").alias("name"), "path", suffix(F.col("path")).alias("ext"), F.col("size_chars").alias("size"), F.col("modified_time").alias("modified"), F.col("created_time").alias("created"), kind.alias("type"))


@query(cte("fx_files") + "," + _ITEMS + " SELECT path, type FROM items ORDER BY CASE WHEN type = 'folder' THEN 0 ELSE 1 END, coalesce(created, modified) DESC, path")
def g9_explorer_sort(spark, d):
    return X.sort_items(_items(spark, d), "date", True).select("path", "type")


@query(cte("fx_files") + "," + _ITEMS + " SELECT CASE WHEN type = 'folder' THEN 'Folders' WHEN ext <> '' THEN ext ELSE 'Other' END AS key, count(*) AS n, CAST(sum(size) AS BIGINT) AS size FROM items GROUP BY 1")
def e21_group_by_type(spark, d):
    return X.group_by_type(_items(spark, d))


@query(cte("fx_files") + "," + _ITEMS + " SELECT strftime(make_timestamp(modified * 1000000), '%Y-%m-%d') AS key, count(*) AS n, CAST(sum(size) AS BIGINT) AS size FROM items GROUP BY 1")
def e21_group_by_day(spark, d):
    return X.group_by_day(_items(spark, d))


@query(cte("fx_files") + "SELECT split_part(path, '/', 3) AS folder, CAST(sum(size_chars) AS BIGINT) AS size FROM fx_files GROUP BY 1")
def e19_folder_sizes(spark, d):
    return X.folder_sizes(view(spark, d, "fx_files"), "/vault")


@query("SELECT event_type || '/' || CAST(user_id AS VARCHAR) AS folder, count(*) AS visits, max(ts) AS last_visit FROM events GROUP BY 1 ORDER BY last_visit DESC, visits DESC, folder LIMIT 2")
def e22_recent_folders(spark, d):
    visits = view(spark, d, "events").select(F.concat_ws("/", "event_type", F.col("user_id").cast("string")).alias("folder"), "ts")
    return X.recent_folders(visits)


@query(cte("fx_files") + "SELECT path, root FROM (SELECT path, root, row_number() OVER (PARTITION BY path ORDER BY length(root) DESC, root DESC) AS p FROM fx_files JOIN (VALUES ('/vault'), ('/vault/src1'), ('/VAULT/src1/en')) r(root) ON starts_with(lower(path), lower(root) || '/')) WHERE p = 1")
def g13_longest_root(spark, d):
    roots = spark.createDataFrame([("/vault",), ("/vault/src1",), ("/VAULT/src1/en",)], "root string")
    return X.longest_root(view(spark, d, "fx_files").select("path"), roots)


_PRIORITY = [".docx", ".pdf", ".txt"]


@query(cte("fx_files") + "SELECT folder, path FROM (SELECT *, row_number() OVER (PARTITION BY folder ORDER BY k, path) AS p FROM (SELECT path, regexp_replace(path, '/[^/]*$', '') AS folder, CASE regexp_extract(path, '(\\.[^.]+)$', 1) WHEN '.docx' THEN 1 WHEN '.pdf' THEN 2 WHEN '.txt' THEN 3 ELSE 4 END AS k FROM fx_files)) WHERE p = 1")
def g11_first_by_extension(spark, d):
    return X.first_by_extension(view(spark, d, "fx_files"), _PRIORITY)


@query("SELECT p_partkey, row_number() OVER (ORDER BY p_size, p_size % 7, p_partkey % 10, CASE WHEN p_size % 2 = 1 THEN 0 ELSE 1 END, p_partkey) AS place FROM part")
def g12_release_order(spark, d):
    tag = F.concat(F.lit("v"), F.concat_ws(".", F.col("p_size").cast("string"), (F.col("p_size") % 7).cast("string"), (F.col("p_partkey") % 10).cast("string")), F.when(F.col("p_size") % 2 == 1, "-beta").otherwise(""))
    from docloom.functions.ranks import with_place

    return with_place(view(spark, d, "part").select("p_partkey", X.release_key(tag).alias("k")), ["k", "p_partkey"], "place").select("p_partkey", "place")


_LINE = "'[' || CAST(event_id AS VARCHAR) || '] [' || upper(CASE WHEN event_type = 'error' THEN 'error' WHEN event_type IN ('purchase') THEN 'warning' WHEN event_type = 'signup' THEN 'success' ELSE 'info' END) || '] [' || event_type || '] ' || message"


@query(cte("fx_logs") + f"SELECT log_id, {_LINE} AS line FROM fx_logs JOIN events ON event_id = log_id")
def b13_log_export(spark, d):
    logs = view(spark, d, "fx_logs")
    level = log_level(F.col("message"), F.col("message").contains("[error]"))
    return X.log_lines(logs.withColumn("at", F.col("log_id")), "at", level, log_prefix(F.col("message")))


@query(cte("fx_sorts") + "SELECT sort_id, undone = 0 AND NOT EXISTS (SELECT 1 FROM fx_files WHERE path = original_path) AS undoable FROM fx_sorts".replace("FROM fx_files WHERE path", "FROM (SELECT '' AS path) WHERE path"))
def q_sort_log(spark, d):
    """A move can be undone once, while its old place is free."""
    rows = view(spark, d, "fx_sorts")
    taken = rows.select(F.col("new_path").alias("_taken"))
    joined = rows.join(taken, rows.original_path == F.col("_taken"), "left")
    return joined.select("sort_id", ((F.col("undone") == 0) & F.col("_taken").isNull()).alias("undoable"))


@query(cte("fx_sorts") + "SELECT sort_id, category, new_path FROM fx_sorts ORDER BY sorted_at DESC, sort_id DESC LIMIT 50")
def g5_recent_sorts(spark, d):
    rows = view(spark, d, "fx_sorts").withColumn("_at", F.struct("sorted_at", "sort_id"))
    return E.ring(rows, None, "_at", 50).select("sort_id", "category", "new_path")


_NAMES = "SELECT o_orderkey AS id, CASE o_orderkey % 8 WHEN 0 THEN 'a.tmp' WHEN 1 THEN '~$b.docx' WHEN 2 THEN 'C:\\Windows\\x.dll' WHEN 3 THEN '.env' WHEN 4 THEN '.hidden' WHEN 5 THEN 'Thumbs.db' WHEN 6 THEN 'report.pdf' ELSE 'd.crdownload' END AS name FROM {t}"


@query("SELECT id, name, name IN ('a.tmp', '~$b.docx', 'Thumbs.db', 'd.crdownload') AS transient, name IN ('a.tmp', 'd.crdownload') AS temporary, starts_with(name, 'C:') AS protected, name IN ('a.tmp', 'C:\\Windows\\x.dll', '.hidden', 'Thumbs.db') AS hidden FROM (" + _NAMES.format(t="orders") + ")")
def c10_file_predicates(spark, d):
    rows = spark.sql(_NAMES.replace("\\", "\\\\"), t=view(spark, d, "orders"))
    n = F.col("name")
    return rows.select("id", "name", C.transient(n).alias("transient"), C.temporary(n).alias("temporary"), C.protected(n).alias("protected"), C.hidden(n).alias("hidden"))
