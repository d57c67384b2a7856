"""Incremental indexing as transforms from an old snapshot to a new one."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _same(names: list[str]) -> Column:
    return reduce(lambda a, n: a & F.col(f"o.{n}").eqNullSafe(F.col(f"n.{n}")), names, F.lit(True))


def snapshot_diff(stored: DataFrame, scanned: DataFrame, key: str = "path", stamp: str = "modified_time") -> DataFrame:
    """key, status (new, modified, deleted, unchanged), old and new stamps."""
    old = stored.select(F.col(key).alias("k"), F.col(stamp).alias("old_stamp"), F.lit(1).alias("o"))
    new = scanned.select(F.col(key).alias("k"), F.col(stamp).alias("new_stamp"), F.lit(1).alias("n"))
    status = (
        F.when(F.col("o").isNull(), "new").when(F.col("n").isNull(), "deleted")
        .when(F.col("old_stamp").eqNullSafe(F.col("new_stamp")), "unchanged").otherwise("modified")
    )
    return old.join(new, "k", "full_outer").select(F.col("k").alias(key), status.alias("status"), "old_stamp", "new_stamp")


def status_counts(diff: DataFrame) -> DataFrame:
    return diff.groupBy("status").agg(F.count("*").alias("n"))


def refresh_files(stored: DataFrame, scanned: DataFrame, root: str | None = None) -> DataFrame:
    """The next file table: changed files keep id and creation time, new ones get the hash of their path as id.

    root: only files under it can be deleted; without it every file that was not scanned goes.
    """
    old = stored.select(*[F.col(c).alias(f"o_{c}") for c in stored.columns])
    joined = old.join(scanned, F.col("o_path") == F.col("path"), "full_outer")
    gone = F.col("path").isNull()
    if root is not None:
        gone = gone & F.lower("o_path").startswith(root.lower())
    known = F.col("o_path").isNotNull()
    return joined.where(~gone).select(
        F.coalesce("o_file_id", F.xxhash64("path")).alias("file_id"),
        F.coalesce("path", "o_path").alias("path"),
        F.coalesce("filename", "o_filename").alias("filename"),
        F.coalesce("modified_time", "o_modified_time").alias("modified_time"),
        F.when(known, F.col("o_created_time")).otherwise(F.col("created_time")).alias("created_time"),
    )


def refresh_chunks(chunks: DataFrame, changed: DataFrame, fresh: DataFrame) -> DataFrame:
    """Chunks without those of changed, skipped or deleted files (file_id), and with the fresh ones."""
    return chunks.join(changed.select("file_id").distinct(), "file_id", "left_anti").unionByName(fresh)


def affected_chunks(old: DataFrame, new: DataFrame, changed: DataFrame) -> DataFrame:
    """Chunk ids to renew in the vector index: those of the changed files before and after."""
    ids = changed.select("file_id").distinct()
    return old.join(ids, "file_id", "left_semi").select("chunk_id").union(new.join(ids, "file_id", "left_semi").select("chunk_id")).distinct()


def refresh_vectors(vectors: DataFrame, removed: DataFrame, added: DataFrame) -> DataFrame:
    """The vector table without the removed ids and with the added rows (ids that are added replace older ones)."""
    out = removed.select("vec_id").union(added.select("vec_id")).distinct()
    return vectors.join(out, "vec_id", "left_anti").unionByName(added)


def upsert(stored: DataFrame, changes: DataFrame, key: str, order: str) -> DataFrame:
    """Each key's last row: the one with the largest `order` of the changes, else the stored one."""
    both = stored.withColumn("_late", F.lit(0)).unionByName(changes.withColumn("_late", F.lit(1)), allowMissingColumns=True)
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("_late"), F.desc_nulls_last(order)))
    return both.withColumn("_place", place).where("_place = 1").drop("_late", "_place")


def insert_missing(stored: DataFrame, defaults: DataFrame, key: str) -> DataFrame:
    return stored.unionByName(defaults.join(stored.select(key), key, "left_anti"))


def skip_counts(rows: DataFrame, reason: str = "reason") -> DataFrame:
    """reason, n, family: unreadable (the file is dropped) or other."""
    unreadable = F.col(reason).isin("permission_denied", "not_found", "file_locked", "password_protected", "access_error")
    return rows.groupBy(reason).agg(F.count("*").alias("n")).withColumn("family", F.when(unreadable, "unreadable").otherwise("other"))


def move_files(files: DataFrame, moves: DataFrame) -> DataFrame:
    """Files under their new paths (old_path, new_path, moved_at); a missing creation time becomes the move's."""
    m = moves.select(F.col("old_path").alias("path"), "new_path", "moved_at")
    joined = files.join(m, "path", "left")
    moved = F.col("new_path").isNotNull()
    return joined.select(
        "file_id",
        F.coalesce("new_path", "path").alias("path"),
        F.when(moved, F.element_at(F.split("new_path", "/"), -1)).otherwise(F.col("filename")).alias("filename"),
        F.when(moved, F.coalesce("created_time", "moved_at")).otherwise(F.col("created_time")).alias("created_time"),
    )


def unique_targets(moves: DataFrame) -> DataFrame:
    """Adds target: files that want one path get `stem (n).ext` from the second on, in the order of their ids."""
    n = F.row_number().over(Window.partitionBy("new_path").orderBy("file_id")) - 1
    base, ext = (F.regexp_extract("new_path", r"^(.*?)(\.[^./]*)?$", k) for k in (1, 2))
    return moves.withColumn("_n", n).withColumn(
        "target", F.when(F.col("_n") == 0, F.col("new_path")).otherwise(F.concat(base, F.lit(" ("), F.col("_n").cast("string"), F.lit(")"), ext))
    ).drop("_n")


def content_copies(docs: DataFrame, text: str = "text") -> DataFrame:
    """content_hash, n_files, kept_id: uploads are named and reused by the hash of their content."""
    return docs.groupBy(F.sha2(F.col(text), 256).alias("content_hash")).agg(F.count("*").alias("n_files"), F.min("doc_id").alias("kept_id"))


UNREADABLE = ("permission_denied", "file_locked", "password_protected", "not_found", "access_error")


def ingest_files(stored: DataFrame, found: DataFrame) -> DataFrame:
    """path, status, reason, new_chunks of files that are ingested one by one.

    found: path, supported, modified_time, reason (why it can't be read, else null)
    and n_chunks. The checks come in order: an unsupported kind, an unchanged
    file, an unreadable one; what is left is indexed.
    """
    old = stored.select("path", F.col("modified_time").alias("_old"))
    joined = found.join(old, "path", "left")
    reason = (
        F.when(~F.col("supported"), "unsupported_file_type")
        .when(F.col("_old") == F.col("modified_time"), "unchanged")
        .when(F.col("reason").isin(*UNREADABLE), F.col("reason"))
    )
    rows = joined.withColumn("_why", reason)
    skipped = F.col("_why").isNotNull()
    return rows.select(
        "path", F.when(skipped, "skipped").otherwise("indexed").alias("status"), F.col("_why").alias("reason"),
        F.when(skipped, 0).otherwise(F.col("n_chunks")).cast("long").alias("new_chunks"),
    )


def remove_files(files: DataFrame, chunks: DataFrame, vectors: DataFrame, paths: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Files, chunks and vectors (vec_id is a chunk_id) without the files at those paths."""
    gone = files.join(paths.select("path").distinct(), "path", "left_semi").select("file_id")
    ids = chunks.join(gone, "file_id", "left_semi").select(F.col("chunk_id").alias("vec_id"))
    return files.join(gone, "file_id", "left_anti"), chunks.join(gone, "file_id", "left_anti"), vectors.join(ids, "vec_id", "left_anti")


def reset(*tables: DataFrame) -> tuple[DataFrame, ...]:
    """The same tables without rows."""
    return tuple(t.limit(0) for t in tables)


def chat_ingest(stored: DataFrame, uploads: DataFrame) -> DataFrame:
    """store, path, status, reason: an upload is skipped if it is the one file of its chat store, unchanged and with chunks.

    stored: store, path, modified_time, n_chunks; uploads: store, path, modified_time.
    """
    held = stored.groupBy(F.col("store").alias("_store")).agg(F.count("*").alias("_files"))
    old = stored.select(F.col("store").alias("_s"), F.col("path").alias("_p"), F.col("modified_time").alias("_m"), "n_chunks")
    joined = uploads.join(held, F.col("store") == F.col("_store"), "left").join(old, (F.col("store") == F.col("_s")) & (F.col("path") == F.col("_p")), "left")
    same = F.coalesce((F.col("_files") == 1) & (F.col("_m") == F.col("modified_time")) & (F.col("n_chunks") > 0), F.lit(False))
    return joined.select("store", "path", F.when(same, "skipped").otherwise("indexed").alias("status"), F.when(same, "unchanged").otherwise("chat_isolated").alias("reason"))


def undo_sorts(log: DataFrame, asked: DataFrame, existing: DataFrame) -> DataFrame:
    """sort_id, undone, from_path, to_path: a sort can be undone once, if its new place is there and its old one free.

    log: sort_id, original_path, new_path, undone (0 or 1); existing: path.
    """
    there = existing.select(F.col("path").alias("_e")).distinct()
    wanted = log.join(asked.select("sort_id").distinct(), "sort_id", "left_semi")
    here = wanted.join(there.select(F.col("_e").alias("new_path"), F.lit(True).alias("_here")), "new_path", "left")
    both = here.join(there.select(F.col("_e").alias("original_path"), F.lit(True).alias("_taken")), "original_path", "left")
    done = (F.coalesce("undone", F.lit(0)) != 1) & F.col("_here").isNotNull() & F.col("_taken").isNull()
    return both.select("sort_id", done.alias("undone"), F.when(done, F.col("new_path")).alias("from_path"), F.when(done, F.col("original_path")).alias("to_path"))
