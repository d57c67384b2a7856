"""Versions of files: timeline, reuse of storage, retention, blocks and integrity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.dates import age_days

BLOCK, SYNC_BLOCK = 512 * 1024, 128 * 1024


def content_hash(text: Column) -> Column:
    """SHA-256 of the text with line ends as \\n."""
    return F.sha2(F.replace(text, F.lit("\r\n"), F.lit("\n")), 256)


def binary_hash(data: Column) -> Column:
    """SHA-256 of the bytes read as Latin-1 and written as UTF-8."""
    return F.sha2(F.encode(F.decode(data, "ISO-8859-1"), "UTF-8"), 256)


def _by(*order) -> Window:
    return Window.partitionBy("file_id").orderBy(*order)


def timeline(versions: DataFrame) -> DataFrame:
    """Adds number (1 is the oldest), parent (the version before) and storage (full every third, else diff)."""
    n = F.row_number().over(_by("stamp", "version"))
    out = versions.withColumn("number", n).withColumn("parent", F.lag("version").over(_by("stamp", "version")))
    return out.withColumn("storage", F.when((F.col("number") > 1) & (F.col("number") % 3 != 1), "diff").otherwise("full"))


def latest(versions: DataFrame) -> DataFrame:
    return versions.withColumn("_n", F.row_number().over(_by(F.desc("stamp"), F.desc("version")))).where("_n = 1").drop("_n")


def reused_storage(versions: DataFrame) -> DataFrame:
    """Adds reused: the earliest version with the same content, null for that one itself."""
    same = Window.partitionBy("file_id", "hash").orderBy("stamp", "version")
    first = F.first("version").over(same)
    return versions.withColumn("reused", F.when(first != F.col("version"), first))


def changed_only(versions: DataFrame) -> DataFrame:
    """Versions whose content differs from the one before: a save without a change is none."""
    before = F.lag("hash").over(_by("stamp", "version"))
    return versions.withColumn("_b", before).where(F.col("_b").isNull() | (F.col("_b") != F.col("hash"))).drop("_b")


def retention(versions: DataFrame, now: int) -> DataFrame:
    """Adds age and keep: all for 30 days, the newest of each UTC day for a year, nothing older."""
    aged = versions.withColumn("age", age_days(F.col("stamp"), now))
    day = F.when((F.col("age") > 30) & (F.col("age") <= 365), F.to_date(F.timestamp_seconds("stamp")))
    first = F.row_number().over(Window.partitionBy("file_id", "_day").orderBy(F.desc("stamp"), F.desc("version")))
    out = aged.withColumn("_day", day).withColumn("_first", first)
    keep = (F.col("age") <= 30) | ((F.col("age") <= 365) & (F.col("_first") == 1))
    return out.withColumn("keep", keep).drop("_day", "_first")


def freed(versions: DataFrame) -> DataFrame:
    """file_id, deleted, freed_bytes of versions with keep and reused: storage that a kept version uses stays."""
    used = versions.where("keep").select("file_id", F.coalesce("reused", "version").alias("version")).distinct()
    gone = versions.where("not keep")
    free = gone.where("reused is null").join(used, ["file_id", "version"], "left_anti")
    count = gone.groupBy("file_id").agg(F.count("*").alias("deleted"))
    size = free.groupBy("file_id").agg(F.sum("size").alias("freed_bytes"))
    return count.join(size, "file_id", "left").select("file_id", "deleted", F.coalesce("freed_bytes", F.lit(0)).alias("freed_bytes"))


def blocks(files: DataFrame, content: str, size: int = BLOCK, algorithm: str = "sha2") -> DataFrame:
    """file columns without the content, block (from 0), block_hash, data of each fixed-size block."""
    data = F.col(content).cast("binary")
    last = F.greatest(F.ceil(F.octet_length(data) / F.lit(float(size))) - 1, F.lit(0)).cast("int")
    others = [c for c in files.columns if c != content]
    cut = files.select(*others, data.alias("_data"), F.explode(F.sequence(F.lit(0), last)).alias("block"))
    piece = F.expr(f"substring(_data, block * {size} + 1, {size})")
    out = cut.withColumn("data", piece).drop("_data")
    return out.withColumn("block_hash", F.sha2("data", 256) if algorithm == "sha2" else F.md5("data"))


def recipe(block_rows: DataFrame, *keys: str) -> DataFrame:
    """keys, recipe: the block hashes in order."""
    held = F.array_sort(F.collect_list(F.struct("block", "block_hash")))
    return block_rows.groupBy(*keys).agg(F.transform(held, lambda x: x["block_hash"]).alias("recipe"))


def rebuild(recipes: DataFrame, store: DataFrame, *keys: str) -> DataFrame:
    """keys, content: contents from recipes and a store of blocks (block_hash, data)."""
    parts = recipes.select(*keys, F.posexplode("recipe").alias("block", "block_hash")).join(store, "block_hash")
    held = F.array_sort(F.collect_list(F.struct("block", F.decode("data", "ISO-8859-1").alias("s"))))
    text = F.array_join(F.transform(held, lambda x: x["s"]), "")
    return parts.groupBy(*keys).agg(F.encode(text, "ISO-8859-1").alias("content"))


def orphans(store: DataFrame, recipes: DataFrame) -> DataFrame:
    """Blocks that no recipe names."""
    return store.join(recipes.select(F.explode("recipe").alias("block_hash")).distinct(), "block_hash", "left_anti")


def intact(versions: DataFrame, content: str = "content", stored: str = "hash") -> DataFrame:
    """Adds ok: whether the content still has the hash that was stored with it, as a restore requires."""
    return versions.withColumn("ok", content_hash(F.col(content)) == F.col(stored))


def merge_listings(indexed: DataFrame, legacy: DataFrame) -> DataFrame:
    """Indexed version rows and the legacy ones that the index doesn't have, newest first by id."""
    more = legacy.join(indexed.select("version_id"), "version_id", "left_anti")
    return indexed.unionByName(more, allowMissingColumns=True).orderBy(F.desc("version_id"))


def next_number(versions: DataFrame, paths: DataFrame) -> DataFrame:
    """path, next_version: one more than the largest so far, or 1."""
    top = versions.groupBy("path").agg(F.max("version").alias("v"))
    return paths.select("path").distinct().join(top, "path", "left").select("path", (F.coalesce("v", F.lit(0)) + 1).alias("next_version"))


def stability(old: Column, new: Column, risk: Column) -> Column:
    """0.05 to 1: likeness of the lengths, less 70 % of the risk; 1 without old content."""
    empty = old.isNull() | F.trim(F.regexp_replace(old, r"^\s+|\s+$", "")).isin("", "{}", "[]", "None")
    a, b = F.length(old), F.coalesce(F.length(new), F.lit(0))
    most = F.greatest(a, b)
    value = (1.0 - F.abs(b - a) / most) * (1.0 - risk * 0.7)
    return F.when(empty | (most == 0), F.lit(1.0)).otherwise(F.round(F.greatest(F.lit(0.05), F.least(value, F.lit(1.0))), 3))
