"""Listings: sorting, grouping, folder sizes, recent folders and releases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.text import parent_path, suffix


def sort_items(items: DataFrame, by: str = "name", descending: bool = False) -> DataFrame:
    """Folders first, then by name, date (created, else modified), size or type; ties by path."""
    keys = {"name": F.col("name"), "date": F.coalesce("created", "modified", F.lit(0)), "size": F.col("size"), "type": F.coalesce("ext", F.lit(""))}
    key = keys[by].desc() if descending else keys[by].asc()
    return items.orderBy(F.when(F.col("type") == "folder", 0).otherwise(1), key, "path")


def group_by_type(items: DataFrame) -> DataFrame:
    key = F.when(F.col("type") == "folder", "Folders").otherwise(F.coalesce(F.when(F.col("ext") != "", F.col("ext")), F.lit("Other")))
    return items.groupBy(key.alias("key")).agg(F.count("*").alias("n"), F.sum("size").alias("size"))


def group_by_day(items: DataFrame, stamp: str = "modified") -> DataFrame:
    day = F.date_format(F.timestamp_seconds(F.col(stamp)), "yyyy-MM-dd")
    return items.groupBy(day.alias("key")).agg(F.count("*").alias("n"), F.sum("size").alias("size"))


def folder_sizes(files: DataFrame, root: str, depth: int = 2) -> DataFrame:
    """folder, size: bytes of each folder right under root, of files at most `depth` folders below it."""
    rel = F.split(F.substring("path", len(root.rstrip("/")) + 2, 1 << 30), "/")
    inside = files.where(F.col("path").startswith(root.rstrip("/") + "/")).withColumn("_rel", rel)
    near = inside.where((F.size("_rel") >= 2) & (F.size("_rel") - 2 <= depth))
    return near.groupBy(F.col("_rel")[0].alias("folder")).agg(F.sum("size_chars").alias("size"))


def recent_folders(visits: DataFrame, n: int = 2) -> DataFrame:
    """folder, visits, last_visit of the n folders visited last."""
    counted = visits.groupBy("folder").agg(F.count("*").alias("visits"), F.max("ts").alias("last_visit"))
    return counted.orderBy(F.desc("last_visit"), F.desc("visits"), "folder").limit(n)


def longest_root(paths: DataFrame, roots: DataFrame) -> DataFrame:
    """path, root: the longest of the roots that holds the path; an equi-join on the path's own leading parts."""
    parts = F.split(F.lower("path"), "/")
    leads = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    led = paths.select("path", F.explode(leads).alias("_lead")).join(roots.select("root", F.lower("root").alias("_root")), F.col("_lead") == F.col("_root"))
    return led.groupBy("path").agg(F.max_by("root", F.struct(F.length("root"), "root")).alias("root"))


def first_by_extension(files: DataFrame, priority: list[str]) -> DataFrame:
    """folder, path: of each folder the file whose extension comes first in the list; ties by path."""
    place = F.array_position(F.array(*map(F.lit, priority)), suffix(F.col("path")))
    ranked = files.withColumns({"folder": parent_path(F.col("path")), "_p": F.when(place > 0, place).otherwise(F.lit(len(priority) + 1))})
    return ranked.withColumn("_n", F.row_number().over(Window.partitionBy("folder").orderBy("_p", "path"))).where("_n = 1").select("folder", "path")


def release_key(tag: Column) -> Column:
    """A struct that sorts release tags; a prerelease sorts below its release."""
    bare = F.regexp_replace(F.trim(tag), "(?i)^v", "")
    part = lambda k: F.regexp_extract(bare, r"^(\d+)\.(\d+)\.(\d+)(?:[-+](.+))?$", k)
    number = lambda k: F.when(part(k) != "", part(k).cast("long"))
    return F.struct(number(1).alias("major"), number(2).alias("minor"), number(3).alias("patch"), (part(4) == "").alias("final"), part(4).alias("pre"))


def log_lines(logs: DataFrame, stamp: str, level: Column, category: Column) -> DataFrame:
    """log_id, line: what an export writes."""
    text = F.concat(F.lit("["), F.col(stamp).cast("string"), F.lit("] ["), F.upper(level), F.lit("] ["), category, F.lit("] "), F.col("message"))
    return logs.select("log_id", text.alias("line"))
