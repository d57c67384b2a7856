"""File sources: scans of folders and text of documents, by format."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import LongType, StringType, StructField, StructType

from docloom.functions.classify import hidden, ignored_dir, supported_file, valid_size
from docloom.functions.text import filename, suffix

MOST_CHARS, PREVIEW_CHARS = 100_000, 20_000

SCAN = "path string, filename string, modified_time long, size long"


def listing(spark: SparkSession, roots: list[str]) -> DataFrame:
    """path, filename, modified_time, size of all files below the roots; contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(roots)
    path = F.regexp_replace("path", "^file:/+", "/")
    return found.select(path.alias("path"), filename(path).alias("filename"), F.unix_timestamp("modificationTime").alias("modified_time"), F.col("length").alias("size"))


@arrow_udf(LongType())
def _created(path):
    import os

    import pyarrow as pa

    def stamp(p):
        try:
            found = os.stat(p)
        except (OSError, TypeError, ValueError):
            return None
        return int(getattr(found, "st_birthtime", found.st_ctime))

    return pa.array([stamp(p) for p in path.to_pylist()], pa.int64())


def with_created(files: DataFrame) -> DataFrame:
    """Adds created_time in seconds where the path can be reached as a file (a mounted folder), null elsewhere: object stores keep none."""
    return files.withColumn("created_time", _created("path"))


def default_roots(home: str, override: str | None = None) -> list[str]:
    """Where a scan begins: the folders of an override (parted by the system's path separator), else the usual ones of a home."""
    import os

    if override:
        return list(dict.fromkeys(p.strip().rstrip("/") for p in override.split(os.pathsep) if p.strip()))
    return [f"{home.rstrip('/')}/{name}" for name in ("Desktop", "Documents", "Downloads")]


def indexable(files: DataFrame, roots: list[str]) -> DataFrame:
    """Documents of a supported kind and size; below the roots no folder may be hidden or ignored."""
    longest = sorted((r.rstrip("/") for r in roots), key=len, reverse=True)
    below = F.regexp_replace("path", f"^(?:{'|'.join(map(re.escape, longest))})/", "")
    return files.where(supported_file(F.col("filename")) & ~ignored_dir(below) & valid_size(F.col("filename"), F.col("size")))


def scan(spark: SparkSession, roots: list[str]) -> DataFrame:
    return indexable(listing(spark, roots), roots)


def explorer(files: DataFrame, show_hidden: bool = False, folder: str | None = None) -> DataFrame:
    """name, path, type, ext, size, modified of a listing; hidden and system items left out.

    folder: what lies right in it, its files and the folders that lead to further
    files (size 0, the time of the latest change below); without it all files.
    Paths have / between their parts.
    """
    item = lambda name, path, kind, ext, size, modified: [name.alias("name"), path.alias("path"), F.lit(kind).alias("type"), ext.alias("ext"), size.alias("size"), modified.alias("modified")]
    own = item(F.col("filename"), F.col("path"), "file", suffix(F.col("path")), F.col("size"), F.col("modified_time"))
    if folder is None:
        rows = files.select(*own)
    else:
        base = folder.rstrip("/") + "/"
        below = F.substr("path", F.lit(len(base) + 1))
        inside = files.where(F.col("path").startswith(base)).withColumn("_first", F.split(below, "/", 2)[0])
        here = F.col("path") == F.concat(F.lit(base), F.col("_first"))
        led = inside.where(~here).groupBy("_first").agg(F.max("modified_time").alias("m"))
        folders = led.select(*item(F.col("_first"), F.concat(F.lit(base), F.col("_first")), "folder", suffix(F.col("_first")), F.lit(0).cast("long"), F.col("m")))
        rows = inside.where(here).select(*own).unionByName(folders)
    return rows if show_hidden else rows.where(~hidden(F.col("name")))


_TEXT = StructType([StructField("text", StringType()), StructField("reason", StringType())])


@arrow_udf(_TEXT)
def _extracted(name, content):
    import pyarrow as pa

    from docloom.sources.office import extract

    rows = [extract(n, c, MOST_CHARS) for n, c in zip(name.to_pylist(), content.to_pylist(), strict=True)]
    return pa.array([{"text": t, "reason": r} for t, r in rows], pa.struct([("text", pa.string()), ("reason", pa.string())]))


def extracted(name: Column, content: Column) -> Column:
    """struct(text, reason): reason is null, password_protected or extract_error."""
    return _extracted(name, content)


@arrow_udf(_TEXT)
def _opened(path):
    import pyarrow as pa

    from docloom.sources.office import access_reason, extract

    rows = []
    for p in path.to_pylist():
        try:
            with open(p, "rb") as f:
                rows.append(extract(p, f.read(), MOST_CHARS))
        except OSError as e:
            rows.append(("", access_reason(e)))
    return pa.array([{"text": t, "reason": r} for t, r in rows], pa.struct([("text", pa.string()), ("reason", pa.string())]))


def opened(path: Column) -> Column:
    """struct(text, reason) of files in a mounted folder, opened by the tasks: what can't be opened gets permission_denied,
    not_found, file_locked or access_error and doesn't fail the job."""
    return _opened(path)


def read_documents(spark: SparkSession, roots: list[str]) -> DataFrame:
    """path, text, reason of the documents below the roots; reason is null where the text could be read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(roots)
    path = F.regexp_replace("path", "^file:/+", "/")
    rows = found.select(path.alias("path"), "content", F.col("length").alias("size")).withColumn("filename", filename(F.col("path")))
    return indexable(rows, roots).select("path", extracted(F.col("filename"), F.col("content")).alias("x")).select("path", "x.text", "x.reason")


@arrow_udf(StringType())
def _previewed(name, content):
    import pyarrow as pa

    from docloom.sources.office import preview

    return pa.array([preview(n, c) for n, c in zip(name.to_pylist(), content.to_pylist(), strict=True)], pa.string())


def preview(name: Column, content: Column) -> Column:
    """JSON of kind, text (at most PREVIEW_CHARS), truncated and error."""
    return _previewed(name, content)


def read_metadata(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """One row for each JSON file of a folder; `*.structure.json` and broken files are passed over."""
    found = spark.read.text(folder, wholetext=True, pathGlobFilter="*.json")
    named = found.where(~F.col("_metadata.file_name").endswith(".structure.json"))
    parsed = named.select(F.from_json("value", f"{schema}, _broken string", {"columnNameOfCorruptRecord": "_broken"}).alias("x"))
    return parsed.select("x.*").where("_broken is null").drop("_broken")
