"""Files, chunks, keyword postings and vectors that are renewed together, in one commit of a store."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.ranks import with_place
from docloom.functions.text import file_of, index_chunks, tokens
from docloom.operators.indexing import snapshot_diff
from docloom.operators.inverted import KeywordIndex
from docloom.operators.vector_index import VectorIndex
from docloom.session import reliable
from docloom.sources.store import Change, Snapshot, Store

FILE = ["file_id", "path", "filename", "modified_time", "created_time"]


class Library:
    """The tables files (by path), chunks (by chunk_id), postings and vectors of a store.

    embed: a column function of the chunks' texts; without it no vectors are kept.
    """

    def __init__(self, store: Store, embed: Callable[[Column], Column] | None = None, tokenize: Callable[[Column], Column] = tokens):
        self.store, self.embed = store, embed
        self.keywords, self.vectors = KeywordIndex("postings", tokenize), VectorIndex("vectors")

    def files(self, snapshot: Snapshot) -> DataFrame | None:
        return snapshot.read("files", "path")

    def chunks(self, snapshot: Snapshot) -> DataFrame | None:
        return snapshot.read("chunks", "chunk_id")

    def refresh(self, scanned: DataFrame, root: str | None = None) -> Snapshot:
        """Brings the library to the state of a scan (path, filename, modified_time, created_time, text), in one commit.

        New and modified files are cut and indexed, modified ones keep their id and
        creation time, files that were not scanned go (with a root: those under it). A
        text that could not be read (null) takes its file out, until a later scan can.
        """
        return self.store.transact(lambda change: self._refresh(change, scanned, root))

    def _refresh(self, change: Change, scanned: DataFrame, root: str | None) -> None:
        spark = self.store.spark
        held = self.files(change.base)
        if held is None:
            held = spark.createDataFrame([], "file_id long, path string, filename string, modified_time long, created_time long")
        readable = scanned.where("text IS NOT NULL")
        diff = reliable(snapshot_diff(held, readable).where("status <> 'unchanged'"))
        going = diff.where("status <> 'new'")
        if root is not None:
            going = going.where((F.col("status") == "modified") | F.lower("path").startswith(root.lower()))
        old = reliable(held.join(going.select("path"), "path", "left_semi"))
        last = change.notes.get("last_file_id", 0)
        fresh = with_place(diff.where("status = 'new'").select("path"), ["path"], "file_id").withColumn("file_id", F.col("file_id") + last)
        known = old.select("path", "file_id", F.col("created_time").alias("_created"), F.lit(True).alias("_known"))
        ids = fresh.select("path", "file_id", F.lit(None).cast("long").alias("_created"), F.lit(False).alias("_known")).unionByName(known)
        renewed = readable.join(ids, "path").select("file_id", "path", "filename", "modified_time", F.when(F.col("_known"), F.col("_created")).otherwise(F.col("created_time")).alias("created_time"), "text")
        renewed = reliable(renewed)
        change.notes["last_file_id"] = last + diff.where("status = 'new'").count()
        chunks = index_chunks(renewed.select(FILE), renewed.select(F.col("file_id").alias("doc_id"), "text"))
        dead = self._chunks_of(change.base, old.select("file_id"))
        if change.base.parts("files"):
            change.remove("files", old.select("path"))
        change.append("files", renewed.select(FILE))
        self._swap(change, dead, chunks)

    def remove(self, paths: DataFrame) -> Snapshot:
        """Takes files (path) out, in one commit."""

        def make(change: Change) -> None:
            held = self.files(change.base)
            if held is not None:
                old = reliable(held.join(paths.select("path").distinct(), "path", "left_semi"))
                dead = self._chunks_of(change.base, old.select("file_id"))
                change.remove("files", old.select("path"))
                self._swap(change, dead, None)

        return self.store.transact(make)

    def _chunks_of(self, snapshot: Snapshot, files: DataFrame) -> DataFrame | None:
        chunks = self.chunks(snapshot)
        return None if chunks is None else reliable(chunks.select("chunk_id").join(files.select("file_id"), file_of(F.col("chunk_id")) == F.col("file_id"), "left_semi"))

    def _swap(self, change: Change, dead: DataFrame | None, chunks: DataFrame | None) -> None:
        if dead is not None:
            change.remove("chunks", dead)
        if chunks is not None:
            change.append("chunks", chunks)
            chunks = self.store.spark.read.parquet(f"{self.store.root}/{change.tables['chunks'][-1].path}")
        self.keywords.update(change, chunks, dead)
        if self.embed is not None:
            added = None if chunks is None else chunks.select(F.col("chunk_id").alias("vec_id"), self.embed(F.col("text")).alias("embedding"))
            self.vectors.update(change, added, None if dead is None else dead.select(F.col("chunk_id").alias("vec_id")))

    def merge(self) -> Snapshot:
        """Writes the parts that many refreshes have left anew, in one commit."""

        def make(change: Change) -> None:
            change.compact("files", "path")
            change.compact("chunks", "chunk_id")
            self.keywords.merge(change)

        return self.store.transact(make)
