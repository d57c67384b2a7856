"""Versions of files in a store: numbers given in the commit, contents as shared blocks, twins named instead of stored again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.operators.versions import BLOCK, blocks, rebuild, recipe
from docloom.session import reliable
from docloom.sources.store import Change, Snapshot, Store


PACKED = {"compression": "zstd"}  # of contents and blocks


class VersionStore:
    """The tables versions (file_id, version, hash, reused and what is saved with them), blocks and recipes.

    A save numbers its contents after the last version of their file in the version
    of the store that it changes. If another save is first, it is done again on the
    newer one, so two writers of one file get different numbers. A content that its
    file has had already names that version in `reused`; only the first has a recipe.
    """

    def __init__(self, store: Store):
        self.store = store

    def versions(self, snapshot: Snapshot | None = None) -> DataFrame | None:
        return (snapshot or self.store.at()).read("versions")

    def save(self, contents: DataFrame, order: str | None = None, content: str = "content") -> Snapshot:
        """Adds a version for each row (file_id, content and more); order: the column that numbers several of one file.

        The contents are written down once, compressed, so that every part of the
        commit and a second try see the same rows; that copy goes when the save ends.
        """
        hashed = contents.withColumns({"hash": F.sha2(F.col(content).cast("binary"), 256), "_row": F.monotonically_increasing_id()})
        with self.store.draft(hashed, **PACKED) as held:
            return self.store.transact(lambda change: self._save(change, held, order or "hash", content))

    def _save(self, change: Change, held: DataFrame, order: str, content: str) -> None:
        """Numbers come from the rows without their contents, which are shuffled once, by block."""
        old = self.versions(change.base)
        rows = held.drop(content) if order != content else held
        number = F.row_number().over(Window.partitionBy("file_id").orderBy(order, "hash"))
        if old is None:
            rows = rows.withColumns({"version": number, "_twin": F.lit(None).cast("int")})
        else:
            last = old.groupBy("file_id").agg(F.max("version").alias("_last"))
            twins = old.where("reused IS NULL").select("file_id", "hash", F.col("version").alias("_twin"))
            rows = rows.join(last, "file_id", "left").withColumn("version", F.coalesce("_last", F.lit(0)) + number).drop("_last")
            rows = rows.join(twins, ["file_id", "hash"], "left")
        first = F.coalesce("_twin", F.min("version").over(Window.partitionBy("file_id", "hash")))
        rows = rows.withColumn("reused", F.when(first < F.col("version"), first).cast("int")).withColumn("version", F.col("version").cast("int"))
        rows = reliable(rows.drop("_twin", content))
        longest = held.agg(F.max(F.octet_length(F.col(content).cast("binary")))).first()[0] or 0
        cut = blocks(held.select("_row", content), content)
        new = cut.select("block_hash", "data").dropDuplicates(["block_hash"])
        stored = change.base.read("blocks")
        if stored is not None:
            new = new.join(stored.select("block_hash"), "block_hash", "left_anti")
        change.append("blocks", new, **PACKED)
        recipes = rows.where("reused IS NULL").select("_row", "file_id", "version").join(recipe(cut.drop("data"), "_row"), "_row").drop("_row")
        change.append("recipes", recipes, {"whole": longest <= BLOCK})
        change.append("versions", rows.drop("_row"))

    def load(self, wanted: DataFrame | None = None, snapshot: Snapshot | None = None, of: Callable[[Column], Column] = lambda content: content) -> DataFrame:
        """file_id, version, content; of the wanted (file_id, version) if they are given.

        of: what is wanted of a content, in its place. Where a content is one block it
        is worked out beside the block, so that its value alone is shuffled.
        """
        snapshot = snapshot or self.store.at()
        asked = self.versions(snapshot).select("file_id", "version", F.coalesce("reused", "version").alias("_from"))
        if wanted is not None:
            asked = asked.join(wanted.select("file_id", "version"), ["file_id", "version"], "left_semi")
        recipes = asked.join(snapshot.read("recipes").withColumnRenamed("version", "_from"), ["file_id", "_from"]).drop("_from")
        stored, whole = snapshot.read("blocks"), F.size("recipe") == 1
        one = recipes.where(whole).select("file_id", "version", F.col("recipe")[0].alias("block_hash"))
        found = one.join(stored.select("block_hash", of(F.col("data")).alias("content")), "block_hash").drop("block_hash")
        if all(p.notes.get("whole") for p in snapshot.parts("recipes")):
            return found
        return found.unionByName(rebuild(recipes.where(~whole), stored, "file_id", "version").select("file_id", "version", of(F.col("content")).alias("content")))
