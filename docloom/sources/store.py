"""Versioned tables that change together.

A store is a folder with data parts, each written once, and manifests, one per
version, that list the parts of every table. A commit writes its parts first, then
the next manifest under a name of its own, and puts it in place by a move that
fails if that version is there already. So a run that dies between any two writes
leaves the version before, readers hold the version that they opened, and of two
writers one wins; the other gets a Conflict and may try again on the new version.

The move is atomic on local disks (a hard link) and on file systems whose rename
without overwriting is (HDFS and its kin). An object store needs one that offers
this.

A keyed table has parts of rows and parts of keys that are gone: these hide the
rows of all versions before their own. `compact` writes such a table anew as one
part.
"""

from __future__ import annotations

import json
import os
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFESTS, DATA = "_manifests", "data"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Conflict(RuntimeError):
    """Another writer has put this version in place."""


@dataclass(frozen=True)
class Part:
    """Rows (or, if `gone`, keys) that were written once; since: the version that brought them."""

    path: str
    since: int
    gone: bool = False
    notes: dict = field(default_factory=dict)


class Snapshot:
    """One version of all tables."""

    def __init__(self, store: Store, version: int, tables: dict[str, list[Part]], notes: dict):
        self.store, self.version, self.tables, self.notes = store, version, tables, notes

    def parts(self, table: str, gone: bool = False) -> list[Part]:
        return [p for p in self.tables.get(table, []) if p.gone == gone]

    def _read(self, parts: list[Part]) -> DataFrame | None:
        if not parts:
            return None
        return self.store.spark.read.parquet(*[f"{self.store.root}/{p.path}" for p in parts])

    def read(self, table: str, key: str | None = None) -> DataFrame | None:
        """The table's rows, without those whose keys are gone; None if it has no parts."""
        gone = self.parts(table, gone=True)
        if not gone:
            return self._read(self.parts(table))
        since = {}
        for p in self.parts(table):
            since.setdefault(p.since, []).append(p)
        if not since:
            return None
        rows = reduce(DataFrame.unionByName, [self._read(x).withColumn("_since", F.lit(v)) for v, x in since.items()])
        last = reduce(DataFrame.unionByName, [self._read([p]).select(key, F.lit(p.since).alias("_gone")) for p in gone])
        last = last.groupBy(F.col(key).alias("_key")).agg(F.max("_gone").alias("_gone"))
        return rows.join(last, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_since") < F.col("_gone")), "left_anti").drop("_since")


class Change:
    """What a commit adds to a snapshot. Parts are written at once and seen by nobody before the commit."""

    def __init__(self, base: Snapshot):
        self.base, self.store, self.version = base, base.store, base.version + 1
        self.tables = {name: list(parts) for name, parts in base.tables.items()}
        self.notes = dict(base.notes)

    def _write(self, rows: DataFrame, by: str | None = None, **options) -> str:
        path = f"{DATA}/{uuid.uuid4().hex}"
        writer = rows.write.options(**options)
        (writer if by is None else writer.partitionBy(by)).parquet(f"{self.store.root}/{path}")
        return path

    def append(self, table: str, rows: DataFrame, notes: dict | None = None, **options) -> None:
        self.tables.setdefault(table, []).append(Part(self._write(rows, **options), self.version, False, notes or {}))

    def append_by(self, table: str, rows: DataFrame, by: str) -> None:
        """As `append`, with a folder for each value of a column: a scan with a filter on it lists those in use only."""
        self.tables.setdefault(table, []).append(Part(self._write(rows.repartition(by), by), self.version))

    def remove(self, table: str, keys: DataFrame, notes: dict | None = None) -> None:
        """Rows of earlier versions with these keys go."""
        self.tables.setdefault(table, []).append(Part(self._write(keys), self.version, True, notes or {}))

    def upsert(self, table: str, rows: DataFrame, key: str) -> None:
        """Rows take the place of those with their keys."""
        rows = self.store.spark.read.schema(rows.schema).parquet(f"{self.store.root}/{self._write(rows)}")
        if self.tables.get(table):
            self.remove(table, rows.select(key).distinct())
        self.append(table, rows)

    def replace(self, table: str, rows: DataFrame) -> None:
        """The table has these rows only."""
        self.tables[table] = []
        self.append(table, rows)

    def compact(self, table: str, key: str) -> None:
        rows = self.base.read(table, key)
        if rows is not None:
            self.replace(table, rows)


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm, self._conf = spark._jvm, spark._jsparkSession.sessionState().newHadoopConf()
        self._fs = self._path(self.root).getFileSystem(self._conf)

    def _path(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def _names(self, folder: str) -> list[str]:
        path = self._path(f"{self.root}/{folder}")
        return sorted(s.getPath().getName() for s in self._fs.listStatus(path)) if self._fs.exists(path) else []

    def versions(self) -> list[int]:
        return [int(n[:-5]) for n in self._names(MANIFESTS) if n.endswith(".json") and n[:-5].isdigit()]

    def at(self, version: int | None = None) -> Snapshot:
        """A version, the latest if none is given; 0 is the empty one."""
        version = max(self.versions(), default=0) if version is None else version
        if version == 0:
            return Snapshot(self, 0, {}, {})
        stream = self._fs.open(self._path(f"{self.root}/{MANIFESTS}/{version:012d}.json"))
        try:
            held = json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()
        tables = {name: [Part(**p) for p in parts] for name, parts in held["tables"].items()}
        return Snapshot(self, version, tables, held["notes"])

    def commit(self, change: Change) -> Snapshot:
        """Puts a change in place as the version after its base, or raises Conflict."""
        self._fs.mkdirs(self._path(f"{self.root}/{MANIFESTS}"))
        held = {"tables": {name: [vars(p) for p in parts] for name, parts in change.tables.items()}, "notes": change.notes}
        name = f"{self.root}/{MANIFESTS}/{change.version:012d}.json"
        own = f"{self.root}/{MANIFESTS}/.{uuid.uuid4().hex}"
        stream = self._fs.create(self._path(own))
        stream.write(bytearray(json.dumps(held).encode()))
        stream.close()
        try:
            self._move(own, name)
        finally:
            self._fs.delete(self._path(own), False)
        return self.at(change.version)

    def _move(self, own: str, name: str) -> None:
        """own becomes name, or Conflict if name is there."""
        if self._fs.getScheme() == "file":
            local = [self._fs.pathToFile(self._path(x)).getPath() for x in (own, name)]
            try:
                os.link(*local)
            except FileExistsError as e:
                raise Conflict(name) from e
            return
        none = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path(self.root).toUri(), self._conf)
        options = self.spark.sparkContext._gateway.new_array(getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            none.rename(self._path(own), self._path(name), options)
        except Exception as e:
            if self._fs.exists(self._path(name)):
                raise Conflict(name) from e
            raise

    @contextmanager
    def draft(self, rows: DataFrame, **options) -> Iterator[DataFrame]:
        """The rows, written down once for a change that reads them several times; no version lists them, and they go at the end.

        Meanwhile shuffle files go with the job that wrote them, not when the driver
        happens to collect its garbage.
        """
        path, conf = f"{self.root}/{DATA}/{uuid.uuid4().hex}", self.spark.conf
        before = conf.get(CLEANUP, None)
        try:
            conf.set(CLEANUP, "true")
            rows.write.options(**options).parquet(path)
            yield self.spark.read.schema(rows.schema).parquet(path)
        finally:
            if before is None:
                conf.unset(CLEANUP)
            else:
                conf.set(CLEANUP, before)
            self._fs.delete(self._path(path), True)

    def transact(self, make: Callable[[Change], None], tries: int = 10) -> Snapshot:
        """Runs make on a change of the latest version and commits it; after a Conflict again, on the newer one."""
        for k in range(tries):
            change = Change(self.at())
            make(change)
            try:
                return self.commit(change)
            except Conflict:
                if k + 1 == tries:
                    raise
        raise AssertionError

    def vacuum(self, keep: int = 2, older_than: float = 24 * 3600) -> int:
        """Removes all but the last `keep` versions, and data that no version lists; gives the number of removed parts.

        Data younger than `older_than` seconds stay, as a writer may be about to commit them.
        """
        versions = self.versions()
        for v in versions[: -max(1, keep)]:
            self._fs.delete(self._path(f"{self.root}/{MANIFESTS}/{v:012d}.json"), False)
        held = {p.path for v in versions[-max(1, keep) :] for parts in self.at(v).tables.values() for p in parts}
        removed = 0
        for name in self._names(DATA):
            path = self._path(f"{self.root}/{DATA}/{name}")
            if f"{DATA}/{name}" not in held and self._fs.getFileStatus(path).getModificationTime() / 1000 <= time.time() - older_than:
                removed += bool(self._fs.delete(path, True))
        return removed

    def delete(self) -> None:
        """The store goes, with all versions."""
        self._fs.delete(self._path(self.root), True)
