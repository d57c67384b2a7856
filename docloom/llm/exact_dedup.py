"""Exact deduplication by Grace hashing.

Records are dealt by a hash of their content; each bucket is read into an
open-addressing table that compares whole contents. A bucket whose distinct
contents exceed the memory budget is split into spill files by further bits of
the hash, again and again, until each part fits.

Every task first folds its own copies (flushing its table when full, nothing is
dropped), so a content that a third of all rows share reaches the shuffle once
per task. The verdicts go back to the rows by a join on the digest; the few
groups that hold more than one row in a thousand (at most a thousand of them,
whatever the input) are broadcast, the others are shuffled.

Defined cases: a null text counts as empty; rows with a null doc_id take part,
null is below every id; if several rows with equal text share the largest
doc_id, `exact_groups` marks each of them as kept and `drop_exact_copies` keeps
one of them; texts of any length are compared whole, one longer than the budget
in a table of its own; an empty table gives an empty result; other columns,
whatever their names, are ignored by `exact_groups` and kept by
`drop_exact_copies`.
"""

from __future__ import annotations

import hashlib
import os
import pickle
import shutil
import tempfile
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.arrowtext import column
from docloom.llm.common import checkpoint, map_arrow

_LOCAL = "sha string, content binary, n long, top long, n_top long"
_GROUP = "sha string, keep_id long, group_size long, n_top long"
_FAN_BITS, _MAX_LEVEL = 4, 12
BROADCAST_GROUPS = 500_000


class ContentTable:
    """Open addressing with linear probing over whole contents.

    Each entry has a digest, a content, a row count, the largest id and how
    many rows have that id. Equal digests with different contents raise.
    """

    def __init__(self):
        self.slots = np.full(1024, -1, np.int64)
        self.entries: list[list] = []
        self.bytes = 0

    def _grow(self) -> None:
        self.slots = np.full(len(self.slots) * 2, -1, np.int64)
        for k, entry in enumerate(self.entries):
            self.slots[self._free(entry[0])] = k

    def _free(self, digest: bytes) -> int:
        at, mask = int.from_bytes(digest[:8], "little") & (len(self.slots) - 1), len(self.slots) - 1
        while self.slots[at] >= 0:
            at = (at + 1) & mask
        return at

    def add(self, digest: bytes, content: bytes, n: int, top: int | None, n_top: int) -> None:
        mask = len(self.slots) - 1
        at = int.from_bytes(digest[:8], "little") & mask
        while (k := self.slots[at]) >= 0:
            entry = self.entries[k]
            if entry[1] == content:
                entry[2] += n
                if top == entry[3]:
                    entry[4] += n_top
                elif entry[3] is None or (top is not None and top > entry[3]):
                    entry[3], entry[4] = top, n_top
                return
            if entry[0] == digest:
                raise ValueError("two contents with one SHA-256 digest")
            at = (at + 1) & mask
        self.slots[at] = len(self.entries)
        self.entries.append([digest, content, n, top, n_top])
        self.bytes += len(content) + 200
        if 2 * len(self.entries) > len(self.slots):
            self._grow()


def grace(records: Iterable[tuple], budget: int, level: int = 0) -> Iterator[list]:
    """Groups (digest, content, n, top, n_top) records; spills what exceeds `budget` bytes of distinct contents."""
    held, folder, files = ContentTable(), None, []
    shift = 64 + _FAN_BITS * level
    spill = lambda r: pickle.dump(tuple(r), files[(int.from_bytes(r[0], "little") >> shift) & (2**_FAN_BITS - 1)])
    try:
        for record in records:
            if folder:
                spill(record)
                continue
            held.add(*record)
            if held.bytes > budget and len(held.entries) > 1 and level < _MAX_LEVEL:
                folder = tempfile.mkdtemp(prefix="grace-")
                files = [open(f"{folder}/{k}", "wb") for k in range(2**_FAN_BITS)]  # noqa: SIM115
                for entry in held.entries:
                    spill(entry)
                held = ContentTable()
        yield from held.entries
        for f in files:
            f.close()
        for k in range(len(files)):
            yield from grace(_spilled(f"{folder}/{k}"), budget, level + 1)
            os.unlink(f"{folder}/{k}")
    finally:
        for f in files:
            f.close()
        if folder:
            shutil.rmtree(folder, ignore_errors=True)


def _spilled(path: str) -> Iterator[tuple]:
    with open(path, "rb") as f:
        while True:
            try:
                yield pickle.load(f)
            except EOFError:
                return


def _digests(batches: Iterable[pa.RecordBatch]):
    """(ids, digests, contents) of each batch; the contents are lower-cased (A-Z only)."""
    for batch in batches:
        contents = [s.encode() for s in column(batch, "text", lower=True).to_pylist()]
        ids = batch.column(batch.schema.get_field_index("doc_id")).to_pylist()
        yield ids, [hashlib.sha256(c).digest() for c in contents], contents


def _fold(budget: int):
    def run(batches):
        def out(table):
            d, c, n, t, m = zip(*table.entries, strict=True)
            return pa.RecordBatch.from_arrays(
                [pa.array([x.hex() for x in d]), pa.array(c, pa.binary()), pa.array(n, pa.int64()), pa.array(t, pa.int64()), pa.array(m, pa.int64())],
                ["sha", "content", "n", "top", "n_top"],
            )

        table = ContentTable()
        for ids, digests, contents in _digests(batches):
            for record in zip(digests, contents, [1] * len(ids), ids, [1] * len(ids), strict=True):
                table.add(*record)
                if table.bytes > budget:
                    yield out(table)
                    table = ContentTable()
        if table.entries:
            yield out(table)

    return run


def _bucket(budget: int):
    def run(batches):
        def records():
            for b in batches:
                for sha, *rest in zip(*(b.column(k).to_pylist() for k in range(5)), strict=True):
                    yield bytes.fromhex(sha), *rest

        rows = []
        for digest, _, n, top, n_top in grace(records(), budget):
            rows.append((digest.hex(), top, n, n_top))
            if len(rows) == 20_000:
                yield _groups(rows)
                rows = []
        if rows:
            yield _groups(rows)

    return run


def _groups(rows: list[tuple]) -> pa.RecordBatch:
    sha, top, n, n_top = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays(
        [pa.array(sha), pa.array(top, pa.int64()), pa.array(n, pa.int64()), pa.array(n_top, pa.int64())],
        ["sha", "keep_id", "group_size", "n_top"],
    )


def _row_digests(batches):
    for b in batches:
        contents = column(b, "text", lower=True)
        sha = [hashlib.sha256(x.as_buffer()).hexdigest() for x in contents.cast(pa.binary())]
        names = [n for n in b.schema.names if n != "text"]
        yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(n)) for n in names), pa.array(sha)], [*names, "sha"])


def content_groups(docs: DataFrame, budget: int = 48 << 20) -> DataFrame:
    """One row per distinct text: sha, keep_id, group_size, n_top (rows that have keep_id).

    budget: bytes of distinct contents that a task holds at once.
    """
    local = map_arrow(docs.select("doc_id", "text"), _fold(budget // 2), _LOCAL)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return map_arrow(local.repartition(parts, "sha"), _bucket(budget), _GROUP)


def _with_groups(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """Joins groups to rows by sha; groups with over a thousandth of all rows (so a thousand at most) by broadcast."""
    groups = checkpoint(groups)
    total = groups.agg(F.sum("group_size")).first()[0] or 0
    large = max(1000, total // 1000)
    hot = groups.where(F.col("group_size") > large)
    names = [F.col("sha").alias("_sha"), *(F.col(c).alias(f"_{c}") for c in ("keep_id", "group_size", "n_top"))]
    marked = rows.join(F.broadcast(hot.select(*names)), F.col("sha") == F.col("_sha"), "left")
    done = marked.where("_sha is not null")
    rest = marked.where("_sha is null").select(*rows.columns)
    cold = groups.where(F.col("group_size") <= large).select(*names)
    return done.union(rest.join(cold, F.col("sha") == F.col("_sha")).select(*done.columns))


def exact_groups(docs: DataFrame, budget: int = 48 << 20) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256, n_top (see the module)."""
    rows = map_arrow(docs.select("doc_id", "text"), _row_digests, "doc_id long, sha string")
    out = _with_groups(rows, content_groups(docs, budget))
    return out.select(
        "doc_id",
        F.col("_keep_id").alias("keep_id"),
        F.col("_group_size").alias("group_size"),
        F.col("doc_id").eqNullSafe(F.col("_keep_id")).alias("kept"),
        F.col("sha").alias("text_sha256"),
        F.col("_n_top").alias("n_top"),
    )


def drop_exact_copies(docs: DataFrame, budget: int = 48 << 20) -> DataFrame:
    """The documents that stay, one of each group of equal texts, with all their columns.

    Texts that occur once stay where they lie; the digests of the others are joined
    to them, broadcast up to BROADCAST_GROUPS. A row is recognised by its id and
    digest; where several rows of a group have the largest id, they are reduced to
    one.
    """
    from docloom.llm.textudf import lower_sha256

    names = [f"_c{k}" for k in range(len(docs.columns))]
    plain = docs.toDF(*names)
    text, doc_id = (names[docs.columns.index(c)] for c in ("text", "doc_id"))
    groups = checkpoint(content_groups(docs, budget))
    tops = groups.where("group_size > 1").select(F.col("sha").alias("_key"), F.col("keep_id").alias("_id"), F.col("n_top").alias("_n"))
    n, most = tops.agg(F.count("*"), F.max("_n")).first()
    if n <= BROADCAST_GROUPS:
        tops = F.broadcast(tops)
    out = plain.withColumn("_sha", lower_sha256(F.col(text))).join(tops, F.col("_sha") == F.col("_key"), "left")
    top = F.col(doc_id).eqNullSafe(F.col("_id"))
    single = out.where(F.col("_key").isNull() | (top & (F.col("_n") == 1))).select(*names)
    if (most or 0) <= 1:
        return single.toDF(*docs.columns)
    several = out.where(F.col("_key").isNotNull() & top & (F.col("_n") > 1)).dropDuplicates(["_key"]).select(*names)
    return single.union(several).toDF(*docs.columns)
