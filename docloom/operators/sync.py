"""Reconciling two replicas: trees, blocks, vector clocks and what to do about them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PACKET = 50  # blocks in a message


def tree_root(tree: DataFrame, *keys: str) -> DataFrame:
    """keys, root: MD5 of path:checksum of all files in the binary order of their paths."""
    held = F.array_sort(F.collect_list(F.struct("filepath", "checksum")))
    text = F.array_join(F.transform(held, lambda x: F.concat_ws(":", x["filepath"], x["checksum"])), "")
    return tree.groupBy(*keys).agg(F.md5(text).alias("root"), F.count("*").alias("n_files"))


def tree_diff(local: DataFrame, remote: DataFrame) -> DataFrame:
    """filepath, change (deleted: local only, added: remote only, modified), side; equal files are left out."""
    a = local.where("filepath <> '__root__'").select("filepath", F.col("checksum").alias("a"))
    b = remote.where("filepath <> '__root__'").select("filepath", F.col("checksum").alias("b"))
    change = F.when(F.col("b").isNull(), "deleted").when(F.col("a").isNull(), "added").otherwise("modified")
    side = F.when(F.col("b").isNull(), "local_only").when(F.col("a").isNull(), "remote_only").otherwise("both")
    return a.join(b, "filepath", "full_outer").where(~F.col("a").eqNullSafe(F.col("b"))).select("filepath", change.alias("change"), side.alias("side"))


def changed_blocks(local: DataFrame, remote: DataFrame) -> DataFrame:
    """Local blocks (filepath, block, block_hash, data) that the other side lacks or has otherwise."""
    return local.join(remote.select("filepath", "block", "block_hash"), ["filepath", "block", "block_hash"], "left_anti")


def packets(blocks: DataFrame, size: int = PACKET) -> DataFrame:
    """filepath, n_blocks, n_packets: one message at least."""
    counted = blocks.groupBy("filepath").agg(F.count("*").alias("n_blocks"))
    return counted.withColumn("n_packets", F.greatest(F.lit(1), F.ceil(F.col("n_blocks") / F.lit(float(size)))).cast("long"))


def apply_delta(local: DataFrame, delta: DataFrame, sizes: DataFrame) -> DataFrame:
    """filepath, content: local blocks with those of the delta in place, cut to the new size (filepath, size).

    A file that only shrinks is cut as well.
    """
    a = local.select("filepath", "block", F.col("data").alias("old"))
    b = delta.select("filepath", "block", F.col("data").alias("new"))
    both = a.join(b, ["filepath", "block"], "full_outer").select("filepath", "block", F.coalesce("new", "old").alias("data"))
    held = F.array_sort(F.collect_list(F.struct("block", F.decode("data", "ISO-8859-1").alias("s"))))
    whole = both.groupBy("filepath").agg(F.array_join(F.transform(held, lambda x: x["s"]), "").alias("s"))
    return whole.join(sizes, "filepath").select("filepath", F.encode(F.expr("substring(s, 1, cast(size as int))"), "ISO-8859-1").alias("content"))


def clock_maps(rows: DataFrame) -> DataFrame:
    """filepath, local, remote: clocks (filepath, side, device, counter) as maps; a side without rows is empty."""
    side = lambda s: F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("side") == s, F.struct("device", "counter")))))
    return rows.groupBy("filepath").agg(side("local").alias("local"), side("remote").alias("remote"))


def tick(clock: Column, device: str) -> Column:
    now = F.coalesce(F.try_element_at(clock, F.lit(device)), F.lit(0).cast("long"))
    return F.map_concat(F.map_filter(clock, lambda k, v: k != device), F.create_map(F.lit(device), now + 1))


def merge_clocks(a: Column, b: Column) -> Column:
    return F.map_zip_with(a, b, lambda k, x, y: F.greatest(F.coalesce(x, F.lit(0)), F.coalesce(y, F.lit(0))))


def compare_clocks(a: Column, b: Column) -> Column:
    """local_wins, remote_wins, identical or conflict; a missing device counts 0."""
    ahead = F.map_zip_with(a, b, lambda k, x, y: F.coalesce(x, F.lit(0)) > F.coalesce(y, F.lit(0)))
    behind = F.map_zip_with(a, b, lambda k, x, y: F.coalesce(x, F.lit(0)) < F.coalesce(y, F.lit(0)))
    up, down = (F.exists(F.map_values(m), lambda v: v) for m in (ahead, behind))
    return F.when(up & down, "conflict").when(up, "local_wins").when(down, "remote_wins").otherwise("identical")


def resolve(change: Column, verdict: Column, present: Column | None = None) -> Column:
    """The action for a changed file; present: whether the local file is still there."""
    there = present if present is not None else F.lit(True)
    newer = verdict.isin("local_wins", "identical")
    sent = F.when(there, "send_delta").otherwise(F.when(change == "modified", "send_delete").otherwise("none"))
    return (
        F.when(verdict == "conflict", "conflict")
        .when((change == "deleted") & (verdict == "remote_wins"), "delete_local")
        .when(change == "deleted", sent)
        .when((change == "added") & (verdict == "local_wins"), "send_delete")
        .when(change == "added", "request_delta")
        .when(newer, sent)
        .otherwise("request_delta")
    )


def push_or_pull(change: Column, verdict: Column) -> Column:
    """The desktop engine's rule: clocks decide for changed files only."""
    return F.when(change == "added", "request_delta").when(change == "deleted", "send_delta").otherwise(resolve(change, verdict))


def stale(cache: DataFrame, current: DataFrame) -> DataFrame:
    """Cached rows of files that are gone."""
    return cache.join(current.select("filepath"), "filepath", "left_anti")


def backoff(attempt: Column) -> Column:
    """Milliseconds before a reconnect."""
    return F.least(F.lit(500) * F.pow(F.lit(2.0), attempt - 1), F.lit(30000.0)).cast("long")


def answer_all(pending: DataFrame, approve: bool) -> tuple[DataFrame, DataFrame]:
    """The messages (type, filepath) that answer every pending change alike, and the queue after it."""
    kind = "sync_approved" if approve else "sync_rejected"
    return pending.select(F.lit(kind).alias("type"), "filepath"), pending.limit(0)


def answer(pending: DataFrame, answers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The messages (type, filepath) for answered changes (filepath, approved), and the queue without them."""
    given = answers.groupBy("filepath").agg(F.max_by("approved", "answered_at").alias("approved"))
    kind = F.when(F.col("approved"), "sync_approved").otherwise("sync_rejected")
    return given.select(kind.alias("type"), "filepath"), pending.join(given, "filepath", "left_anti")


def status(pending: DataFrame, connections: DataFrame) -> DataFrame:
    """One row: pending_changes, and connected_devices, those whose last event (device, event_type, ts, event_id) is not a disconnect."""
    last = connections.groupBy("device").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("last"))
    connected = last.agg(F.count_if(F.col("last") != "disconnect").alias("connected_devices"))
    return pending.agg(F.count("*").alias("pending_changes")).join(F.broadcast(connected))
