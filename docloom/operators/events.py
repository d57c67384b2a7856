"""Change events in batch form: debouncing, suppression, queues, limits and streaks.

Events have the columns event_id, ts, filepath, event_type and checksum; the
streaming forms are in docloom.streaming.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _micros(c: str = "ts") -> Column:
    return F.unix_micros(F.col(c).cast("timestamp"))


def sessions(events: DataFrame, key: str, gap_seconds: float) -> DataFrame:
    """Adds session: runs of a key's events with less than the gap between neighbours."""
    order = Window.partitionBy(key).orderBy("ts", "event_id")
    before = F.lag(_micros()).over(order)
    new = F.when(before.isNull() | (_micros() - before >= F.lit(int(gap_seconds * 1e6))), 1).otherwise(0)
    return events.withColumn("_new", new).withColumn("session", F.sum("_new").over(order)).drop("_new")


def debounce(events: DataFrame, gap_seconds: float, key: str = "filepath") -> DataFrame:
    """key, last_ts, event_type, n_events: one row per quiet period, the last event wins."""
    last = F.struct("ts", "event_id")
    return (
        sessions(events, key, gap_seconds)
        .groupBy(key, "session")
        .agg(F.max("ts").alias("last_ts"), F.max_by("event_type", last).alias("event_type"), F.count("*").alias("n_events"))
        .drop("session")
    )


def real_changes(events: DataFrame) -> DataFrame:
    """Events whose checksum differs from the file's event before."""
    before = F.lag("checksum").over(Window.partitionBy("filepath").orderBy("ts", "event_id"))
    return events.withColumn("_b", before).where(F.col("_b").isNull() | (F.col("_b") != F.col("checksum"))).drop("_b")


def ticks(events: DataFrame) -> DataFrame:
    """Adds tick: the clock of the file after each accepted change."""
    return real_changes(events).withColumn("tick", F.count("*").over(Window.partitionBy("filepath").orderBy("ts", "event_id")))


def settled_creations(events: DataFrame, grace_seconds: float = 4.0) -> DataFrame:
    """Added files without a deletion (a move away) within the grace period: the next event of the file decides."""
    order = Window.partitionBy("filepath").orderBy("ts", "event_id")
    kind, at = F.lead("event_type").over(order), F.lead(_micros()).over(order)
    rows = events.withColumns({"_k": kind, "_d": at - _micros()})
    moved = (F.col("_k") == "deleted") & (F.col("_d") <= F.lit(int(grace_seconds * 1e6)))
    return rows.where((F.col("event_type") == "added") & ~F.coalesce(moved, F.lit(False))).drop("_k", "_d")


def pending(events: DataFrame) -> DataFrame:
    """filepath, event_type, ts: each file's latest change in the queue."""
    place = F.row_number().over(Window.partitionBy("filepath").orderBy(F.desc("ts"), F.desc("event_id")))
    return events.withColumn("_p", place).where("_p = 1").select("filepath", "event_type", "ts", "event_id")


def notices(events: DataFrame, ttl_seconds: float = 30.0) -> DataFrame:
    """Events that notify: the first of a file, or one more than the time to live after the one before."""
    before = F.lag(_micros()).over(Window.partitionBy("filepath").orderBy("ts", "event_id"))
    return events.withColumn("_b", before).where(F.col("_b").isNull() | (_micros() - F.col("_b") > F.lit(int(ttl_seconds * 1e6)))).drop("_b")


def attempts(events: DataFrame, key: str, window_seconds: int = 60) -> DataFrame:
    """Adds n_recent: the key's events in the window that ends with this one."""
    w = Window.partitionBy(key).orderBy("_s").rangeBetween(-window_seconds, 0)
    return events.withColumn("_s", F.unix_timestamp(F.col("ts").cast("timestamp"))).withColumn("n_recent", F.count("*").over(w)).drop("_s")


def accepted_joins(events: DataFrame, key: str, window_seconds: int = 60, most: int = 10) -> DataFrame:
    """key, event_id, allowed: only accepted attempts count against the limit.

    Each verdict depends on those before, so a key's events are run through in
    order; rows arrive sorted and only the last `most` times are held.
    """

    def run(batches):
        now, held = None, []
        for b in batches:
            out = []
            for k, at in zip(b["k"], b["_m"], strict=True):
                if k != now:
                    now, held = k, []
                while held and held[0] <= at - window_seconds * 1_000_000:
                    held.pop(0)
                ok = len(held) < most
                if ok:
                    held.append(at)
                out.append(ok)
            yield pd.DataFrame({key: b["k"], "event_id": b["event_id"], "allowed": out})

    rows = events.select(F.col(key).alias("k"), "event_id", _micros().alias("_m"))
    ordered = rows.repartition("k").sortWithinPartitions("k", "_m", "event_id")
    kind = rows.schema["k"].dataType.simpleString()
    return ordered.mapInPandas(run, f"{key} {kind}, event_id long, allowed boolean")


def reservations(events: DataFrame, key: str, ttl_seconds: int = 300) -> DataFrame:
    """key, first_ts, last_ts, n_events: memberships that outlive absences shorter than the time to live."""
    return sessions(events, key, ttl_seconds).groupBy(key, "session").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("n_events")).drop("session")


def streaks(samples: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """key, value, length, from and to of runs of equal values: a file is stable after three."""
    w = Window.partitionBy(key).orderBy(order)
    new = F.when(F.lag(value).over(w).eqNullSafe(F.col(value)), 0).otherwise(1)
    runs = samples.withColumn("_n", new).withColumn("_run", F.sum("_n").over(w))
    return runs.groupBy(key, "_run", value).agg(F.count("*").alias("length"), F.min(order).alias("first_at"), F.max(order).alias("last_at")).drop("_run")


def since(files: DataFrame, mark: int, stamp: str = "modified_time") -> DataFrame:
    """Files changed after the last one that was processed."""
    return files.where(F.col(stamp) > mark)


def dedupe(events: DataFrame, *keys: str) -> DataFrame:
    """The first event of each key."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("ts", "event_id"))
    return events.withColumn("_p", place).where("_p = 1").drop("_p")


def ring(rows: DataFrame, group: str | None, order: str, n: int) -> DataFrame:
    """The last n rows, of each group if there is one; n is the size of the buffer."""
    if group is None:
        return rows.orderBy(F.desc(order)).limit(n)
    return rows.withColumn("_p", F.row_number().over(Window.partitionBy(group).orderBy(F.desc(order)))).where(F.col("_p") <= n).drop("_p")


def cached_listing(requests: DataFrame, key: str, ttl_seconds: float = 5.0) -> DataFrame:
    """key, read_ts, served: the reads of a cached listing and the requests each answers, its own included.

    A request reads anew unless the key's last read is younger than the time to
    live; requests in between don't prolong it. Each verdict depends on the reads
    before, so a key's requests are run through in order and only the last read is
    held.
    """

    def run(batches):
        now, read, served = None, None, 0
        for b in batches:
            out = []
            for k, at in zip(b["k"], b["_m"], strict=True):
                if read is not None and k == now and at - read < ttl_seconds * 1e6:
                    served += 1
                    continue
                if read is not None:
                    out.append((now, read, served))
                now, read, served = k, at, 1
            yield pd.DataFrame(out, columns=["k", "_m", "served"])
        if read is not None:
            yield pd.DataFrame([(now, read, served)], columns=["k", "_m", "served"])

    rows = requests.select(F.col(key).alias("k"), "event_id", _micros().alias("_m"))
    ordered = rows.repartition("k").sortWithinPartitions("k", "_m", "event_id")
    kind = rows.schema["k"].dataType.simpleString()
    found = ordered.mapInPandas(run, f"k {kind}, _m long, served long")
    return found.select(F.col("k").alias(key), F.timestamp_micros("_m").cast(requests.schema["ts"].dataType).alias("read_ts"), "served")
