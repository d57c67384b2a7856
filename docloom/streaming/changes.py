"""Streaming forms of the change-event operators.

Input streams have the columns event_id, ts (timestamp), filepath, event_type and
checksum. Steps in event time have a watermark (WATERMARK behind the latest
event); states that hold a key's last value have a time to live, counted from
their last change (KEPT or a parameter). So state is bounded by the keys in use,
not by the history. A file that comes back after that time counts as changed; its
clock, a number a file, goes on where it was, as other devices compare it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType, TimestampType

WATERMARK = "10 minutes"
KEPT = 30 * 24 * 3600 * 1000  # milliseconds

EVENTS = StructType(
    [
        StructField("event_id", LongType()), StructField("ts", TimestampType()), StructField("filepath", StringType()),
        StructField("event_type", StringType()), StructField("checksum", StringType()),
    ]
)


def read_events(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    """A stream over Parquet files of events that are added to a folder."""
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def visible(events: DataFrame) -> DataFrame:
    """Without hidden and temporary files, and events of folders."""
    name = F.element_at(F.split("filepath", r"[\\/]"), -1)
    return events.where(~name.startswith(".") & ~F.lower(name).endswith(".tmp"))


def debounce(events: DataFrame, gap: str = "500 milliseconds", watermark: str = WATERMARK) -> DataFrame:
    """filepath, last_ts, event_type, n_events per quiet period; the last event wins."""
    last = F.struct("ts", "event_id")
    grouped = events.withWatermark("ts", watermark).groupBy("filepath", F.session_window("ts", gap).alias("w"))
    found = grouped.agg(F.max("ts").alias("last_ts"), F.max_by("event_type", last).alias("event_type"), F.count("*").alias("n_events"))
    return found.drop("w")


def distinct_events(events: DataFrame, *keys: str, watermark: str = WATERMARK) -> DataFrame:
    """One event of each key within the watermark."""
    return events.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(list(keys))


def event_counts(events: DataFrame, width: str = "1 day", watermark: str = WATERMARK) -> DataFrame:
    grouped = events.withWatermark("ts", watermark).groupBy(F.window("ts", width).alias("w"), "event_type")
    return grouped.agg(F.count("*").alias("n")).select(F.col("w.start").alias("day"), "event_type", "n")


class _Checksums(StatefulProcessor):
    """Holds each file's last checksum, which counts for the time to live, and its clock, which never starts again; passes events that change the checksum."""

    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", StructType([StructField("checksum", StringType()), StructField("tick", LongType()), StructField("at", LongType())]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        events = pd.concat(list(rows)).sort_values(["ts", "event_id"])
        now = timerValues.getCurrentProcessingTimeInMs()
        checksum, tick, at = self.last.get() if self.last.exists() else (None, 0, 0)
        known, out = tick > 0 and now - at <= self.ttl_ms, []
        for e in events.itertuples(index=False):
            if not known or e.checksum != checksum:
                known, checksum, tick = True, e.checksum, tick + 1
                out.append((e.event_id, key[0], e.event_type, tick))
        self.last.update((checksum, tick, now))
        yield pd.DataFrame(out, columns=["event_id", "filepath", "event_type", "tick"])

    def close(self) -> None:
        pass


_TICKED = StructType([StructField("event_id", LongType()), StructField("filepath", StringType()), StructField("event_type", StringType()), StructField("tick", LongType())])


def real_changes(events: DataFrame, ttl_ms: int = KEPT) -> DataFrame:
    """event_id, filepath, event_type, tick of events that change a file's checksum."""
    return events.groupBy("filepath").transformWithStateInPandas(_Checksums(ttl_ms), _TICKED, "Update", "ProcessingTime")


class _Pending(StatefulProcessor):
    """Each file's open change: a later event replaces it, approve and reject close it, and so does the time to live."""

    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        kind = StructType([StructField("event_type", StringType()), StructField("at", LongType())])
        self.open = handle.getValueState("open", kind)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        events = pd.concat(list(rows)).sort_values(["ts", "event_id"])
        out = []
        for e in events.itertuples(index=False):
            at = int(pd.Timestamp(e.ts).value // 1_000_000)
            held = self.open.get() if self.open.exists() else None
            if e.event_type in ("approve", "reject"):
                if held:
                    out.append((key[0], held[0], "approved" if e.event_type == "approve" else "rejected"))
                    self.open.clear()
                continue
            new = held is None or at - held[1] > self.ttl_ms
            out.append((key[0], e.event_type, "notified" if new else "replaced"))
            self.open.update((e.event_type, at))
        if self.open.exists():
            self.handle.registerTimer(self.open.get()[1] + self.ttl_ms)
        yield pd.DataFrame(out, columns=["filepath", "event_type", "action"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = self.open.get() if self.open.exists() else None
        rows = []
        if held and held[1] + self.ttl_ms <= expiredTimerInfo.getExpiryTimeInMs():
            rows = [(key[0], held[0], "expired")]
            self.open.clear()
        yield pd.DataFrame(rows, columns=["filepath", "event_type", "action"])

    def close(self) -> None:
        pass


def pending(events: DataFrame, ttl_ms: int = 30_000, watermark: str = WATERMARK) -> DataFrame:
    """filepath, event_type, action (notified, replaced, approved, rejected, expired) as the queue changes."""
    kind = StructType([StructField(n, StringType()) for n in ("filepath", "event_type", "action")])
    grouped = events.withWatermark("ts", watermark).groupBy("filepath")
    return grouped.transformWithStateInPandas(_Pending(ttl_ms), kind, "Append", "EventTime")


class _Limiter(StatefulProcessor):
    """The times of the accepted attempts in the last window; at most `most` are held."""

    def __init__(self, window_us: int, most: int, ttl_ms: int):
        self.window_us, self.most, self.ttl_ms = window_us, most, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.times = handle.getListState("times", StructType([StructField("at", LongType())]), self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        events = pd.concat(list(rows)).sort_values(["ts", "event_id"])
        held = [t[0] for t in self.times.get()] if self.times.exists() else []
        out = []
        for e in events.itertuples(index=False):
            at = int(pd.Timestamp(e.ts).value // 1000)
            held = [t for t in held if t > at - self.window_us]
            ok = len(held) < self.most
            if ok:
                held.append(at)
            out.append((key[0], e.event_id, ok))
        if held:
            self.times.put([(t,) for t in held])
        else:
            self.times.clear()
        yield pd.DataFrame(out, columns=["key", "event_id", "allowed"])

    def close(self) -> None:
        pass


def limited(events: DataFrame, key: str, window_seconds: int = 60, most: int = 10, ttl_ms: int | None = None) -> DataFrame:
    """key, event_id, allowed: a sliding-window limit that only accepted attempts count against.

    ttl_ms: how long a key's attempts are held after the last one, an hour more
    than the window if not given, as events may arrive late.
    """
    ttl_ms = ttl_ms or window_seconds * 1000 + 3_600_000
    kind = StructType([StructField("key", StringType()), StructField("event_id", LongType()), StructField("allowed", BooleanType())])
    rows = events.withColumn("_k", F.col(key).cast("string"))
    return rows.groupBy("_k").transformWithStateInPandas(_Limiter(window_seconds * 1_000_000, most, ttl_ms), kind, "Append", "ProcessingTime")


class _Members(StatefulProcessor):
    """A session's members: joins are refused when it is full, and a place is kept for a while after leaving."""

    def __init__(self, most: int, ttl_ms: int, kept_ms: int):
        self.most, self.ttl_ms, self.kept_ms = most, ttl_ms, kept_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        kind = StructType([StructField("left_at", LongType())])
        self.places = handle.getMapState("places", StructType([StructField("member", StringType())]), kind, self.kept_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        events = pd.concat(list(rows)).sort_values(["ts", "event_id"])
        held = {k[0]: v[0] for k, v in self.places.iterator()} if self.places.exists() else {}
        out = []
        for e in events.itertuples(index=False):
            at = int(pd.Timestamp(e.ts).value // 1_000_000)
            held = {m: t for m, t in held.items() if t < 0 or at - t <= self.ttl_ms}
            if e.event_type == "leave":
                if e.member in held:
                    held[e.member] = at
                continue
            back = e.member in held
            ok = back or len(held) < self.most
            if ok:
                held[e.member] = -1
            out.append((key[0], e.member, e.event_id, "rejoined" if back else "joined" if ok else "refused"))
        self.places.clear()
        for m, t in held.items():
            self.places.updateValue((m,), (t,))
        yield pd.DataFrame(out, columns=["session", "member", "event_id", "action"])

    def close(self) -> None:
        pass


def memberships(events: DataFrame, most: int = 10, ttl_ms: int = 300_000, kept_ms: int = 24 * 3600 * 1000) -> DataFrame:
    """session, member, event_id, action for join and leave events (session, member, event_type, ts, event_id).

    ttl_ms: how long a place is kept after leaving; kept_ms: how long a session is
    held after its last event.
    """
    kind = StructType([StructField("session", StringType()), StructField("member", StringType()), StructField("event_id", LongType()), StructField("action", StringType())])
    return events.groupBy("session").transformWithStateInPandas(_Members(most, ttl_ms, kept_ms), kind, "Append", "ProcessingTime")


def snapshot_changes(scans: DataFrame, state_path: str, sink) -> object:
    """Compares each batch of scans (filepath, checksum) with the one before and hands the differences to sink(df, batch).

    The snapshots are a table of their own per batch, so a repeated batch reads the
    same state; those before the last one are removed. The state belongs to the
    stream's checkpoint: batch 0 has none before it.
    """
    from docloom.operators.sync import tree_diff

    def each(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        where = spark._jvm.org.apache.hadoop.fs.Path
        system = where(state_path).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
        batch.select("filepath", "checksum").write.mode("overwrite").parquet(f"{state_path}/{number}")
        now = spark.read.parquet(f"{state_path}/{number}")
        held = [int(s.getPath().getName()) for s in system.listStatus(where(state_path)) if s.getPath().getName().isdigit()]
        before = max((n for n in held if n < number), default=None)
        sink(tree_diff(now, now.limit(0) if before is None else spark.read.parquet(f"{state_path}/{before}")), number)
        for n in held:
            if n > number or (before is not None and n < before):
                system.delete(where(f"{state_path}/{n}"), True)

    return scans.writeStream.foreachBatch(each)
