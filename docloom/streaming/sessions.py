"""Sync sessions: messages applied in order, reservations that expire, files that are written to their end.

Messages have the columns session, seq (from 1, one more each), type, filepath, clock
(map of device to counter), checksum and change. The effects of a message on its
file depend on those before it in the session, so both forms run the same steps:
the batch form over sorted rows, the stream with a hold-back buffer per session
that passes messages on in sequence only.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StringType, StructField, StructType

from docloom.streaming.changes import WATERMARK

OWN = "pc"
EFFECT = "session string, seq long, filepath string, type string, reply string, clock map<string,long>, checksum string, present boolean, pending string"
_COLUMNS = [x.split()[0] for x in EFFECT.split(", ")]


class File:
    """What a session knows of a file: clock, cached checksum, whether it is there, and the change that waits for an answer."""

    def __init__(self, clock=None, checksum=None, present=False, pending=None):
        self.clock, self.checksum, self.present, self.pending = dict(clock or {}), checksum, present, pending

    def apply(self, kind: str, clock: dict | None, checksum: str | None, change: str | None) -> str | None:
        """The effect of a message; gives the type of the reply, if there is one."""
        if kind in ("delta", "delete"):
            for device, n in (clock or {}).items():
                self.clock[device] = max(self.clock.get(device, 0), n)
            self.present, self.checksum = kind == "delta", checksum if kind == "delta" else None
            return "ack"
        if kind == "local_change":
            self.pending, self.present = change, change != "deleted"
            return "change_pending"
        if kind == "change_pending":
            return "sync_approved"
        if kind in ("sync_approved", "sync_rejected"):
            change, self.pending = self.pending, None
            if kind == "sync_rejected" or change is None:
                return None
            if change == "deleted" or not self.present:
                return "delete"
            self.clock[OWN] = self.clock.get(OWN, 0) + 1
            return "delta"
        return None  # ack, in_sync and what is not known

    def row(self, session: str, seq: int, filepath: str, kind: str, reply: str | None) -> tuple:
        return session, seq, filepath, kind, reply, dict(self.clock), self.checksum, self.present, self.pending


def _frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=_COLUMNS)
    return out.astype({"seq": "int64", "present": "boolean"})


def in_sequence(messages: DataFrame) -> DataFrame:
    """Messages up to the first gap of their session, each once."""
    w = Window.partitionBy("session").orderBy("seq")
    once = messages.dropDuplicates(["session", "seq"])
    return once.withColumn("_n", F.row_number().over(w)).where(F.col("seq") == F.col("_n")).drop("_n")


def effects(messages: DataFrame) -> DataFrame:
    """What each message does (EFFECT), in the order of its session; messages after a gap wait, repeated ones do nothing.

    A file's messages are run through in order, sorted by Spark; one file's state is held at a time.
    """

    def run(batches):
        now, file = None, File()
        for b in batches:
            out = []
            for m in b.itertuples(index=False):
                if (m.session, m.filepath) != now:
                    now, file = (m.session, m.filepath), File()
                reply = file.apply(m.type, None if m.clock is None else dict(m.clock), m.checksum, m.change)
                out.append(file.row(m.session, m.seq, m.filepath, m.type, reply))
            yield _frame(out)

    rows = in_sequence(messages).select(F.col("session").cast("string").alias("session"), F.col("seq").cast("long").alias("seq"), "type", "filepath", "clock", "checksum", "change")
    return rows.repartition("session", "filepath").sortWithinPartitions("session", "filepath", "seq").mapInPandas(run, EFFECT)


def session_files(found: DataFrame) -> DataFrame:
    """session, filepath, clock, checksum, present, pending after the last of the effects."""
    last = F.max_by(F.struct("clock", "checksum", "present", "pending"), "seq")
    return found.groupBy("session", "filepath").agg(last.alias("s")).select("session", "filepath", "s.*")


class _Session(StatefulProcessor):
    """The next number, messages that came too early, and the files of a session. Maps are held as JSON."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        text = StructType([StructField("json", StringType())])
        self.next = handle.getValueState("next", StructType([StructField("seq", LongType())]))
        self.early = handle.getMapState("early", StructType([StructField("seq", LongType())]), text)
        self.files = handle.getMapState("files", StructType([StructField("filepath", StringType())]), text)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        seq = self.next.get()[0] if self.next.exists() else 1
        new = {}
        for batch in rows:
            for m in batch.itertuples(index=False):
                if m.seq >= seq:
                    new.setdefault(int(m.seq), (m.type, m.filepath, None if m.clock is None else {k: int(v) for k, v in dict(m.clock).items()}, m.checksum, m.change))
        files: dict[str, File] = {}
        out = []
        while seq in new or self.early.containsKey((seq,)):
            message = new.pop(seq, None)
            if self.early.containsKey((seq,)):
                message = json.loads(self.early.getValue((seq,))[0])  # the first that came
                self.early.removeKey((seq,))
            kind, path, clock, checksum, change = message
            if path not in files:
                files[path] = File(*json.loads(self.files.getValue((path,))[0])) if self.files.containsKey((path,)) else File()
            reply = files[path].apply(kind, clock, checksum, change)
            out.append(files[path].row(key[0], seq, path, kind, reply))
            seq += 1
        for path, f in files.items():
            self.files.updateValue((path,), (json.dumps([f.clock, f.checksum, f.present, f.pending]),))
        for at, message in new.items():
            if not self.early.containsKey((at,)):
                self.early.updateValue((at,), (json.dumps(message),))
        self.next.update((seq,))
        yield _frame(out)

    def close(self) -> None:
        pass


def effects_stream(messages: DataFrame) -> DataFrame:
    """As `effects`, of a stream whose messages may come in any order, late or twice; session is a string."""
    grouped = messages.select("session", "seq", "type", "filepath", "clock", "checksum", "change").groupBy("session")
    return grouped.transformWithStateInPandas(_Session(), EFFECT, "Append", "None")


SWEPT = "session string, member string, at timestamp, action string"


def expiries(events: DataFrame, ttl_seconds: int = 300, sweep_seconds: int = 60) -> DataFrame:
    """session, member, at, action: reservations that run out at a sweep (expired), and sessions left empty by it (session_expired).

    Events (session, member, event_type join or leave, ts, event_id). A place is kept
    for the time to live after leaving; sweeps come at whole multiples of their
    interval. A session is gone at the sweep after which it has neither members nor places.
    """
    step, keep = sweep_seconds * 1_000_000, ttl_seconds * 1_000_000
    w = Window.partitionBy("session", "member").orderBy("_at", "event_id")
    rows = events.select("session", "member", "event_type", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("_at"))
    # A second join or leave in a row does nothing, so joins and leaves take turns.
    rows = rows.withColumn("_before", F.lag("event_type").over(w)).where("event_type = 'join' AND coalesce(_before, '') <> 'join' OR event_type = 'leave' AND _before = 'join'")
    sweep = (F.ceil((F.col("_at") + F.lit(keep)) / F.lit(float(step))) * F.lit(step)).cast("long")
    rows = rows.withColumn("_end", F.when(F.col("event_type") == "leave", sweep))
    rows = rows.withColumns({"_next": F.lead("_at").over(w), "_held": F.lag("_end").over(w)})
    gone = rows.where("event_type = 'leave' AND (_next IS NULL OR _next >= _end)")
    expired = gone.select("session", "member", F.timestamp_micros("_end").alias("at"), F.lit("expired").alias("action"))
    # A session is empty after a sweep if all places that were taken before have gone.
    taken = rows.where("event_type = 'join' AND (_held IS NULL OR _at >= _held)").select("session", F.col("_at").alias("t"), F.lit(1).alias("d"))
    moves = taken.union(gone.select("session", F.col("_end").alias("t"), F.lit(-1)))
    level = F.sum("d").over(Window.partitionBy("session").orderBy("t", "d").rowsBetween(Window.unboundedPreceding, 0))
    empty = moves.withColumn("n", level).where("n = 0 AND d = -1")
    return expired.union(empty.select("session", F.lit(None).cast("string"), F.timestamp_micros("t"), F.lit("session_expired")))


class _Swept(StatefulProcessor):
    """A session's places; each sweep at which one runs out is a timer."""

    def __init__(self, ttl_ms: int, sweep_ms: int):
        self.ttl_ms, self.sweep_ms = ttl_ms, sweep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.places = handle.getMapState("places", StructType([StructField("member", StringType())]), StructType([StructField("sweep", LongType())]))

    def _sweep(self, at: int) -> int:
        return -(-(at + self.ttl_ms) // self.sweep_ms) * self.sweep_ms

    def _until(self, session: str, held: dict[str, int], at: int) -> list[tuple]:
        """What the sweeps up to a time find; held: the sweep of each place, -1 for members that are there."""
        out = []
        for sweep in sorted({s for s in held.values() if 0 <= s <= at}):
            for member in sorted(m for m, s in held.items() if s == sweep):
                del held[member]
                out.append((session, member, pd.Timestamp(sweep, unit="ms"), "expired"))
            if not held:
                out.append((session, None, pd.Timestamp(sweep, unit="ms"), "session_expired"))
        return out

    def _keep(self, held: dict[str, int]) -> None:
        self.places.clear()
        for member, sweep in held.items():
            self.places.updateValue((member,), (sweep,))
            if sweep >= 0:
                self.handle.registerTimer(sweep)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        events = pd.concat(list(rows)).sort_values(["ts", "event_id"])
        held = {k[0]: v[0] for k, v in self.places.iterator()} if self.places.exists() else {}
        out = []
        for e in events.itertuples(index=False):
            at = int(pd.Timestamp(e.ts).value // 1_000_000)
            out += self._until(key[0], held, at)
            if e.event_type == "join":
                held[e.member] = -1
            elif held.get(e.member) == -1:
                held[e.member] = self._sweep(at)
        self._keep(held)
        yield pd.DataFrame(out, columns=["session", "member", "at", "action"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = {k[0]: v[0] for k, v in self.places.iterator()} if self.places.exists() else {}
        out = self._until(key[0], held, expiredTimerInfo.getExpiryTimeInMs())
        if out:
            self._keep(held)
        yield pd.DataFrame(out, columns=["session", "member", "at", "action"])

    def close(self) -> None:
        pass


def expiries_stream(events: DataFrame, ttl_seconds: int = 300, sweep_seconds: int = 60, watermark: str = WATERMARK) -> DataFrame:
    """As `expiries`: they come out when the watermark passes their sweep, without any further event of the session."""
    grouped = events.select("session", "member", "event_type", "ts", "event_id").withWatermark("ts", watermark).groupBy("session")
    return grouped.transformWithStateInPandas(_Swept(ttl_seconds * 1000, sweep_seconds * 1000), SWEPT, "Append", "EventTime")


TRANSIENT = (r"(?i)\.(tmp|temp|part|partial|crdownload|download|swp|lock)$", r"^(~\$|\.~|\.#)")  # Fixed values: names of files that are still made
FINISHED = "filepath string, size long, n_changes long"


class _Writing(StatefulProcessor):
    """A file's size and its timer, which moves at each change of the size."""

    def __init__(self, quiet_ms: int, event_time: bool):
        self.quiet_ms, self.event_time = quiet_ms, event_time

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", StructType([StructField("size", LongType()), StructField("n", LongType()), StructField("due", LongType())]))

    def _out(self, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["filepath", "size", "n_changes"]).astype({"size": "int64", "n_changes": "int64"})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        size, n, due = self.last.get() if self.last.exists() else (None, 0, None)
        before, out = due, []
        for e in pd.concat(list(rows)).sort_values(["ts", "event_id"]).itertuples(index=False):
            at = int(pd.Timestamp(e.ts).value // 1_000_000) if self.event_time else timerValues.getCurrentProcessingTimeInMs()
            if due is not None and at >= due:
                out.append((key[0], size, n))
                size, n, due = None, 0, None
            if e.event_type == "deleted":
                size, n, due = None, 0, None
            elif size is None or e.size != size:
                size, n, due = int(e.size), n + 1, at + self.quiet_ms
        if before is not None and before != due:
            self.handle.deleteTimer(before)
        if due is None:
            self.last.clear()
        else:
            self.last.update((size, n, due))
            if due != before:
                self.handle.registerTimer(due)
        yield self._out(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        out = []
        if self.last.exists() and self.last.get()[2] <= expiredTimerInfo.getExpiryTimeInMs():
            size, n, _ = self.last.get()
            out.append((key[0], size, n))
            self.last.clear()
        yield self._out(out)

    def close(self) -> None:
        pass


def finished_files(events: DataFrame, quiet_seconds: float = 2.0, watermark: str | None = None) -> DataFrame:
    """filepath, size, n_changes: one row for a file whose size has not changed for the quiet time; none while it grows or if it goes.

    Events (event_id, ts, filepath, event_type, size). Names of files in the making
    (TRANSIENT) are left out. By default the time is the cluster's, so a file
    whose events stop comes out by itself; with a watermark it is the events' own.
    A change that is no change of size doesn't prolong the wait.
    """
    name = F.element_at(F.split("filepath", r"[\\/]"), -1)
    kept = events.where(~name.rlike(TRANSIENT[0]) & ~name.rlike(TRANSIENT[1])).select("event_id", "ts", "filepath", "event_type", "size")
    rows = kept if watermark is None else kept.withWatermark("ts", watermark)
    mode = "ProcessingTime" if watermark is None else "EventTime"
    return rows.groupBy("filepath").transformWithStateInPandas(_Writing(int(quiet_seconds * 1000), watermark is not None), FINISHED, "Append", mode)
