import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from docloom.operators import events as E
from docloom.plans.fixtures import view
from docloom.streaming import changes as S


@pytest.fixture
def state(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def run(df, name, folder, mode="append"):
    """Runs until all input is read; a stream with states that have a time to live goes on with empty batches, and is stopped after some."""
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(folder / "checkpoint")).trigger(availableNow=True).start()
    end = time.monotonic() + 120
    while not query.awaitTermination(1) and time.monotonic() < end:
        if len(query.recentProgress) > 5 and not any(p.numInputRows for p in query.recentProgress[-3:]):
            query.stop()
    assert query.exception() is None
    return query


@pytest.fixture
def folder(spark, data, tmp_path):
    rows = view(spark, data, "fx_changes").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "filepath", "event_type", "checksum")
    rows.orderBy("ts", "event_id").coalesce(1).write.option("maxRecordsPerFile", 4000).parquet(str(tmp_path / "events"))
    return str(tmp_path / "events")


def test_debounce_equals_the_batch_form(spark, data, folder, tmp_path):
    stream = S.debounce(S.read_events(spark, folder), "2 hours")
    run(stream, "debounced", tmp_path, "complete")
    key = lambda r: (r["filepath"], str(r["last_ts"]), r["event_type"], r["n_events"])
    batch = E.debounce(view(spark, data, "fx_changes"), 7200)
    assert sorted(map(key, spark.table("debounced").collect())) == sorted(map(key, batch.collect()))


def test_real_changes_equal_the_batch_form(spark, data, folder, tmp_path, state):
    run(S.real_changes(S.read_events(spark, folder)), "changed", tmp_path, "update")
    batch = E.ticks(view(spark, data, "fx_changes"))
    assert {(r["event_id"], r["tick"]) for r in spark.table("changed").collect()} == {(r["event_id"], r["tick"]) for r in batch.collect()}


def test_limiter_equals_the_batch_form(spark, data, folder, tmp_path, state):
    run(S.limited(S.read_events(spark, folder), "filepath", 86400, 3), "limited", tmp_path)
    batch = E.accepted_joins(view(spark, data, "fx_changes"), "filepath", 86400, 3)
    assert {(r["event_id"], r["allowed"]) for r in spark.table("limited").collect()} == {(r["event_id"], r["allowed"]) for r in batch.collect()}


def _write(spark, rows, kind, path):
    spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(path)


def test_pending_queue(spark, tmp_path, state):
    t0 = datetime(2024, 1, 1)
    rows = [
        (1, t0, "f", "added", "a"), (2, t0 + timedelta(seconds=5), "f", "modified", "b"), (3, t0 + timedelta(seconds=6), "f", "approve", None),
        (4, t0 + timedelta(seconds=7), "g", "added", "a"), (5, t0 + timedelta(seconds=50), "g", "modified", "b"), (6, t0 + timedelta(seconds=51), "g", "reject", None),
    ]
    path = str(tmp_path / "in")
    _write(spark, rows, S.EVENTS, path)
    run(S.pending(S.read_events(spark, path)), "queue", tmp_path)
    got = sorted(tuple(r) for r in spark.table("queue").collect())
    assert got == sorted([("f", "added", "notified"), ("f", "modified", "replaced"), ("f", "modified", "approved"), ("g", "added", "notified"), ("g", "modified", "notified"), ("g", "modified", "rejected")])


def test_memberships(spark, tmp_path, state):
    t0 = datetime(2024, 1, 1)
    kind = "event_id long, ts timestamp, session string, member string, event_type string"
    rows = [
        (1, t0, "s", "a", "join"), (2, t0, "s", "b", "join"), (3, t0 + timedelta(seconds=1), "s", "c", "join"), (4, t0 + timedelta(seconds=2), "s", "a", "leave"),
        (5, t0 + timedelta(seconds=100), "s", "a", "join"), (6, t0 + timedelta(seconds=110), "s", "a", "leave"), (7, t0 + timedelta(seconds=420), "s", "c", "join"),
    ]
    path = str(tmp_path / "in")
    _write(spark, rows, kind, path)
    run(S.memberships(spark.readStream.schema(kind).parquet(path), most=2), "members", tmp_path)
    got = {r["event_id"]: r["action"] for r in spark.table("members").collect()}
    assert got == {1: "joined", 2: "joined", 3: "refused", 5: "rejoined", 7: "joined"}


def test_duplicates_and_hidden_files(spark, tmp_path, state):
    t0 = datetime(2024, 1, 1)
    rows = [(k, t0, f, "modified", "x") for k, f in enumerate(["a.txt", "a.txt", ".b", "d/c.TMP", "d\\e.txt"])]
    path = str(tmp_path / "in")
    _write(spark, rows, S.EVENTS, path)
    run(S.distinct_events(S.visible(S.read_events(spark, path)), "filepath", "checksum"), "distinct_ones", tmp_path)
    assert {r["filepath"] for r in spark.table("distinct_ones").collect()} == {"a.txt", "d\\e.txt"}
    assert spark.table("distinct_ones").count() == 2


def test_daily_counts(spark, data, folder, tmp_path):
    run(S.event_counts(S.read_events(spark, folder)), "counts", tmp_path, "complete")
    assert spark.table("counts").agg(F.sum("n")).first()[0] == spark.read.parquet(f"{data}/events.parquet").count()


def test_snapshot_polling(spark, tmp_path):
    kind, seen = "filepath string, checksum string", []
    path = str(tmp_path / "in")
    _write(spark, [("a", "1"), ("b", "1")], kind, path)
    scans = spark.readStream.schema(kind).parquet(path)
    sink = lambda df, number: seen.append(sorted((r["filepath"], r["change"]) for r in df.collect()))
    for _ in range(2):
        S.snapshot_changes(scans, str(tmp_path / "state"), sink).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(60)
        _write(spark, [("a", "2"), ("c", "1")], kind, path)
    assert seen[0] == [("a", "deleted"), ("b", "deleted")]
    assert seen[1] == [("a", "modified"), ("b", "added"), ("c", "deleted")]
