import random
import time
from datetime import datetime, timedelta

import pytest

from docloom.streaming import changes as C
from docloom.streaming import sessions as S

KIND = "session string, seq long, type string, filepath string, clock map<string,long>, checksum string, change string"
T0 = datetime(2024, 1, 1)


@pytest.fixture(autouse=True)
def state(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def stream(spark, kind, path):
    return spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(path)


def run(df, name, folder, mode="append", **trigger):
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(folder / name)).trigger(**(trigger or {"availableNow": True})).start()
    if not trigger:
        query.awaitTermination(120)
        assert query.exception() is None
    return query


def write(spark, rows, kind, path):
    spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(path)


def messages(n, seed):
    rng = random.Random(seed)
    kinds = ["delta", "delete", "local_change", "change_pending", "sync_approved", "sync_rejected", "ack", "in_sync", "strange"]
    rows = []
    for s in ("a", "b"):
        for seq in range(1, n + 1):
            clock = {d: rng.randrange(9) for d in rng.sample(["pc", "mobile", "tab"], rng.randrange(4))} if rng.random() < 0.9 else None
            rows.append((s, seq, rng.choice(kinds), f"f{rng.randrange(3)}", clock, rng.choice(["x", "y", None]), rng.choice(["modified", "deleted", "added"])))
    return rows


def plain(rows):
    """Each session's messages in order, by a plain loop; (session, seq): what is known of the file then."""
    out, files = {}, {}
    for s, seq, kind, path, clock, checksum, change in sorted(rows, key=lambda r: r[:2]):
        f = files.setdefault((s, path), {"clock": {}, "sum": None, "there": False, "wait": None})
        reply = None
        if kind in ("delta", "delete"):
            f["clock"] = {d: max(f["clock"].get(d, 0), (clock or {}).get(d, 0)) for d in {*f["clock"], *(clock or {})}}
            f["there"], f["sum"], reply = kind == "delta", checksum if kind == "delta" else None, "ack"
        elif kind == "local_change":
            f["wait"], f["there"], reply = change, change != "deleted", "change_pending"
        elif kind == "change_pending":
            reply = "sync_approved"
        elif kind == "sync_rejected":
            f["wait"] = None
        elif kind == "sync_approved" and f["wait"]:
            reply = "delete" if f["wait"] == "deleted" or not f["there"] else "delta"
            if reply == "delta":
                f["clock"] = f["clock"] | {"pc": f["clock"].get("pc", 0) + 1}
            f["wait"] = None
        out[s, seq] = (path, kind, reply, tuple(sorted(f["clock"].items())), f["sum"], f["there"], f["wait"])
    return out


def found(rows):
    out = {(r["session"], r["seq"]): (r["filepath"], r["type"], r["reply"], tuple(sorted(r["clock"].items())), r["checksum"], r["present"], r["pending"]) for r in rows}
    assert len(out) == len(rows)
    return out


def test_effects_in_batch(spark):
    rows = messages(120, 1)
    held = [r for r in rows if r[:2] != ("b", 100)]  # b waits for message 100
    again = [*held, *held[:30]]
    random.Random(2).shuffle(again)
    got = S.effects(spark.createDataFrame(again, KIND).repartition(5))
    want = {k: v for k, v in plain(rows).items() if k[0] == "a" or k[1] < 100}
    assert found(got.collect()) == want
    last = {(r["session"], r["filepath"]): (r["checksum"], r["present"], r["pending"]) for r in S.session_files(got).collect()}
    assert last == {(k[0], v[0]): v[4:] for k, v in sorted(want.items())}


def test_shuffled_stream_equals_the_ordered_one(spark, tmp_path):
    rows = messages(60, 3)
    shuffled = [*rows, *rows[:20]]
    random.Random(4).shuffle(shuffled)
    path = str(tmp_path / "in")
    for k in range(0, len(shuffled), 25):
        write(spark, shuffled[k : k + 25], KIND, path)
    run(S.effects_stream(stream(spark, KIND, path)), "effects_shuffled", tmp_path)
    assert found(spark.table("effects_shuffled").collect()) == plain(rows)


EVENTS = "session string, member string, event_type string, ts timestamp, event_id long"


def visits(seed, n=80):
    rng = random.Random(seed)
    at, rows = T0, []
    for k in range(n):
        at += timedelta(seconds=rng.choice([0, 1, 30, 60, 119, 200, 400]))
        rows.append((rng.choice("st"), rng.choice("abc"), rng.choice(["join", "leave"]), at, k))
    return rows


def swept(rows, ttl=300, sweep=60):
    """A clock that ticks every second."""
    out, held = [], {}
    for at in range(-1, int((rows[-1][3] - T0).total_seconds()) + 2 * ttl + sweep):
        now = T0 + timedelta(seconds=at)
        if at % sweep == 0:
            for s in {k[0] for k in held}:
                gone = [k for k, end in held.items() if k[0] == s and end is not None and at >= end]
                for k in gone:
                    del held[k]
                    out.append((*k, now, "expired"))
                if gone and not any(k[0] == s for k in held):
                    out.append((s, None, now, "session_expired"))
        for s, m, kind, ts, _ in rows:
            if ts == now:
                if kind == "join":
                    held[s, m] = None
                elif held.get((s, m), 0) is None:
                    held[s, m] = at + ttl
    return sorted(out, key=str)


def test_expiries_in_batch(spark):
    for seed in range(4):
        rows = visits(seed)
        got = sorted((tuple(r) for r in S.expiries(spark.createDataFrame(rows, EVENTS)).collect()), key=str)
        assert got == swept(rows) and len(got) > 5


def test_expiries_come_out_without_events_of_the_session(spark, tmp_path):
    rows = visits(9, 40)
    path = str(tmp_path / "in")
    for k in range(0, 40, 10):
        write(spark, rows[k : k + 10], EVENTS, path)
    for hours in (1, 2, 3):  # another session moves the time on
        write(spark, [("other", "x", "join", rows[-1][3] + timedelta(hours=hours), 1000 + hours)], EVENTS, path)
    run(S.expiries_stream(stream(spark, EVENTS, path), watermark="1 minute"), "expired_ones", tmp_path)
    assert sorted((tuple(r) for r in spark.table("expired_ones").collect()), key=str) == swept(rows)


SIZES = "event_id long, ts timestamp, filepath string, event_type string, size long"


def test_finished_files_by_the_time_of_events(spark, tmp_path):
    at = lambda s: T0 + timedelta(seconds=s)
    rows = [
        [(1, at(0), "a.txt", "added", 1), (2, at(1), "a.txt", "modified", 5), (3, at(2), "a.txt", "modified", 5), (4, at(0), "b.tmp", "added", 1), (5, at(0), "gone.txt", "added", 3), (6, at(1), "gone.txt", "deleted", 0)],
        [(7, at(4), "late.txt", "added", 1), (8, at(5), "late.txt", "modified", 2), (9, at(6), "d/~$x.docx", "added", 2)],
        [(10, at(6), "late.txt", "modified", 3), (11, at(30), "other.txt", "added", 1)],
        [(12, at(60), "a.txt", "modified", 9)],
        [(13, at(100), "z.part", "added", 1), (14, at(100), "y.txt", "added", 1)],
        [(15, at(200), "end.txt", "added", 1)],
    ]
    path = str(tmp_path / "in")
    for part in rows:
        write(spark, part, SIZES, path)
    run(S.finished_files(stream(spark, SIZES, path), 2, "1 second"), "finished", tmp_path)
    assert sorted(tuple(r) for r in spark.table("finished").collect()) == [("a.txt", 5, 2), ("a.txt", 9, 1), ("late.txt", 3, 3), ("other.txt", 1, 1), ("y.txt", 1, 1)]


def test_a_file_whose_events_stop_comes_out_by_itself(spark, tmp_path):
    path = str(tmp_path / "in")
    write(spark, [(1, T0, "a.txt", "added", 1), (2, T0, "x.crdownload", "added", 1)], SIZES, path)
    query = run(S.finished_files(stream(spark, SIZES, path), 4), "finished_alone", tmp_path, processingTime="500 milliseconds")
    try:
        end = time.monotonic() + 90
        while time.monotonic() < end and not spark.table("finished_alone").count():
            time.sleep(0.5)
        assert [tuple(r) for r in spark.table("finished_alone").collect()] == [("a.txt", 1, 1)]
    finally:
        query.stop()


def test_clocks_go_on_after_the_time_to_live(spark, tmp_path):
    """The checksum is forgotten between two batches, so the event counts as a change; its clock is the next one."""
    path = str(tmp_path / "in")
    write(spark, [(1, T0, "f", "modified", "a"), (2, T0, "f", "modified", "b")], C.EVENTS, path)
    time.sleep(1.1)  # files are read in the order of their times
    write(spark, [(3, T0 + timedelta(days=60), "f", "modified", "b")], C.EVENTS, path)
    query = run(C.real_changes(C.read_events(spark, path, 1), ttl_ms=1), "ticks", tmp_path, "update", processingTime="200 milliseconds")
    end = time.monotonic() + 60
    while time.monotonic() < end and spark.table("ticks").count() < 3:
        time.sleep(0.3)
    query.stop()
    assert sorted((r["event_id"], r["tick"]) for r in spark.table("ticks").collect()) == [(1, 1), (2, 2), (3, 3)]
