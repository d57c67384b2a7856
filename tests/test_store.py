import threading

import pytest

from docloom.sources.store import Change, Conflict, Store


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, f"file://{tmp_path}/store")


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, text string")


def rows(snapshot, table="t"):
    return sorted(map(tuple, snapshot.read(table, "id").collect()))


def test_tables_change_together(spark, store):
    one = Change(store.at())
    one.append("t", frame(spark, [(1, "a"), (2, "b"), (None, "n")]))
    one.append("u", frame(spark, [(7, "x")]))
    first = store.commit(one)
    two = Change(first)
    two.upsert("t", frame(spark, [(2, "B"), (3, "c")]), "id")
    two.remove("u", frame(spark, [(7, "")]).select("id"))
    two.notes["n"] = 3
    second = store.commit(two)
    assert [tuple(r) for r in second.read("t", "id").orderBy("text").collect()] == [(2, "B"), (1, "a"), (3, "c"), (None, "n")]
    assert rows(second, "u") == [] and second.notes == {"n": 3}
    assert sorted(r["text"] for r in first.read("t", "id").collect()) == ["a", "b", "n"] and rows(first, "u") == [(7, "x")]  # a reader keeps its version
    third = store.transact(lambda c: c.upsert("u", frame(spark, [(7, "again")]), "id"))
    assert rows(third, "u") == [(7, "again")] and third.version == 3
    assert store.at(1).version == 1 and store.at(0).read("t") is None


def test_a_run_that_breaks_off_leaves_the_old_version(spark, store, monkeypatch):
    """The run is stopped before each write and before the manifest is put in place."""
    store.transact(lambda c: c.append("t", frame(spark, [(1, "a")])))

    def run():
        change = Change(store.at())
        change.append("t", frame(spark, [(2, "b")]))
        change.upsert("u", frame(spark, [(3, "c")]), "id")
        change.upsert("t", frame(spark, [(1, "A")]), "id")
        store.commit(change)

    write, move = Change._write, Store._move
    for stop in range(6):
        left = [stop]

        def broken(f, left=left):
            def g(*args, **kwargs):
                if left[0] == 0:
                    raise OSError("stopped")
                left[0] -= 1
                return f(*args, **kwargs)

            return g

        monkeypatch.setattr(Change, "_write", broken(write))
        monkeypatch.setattr(Store, "_move", broken(move))
        with pytest.raises(OSError):
            run()
        assert rows(store.at()) == [(1, "a")] and store.at().read("u") is None
        assert not [n for n in store._names("_manifests") if not n.endswith(".json")]
    monkeypatch.setattr(Change, "_write", write)
    monkeypatch.setattr(Store, "_move", move)
    assert store.vacuum(older_than=0) > 0
    run()
    assert rows(store.at()) == [(1, "A"), (2, "b")]


def test_of_two_writers_one_wins(spark, store):
    base = store.transact(lambda c: c.append("t", frame(spark, [(1, "a")])))
    changes = [Change(base), Change(base)]
    for k, c in enumerate(changes):
        c.upsert("t", frame(spark, [(1, f"w{k}")]), "id")
    store.commit(changes[1])
    with pytest.raises(Conflict):
        store.commit(changes[0])
    assert rows(store.at()) == [(1, "w1")]


def test_writers_side_by_side_lose_nothing(spark, store):
    threads = [threading.Thread(target=lambda k=k: store.transact(lambda c: c.append("t", frame(spark, [(k, "x")])))) for k in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert [r[0] for r in rows(store.at())] == [0, 1, 2, 3] and store.versions() == [1, 2, 3, 4]


def test_compact_and_vacuum(spark, store):
    for k in range(4):
        store.transact(lambda c, k=k: c.upsert("t", frame(spark, [(1, str(k)), (10 + k, "x")]), "id"))
    before = rows(store.at())
    after = store.transact(lambda c: c.compact("t", "id"))
    assert rows(after) == before and len(after.tables["t"]) == 1
    assert store.vacuum(keep=1) == 0  # too young
    assert store.vacuum(keep=1, older_than=0) > 0 and store.versions() == [5]
    assert rows(store.at()) == before
