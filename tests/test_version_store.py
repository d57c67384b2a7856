import threading

from pyspark.sql import functions as F

from docloom.sources.store import CLEANUP, Store
from docloom.sources.version_store import VersionStore


def saved(spark, rows):
    return spark.createDataFrame(rows, "file_id long, content binary, note string")


def listed(versions):
    return sorted((r["file_id"], r["version"], r["reused"], r["note"]) for r in versions.versions().collect())


def test_numbers_and_twins(spark, tmp_path):
    versions = VersionStore(Store(spark, f"file://{tmp_path}/v"))
    versions.save(saved(spark, [(1, b"one", "a"), (2, b"two" * 300_000, "b"), (2, b"", "c")]), "note")
    first = versions.store.at()
    versions.save(saved(spark, [(1, b"new", "d"), (2, b"two" * 300_000, "e"), (3, b"one", "f")]))
    versions.save(saved(spark, [(1, b"one", "g"), (1, b"more", "h"), (1, b"more", "i")]), "note")
    assert listed(versions) == [(1, 1, None, "a"), (1, 2, None, "d"), (1, 3, 1, "g"), (1, 4, None, "h"), (1, 5, 4, "i"), (2, 1, None, "b"), (2, 2, None, "c"), (2, 3, 1, "e"), (3, 1, None, "f")]
    want = {(1, 1): b"one", (1, 2): b"new", (1, 3): b"one", (1, 4): b"more", (1, 5): b"more", (2, 1): b"two" * 300_000, (2, 2): b"", (2, 3): b"two" * 300_000, (3, 1): b"one"}
    contents = {(r["file_id"], r["version"]): bytes(r["content"]) for r in versions.load().collect()}
    assert {k: v for k, v in contents.items() if v} == {k: v for k, v in want.items() if v}
    some = versions.load(spark.createDataFrame([(2, 3), (9, 9)], "file_id long, version int")).collect()
    assert [(r["file_id"], r["version"], len(r["content"])) for r in some] == [(2, 3, 900_000)]
    assert versions.versions(first).count() == 3
    blocks = versions.store.at().read("blocks")
    assert blocks.count() == blocks.select("block_hash").distinct().count()
    assert versions.store.at().read("recipes").select("file_id", "version").distinct().count() <= 6


def test_two_writers_of_one_file_get_different_numbers(spark, tmp_path):
    versions = VersionStore(Store(spark, f"file://{tmp_path}/v"))
    threads = [threading.Thread(target=lambda k=k: versions.save(saved(spark, [(1, f"text {k % 3}".encode(), str(k))]))) for k in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    rows = listed(versions)
    assert [r[1] for r in rows] == [1, 2, 3, 4] and sorted(r[3] for r in rows) == ["0", "1", "2", "3"]
    twins = [r for r in rows if r[2] is not None]
    assert len(twins) == 1 and {twins[0][3], rows[twins[0][2] - 1][3]} == {"0", "3"}


def test_a_save_leaves_no_copy_and_a_load_moves_values_only(spark, tmp_path):
    """Contents lie in blocks alone when a save has ended, and the session is as it was; what is asked of a content is worked out beside its block."""
    versions, before = VersionStore(Store(spark, f"file://{tmp_path}/v")), spark.conf.get(CLEANUP, None)
    versions.save(saved(spark, [(k, b"text %d" % k, "a") for k in range(20)]))
    parts = {p.path for parts in versions.store.at().tables.values() for p in parts}
    assert {f"data/{p.name}" for p in (tmp_path / "v" / "data").iterdir()} == parts
    assert spark.conf.get(CLEANUP, None) == before
    short = versions.load(of=F.octet_length)
    assert "data#" not in "".join(x for x in short._jdf.queryExecution().executedPlan().toString().splitlines(True) if "Exchange" in x or "Join" in x)
    versions.save(saved(spark, [(1, b"two" * 300_000, "b"), (2, b"", "c"), (3, b"text 3", "d")]))
    got = {(r["file_id"], r["version"]): r["content"] for r in versions.load(of=F.octet_length).collect()}
    assert got == {(k, 1): len(b"text %d" % k) for k in range(20)} | {(1, 2): 900_000, (2, 2): 0, (3, 2): 6}
