import pytest
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.functions import vector as V
from docloom.functions.embed import embedder
from docloom.operators import search as S
from docloom.operators.library import Library
from docloom.sources.store import Change, Store

SCHEMA = "path string, filename string, modified_time long, created_time long, text string"


def scan(spark, files):
    return spark.createDataFrame([(p, p.rsplit("/", 1)[1], m, 5, t) for p, (m, t) in files.items()], SCHEMA)


def state(library, snapshot):
    """Path: (times, texts of its chunks); postings and vectors are those of the chunks."""
    files = {r["file_id"]: r for r in library.files(snapshot).collect()}
    chunks = library.chunks(snapshot)
    out = {}
    for r in chunks.withColumn("f", T.file_of(F.col("chunk_id"))).orderBy("chunk_id").collect():
        assert r["f"] == r["file_id"]
        if r["chunk_index"]:
            out.setdefault(files[r["file_id"]]["path"], []).append(r["text"])
    asked = library.store.spark.createDataFrame([(1, "alpha beta"), (2, "notes"), (3, "gamma-delta")], "query_id long, query_text string")
    hits = lambda found: sorted((r["query_id"], r["place"], r["chunk_id"], r["score"]) for r in found.collect())
    assert hits(library.keywords.search(snapshot, asked, 10)) == hits(S.bm25(chunks, asked, 10))
    vectors = chunks.select(F.col("chunk_id").alias("vec_id"), embedder()("text").alias("embedding"))
    queries = asked.select("query_id", embedder()("query_text").alias("query_embedding"))
    assert hits(library.vectors.search(snapshot, queries, 10).withColumnRenamed("vec_id", "chunk_id")) == hits(V.nearest(queries, vectors, 10).withColumnRenamed("vec_id", "chunk_id"))
    return {r["path"]: (r["modified_time"], r["created_time"], out.get(r["path"], [])) for r in files.values()}


def test_refresh_is_one_commit(spark, tmp_path, monkeypatch):
    library = Library(Store(spark, f"file://{tmp_path}/l"), embedder())
    files = {f"/a/notes_{k}.txt": (k, f"alpha {k} gamma-delta") for k in range(6)} | {"/b/long.txt": (1, "beta words " * 150), "/b/broken.pdf": (1, None)}
    first = library.refresh(scan(spark, files))
    want = {p: (m, 5, [t.strip()] if len(t) < 900 else [" ".join(t.split()[:200]), " ".join(t.split()[170:])]) for p, (m, t) in files.items() if t}
    assert state(library, first) == want and first.version == 1
    ids = {r["path"]: r["file_id"] for r in library.files(first).collect()}

    files = {p: x for p, x in files.items() if p not in ("/a/notes_0.txt", "/b/long.txt")}
    files |= {"/a/notes_1.txt": (9, "changed alpha"), "/b/broken.pdf": (2, "read at last"), "/c/new.txt": (3, "beta")}
    stopped = Change._write
    calls = []

    def broken(self, *args, **kwargs):
        calls.append(1)
        if len(calls) == 5:
            raise OSError("stopped")
        return stopped(self, *args, **kwargs)

    monkeypatch.setattr(Change, "_write", broken)
    with pytest.raises(OSError):
        library.refresh(scan(spark, files))
    monkeypatch.setattr(Change, "_write", stopped)
    assert library.store.at().version == 1 and state(library, library.store.at()) == want

    second = library.refresh(scan(spark, files), "/a")  # what was not scanned goes under /a only
    want = {p: x for p, x in want.items() if p != "/a/notes_0.txt"} | {"/a/notes_1.txt": (9, 5, ["changed alpha"]), "/b/broken.pdf": (2, 5, ["read at last"]), "/c/new.txt": (3, 5, ["beta"])}
    assert state(library, second) == want
    now = {r["path"]: r["file_id"] for r in library.files(second).collect()}
    assert all(now[p] == ids[p] for p in now if p in ids) and len(set(now.values())) == len(now)
    merged = library.merge()
    assert state(library, merged) == want and len(merged.tables["chunks"]) == 1
    third = library.remove(spark.createDataFrame([("/c/new.txt",), ("/none",)], "path string"))
    assert state(library, third) == {p: x for p, x in want.items() if p != "/c/new.txt"}
