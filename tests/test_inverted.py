import random

import pytest

from docloom.functions import text as T
from docloom.operators import inverted as N
from docloom.operators import search as S
from docloom.sources.store import Store

SCHEMA = "chunk_id long, text string"
WORDS = [f"w{k}" for k in range(40)]


def texts(seed, ids):
    rng = random.Random(seed)
    return {k: " ".join(rng.choices(WORDS, weights=[1 / (j + 1) for j in range(40)], k=rng.randrange(0, 60))).replace("w3 w1", "w3-w1") for k in ids}


def frame(spark, held, parts=5):
    return spark.createDataFrame(list(held.items()), SCHEMA).repartition(parts)


@pytest.fixture(scope="module")
def queries(spark):
    asked = ["w1 w30", "w3-w1", "w2 w2 w39 w3-w1", "nothing", "w0", 'a "quote', "w5-w0-w1 w17", "w20 w21 w22 w23 w24 w25"]
    return spark.createDataFrame(list(enumerate(asked)), "query_id long, query_text string")


def rows(found):
    return sorted((r["query_id"], r["place"], r["chunk_id"], r["score"]) for r in found.collect())


def test_equals_a_search_of_the_texts_after_every_change(spark, queries, tmp_path):
    store, index = Store(spark, f"file://{tmp_path}/i"), N.KeywordIndex()
    assert rows(index.search(store.at(), queries, 10)) == []
    held = texts(1, range(0, 900, 3)) | {100_001: None, 100_002: ""}

    def check(snapshot):
        assert rows(index.search(snapshot, queries, 10)) == rows(S.bm25(frame(spark, held), queries, 10))
        assert index.live(snapshot) == (len(held), sum(len((t or "").replace("-", " ").split()) for t in held.values()))

    first = store.transact(lambda c: index.update(c, frame(spark, held)))
    check(first)
    before = rows(index.search(first, queries, 10))
    new = texts(2, range(1, 300, 3))
    held |= new
    check(store.transact(lambda c: index.update(c, frame(spark, new))))
    changed = texts(3, range(0, 300, 9))
    held |= changed
    removed = [*range(1, 100, 3), 100_002, 777_777]
    held = {k: v for k, v in held.items() if k not in removed}
    check(store.transact(lambda c: index.update(c, frame(spark, changed), spark.createDataFrame([(k,) for k in removed], "chunk_id long"))))
    back = texts(4, range(1, 30, 3))
    held |= back
    check(store.transact(lambda c: index.update(c, frame(spark, back))))
    merged = store.transact(index.merge)
    check(merged)
    assert merged.read("postings_gone") is None and merged.read("postings").select("shard").distinct().count() == 1
    assert rows(index.search(first, queries, 10)) == before  # a reader of the first version is not disturbed
    held = {}
    check(store.transact(lambda c: index.update(c, remove=frame(spark, texts(1, range(1000)) | {100_001: None}))))


def test_skipped_blocks_lose_nothing(spark, tmp_path):
    """Short chunks with rare words among many long ones: few blocks are read, the rows stay the same."""
    held = {k: " ".join([f"common{k % 3}"] + ["filler"] * 300) for k in range(20_000)} | {k: f"common{k % 3} rare" for k in range(3_000, 3_040)}
    store, index = Store(spark, f"file://{tmp_path}/i"), N.KeywordIndex()
    snapshot = store.transact(lambda c: index.update(c, frame(spark, held, 2)))
    asked = spark.createDataFrame([(1, "common1 rare"), (2, "rare")], "query_id long, query_text string")
    assert rows(index.search(snapshot, asked, 5)) == rows(S.bm25(frame(spark, held), asked, 5))
    search = N._Search(index, snapshot, S.Asked(S.asked_phrases(asked).collect(), N.pa.int64()), 5)
    read, there = search.needed().count(), search.own.count()
    assert read < there / 3


def test_scan_is_pruned(spark, tmp_path):
    store, index = Store(spark, f"file://{tmp_path}/i"), N.KeywordIndex("p")
    snapshot = store.transact(lambda c: index.update(c, frame(spark, texts(1, range(100)))))
    search = N._Search(index, snapshot, S.Asked([{"query_id": 1, "asked": [{"phrase": ["w1"], "times": 1}]}], N.pa.int64()), 5)
    plan = search.own.select(*N.HEADING)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(term), EqualTo(term,w1)]" in plan and "places" not in plan.split("ReadSchema")[1]


def test_stemmed_terms(spark, tmp_path):
    held = {1: "Running CAFÉ", 2: "he runs to cafes", 3: "a state-of-the-art café"}
    store, index = Store(spark, f"file://{tmp_path}/i"), N.KeywordIndex("p", T.keyword_terms)
    snapshot = store.transact(lambda c: index.update(c, frame(spark, held)))
    asked = spark.createDataFrame([("a", "run cafe"), ("b", "states-of-the-arts")], "query_id string, query_text string")
    assert rows(index.search(snapshot, asked, 5)) == rows(S.bm25(frame(spark, held), asked, 5, T.keyword_terms))
    assert {r[0] for r in rows(index.search(snapshot, asked, 5))} == {"a", "b"}
