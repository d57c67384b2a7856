import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from docloom.llm import lexical
from docloom.llm.arrowtext import Words, raw

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def low(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def plain(docs, queries, most):
    """(query, rank, doc_id, score) of all documents, each looked at by itself."""
    held = [(key, Counter(TERM.findall(low(text)))) for key, text in docs]
    held = [(key, c) for key, c in held if c]
    n, total = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for q, text in enumerate(queries):
        terms = set(TERM.findall(low(text)))
        scored = []
        for key, c in held:
            m = 50 + 50 * sum(c.values()) * n // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 20 * m)) for t in terms if c[t])
            if score > 0:
                scored.append((-score, key is None, key or 0))
        out += [(q, k, None if none else key, -s) for k, (s, none, key) in enumerate(sorted(scored)[:most], 1)]
    return out


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 2**62)))
def test_bytes_round_trip(values):
    data, at = lexical.to_bytes(np.array(values, np.int64))
    assert lexical.from_bytes(data).tolist() == values and at[-1] == len(data)


WORD = st.sampled_from(["a", "b", "c", "dd", "EE", "é", "7", "w8"])
TEXT = st.one_of(st.none(), st.lists(WORD, max_size=12).map(" ".join))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.none(), st.integers(0, 30)), TEXT), max_size=40), st.lists(TEXT, min_size=1, max_size=4), st.integers(1, 5), st.integers(1, 9), st.integers(1, 20))
def test_shards_of_any_size_give_the_same_rows(docs, queries, block, shard, most):
    before = lexical.BLOCK, lexical.SHARD_DOCS
    lexical.BLOCK, lexical.SHARD_DOCS = block, shard
    try:
        words = Words(*raw(pa.array([low(q) for q in queries], pa.string())), lexical.TERM)
        known, number = np.unique(words.hashes(), return_inverse=True)
        builder, rows = lexical.Builder(known), []
        for key, text in docs:
            builder.add([key], pa.array([low(text)]))
            if builder.full():
                rows.append(builder.shard())
        rows.append(builder.shard())
        names = [x.split()[0] for x in lexical._SHARD.split(", ")]
        rows = [dict(zip(names, r, strict=True)) for r in rows]
        n, total = sum(r["n_docs"] for r in rows), sum(r["n_words"] for r in rows)
        df = Counter()
        for r in rows:
            df.update(dict(zip(r["terms"].tolist(), r["dfs"].tolist(), strict=True)))
        weights = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) for t in range(len(known))], np.int64)
        got = []
        for q in range(len(queries)):
            best = lexical.Best(most)
            terms = np.unique(number[words.first[q] : words.first[q + 1]]).tolist()
            for r in rows:
                lexical.answer(lexical.Shard(r, weights, n, total), terms, best)
            order = sorted(best.heap, reverse=True)
            got += [(q, k, -x if there else None, score) for k, (score, there, x) in enumerate(order, 1)]
    finally:
        lexical.BLOCK, lexical.SHARD_DOCS = before
    assert got == plain(docs, queries, most)


@pytest.mark.parametrize("parts", [1, 5])
def test_search_against_plain_python(spark, data, parts, monkeypatch):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").repartition(parts)
    queries = spark.read.parquet(f"{data}/benchmark.parquet").select("item_id", "text")
    monkeypatch.setattr(lexical, "SLICE_BYTES", 2000)  # several passes
    asked = queries.collect()
    got = sorted((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in lexical.search(docs, queries, 7).collect())
    want = [(asked[q][0], rank, key, score) for q, rank, key, score in plain(docs.collect(), [x[1] for x in asked], 7)]
    assert got == sorted(want)


def test_defined_cases(spark):
    schema = "doc_id long, text string, query int, rank string, ids double, score string"
    rows = [(3, "the Red fox", 1, "x", 0.5, "y"), (3, "the Red fox", 1, "x", 0.5, "y"), (None, "the red fox", None, None, None, None), (1, "THE RED FOX", 1, "x", 0.5, "y"), (4, None, 1, "x", 0.5, "y"), (5, " ,. ", 1, "x", 0.5, "y"), (6, "other words " * 30_000, 1, "x", 0.5, "y")]
    docs = spark.createDataFrame(rows, schema)
    queries = spark.createDataFrame([("a", "red, red?", 1), ("b", None, 2), ("c", "", 3), ("a", "red", 4), (None, "words fox", 5)], "item_id string, text string, doc_id int")
    got = lexical.search(docs, queries).collect()
    assert [r["doc_id"] for r in sorted((r for r in got if r["item_id"] == "a"), key=lambda r: r["rank"])] == [1, 1, 3, 3, 3, 3, None, None]
    assert {r["item_id"] for r in got} == {"a", None} and sum(r["item_id"] is None for r in got) == 5
    assert got[0].asDict().keys() == {"item_id", "rank", "doc_id", "score"}
    assert lexical.search(docs.limit(0), queries).collect() == [] == lexical.search(docs, queries.limit(0)).collect()
