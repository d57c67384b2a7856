"""The pipeline from end to end against plain Python, odd rows included."""

import collections
import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from docloom.llm.queries import vocabulary
from tests.llm.test_brute_force import keys_by_hand
from tests.llm.test_dedup import brute

LOWER = {c: c + 32 for c in range(65, 91)}
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def odd(spark, data, tmp_path_factory):
    """The small tables with null, empty, repeated and very long texts, null ids and a column more."""
    folder = str(tmp_path_factory.mktemp("odd"))
    docs = spark.read.parquet(f"{data.replace('0.01', '0.001')}/documents.parquet").withColumn("node", F.lit("x"))
    rng = random.Random(3)
    first = [r["text"] for r in docs.orderBy("doc_id").limit(40).collect() if len(r["text"].split()) > 60]
    long = " ".join(rng.choice(first[0].split()) for _ in range(60_000))
    near = [first[1].split() for _ in range(3)]
    for k, words in enumerate(near):
        words[5 + k] = f"changed{k}"
    rows = [(9001, None), (9002, ""), (9003, " \n "), (9004, long), (9005, first[0].upper()), (9006, first[0]), (9006, first[0]), (None, first[2] + " more"), (None, None)]
    rows += [(9010 + k, " ".join(w)) for k, w in enumerate(near)]
    more = [(i, t, "en", None if i and i % 2 else "src1", len(t or ""), "y") for i, t in rows]
    docs.unionByName(spark.createDataFrame(more, "doc_id long, text string, lang string, source string, n_chars long, node string")).write.parquet(f"{folder}/documents.parquet")
    spark.read.parquet(f"{data.replace('0.01', '0.001')}/labels.parquet").write.parquet(f"{folder}/labels.parquet")
    return folder


def copies_by_hand(docs, weights=(3, 1, 2), share=1.5, cap=2.0, seed=17):
    size = [len(WORD.findall(d["text"] or "")) for d in docs]
    total = collections.Counter()
    for d, n in zip(docs, size, strict=True):
        total[d["source"]] += n
    order = sorted(total, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    left, target = share * sum(total.values()), {}
    while len(target) < len(order):
        free = [s for s in order if s not in target]
        level = left / sum(weight[s] for s in free)
        full = [s for s in free if cap * total[s] <= level * weight[s]]
        for s in full or free:
            target[s] = cap * total[s] if full else level * weight[s]
            left -= target[s]
    out = []
    for d in docs:
        rate = target[d["source"]] / total[d["source"]] if total[d["source"]] else 0.0
        key = f"{seed}|{'null' if d['doc_id'] is None else d['doc_id']}|{hashlib.md5((d['text'] or '').encode()).hexdigest()}"
        draw = int(hashlib.md5(key.encode()).hexdigest()[:8], 16) / 2**32
        out.append(int(rate) + (draw < rate - int(rate)))
    return out


def test_run_against_plain_python(spark, odd):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{odd}/documents.parquet").collect()
    labels = spark.read.parquet(f"{odd}/labels.parquet").collect()
    keys, least = keys_by_hand(docs, labels)
    docs = [d for d, (_, key) in zip(docs, keys, strict=True) if key >= least]
    stay = {}
    for d in docs:
        low = (d["text"] or "").translate(LOWER)
        if low not in stay or (d["doc_id"] is not None and (stay[low]["doc_id"] is None or d["doc_id"] > stay[low]["doc_id"])):
            stay[low] = d
    docs = list(stay.values())
    name = {k: (d["doc_id"] is None, d["doc_id"] or k) for k, d in enumerate(docs)}  # null ids come last
    root = {k: c for k, (_, c) in brute({name[k]: d["text"] for k, d in enumerate(docs)}, 5, 80).items()}
    docs = [d for k, d in enumerate(docs) if root[name[k]] == name[k]]
    expected = collections.Counter()
    tokenizer = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    for d, n in zip(docs, copies_by_hand(docs), strict=True):
        ids = tokenizer.encode(d["text"] or "", add_special_tokens=False).ids + [1]
        for start in range(0, len(ids), 4096):
            expected[d["doc_id"], start, tuple(ids[start : start + 4096])] += n
    got = corpus_pipeline.run(spark, odd).collect()
    assert collections.Counter((r["doc_id"], r["start"], tuple(r["ids"])) for r in got) == +expected
    at = collections.defaultdict(int)
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == at[r["sequence_id"]] and r["length"] == len(r["ids"])
        at[r["sequence_id"]] += r["length"]
    assert max(at.values()) <= 4096


def test_stages_keep_the_columns_and_take_empty_tables(spark, odd):
    docs = spark.read.parquet(f"{odd}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        none = stage(spark, docs.limit(0), odd)
        assert none.count() == 0, name
        if name != corpus_pipeline.STAGES[-1][0]:
            assert none.columns == docs.columns and none.schema["doc_id"].dataType == docs.schema["doc_id"].dataType, name


def test_operators_leave_the_session_alone(spark, odd):
    before = {r["key"]: r["value"] for r in spark.sql("SET").collect()}
    corpus_pipeline.near(spark, spark.read.parquet(f"{odd}/documents.parquet"), odd).count()
    assert {r["key"]: r["value"] for r in spark.sql("SET").collect()} == before
