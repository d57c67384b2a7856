import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from docloom.llm import vector_packing
from docloom.llm.queries import op11_vector_packing, vocabulary
from docloom.llm.vector_packing import Example, Packer

PATH = vocabulary("word_bpe_49k.json")


def padding(lengths, tokens):
    return sum(0 if n & (n - 1) == 0 else tokens - n for n in lengths)


def packed(sizes, limits, masks=None):
    """All sequences of a packer that finishes, checked against the limits and the input."""
    out = []
    packer = Packer(limits, out.append)
    for k, n in enumerate(sizes):
        mask = None if masks is None else np.array(masks[k], np.uint8)
        packer.add(Example(k, 0, n, np.arange(n, dtype=np.uint32), mask))
    assert packer.run(finish=True) == []
    seen = {}
    for examples in out:
        demands = [x.demand() for x in examples]
        assert sum(d[0] for d in demands) <= limits[0] and len(examples) <= limits[1] and sum(d[1] for d in demands) <= limits[2]
        for x in examples:
            assert len(x.ids) and x.ids.tolist() == list(range(x.start, x.start + len(x.ids)))
            seen.setdefault(x.doc_id, []).extend(x.ids.tolist())
    assert {k: sorted(v) for k, v in seen.items()} == {k: list(range(n)) for k, n in enumerate(sizes) if n}
    return out


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 300), max_size=40), st.integers(1, 8))
def test_limits_hold_and_nothing_is_padded(sizes, segments):
    out = packed(sizes, (64, segments, 64))
    assert padding([sum(len(x.ids) for x in s) for s in out], 64) == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(0, 1), max_size=90), max_size=30), st.integers(1, 6), st.integers(1, 20))
def test_limits_hold_for_loss_tokens(masks, segments, loss):
    packed([len(m) for m in masks], (32, segments, loss), masks)


def test_whole_examples_come_before_cuts():
    out = packed([40, 24, 50, 14, 32, 32], (64, 8, 64))
    assert len(out) == 3 and sum(map(len, out)) == 6


def test_scarce_loss_tokens_are_spread():
    """Half of the examples bear loss throughout, half nowhere: each sequence takes of both."""
    masks = [[1] * 16] * 8 + [[0] * 16] * 8
    out = packed([16] * 16, (64, 8, 32), masks)
    assert len(out) == 4 and all(sum(len(x.ids) for x in s) == 64 for s in out)


def check_pieces(rows, texts, tokens):
    """Rows (doc_id, start, length, crc, doc_tokens, sequence_id, offset) against the tokenizer; the lengths of the sequences."""
    plain = Tokenizer.from_file(PATH)
    pieces, held = {}, {}
    for r in rows:
        pieces.setdefault(r["doc_id"], []).append(r)
        held.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert set(pieces) == set(texts)
    for key, text in texts.items():
        ids = np.array([*plain.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for r in sorted(pieces[key], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    for items in held.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at and length > 0
            at += length
        assert at <= tokens
    return [sum(n for _, n in items) for items in held.values()]


def test_query_against_the_tokenizer(spark, data):
    rows = op11_vector_packing(spark, data).collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()}
    lengths = check_pieces(rows, texts, 2048)
    assert padding(lengths, 2048) == 0
    assert len(lengths) <= sum(lengths) // 2048 + 11


@pytest.mark.parametrize("parts", [1, 7, 150])
def test_leftovers_of_many_tasks_meet(spark, parts):
    texts = {k: "some words here " * (k % 90) for k in range(300)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(parts)
    lengths = check_pieces(vector_packing.pack_documents(docs, PATH, tokens=64).collect(), texts, 64)
    assert padding(lengths, 64) == 0 and len(lengths) <= sum(lengths) // 64 + 6


def test_windows_bound_the_memory(spark, monkeypatch):
    monkeypatch.setattr(vector_packing, "WINDOW_TOKENS", 500)
    out, texts = [], {k: 30 + 7 * k % 100 for k in range(200)}
    examples = (x for k, n in texts.items() for x in (Example(k, 0, n, np.arange(n, dtype=np.uint32), None), None))
    for batch in vector_packing._packed(examples, (128, 16, 128), 3, 0, True, False):
        out += batch.to_pylist()
    assert sum(r["length"] for r in out) == sum(texts.values())
    assert len({r["sequence_id"] for r in out}) <= sum(texts.values()) // 128 + 7


def test_defined_cases(spark):
    schema = "doc_id long, text string, ids string, part double, loss int"
    rows = [(1, None, "x", 0.5, 1), (2, "", "x", 0.5, 1), (None, "a text without an id", "x", 0.5, 1), (3, "again", None, None, None), (3, "again", None, None, None), (4, "long text " * 4000, "x", 0.5, 1)]
    docs = spark.createDataFrame(rows, schema)
    got = vector_packing.pack_documents(docs, PATH).collect()
    assert [r["length"] for r in got if r["doc_id"] in (1, 2)] == [1, 1]
    assert sum(r["length"] for r in got if r["doc_id"] == 3) == 4 and sum(r["length"] for r in got if r["doc_id"] == 4) == 8001
    assert sum(r["length"] for r in got if r["doc_id"] is None) == 6
    assert vector_packing.pack_documents(docs.limit(0), PATH).collect() == []
    assert padding([sum(r["length"] for r in got if r["sequence_id"] == s) for s in {r["sequence_id"] for r in got}], 2048) == 0
    kept = vector_packing.pack_documents(docs, PATH, keep_ids=True).collect()
    assert all(len(r["ids"]) == 4 * r["length"] for r in kept)


def test_conversations_keep_the_limit_of_loss_tokens(spark, data):
    turns = spark.read.parquet(f"{data}/conversations.parquet")
    rows = vector_packing.pack_conversations(turns, PATH, tokens=512, segments=16, loss=200, keep_ids=True).collect()
    plain = Tokenizer.from_file(PATH)
    whole = {}
    for t in sorted(turns.collect(), key=lambda t: (t["conv_id"], t["turn"])):
        ids = [*plain.encode(t["text"] or "", add_special_tokens=False).ids, 1]
        held = whole.setdefault(t["conv_id"], ([], []))
        held[0].extend(ids)
        held[1].extend([t["role"] == "assistant"] * len(ids))
    sequences, seen = {}, {}
    for r in rows:
        ids, mask = whole[r["doc_id"]]
        to = r["start"] + r["length"]
        assert np.frombuffer(r["ids"], "<u4").tolist() == ids[r["start"] : to]
        assert list(map(bool, r["loss"])) == mask[r["start"] : to]
        seen[r["doc_id"]] = seen.get(r["doc_id"], 0) + r["length"]
        s = sequences.setdefault(r["sequence_id"], [0, 0, 0])
        s[0], s[1], s[2] = s[0] + r["length"], s[1] + 1, s[2] + sum(mask[r["start"] + 1 : to])
    assert seen == {k: len(v[0]) for k, v in whole.items()}
    assert all(a <= 512 and b <= 16 and c <= 200 for a, b, c in sequences.values())
    least = max(sum(s[0] for s in sequences.values()) / 512, sum(s[2] for s in sequences.values()) / 200)
    assert padding([s[0] for s in sequences.values()], 512) == 0
    assert len(sequences) <= 1.6 * least + 10  # sequences that loss tokens close early are cut to powers of two
