import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from docloom.llm import packing
from docloom.llm.queries import op1_best_fit_packing, vocabulary


def bins(counts, capacity):
    """Sequences of a plan as lists of lengths, checked against the counts."""
    plan = packing.best_plan(counts, capacity)
    used = {}
    for n, lengths in plan.runs:
        assert n > 0 and sum(lengths) <= capacity
        for x in lengths:
            used[x] = used.get(x, 0) + n
    assert used == {k: v for k, v in counts.items() if v}
    return sum(n for n, _ in plan.runs)


def first_fit(counts, capacity):
    open_ = []
    for size in sorted(counts, reverse=True):
        for _ in range(counts[size]):
            at = next((k for k, gap in enumerate(open_) if gap >= size), None)
            if at is None:
                open_.append(capacity - size)
            else:
                open_[at] -= size
    return len(open_)


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(0, 30), max_size=25))
def test_plan_places_every_piece_and_is_tight(counts):
    n = bins(counts, 40)
    total = sum(k * v for k, v in counts.items())
    assert -(-total // 40) <= n <= first_fit(counts, 40) + 1


def test_exact_complements():
    assert bins({60: 5, 40: 5}, 100) == 5
    assert bins({50: 4, 30: 4, 20: 4}, 100) == 4
    assert bins({40: 3, 30: 3, 20: 3, 10: 3}, 100) == 3
    assert bins({100: 2, 50: 3}, 100) == 4


def test_places_are_gapless():
    plan = packing.best_plan({60: 5, 40: 7, 3: 100}, 100)
    seen = {}
    for size, (ranks, firsts, offsets) in plan.places().items():
        total = {60: 5, 40: 7, 3: 100}[size]
        ends = np.append(ranks[1:], total)
        for r, e, f, o in zip(ranks, ends, firsts, offsets, strict=True):
            for k in range(e - r):
                seen.setdefault(f + k, []).append((o, size))
    for items in seen.values():
        at = 0
        for o, size in sorted(items):
            assert o == at
            at += size
        assert at <= 100


ODD = [
    "it's IT'S don'T 'Sx ''s", "a<|endoftext|>b", "İstanbul ΑΣ ΟΔΟΣ.", "éà x y\x85z\x1cq\tw", "½²³ 12a3 _-_ __a", "", " \n ", "日本語 text ﷽", "ſ K Å ß ẞ",
    "a\xadb \x00c", "ʼn ǅ ǰ \U0001d400", "e\u0301 n\u0303 \u0301", "word\u2028line\u3000wide",
]


LATIN = st.text(st.characters(max_codepoint=0x2FF, exclude_categories=["Cs"]))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.text(), LATIN), max_size=8))
def test_encoder_equals_the_tokenizer(texts):
    path = vocabulary("word_bpe_49k.json")
    plain = Tokenizer.from_file(path)
    for text, ids in zip(texts + ODD, packing.encoder(path).encode(texts + ODD), strict=True):
        assert np.frombuffer(ids, np.uint32).tolist() == plain.encode(text, add_special_tokens=False).ids


def test_encoder_on_every_latin_code_point():
    path = vocabulary("word_bpe_49k.json")
    plain = Tokenizer.from_file(path)
    for c in map(chr, range(0x300)):
        texts = [c, c + c, f"a{c}b", f"({c})", f"{c}, -{c}-", f"x {c} 1{c}2"]
        for text, ids in zip(texts, packing.encoder(path).encode(texts), strict=True):
            assert np.frombuffer(ids, np.uint32).tolist() == plain.encode(text, add_special_tokens=False).ids, text


def test_letters_that_grow_beyond_the_range_dont_stop_the_job(spark):
    texts = ["(\u023a)", "S\u023aN\u0106O\u0166EN", "\u023a\u023e,", "plain"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    path = vocabulary("word_bpe_49k.json")
    plain = Tokenizer.from_file(path)
    got = {r["doc_id"]: r["ids"] for r in packing.pack(docs, path, keep_ids=True).collect()}
    assert got == {k: [*plain.encode(t, add_special_tokens=False).ids, 1] for k, t in enumerate(texts)}


def test_query_against_brute_force(spark, data):
    got = op1_best_fit_packing(spark, data).collect()
    plain = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    pieces = {}
    for r in got:
        pieces.setdefault(r["doc_id"], []).append(r)
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()
    assert set(pieces) == {d["doc_id"] for d in docs}
    for d in docs:
        ids = np.array(plain.encode(d["text"] or "", add_special_tokens=False).ids + [1], "<u4")
        own = sorted(pieces[d["doc_id"]], key=lambda r: r["piece"])
        cut = [ids[k : k + 4096] for k in range(0, len(ids), 4096)]
        assert [(r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in own] == [
            (k, 4096 * k, len(c), zlib.crc32(c.tobytes())) for k, c in enumerate(cut)
        ]
    held = {}
    for r in got:
        held.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for items in held.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(held) <= -(-sum(r["length"] for r in got) // 4096) * 1.01 + 1


def test_sequences_round_trip(spark):
    docs = spark.createDataFrame([(k, "some words here " * (k % 90 + 1)) for k in range(300)], "doc_id long, text string")
    path = vocabulary("word_bpe_49k.json")
    out = packing.sequences(docs, path, capacity=64).collect()
    assert all(r["n_tokens"] == len(r["input_ids"]) <= 64 for r in out)
    plain = Tokenizer.from_file(path)
    total = sum(len(plain.encode("some words here " * (k % 90 + 1), add_special_tokens=False).ids) + 1 for k in range(300))
    assert sum(r["n_tokens"] for r in out) == total
