import re
import zlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from docloom.llm import spelling
from docloom.llm.queries import op13_spelling_variants

WORDS = st.sets(st.text("abé", min_size=6, max_size=9), max_size=60)


def near(a, b):
    """Distance exactly one, by looking at every place."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) == len(short) + 1 and any(long[:k] + long[k + 1 :] == short for k in range(len(long)))


def drops(w):
    return {w[:k] + w[k + 1 :] for k in range(len(w))}


def brute(counts, times=5):
    """word: (form, root, n, n_near, form_n), near words by shared deletions, each pair checked."""
    by_key = {}
    for w in counts:
        for key in {w} | drops(w):
            by_key.setdefault(key, set()).add(w)
    found = {w: {v for key in {w} | drops(w) for v in by_key[key] if near(w, v)} for w in counts}
    form = {}
    for w, others in found.items():
        best = min(others, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= times * counts[w] else None
    out = {}
    for w in counts:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = form[w], root, counts[w], len(found[w]), counts[form[w]] if form[w] else None
    return out


@settings(max_examples=300, deadline=None)
@given(WORDS)
def test_automaton_numbers_every_word(words):
    words = sorted(words)
    a = spelling.Automaton(words)
    assert a.count[0] == len(words)
    for k, w in enumerate(words):
        state = number = 0
        for c in w:
            state, skip = a.next[state][c]
            number += skip
        assert a.final[state] and number == k
        reached = {v for h in (0, 3) for s in (len(w), len(w) - 1) for v in a.near(w, h, s)}
        assert {words[v] for v in reached} == {v for v in words if near(w, v) and len(v) <= len(w)}


def test_automaton_is_minimal():
    a = spelling.Automaton(sorted(x + y for x in ("tap", "top", "stop", "step") for y in ("ping", "pings", "ped")))
    live, todo = set(), [0]
    while todo:
        k = todo.pop()
        if k not in live:
            live.add(k)
            todo += [t for t, _ in a.next[k].values()]
    keys = [(a.final[k], *sorted(a.next[k].items())) for k in live]
    assert len(keys) == len(set(keys))


def rows_of(counts, parts):
    out = []
    for w, n in counts.items():
        for side in (0, 1):
            for size, held in ((len(w), True), (len(w) - 1, False)):
                half = w[: size // 2] if side == 0 else w[len(w) - (size - size // 2) :]
                if parts == 1:
                    out.append((side, size, half, 0, held, True, w, n))
                else:
                    out += [(side, size, half, zlib.crc32(w.encode()) % parts, True, False, w, n)] * held
                    out += [(side, size, half, k, False, True, w, n) for k in range(parts)]
    return sorted(out, key=lambda r: (r[:4], not r[4]))


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.text("ab", min_size=6, max_size=9), st.integers(5, 300), max_size=60), st.sampled_from([1, 2, 7]), st.sampled_from([1, 3, 1000]))
def test_buckets_find_each_pair_once(counts, parts, chunk):
    got = {}
    for found in spelling._answered(iter(rows_of(counts, parts)), chunk):
        for w, (n, best, other) in found.items():
            held = got.setdefault(w, [0, 0, ""])
            held[0] += n
            held[1:] = min((-held[1], held[2]), (-best, other)) if held[1] else (-best, other)
            held[1] = -held[1]
    want = {w: [k, *min(((-counts[v], v) for v in counts if near(w, v)))] for w in counts if (k := sum(near(w, v) for v in counts))}
    assert got == {w: [k, -n, v] for w, (k, n, v) in want.items()}


def slipped(docs):
    counts = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{doc_id}:{run}".encode())
            if h % 199 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}


def as_dict(rows):
    out = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in rows}
    assert len(out) == len(rows)
    return out


def test_query_against_brute_force(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()
    want = brute(slipped(docs))
    assert len(want) > 100 and any(v[0] for v in want.values())
    assert as_dict(op13_spelling_variants(spark, data).collect()) == want


@pytest.mark.parametrize("limit", [10, 100_000])
def test_crowded_halves_are_dealt_out(spark, limit):
    """A third of all words share their first half; the forms make chains."""
    counts = {f"prefixes{a}{b}{c}": 5 + 7 * (ord(a) * ord(b) % 13) for a in "abcdef" for b in "abcdef" for c in "abc"}
    counts |= {f"{a}{b}{a}ending{b}": 5 + ord(b) for a in "uvwxyz" for b in "ghijkl"}
    counts |= {"letters": 3125, "lettersx": 625, "letterxx": 125, "lettexxx": 25, "lettxxxx": 5}
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert as_dict(spelling.group_variants(words, limit=limit).collect()) == brute(counts)
    assert brute(counts)["lettxxxx"][1] == "letters"


def test_defined_cases(spark):
    schema = "doc_id long, text string, n int, word double, form string"
    rows = [(1, None, 1, 0.5, "x"), (2, "", 1, 0.5, "x"), (None, "Colour colours " * 5, None, None, None), (3, "COLOUR 12 short", 1, 0.5, "x"), (3, "COLOUR 12 short", 1, 0.5, "x"), (4, "colour " * 30_000, 1, 0.5, "x"), (5, "À×÷niceÿ " * 5 + "a" * 100_000, 1, 0.5, "x")]
    docs = spark.createDataFrame(rows, schema)
    got = as_dict(spelling.variants(docs).collect())
    assert got == {"colour": (None, "colour", 30_007, 1, None), "colours": ("colour", "colour", 5, 1, 30_007), "À×÷niceÿ": (None, "À×÷niceÿ", 5, 0, None)}
    assert spelling.variants(docs.limit(0)).collect() == []
