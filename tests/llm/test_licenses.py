import re

from hypothesis import given, settings
from hypothesis import strategies as st

from docloom.llm import licenses as L
from docloom.llm.queries import op2_license_scan

WORDS = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def brute(text):
    words = WORDS.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    starts, labels = [], set()
    for phrase, label in L.PHRASES.items():
        p = phrase.split()
        for k in range(len(words) - len(p) + 1):
            if words[k : k + len(p)] == p:
                starts.append(k)
                labels.add(label)
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels))


def test_query_against_brute_force(spark, data):
    got = {r["doc_id"]: r for r in op2_license_scan(spark, data).collect()}
    for d in spark.read.parquet(f"{data}/documents.parquet").collect():
        r = got[d["doc_id"]]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == brute(d["text"])
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("the mit license apache version 2 cc by nc permission is hereby zzz".split()), max_size=40))
def test_phrases_anywhere(words):
    text = " ".join(words)
    found = L.Scanner().scan(text)
    assert (found["n_words"], found["n_base"], found["first_word"], found["last_word"], found["base_labels"]) == brute(text)


def longest_suffix(tokens, end, sequences):
    for size in range(end + 1, 0, -1):
        part = tokens[end + 1 - size : end + 1]
        if any(s[k : k + size] == part for s in sequences for k in range(len(s) - size + 1)):
            return size
    return 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 4), min_size=1, max_size=30), st.lists(st.lists(st.integers(1, 4), min_size=1, max_size=12), min_size=1, max_size=4))
def test_matching_statistics(tokens, sequences):
    graph = L.SuffixAutomaton()
    for s in sequences:
        graph.add(s)
    state = length = 0
    for end, t in enumerate(tokens):
        state, length = graph.walk(state, length, t)
        assert length == longest_suffix(tokens, end, sequences)


def test_templates_are_found_with_gaps():
    body = L.TEMPLATES["bsd-3-clause"].replace("disclaimer", "disclaimer (see below)")
    found = L.Scanner().scan("some words before " + body + " and after")
    assert "bsd-3-clause" in found["labels"] and found["base_labels"] == "" and found["score"] > 0.8
    label, first, last, share = found["spans"][0]
    assert first == 3 and share <= 1
    for name, text in L.TEMPLATES.items():
        assert name in L.Scanner().scan(text)["labels"].split(",")
    assert L.Scanner().scan("permission is hereby given to read this")["labels"] == ""


BASE = [
    ("Given out under the MIT License.", 6, 1, 2, 2, "mit"),
    ("Under (the) [MIT] {License}", 4, 1, 0, 0, "mit"),
    ("under the under the mit license and under\nTHE-MIT-license", 11, 2, 2, 7, "mit"),
    ("The MIT License applies to all of this", 8, 0, None, None, ""),
    ("thunder the mit license, under the mit licensed", 8, 0, None, None, ""),
    ("\u00fcnder the mit license under\u00a0the mit license", 7, 0, None, None, ""),
    ("Apache License, Version 2.0; cc by cc-by-NC 4.0", 12, 2, 0, 7, "apache-2,cc-by-nc"),
    ("apache license version 20 ccbync", 5, 0, None, None, ""),
    ("cc by nc under the mit license apache license version 2", 11, 3, 0, 7, "apache-2,cc-by-nc,mit"),
    ("word " * 70_000 + "under the mit license", 70_004, 1, 70_000, 70_000, "mit"),
    ("", 0, 0, None, None, ""),
    (None, 0, 0, None, None, ""),
]


def test_base_columns_as_the_contract_has_them(spark, tmp_path):
    """Phrases and results are written out here, so that they can't change with the code."""
    docs = spark.createDataFrame([(k, x[0]) for k, x in enumerate(BASE)], "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    out = op2_license_scan(spark, str(tmp_path)).orderBy("doc_id")
    assert [tuple(r) for r in out.select("n_words", "n_base", "first_word", "last_word", "base_labels").collect()] == [x[1:] for x in BASE]
    assert {n: t for n, t in out.dtypes if n != "spans"} == {
        "doc_id": "bigint", "n_words": "bigint", "n_base": "bigint", "first_word": "bigint", "last_word": "bigint",
        "base_labels": "string", "labels": "string", "score": "double",
    }
