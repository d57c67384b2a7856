"""Every operator on nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns."""

import pytest
from pyspark.sql import functions as F

from docloom.llm import classifier, exact_dedup, html, licenses, minhash, mixing, packing, quality_rules, unigram, urls
from docloom.llm.queries import vocabulary

LONG = " ".join(f"word{i % 4999}" for i in range(60_000))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, keep_id string, node int, _c0 string, host double, kept string, score int"
ROWS = [
    (1, "The MIT License applies to all of this text here", "en", "a", 10, "x", 1, "y", 0.5, "no", 3),
    (1, "The MIT License applies to all of this text here", "en", "a", 10, "x", 1, "y", 0.5, "no", 3),
    (2, None, "en", "a", None, None, None, None, None, None, None),
    (3, "", None, None, 0, "x", 1, "y", 0.5, "no", 3),
    (None, "text of a row without an id", "en", None, 5, "x", 1, "y", 0.5, "no", 3),
    (4, LONG, "en", "b", len(LONG), "x", 1, "y", 0.5, "no", 3),
    (5, "ÄÖ\u2028 \U0001f600 \x00 tail", "de", "b", 9, "x", 1, "y", 0.5, "no", 3),
    (6, "THE mit license applies to ALL of this text here", "en", "c", 9, "x", 1, "y", 0.5, "no", 3),
]
LABELS = [(1, 1, 0), (4, 1, None), (5, 1, 0), (6, 0, 0), (None, 1, 1), (6, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")


def operators(labels):
    words, pieces = vocabulary("word_bpe_49k.json"), vocabulary("piece_bpe_32k.model")
    return {
        "pack": lambda d: packing.pack(d, words),
        "sequences": lambda d: packing.sequences(d, words),
        "licenses": licenses.scan,
        "exact": exact_dedup.exact_groups,
        "rules": quality_rules.judge,
        "copies": mixing.copies,
        "tokens": lambda d: unigram.count_tokens(d, pieces),
        "near": minhash.near_groups,
        "classify": lambda d: classifier.classify(d, labels),
    }


def stages(labels):
    return {
        "classifier": lambda d: classifier.keep_sampled(d, labels),
        "exact": exact_dedup.drop_exact_copies,
        "near": minhash.drop_near_copies,
        "mix": mixing.mix,
    }


def test_operators_take_any_row(docs, labels):
    for name, run in operators(labels).items():
        out = run(docs).collect()
        if name not in ("pack", "sequences"):
            assert len(out) == len(ROWS), name
        elif name == "pack":
            assert {r["doc_id"] for r in out} == {r[0] for r in ROWS}


def test_operators_take_empty_tables(spark, labels):
    empty = spark.createDataFrame([], SCHEMA)
    for name, run in operators(labels.limit(0)).items():
        assert run(empty).collect() == [], name


def test_stages_keep_the_columns(spark, docs, labels):
    for name, run in stages(labels).items():
        assert run(docs).columns == docs.columns, name
        assert set(map(tuple, run(docs).collect())) <= set(ROWS), name
        assert run(docs.limit(0)).collect() == [], name


def test_exact_defined_cases(docs):
    got = {(r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["n_top"]) for r in exact_dedup.exact_groups(docs).collect()}
    assert (1, 6, 3, False, 1) in got and (6, 6, 3, True, 1) in got
    assert (2, 3, 2, False, 1) in got and (3, 3, 2, True, 1) in got
    assert (None, None, 1, True, 1) in got
    kept = exact_dedup.drop_exact_copies(docs.union(docs)).collect()
    assert sorted(str(r["doc_id"]) for r in kept) == ["3", "4", "5", "6", "None"]


def test_near_defined_cases(spark, docs):
    got = {(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.near_groups(docs).collect()}
    assert (6, 6, 1, False) in got and (1, 6, 1, True) in got
    assert (2, 0, 2, True) in got and (3, 0, 3, True) in got
    assert (None, 3, None, True) in got
    short = spark.createDataFrame([(7, "one two"), (8, "ONE  two"), (9, "one")], "doc_id long, text string")
    assert {(r["doc_id"], r["component_id"]) for r in minhash.near_groups(short).collect()} == {(7, 7), (8, 7), (9, 9)}


def test_pack_defined_cases(docs):
    out = packing.pack(docs, vocabulary("word_bpe_49k.json"))
    empty = out.where("doc_id in (2, 3)").collect()
    assert [r["length"] for r in empty] == [1, 1]
    long = sorted(out.where("doc_id = 4").collect(), key=lambda r: r["piece"])
    assert [r["start"] for r in long] == [4096 * k for k in range(len(long))]
    assert all(r["length"] == 4096 for r in long[:-1])


def test_rules_defined_cases(docs):
    got = {r["doc_id"]: r for r in quality_rules.judge(docs).collect()}
    assert got[2]["n_words"] == 0 and got[2]["base_failed"] and not got[2]["kept"]
    assert got[4]["n_words"] == 60_000 and got[4]["n_repeat_words"] == 60_000


def test_classifier_without_target_keeps_all(docs, labels):
    assert all(r["kept"] for r in classifier.classify(docs, labels.limit(0)).collect())


PAGES = [
    (1, None, None), (2, "no scheme", ""), (2, "no scheme", ""), (None, "HTTP://Example.COM/en/7?x", "plain text without tags"),
    (3, "https://a.example.com/en/71/8/9/10/11/12", "<article><p>" + LONG + "</p><p>cut of"), (4, "x://h", "<p>a &amp; b</p><div"), (5, "https://ÀB.org/es/", "<<< >>> <3"),
]
PAGE_SCHEMA = "page_id long, url string, html string, host int, path string, text string, purity string"


def test_pages_take_any_row(spark):
    pages = spark.createDataFrame([(*p, 1, "p", "t", "u") for p in PAGES], PAGE_SCHEMA)
    found = {r["page_id"]: r for r in html.extract(pages).collect()}
    assert len(html.extract(pages).collect()) == len(PAGES)
    assert found[1]["text"] == "" and found[2]["text"] == ""
    assert found[None]["text"] == "plain text without tags"
    assert found[3]["text"] == f"{LONG} cut of"
    assert found[4]["text"] == "a & b" and found[4]["n_chars"] == 5
    assert found[5]["text"] == "<<< >>> <3"
    judged = {r["page_id"]: r for r in urls.judge(pages).collect()}
    assert (judged[1]["host"], judged[1]["path"], judged[1]["rule"]) == ("", "", None)
    assert (judged[None]["host"], judged[None]["rule"], judged[None]["verdict"]) == ("example.com", "example.com/en/7", "allow")
    assert judged[5]["host"] == "Àb.org" and judged[5]["rule"] == "org/es/"
    empty = pages.limit(0)
    assert html.extract(empty).collect() == [] and urls.judge(empty).collect() == []


def test_labels_of_pages_may_be_null(spark):
    pages = spark.createDataFrame([(1, "https://h.test/a/1", 1), (2, "https://h.test/a/2", None)], "page_id long, url string, bad int")
    assert urls.judge(pages, F.col("bad")).count() == 2
