import difflib
import math
import sqlite3
from datetime import UTC, datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docloom.functions import classify as C
from docloom.functions import dates as D
from docloom.functions import slices
from docloom.functions import text as T
from docloom.functions import vector as V
from docloom.operators import diff as X
from docloom.operators import events as E
from docloom.operators import indexing as I
from docloom.operators import merge as M
from docloom.operators import search as S
from docloom.operators import sync as Y
from docloom.operators import versions as G

NOW = 1735603200  # 2024-12-31


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def at(*ymd, end=False):
    return int(datetime(*ymd, *((23, 59, 59) if end else ()), tzinfo=UTC).timestamp())


@pytest.mark.parametrize(
    ("question", "clean", "low", "high"),
    [
        ("invoices between jan 2024 and march 2024", "invoices", at(2024, 1, 1), at(2024, 3, 31, end=True)),
        ("report from 19th june 2025", "report", at(2025, 6, 19), at(2025, 6, 19, end=True)),
        ("june 19, 2025 notes", "notes", at(2025, 6, 19), at(2025, 6, 19, end=True)),
        ("28 june 2026", "", at(2026, 6, 28), at(2026, 6, 28, end=True)),
        ("before march 2024", "", None, at(2024, 3, 31, end=True)),
        ("after may 2023", "", at(2023, 5, 1), None),
        ("budget 2026-06-28", "budget", at(2026, 6, 28), at(2026, 6, 28, end=True)),
        ("28/06/2026 photos", "photos", at(2026, 6, 28), at(2026, 6, 28, end=True)),
        ("june 28", "", at(2024, 6, 28), at(2024, 6, 28, end=True)),
        ("28th june", "", at(2024, 6, 28), at(2024, 6, 28, end=True)),
        ("files from june", "", at(2024, 6, 1), at(2024, 6, 30, end=True)),
        ("contracts in 2023", "contracts", at(2023, 1, 1), at(2023, 12, 31, end=True)),
        ("yesterday", "", at(2024, 12, 30), at(2024, 12, 30, end=True)),
        ("last week report", "report", at(2024, 12, 24), at(2024, 12, 31, end=True)),
        ("last month", "", at(2024, 12, 1), at(2024, 12, 31, end=True)),
        ("this year", "", at(2024, 1, 1), at(2024, 12, 31, end=True)),
        ("codec list", "codec list", None, None),
        ("", "", None, None),
    ],
)
def test_date_questions(question, clean, low, high):
    assert D.parse_dates(question, NOW) == (clean, low, high)


def test_porter_stems_as_the_keyword_index_does():
    words = (
        "caresses ponies ties caress cats feed agreed plastered bled motoring sing conflated troubled sized hopping tanned falling hissing fizzed "
        "failing filing happy sky relational conditional rational valenci hesitanci digitizer conformabli radicalli differentli vileli analogousli "
        "vietnamization predication operator feudalism decisiveness hopefulness callousness formaliti sensitiviti sensibiliti triplicate formative "
        "formalize electriciti electrical hopeful goodness revival allowance inference airliner gyroscopic adjustable defensible irritant replacement "
        "adjustment dependent adoption homologou communism activate angulariti homologous effective bowdlerize probate rate cease controll roll"
    ).split()
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE t USING fts5(x, tokenize='porter unicode61')")
    db.execute("INSERT INTO t VALUES (?)", (" ".join(words),))
    db.execute("CREATE VIRTUAL TABLE v USING fts5vocab(t, 'instance')")
    stems = [r[0] for r in db.execute("SELECT term FROM v ORDER BY offset")]
    assert [T.porter(w) for w in words] == stems


def test_bm25_equals_the_keyword_index(spark):
    texts = ["the cat sat on the mat", "dogs and cats living together", "the quick brown fox", "cats cats cats", "nothing here at all", "a mat for the fox"]
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE t USING fts5(x, tokenize='porter unicode61')")
    db.executemany("INSERT INTO t(rowid, x) VALUES (?, ?)", list(enumerate(texts)))
    expected = {r[0]: round(-r[1], 4) for r in db.execute("SELECT rowid, rank FROM t WHERE t MATCH '\"cats\" OR \"mat\"'")}
    chunks = spark.createDataFrame(list(enumerate(texts)), "chunk_id long, text string")
    asked = spark.createDataFrame([(1, "cats mat"), (2, 'broken "quote'), (3, "")], "query_id long, query_text string")
    found = S.bm25(chunks, asked, 10, T.keyword_terms).collect()
    assert {r["chunk_id"]: r["score"] for r in found if r["query_id"] == 1} == pytest.approx(expected, abs=2e-4)
    assert {r["query_id"] for r in found} == {1}


def fts5(texts, query, tokenize="unicode61"):
    """Scores of the rows that the keyword index finds for the words of a query."""
    db = sqlite3.connect(":memory:")
    db.execute(f"CREATE VIRTUAL TABLE t USING fts5(x, tokenize='{tokenize}')")
    db.executemany("INSERT INTO t(rowid, x) VALUES (?, ?)", list(enumerate(texts)))
    match = " OR ".join(f'"{w}"' for w in query.split())
    return {r[0]: -r[1] for r in db.execute("SELECT rowid, rank FROM t WHERE t MATCH ?", (match,))}


PHRASE_TEXTS = [
    "foo-bar baz", "foo and bar, foo bar foo bar", "bar foo", "write to ann.lee@mail.example.org today", "ann lee mail", "version 1.2.3 of 2024-05-06", "1 2 3", "1.2 and 3",
    "a a a a", "a b a", "well-known well known", "", None, "the quick brown fox", "O'Neil's state-of-the-art", "state of the art", "foo", "x" * 50, "foo-bar foo-bar-foo",
]


@pytest.mark.parametrize("tokenize", ["unicode61", "porter unicode61"])
def test_phrases_and_repeats_equal_the_keyword_index(spark, tokenize):
    """Hyphens, addresses, numbers with points, overlapping places, repeated words, words without tokens."""
    asked = ["foo-bar", "foo bar", "foo foo", "foo foo-bar foo-bar", "ann.lee@mail.example.org", "1.2.3 2024-05-06", "a-a", "a-a a", "well-known known", "state-of-the-art o'neil's", "- foo", "--", "foo-bar-foo fox", "a\u2003b", "bar-foo\x1cfoo"]
    chunks = spark.createDataFrame(list(enumerate(PHRASE_TEXTS)), "chunk_id long, text string").repartition(3)
    queries = spark.createDataFrame(list(enumerate(asked)), "query_id long, query_text string")
    found = S.bm25(chunks, queries, 30, T.keyword_terms if "porter" in tokenize else T.tokens).collect()
    for k, text in enumerate(asked):
        got = {r["chunk_id"]: r["score"] for r in found if r["query_id"] == k}
        assert got == pytest.approx(fts5(PHRASE_TEXTS, text, tokenize), abs=6e-5), text


def test_slices_of_queries_give_the_same_rows(spark, monkeypatch):
    chunks = spark.createDataFrame([(k, f"w{k % 7} w{k % 5} v-{k % 3}") for k in range(200)], "chunk_id long, text string")
    files = spark.createDataFrame([(k, f"/w{k % 7}/v{k % 3}.txt", f"v{k % 3}.txt", k, k) for k in range(200)], "file_id long, path string, filename string, created_time long, modified_time long")
    vectors = spark.createDataFrame([(k, [float(k % 7), float(k % 5)]) for k in range(200)], "vec_id long, embedding array<double>")
    queries = spark.createDataFrame([(k, f"w{k % 7} v-{k % 4}", [1.0, k / 7]) for k in range(30)], "query_id long, query_text string, query_embedding array<double>")

    def rows():
        names = queries.withColumn("query_text", F.concat(F.lit("w"), (F.col("query_id") % 7).cast("string")))
        return [sorted(x.collect()) for x in (S.bm25(chunks, queries, 9), S.path_matches(files, names, 5), V.nearest(queries, vectors, 4))]

    whole = rows()
    assert [len(x) for x in whole] == [270, 150, 120]
    monkeypatch.setattr(slices, "SLICE_ROWS", 7)
    assert rows() == whole
    monkeypatch.setattr(slices, "SLICE_BYTES", 40)
    assert rows() == whole


def test_sentence_chunks_carry_their_overlap():
    text = ". ".join(" ".join(f"w{s}_{k}" for k in range(30)) for s in range(60))
    chunks = T.sentence_chunks(text, 100, 20)
    assert all(len(c.split()) <= 100 for c in chunks)
    for a, b in zip(chunks, chunks[1:], strict=False):
        assert b.split()[:20] == a.split()[-20:]
    assert T.sentence_chunks("") == [] and T.sentence_chunks(None) == [] and T.sentence_chunks(" \n") == []
    assert T.sentence_chunks("one two. three") == ["one two. three"]
    assert len(T.sentence_chunks(text, 10, 2)) == 40
    assert T.sentence_chunks(" ".join(["x"] * 2500), 1000, 150)[0].count("x") == 1000


def test_windows_cover_the_text(spark):
    for n in (0, 1, 199, 200, 201, 370, 371, 1000):
        words = [f"w{k}" for k in range(n)]
        cut = one(spark, T.windows(F.lit(" ".join(words))))
        assert len(cut) == (0 if n == 0 else 1 + max(0, math.ceil((n - 200) / 170)))
        if n:
            assert cut[-1].split()[-1] == words[-1] and cut[0].split()[0] == "w0"


def test_small_text_functions(spark):
    assert one(spark, T.human_size(F.lit(0))) == "0 B"
    assert one(spark, T.human_size(F.lit(1536))) == "1.5 KB"
    assert one(spark, T.human_size(F.lit(1024**3))) == "1 GB"
    assert one(spark, T.normal_tags(F.array(F.lit(" Big Data! "), F.lit("big data"), F.lit("-"), F.lit(None)))) == ["big-data"]
    assert one(spark, T.category_tags(F.lit("Documents/Invoices"))) == ["documents", "invoices"]
    assert one(spark, T.category_tags(F.lit(None).cast("string"))) == ["other"]
    assert one(spark, T.highlight(F.lit("Find the (x) here"), "(x) find")) == "<mark>Find</mark> the <mark>(x)</mark> here"
    assert one(spark, T.log_level(F.lit("Model LOADED"))) == "success"
    assert one(spark, T.log_level(F.lit("x"), F.lit(True))) == "error"
    assert one(spark, T.csv_list(F.lit(" a, ,b,"))) == ["a", "b"]


def test_file_predicates(spark):
    names = ["report.PDF", "~$report.docx", ".hidden.txt", "a.md", "x.tmp", "Thumbs.db", "photo.jpg", "back.txt~", ""]
    rows = spark.createDataFrame([(n,) for n in names], "name string").select("name", C.supported_file(F.col("name")).alias("ok")).collect()
    assert [r["name"] for r in rows if r["ok"]] == ["report.PDF", "photo.jpg"]
    assert one(spark, C.valid_size(F.lit("a.jpg"), F.lit(50 * 1024))) and not one(spark, C.valid_size(F.lit("a.jpg"), F.lit(50 * 1024 - 1)))
    assert one(spark, C.valid_size(F.lit("a.pdf"), F.lit(50 << 20))) and not one(spark, C.valid_size(F.lit("a.pdf"), F.lit((50 << 20) + 1)))
    assert one(spark, C.ignored_dir(F.lit("/home/u/Node_Modules/a.txt"))) and not one(spark, C.ignored_dir(F.lit("/home/u/docs/build")))
    assert one(spark, C.category(F.lit("/x/bill_of_may.xyz"), None, F.lit(""))) == "Documents/Invoices"
    assert one(spark, C.category(F.lit("/x/a.xyz"), None, F.lit("The Merchant and more"))) == "Documents/Receipts"
    assert one(spark, C.category(F.lit("/x/a.xyz"), None, F.lit(None).cast("string"))) == "Other"


def test_vectors(spark):
    assert one(spark, V.cosine(F.array(F.lit(0.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(0.0)))) == 0.0
    assert one(spark, V.normalized(F.array(F.lit(3.0), F.lit(4.0)))) == pytest.approx([0.6, 0.8])
    vectors = spark.createDataFrame([(k, [1.0, float(k % 3)]) for k in range(20)] + [(99, None)], "vec_id long, embedding array<float>")
    asked = spark.createDataFrame([(1, [1.0, 1.0]), (2, None)], "query_id long, query_embedding array<float>")
    found = V.nearest(asked, vectors.repartition(3), 4).orderBy("place").collect()
    assert [(r["query_id"], r["vec_id"], r["score"]) for r in found] == [(1, 2, 3.0), (1, 5, 3.0), (1, 8, 3.0), (1, 11, 3.0)]


@settings(max_examples=20, deadline=None)
@given(st.text(max_size=40))
def test_entropy(spark, text):
    n = len(text)
    expected = -sum(text.count(c) / n * math.log2(text.count(c) / n) for c in set(text)) if n else 0.0
    row = spark.createDataFrame([(text,)], "t string").select(X.entropy(F.col("t")).alias("h")).first()
    assert row["h"] == pytest.approx(expected, abs=1e-9)


def weight(line, mean):
    if not line:
        return 0.0
    h = -sum(line.count(c) / len(line) * math.log2(line.count(c) / len(line)) for c in set(line))
    if len(line) > 120 and all(c.isalnum() or c in "+/=" for c in line):
        return h * 0.1
    symbols = sum(not (c.isascii() and c.isalnum()) and not c.isspace() for c in line)
    return (h + len(line.split()) + symbols + len(line) / max(mean, 1.0)) * (5.0 if '"formula": "=' in line else 1.0)


def test_risk_of_a_change(spark):
    old = "keep\nmy password is here\nold line with words\n" + "A" * 130 + "\ngone"
    new = 'keep\nnew line\n"formula": "=A1"'
    pairs = spark.createDataFrame([(1, old, new), (2, "same", "same"), (3, "", "x y"), (4, None, None)], "key long, old string, new string")
    diffed = pairs.withColumn("diff", X.unified_diff("old", "new")).withColumn("ratio", X.likeness("old", "new"))
    got = {r["key"]: r for r in X.risk(X.weigh_diff(diffed).join(diffed.select("key", "ratio"), "key"), F.col("ratio")).collect()}
    r = got[1]
    a, b = old.split("\n"), new.split("\n")
    mean = sum(map(len, a + b)) / len(a + b)
    removed, added = a[1:], b[1:]
    modify = sum(weight(n, mean) + 2 * max(0.0, weight(o, mean) - weight(n, mean)) for o, n in zip(removed, added, strict=False))
    assert r["modify_score"] == pytest.approx(modify)
    assert r["delete_score"] == pytest.approx(weight("A" * 130, mean) * 2 + weight("gone", mean) * 2)
    assert r["similarity_score"] == pytest.approx((1 - difflib.SequenceMatcher(None, old, new).ratio()) * 5)
    assert r["intent"] == "Heavy Deletion" and not r["sensitive"]
    assert got[2]["change_score"] == 0 and got[2]["severity"] == "Minor" and got[2]["intent"] == "Addition/Modification"
    assert got[3]["n_added"] == 1 and got[4]["change_score"] == 0
    secret = spark.createDataFrame([(1, "a\nthe password\nb", "a\nb")], "key long, old string, new string")
    s = X.risk(X.weigh_lines(secret)).first()
    assert s["sensitive"] and s["severity"] == "Major" and s["intent"] == "Sensitive Data Deletion"


def test_paragraph_changes():
    out = X.paragraph_changes(["a b c", "same", "gone"], ["a x c d", "same", "new one", "more"])
    assert [(c["type"], c.get("words_added"), c.get("words_removed")) for c in out] == [("modified", 2, 1), ("modified", 2, 1), ("added", None, None)]


def test_stability(spark):
    value = lambda old, new, r: one(spark, G.stability(F.lit(old).cast("string"), F.lit(new).cast("string"), F.lit(r)))
    assert value(None, "x", 1.0) == 1.0 and value("{}", "x", 1.0) == 1.0 and value("", "", 0.0) == 1.0
    assert value("abcd", "ab", 0.0) == 0.5 and value("abcd", "ab", 1.0) == 0.15 and value("abcd", None, 0.5) == 0.05


def test_retention_edges(spark):
    days = [7, 8, 30, 31, 31, 365, 366]
    rows = [(1, k, NOW - d * 86400 - k) for k, d in enumerate(days)]
    out = G.retention(spark.createDataFrame(rows, "file_id long, version int, stamp long"), NOW).collect()
    assert {r["version"]: r["keep"] for r in out} == {0: True, 1: True, 2: True, 3: True, 4: False, 5: True, 6: False}


def test_blocks_round_trip(spark):
    files = spark.createDataFrame([(1, bytes(range(256)) * 5), (2, b""), (3, b"x" * 512)], "file_id long, content binary")
    cut = G.blocks(files, "content", 512)
    assert sorted((r["file_id"], r["block"], len(r["data"])) for r in cut.collect()) == [(1, 0, 512), (1, 1, 512), (1, 2, 256), (2, 0, 0), (3, 0, 512)]
    back = G.rebuild(G.recipe(cut, "file_id"), cut.select("block_hash", "data").dropDuplicates(["block_hash"]), "file_id").collect()
    assert {r["file_id"]: bytes(r["content"]) for r in back} == {1: bytes(range(256)) * 5, 2: b"", 3: b"x" * 512}


def test_delta_cuts_a_shrunk_file(spark):
    kind = "filepath string, block int, data binary"
    local = spark.createDataFrame([("f", 0, b"abcd"), ("f", 1, b"efgh"), ("g", 0, b"abcd")], kind)
    delta = spark.createDataFrame([("g", 1, b"xy")], kind)
    sizes = spark.createDataFrame([("f", 4), ("g", 6)], "filepath string, size long")
    assert {r["filepath"]: bytes(r["content"]) for r in Y.apply_delta(local, delta, sizes).collect()} == {"f": b"abcd", "g": b"abcdxy"}


def test_clocks(spark):
    verdict = lambda a, b: one(spark, Y.compare_clocks(*(F.from_json(F.lit(x), "map<string,bigint>") for x in (a, b))))
    assert verdict('{"pc":1}', "{}") == "local_wins" and verdict("{}", '{"m":2}') == "remote_wins"
    assert verdict('{"pc":1}', '{"m":1}') == "conflict" and verdict("{}", "{}") == "identical" and verdict('{"pc":0}', "{}") == "identical"
    table = {(c, v): one(spark, Y.resolve(F.lit(c), F.lit(v))) for c in ("deleted", "added", "modified") for v in ("local_wins", "identical", "remote_wins", "conflict")}
    assert [table[("deleted", v)] for v in ("local_wins", "identical", "remote_wins", "conflict")] == ["send_delta", "send_delta", "delete_local", "conflict"]
    assert [table[("added", v)] for v in ("local_wins", "identical", "remote_wins", "conflict")] == ["send_delete", "request_delta", "request_delta", "conflict"]
    assert [table[("modified", v)] for v in ("local_wins", "identical", "remote_wins", "conflict")] == ["send_delta", "send_delta", "request_delta", "conflict"]
    assert one(spark, Y.resolve(F.lit("modified"), F.lit("identical"), F.lit(False))) == "send_delete"


def test_auto_merge(spark):
    merged = lambda b, o, t: one(spark, M.auto_merge(F.lit(b), F.lit(o), F.lit(t)))
    assert merged("a\nb\nc\n", "a\nX\nc\n", "a\nb\nY\n") == "a\nX\nY\n"
    assert merged("a\n", "x\n", "y\n") == "x\n" and merged("", "", "") == "" and merged("a\nb", "a", "a\nb") == "a"


def test_limiter_counts_accepted_attempts_only(spark):
    rows = [(k, datetime(2024, 1, 1, 0, 0, k), "u") for k in range(5)] + [(9, datetime(2024, 1, 1, 0, 1, 1), "u"), (10, datetime(2024, 1, 1, 0, 1, 2), "u")]
    events = spark.createDataFrame(rows, "event_id long, ts timestamp, user string")
    out = {r["event_id"]: r["allowed"] for r in E.accepted_joins(events, "user", 60, 3).collect()}
    assert out == {0: True, 1: True, 2: True, 3: False, 4: False, 9: True, 10: True}


def test_debounce_gap_is_exclusive(spark):
    rows = [(1, datetime(2024, 1, 1), "f", "added"), (2, datetime(2024, 1, 1, 0, 0, 0, 499_999), "f", "modified"), (3, datetime(2024, 1, 1, 0, 0, 0, 999_999), "f", "deleted")]
    out = E.debounce(spark.createDataFrame(rows, "event_id long, ts timestamp, filepath string, event_type string"), 0.5).collect()
    assert sorted((r["event_type"], r["n_events"]) for r in out) == [("deleted", 1), ("modified", 2)]


def test_index_tables(spark):
    stored = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "key int, value string, stamp int")
    changes = spark.createDataFrame([(2, "c", 0), (2, "d", 5), (3, "e", 1)], "key int, value string, stamp int")
    assert sorted((r["key"], r["value"]) for r in I.upsert(stored, changes, "key", "stamp").collect()) == [(1, "a"), (2, "d"), (3, "e")]
    old = spark.createDataFrame([("a", None), ("b", 1)], "path string, modified_time long")
    new = spark.createDataFrame([("a", None), ("c", 1)], "path string, modified_time long")
    assert {(r["path"], r["status"]) for r in I.snapshot_diff(old, new).collect()} == {("a", "unchanged"), ("b", "deleted"), ("c", "new")}


def test_confidence_of_equal_scores(spark):
    rows = spark.createDataFrame([(1, 0.5, 1), (1, 0.5, 3), (2, 0.1, 2), (2, 0.2, 1)], "query_id long, rrf double, n_signals int")
    assert sorted(r["score"] for r in S.confidence(rows).collect()) == [0.45, 0.92, 0.92, 0.99]


def test_many_queries_with_one_common_word_take_one_pass_over_the_chunks(spark, monkeypatch):
    """Each asks for a rare word twice and a common one; best are the chunks with both, then the common word's own best."""
    chunks = spark.createDataFrame([(k, f"r{k % 2500} " + "the " * (k % 4) + "x " * (k % 6)) for k in range(5000)], "chunk_id long, text string")
    queries = spark.createDataFrame([(k, f"r{k} r{k} the") for k in range(2100)], "query_id long, query_text string")
    passes, run = [], S._bm25
    monkeypatch.setattr(S, "_bm25", lambda *a: passes.append(1) or run(*a))
    found = S.bm25(chunks, queries, 6).collect()
    assert len(passes) == 1 and len(found) == 6 * 2100
    alone = [r["chunk_id"] for r in S.bm25(chunks, spark.createDataFrame([(1, "the")], "query_id long, query_text string"), 6).orderBy("place").collect()]
    for q in (0, 3, 1234, 2099):
        got = [r["chunk_id"] for r in sorted((r for r in found if r["query_id"] == q), key=lambda r: r["place"])]
        assert set(got[:2]) == {q, q + 2500} and got[2:] == [c for c in alone if c not in got[:2]][:4]
