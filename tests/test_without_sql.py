"""Values of queries that SQL can't express, against the standard library."""

import collections
import difflib
import hashlib
import random
import time

import pytest

from docloom.operators import diff as X
from docloom.operators import registry
from docloom.plans.fixtures import view

QUERIES = registry.queries()


@pytest.fixture(scope="module")
def contents(spark, data):
    out = collections.defaultdict(dict)
    for r in view(spark, data, "fx_versions").select("file_id", "version", "content").collect():
        out[r["file_id"]][r["version"]] = r["content"] or ""
    return out


def line_changes(old, new):
    """Deleted and inserted lines with their places in the old text."""
    at, out = 0, []
    for line in difflib.Differ().compare(old.splitlines(), new.splitlines()):
        if line[0] in "-+":
            out.append(("delete" if line[0] == "-" else "insert", at))
        at += line[0] in "- "
    return out


@pytest.fixture(scope="module")
def changes(contents):
    return {k: (line_changes(v[1], v[2]), line_changes(v[1], v[3])) for k, v in contents.items()}


def test_m1_line_changes(spark, data, changes):
    expected = set()
    for k, (_, theirs) in changes.items():
        for op in {o for o, _ in theirs}:
            places = [a for o, a in theirs if o == op]
            expected.add((k, op, len(places), max(places)))
    assert {(r["key"], r["op"], r["n"], r["last_line"]) for r in QUERIES["m1_line_changes"](spark, data).collect()} == expected


def conflicts(ours, theirs):
    return [(i, a, b) for a, i in ours for b, j in theirs if i == j and a != b]


def test_m2_merge_conflicts(spark, data, changes):
    expected = collections.Counter((k, *c) for k, (ours, theirs) in changes.items() for c in conflicts(ours, theirs))
    got = collections.Counter((r["key"], r["line_num"], r["our_op"], r["their_op"]) for r in QUERIES["m2_merge_conflicts"](spark, data).collect())
    assert got == expected


def test_e15_change_counts(spark, data, changes):
    expected = {}
    for k, (ours, _) in changes.items():
        if ours:
            n = collections.Counter(o for o, _ in ours)
            expected[k] = "Total changes: " + ", ".join(f"{n[o]} {o}" for o in sorted(n))
    assert {r["key"]: r["summary"] for r in QUERIES["e15_change_counts"](spark, data).collect()} == expected


def test_m9_merge_report(spark, data, contents, changes):
    got = {r["key"]: r for r in QUERIES["m9_merge_report"](spark, data).collect()}
    assert got.keys() == contents.keys()
    for k, (ours, theirs) in changes.items():
        r = got[k]
        n = len(conflicts(ours, theirs))
        assert (r["n_ours"], r["n_theirs"], r["n_conflicts"]) == (len(ours), len(theirs), n)
        assert [s["strategy"] for s in r["suggestions"]] == ["keep_ours", "keep_theirs", "auto_merge"]
        assert r["suggestions"][2]["base_score"] == (0.9 if n == 0 else 0.5)
        assert r["suggestions"][0]["merged_md5"] == hashlib.md5(contents[k][2].encode()).hexdigest()


def test_l1_unified_diff(spark, data, contents):
    pairs = spark.createDataFrame([(k, v[1], v[3]) for k, v in contents.items()], "key long, old string, new string")
    for r in pairs.select("key", "old", "new", X.unified_diff("old", "new").alias("d")).collect():
        assert r["d"] == "\n".join(difflib.unified_diff(r["old"].splitlines(), r["new"].splitlines(), lineterm=""))


def test_l11_and_l6_have_a_row_for_each_file(spark, data, contents):
    got = {r["file_id"]: (r["lo"], r["hi"]) for r in QUERIES["l11_compare_versions"](spark, data).collect()}
    assert got == {k: (min(v), max(v)) for k, v in contents.items()}
    summary = {r["file_id"]: r["summary"] for r in QUERIES["l6_version_summary"](spark, data).collect()}
    for k, v in contents.items():
        lines = list(difflib.unified_diff(v[1].splitlines(), v[3].splitlines(), lineterm=""))
        added, removed = (sum(x.startswith(s) and not x.startswith(s * 3) for x in lines) for s in "+-")
        assert summary[k] == f"{added} lines added, {removed} lines removed"


ODD = [("", "x"), ("same\n" * 300 + "end", "same\n" * 290 + "other\nend"), ("ab cd\nab ce\nab cf", "ab ce!\nab cd!\nab cf!"), ("a\r\nb\x0bc d", "a\nb\nc\nd"), ("x", "x\n\n\n")]


def texts(draw):
    """Old and new lines: short and long ones, few and many characters, changed a little, moved, dropped, repeated."""
    for _ in range(150):
        old = ["".join(draw.choices(draw.choice(["ab", "abcdefghij .", "aäß語𝄞 \0", "0123456789,"]), k=draw.choice([0, 3, 20, 60, 250]))) for _ in range(draw.choice([1, 2, 5, 12, 30]))]
        new = [x.replace(draw.choice("ab 0"), "!", draw.randrange(4)) for x in old * draw.choice([1, 1, 2]) if draw.random() < 0.9]
        if draw.random() < 0.3:
            draw.shuffle(new)
        yield "\n".join(old), "\n".join(new)


def test_line_changes_are_those_of_the_library():
    for old, new in [*ODD, *texts(random.Random(7))]:
        got = [(x["op"], x["line_num"]) for x in X._line_ops(old, new)]
        assert got == line_changes(old, new)


def test_replaced_lines_take_no_work_for_marks_inside_them():
    """Forty changed lines beside each other; the library compares all their pairs again behind each one it has found."""
    draw = random.Random(3)
    old = [" ".join(draw.choices("of the and station committee report river.".split(), k=25)) for _ in range(40)]
    old, new = "\n".join(old), "\n".join(x.replace(".", "!") for x in old)
    began = time.process_time()
    got = [(x["op"], x["line_num"]) for x in X._line_ops(old, new)]
    took = time.process_time() - began
    assert got == line_changes(old, new)
    assert 3 * took < time.process_time() - began - took


@pytest.mark.parametrize("name", ["m2_merge_conflicts", "e15_change_counts"])
def test_versions_are_dealt_out_before_they_are_compared(spark, data, name):
    """Beside broadcast tables the rows would stay in the few tasks that read the file."""
    plan = QUERIES[name](spark, data)._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" in plan[plan.index("ArrowEvalPython") :]


def test_m9_compares_each_side_once(spark, data):
    plan = QUERIES["m9_merge_report"](spark, data)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and plan.count("Aggregate") == 0
