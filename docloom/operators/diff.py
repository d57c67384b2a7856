"""Differences of two contents: lines, words, cells, and what they weigh.

Inputs are pairs with the columns key, old and new. Sequence alignment is the
standard library's, in Arrow batches; everything that is counted from lines is a
column expression on exploded rows.
"""

from __future__ import annotations

import difflib
import json
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, LongType, StringType, StructField, StructType

from docloom.functions.classify import sensitive
from docloom.functions.linediff import line_changes

# What lines, deletions and changes weigh.
BLOB_LENGTH, BLOB_SHARE, FORMULA = 120, 0.1, 5.0
LOST, BLOCK_WEIGHT, BLOCK_LINES = 2.0, 0.2, 5
SENSITIVE_DELETION, DELETIONS, OTHER_DELETION = 10.0, ((3.5, 3.0), (2.0, 2.5)), 2.0  # (more entropy than, factor)
HEAVY, MODERATE = 0.5, 0.2  # shares of deleted lines
MAJOR, MIDDLING = 20, 10  # change score per line


@arrow_udf(StringType())
def unified_diff(old: pa.Array, new: pa.Array) -> pa.Array:
    rows = zip(old.to_pylist(), new.to_pylist(), strict=True)
    return pa.array(["\n".join(difflib.unified_diff((a or "").splitlines(), (b or "").splitlines(), lineterm="")) for a, b in rows])


@arrow_udf(DoubleType())
def likeness(old: pa.Array, new: pa.Array) -> pa.Array:
    """The matcher's ratio of the characters; equal contents need no matching."""
    rows = zip(old.to_pylist(), new.to_pylist(), strict=True)
    return pa.array([1.0 if (a or "") == (b or "") else difflib.SequenceMatcher(None, a or "", b or "").ratio() for a, b in rows], pa.float64())


_OPS = ArrayType(StructType([StructField("op", StringType()), StructField("line_num", LongType()), StructField("content", StringType())]))
_OPS_ARROW = pa.list_(pa.struct([("op", pa.string()), ("line_num", pa.int64()), ("content", pa.string())]))


def _line_ops(old: str, new: str) -> list[dict]:
    """Deleted and inserted lines with their place in the old text."""
    kinds = {"-": "delete", "+": "insert"}
    return [{"op": kinds[sign], "line_num": at, "content": line} for sign, at, line in line_changes(old.splitlines(), new.splitlines())]


@arrow_udf(_OPS)
def line_ops(old: pa.Array, new: pa.Array) -> pa.Array:
    rows = zip(old.to_pylist(), new.to_pylist(), strict=True)
    return pa.array([[] if a == b else _line_ops(a or "", b or "") for a, b in rows], _OPS_ARROW)


_PARAGRAPH = [("type", "string"), ("old_text", "string"), ("new_text", "string"), ("words_added", "long"), ("words_removed", "long")]
_PARAGRAPHS = ArrayType(StructType([StructField(n, StringType() if t == "string" else LongType()) for n, t in _PARAGRAPH]))
_PARAGRAPHS_ARROW = pa.list_(pa.struct([(n, pa.string() if t == "string" else pa.int64()) for n, t in _PARAGRAPH]))


def word_counts(old: str, new: str) -> tuple[int, int]:
    """Words added and removed between two paragraphs."""
    a, b = old.split(), new.split()
    changed = [o for o in difflib.SequenceMatcher(None, a, b).get_opcodes() if o[0] != "equal"]
    return sum(o[4] - o[3] for o in changed), sum(o[2] - o[1] for o in changed)


def paragraph_changes(old: list[str], new: list[str]) -> list[dict]:
    """Modified, removed and added paragraphs: those of a replaced stretch are paired in order."""
    out = []
    for kind, a, b, c, d in difflib.SequenceMatcher(None, old, new).get_opcodes():
        if kind == "equal":
            continue
        both = min(b - a, d - c)
        for i in range(both):
            plus, minus = word_counts(old[a + i], new[c + i])
            out.append({"type": "modified", "old_text": old[a + i], "new_text": new[c + i], "words_added": plus, "words_removed": minus})
        out += [{"type": "removed", "old_text": t} for t in old[a + both : b]]
        out += [{"type": "added", "new_text": t} for t in new[c + both : d]]
    return out


@arrow_udf(_PARAGRAPHS)
def word_diff(old: pa.Array, new: pa.Array) -> pa.Array:
    rows = zip(old.to_pylist(), new.to_pylist(), strict=True)
    return pa.array([paragraph_changes(list(a or []), list(b or [])) for a, b in rows], _PARAGRAPHS_ARROW)


@arrow_udf(StringType())
def structure_text(structure: pa.Array) -> pa.Array:
    """A structure (JSON) with two spaces of indent, one value a line; other text stays as it is."""

    def shown(x: str | None) -> str:
        try:
            return json.dumps(json.loads(x or ""), indent=2)
        except ValueError:
            return x or ""

    return pa.array([shown(x) for x in structure.to_pylist()], pa.string())


@arrow_udf(ArrayType(StringType()))
def missing_from(one: pa.Array, other: pa.Array) -> pa.Array:
    """Items of one array that the other lacks, with repeats, in order."""
    out = []
    for a, b in zip(one.to_pylist(), other.to_pylist(), strict=True):
        there = set(b or [])
        out.append(None if a is None else [x for x in a if x not in there])
    return pa.array(out, pa.list_(pa.string()))


def text_lines(text: Column) -> Column:
    """Lines without a trailing empty one; none for null or empty text."""
    value = F.regexp_replace(F.coalesce(text, F.lit("")), r"\r\n?", "\n")
    cut = F.split(F.regexp_replace(value, "\n$", ""), "\n", -1)
    return F.when(value == "", F.array().cast("array<string>")).otherwise(cut)


def _codes(text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all texts (null: empty), the row of each, and the texts' lengths."""
    text = text.fill_null("")
    code = np.frombuffer("".join(text.to_pylist()).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    length = pc.utf8_length(text).to_numpy(zero_copy_only=False).astype(np.int64)
    return code, np.repeat(np.arange(len(text)), length), length


def _entropies(code: np.ndarray, row: np.ndarray, length: np.ndarray) -> np.ndarray:
    out = np.zeros(len(length))
    if len(code):
        pair, n = np.unique((row << 21) | code, return_counts=True)
        spent = np.bincount(pair >> 21, n * np.log2(n), minlength=len(length))
        some = length > 0
        out[some] = np.log2(length[some]) - spent[some] / length[some]
    return out


@arrow_udf(DoubleType())
def entropy(text: pa.Array) -> pa.Array:
    """Bits per character, counted on the text's distinct characters; 0 for null or empty text."""
    return pa.array(_entropies(*_codes(text)), pa.float64())


_SPACE, _ALNUM, _BLOB = (np.zeros(129, bool) for _ in range(3))  # of ASCII characters; the last place stands for all others
_SPACE[[ord(c) for c in " \t\n\x0b\f\r"]] = True
_ALNUM[[c for c in range(128) if chr(c).isalnum()]] = True
_BLOB[[c for c in range(128) if chr(c).isalnum() or chr(c) in "+/="]] = True


@arrow_udf(StructType([StructField("h", DoubleType()), StructField("marks", LongType()), StructField("blob", BooleanType())]))
def line_facts(text: pa.Array) -> pa.Array:
    """Of each line its entropy, its words and symbols together, and whether it is an encoded blob; all from one pass over the characters."""
    code, row, length = _codes(text)
    kind, n = np.minimum(code, 128), len(length)
    space = _SPACE[kind]
    starts = ~space & np.concatenate(([True], space[:-1] | (row[1:] != row[:-1]))) if len(code) else space
    marks = np.bincount(row[starts], minlength=n) + np.bincount(row[~space & ~_ALNUM[kind]], minlength=n)
    blob = (length > BLOB_LENGTH) & (np.bincount(row[~_BLOB[kind]], minlength=n) == 0)
    return pa.StructArray.from_arrays([pa.array(_entropies(code, row, length)), pa.array(marks.astype(np.int64)), pa.array(blob)], ["h", "marks", "blob"])


#: A heading of plain text: a line of at most 80 characters that begins with # or with a capital and a further letter, and has no end of a sentence, comma, colon or semicolon.
HEADING = "^(#{1,6} .{1,80}|[A-ZÀ-Þ][^.!?,:;]{1,79})$"


def headings(text: Column) -> Column:
    """The headings among all lines of a text."""
    return F.filter(text_lines(text), lambda x: x.rlike(HEADING))


def importance(line: Column, mean_length: Column, facts: Column) -> Column:
    """What a line weighs, given its `line_facts`: entropy, words, symbols and relative length; encoded blobs little, formulas five times."""
    value = facts["h"] + facts["marks"] + F.length(line) / F.greatest(mean_length, F.lit(1.0))
    formula = F.when(line.contains('"formula": "='), FORMULA).otherwise(1.0)
    return F.when(line == "", F.lit(0.0)).when(facts["blob"], facts["h"] * BLOB_SHARE).otherwise(value * formula)


def weigh_lines(pairs: DataFrame) -> DataFrame:
    """Per key the scores of the lines that only one side has, paired in order.

    total_lines, n_added, n_removed, modify_score, add_score, delete_score,
    block_score, size_score, sensitive: lines at the same place of both lists are
    a modification (information lost counts twice more), the others additions or
    deletions; deletions weigh 2 to 3 times by entropy, sensitive ones 10 times.
    """
    old, new = text_lines(F.col("old")), text_lines(F.col("new"))
    lined = pairs.select("key", F.coalesce("old", F.lit("")).alias("old"), F.coalesce("new", F.lit("")).alias("new"), old.alias("a"), new.alias("b"))
    n_all = F.size("a") + F.size("b")
    chars = F.aggregate(F.concat("a", "b"), F.lit(0), lambda s, x: s + F.length(x))
    base = lined.withColumns(
        {
            "total_lines": F.greatest(F.size("a"), F.size("b"), F.lit(1)),
            "mean": F.when(n_all > 0, chars / n_all).otherwise(0.0),
            "added": missing_from(F.col("b"), F.col("a")),
            "removed": missing_from(F.col("a"), F.col("b")),
        }
    )
    return _scores(base)


def weigh_diff(pairs: DataFrame) -> DataFrame:
    """weigh_lines on the lines of a unified diff (column diff); changed lines that begin with -- or ++ are passed over."""
    lines = F.split("diff", "\n")
    plus = F.filter(lines, lambda x: x.startswith("+") & ~x.startswith("+++"))
    minus = F.filter(lines, lambda x: x.startswith("-") & ~x.startswith("---"))
    old, new = text_lines(F.col("old")), text_lines(F.col("new"))
    lined = pairs.select("key", F.coalesce("old", F.lit("")).alias("old"), F.coalesce("new", F.lit("")).alias("new"), old.alias("a"), new.alias("b"), plus.alias("p"), minus.alias("m"))
    n_all = F.size("a") + F.size("b")
    chars = F.aggregate(F.concat("a", "b"), F.lit(0), lambda s, x: s + F.length(x))
    base = lined.withColumns(
        {
            "total_lines": F.greatest(F.size("a"), F.size("b"), F.lit(1)),
            "mean": F.when(n_all > 0, chars / n_all).otherwise(0.0),
            "added": F.transform("p", lambda x: F.substring(x, 2, 1 << 30)),
            "removed": F.transform("m", lambda x: F.substring(x, 2, 1 << 30)),
        }
    )
    return _scores(base)


def line_blocks(lines: Column, size: int = BLOCK_LINES) -> Column:
    last = F.floor((F.size(lines) - 1) / F.lit(size)).cast("int")
    cut = F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.array_join(F.slice(lines, i * size + 1, F.lit(size)), "\n"))
    return F.when(F.size(lines) > 0, cut).otherwise(F.array().cast("array<string>"))


def _scores(base: DataFrame) -> DataFrame:
    one, two = line_blocks(F.col("a")), line_blocks(F.col("b"))
    blocks = F.size(F.array_except(one, two)) + F.size(F.array_except(two, one))
    sized = base.withColumns(
        {
            "n_added": F.size("added"),
            "n_removed": F.size("removed"),
            "block_score": blocks * (F.col("mean") * BLOCK_WEIGHT),
            "size_score": F.abs(F.length("new") - F.length("old")) / F.greatest(F.length("old").cast("double"), F.lit(1.0)),
        }
    )
    kept = ["key", "total_lines", "n_added", "n_removed", "block_score", "size_score"]
    paired = sized.select(*kept, "mean", F.posexplode_outer(F.arrays_zip("added", "removed")).alias("pos", "z"))
    new, old = F.col("z.added"), F.col("z.removed")
    alone = new.isNull() & old.isNotNull()
    paired = paired.withColumns({"_new": line_facts(new), "_old": line_facts(old), "_sensitive": F.coalesce(alone & sensitive(old), F.lit(False))})
    paired = paired.withColumns({"_ni": importance(new, F.col("mean"), F.col("_new")), "_oi": importance(old, F.col("mean"), F.col("_old"))})
    ni, oi, h = F.col("_ni"), F.col("_oi"), F.col("_old.h")
    factor = reduce(lambda f, d: f.when(h > d[0], d[1]), DELETIONS, F.when(F.col("_sensitive"), SENSITIVE_DELETION)).otherwise(OTHER_DELETION)
    rows = paired.withColumns(
        {
            "_modify": F.when(new.isNotNull() & old.isNotNull(), ni + F.when(oi > ni, (oi - ni) * LOST).otherwise(0.0)),
            "_add": F.when(new.isNotNull() & old.isNull(), ni),
            "_delete": F.when(alone, oi * factor),
        }
    )
    total = lambda c: F.coalesce(F.sum(c), F.lit(0.0))
    return rows.groupBy(*kept).agg(
        total("_modify").alias("modify_score"), total("_add").alias("add_score"), total("_delete").alias("delete_score"), F.max("_sensitive").alias("sensitive")
    )


def risk(weighed: DataFrame, ratio: Column | None = None) -> DataFrame:
    """Adds similarity_score, change_score, risk_score, intent and severity to weigh_lines' rows.

    ratio: likeness of the whole contents, 1 left out.
    """
    alike = (1.0 - ratio) * F.col("total_lines") if ratio is not None else F.lit(0.0)
    change = F.col("add_score") + F.col("delete_score") + F.col("modify_score") + F.col("similarity_score") + F.col("block_score") + F.col("size_score")
    out, into, lines = F.col("n_removed"), F.col("n_added"), F.col("total_lines")
    intent = (
        F.when(F.col("sensitive"), "Sensitive Data Deletion")
        .when(out <= into, "Addition/Modification")
        .when(out > lines * HEAVY, "Heavy Deletion")
        .when(out > lines * MODERATE, "Moderate Deletion")
        .otherwise("Light Deletion")
    )
    severity = F.when(F.col("sensitive") | (F.col("change_score") > lines * MAJOR), "Major").when(F.col("change_score") > lines * MIDDLING, "Moderate").otherwise("Minor")
    scored = weighed.withColumn("similarity_score", alike).withColumn("change_score", change)
    share = F.col("delete_score") / F.greatest("change_score", F.lit(1.0))
    return scored.withColumns({"risk_score": F.least(F.lit(1.0), F.greatest(F.lit(0.0), share)), "intent": intent, "severity": severity})


def cells(old: DataFrame, new: DataFrame) -> DataFrame:
    """sheet, cell, change (added, removed, changed, same), old and new value, formula_changed."""
    a = old.select("sheet", "cell", F.col("value").alias("old_value"), F.col("formula").alias("old_formula"), F.lit(True).alias("o"))
    b = new.select("sheet", "cell", F.col("value").alias("new_value"), F.col("formula").alias("new_formula"), F.lit(True).alias("n"))
    alike = F.col("old_value").eqNullSafe(F.col("new_value")) & F.col("old_formula").eqNullSafe(F.col("new_formula"))
    change = F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "removed").when(alike, "same").otherwise("changed")
    both = F.col("o").isNotNull() & F.col("n").isNotNull()
    formula = both & ~F.col("old_formula").eqNullSafe(F.col("new_formula"))
    return a.join(b, ["sheet", "cell"], "full_outer").select("sheet", "cell", change.alias("change"), "old_value", "new_value", formula.alias("formula_changed"))


def sheet_summary(cell_rows: DataFrame) -> DataFrame:
    """sheet, n_changed, n_formulas and whether the sheet is new or gone."""
    status = F.when(F.count_if(F.col("change") != "added") == 0, "added").when(F.count_if(F.col("change") != "removed") == 0, "removed").otherwise("kept")
    return cell_rows.groupBy("sheet").agg(F.count_if(F.col("change") != "same").alias("n_changed"), F.count_if("formula_changed").alias("n_formulas"), status.alias("status"))


def paragraphs(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda p: F.trim(p) != "")
