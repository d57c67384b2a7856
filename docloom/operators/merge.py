"""Three-way merges: positional merge, conflicts, suggestions and preferences."""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import LongType, StructField, StructType

from docloom.functions.linediff import line_changes
from docloom.operators.diff import line_ops

# Fixed values of the ranking.
ACCEPTED, REJECTED, SOURCE_WEIGHT, SIZE_WEIGHT, FEW_CHANGES = 0.1, -0.05, 0.1, 0.05, 3
SCOPES = {"isolated": 1.0, "local": 0.7, "global": 0.3}


def lines_with_ends(text: Column) -> Column:
    """Lines that keep their \\n."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[^\n]*\n|[^\n]+"), F.lit(0))


def auto_merge(base: Column, ours: Column, theirs: Column) -> Column:
    """Line by line: equal lines; else the side that differs from the base; else ours if it has one."""
    together = F.arrays_zip(*(lines_with_ends(x) for x in (base, ours, theirs)))  # as long as the longest, nulls behind the others

    def pick(lines: Column) -> Column:
        x, y, z = (F.coalesce(lines[k], F.lit("")) for k in "012")
        return F.when(y == z, y).when(y == x, z).otherwise(y)

    return F.array_join(F.transform(together, pick), "")


def changes(rows: DataFrame, new: str) -> DataFrame:
    """key, op, line_num, content: line changes from base to a column."""
    return rows.select("key", F.explode(line_ops("base", F.col(new))).alias("c")).select("key", "c.op", "c.line_num", "c.content")


def conflicts(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """Pairs of changes at one line with different operations: an equi-join on the line, the operation as a residue."""
    a = ours.select("key", "line_num", F.col("op").alias("our_op"), F.col("content").alias("our_content"))
    b = theirs.select("key", "line_num", F.col("op").alias("their_op"), F.col("content").alias("their_content"))
    return a.join(b, ["key", "line_num"]).where("our_op <> their_op")


def relevance(length: Column, scope: Column, conflict: Column) -> Column:
    size = 0.3 / (1.0 + F.ln(length + 1.0))
    weight = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in SCOPES.items() for x in kv]), scope), F.lit(0.5))
    return F.least(F.lit(1.0), size + weight * 0.4 + F.when(F.coalesce(conflict, F.lit(False)), 0.0).otherwise(0.3))


def suggestions(rows: DataFrame) -> DataFrame:
    """key, strategy, source, merged, base_score, relevance_score, place: the three strategies, re-ranked.

    rows: key, base, ours, theirs, n_conflicts. Suggestions carry neither content,
    scope nor conflict, so the re-ranker gives each the same score and the
    order of the strategies stays.
    """
    score = relevance(F.lit(0), F.lit("unknown"), F.lit(False))
    return rows.select("key", F.explode(strategies()).alias("s")).select("key", "s.*", score.alias("relevance_score"))


def strategies() -> Column:
    """The three suggestions of a row (base, ours, theirs, n_conflicts) as an array of structs."""
    auto = F.when(F.col("n_conflicts") == 0, 0.9).otherwise(0.5)
    return F.array(
        F.struct(F.lit(1).alias("place"), F.lit("keep_ours").alias("strategy"), F.lit("ours").alias("source"), F.col("ours").alias("merged"), F.lit(0.3).alias("base_score")),
        F.struct(F.lit(2).alias("place"), F.lit("keep_theirs").alias("strategy"), F.lit("theirs").alias("source"), F.col("theirs").alias("merged"), F.lit(0.3).alias("base_score")),
        F.struct(
            F.lit(3).alias("place"), F.lit("auto_merge").alias("strategy"), F.lit("auto").alias("source"),
            auto_merge(F.col("base"), F.col("ours"), F.col("theirs")).alias("merged"), auto.alias("base_score"),
        ),
    )


def preferences(choices: DataFrame, *keys: str) -> DataFrame:
    """Sums of a choice log (source, accepted, n_changes): prefer_ours, prefer_theirs, prefer_conservative, prefer_aggressive."""
    w = F.when(F.col("accepted"), ACCEPTED).otherwise(REJECTED)
    few = F.col("n_changes") < FEW_CHANGES
    total = lambda c: F.coalesce(F.sum(F.when(c, w)), F.lit(0.0))
    return choices.groupBy(*keys).agg(
        total(F.col("source") == "ours").alias("prefer_ours"), total(F.col("source") == "theirs").alias("prefer_theirs"),
        total(few).alias("prefer_conservative"), total(~few).alias("prefer_aggressive"),
    )


def adjusted(score: Column, source: Column, n_changes: Column) -> Column:
    """A score with the preference columns of its row added, kept within 0 and 1."""
    side = F.when(source == "ours", F.col("prefer_ours")).when(source == "theirs", F.col("prefer_theirs")).otherwise(0.0)
    style = F.when(n_changes < FEW_CHANGES, F.col("prefer_conservative")).otherwise(F.col("prefer_aggressive"))
    return F.least(F.greatest(score + side * SOURCE_WEIGHT + style * SIZE_WEIGHT, F.lit(0.0)), F.lit(1.0))


def summary(change_rows: DataFrame) -> DataFrame:
    """key, summary: counts of changes by operation."""
    counted = change_rows.groupBy("key", "op").agg(F.count("*").alias("n"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("op", "n"))), lambda x: F.concat_ws(" ", x["n"].cast("string"), x["op"]))
    return counted.groupBy("key").agg(F.concat(F.lit("Total changes: "), F.array_join(parts, ", ")).alias("summary"))


def assist(rows: DataFrame) -> DataFrame:
    """key, n_ours, n_theirs, n_conflicts, ours_summary, theirs_summary, suggestions of rows (key, base, ours, theirs).

    What a merge view shows at once: the line changes of both sides, the lines
    that both change with different operations, and the three suggestions ranked
    with that number of conflicts.
    """
    n = F.col("_n")
    ours, theirs = n["ours_delete"] + n["ours_insert"], n["theirs_delete"] + n["theirs_insert"]
    counted = rows.where("key is not null").withColumn("_n", change_counts("base", "ours", "theirs")).withColumns({"n_ours": ours, "n_theirs": theirs, "n_conflicts": n["conflicts"]})
    score = relevance(F.lit(0), F.lit("unknown"), F.lit(False)).alias("relevance_score")
    ranked = F.transform(strategies(), lambda s: F.struct(s["place"].alias("place"), s["strategy"].alias("strategy"), s["source"].alias("source"), s["base_score"].alias("base_score"), score, s["merged"].alias("merged")))
    told = lambda side: _told(n[f"{side}_delete"], n[f"{side}_insert"]).alias(f"{side}_summary")
    return counted.select("key", "n_ours", "n_theirs", "n_conflicts", told("ours"), told("theirs"), ranked.alias("suggestions"))


def _told(deletes: Column, inserts: Column) -> Column:
    parts = [F.when(n > 0, F.concat_ws(" ", n.cast("string"), F.lit(op))) for n, op in ((deletes, "delete"), (inserts, "insert"))]
    return F.when(deletes + inserts == 0, "No changes detected").otherwise(F.concat(F.lit("Total changes: "), F.concat_ws(", ", *parts)))


_COUNTS = "ours_delete ours_insert theirs_delete theirs_insert conflicts".split()


@arrow_udf(StructType([StructField(n, LongType()) for n in _COUNTS]))
def change_counts(base: pa.Array, ours: pa.Array, theirs: pa.Array) -> pa.Array:
    """How many lines both sides delete and insert, and how many pairs of changes at one line have different operations."""
    out = []
    for x, y, z in zip(base.to_pylist(), ours.to_pylist(), theirs.to_pylist(), strict=True):
        sides = [Counter((sign, at) for sign, at, _ in line_changes((x or "").splitlines(), (t or "").splitlines())) if x != t else Counter() for t in (y, z)]
        totals = [sum(n for (sign, _), n in side.items() if sign == op) for side in sides for op in "-+"]
        other = {"-": "+", "+": "-"}
        out.append([*totals, sum(n * sides[1][other[sign], at] for (sign, at), n in sides[0].items())])
    return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out, strict=True) if out else [[]] * len(_COUNTS))], _COUNTS)
