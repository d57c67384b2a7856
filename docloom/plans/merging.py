"""Queries: three-way merges and preferences."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.operators import merge as M
from docloom.operators.registry import query
from docloom.plans.fixtures import cte, view

_ROWS = cte("fx_versions") + ", t AS (SELECT a.file_id AS key, a.content AS base, b.content AS ours, c.content AS theirs FROM fx_versions a JOIN fx_versions b ON a.file_id = b.file_id AND b.version = 2 JOIN fx_versions c ON a.file_id = c.file_id AND c.version = 3 WHERE a.version = 1)"


def _rows(spark, d):
    """The second version is ours, the third theirs, the first their base; dealt by key, as comparing them costs more than moving them."""
    v = view(spark, d, "fx_versions")
    part = lambda n, name: v.where(f"version = {n}").select(F.col("file_id").alias("key"), F.col("content").alias(name))
    return part(1, "base").repartition("key").join(part(2, "ours"), "key").join(part(3, "theirs"), "key")


_LINES = "regexp_extract_all({0}, '[^\\n]*\\n|[^\\n]+')"
_AUTO = (
    _ROWS
    + f", l AS (SELECT key, {_LINES.format('base')} AS b, {_LINES.format('ours')} AS o, {_LINES.format('theirs')} AS t FROM t)"
    + """, p AS (SELECT key, i, coalesce(b[i], '') AS x, coalesce(o[i], '') AS y, coalesce(t[i], '') AS z FROM (SELECT *, unnest(generate_series(1, greatest(len(b), len(o), len(t)))) AS i FROM l)),
    m AS (SELECT key, string_agg(CASE WHEN y = z THEN y WHEN y = x THEN z ELSE y END, '' ORDER BY i) AS merged FROM p GROUP BY key)"""
)


@query(_AUTO + " SELECT key, md5(merged) AS merged_md5 FROM m")
def m4_auto_merge(spark, d):
    rows = _rows(spark, d).where("length(base) + length(ours) + length(theirs) > 0")
    return rows.select("key", F.md5(M.auto_merge(F.col("base"), F.col("ours"), F.col("theirs"))).alias("merged_md5"))


@query()
def m1_line_changes(spark, d):
    rows = _rows(spark, d)
    return M.changes(rows, "theirs").groupBy("key", "op").agg(F.count("*").alias("n"), F.max("line_num").alias("last_line"))


@query()
def m2_merge_conflicts(spark, d):
    rows = _rows(spark, d)
    found = M.conflicts(M.changes(rows, "ours"), M.changes(rows, "theirs"))
    return found.select("key", "line_num", "our_op", "their_op")


@query()
def e15_change_counts(spark, d):
    return M.summary(M.changes(_rows(spark, d), "ours"))


@query(
    _AUTO
    + """ SELECT key, strategy, source, place, md5(merged) AS merged_md5, base_score, round(0.3 + 0.5 * 0.4 + 0.3, 4)::DOUBLE AS relevance_score FROM (
    SELECT key, 'keep_ours' AS strategy, 'ours' AS source, 1 AS place, ours AS merged, 0.3::DOUBLE AS base_score FROM t
    UNION ALL SELECT key, 'keep_theirs', 'theirs', 2, theirs, 0.3 FROM t UNION ALL SELECT t.key, 'auto_merge', 'auto', 3, coalesce(merged, ''), 0.9 FROM t LEFT JOIN m USING (key))"""
)
def m5_suggestions(spark, d):
    rows = _rows(spark, d).withColumn("n_conflicts", F.lit(0))
    made = M.suggestions(rows)
    return made.select("key", "strategy", "source", "place", F.md5("merged").alias("merged_md5"), "base_score", F.round("relevance_score", 4).alias("relevance_score"))


_SCOPE = "CASE WHEN lang = 'en' THEN 'isolated' WHEN lang = 'fr' THEN 'local' WHEN lang = 'de' THEN 'global' ELSE 'other' END"


@query(
    f"""SELECT doc_id, round(least(1.0, 0.3 / (1.0 + ln(n_chars + 1.0)) + CASE {_SCOPE} WHEN 'isolated' THEN 1.0 WHEN 'local' THEN 0.7 WHEN 'global' THEN 0.3 ELSE 0.5 END * 0.4
    + CASE WHEN source = 'src2' THEN 0.0 ELSE 0.3 END), 4) AS score FROM documents"""
)
def i47_relevance(spark, d):
    docs = view(spark, d, "documents")
    return docs.select("doc_id", F.round(M.relevance(F.col("n_chars"), F.expr(_SCOPE), F.col("source") == "src2"), 4).alias("score"))


_CHOICES = "SELECT user_id, CASE event_type WHEN 'click' THEN 'ours' WHEN 'view' THEN 'theirs' ELSE 'auto' END AS source, value > 50 AS accepted, CAST(floor(value / 20) AS INT) AS n_changes FROM {events}"


def _preferences(spark, d):
    return M.preferences(spark.sql(_CHOICES, events=view(spark, d, "events")), "user_id")


_PREFERENCES = "WITH c AS (" + _CHOICES.replace("{events}", "events") + """), p AS (SELECT user_id, coalesce(sum(w) FILTER (source = 'ours'), 0) AS prefer_ours, coalesce(sum(w) FILTER (source = 'theirs'), 0) AS prefer_theirs,
    coalesce(sum(w) FILTER (n_changes < 3), 0) AS prefer_conservative, coalesce(sum(w) FILTER (n_changes >= 3), 0) AS prefer_aggressive
    FROM (SELECT *, CASE WHEN accepted THEN 0.1::DOUBLE ELSE -0.05::DOUBLE END AS w FROM c) GROUP BY user_id)"""


@query(_PREFERENCES + " SELECT user_id, round(prefer_ours, 4) + 0.0 AS prefer_ours, round(prefer_theirs, 4) + 0.0 AS prefer_theirs, round(prefer_conservative, 4) + 0.0 AS prefer_conservative, round(prefer_aggressive, 4) + 0.0 AS prefer_aggressive FROM p")
def e25_preferences(spark, d):
    p = _preferences(spark, d)
    return p.select("user_id", *[(F.round(c, 4) + 0.0).alias(c) for c in p.columns[1:]])


@query(
    _PREFERENCES
    + " SELECT user_id, round(least(greatest(0.8 + prefer_ours * 0.1 + prefer_conservative * 0.05, 0), 1), 4) AS ours, round(least(greatest(0.8 + prefer_theirs * 0.1 + prefer_conservative * 0.05, 0), 1), 4) AS theirs FROM p"
)
def i48_adjusted_scores(spark, d):
    score = lambda s: F.round(M.adjusted(F.lit(0.8), F.lit(s), F.lit(0)), 4).alias(s)
    return _preferences(spark, d).select("user_id", score("ours"), score("theirs"))


@query()
def m9_merge_report(spark, d):
    """Everything a merge view shows, suggestions ranked with the conflicts that were found."""
    shown = M.assist(_rows(spark, d))
    best = F.transform("suggestions", lambda s: F.struct(s["strategy"].alias("strategy"), s["base_score"].alias("base_score"), F.md5(s["merged"]).alias("merged_md5")))
    return shown.withColumn("suggestions", best)
