"""Queries: versions, differences and risk."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.functions import dates as D
from docloom.operators import diff as X
from docloom.operators import versions as V
from docloom.operators.registry import query
from docloom.plans.fixtures import NOW, cte, view

_VERSIONS = cte("fx_versions") + f", v AS (SELECT file_id, version, {NOW} - age_days * 86400 AS stamp, sha256(replace(content, chr(13) || chr(10), chr(10))) AS hash, length(content) AS size FROM fx_versions)"


def _versions(spark, d):
    v = view(spark, d, "fx_versions")
    return v.select("file_id", "version", (F.lit(NOW).cast("long") - F.col("age_days") * 86400).alias("stamp"), V.content_hash(F.col("content")).alias("hash"), F.length("content").cast("long").alias("size"))


def _pairs(spark, d):
    """Version 1 against version 3 of each file."""
    v = view(spark, d, "fx_versions")
    a = v.where("version = 1").select(F.col("file_id").alias("key"), F.col("content").alias("old"))
    return a.join(v.where("version = 3").select(F.col("file_id").alias("key"), F.col("content").alias("new")), "key")


_PAIRS = cte("fx_versions") + ", pairs AS (SELECT a.file_id AS key, a.content AS old, b.content AS new FROM fx_versions a JOIN fx_versions b ON a.file_id = b.file_id AND a.version = 1 AND b.version = 3)"


@query(
    _VERSIONS
    + """ SELECT file_id, version, n AS number, lag(version) OVER w AS parent, CASE WHEN n > 1 AND n % 3 <> 1 THEN 'diff' ELSE 'full' END AS storage
    FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY stamp, version) AS n FROM v) WINDOW w AS (PARTITION BY file_id ORDER BY stamp, version)"""
)
def f4_version_timeline(spark, d):
    return V.timeline(_versions(spark, d)).select("file_id", "version", "number", "parent", "storage")


@query(_VERSIONS + " SELECT file_id, arg_max(version, (stamp, version)) AS version, max(stamp) AS stamp FROM v GROUP BY file_id")
def f2_latest_version(spark, d):
    return V.latest(_versions(spark, d)).select("file_id", "version", "stamp")


@query(_VERSIONS + " SELECT file_id, version, nullif(first_value(version) OVER (PARTITION BY file_id, hash ORDER BY stamp, version), version) AS reused FROM v")
def l7_reused_storage(spark, d):
    return V.reused_storage(_versions(spark, d)).select("file_id", "version", "reused")


@query(_VERSIONS + " SELECT file_id, version FROM (SELECT *, lag(hash) OVER (PARTITION BY file_id ORDER BY stamp, version) AS b FROM v) WHERE b IS NULL OR b <> hash")
def f8_changed_only(spark, d):
    return V.changed_only(_versions(spark, d)).select("file_id", "version")


_KEPT = _VERSIONS + f""", aged AS (SELECT *, ({NOW} - stamp) // 86400 AS age, nullif(first_value(version) OVER (PARTITION BY file_id, hash ORDER BY stamp, version), version) AS reused FROM v),
    kept AS (SELECT *, age <= 30 OR (age <= 365 AND n = 1) AS keep FROM (SELECT *, row_number() OVER (PARTITION BY file_id, CASE WHEN age > 30 AND age <= 365 THEN stamp // 86400 END ORDER BY stamp DESC, version DESC) AS n FROM aged))"""


@query(_KEPT + " SELECT file_id, version, age, keep FROM kept")
def l13_retention(spark, d):
    return V.retention(_versions(spark, d), NOW).select("file_id", "version", "age", "keep")


@query(
    _KEPT
    + """, used AS (SELECT DISTINCT file_id, coalesce(reused, version) AS version FROM kept WHERE keep)
    SELECT k.file_id, count(*) AS deleted, CAST(coalesce(sum(size) FILTER (k.reused IS NULL AND u.version IS NULL), 0) AS BIGINT) AS freed_bytes
    FROM kept k LEFT JOIN used u ON u.file_id = k.file_id AND u.version = k.version WHERE NOT keep GROUP BY k.file_id"""
)
def d12_retention_protected(spark, d):
    return V.freed(V.retention(V.reused_storage(_versions(spark, d)), NOW))


@query(cte("fx_versions") + "SELECT CASE WHEN age_days <= 7 THEN 'week' WHEN age_days <= 30 THEN 'month' WHEN age_days <= 365 THEN 'year' ELSE 'older' END AS band, count(*) AS n FROM fx_versions GROUP BY 1")
def i35_age_bands(spark, d):
    return _versions(spark, d).groupBy(D.age_band(D.age_days(F.col("stamp"), NOW)).alias("band")).agg(F.count("*").alias("n"))


@query(cte("fx_versions") + f"SELECT file_id, version, {NOW} - age_days * 86400 AS parsed FROM fx_versions")
def i36_version_time(spark, d):
    stamp = F.date_format(F.timestamp_seconds("stamp"), "yyyyMMddHHmmss")
    return _versions(spark, d).select("file_id", "version", D.version_time(F.concat(stamp, F.lit("000000_abcd"))).alias("parsed"))


@query("SELECT doc_id, lower(sha256(replace(text, chr(13) || chr(10), chr(10)))) AS hash, md5(text) AS digest FROM documents")
def i52_content_hash(spark, d):
    return view(spark, d, "documents").select("doc_id", V.content_hash(F.col("text")).alias("hash"), F.md5("text").alias("digest"))


def _blocks(spark, d):
    """Blocks of 512 bytes here, so that the documents have several."""
    docs = view(spark, d, "documents").select("doc_id", "text")
    return V.blocks(docs, "text", 512)


@query(
    """SELECT doc_id, b AS block, sha256(unhex(substring(h, b * 1024 + 1, 1024))) AS block_hash FROM (
    SELECT doc_id, h, unnest(generate_series(0, greatest(CAST(ceil(length(h) / 1024.0) AS BIGINT) - 1, 0))) AS b FROM (SELECT doc_id, hex(encode(text)) AS h FROM documents))"""
)
def i54_block_recipe(spark, d):
    return _blocks(spark, d).select("doc_id", "block", "block_hash")


@query("SELECT doc_id, md5(text) AS content_md5 FROM documents WHERE length(text) > 0")
def l10_rebuild_content(spark, d):
    """Contents put together again from recipes and the store of distinct blocks."""
    cut = _blocks(spark, d).where(F.octet_length("data") > 0)
    store = cut.select("block_hash", "data").dropDuplicates(["block_hash"])
    return V.rebuild(V.recipe(cut, "doc_id"), store, "doc_id").select("doc_id", F.md5("content").alias("content_md5"))


@query(
    """WITH b AS (SELECT doc_id, lang, sha256(unhex(substring(h, b * 1024 + 1, 1024))) AS block_hash FROM (
    SELECT doc_id, lang, h, unnest(generate_series(0, greatest(CAST(ceil(length(h) / 1024.0) AS BIGINT) - 1, 0))) AS b FROM (SELECT doc_id, lang, hex(encode(text)) AS h FROM documents)))
    SELECT DISTINCT block_hash FROM b WHERE block_hash NOT IN (SELECT block_hash FROM b WHERE lang = 'en')"""
)
def l14_orphan_blocks(spark, d):
    """Blocks left over when only the English documents' recipes remain."""
    docs = view(spark, d, "documents").select("doc_id", "lang", "text")
    cut = V.blocks(docs, "text", 512)
    kept = V.recipe(cut.where("lang = 'en'"), "doc_id")
    return V.orphans(cut.select("block_hash").distinct(), kept)


@query(cte("fx_versions") + "SELECT a.file_id, a.version, sha256(replace(a.content, chr(13) || chr(10), chr(10))) = sha256(replace(b.content, chr(13) || chr(10), chr(10))) AS ok FROM fx_versions a JOIN fx_versions b ON a.file_id = b.file_id AND b.version = 1")
def l12_integrity_check(spark, d):
    """Each version against the hash of the first one."""
    v = view(spark, d, "fx_versions")
    first = v.where("version = 1").select("file_id", V.content_hash(F.col("content")).alias("hash"))
    return V.intact(v.join(first, "file_id")).select("file_id", "version", "ok")


@query("SELECT p_brand AS path, CAST(max(p_size) + 1 AS BIGINT) AS next_version FROM part GROUP BY 1 UNION ALL SELECT n_name, 1 FROM nation")
def e3_next_version(spark, d):
    versions = view(spark, d, "part").select(F.col("p_brand").alias("path"), F.col("p_size").cast("long").alias("version"))
    paths = versions.select("path").union(view(spark, d, "nation").select("n_name"))
    return V.next_number(versions, paths)


@query(_VERSIONS + " SELECT CAST(file_id AS VARCHAR) || '_' || CAST(version AS VARCHAR) AS version_id FROM v WHERE version <> 2 UNION ALL SELECT CAST(file_id AS VARCHAR) || '_2' FROM v WHERE version = 2")
def d10_merge_listings(spark, d):
    """The index lacks the second versions, the legacy files the first ones."""
    ids = _versions(spark, d).select(F.concat_ws("_", F.col("file_id").cast("string"), F.col("version").cast("string")).alias("version_id"), "version")
    return V.merge_listings(ids.where("version <> 2"), ids.where("version <> 1")).select("version_id")


@query(
    _PAIRS
    + """ SELECT key, CASE WHEN trim(old) IN ('', '{}', '[]', 'None') OR greatest(length(old), length(new)) = 0 THEN 1.0
    ELSE round(greatest(0.05, least((1.0::DOUBLE - abs(length(new) - length(old)) / greatest(length(old), length(new))) * (1.0::DOUBLE - 0.3::DOUBLE * 0.7), 1.0)), 3) END AS stability FROM pairs"""
)
def l5_stability(spark, d):
    return _pairs(spark, d).select("key", V.stability(F.col("old"), F.col("new"), F.lit(0.3)).alias("stability"))


_ENTROPY = "(SELECT coalesce(log2(sum(n)) - sum(n * log2(n)) / sum(n), 0) FROM (SELECT count(*)::DOUBLE AS n FROM (SELECT unnest(string_split({0}, '')) AS c) WHERE c <> '' GROUP BY c))"


@query("SELECT doc_id, round(coalesce(log2(sum(n)) - sum(n * log2(n)) / sum(n), 0), 4) AS entropy FROM (SELECT doc_id, c, count(*)::DOUBLE AS n FROM (SELECT doc_id, unnest(string_split(text, '')) AS c FROM documents) WHERE c <> '' GROUP BY doc_id, c) GROUP BY doc_id")
def i44_entropy(spark, d):
    return view(spark, d, "documents").where("text <> ''").select("doc_id", F.round(X.entropy(F.col("text")), 4).alias("entropy"))


@query(
    r"""WITH l AS (SELECT doc_id, row_number() OVER () AS id, line FROM (SELECT doc_id, unnest(string_split(regexp_replace(text, '\n$', ''), chr(10))) AS line FROM documents)),
    h AS (SELECT id, log2(sum(n)) - sum(n * log2(n)) / sum(n) AS h FROM (SELECT id, c, count(*)::DOUBLE AS n FROM (SELECT id, unnest(string_split(line, '')) AS c FROM l) WHERE c <> '' GROUP BY id, c) GROUP BY id)
    SELECT doc_id, count(*) AS n_lines, round(sum(CASE WHEN line = '' THEN 0 WHEN length(line) > 120 AND regexp_full_match(line, '[A-Za-z0-9+/=]+') THEN h * 0.1
        ELSE h + len(list_filter(regexp_split_to_array(line, '\s+'), lambda w: w <> '')) + length(regexp_replace(line, '[a-zA-Z0-9\s]', '', 'g')) + length(line) / 80.0::DOUBLE END), 3) AS importance
    FROM l LEFT JOIN h USING (id) GROUP BY doc_id"""
)
def i45_line_importance(spark, d):
    lines = view(spark, d, "documents").select("doc_id", F.explode(X.text_lines(F.col("text"))).alias("line"))
    return lines.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.round(F.sum(X.importance(F.col("line"), F.lit(80.0), X.line_facts(F.col("line")))), 3).alias("importance"))


@query()
def l4_line_risk(spark, d):
    """The scores that lines give, without the likeness of the whole texts."""
    scored = X.risk(X.weigh_lines(_pairs(spark, d)))
    numbers = ["modify_score", "add_score", "delete_score", "block_score", "size_score", "change_score", "risk_score"]
    return scored.select("key", "n_added", "n_removed", "intent", "severity", *[F.round(c, 4).alias(c) for c in numbers])


@query()
def l4_semantic_risk(spark, d):
    """The whole score: lines of the unified diff, and the likeness of the texts."""
    pairs = _pairs(spark, d).withColumn("diff", X.unified_diff("old", "new")).withColumn("ratio", X.likeness("old", "new"))
    scored = X.risk(X.weigh_diff(pairs).join(pairs.select("key", "ratio"), "key"), F.col("ratio"))
    return scored.select("key", "intent", "severity", F.round("change_score", 4).alias("change_score"), F.round("risk_score", 4).alias("risk_score"))


_BLOCKS5 = "list_transform(generate_series(0, (len({0}) - 1) // 5), lambda i: array_to_string({0}[i * 5 + 1 : i * 5 + 5], chr(10)))"


@query(
    _PAIRS
    + r""", s AS (SELECT key, string_split(regexp_replace(old, '\n$', ''), chr(10)) AS a, string_split(regexp_replace(new, '\n$', ''), chr(10)) AS b FROM pairs WHERE old <> '' AND new <> ''),
    k AS (SELECT key, """ + _BLOCKS5.format("a") + " AS x, " + _BLOCKS5.format("b") + """ AS y FROM s)
    SELECT key, len(list_distinct(list_filter(x, lambda q: NOT list_contains(y, q)))) + len(list_distinct(list_filter(y, lambda q: NOT list_contains(x, q)))) AS n_blocks FROM k"""
)
def h3_block_difference(spark, d):
    rows = _pairs(spark, d).where("old <> '' and new <> ''").select("key", X.line_blocks(X.text_lines(F.col("old"))).alias("x"), X.line_blocks(X.text_lines(F.col("new"))).alias("y"))
    return rows.select("key", (F.size(F.array_except("x", "y")) + F.size(F.array_except("y", "x"))).cast("long").alias("n_blocks"))


@query(
    _PAIRS
    + r""", s AS (SELECT key, string_split(regexp_replace(old, '\n$', ''), chr(10)) AS a, string_split(regexp_replace(new, '\n$', ''), chr(10)) AS b FROM pairs WHERE old <> '' AND new <> '')
    SELECT key, len(list_filter(b, lambda x: NOT list_contains(a, x))) AS added, len(list_filter(a, lambda x: NOT list_contains(b, x))) AS removed FROM s"""
)
def h4_line_difference(spark, d):
    a, b = X.text_lines(F.col("old")), X.text_lines(F.col("new"))
    rows = _pairs(spark, d).where("old <> '' and new <> ''").select("key", a.alias("a"), b.alias("b"))
    return rows.select("key", F.size(X.missing_from(F.col("b"), F.col("a"))).cast("long").alias("added"), F.size(X.missing_from(F.col("a"), F.col("b"))).cast("long").alias("removed"))


@query(
    _PAIRS
    + r""" SELECT key, len(string_split(regexp_replace(new, '\n$', ''), chr(10))) - len(string_split(regexp_replace(old, '\n$', ''), chr(10))) AS line_delta,
    round((length(new) - length(old)) / greatest(length(old), 1)::DOUBLE, 4) AS size_change FROM pairs WHERE old <> '' AND new <> ''"""
)
def i30_line_delta(spark, d):
    rows = _pairs(spark, d).where("old <> '' and new <> ''")
    delta = F.size(X.text_lines(F.col("new"))) - F.size(X.text_lines(F.col("old")))
    change = (F.length("new") - F.length("old")) / F.greatest(F.length("old"), F.lit(1))
    return rows.select("key", delta.cast("long").alias("line_delta"), F.round(change, 4).alias("size_change"))


_CELLS = cte("fx_cells_old", "fx_cells_new") + """, c AS (SELECT coalesce(o.sheet, n.sheet) AS sheet, coalesce(o.cell, n.cell) AS cell,
    CASE WHEN o.cell IS NULL THEN 'added' WHEN n.cell IS NULL THEN 'removed' WHEN o.value IS NOT DISTINCT FROM n.value AND o.formula IS NOT DISTINCT FROM n.formula THEN 'same' ELSE 'changed' END AS change,
    o.value AS old_value, n.value AS new_value, o.cell IS NOT NULL AND n.cell IS NOT NULL AND o.formula IS DISTINCT FROM n.formula AS formula_changed
    FROM fx_cells_old o FULL JOIN fx_cells_new n ON o.sheet = n.sheet AND o.cell = n.cell)"""


@query(_CELLS + " SELECT * FROM c WHERE change <> 'same'")
def l3_cell_diff(spark, d):
    return X.cells(view(spark, d, "fx_cells_old"), view(spark, d, "fx_cells_new")).where("change <> 'same'")


@query(
    _CELLS
    + """ SELECT sheet, count(*) FILTER (change <> 'same') AS n_changed, count(*) FILTER (formula_changed) AS n_formulas,
    CASE WHEN count(*) FILTER (change <> 'added') = 0 THEN 'added' WHEN count(*) FILTER (change <> 'removed') = 0 THEN 'removed' ELSE 'kept' END AS status FROM c GROUP BY sheet"""
)
def e17_sheet_summary(spark, d):
    return X.sheet_summary(X.cells(view(spark, d, "fx_cells_old"), view(spark, d, "fx_cells_new")))


@query()
def l1_unified_diff(spark, d):
    return _pairs(spark, d).select("key", F.md5(X.unified_diff("old", "new")).alias("diff_md5"))


@query()
def l2_word_diff(spark, d):
    """Lines stand for the paragraphs of a document."""
    rows = _pairs(spark, d).select("key", F.explode(X.word_diff(X.paragraphs(F.col("old")), X.paragraphs(F.col("new")))).alias("c"))
    return rows.groupBy("key", "c.type").agg(F.count("*").alias("n"), F.sum("c.words_added").alias("words_added"), F.sum("c.words_removed").alias("words_removed"))


#: A question of each form of the grammar about the date of an order, and one without a date.
_QUESTION = {
    "spark": """SELECT o_orderkey, o_orderdate AS d, CASE o_orderkey % 5 WHEN 0 THEN concat('invoices from ', lower(date_format(o_orderdate, 'MMMM')), date_format(o_orderdate, ' yyyy'))
        WHEN 1 THEN concat('report ', date_format(o_orderdate, 'yyyy-MM-dd')) WHEN 2 THEN concat('contracts in ', date_format(o_orderdate, 'yyyy'))
        WHEN 3 THEN concat('budget ', date_format(o_orderdate, 'd MMMM yyyy')) ELSE concat('letter ', o_orderpriority) END AS question FROM {orders}""",
    "sql": """SELECT o_orderkey, o_orderdate AS d, CASE o_orderkey % 5 WHEN 0 THEN concat('invoices from ', lower(strftime(o_orderdate, '%B')), strftime(o_orderdate, ' %Y'))
        WHEN 1 THEN concat('report ', strftime(o_orderdate, '%Y-%m-%d')) WHEN 2 THEN concat('contracts in ', strftime(o_orderdate, '%Y'))
        WHEN 3 THEN concat('budget ', strftime(o_orderdate, '%-d %B %Y')) ELSE concat('letter ', o_orderpriority) END AS question FROM orders""",
}


@query(
    "WITH q AS (" + _QUESTION["sql"] + """), u AS (SELECT *, CASE o_orderkey % 5 WHEN 0 THEN 'month' WHEN 2 THEN 'year' WHEN 4 THEN NULL ELSE 'day' END AS unit FROM q)
    SELECT o_orderkey, question, CASE WHEN unit IS NULL THEN question ELSE split_part(question, ' ', 1) END AS clean_query, unit IS NOT NULL AS badge,
           CAST(epoch(CASE unit WHEN 'month' THEN date_trunc('month', d) WHEN 'year' THEN date_trunc('year', d) WHEN 'day' THEN d END) AS BIGINT) AS date_from,
           CAST(epoch(CASE unit WHEN 'month' THEN date_trunc('month', d) + INTERVAL 1 MONTH WHEN 'year' THEN date_trunc('year', d) + INTERVAL 1 YEAR WHEN 'day' THEN d + INTERVAL 1 DAY END) AS BIGINT) - 1 AS date_to
    FROM u"""
)
def i33_date_questions(spark, d):
    asked = spark.sql(_QUESTION["spark"], orders=view(spark, d, "orders"))
    return asked.withColumn("p", D.date_parser(NOW)("question")).select("o_orderkey", "question", "p.*", D.has_date(F.col("question")).alias("badge"))


_SHOWN = "list_transform(range(1, len({0}) + 1), lambda i: CAST(to_json({0}[i]) AS VARCHAR) || CASE WHEN i < len({0}) THEN ',' ELSE '' END)"


@query(
    cte("fx_versions")
    + f""", p AS (SELECT a.file_id AS key, list_filter(string_split(a.content, chr(10)), lambda x: trim(x) <> '') AS a, list_filter(string_split(b.content, chr(10)), lambda x: trim(x) <> '') AS b
        FROM fx_versions a JOIN fx_versions b ON a.file_id = b.file_id AND a.version = 1 AND b.version = 2),
    l AS (SELECT key, {_SHOWN.format("a")} AS a, {_SHOWN.format("b")} AS b FROM p WHERE len(a) > 0 AND len(b) > 0)
    SELECT key, len(list_filter(b, lambda x: NOT list_contains(a, x))) AS added, len(list_filter(a, lambda x: NOT list_contains(b, x))) AS removed FROM l"""
)
def i60_structure_lines(spark, d):
    """Structures of paragraphs as indented text: the lines that only one of two versions has."""
    v = view(spark, d, "fx_versions")
    side = lambda n, c: v.where(f"version = {n}").select(F.col("file_id").alias("key"), X.paragraphs(F.col("content")).alias(c))
    rows = side(1, "a").join(side(2, "b"), "key").where("size(a) > 0 AND size(b) > 0")
    lines = rows.select("key", *[F.split(X.structure_text(F.to_json(F.struct(F.col(c).alias("paragraphs")))), "\n").alias(c) for c in "ab"])
    return lines.select("key", F.size(X.missing_from("b", "a")).cast("long").alias("added"), F.size(X.missing_from("a", "b")).cast("long").alias("removed"))
