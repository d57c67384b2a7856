"""Queries: categories, tags, sensitivity and small text functions."""

from __future__ import annotations

import mimetypes

from pyspark.sql import functions as F

from docloom.functions import classify as C
from docloom.functions import text as T
from docloom.functions import vector as V
from docloom.operators.registry import query
from docloom.plans.fixtures import cte, view

_PART = "regexp_replace(p_name || '_' || p_type || CASE WHEN p_size % 4 = 0 THEN ' report' WHEN p_size % 4 = 1 THEN '-setup' ELSE '' END, ' ', '-', 'g') || CASE WHEN p_size % 3 = 0 THEN '.pdf' WHEN p_size % 3 = 1 THEN '.PY' ELSE '' END"


def _names(spark, d):
    """File names made of part names."""
    end = F.expr("CASE WHEN p_size % 4 = 0 THEN ' report' WHEN p_size % 4 = 1 THEN '-setup' ELSE '' END")
    ext = F.expr("CASE WHEN p_size % 3 = 0 THEN '.pdf' WHEN p_size % 3 = 1 THEN '.PY' ELSE '' END")
    return view(spark, d, "part").select("p_partkey", F.concat(F.regexp_replace(F.concat("p_name", F.lit("_"), "p_type", end), " ", "-"), ext).alias("path"))


def _rules(value: str, rules, flags: str = "(?i)") -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({value}, '{flags}{p}') THEN '{label}'" for p, label in rules) + " END"


_WORDS = "regexp_replace(path, '[_\\-.]+', ' ', 'g')"
_EXT = "CASE lower(regexp_extract(path, '[^.](\\.[^.]+)$', 1)) " + " ".join(f"WHEN '{e}' THEN '{c}'" for e, c in C.EXTENSIONS.items()) + " END"


@query(f"SELECT p_partkey, {_rules(_WORDS, C.NAME_RULES)} AS category FROM (SELECT p_partkey, {_PART} AS path FROM part)")
def i21_classify_filename(spark, d):
    return _names(spark, d).select("p_partkey", C.by_filename(F.col("path")).alias("category"))


@query(f"SELECT p_partkey, {_EXT} AS category FROM (SELECT p_partkey, {_PART} AS path FROM part)")
def i22_classify_extension(spark, d):
    return _names(spark, d).select("p_partkey", C.by_extension(F.col("path")).alias("category"))


_MIMES = sorted({t for e in C.EXTENSIONS if (t := mimetypes.guess_type("x" + e)[0])})


_KIND_OF = {m: next((c for p, c in C.MIME_RULES if m.startswith(p)), "Documents/General" if m in C.GENERAL_MIMES else None) for m in _MIMES}


@query(
    "SELECT p_partkey, mime, category FROM (SELECT p_partkey, [" + ", ".join(f"'{m}'" for m in _MIMES) + f"][p_partkey % {len(_MIMES)} + 1] AS mime FROM part) JOIN (VALUES "
    + ", ".join(f"('{m}', {repr(c) if c else 'NULL'})" for m, c in _KIND_OF.items())
    + ") t(mime, category) USING (mime)"
)
def i23_classify_mime(spark, d):
    """Each part stands for a file of one of the known types."""
    mime = F.element_at(F.array(*map(F.lit, _MIMES)), (F.col("p_partkey") % len(_MIMES) + 1).cast("int"))
    return view(spark, d, "part").select("p_partkey", mime.alias("mime")).withColumn("category", C.by_mime(F.col("mime")))


_CONTENT = f"coalesce({_rules('substring(text, 1, 1500)', C.CONTENT_RULES)}, {_rules('lower(substring(text, 1, 1500))', C.LATE_WORDS, '')})"


@query(f"SELECT doc_id, {_CONTENT} AS category FROM documents")
def i24_classify_content(spark, d):
    return view(spark, d, "documents").select("doc_id", C.by_content(F.col("text")).alias("category"))


@query(
    cte("fx_files")
    + f"SELECT file_id, coalesce({_rules(_WORDS.replace('path', 'name'), C.NAME_RULES)}, {_EXT.replace('path', 'name')}, {_CONTENT}, 'Other') AS category FROM (SELECT file_id, regexp_replace(filename, '\\.md$', '') AS name, text FROM fx_files JOIN documents ON doc_id = file_id)"
)
def i25_classify_cascade(spark, d):
    files = view(spark, d, "fx_files").select("file_id", F.regexp_replace("filename", r"\.md$", "").alias("name"))
    rows = files.join(view(spark, d, "documents").select(F.col("doc_id").alias("file_id"), "text"), "file_id")
    return rows.select("file_id", C.category(F.col("name"), None, F.col("text")).alias("category"))


#: What a model may answer about a turn: a label, a quoted one, a sentence with one in it, the turn itself.
_LABEL = "['" + "', '".join(C.CATEGORIES) + f"'][CAST((conv_id + turn) % {len(C.CATEGORIES)} AS INT) + 1]"
_FIRST = "CASE " + " ".join(f"WHEN contains(low, '{c.lower()}') THEN '{c}'" for c in C.CATEGORIES) + " END"


@query(
    f"""SELECT conv_id, turn, coalesce(CASE {" ".join(f"WHEN low = '{c.lower()}' THEN '{c}'" for c in C.CATEGORIES)} END, {_FIRST}) AS category FROM (
    SELECT conv_id, turn, lower(regexp_replace(trim(answer), '^["''`]+|["''`]+$', '', 'g')) AS low FROM (
    SELECT conv_id, turn, CASE (conv_id * 3 + turn) % 4 WHEN 0 THEN {_LABEL} WHEN 1 THEN '"' || lower({_LABEL}) || '"' WHEN 2 THEN 'I think that it is ' || {_LABEL} || ', mostly.' ELSE text END AS answer FROM conversations))"""
)
def i26_clean_label(spark, d):
    label = F.element_at(F.array(*map(F.lit, C.CATEGORIES)), ((F.col("conv_id") + F.col("turn")) % len(C.CATEGORIES) + 1).cast("int"))
    form = (F.col("conv_id") * 3 + F.col("turn")) % 4
    answer = F.when(form == 0, label).when(form == 1, F.concat(F.lit('"'), F.lower(label), F.lit('"'))).when(form == 2, F.concat(F.lit("I think that it is "), label, F.lit(", mostly."))).otherwise(F.col("text"))
    return view(spark, d, "conversations").select("conv_id", "turn", C.clean_label(answer).alias("category"))


@query(
    r"""SELECT p_partkey, array_to_string(list_filter([t1, t2, t3], lambda x: x <> ''), ',') AS tags FROM (
    SELECT p_partkey, trim(replace(regexp_replace(lower(trim(p_name)), '[^a-z0-9\- ]+', '', 'g'), ' ', '-'), '-') AS t1,
    CASE WHEN a = b THEN '' ELSE trim(replace(b, ' ', '-'), '-') END AS t2, '' AS t3
    FROM (SELECT p_partkey, p_name, regexp_replace(lower(trim(p_name)), '[^a-z0-9\- ]+', '', 'g') AS a, regexp_replace(lower(trim(p_brand)), '[^a-z0-9\- ]+', '', 'g') AS b FROM part))"""
)
def i8_normal_tags(spark, d):
    tags = F.array("p_name", "p_brand", F.lit(" !? "), F.upper("p_name"))
    return view(spark, d, "part").select("p_partkey", F.array_join(T.normal_tags(tags), ",").alias("tags"))


@query("SELECT p_partkey, lower(replace(p_brand, '#', '')) || ',' || replace(lower(trim(p_type)), ' ', '-') AS tags FROM part")
def i9_base_tags(spark, d):
    return view(spark, d, "part").select("p_partkey", F.array_join(T.category_tags(F.concat_ws("/", "p_brand", "p_type")), ",").alias("tags"))


@query(
    """WITH tags AS (SELECT label AS tag, embedding AS tv FROM embeddings e WHERE vec_id = (SELECT min(vec_id) FROM embeddings f WHERE f.label = e.label)),
    scored AS (SELECT vec_id, tag, round(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(tv AS DOUBLE[])), 4) AS score FROM embeddings, tags)
    SELECT vec_id, tag, score FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, tag) AS place FROM scored WHERE score > 0.2) WHERE place <= 6"""
)
def i27_tag_similarity(spark, d):
    """The first vector of each label stands for a tag of the taxonomy."""
    e = view(spark, d, "embeddings")
    tags = e.groupBy(F.col("label").alias("tag")).agg(F.min_by("embedding", "vec_id").alias("embedding"))
    return V.best_choices(e, tags, 6, 0.2)


_SENSITIVE = "(regexp_matches(lower(text), '" + "|".join(C.SENSITIVE_WORDS) + "') OR " + " OR ".join(f"regexp_matches(text, '{p}')" for p in C.SENSITIVE_PATTERNS) + ")"


@query(f"SELECT doc_id, {_SENSITIVE} AS sensitive FROM documents")
def c14_sensitivity(spark, d):
    return view(spark, d, "documents").select("doc_id", C.sensitive(F.col("text")).alias("sensitive"))


_LEVEL = "CASE WHEN contains(message, '[error]') THEN 'error' WHEN regexp_matches(lower(message), 'warn|deprecated|timeout|retrying|skipping') THEN 'warning' WHEN regexp_matches(lower(message), '✅|done|success|complete|\\[ok\\]|healthy|ready|loaded') THEN 'success' ELSE 'info' END"


@query(cte("fx_logs") + f"SELECT {_LEVEL} AS level, count(*) AS n FROM fx_logs GROUP BY 1")
def e20_level_counts(spark, d):
    return view(spark, d, "fx_logs").groupBy(T.log_level(F.col("message"), F.col("message").contains("[error]")).alias("level")).agg(F.count("*").alias("n"))


@query(cte("fx_logs") + f"SELECT log_id, regexp_extract(message, '^\\[(.*?)\\]', 1) AS category, {_LEVEL} AS level FROM fx_logs")
def i13_log_levels(spark, d):
    return view(spark, d, "fx_logs").select("log_id", T.log_prefix(F.col("message")).alias("category"), T.log_level(F.col("message"), F.col("message").contains("[error]")).alias("level"))


@query(cte("fx_logs") + f"SELECT log_id, message FROM fx_logs WHERE {_LEVEL} = 'warning' AND regexp_extract(message, '^\\[(.*?)\\]', 1) IN ('purchase', 'view') AND contains(lower(message), 'user 1')")
def c9_log_filter(spark, d):
    m = F.col("message")
    rows = view(spark, d, "fx_logs").where((T.log_level(m, m.contains("[error]")) == "warning") & T.log_prefix(m).isin("purchase", "view") & F.lower(m).contains("user 1"))
    return rows.select("log_id", "message")


_CHANGE = "CASE " + " ".join(f"WHEN regexp_matches({{0}}, '{p}') THEN '{t}'" for t, p in C.CHANGE_TYPES) + " ELSE 'generic' END"


@query(f"SELECT conv_id, turn, {_CHANGE.format('text')} AS change_type FROM conversations")
def i31_change_type(spark, d):
    return view(spark, d, "conversations").select("conv_id", "turn", C.change_type(F.col("text")).alias("change_type"))


@query(
    f"SELECT conv_id, turn, CASE role WHEN 'user' THEN 'Added ' || {_CHANGE.format('h')} || ': ' || trim(h) WHEN 'assistant' THEN 'Removed ' || {_CHANGE.format('h')} || ': ' || trim(h) ELSE 'Changed: ' || trim(h) END AS sentence FROM (SELECT *, substring(text, 1, 100) AS h FROM conversations)"
)
def m8_change_summary(spark, d):
    op = F.when(F.col("role") == "user", "insert").when(F.col("role") == "assistant", "delete").otherwise("other")
    return view(spark, d, "conversations").select("conv_id", "turn", C.change_sentence(op, F.col("text")).alias("sentence"))


_TOY_DIFF = "chr(10) || '+' || replace(text, ' ', chr(10) || CASE WHEN doc_id % 2 = 0 THEN '+' ELSE '-' END)"


@query(
    f"""SELECT doc_id, CASE WHEN a > r * 2 THEN 'Major feature additions detected.' WHEN r > a * 2 THEN 'Significant content removal detected.' WHEN a > 0 OR r > 0 THEN 'Minor modifications made.' ELSE 'No significant changes.' END AS summary,
    CASE WHEN contains(x, 'def ') OR contains(x, 'class ') THEN 'Feature Update' WHEN contains(x, 'try:') OR contains(x, 'except') THEN 'Bug Fix' WHEN contains(x, 'import ') THEN 'Dependency Change' WHEN r > 20 THEN 'Deletion Heavy' ELSE 'Refactor' END AS intent
    FROM (SELECT doc_id, x, (length(x) - length(replace(x, chr(10) || '+', ''))) // 2 AS a, (length(x) - length(replace(x, chr(10) || '-', ''))) // 2 AS r FROM (SELECT doc_id, {_TOY_DIFF} AS x FROM documents))"""
)
def i28_diff_summary(spark, d):
    x = F.expr(_TOY_DIFF.replace("chr(10)", "char(10)"))
    rows = view(spark, d, "documents").select("doc_id", x.alias("x"))
    return rows.select("doc_id", C.diff_summary(F.col("x")).alias("summary"), C.diff_intent(F.col("x")).alias("intent"))


@query(
    """SELECT doc_id, n_chars, CASE WHEN v = trunc(v) THEN CAST(CAST(v AS BIGINT) AS VARCHAR) ELSE regexp_replace(printf('%.2f', v), '0$', '') END || ' ' || ['B', 'KB', 'MB', 'GB', 'TB'][u + 1] AS size
    FROM (SELECT doc_id, n_chars, u, round(b / pow(1024.0, u), 2) AS v FROM (SELECT doc_id, n_chars, n_chars * n_chars AS b, CAST(greatest(0, least(4, floor(log2(greatest(n_chars * n_chars, 1)) / 10))) AS INT) AS u FROM documents))"""
)
def i15_human_size(spark, d):
    return view(spark, d, "documents").select("doc_id", "n_chars", T.human_size(F.col("n_chars") * F.col("n_chars")).alias("size"))


@query("SELECT doc_id, md5(regexp_replace(text, '(there|the|and)', '<mark>\\1</mark>', 'gi')) AS marked_md5 FROM documents")
def i12_highlight(spark, d):
    return view(spark, d, "documents").select("doc_id", F.md5(T.highlight(F.col("text"), "the and there")).alias("marked_md5"))


@query(cte("fx_files") + "SELECT file_id, regexp_replace(path, '/[^/]*$', '') AS parent, array_to_string(list_filter(string_split(path, '/'), lambda p: p <> ''), ' > ') AS crumbs FROM fx_files")
def i20_breadcrumbs(spark, d):
    p = F.col("path")
    return view(spark, d, "fx_files").select("file_id", T.parent_path(p).alias("parent"), T.breadcrumb(p).alias("crumbs"))


@query(r"SELECT page_id, regexp_replace(url, '[^\p{L}\p{N}._\- ]', '', 'g') AS name FROM pages")
def i16_safe_filename(spark, d):
    return view(spark, d, "pages").select("page_id", T.safe_filename(F.col("url")).alias("name"))


@query(cte("fx_files") + "SELECT file_id, replace(substring(path, 8), '\\', '/') AS rel, rtrim(lower(path), '/') AS norm FROM fx_files")
def i7_relative_paths(spark, d):
    p = F.col("path")
    return view(spark, d, "fx_files").select("file_id", T.relative_path(p, "/vault").alias("rel"), T.normal_path(p).alias("norm"))


@query(cte("fx_files") + "SELECT file_id, CASE regexp_extract(filename, '(\\.[^.]+)$', 1) WHEN '.docx' THEN 'word' ELSE 'text' END AS kind FROM fx_files")
def i32_version_format(spark, d):
    return view(spark, d, "fx_files").select("file_id", C.version_format(F.col("filename")).alias("kind"))


