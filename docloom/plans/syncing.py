"""Queries: trees, blocks and clocks of two replicas."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.operators import events as E
from docloom.operators import sync as S
from docloom.operators import versions as V
from docloom.operators.registry import query
from docloom.plans.fixtures import cte, view

_TREES = cte("fx_local_tree", "fx_remote_tree")
_CHANGED = """changed AS (SELECT coalesce(l.filepath, r.filepath) AS filepath, CASE WHEN r.filepath IS NULL THEN 'deleted' WHEN l.filepath IS NULL THEN 'added' ELSE 'modified' END AS change,
    CASE WHEN r.filepath IS NULL THEN 'local_only' WHEN l.filepath IS NULL THEN 'remote_only' ELSE 'both' END AS side
    FROM fx_local_tree l FULL JOIN fx_remote_tree r ON l.filepath = r.filepath WHERE l.checksum IS DISTINCT FROM r.checksum)"""


def _changed(spark, d):
    return S.tree_diff(view(spark, d, "fx_local_tree"), view(spark, d, "fx_remote_tree"))


@query(_TREES + "," + _CHANGED + " SELECT * FROM changed")
def d5_tree_diff(spark, d):
    return _changed(spark, d)


@query(_TREES + "SELECT split_part(filepath, '/', 3) AS folder, md5(string_agg(filepath || ':' || checksum, '' ORDER BY filepath)) AS root, count(*) AS n_files FROM fx_local_tree GROUP BY 1")
def e10_tree_roots(spark, d):
    tree = view(spark, d, "fx_local_tree").withColumn("folder", F.element_at(F.split("filepath", "/"), 3))
    return S.tree_root(tree, "folder")


_VERDICT = """clocks AS (SELECT filepath, device, coalesce(max(counter) FILTER (side = 'local'), 0) AS a, coalesce(max(counter) FILTER (side = 'remote'), 0) AS b FROM fx_clocks GROUP BY filepath, device),
    verdicts AS (SELECT filepath, CASE WHEN bool_or(a > b) AND bool_or(a < b) THEN 'conflict' WHEN bool_or(a > b) THEN 'local_wins' WHEN bool_or(a < b) THEN 'remote_wins' ELSE 'identical' END AS verdict FROM clocks GROUP BY filepath)"""


def _verdicts(spark, d):
    return S.clock_maps(view(spark, d, "fx_clocks")).select("filepath", S.compare_clocks(F.col("local"), F.col("remote")).alias("verdict"))


@query(cte("fx_clocks") + "," + _VERDICT + " SELECT * FROM verdicts")
def i57_clock_compare(spark, d):
    return _verdicts(spark, d)


@query(cte("fx_clocks") + "," + _VERDICT + " SELECT filepath, device, greatest(a, b) AS counter FROM clocks")
def i57_clock_merge(spark, d):
    merged = S.clock_maps(view(spark, d, "fx_clocks")).select("filepath", F.explode(S.merge_clocks(F.col("local"), F.col("remote"))).alias("device", "counter"))
    return merged


@query(cte("fx_clocks") + "," + _VERDICT + " SELECT filepath, device, a + CASE WHEN device = 'pc' THEN 1 ELSE 0 END AS counter FROM clocks")
def i57_clock_tick(spark, d):
    maps = S.clock_maps(view(spark, d, "fx_clocks"))
    return maps.select("filepath", F.explode(S.tick(F.col("local"), "pc")).alias("device", "counter"))


_ACTION = """CASE WHEN verdict = 'conflict' THEN 'conflict' WHEN change = 'deleted' THEN CASE WHEN verdict = 'remote_wins' THEN 'delete_local' ELSE 'send_delta' END
    WHEN change = 'added' THEN CASE WHEN verdict = 'local_wins' THEN 'send_delete' ELSE 'request_delta' END WHEN verdict IN ('local_wins', 'identical') THEN 'send_delta' ELSE 'request_delta' END"""


@query(cte("fx_local_tree", "fx_remote_tree", "fx_clocks") + "," + _CHANGED + "," + _VERDICT + f" SELECT filepath, change, coalesce(verdict, 'identical') AS verdict, {_ACTION} AS action, CASE change WHEN 'added' THEN 'request_delta' WHEN 'deleted' THEN 'send_delta' ELSE {_ACTION} END AS desktop_action FROM changed LEFT JOIN verdicts USING (filepath)")
def p_sync_resolution(spark, d):
    rows = _changed(spark, d).join(_verdicts(spark, d), "filepath", "left").withColumn("verdict", F.coalesce("verdict", F.lit("identical")))
    change, verdict = F.col("change"), F.col("verdict")
    return rows.select("filepath", "change", "verdict", S.resolve(change, verdict).alias("action"), S.push_or_pull(change, verdict).alias("desktop_action"))


_BLOCK_SQL = """SELECT filepath, b AS block, md5(unhex(substring(h, b * 1024 + 1, 1024))) AS block_hash FROM (
    SELECT filepath, h, unnest(generate_series(0, greatest(CAST(ceil(length(h) / 1024.0) AS BIGINT) - 1, 0))) AS b FROM (SELECT '/d/' || CAST(doc_id AS VARCHAR) AS filepath, hex(encode({0})) AS h FROM documents))"""


def _side(spark, d, text):
    docs = view(spark, d, "documents").select(F.concat(F.lit("/d/"), F.col("doc_id").cast("string")).alias("filepath"), text.alias("text"))
    return V.blocks(docs, "text", 512, "md5")


def _edited():
    return F.when(F.col("lang") == "fr", F.concat("text", F.lit(" end"))).otherwise(F.col("text"))


_EDITED = "CASE WHEN lang = 'fr' THEN text || ' end' ELSE text END"


@query(_BLOCK_SQL.format("text"))
def i53_block_checksums(spark, d):
    return _side(spark, d, F.col("text")).select("filepath", "block", "block_hash")


_DELTA = f"WITH a AS ({_BLOCK_SQL.format(_EDITED)}), b AS ({_BLOCK_SQL.format('text')}), delta AS (SELECT a.* FROM a LEFT JOIN b USING (filepath, block) WHERE a.block_hash IS DISTINCT FROM b.block_hash)"


def _delta(spark, d):
    return S.changed_blocks(_side(spark, d, _edited()), _side(spark, d, F.col("text")))


@query(_DELTA + " SELECT filepath, block, block_hash FROM delta")
def d6_block_delta(spark, d):
    return _delta(spark, d).select("filepath", "block", "block_hash")


@query(_DELTA + " SELECT filepath, count(*) AS n_blocks, CAST(greatest(1, ceil(count(*) / 50.0)) AS BIGINT) AS n_packets FROM delta GROUP BY filepath")
def i50_delta_packets(spark, d):
    return S.packets(_delta(spark, d))


@query(f"SELECT '/d/' || CAST(doc_id AS VARCHAR) AS filepath, md5({_EDITED}) AS content_md5 FROM documents")
def b9_delta_apply(spark, d):
    docs = view(spark, d, "documents")
    sizes = docs.select(F.concat(F.lit("/d/"), F.col("doc_id").cast("string")).alias("filepath"), F.octet_length(_edited()).alias("size"))
    done = S.apply_delta(_side(spark, d, F.col("text")), _delta(spark, d), sizes)
    return done.select("filepath", F.md5("content").alias("content_md5"))


@query(_TREES + "SELECT filepath FROM fx_local_tree WHERE filepath NOT IN (SELECT filepath FROM fx_remote_tree)")
def d8_stale_cache(spark, d):
    return S.stale(view(spark, d, "fx_local_tree"), view(spark, d, "fx_remote_tree")).select("filepath")


@query("SELECT o_orderkey, CAST(least(500 * pow(2.0, (o_orderkey % 9)), 30000.0) AS BIGINT) AS wait_ms FROM orders")
def i49_backoff(spark, d):
    return view(spark, d, "orders").select("o_orderkey", S.backoff(F.col("o_orderkey") % 9 + 1).alias("wait_ms"))


@query("SELECT doc_id, md5(text) AS opened_md5, CAST(28 AS INT) AS overhead FROM documents")
def b10_encrypted_vault(spark, d):
    """AES-GCM with a key derived from a password, and back again."""
    from docloom.sources.sinks import vault_key

    key = F.lit(vault_key("password", b"docloom-salt-16b"))
    docs = view(spark, d, "documents").select("doc_id", "text")
    locked = docs.withColumn("locked", F.aes_encrypt(F.encode("text", "UTF-8"), key, F.lit("GCM")))
    return locked.select("doc_id", F.md5(F.aes_decrypt("locked", key, F.lit("GCM"))).alias("opened_md5"), (F.octet_length("locked") - F.octet_length("text")).alias("overhead"))


_ANSWERS = "SELECT concat('/vault/u', CAST(user_id AS STRING)) AS filepath, event_type = 'click' AS approved, ts, event_id FROM {events} WHERE value > 99 AND event_type IN ('click', 'view')"


@query(
    cte("fx_changes") + ", a AS (" + _ANSWERS.replace("{events}", "events") + """), g AS (SELECT filepath, arg_max(approved, (ts, event_id)) AS approved FROM a GROUP BY filepath)
    SELECT CASE WHEN approved THEN 'sync_approved' ELSE 'sync_rejected' END AS type, filepath FROM g
    UNION ALL SELECT DISTINCT 'pending', filepath FROM fx_changes WHERE filepath NOT IN (SELECT filepath FROM g)"""
)
def n6_answers(spark, d):
    """Some changes are approved or rejected one by one, the others stay in the queue."""
    answers = spark.sql(_ANSWERS, events=view(spark, d, "events")).withColumn("answered_at", F.struct("ts", "event_id"))
    said, left = S.answer(E.pending(view(spark, d, "fx_changes")), answers)
    return said.union(left.select(F.lit("pending").alias("type"), "filepath"))


@query(cte("fx_changes") + "SELECT DISTINCT 'sync_rejected' AS type, filepath FROM fx_changes")
def n6_answer_all(spark, d):
    said, left = S.answer_all(E.pending(view(spark, d, "fx_changes")), approve=False)
    return said.union(left.select(F.lit("pending").alias("type"), "filepath"))


@query(
    cte("fx_changes") + """SELECT (SELECT count(DISTINCT filepath) FROM fx_changes) AS pending_changes,
    (SELECT count(*) FROM (SELECT user_id, arg_max(event_type, (ts, event_id)) AS last FROM events GROUP BY user_id) WHERE last <> 'error') AS connected_devices"""
)
def e26_status(spark, d):
    """An error ends a device's connection."""
    kind = F.when(F.col("event_type") == "error", "disconnect").otherwise("connect")
    connections = view(spark, d, "events").select(F.col("user_id").alias("device"), kind.alias("event_type"), "ts", "event_id")
    return S.status(E.pending(view(spark, d, "fx_changes")), connections)
