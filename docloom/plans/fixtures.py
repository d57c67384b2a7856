"""Views that give the test tables the shape of the operators' inputs.

Each view is one SELECT that Spark and DuckDB both run; {name} stands for a
table or another view. Scenarios (deleted, changed, added files and so on) hang
on attributes of the rows, so every view covers its whole table.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

NOW = 1735603200  # 2024-12-31T00:00:00Z

VIEWS = {
    "fx_files": """
        SELECT doc_id AS file_id,
               concat('/vault/', source, '/', lang, '/doc_', CAST(doc_id AS STRING), ext) AS path,
               concat('doc_', CAST(doc_id AS STRING), ext) AS filename,
               CAST(1704067200 + doc_id * 1800 AS BIGINT) AS modified_time,
               CASE WHEN source = 'src17' THEN NULL ELSE CAST(1672531200 + doc_id * 3600 AS BIGINT) END AS created_time,
               n_chars AS size_chars
        FROM (SELECT *, CASE doc_id % 5 WHEN 0 THEN '.txt' WHEN 1 THEN '.csv' WHEN 2 THEN '.docx' WHEN 3 THEN '.pdf' ELSE '.md' END AS ext FROM {documents}) d""",
    "fx_scan": """
        SELECT path, filename, created_time, size_chars, CASE WHEN path LIKE '%/fr/%' THEN modified_time + 60 ELSE modified_time END AS modified_time
        FROM {fx_files} WHERE path NOT LIKE '/vault/src11/%'
        UNION ALL
        SELECT concat(path, '.new.txt'), concat(filename, '.new.txt'), created_time, size_chars, modified_time
        FROM {fx_files} WHERE path LIKE '/vault/src13/%'""",
    "fx_versions": """
        SELECT d.doc_id AS file_id, v.version, CAST((d.doc_id * 7 + v.version * 131) % 400 AS BIGINT) AS age_days,
               CASE WHEN v.version = 1 THEN d.text
                    WHEN v.version = 2 AND d.lang = 'en' THEN replace(d.text, '.', '!')
                    WHEN v.version = 3 THEN substring(d.text, 1, CAST(floor(d.n_chars * 0.8) AS INT))
                    ELSE d.text END AS content
        FROM {documents} d CROSS JOIN (SELECT 1 AS version UNION ALL SELECT 2 UNION ALL SELECT 3) v""",
    "fx_local_tree": """
        SELECT f.path AS filepath, md5(d.text) AS checksum
        FROM {fx_files} f JOIN {documents} d ON d.doc_id = f.file_id WHERE d.source <> 'src1'""",
    "fx_remote_tree": """
        SELECT f.path AS filepath, md5(CASE WHEN d.source = 'src3' THEN concat(d.text, 'x') ELSE d.text END) AS checksum
        FROM {fx_files} f JOIN {documents} d ON d.doc_id = f.file_id WHERE d.source <> 'src2'""",
    "fx_clocks": """
        SELECT path AS filepath, 'local' AS side, 'pc' AS device, file_id % 3 AS counter FROM {fx_files}
        UNION ALL SELECT path, 'local', 'mobile', file_id % 2 FROM {fx_files}
        UNION ALL SELECT path, 'remote', 'pc', file_id % 2 FROM {fx_files}
        UNION ALL SELECT path, 'remote', 'mobile', file_id % 4 FROM {fx_files} WHERE path NOT LIKE '/vault/src5/%'""",
    "fx_changes": """
        SELECT event_id, ts, concat('/vault/u', CAST(user_id AS STRING)) AS filepath,
               CASE event_type WHEN 'error' THEN 'deleted' WHEN 'signup' THEN 'added' WHEN 'purchase' THEN 'added' ELSE 'modified' END AS event_type,
               md5(CAST(CAST(floor(value / 50) AS BIGINT) AS STRING)) AS checksum
        FROM {events}""",
    "fx_messages": """
        SELECT * FROM (
            SELECT CAST(user_id AS STRING) AS session, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS seq,
                   CASE event_type WHEN 'view' THEN 'delta' WHEN 'error' THEN 'delete' WHEN 'click' THEN 'local_change' WHEN 'purchase' THEN 'sync_approved'
                        ELSE CASE WHEN value > 100 THEN 'sync_rejected' ELSE 'change_pending' END END AS type,
                   concat('/f', CAST(event_id % 3 AS STRING)) AS filepath, event_id % 5 AS pc, event_id % 7 AS mobile, md5(CAST(event_id AS STRING)) AS checksum,
                   CASE WHEN event_id % 4 = 0 THEN 'deleted' ELSE 'modified' END AS change
            FROM {events}) m
        WHERE NOT (session LIKE '%3' AND seq = 30)""",
    "fx_visits": """
        SELECT CAST(user_id % 12 AS STRING) AS session, CAST(user_id AS STRING) AS member, CASE WHEN event_type IN ('view', 'signup') THEN 'join' ELSE 'leave' END AS event_type,
               ts, event_id FROM {events}""",
    "fx_query_vectors": "SELECT vec_id AS query_id, embedding AS query_embedding FROM {embeddings} WHERE vec_id % 50 = 0",
    "fx_queries": "SELECT item_id AS query_id, text AS query_text FROM {benchmark}",
    "fx_cells_old": """
        SELECT l_returnflag AS sheet, concat('R', CAST(l_orderkey AS STRING), 'C', CAST(l_linenumber AS STRING)) AS cell,
               CAST(max(l_partkey) AS STRING) AS value,
               CASE WHEN l_linenumber = 1 THEN concat('=A', CAST(max(l_suppkey) AS STRING)) ELSE NULL END AS formula
        FROM {lineitem} WHERE l_returnflag <> 'A' GROUP BY l_returnflag, l_orderkey, l_linenumber""",
    "fx_cells_new": """
        SELECT l_returnflag AS sheet, concat('R', CAST(l_orderkey AS STRING), 'C', CAST(l_linenumber AS STRING)) AS cell,
               CAST(max(l_partkey) + CASE WHEN max(l_discount) > 0.08 THEN 1 ELSE 0 END AS STRING) AS value,
               CASE WHEN l_linenumber = 1 THEN concat('=A', CAST(max(l_suppkey) + CASE WHEN max(l_tax) > 0.06 THEN 1 ELSE 0 END AS STRING)) ELSE NULL END AS formula
        FROM {lineitem} WHERE l_returnflag <> 'R' AND l_linestatus = 'O' OR l_returnflag = 'A' GROUP BY l_returnflag, l_orderkey, l_linenumber""",
    "fx_sorts": """
        SELECT o_orderkey AS sort_id, concat('/inbox/', CAST(o_orderkey AS STRING), '.pdf') AS original_path,
               concat('/sorted/', lower(o_orderpriority), '/', CAST(o_orderkey AS STRING), '.pdf') AS new_path,
               o_orderpriority AS category, o_orderdate AS sorted_at, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS undone
        FROM {orders}""",
    "fx_logs": """
        SELECT event_id AS log_id, ts, concat('[', event_type, '] user ', CAST(user_id AS STRING),
               CASE event_type WHEN 'error' THEN ' failed to load' WHEN 'signup' THEN ' completed' WHEN 'purchase' THEN ' warning: slow' ELSE ' opened page' END) AS message
        FROM {events}""",
    "fx_chunks": "",  # made by each engine from its own split, see chunks() and CHUNKS_SQL
}

#: Word windows of 200 words, 170 apart; chunk 0 holds the name and the path.
CHUNKS_SQL = r"""
    SELECT file_id * 1000000 AS chunk_id, file_id, 0 AS chunk_index,
           concat_ws(' ', translate(regexp_replace(filename, '\.[^.]*$', ''), '_-', '  '), filename, path) AS text FROM fx_files
    UNION ALL
    SELECT file_id * 1000000 + p + 1, file_id, CAST(p + 1 AS INT), array_to_string(words[p * 170 + 1 : p * 170 + 200], ' ')
    FROM (SELECT file_id, words, unnest(generate_series(0, greatest(CAST(ceil((len(words) - 200) / 170.0) AS BIGINT), 0))) AS p
          FROM (SELECT doc_id AS file_id, list_filter(regexp_split_to_array(text, '[\s]+'), lambda w: w <> '') AS words FROM documents) WHERE len(words) > 0)"""


def _needs(sql: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"\{(\w+)\}", sql)))


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view, or a plain table, as a DataFrame."""
    if name not in VIEWS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if name == "fx_chunks":
        from docloom.functions.text import index_chunks

        return index_chunks(view(spark, sf_dir, "fx_files"), view(spark, sf_dir, "documents"))
    sql = VIEWS[name]
    return spark.sql(sql, **{n: view(spark, sf_dir, n) for n in _needs(sql)})


def cte(*names: str) -> str:
    """WITH clause (DuckDB) that defines the named views and what they need."""
    parts: dict[str, str] = {}

    def add(name: str) -> None:
        if name in parts or name not in VIEWS:
            return
        if name == "fx_chunks":
            add("fx_files")
            parts[name] = CHUNKS_SQL
            return
        for n in _needs(VIEWS[name]):
            add(n)
        parts[name] = re.sub(r"\{(\w+)\}", r"\1", VIEWS[name])

    for name in names:
        add(name)
    return "WITH " + ",\n".join(f"{n} AS ({s})" for n, s in parts.items()) + "\n"
