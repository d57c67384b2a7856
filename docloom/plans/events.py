"""Queries: change events in batch form."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.operators import events as E
from docloom.operators.registry import query
from docloom.plans.fixtures import cte, view
from docloom.streaming import sessions as P

_W = "PARTITION BY filepath ORDER BY ts, event_id"


def _changes(spark, d):
    return view(spark, d, "fx_changes")


def _sessions(gap: float, key: str = "filepath", table: str = "fx_changes") -> str:
    return f"""s AS (SELECT *, sum(new) OVER (PARTITION BY {key} ORDER BY ts, event_id) AS session FROM (
    SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR epoch_us(ts) - epoch_us(lag(ts) OVER w) >= {int(gap * 1e6)} THEN 1 ELSE 0 END AS new FROM {table} WINDOW w AS (PARTITION BY {key} ORDER BY ts, event_id)))"""


@query(cte("fx_changes") + "," + _sessions(7200) + " SELECT filepath, max(ts) AS last_ts, arg_max(event_type, (ts, event_id)) AS event_type, count(*) AS n_events FROM s GROUP BY filepath, session")
def n1_debounce(spark, d):
    """A quiet gap of two hours, as the events lie far apart."""
    return E.debounce(_changes(spark, d), 7200)


@query(cte("fx_changes") + f"SELECT event_id, filepath FROM (SELECT *, lag(checksum) OVER ({_W}) AS b FROM fx_changes) WHERE b IS NULL OR b <> checksum")
def n4_real_changes(spark, d):
    return E.real_changes(_changes(spark, d)).select("event_id", "filepath")


@query(cte("fx_changes") + f"SELECT event_id, filepath, count(*) OVER ({_W}) AS tick FROM (SELECT *, lag(checksum) OVER ({_W}) AS b FROM fx_changes) WHERE b IS NULL OR b <> checksum")
def n5_clock_ticks(spark, d):
    return E.ticks(_changes(spark, d)).select("event_id", "filepath", "tick")


@query(
    cte("fx_changes")
    + f"SELECT event_id, filepath FROM (SELECT *, lead(event_type) OVER ({_W}) AS k, epoch_us(lead(ts) OVER ({_W})) - epoch_us(ts) AS g FROM fx_changes) WHERE event_type = 'added' AND NOT coalesce(k = 'deleted' AND g <= 3600000000, false)"
)
def n2_settled_creations(spark, d):
    return E.settled_creations(_changes(spark, d), 3600).select("event_id", "filepath")


@query(cte("fx_changes") + "SELECT filepath, arg_max(event_type, (ts, event_id)) AS event_type, max(ts) AS ts FROM fx_changes GROUP BY filepath")
def n6_pending_final(spark, d):
    return E.pending(_changes(spark, d)).select("filepath", "event_type", "ts")


@query(cte("fx_changes") + f"SELECT event_id, filepath FROM (SELECT *, lag(ts) OVER ({_W}) AS b FROM fx_changes) WHERE b IS NULL OR epoch_us(ts) - epoch_us(b) > 3600000000")
def f13_notices(spark, d):
    return E.notices(_changes(spark, d), 3600).select("event_id", "filepath")


@query(
    """SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY s RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW) AS n_recent FROM (SELECT *, CAST(floor(epoch(ts)) AS BIGINT) AS s FROM events)"""
)
def f12_attempts(spark, d):
    return E.attempts(view(spark, d, "events"), "user_id", 86400).select("event_id", "user_id", "n_recent")


@query(
    """WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) AS moment, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
    r AS (SELECT user_id, event_id, k, [moment] AS held, true AS allowed FROM e WHERE k = 1
          UNION ALL SELECT user_id, event_id, k, CASE WHEN len(f) < 3 THEN list_append(f, moment) ELSE f END, len(f) < 3
          FROM (SELECT e.*, list_filter(r.held, lambda x: x > e.moment - 86400000000) AS f FROM r JOIN e ON e.user_id = r.user_id AND e.k = r.k + 1))
    SELECT user_id, event_id, allowed FROM r"""
)
def n7_accepted_joins(spark, d):
    return E.accepted_joins(view(spark, d, "events"), "user_id", 86400, 3)


@query("WITH " + _sessions(43200, "user_id", "events") + " SELECT user_id, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n_events FROM s GROUP BY user_id, session")
def n8_reservations(spark, d):
    return E.reservations(view(spark, d, "events"), "user_id", 43200)


@query(
    cte("fx_changes")
    + f""", r AS (SELECT *, sum(n) OVER ({_W}) AS run FROM (SELECT *, CASE WHEN lag(checksum) OVER ({_W}) IS NOT DISTINCT FROM checksum THEN 0 ELSE 1 END AS n FROM fx_changes))
    SELECT filepath, checksum, count(*) AS length, min(event_id) AS first_at, max(event_id) AS last_at FROM r GROUP BY filepath, run, checksum HAVING count(*) >= 3"""
)
def f11_stability_streak(spark, d):
    rows = _changes(spark, d).withColumn("at", F.col("event_id"))
    return E.streaks(rows, "filepath", "checksum", "event_id").where("length >= 3")


@query(cte("fx_files") + "SELECT file_id, path FROM fx_files WHERE modified_time > 1705000000")
def n10_catch_up(spark, d):
    return E.since(view(spark, d, "fx_files"), 1705000000).select("file_id", "path")


@query(cte("fx_changes") + "SELECT filepath, checksum, min(event_id) AS event_id FROM (SELECT *, row_number() OVER (PARTITION BY filepath, checksum ORDER BY ts, event_id) AS p FROM fx_changes) WHERE p = 1 GROUP BY filepath, checksum")
def n12_event_dedup(spark, d):
    return E.dedupe(_changes(spark, d), "filepath", "checksum").select("filepath", "checksum", "event_id")


@query(
    """WITH RECURSIVE follows AS (SELECT user_id, ts, min(ts) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 5 HOUR FOLLOWING AND UNBOUNDED FOLLOWING) AS after FROM events),
    reads AS (SELECT user_id, min(ts) AS read_ts FROM events GROUP BY user_id
              UNION SELECT f.user_id, f.after FROM reads r JOIN follows f ON f.user_id = r.user_id AND f.ts = r.read_ts WHERE f.after IS NOT NULL)
    SELECT e.user_id, r.read_ts, count(*) AS served FROM events e ASOF JOIN reads r ON e.user_id = r.user_id AND e.ts >= r.read_ts GROUP BY e.user_id, r.read_ts"""
)
def n16_cached_listing(spark, d):
    return E.cached_listing(view(spark, d, "events"), "user_id", 5 * 3600)


@query("SELECT event_id, user_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS p FROM events) WHERE p <= 20")
def f10_ring_buffer(spark, d):
    return E.ring(view(spark, d, "events"), "user_id", "event_id", 20).select("event_id", "user_id")


@query("SELECT event_type, count(*) AS n FROM events WHERE value > 0 GROUP BY event_type")
def e1_event_counts(spark, d):
    return view(spark, d, "events").where("value > 0").groupBy("event_type").agg(F.count("*").alias("n"))


@query("SELECT event_id, event_type, ts FROM events ORDER BY event_id DESC LIMIT 20")
def g5_recent_events(spark, d):
    return view(spark, d, "events").orderBy(F.desc("event_id")).limit(20).select("event_id", "event_type", "ts")


_ANSWERS = "('local_change', 'sync_approved', 'sync_rejected')"


@query(
    cte("fx_messages")
    + f""", m AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session ORDER BY seq) AS n FROM fx_messages) WHERE n = seq),
    a AS (SELECT *, lag(type) OVER w = 'local_change' AS waits, lag(change) OVER w AS asked FROM m WHERE type IN {_ANSWERS} WINDOW w AS (PARTITION BY session, filepath ORDER BY seq)),
    b AS (SELECT m.*, coalesce(waits, false) AS waits, asked,
                 coalesce(last_value(CASE m.type WHEN 'delta' THEN true WHEN 'delete' THEN false WHEN 'local_change' THEN m.change <> 'deleted' END IGNORE NULLS) OVER w, false) AS present,
                 last_value(CASE WHEN m.type IN ('delta', 'delete') THEN {{'c': CASE WHEN m.type = 'delta' THEN m.checksum END}} END IGNORE NULLS) OVER w AS c,
                 last_value(CASE WHEN m.type IN {_ANSWERS} THEN {{'p': CASE WHEN m.type = 'local_change' THEN m.change END}} END IGNORE NULLS) OVER w AS p,
                 coalesce(max(CASE WHEN m.type IN ('delta', 'delete') THEN m.mobile END) OVER w, 0) AS clock_mobile
          FROM m LEFT JOIN a USING (session, seq) WINDOW w AS (PARTITION BY m.session, m.filepath ORDER BY m.seq ROWS UNBOUNDED PRECEDING)),
    t AS (SELECT *, type = 'sync_approved' AND waits AND asked <> 'deleted' AND present AS ticks FROM b),
    u AS (SELECT *, sum(ticks::INT) OVER w AS n_ticks FROM t WINDOW w AS (PARTITION BY session, filepath ORDER BY seq ROWS UNBOUNDED PRECEDING))
    SELECT session, seq, filepath, type, CASE WHEN type IN ('delta', 'delete') THEN 'ack' WHEN type = 'local_change' THEN 'change_pending' WHEN type = 'change_pending' THEN 'sync_approved'
                WHEN type = 'sync_approved' AND waits THEN CASE WHEN ticks THEN 'delta' ELSE 'delete' END END AS reply,
           CAST(n_ticks + greatest(0, coalesce(max(CASE WHEN type IN ('delta', 'delete') THEN pc - n_ticks END) OVER w, 0)) AS BIGINT) AS clock_pc, clock_mobile, c.c AS checksum, present, p.p AS pending
    FROM u WINDOW w AS (PARTITION BY session, filepath ORDER BY seq ROWS UNBOUNDED PRECEDING)"""
)
def n11_session_effects(spark, d):
    """What each message of a sync session does to its file, in order; some sessions wait for a message that is missing."""
    m = view(spark, d, "fx_messages").withColumn("clock", F.create_map(F.lit("pc"), "pc", F.lit("mobile"), "mobile"))
    counter = lambda device: F.coalesce(F.try_element_at("clock", F.lit(device)), F.lit(0).cast("long")).alias(f"clock_{device}")
    return P.effects(m).select("session", "seq", "filepath", "type", "reply", counter("pc"), counter("mobile"), "checksum", "present", "pending")


@query(
    cte("fx_visits")
    + """, r AS (SELECT *, epoch_us(ts) AS t FROM (SELECT *, lag(event_type) OVER (PARTITION BY session, member ORDER BY ts, event_id) AS before FROM fx_visits)
                 WHERE event_type = 'join' AND before IS DISTINCT FROM 'join' OR event_type = 'leave' AND before = 'join'),
    e AS (SELECT *, CASE WHEN event_type = 'leave' THEN CAST(ceil((t + 21600000000) / 3600000000.0) * 3600000000 AS BIGINT) END AS ends FROM r),
    n AS (SELECT *, lead(t) OVER w AS next, lag(ends) OVER w AS held FROM e WINDOW w AS (PARTITION BY session, member ORDER BY t, event_id)),
    gone AS (SELECT * FROM n WHERE event_type = 'leave' AND (next IS NULL OR next >= ends)),
    moves AS (SELECT session, t, 1 AS d FROM n WHERE event_type = 'join' AND (held IS NULL OR t >= held) UNION ALL SELECT session, ends, -1 FROM gone),
    l AS (SELECT *, sum(d) OVER (PARTITION BY session ORDER BY t, d ROWS UNBOUNDED PRECEDING) AS level FROM moves)
    SELECT session, member, make_timestamp(ends) AS at, 'expired' AS action FROM gone UNION ALL SELECT session, NULL, make_timestamp(t), 'session_expired' FROM l WHERE level = 0 AND d = -1"""
)
def n9_expiries(spark, d):
    """Places that are kept for six hours and swept every hour, and sessions that a sweep leaves empty."""
    found = P.expiries(view(spark, d, "fx_visits"), 6 * 3600, 3600)
    return found.withColumn("at", F.col("at").cast("timestamp_ntz"))
