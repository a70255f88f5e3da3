"""Registered queries: the streaming jobs, run once over the stored events.

A stream in append mode gives what its watermark has passed: all rows but those of the last
ten minutes.  The SQL twins leave the same rows out.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from probatio import fixed_values as fv
from probatio.operators import funnel, leads, transitions
from probatio.plans import oracle as o
from probatio.plans.catalog.leads import _APPROVAL
from probatio.streaming import events as streams, ordered

_STEPS = {"view": "PAGE_VIEW", "click": "CTA_CLICK", "signup": "FORM_STARTED",
          "purchase": "LEAD_CREATED"}


def _events(spark, sf):
    return streams.table_stream(spark, f"{sf}/events.parquet").withColumn(
        "ts", F.col("ts").cast("timestamp"))


def _mapped(column, names):
    return F.create_map(*[F.lit(x) for kv in names.items() for x in kv])[column]


#: Milliseconds up to which the stream has seen everything.
PASSED = "passed AS (SELECT epoch_ms(max(ts)) - 600000 AS ms FROM events)"


def stream_spam_verdicts(spark, sf):
    """The rate rule as a stream with event-time timers."""
    rows = _events(spark, sf).select(
        F.col("event_id").alias("submission_id"), F.col("user_id").cast("string")
        .alias("client_key"), F.col("ts").alias("submitted_at"),
        F.when(F.col("event_type") == "error", "x").alias("honeypot"),
        F.when(F.col("value") < 2, 80).otherwise(5000).alias("elapsed_ms"))
    return streams.run_once(ordered.spam_verdicts(rows)).select(
        "submission_id", "client_key", "accepted", F.col("reason").alias("spam_reason"))


STREAM_SPAM_VERDICTS = f"""
WITH RECURSIVE q AS (
  SELECT event_id, user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n
  FROM events WHERE event_type <> 'error' AND value >= 2),
{PASSED},
walk AS (
  SELECT user_id, 0::BIGINT AS n, 0::BIGINT AS event_id, NULL::TIMESTAMP AS ts,
         []::TIMESTAMP[] AS seen, true AS ok FROM (SELECT DISTINCT user_id FROM q)
  UNION ALL
  SELECT user_id, n, event_id, ts, CASE WHEN len(kept) < 5 THEN list_append(kept, ts) ELSE kept END,
         len(kept) < 5
  FROM (SELECT q.*, list_filter(seen, lambda t: t >= q.ts - INTERVAL 3600 SECOND) AS kept
        FROM walk JOIN q ON q.user_id = walk.user_id AND q.n = walk.n + 1))
SELECT event_id AS submission_id, CAST(user_id AS VARCHAR) AS client_key, ok AS accepted,
       CASE WHEN NOT ok THEN '{leads.RATE_REASON}' END AS spam_reason
FROM walk, passed WHERE n > 0 AND epoch_ms(ts) < ms"""


def _session_events(rows):
    return rows.select(F.col("user_id").alias("session_id"), "ts", _mapped(
        F.col("event_type"), _STEPS).alias("event_type"))


def _listed(rows):
    return rows.select("session_id", F.unix_micros("started_at").alias("started_at"), F.unix_micros(
        "closed_at").alias("closed_at"), "furthest_step", "events", "abandoned")


def stream_sessions(spark, sf):
    """Closed sessions: half an hour without an event ends one."""
    return _listed(streams.run_once(streams.funnel_sessions(_session_events(_events(spark, sf)))))


def batch_sessions(spark, sf):
    """All sessions, open ones too, from stored events."""
    stored = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    return _listed(funnel.gap_sessions(_session_events(stored)))


_STEP_NUMBER = o.case([(f"event_type = '{kind}'", str(fv.EVENT_TYPES.index(name) + 1))
                       for kind, name in _STEPS.items()])
BATCH_SESSIONS = f"""
WITH stepped AS (
  SELECT user_id, ts, epoch_us(ts) AS us, {_STEP_NUMBER} AS step FROM events),
marked AS (
  SELECT *, CASE WHEN us - lag(us) OVER w <= 1800000000 THEN 0 ELSE 1 END AS opens
  FROM stepped WHERE step IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY us)),
numbered AS (
  SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY us RANGE UNBOUNDED PRECEDING) AS n
  FROM marked),
sessions AS (
  SELECT user_id AS session_id, min(us) AS started_at, max(us) + 1800000000 AS closed_at,
         max(step) AS furthest_step, count(*) AS events, max(step) < {len(fv.EVENT_TYPES)} AS abandoned
  FROM numbered GROUP BY user_id, n)
SELECT session_id, started_at, closed_at, furthest_step, events, abandoned FROM sessions"""
STREAM_SESSIONS = BATCH_SESSIONS.replace("WITH stepped", f"WITH {PASSED},\nstepped") + \
    ", passed WHERE closed_at // 1000 <= ms"


def stream_state_fold(spark, sf):
    """Approval requests labelled as they arrive, in event order."""
    log = _events(spark, sf).select(
        F.concat_ws("/", F.col("user_id").cast("string"), F.floor(
            F.col("value") / 10).cast("string")).alias("key"), "ts",
        F.col("event_id").alias("step_id"),
        _mapped(F.col("event_type"), _APPROVAL).alias("requested"))
    return streams.run_once(ordered.fold_states(log, fv.APPROVAL_TRANSITIONS, "PENDING")).select(
        "key", "step_id", "requested", "state_before", "state_after", "allowed")


_ALLOWED = ", ".join(f"'{a}>{b}'" for a, b in transitions.transition_rows(fv.APPROVAL_TRANSITIONS))
_REQUESTED = o.case([(f"event_type = '{a}'", f"'{b}'") for a, b in _APPROVAL.items()])
STREAM_STATE_FOLD = f"""
WITH RECURSIVE log AS (
  SELECT user_id || '/' || floor(value / 10)::BIGINT AS key, {_REQUESTED} AS requested, event_id, ts,
         row_number() OVER (PARTITION BY user_id, floor(value / 10) ORDER BY ts, event_id) AS n
  FROM events),
{PASSED},
walk AS (
  SELECT DISTINCT key, 0::BIGINT AS n, 0::BIGINT AS event_id, NULL::TIMESTAMP AS ts,
         '' AS requested, '' AS before, 'PENDING' AS state, false AS allowed FROM log
  UNION ALL
  SELECT l.key, l.n, l.event_id, l.ts, l.requested, w.state,
    CASE WHEN w.state || '>' || l.requested IN ({_ALLOWED}) THEN l.requested ELSE w.state END,
    w.state || '>' || l.requested IN ({_ALLOWED})
  FROM walk w JOIN log l ON l.key = w.key AND l.n = w.n + 1)
SELECT key, event_id AS step_id, requested, before AS state_before, state AS state_after, allowed
FROM walk, passed WHERE n > 0 AND epoch_ms(ts) < ms"""


def stream_ingest_once(spark, sf):
    """One row per user and day, however often a batch is replayed."""
    rows = _events(spark, sf).select("user_id", "ts")
    return streams.store_once(rows, "user_id").select(
        F.col("day").cast("string").alias("day"), "user_id",
        F.unix_micros("ts").alias("first_at"))


STREAM_INGEST_ONCE = """
SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, user_id, epoch_us(min(ts)) AS first_at
FROM events GROUP BY ALL"""


def stream_hourly_counts(spark, sf):
    rows = streams.hourly_counts(_events(spark, sf), ["event_type"])
    return streams.run_once(rows).select(
        F.unix_micros("hour").alias("hour"), "event_type", "events")


STREAM_HOURLY_COUNTS = f"""
WITH {PASSED}
SELECT epoch_us(date_trunc('hour', ts)) AS hour, event_type, count(*) AS events
FROM events, passed WHERE epoch_ms(date_trunc('hour', ts)) + 3600000 <= ms GROUP BY ALL"""


def stream_hourly_spend(spark, sf):
    """Requests and cost per provider and hour."""
    usage = _events(spark, sf).select(
        "ts", F.col("event_type").alias("provider"), F.lit(1).alias("requests"),
        F.col("value").cast("decimal(18, 2)").alias("cost_usd"))
    return streams.run_once(streams.hourly_spend(usage)).select(
        F.unix_micros("hour").alias("hour"), "provider", "requests",
        F.col("cost_usd").cast("double").alias("cost_usd"))


STREAM_HOURLY_SPEND = f"""
WITH {PASSED}
SELECT epoch_us(date_trunc('hour', ts)) AS hour, event_type AS provider, count(*) AS requests,
       CAST(sum(CAST(value AS DECIMAL(18, 2))) AS DOUBLE) AS cost_usd
FROM events, passed WHERE epoch_ms(date_trunc('hour', ts)) + 3600000 <= ms GROUP BY ALL"""


QUERIES = {
    "stream_spam_verdicts": (stream_spam_verdicts, STREAM_SPAM_VERDICTS),
    "stream_sessions": (stream_sessions, STREAM_SESSIONS),
    "batch_sessions": (batch_sessions, BATCH_SESSIONS),
    "stream_state_fold": (stream_state_fold, STREAM_STATE_FOLD),
    "stream_ingest_once": (stream_ingest_once, STREAM_INGEST_ONCE),
    "stream_hourly_counts": (stream_hourly_counts, STREAM_HOURLY_COUNTS),
    "stream_hourly_spend": (stream_hourly_spend, STREAM_HOURLY_SPEND),
}
