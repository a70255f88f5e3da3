"""Registered queries: result pages, scores, spend, outcomes and funnel."""

from __future__ import annotations

from pyspark.sql import functions as F

from probatio import fixed_values as fv
from probatio.operators import funnel, research, serp, usage
from probatio.plans import inputs, oracle as o
from probatio.plans.probe import PROFILE
from probatio.sources import serp as serp_source


# ------------------------------------------------------------- result pages --
def _results(spark, sf):
    """Pages as organic results of one snapshot per ten pages."""
    return inputs.table(spark, sf, "pages").select(
        F.floor(F.col("page_id") / 10).alias("snapshot_id"),
        F.col("page_id").alias("result_ord"),
        F.when(F.col("page_id") % 9 == 0, F.regexp_replace("url", r"\.com", ".be"))
        .otherwise(F.col("url")).alias("url"),
        F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"))


RESULTS = """
results AS (
  SELECT page_id // 10 AS snapshot_id, page_id AS result_ord,
         CASE WHEN page_id % 9 = 0 THEN replace(url, '.com', '.be') ELSE url END AS url,
         regexp_extract(html, '<title>([^<]*)</title>', 1) AS title
  FROM pages)"""
_SHAPES = ", ".join(f"{o.contains('t', hints)} AS {name}"
                    for name, hints in fv.PAGE_SHAPE_HINTS.items())
SHAPED = RESULTS + f""",
shaped AS (
  SELECT snapshot_id, result_ord, host, {_SHAPES},
         coalesce(ends_with(host, '.be'), false) AS local_domain
  FROM (SELECT *, {o.norm('title')} AS t, {o.bare_host('url')} AS host FROM results))"""


def page_shapes(spark, sf):
    return serp.page_shapes(_results(spark, sf)).drop("url", "title")


PAGE_SHAPES = o.with_(SHAPED) + "SELECT * FROM shaped"


def serp_analysis(spark, sf):
    results = _results(spark, sf)
    snapshots = results.select("snapshot_id").distinct()
    questions = results.select(
        "snapshot_id", F.col("result_ord").alias("question_ord"),
        F.when(F.col("result_ord") % 2 == 0, "PAA").otherwise("RELATED").alias("kind"),
        F.col("title").alias("text"))
    features = results.select("snapshot_id", F.when(
        F.col("url").startswith("https://www."), "VIDEO").otherwise("ORGANIC")
        .alias("item_type"))
    return serp.analyse(snapshots, results, questions, features).select(
        "snapshot_id", "organic_count", "distinct_domains", *fv.PAGE_SHAPE_HINTS,
        "local_domain", "dominant_framing",
        F.array_join(F.transform("top_domains", lambda d: F.concat_ws(
            ":", d["domain"], d["count"].cast("string"))), " ").alias("top_domains"),
        F.array_join("repeated_domains", " ").alias("repeated_domains"),
        F.array_join("serp_features", " ").alias("serp_features"),
        F.array_join("content_gap", "|").alias("content_gap"),
        F.array_join("questions", "|").alias("questions"),
        F.size("observations").alias("observations"))


SERP_ANALYSIS = o.with_(SHAPED) + f""",
counts AS (
  SELECT snapshot_id, count(*) AS organic_count, count(DISTINCT host) AS distinct_domains,
    {", ".join(f"count(*) FILTER ({n}) AS {n}" for n in fv.PAGE_SHAPE_HINTS)},
    count(*) FILTER (local_domain) AS local_domain
  FROM shaped GROUP BY 1),
hosts AS (
  SELECT snapshot_id, host, n, row_number() OVER (
    PARTITION BY snapshot_id ORDER BY n DESC, f) AS place
  FROM (SELECT snapshot_id, host, count(*) AS n, min(result_ord) AS f
        FROM shaped WHERE host IS NOT NULL GROUP BY 1, 2)),
tops AS (
  SELECT snapshot_id, string_agg(host || ':' || n, ' ' ORDER BY place)
           AS top_domains,
         coalesce(string_agg(host, ' ' ORDER BY place) FILTER (n > 1), '')
           AS repeated_domains
  FROM hosts GROUP BY 1),
asked AS (
  SELECT snapshot_id,
    coalesce(string_agg(title, '|' ORDER BY result_ord) FILTER (result_ord % 2 = 0), '')
      AS questions,
    string_agg(DISTINCT f, ' ' ORDER BY f) AS serp_features
  FROM (SELECT *, CASE WHEN starts_with(url, 'https://www.') THEN 'VIDEO'
                       ELSE 'ORGANIC' END AS f FROM results) GROUP BY 1)
SELECT c.*, top_domains, repeated_domains, questions, serp_features,
  CASE WHEN price_focused + listing + comparison > guide THEN 'commercial'
       WHEN guide > price_focused + listing + comparison THEN 'informational'
       ELSE 'mixed' END AS dominant_framing,
  concat_ws('|',
    CASE WHEN calculator = 0 THEN 'No calculator or simulator appears in the top results.' END,
    CASE WHEN comparison = 0 THEN 'No comparison page appears in the top results.' END,
    CASE WHEN local_domain = 0 THEN 'No Belgian-domain result appears in the top results.' END,
    CASE WHEN guide = 0 THEN 'No explanatory guide appears in the top results.' END)
    AS content_gap,
  4 + (calculator > 0)::INT + (comparison > 0)::INT + (price_focused > 0)::INT
    + (repeated_domains <> '')::INT AS observations
FROM counts c JOIN tops USING (snapshot_id) JOIN asked USING (snapshot_id)"""


# -------------------------------------------------------------------- score --
def _score_inputs(spark, sf):
    """Customers as keywords; some inputs are unknown on purpose."""
    c = inputs.table(spark, sf, "customer")
    key, balance = F.col("c_custkey"), F.col("c_acctbal")
    intents = F.array(*[F.lit(i) for i in fv.INTENTS])
    return c.select(
        key.alias("keyword"), F.get(intents, F.col("c_nationkey") % 5).alias("intent"),
        F.when(balance > 0, F.floor(balance) / 10000).alias("topic_alignment"),
        F.when(key % 7 != 0, F.lit(10)).alias("organic_count"),
        (key % 10 + 1).alias("distinct_domains"), (key % 4).alias("feature_count"),
        (key % 5).alias("gap_count"),
        F.when(key % 3 != 0, F.floor(F.abs(balance)).cast("double"))
        .alias("search_volume"),
        F.when(key % 2 == 0, (key % 100).cast("double")).alias("competition_index"),
        F.when(key % 11 == 0, 0).otherwise(3).alias("eligible_count"))


def opportunity_score(spark, sf):
    return serp.opportunity_score(_score_inputs(spark, sf), PROFILE).select(
        "keyword", "overall_score", F.round("confidence", 6).alias("confidence"),
        F.array_join("missing_inputs", ",").alias("missing_inputs"),
        *list(fv.SCORE_WEIGHTS))


_SERVED = sorted({i for c in PROFILE.cta_options for i in c["intents"]})
_KNOWN = " + ".join(f"CASE WHEN {n} IS NULL THEN 0.0 ELSE {w}::DOUBLE END"
                    for n, w in fv.SCORE_WEIGHTS.items())
_TOTAL = " + ".join(f"coalesce({n} * {w}::DOUBLE, 0.0)"
                    for n, w in fv.SCORE_WEIGHTS.items())
_SPREAD = ("greatest(0.0::DOUBLE, least(100.0::DOUBLE, (k % 10 + 1) / 10.0::DOUBLE * 100 "
           "- least(30.0::DOUBLE, 6.0::DOUBLE * (k % 4))))")
_DEMAND = "least(100.0::DOUBLE, 20.0::DOUBLE * log10(greatest(vol, 1.0::DOUBLE) + 1))"
OPPORTUNITY_SCORE = f"""
WITH src AS (
  SELECT c_custkey AS keyword, [{o.listed(fv.INTENTS)}][c_nationkey % 5 + 1] AS intent,
    CASE WHEN c_acctbal > 0 THEN floor(c_acctbal) / 10000 END AS align,
    c_custkey AS k, floor(abs(c_acctbal)) AS vol FROM customer),
parts AS (
  SELECT keyword, k, {o.case([(f"intent = '{i}'", f"{v}::DOUBLE")
                              for i, v in fv.INTENT_SCORES.items()], "40.0::DOUBLE")}
      AS commercial_intent,
    {o.tenth('align * 100')} AS business_relevance,
    CASE WHEN intent IN ({o.listed(_SERVED)}) THEN 90.0::DOUBLE ELSE 40.0::DOUBLE END
      AS conversion_potential,
    CASE WHEN k % 7 <> 0 THEN least(100.0::DOUBLE, 25.0::DOUBLE * (k % 5)) END
      AS content_gap,
    CASE WHEN k % 7 <> 0 THEN {o.tenth(_SPREAD)} END AS serp_opportunity,
    CASE WHEN k % 3 <> 0 THEN {o.tenth(_DEMAND)} END AS search_demand,
    CASE WHEN k % 2 = 0 THEN 100.0::DOUBLE - (k % 100) END AS competition
  FROM src)
SELECT keyword, round_even(({_TOTAL}) / ({_KNOWN}), 0)::INT AS overall_score,
  round(({_KNOWN}) / {sum(fv.SCORE_WEIGHTS.values())}, 6) AS confidence,
  concat_ws(',', {", ".join(f"CASE WHEN {n} IS NULL THEN '{n}' END"
                            for n in fv.SCORE_WEIGHTS)},
            CASE WHEN k % 11 = 0 THEN 'eligible_evidence' END) AS missing_inputs,
  {", ".join(fv.SCORE_WEIGHTS)}
FROM parts"""


def keyword_metrics(spark, sf):
    """Parts as keywords with wide metrics; NULL or blank metrics leave no row."""
    p = inputs.table(spark, sf, "part")
    size = F.col("p_size")
    return serp_source.long_metrics(p.select(
        F.concat_ws(" ", "p_name", F.col("p_partkey").cast("string")).alias("keyword"),
        F.when(size % 3 != 0, size * 100).alias("search_volume"),
        F.when(size % 4 != 0, F.col("p_retailprice")).alias("cpc"),
        F.when(size % 5 != 0, size).alias("competition_index"),
        F.when(size % 2 == 0, F.col("p_type")).otherwise(" ").alias("competition")))


METRICS = """
metrics AS (
  SELECT p_name || ' ' || p_partkey AS keyword, unnest([
    {'metric_ord': 0, 'metric_type': 'search_volume',
     'value': CASE WHEN p_size % 3 <> 0 THEN p_size * 100::DOUBLE END,
     'value_text': NULL::VARCHAR, 'currency': NULL::VARCHAR},
    {'metric_ord': 1, 'metric_type': 'cpc',
     'value': CASE WHEN p_size % 4 <> 0 THEN p_retailprice END,
     'value_text': NULL::VARCHAR, 'currency': 'USD'},
    {'metric_ord': 2, 'metric_type': 'competition_index',
     'value': CASE WHEN p_size % 5 <> 0 THEN p_size::DOUBLE END,
     'value_text': NULL::VARCHAR, 'currency': NULL::VARCHAR},
    {'metric_ord': 3, 'metric_type': 'competition', 'value': NULL::DOUBLE,
     'value_text': CASE WHEN p_size % 2 = 0 THEN p_type END,
     'currency': NULL::VARCHAR}], recursive := true)
  FROM part)"""
KEYWORD_METRICS = o.with_(METRICS) + """
SELECT keyword, metric_ord, metric_type, value, value_text, currency FROM metrics
WHERE value IS NOT NULL OR value_text IS NOT NULL"""


def first_metric(spark, sf):
    return serp.first_metric(keyword_metrics(spark, sf), "competition_index")


FIRST_METRIC = o.with_(METRICS) + """
SELECT keyword, value, value_text FROM metrics
WHERE metric_type = 'competition_index' AND value IS NOT NULL"""


# -------------------------------------------------------------------- spend --
def _usage(spark, sf):
    """Events as provider calls: a job per user, purchases and clicks are priced."""
    units = F.get_json_object("props", "$.k").cast("bigint")
    priced = F.col("event_type").isin("purchase", "click")
    return inputs.table(spark, sf, "events").select(
        F.col("user_id").alias("correlation_id"), F.col("event_type").alias("provider"),
        F.when(F.col("event_id") % 2 == 0, "search").otherwise("extract")
        .alias("operation"), F.lit(1).cast("bigint").alias("requests"),
        F.when(units > 10, units).alias("units"),
        F.when(priced, F.round("value", 4)).alias("cost_usd"),
        (F.col("event_type") == "purchase").alias("cost_is_actual"),
        F.col("ts").cast("timestamp").alias("ts"), "event_id")


USAGE = """
usage AS (
  SELECT user_id AS correlation_id, event_type AS provider, event_id, ts,
    CASE WHEN event_id % 2 = 0 THEN 'search' ELSE 'extract' END AS operation,
    CASE WHEN k > 10 THEN k END AS units,
    CASE WHEN event_type IN ('purchase', 'click') THEN round(value, 4) END AS cost_usd
  FROM (SELECT *, (props::JSON->>'k')::BIGINT AS k FROM events))"""


def provider_ledger(spark, sf):
    return usage.provider_ledger(_usage(spark, sf))


PROVIDER_LEDGER = o.with_(USAGE) + """
SELECT correlation_id, provider, count(*) AS requests,
  coalesce(sum(units), 0)::BIGINT AS units, round(sum(cost_usd), 6) AS cost_usd,
  provider = 'purchase' AS cost_is_actual
FROM usage GROUP BY 1, 2"""


def operation_ledger(spark, sf):
    return usage.operation_ledger(_usage(spark, sf))


OPERATION_LEDGER = o.with_(USAGE) + """
SELECT correlation_id, provider, operation, count(*) AS requests FROM usage GROUP BY ALL"""


def job_totals(spark, sf):
    return usage.job_totals(_usage(spark, sf))


JOB_TOTALS = o.with_(USAGE) + """
SELECT correlation_id, round(sum(cost_usd), 6) AS total_cost_usd,
  count(*) AS total_requests, count(cost_usd) AS priced_events,
  count(*) - count(cost_usd) AS unpriced_events
FROM usage GROUP BY 1"""


def usage_backstop(spark, sf):
    """Errors are calls; those without a usage row get one of unknown cost."""
    events = _usage(spark, sf)
    calls = events.withColumn("duration_ms", F.lit(1))
    recorded = events.where("provider <> 'error' or operation = 'search'")
    return usage.job_totals(usage.backstop(calls, recorded))


USAGE_BACKSTOP = o.with_(USAGE) + """,
recorded AS (SELECT * FROM usage WHERE provider <> 'error' OR operation = 'search'),
missing AS (
  SELECT DISTINCT correlation_id, provider, operation FROM usage
  EXCEPT SELECT correlation_id, provider, operation FROM recorded),
complete AS (
  SELECT correlation_id, cost_usd FROM recorded
  UNION ALL SELECT correlation_id, NULL FROM missing)
SELECT correlation_id, round(sum(cost_usd), 6) AS total_cost_usd,
  count(*) AS total_requests, count(cost_usd) AS priced_events,
  count(*) - count(cost_usd) AS unpriced_events
FROM complete GROUP BY 1"""


def call_budget(spark, sf):
    return usage.enforce_budget(
        _usage(spark, sf), ["correlation_id", "provider"], ["ts", "event_id"]).select(
            "event_id", "correlation_id", "provider", "allowed")


CALL_BUDGET = o.with_(USAGE) + f"""
SELECT event_id, correlation_id, provider, row_number() OVER (
  PARTITION BY correlation_id, provider ORDER BY ts, event_id) <= {fv.MAX_CALLS_PER_JOB}
  AS allowed
FROM usage"""


def cached_snapshots(spark, sf):
    """Latest event per user and type as a cached snapshot, looked up per kind."""
    kinds = {"click": "SERP", "view": "WEB_RESEARCH", "purchase": "COMMUNITY",
             "signup": "KEYWORD_METRICS", "error": "SERP"}
    key = F.concat_ws("/", F.col("user_id").cast("string"), "event_type")
    events = inputs.table(spark, sf, "events")
    snapshots = events.select(key.alias("cache_key"), F.col("event_id")
                              .alias("snapshot_id"),
                              F.col("ts").cast("timestamp").alias("retrieved_at"))
    kind = F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv])
    lookups = events.select(key.alias("cache_key"), kind[F.col("event_type")]
                            .alias("kind")).distinct()
    return usage.cached(lookups, snapshots, F.to_timestamp(
        F.lit("2024-01-30 12:00:00"))).select("cache_key", "kind", "snapshot_id", "usable")


CACHED_SNAPSHOTS = """
SELECT user_id || '/' || event_type AS cache_key,
  CASE event_type WHEN 'view' THEN 'WEB_RESEARCH' WHEN 'purchase' THEN 'COMMUNITY'
       WHEN 'signup' THEN 'KEYWORD_METRICS' ELSE 'SERP' END AS kind,
  arg_max(event_id, (ts, event_id)) AS snapshot_id,
  TIMESTAMP '2024-01-30 12:00:00' - max(ts) < CASE event_type
    WHEN 'purchase' THEN INTERVAL 72 HOUR WHEN 'click' THEN INTERVAL 24 HOUR
    WHEN 'error' THEN INTERVAL 24 HOUR ELSE INTERVAL 168 HOUR END AS usable
FROM events GROUP BY user_id, event_type"""


# ----------------------------------------------------------------- outcomes --
def outcome_summary(spark, sf):
    """Users as runs, events as source outcomes."""
    states = F.array(*[F.lit(s) for s in fv.SOURCE_STATES])
    return research.outcome_summary(inputs.table(spark, sf, "events").select(
        F.col("user_id").alias("run_id"), F.col("event_type").alias("source_type"),
        F.get(states, (F.col("event_id") % 10).cast("int")).alias("state"),
        (F.col("event_id") % 3).alias("item_count")))


OUTCOME_SUMMARY = f"""
SELECT user_id AS run_id, count(*) FILTER (s IN ({o.listed(fv.STATES_DEGRADED)})) AS degraded,
  count(*) FILTER (s = '{fv.STATE_UNCONFIGURED}') AS unconfigured,
  count(*) FILTER (s = 'no-results') AS clean_empty,
  count(*) FILTER (event_id % 3 > 0) AS with_items,
  count(*) FILTER (s IN ('ok', 'partial') AND event_id % 3 = 0) AS ok_but_empty,
  bool_or(s IN ({o.listed(fv.STATES_DEGRADED)})) AS is_partial
FROM (SELECT *, [{o.listed(fv.SOURCE_STATES)}][event_id % 10 + 1] AS s FROM events)
GROUP BY 1"""


# ------------------------------------------------------------------- funnel --
_EVENT_NAMES = {"view": "PAGE_VIEW", "click": "CTA_CLICK", "signup": "FORM_STARTED",
                "purchase": "LEAD_CREATED"}


def site_events(spark, sf):
    """Events as site events; an error keeps its unknown type."""
    names = F.create_map(*[F.lit(x) for kv in _EVENT_NAMES.items() for x in kv])
    ts = F.col("ts").cast("timestamp")
    return inputs.table(spark, sf, "events").select(
        "event_id", F.coalesce(names[F.col("event_type")], F.col("event_type"))
        .alias("event_type"), ts.alias("ts"),
        F.concat_ws("/", F.col("user_id").cast("string"), F.date_format(ts, "yyyy-MM-dd"))
        .alias("session_id"), F.to_date(ts).cast("string").alias("day"), "props", "value")


SITE_EVENTS = f"""
site_events AS (
  SELECT event_id, {o.case([(f"event_type = '{a}'", f"'{b}'")
                            for a, b in _EVENT_NAMES.items()], "event_type")} AS event_type,
    ts, user_id || '/' || strftime(ts, '%Y-%m-%d') AS session_id,
    strftime(ts, '%Y-%m-%d') AS day, props, value FROM events),
stepped AS (SELECT *, list_position({o.array(fv.EVENT_TYPES)}, event_type) AS step
            FROM site_events)"""


def event_validation(spark, sf):
    detail = F.map_from_arrays(
        F.transform(F.sequence(F.lit(1), F.lit(10)), lambda i: F.concat(
            F.lit("key"), F.repeat(F.lit("x"), 38), i.cast("string"))),
        F.transform(F.sequence(F.lit(1), F.lit(10)), lambda i: F.repeat(
            F.col("props"), 20)))
    rows = site_events(spark, sf).withColumn("detail", detail)
    checked = funnel.validate_events(rows.withColumn("detail", F.map_from_arrays(
        F.transform(F.map_keys("detail"), lambda k: F.concat(
            F.right(k, F.lit(1)), k)), F.map_values("detail"))))
    return checked.select(
        "event_id", "event_type", "accepted", "rejection_reason",
        F.size("detail").alias("keys"),
        F.length(F.get(F.map_values("detail"), F.lit(0))).alias("value_chars"),
        F.length(F.get(F.map_keys("detail"), F.lit(0))).alias("key_chars"))


EVENT_VALIDATION = o.with_(SITE_EVENTS) + """
SELECT event_id, event_type, step > 0 AS accepted,
  CASE WHEN step > 0 THEN NULL ELSE 'UNKNOWN_EVENT_TYPE' END AS rejection_reason,
  CASE WHEN step > 0 THEN 10 END AS keys,
  CASE WHEN step > 0 THEN 20 * length(props) END AS value_chars,
  CASE WHEN step > 0 THEN 43 END AS key_chars
FROM (SELECT * REPLACE (coalesce(step, 0) AS step) FROM stepped)"""


def session_funnel(spark, sf):
    return funnel.session_funnel(site_events(spark, sf)).select(
        "session_id", "furthest_step", "furthest", "events", "abandoned")


SESSION_FUNNEL = o.with_(SITE_EVENTS) + f"""
SELECT session_id, max(step) AS furthest_step,
  ({o.array(fv.EVENT_TYPES)})[max(step)] AS furthest, count(*) AS events,
  max(step) < {len(fv.EVENT_TYPES)} AS abandoned
FROM stepped WHERE step > 0 GROUP BY 1"""


def daily_funnel(spark, sf):
    return funnel.funnel(site_events(spark, sf), ["day"]).withColumn(
        "conversion_rate", F.round("conversion_rate", 6))


DAILY_FUNNEL = o.with_(SITE_EVENTS) + f"""
SELECT day, count(*) AS sessions,
  {", ".join(f"count(*) FILTER (m >= {i + 1}) AS {n.lower()}"
             for i, n in enumerate(fv.EVENT_TYPES))},
  round(count(*) FILTER (m >= {len(fv.EVENT_TYPES)}) / count(*), 6) AS conversion_rate
FROM (SELECT day, session_id, max(step) AS m FROM stepped WHERE step > 0 GROUP BY 1, 2)
GROUP BY 1"""


def hourly_events(spark, sf):
    return funnel.hourly_counts(site_events(spark, sf), ["event_type"]).withColumn(
        "hour", F.date_format("hour", "yyyy-MM-dd HH:mm"))


HOURLY_EVENTS = o.with_(SITE_EVENTS) + """
SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS hour, event_type,
       count(*) AS events
FROM site_events GROUP BY ALL"""


def distinct_titles(spark, sf):
    """First page of each distinct title, arrival order kept."""
    return research.ordered_distinct(
        _results(spark, sf).select("title", "result_ord"), ["title"], "result_ord")


DISTINCT_TITLES = o.with_(RESULTS) + """
SELECT title, min(result_ord) AS result_ord FROM results GROUP BY 1"""

QUERIES = {
    "page_shapes": (page_shapes, PAGE_SHAPES),
    "serp_analysis": (serp_analysis, SERP_ANALYSIS),
    "opportunity_score": (opportunity_score, OPPORTUNITY_SCORE),
    "keyword_metrics": (keyword_metrics, KEYWORD_METRICS),
    "first_metric": (first_metric, FIRST_METRIC),
    "provider_ledger": (provider_ledger, PROVIDER_LEDGER),
    "operation_ledger": (operation_ledger, OPERATION_LEDGER),
    "job_totals": (job_totals, JOB_TOTALS),
    "usage_backstop": (usage_backstop, USAGE_BACKSTOP),
    "call_budget": (call_budget, CALL_BUDGET),
    "cached_snapshots": (cached_snapshots, CACHED_SNAPSHOTS),
    "outcome_summary": (outcome_summary, OUTCOME_SUMMARY),
    "event_validation": (event_validation, EVENT_VALIDATION),
    "session_funnel": (session_funnel, SESSION_FUNNEL),
    "daily_funnel": (daily_funnel, DAILY_FUNNEL),
    "hourly_events": (hourly_events, HOURLY_EVENTS),
    "distinct_titles": (distinct_titles, DISTINCT_TITLES),
}
