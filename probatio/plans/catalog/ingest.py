"""Registered queries: stored provider JSON, sinks and contexts.

The JSON is written by Spark from the driver tables in the shape providers return it,
one response per page, document or conversation, with broken ones in between.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from probatio import fixed_values as fv
from probatio.operators import matching
from probatio.plans import inputs, oracle as o
from probatio.profiles import contexts
from probatio.sources import research, serp, sinks


# ------------------------------------------------------------- result pages --
def _serp_raw(spark, sf):
    """One response per page: a result, two questions and an unknown feature."""
    p = inputs.table(spark, sf, "pages")
    key = F.col("page_id")
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    none = F.lit(None).cast("string")

    def item(kind, rank, url, name, items):
        return F.struct(F.lit(kind).alias("type"), F.lit(rank).alias("rank_absolute"),
                        url.alias("url"), name.alias("title"), items.alias("items"))

    asked = F.to_json(F.array(F.struct(title.alias("title"))))
    items = F.array(
        item("organic", 1, F.col("url"), title, none),
        item("people_also_ask", 2, none, none, asked),
        item("organic", 3, F.concat("url", F.lit("#2")), none, none),
        item("odd_box", 4, none, none, none))
    body = F.to_json(F.struct(
        F.when(key % 11 == 0, 40000).otherwise(20000).alias("status_code"),
        F.lit("no credit").alias("status_message"), F.lit(0.002).alias("cost"),
        F.when(key % 13 != 0, F.array(F.struct(
            F.concat(F.lit("t"), key.cast("string")).alias("id"),
            F.when(key % 7 == 0, 40501).otherwise(20000).alias("status_code"),
            F.when(key % 5 != 0, F.array(F.struct(
                F.lit("2026-08-12 09:00:00 +00:00").alias("datetime"),
                items.alias("items")))).alias("result")))).alias("tasks")))
    # Nested entries are objects in the wire format, not text.
    return p.select(key.alias("snapshot_id"), F.regexp_replace(
        F.regexp_replace(F.regexp_replace(body, r'"items":"\[', '"items":['),
                         r'\]"\}', "]}"), r'\\"', '"').alias("payload"))


RAW_SERP = """
raw AS (
  SELECT page_id AS k, url, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title,
    CASE WHEN page_id % 11 = 0 THEN 'envelope status 40000: no credit'
         WHEN page_id % 13 = 0 THEN 'response carries no tasks'
         WHEN page_id % 7 = 0 THEN 'task status 40501: no message' END AS reason,
    page_id % 5 <> 0 AS filled FROM pages)"""


def serp_snapshots(spark, sf):
    return serp.ingest_serp(_serp_raw(spark, sf)).snapshot.select(
        "snapshot_id", "task_id", "total_items", "organic_count", "provider_cost_usd",
        F.date_format("retrieved_at", "yyyy-MM-dd HH:mm").alias("retrieved_at"))


SERP_SNAPSHOTS = o.with_(RAW_SERP) + """
SELECT k AS snapshot_id, 't' || k AS task_id, CASE WHEN filled THEN 4 ELSE 0 END
  AS total_items, CASE WHEN filled THEN 2 ELSE 0 END AS organic_count,
  0.002 AS provider_cost_usd,
  CASE WHEN filled THEN '2026-08-12 09:00' END AS retrieved_at
FROM raw WHERE reason IS NULL"""


def serp_quarantine(spark, sf):
    return serp.ingest_serp(_serp_raw(spark, sf)).quarantine


SERP_QUARANTINE = o.with_(RAW_SERP) + \
    "SELECT k AS snapshot_id, reason FROM raw WHERE reason IS NOT NULL"


def serp_results(spark, sf):
    return serp.ingest_serp(_serp_raw(spark, sf)).result.select(
        "snapshot_id", "result_ord", "rank_absolute", "url", "title")


SERP_RESULTS = o.with_(RAW_SERP) + """
SELECT k AS snapshot_id, 0 AS result_ord, 1 AS rank_absolute, url,
       nullif(trim(title), '') AS title
FROM raw WHERE reason IS NULL AND filled
UNION ALL SELECT k, 2, 3, url || '#2', NULL FROM raw WHERE reason IS NULL AND filled"""


def serp_questions(spark, sf):
    return serp.ingest_serp(_serp_raw(spark, sf)).question.select(
        "snapshot_id", "kind", "text", "rank_absolute")


SERP_QUESTIONS = o.with_(RAW_SERP) + """
SELECT k AS snapshot_id, 'PAA' AS kind, trim(title) AS text, 2 AS rank_absolute
FROM raw WHERE reason IS NULL AND filled AND trim(title) <> ''"""


def serp_features(spark, sf):
    return serp.ingest_serp(_serp_raw(spark, sf)).feature


SERP_FEATURES = o.with_(RAW_SERP) + """
SELECT k AS snapshot_id, raw_type, item_type, n AS count, r AS rank_absolute
FROM raw, (VALUES ('organic', 'ORGANIC', 2, 1), ('people_also_ask', 'PEOPLE_ALSO_ASK', 1, 2),
                  ('odd_box', 'OTHER', 1, 4)) AS f(raw_type, item_type, n, r)
WHERE reason IS NULL AND filled"""


# --------------------------------------------------------------- web search --
def _web_raw(spark, sf):
    """One response per retrieval source and language, a document per entry."""
    d = inputs.documents(spark, sf)
    key = F.col("doc_id")
    entry = F.struct(
        key.alias("ord"),
        F.when(key % 4 == 0, F.concat(F.lit("id"), key.cast("string"))).alias("id"),
        F.when(key % 5 != 0, F.col("url")).alias("url"), F.col("title"),
        F.col("body").alias("content"),
        F.when(key % 3 == 0, "2024-05-01").when(key % 3 == 1, "soon")
        .alias("published_date"))
    # Provider responses are small; this only rebuilds their shape for the test.
    grouped = d.groupBy((key / 10).cast("bigint").alias("run_id")).agg(
        F.array_sort(F.collect_list(entry)).alias("e"))
    results = F.transform("e", lambda e: F.struct(
        e["id"].alias("id"), e["url"].alias("url"), e["title"].alias("title"),
        e["content"].alias("content"), e["published_date"].alias("published_date")))
    return grouped.select("run_id", F.when(F.col("run_id") % 9 == 8, F.lit("{}")).otherwise(
        F.to_json(F.struct(results.alias("results")))).alias("payload"))


RAW_WEB = o.DOCUMENTS + """,
entries AS (
  SELECT doc_id // 10 AS run_id, doc_id AS k,
    row_number() OVER (PARTITION BY doc_id // 10 ORDER BY doc_id) - 1 AS ord, url,
    nullif(regexp_replace(title, '^ +| +$', '', 'g'), '') AS title,
    nullif(regexp_replace(body, '^ +| +$', '', 'g'), '') AS body FROM documents_in),
web AS (
  SELECT *, CASE WHEN k % 4 = 0 THEN 'id' || k ELSE 'tavily-' || printf('%03d', ord) END
           AS source_ref, CASE WHEN k % 3 = 0 THEN '2024-05-01' END AS published
  FROM entries WHERE run_id % 9 <> 8 AND k % 5 <> 0)"""


def web_sources(spark, sf):
    return research.ingest_web(_web_raw(spark, sf)).source.select(
        "run_id", "source_ref", "url", "title", "body",
        F.date_format("published_at", "yyyy-MM-dd").alias("published_at"))


WEB_SOURCES = o.with_(RAW_WEB) + """
SELECT run_id, source_ref, url, title, body, published AS published_at FROM web"""


def web_facts(spark, sf):
    return research.ingest_web(_web_raw(spark, sf)).fact.select(
        "run_id", "source_ref", "observability")


WEB_FACTS = o.with_(RAW_WEB) + """
SELECT run_id, source_ref, CASE WHEN published IS NULL THEN 'ESTIMATED' ELSE 'OBSERVED' END
  AS observability FROM web WHERE body IS NOT NULL"""


def web_notes(spark, sf):
    tables = research.ingest_web(_web_raw(spark, sf))
    return tables.run.join(tables.outcome, "run_id").join(
        tables.note, "run_id", "left").select(
            "run_id", "status", "state", "item_count", "note")


WEB_NOTES = o.with_(RAW_WEB) + """,
counts AS (
  SELECT run_id, count(*) AS n, count(*) FILTER (published IS NULL) AS u
  FROM web GROUP BY 1)
SELECT run_id, 'SUCCEEDED' AS status, 'ok' AS state, n AS item_count,
  CASE WHEN u > 0 THEN u || ' of ' || n || ' web sources carry no publication date; their claims cannot be placed in time and are marked ESTIMATED.' END AS note
FROM counts"""


# ---------------------------------------------------------- community report --
_VERSIONS = ("1.2", "1.3", "1.1", "2.0", "1.x", None, "1.4")


def _community_raw(spark, sf):
    """One report per conversation, an item per turn."""
    c = inputs.table(spark, sf, "conversations")
    ref = F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    item = F.struct(
        F.col("turn").alias("ord"), ref.alias("candidate_id"),
        inputs.first_sentence(F.col("text")).alias("title"), F.col("role").alias("source"),
        F.when(F.col("turn") != 3, F.concat(F.lit("https://c.example/"), ref))
        .alias("url"),
        F.when(F.col("turn") % 2 == 0, "2024-05-01T10:00:00Z").alias("published_at"))
    grouped = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(item)).alias("e"))
    results = F.transform("e", lambda e: F.struct(*[e[n].alias(n) for n in (
        "candidate_id", "title", "source", "url", "published_at")]))
    verdicts = F.transform("e", lambda e: F.struct(
        e["candidate_id"].alias("candidate_id"),
        F.get(F.array(F.lit("stale"), F.lit("odd"), F.lit("contradicted")),
              (e["ord"] % 3).cast("int"))
        .alias("verdict")))
    version = F.get(F.array(*[F.lit(v).cast("string") for v in _VERSIONS]),
                    (F.col("conv_id") % len(_VERSIONS)).cast("int"))
    status = F.create_map(
        F.lit("user"), F.lit("ok"), F.lit("assistant"), F.when(
            F.col("conv_id") % 2 == 0, "timeout").otherwise("weird"),
        F.lit("web"), F.lit("skipped-unconfigured"), F.lit("forum"), F.lit("no-results"))
    return grouped.select(F.col("conv_id").alias("run_id"), F.to_json(F.struct(
        version.alias("schema_version"), F.lit("2024-05-02T00:00:00Z")
        .alias("generated_at"), status.alias("source_status"),
        verdicts.alias("freshness_verdicts"), F.array(F.struct(F.concat(
            F.lit("theme "), F.col("conv_id").cast("string")).alias("title")))
        .alias("clusters"), results.alias("results"))).alias("payload"))


RAW_COMMUNITY = f"""
reports AS (
  SELECT *, conv_id || '-' || turn AS ref, [{", ".join(
      "NULL" if v is None else o.quoted(v) for v in _VERSIONS)}][conv_id % 7 + 1] AS v,
    regexp_extract(text, '^[^.!?\\n]*') AS t FROM conversations),
good AS (SELECT * FROM reports WHERE v IN ('1.2', '1.3', '1.4')),
items AS (
  SELECT conv_id AS run_id, ref AS source_ref, role AS source_type,
    CASE WHEN turn <> 3 THEN 'https://c.example/' || ref END AS url,
    CASE role WHEN 'user' THEN 'ok' WHEN 'assistant' THEN CASE WHEN conv_id % 2 = 0
         THEN 'timeout' ELSE 'schema-drift' END ELSE 'ok' END AS state,
    CASE turn % 3 WHEN 0 THEN 'stale' WHEN 2 THEN 'contradicted' END AS verdict,
    turn % 2 = 0 AS dated, nullif(regexp_replace(t, '^ +| +$', '', 'g'), '') AS title
  FROM good)"""


def community_sources(spark, sf):
    return research.ingest_community(_community_raw(spark, sf)).source.select(
        "run_id", "source_ref", "source_type", "state", "url", "title",
        "freshness_verdict", F.col("published_at").isNotNull().alias("dated"))


COMMUNITY_SOURCES = o.with_(RAW_COMMUNITY) + """
SELECT run_id, source_ref, source_type, state, url, title, verdict AS freshness_verdict,
       dated FROM items"""


def community_facts(spark, sf):
    return research.ingest_community(_community_raw(spark, sf)).fact.select(
        "run_id", "source_ref", "observability")


COMMUNITY_FACTS = o.with_(RAW_COMMUNITY) + """
SELECT run_id, source_ref, CASE WHEN verdict = 'contradicted' THEN 'UNKNOWN'
    WHEN verdict = 'stale' OR NOT dated THEN 'ESTIMATED' ELSE 'OBSERVED' END
  AS observability
FROM items WHERE url IS NOT NULL AND title IS NOT NULL"""


def community_outcomes(spark, sf):
    tables = research.ingest_community(_community_raw(spark, sf))
    return tables.outcome.join(tables.run, "run_id")


COMMUNITY_OUTCOMES = o.with_(RAW_COMMUNITY) + """
SELECT DISTINCT g.conv_id AS run_id, s AS source_type,
  CASE s WHEN 'user' THEN 'ok' WHEN 'web' THEN 'skipped-unconfigured'
       WHEN 'forum' THEN 'no-results' ELSE CASE WHEN g.conv_id % 2 = 0 THEN 'timeout'
       ELSE 'schema-drift' END END AS state,
  (SELECT count(*) FROM items i WHERE i.run_id = g.conv_id AND i.source_type = s)
    AS item_count, 'PARTIAL' AS status
FROM good g, (SELECT unnest(['user', 'assistant', 'web', 'forum']) AS s)"""


def contract_gate(spark, sf):
    return research.ingest_community(_community_raw(spark, sf)).quarantine


CONTRACT_GATE = o.with_(RAW_COMMUNITY) + """
SELECT DISTINCT conv_id AS run_id, CASE v WHEN '1.1' THEN 'contract minor 1 below minimum 2'
    WHEN '2.0' THEN 'unsupported contract major 2'
    WHEN '1.x' THEN 'malformed schema_version: 1.x'
    ELSE 'report has no schema_version' END AS reason
FROM reports WHERE v IS NULL OR v NOT IN ('1.2', '1.3', '1.4')"""


# -------------------------------------------------------------------- sinks --
def source_sink(spark, sf):
    """Sources with decisions, plus a row per outcome that yielded no item."""
    tables = research.ingest_community(_community_raw(spark, sf))
    decisions = tables.source.where("url is not null").select(
        "run_id", "source_ref", F.lit("RELEVANT").alias("relevance_status"))
    return sinks.source_rows(
        tables.source.select("run_id", "source_ref", "source_type", "url", "state"),
        tables.outcome, decisions).select(
            "run_id", "source_ref", "source_type", "state", "relevance_status",
            "no_item_reason")


SOURCE_SINK = o.with_(RAW_COMMUNITY) + """
SELECT run_id, source_ref, source_type, state,
  CASE WHEN url IS NOT NULL THEN 'RELEVANT' END AS relevance_status,
  NULL::VARCHAR AS no_item_reason FROM items
UNION ALL
SELECT DISTINCT g.conv_id, NULL, s, st, NULL, st FROM (
  SELECT conv_id, s, CASE s WHEN 'user' THEN 'ok' WHEN 'web' THEN 'skipped-unconfigured'
    WHEN 'forum' THEN 'no-results' ELSE CASE WHEN conv_id % 2 = 0 THEN 'timeout'
    ELSE 'schema-drift' END END AS st
  FROM good, (SELECT unnest(['user', 'assistant', 'web', 'forum']) AS s)) g
WHERE NOT EXISTS (SELECT 1 FROM items i WHERE i.run_id = g.conv_id AND i.source_type = s)"""


def search_contexts(spark, sf):
    """Customers as requests for a market, language and device."""
    c = inputs.table(spark, sf, "customer")
    markets, languages = (F.array(*[F.lit(x) for x in xs]) for xs in (
        ("be", "FR", "NL", "de"), ("fr", "NL", "de")))
    requests = c.select(
        "c_custkey", F.get(markets, F.col("c_nationkey") % 4).alias("market"),
        F.get(languages, (F.col("c_custkey") % 3).cast("int")).alias("language"),
        F.when(F.col("c_acctbal") > 0, "desktop").otherwise("mobile").alias("device"))
    return sinks.with_context(requests, contexts(spark)).select(
        "c_custkey", "market", "language", "device", "location_code", "se_domain", "os",
        "refusal")


SEARCH_CONTEXTS = f"""
WITH ctx(market, language, location_code, domain) AS (VALUES {", ".join(
    f"('{m}', '{l}', {c}, '{d}')" for m, l, c, _p, _n, d in fv.SEARCH_CONTEXTS)}),
req AS (
  SELECT c_custkey, ['BE', 'FR', 'NL', 'DE'][c_nationkey % 4 + 1] AS market,
    ['fr', 'nl', 'de'][c_custkey % 3 + 1] AS language,
    CASE WHEN c_acctbal > 0 THEN 'desktop' ELSE 'mobile' END AS device FROM customer)
SELECT c_custkey, market, language, device, location_code, domain AS se_domain,
  CASE WHEN location_code IS NOT NULL THEN CASE device WHEN 'mobile' THEN 'android'
       ELSE 'windows' END END AS os,
  CASE WHEN location_code IS NULL THEN 'no search context configured for market=' || market
       || ' language=' || language END AS refusal
FROM req LEFT JOIN ctx USING (market, language)"""


def category_compatibility(spark, sf):
    """Part types as claim categories against brands as passage categories."""
    p = inputs.table(spark, sf, "part")
    categories = F.array(*[F.lit(c) for c in fv.CLAIM_CATEGORIES])
    rows = p.select(
        F.get(categories, (F.col("p_partkey") % 16).cast("int")).alias("claim_category"),
        F.get(categories, (F.col("p_size") % 16).cast("int")).alias("passage_category"))
    return rows.groupBy("claim_category", "passage_category").agg(
        F.count("*").alias("pairs")).withColumn(
            "compatible", matching.compatible_categories(
                F.col("claim_category"), F.col("passage_category")))


_PAIRS = [f"{c}>{p}" for c, ps in fv.COMPATIBLE_CATEGORIES.items() for p in ps]
CATEGORY_COMPATIBILITY = f"""
SELECT c AS claim_category, p AS passage_category, count(*) AS pairs,
  c = p OR c NOT IN ({o.listed(fv.COMPATIBLE_CATEGORIES)})
    OR c || '>' || p IN ({o.listed(_PAIRS)}) AS compatible
FROM (SELECT [{o.listed(fv.CLAIM_CATEGORIES)}][p_partkey % 16 + 1] AS c,
             [{o.listed(fv.CLAIM_CATEGORIES)}][p_size % 16 + 1] AS p FROM part)
GROUP BY 1, 2"""


def ingested_metrics(spark, sf):
    """Metrics read from provider JSON: a response per part, every ninth one refused."""
    p, key = inputs.table(spark, sf, "part"), F.col("p_partkey")

    def entry(keyword):
        return F.struct(
            keyword.alias("keyword"), F.when(F.col("p_size") > 10, F.col("p_size") * 10)
            .alias("search_volume"), F.round("p_retailprice", 2).alias("cpc"),
            F.when(key % 3 > 0, F.col("p_size")).alias("competition_index"),
            F.when(key % 4 > 0, F.lower("p_type")).otherwise(" ").alias("competition"))

    payload = F.to_json(F.struct(
        F.when(key % 9 == 0, 40000).otherwise(20000).alias("status_code"),
        F.array(F.struct(F.array(
            entry(F.concat_ws(" ", F.lit(" "), "p_name", key.cast("string"))),
            entry(F.lit("  "))).alias("result"))).alias("tasks")))
    return serp.ingest_metrics(p.select(key.alias("batch_id"), payload.alias("payload"))).select(
        "keyword", "metric_ord", "metric_type", "value", "value_text", "currency")


INGESTED_METRICS = """
WITH good AS (SELECT *, p_name || ' ' || p_partkey AS keyword FROM part WHERE p_partkey % 9 <> 0)
SELECT keyword, 0 AS metric_ord, 'search_volume' AS metric_type, CAST(p_size * 10 AS DOUBLE) AS value,
       NULL AS value_text, NULL AS currency FROM good WHERE p_size > 10
UNION ALL SELECT keyword, 1, 'cpc', round(p_retailprice, 2), NULL, 'USD' FROM good
UNION ALL SELECT keyword, 2, 'competition_index', CAST(p_size AS DOUBLE), NULL, NULL FROM good
  WHERE p_partkey % 3 > 0
UNION ALL SELECT keyword, 3, 'competition', NULL, lower(p_type), NULL FROM good
  WHERE p_partkey % 4 > 0"""


QUERIES = {
    "ingested_metrics": (ingested_metrics, INGESTED_METRICS),
    "serp_snapshots": (serp_snapshots, SERP_SNAPSHOTS),
    "serp_quarantine": (serp_quarantine, SERP_QUARANTINE),
    "serp_results": (serp_results, SERP_RESULTS),
    "serp_questions": (serp_questions, SERP_QUESTIONS),
    "serp_features": (serp_features, SERP_FEATURES),
    "web_sources": (web_sources, WEB_SOURCES),
    "web_facts": (web_facts, WEB_FACTS),
    "web_notes": (web_notes, WEB_NOTES),
    "community_sources": (community_sources, COMMUNITY_SOURCES),
    "community_facts": (community_facts, COMMUNITY_FACTS),
    "community_outcomes": (community_outcomes, COMMUNITY_OUTCOMES),
    "contract_gate": (contract_gate, CONTRACT_GATE),
    "source_sink": (source_sink, SOURCE_SINK),
    "search_contexts": (search_contexts, SEARCH_CONTEXTS),
    "category_compatibility": (category_compatibility, CATEGORY_COMPATIBILITY),
}
