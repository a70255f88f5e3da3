"""Registered queries: query profiles, relevance and labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from probatio import fixed_values as fv
from probatio.functions import text
from probatio.operators import authority, classify, gate, research
from probatio.plans import inputs, oracle as o
from probatio.plans.probe import PROFILE

PROFILES = o.query_profiles(PROFILE)


def _profiles(spark, sf):
    return gate.query_profile(inputs.queries(spark, sf), PROFILE)


def _joined(column):
    return F.array_join(column, " ").alias(column)


# ------------------------------------------------------------------ queries --
def query_profile(spark, sf):
    return _profiles(spark, sf).select(
        "package_id", "query", _joined("topic_tokens"), _joined("modifier_tokens"),
        _joined("market_tokens"))


QUERY_PROFILE = o.with_(PROFILES) + """
SELECT package_id, query, array_to_string(topic, ' ') AS topic_tokens,
       array_to_string(modifier, ' ') AS modifier_tokens,
       array_to_string(market, ' ') AS market_tokens
FROM profiles"""


def relevance_gate_corpus(spark, sf):
    return gate.gate_corpus(_profiles(spark, sf), inputs.documents(spark, sf))


_HOST_WORDS = f"replace(coalesce({o.host('url')}, ''), '.', ' ')"
CORPUS = o.DOCUMENTS + f""",
docs AS (
  SELECT doc_id, {o.tokens('title')} AS tt, {o.tokens('body')} AS bt,
         {o.tokens(_HOST_WORDS)} AS dt FROM documents_in),
pairs AS (
  SELECT package_id, doc_id, len(topic) AS n_topic, len(modifier) AS n_modifier,
         len(list_intersect(topic, list_distinct(list_concat(tt, bt, dt)))) AS topic_hits,
         len(list_intersect(topic, tt)) AS title_hits,
         len(list_intersect(topic, bt)) AS body_hits,
         len(list_intersect(topic, dt)) AS domain_hits,
         len(list_intersect(modifier, list_distinct(list_concat(tt, bt))))
           AS modifier_hits
  FROM profiles, docs WHERE len(topic) > 0),
hits AS (
  SELECT *, {o.gate_score('n_topic', 'n_modifier', 'title_hits', 'body_hits',
                          'domain_hits', 'modifier_hits')} AS relevance_score
  FROM pairs WHERE topic_hits > 0)"""
RELEVANCE_GATE_CORPUS = o.with_(PROFILES, CORPUS) + f"""
SELECT package_id, doc_id, n_topic, topic_hits, title_hits, body_hits, domain_hits,
       modifier_hits, relevance_score,
       {o.gate_status('relevance_score')} AS relevance_status
FROM hits"""


def corpus_relevance_summary(spark, sf):
    return gate.corpus_summary(
        _profiles(spark, sf), inputs.documents(spark, sf)
    ).withColumn("mean_relevance", F.round("mean_relevance", 6))


CORPUS_RELEVANCE_SUMMARY = o.with_(PROFILES, CORPUS) + f"""
, found AS (
  SELECT package_id, count(*) AS c, sum(relevance_score) AS s,
         count(*) FILTER (relevance_score >= {fv.RELEVANT_AT}) AS rel,
         count(*) FILTER (relevance_score >= {fv.LOW_RELEVANCE_AT}
                          AND relevance_score < {fv.RELEVANT_AT}) AS low,
         count(*) FILTER (relevance_score < {fv.LOW_RELEVANCE_AT}) AS weak
  FROM hits GROUP BY 1)
SELECT package_id, n AS evaluated, coalesce(rel, 0) AS eligible,
       n - coalesce(rel, 0) AS rejected, coalesce(low, 0) AS low_relevance,
       coalesce(weak, 0) AS weak_match,
       CASE WHEN len(topic) > 0 THEN n - coalesce(c, 0) ELSE 0 END AS no_topic_overlap,
       CASE WHEN len(topic) > 0 THEN 0 ELSE n END AS unknown,
       round(coalesce(s, 0) / n, 6) AS mean_relevance
FROM profiles LEFT JOIN found USING (package_id),
     (SELECT count(*) AS n FROM documents)"""


def _gated(spark, sf):
    return gate.gate_sources(inputs.sources(spark, sf), _profiles(spark, sf))


def relevance_gate_sources(spark, sf):
    return _gated(spark, sf).select(
        "package_id", "doc_id", "relevance_status", "relevance_score", "relevance_reason",
        _joined("topic_matched"), _joined("modifier_matched"))


GATED = o.gate_rows("sources_in", PROFILE)
_REASON = f"""
CASE WHEN relevance_status = 'UNKNOWN' THEN 'Query carries no topical tokens; relevance cannot be assessed deterministically.'
     WHEN len(topic_matched) = 0 THEN 'No topical overlap with the query. The query is about '
          || array_to_string(topic, ', ') || '; this source matched only '
          || CASE WHEN len(modifier_matched) = 0 THEN 'nothing'
                  ELSE array_to_string(modifier_matched, ', ') END || '.'
     WHEN relevance_status = 'RELEVANT' THEN 'Covers ' || len(topic_matched) || '/'
          || len(topic) || ' topic tokens (score ' || shown || ').'
     WHEN relevance_status = 'LOW_RELEVANCE' THEN 'Partial topical match, score ' || shown
          || ' below the {fv.RELEVANT_AT:.2f} threshold.'
     ELSE 'Topical match too weak, score ' || shown
          || ' below the {fv.LOW_RELEVANCE_AT:.2f} floor.' END"""
RELEVANCE_GATE_SOURCES = o.with_(PROFILES, o.SOURCES, GATED) + f"""
SELECT package_id, doc_id, relevance_status, relevance_score,
       {_REASON} AS relevance_reason,
       array_to_string(topic_matched, ' ') AS topic_matched,
       array_to_string(modifier_matched, ' ') AS modifier_matched
FROM (SELECT *, printf('%.2f', relevance_score) AS shown FROM gated)"""


def relevance_summary(spark, sf):
    return gate.relevance_summary(_gated(spark, sf)).withColumn(
        "mean_relevance", F.round("mean_relevance", 6))


RELEVANCE_SUMMARY = o.with_(PROFILES, o.SOURCES, GATED) + """
SELECT package_id, count(*) AS evaluated,
       count(*) FILTER (relevance_status = 'RELEVANT') AS eligible,
       count(*) FILTER (relevance_status != 'RELEVANT') AS rejected,
       count(*) FILTER (relevance_status = 'LOW_RELEVANCE') AS low_relevance,
       count(*) FILTER (relevance_status = 'IRRELEVANT') AS irrelevant,
       count(*) FILTER (relevance_status = 'UNKNOWN') AS unknown,
       round(avg(relevance_score), 6) AS mean_relevance
FROM gated GROUP BY 1"""


def claim_relevance(spark, sf):
    decisions = _gated(spark, sf)
    claims = inputs.sources(spark, sf).select(
        "package_id", "source_ref",
        F.posexplode(text.split_sentences(F.col("body"))).alias("claim_ord", "claim"))
    return gate.gate_claims(claims, decisions, _profiles(spark, sf)).select(
        "package_id", "source_ref", "claim_ord", "relevance_status", "relevance_score")


_CLAIM_ROWS = f"""
claim_rows AS (
  SELECT package_id, source_ref, status AS source_status, i - 1 AS claim_ord,
         CAST(NULL AS VARCHAR) AS title, parts[i] AS body, CAST(NULL AS VARCHAR) AS url
  FROM (SELECT package_id, source_ref, relevance_status AS status,
               {o.sentences('body')} AS parts FROM gated),
       unnest(generate_series(1, len(parts))) AS u(i))"""
CLAIM_RELEVANCE = o.with_(
    PROFILES, o.SOURCES, GATED, _CLAIM_ROWS,
    o.gate_rows("claim_rows", PROFILE).replace("tokenised", "tokenised2")
    .replace("counted", "counted2").replace("scored", "scored2")
    .replace("gated", "gated2")) + """
SELECT package_id, source_ref, claim_ord,
       CASE WHEN source_status = 'IRRELEVANT' THEN 'IRRELEVANT'
            WHEN source_status = 'LOW_RELEVANCE' AND relevance_status = 'RELEVANT'
            THEN 'LOW_RELEVANCE' ELSE relevance_status END AS relevance_status,
       CASE WHEN source_status = 'IRRELEVANT' THEN 0.0 ELSE relevance_score END
         AS relevance_score
FROM gated2"""


def _review(rows):
    """Stand-in for a model: license pages are on topic, short ones are not."""
    body = rows["body"]
    verdict = body.map(lambda b: "RELEVANT" if "icense" in b
                       else ("IRRELEVANT" if len(b) < 1500 else "UNSURE"))
    return rows.assign(verdict=verdict, verdict_reason="length " + body.str.len()
                       .astype(str))


def ambiguous_review(spark, sf):
    rows = _gated(spark, sf).select("package_id", "doc_id", "body", "relevance_status",
                                    "relevance_score", "relevance_reason")
    return gate.review_ambiguous(rows, _review).select(
        "package_id", "doc_id", "relevance_status", "relevance_score", "relevance_stage")


AMBIGUOUS_REVIEW = o.with_(PROFILES, o.SOURCES, GATED) + f"""
SELECT package_id, doc_id,
       CASE WHEN up THEN 'RELEVANT' WHEN down THEN 'IRRELEVANT' ELSE relevance_status END
         AS relevance_status,
       CASE WHEN up THEN greatest(relevance_score, {fv.REVIEW_PROMOTED_FLOOR})
            WHEN down THEN least(relevance_score, {fv.REVIEW_DEMOTED_CEILING})
            ELSE relevance_score END AS relevance_score,
       CASE WHEN up OR down THEN 'semantic' ELSE 'deterministic' END AS relevance_stage
FROM (SELECT *, relevance_status = 'LOW_RELEVANCE' AND contains(body, 'icense') AS up,
             relevance_status = 'LOW_RELEVANCE' AND NOT contains(body, 'icense')
             AND length(body) < 1500 AS down FROM gated)"""


# ------------------------------------------------------------ classification --
def intent_classification(spark, sf):
    rows = inputs.documents(spark, sf).select("doc_id", F.col("title").alias("query"))
    return classify.classify_queries(rows, PROFILE).select(
        "doc_id", "intent", "content_type", F.col("cta.code").alias("cta_code"),
        F.col("cta.reason").alias("cta_reason"))


def _plain(x: str) -> str:
    for term in PROFILE.market_terms:
        x = f"replace({x}, {o.quoted(text.local_normalise(term))}, ' ')"
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"


_QUESTION = r"\b(" + "|".join(fv.QUESTION_WORDS).replace("'", "''") + r")\b"
INTENTS = f"""
normed AS (SELECT doc_id, {o.norm('title')} AS n FROM documents_in),
plained AS (SELECT doc_id, n, {_plain('n')} AS p FROM normed),
intents AS (
  SELECT doc_id, n, CASE
    WHEN {o.contains('p', PROFILE.comparison_terms)} THEN 'COMMERCIAL'
    WHEN {o.contains('p', PROFILE.commercial_terms)} THEN
      CASE WHEN {o.contains('p', PROFILE.local_terms)} THEN 'LOCAL' ELSE 'COMMERCIAL' END
    WHEN regexp_matches(p, '{_QUESTION}') THEN 'INFORMATIONAL'
    WHEN {o.contains('p', PROFILE.local_terms)} THEN 'LOCAL'
    ELSE 'INFORMATIONAL' END AS intent
  FROM plained)"""
INTENT_CLASSIFICATION = o.with_(o.DOCUMENTS, INTENTS) + f"""
SELECT doc_id, intent,
       CASE WHEN {o.contains('n', PROFILE.comparison_terms)} THEN 'COMPARISON'
            WHEN intent IN ('COMMERCIAL', 'LOCAL') THEN 'LANDING_PAGE'
            ELSE 'GUIDE' END AS content_type,
       CASE intent WHEN 'COMMERCIAL' THEN 'quote' WHEN 'LOCAL' THEN 'callback'
            ELSE 'guide' END AS cta_code,
       'matches ' || intent || ' intent' AS cta_reason
FROM intents"""


def provider_routing(spark, sf):
    rows = inputs.documents(spark, sf).select("doc_id", F.col("title").alias("query"))
    forced = inputs.table(spark, sf, "labels").select(
        "doc_id", (F.col("toxic") == 1).alias("force"))
    routed = classify.classify_queries(rows, PROFILE).join(forced, "doc_id", "left")
    return classify.provider_plan(routed, PROFILE, "force").select(
        "doc_id", "intent", "serp", "web_research", "community", "keyword_metrics",
        "community_reason")


PROVIDER_ROUTING = o.with_(o.DOCUMENTS, INTENTS) + f"""
SELECT i.doc_id, intent, true AS serp, true AS web_research,
       coalesce(toxic = 1, false) AS community, true AS keyword_metrics,
       CASE WHEN toxic = 1 THEN 'explicitly forced on by the operator'
            WHEN toxic = 0 THEN 'explicitly forced off by the operator'
            ELSE 'vertical {PROFILE.code} does not enable community research (its audience is not the technical community this provider indexes)'
       END AS community_reason
FROM intents i LEFT JOIN labels l ON l.doc_id = i.doc_id"""


# ------------------------------------------------------------------ sources --
_HOSTS = ("ores.be", "data.gov", "kuleuven.be", "www.ulb.ac.be", "box.com", "reddit.com",
          "solar-shop.be", "plain.example")


def _quality_rows(spark, sf):
    pages = inputs.table(spark, sf, "pages")
    hosts = F.array(*[F.lit(h) for h in _HOSTS])
    swapped = F.concat(F.lit("https://"), F.get(hosts, (
        F.col("page_id") % len(_HOSTS)).cast("int")), F.lit("/p"))
    channel = F.when(F.col("page_id") % 3 == 0, "youtube").otherwise("web")
    both = pages.select("page_id", "url", F.lit("web").alias("source_type")).unionByName(
        pages.select("page_id", swapped.alias("url"), channel.alias("source_type")))
    return both.withColumn("host", text.bare_host(F.col("url"))).withColumn(
        "source_quality", classify.source_quality(
            F.col("url"), F.col("host"), F.col("source_type")))


def source_quality(spark, sf):
    return _quality_rows(spark, sf).select("page_id", "url", "host", "source_quality")


def _ends(x: str, suffixes) -> str:
    return "(" + " OR ".join(f"ends_with({x}, {o.quoted(s)})" for s in suffixes) + ")"


QUALITY = f"""
page_urls AS (
  SELECT page_id, url, 'web' AS source_type FROM pages
  UNION ALL
  SELECT page_id, 'https://' || [{o.listed(_HOSTS)}][page_id % {len(_HOSTS)} + 1] || '/p',
         CASE WHEN page_id % 3 = 0 THEN 'youtube' ELSE 'web' END FROM pages),
hosted AS (SELECT *, {o.bare_host('url')} AS host FROM page_urls),
rated AS (
  SELECT *, CASE
    WHEN host IN ({o.listed(fv.OFFICIAL_HOSTS)}) OR {_ends('host', fv.OFFICIAL_SUFFIXES)}
      THEN 'OFFICIAL'
    WHEN host IN ({o.listed(fv.INSTITUTIONAL_HOSTS)})
      OR {_ends('host', fv.INSTITUTIONAL_SUFFIXES)} THEN 'INSTITUTIONAL'
    WHEN {_ends('host', fv.COMMUNITY_HOSTS)}
      OR source_type IN ({o.listed(fv.COMMUNITY_CHANNELS)}) THEN 'COMMUNITY'
    WHEN {o.contains('host', fv.SPECIALIST_HINTS)} THEN 'SPECIALIST'
    ELSE 'COMMERCIAL' END AS source_quality
  FROM hosted)"""
SOURCE_QUALITY = o.with_(QUALITY) + "SELECT page_id, url, host, source_quality FROM rated"


def source_quality_summary(spark, sf):
    rows = _quality_rows(spark, sf).withColumn("package_id", F.col("page_id") % 7)
    return classify.quality_summary(rows)


SOURCE_QUALITY_SUMMARY = o.with_(QUALITY) + f"""
SELECT page_id % 7 AS package_id,
       {", ".join(f"count(*) FILTER (source_quality = '{q}') AS {q.lower()}"
                  for q in fv.QUALITY_RANK)},
       bool_or(source_quality = 'OFFICIAL') AS has_official,
       bool_or(source_quality = 'INSTITUTIONAL') AS has_institutional,
       arg_max(source_quality, {o.rank('source_quality', fv.QUALITY_RANK)}) AS best
FROM rated GROUP BY 1"""


# -------------------------------------------------------------- authorities --
def authority_lookup(spark, sf):
    return authority.lookup(inputs.documents(spark, sf), PROFILE).select(
        "doc_id", "authority_domain", "authority_type", "authority_region",
        "authority_priority")


def _registry() -> str:
    rows = ", ".join(
        f"({o.quoted(d)}, {o.quoted(t)}, {o.quoted(r)}, {o.array(c)}, {p})"
        for d, t, r, _m, _l, c, p, _n in PROFILE.registry_rows())
    return (f"registry(domain, authority_type, region, categories, priority) AS "
            f"(VALUES {rows})")


LOOKED_UP = _registry() + f""",
looked_up AS (
  SELECT d.*, r.domain AS authority_domain, r.authority_type, r.region AS authority_region,
         r.categories AS authority_categories, r.priority AS authority_priority
  FROM documents_in d LEFT JOIN registry r
    ON {o.bare_host('d.url')} = r.domain
    OR ends_with({o.bare_host('d.url')}, '.' || r.domain)
  QUALIFY row_number() OVER (PARTITION BY d.doc_id ORDER BY length(r.domain) DESC) = 1)"""
AUTHORITY_LOOKUP = o.with_(o.DOCUMENTS, LOOKED_UP) + """
SELECT doc_id, authority_domain, authority_type, authority_region, authority_priority
FROM looked_up"""


def _cover(evidence: str, claim: str) -> str:
    pairs = [f"{e}>{c}" for e, c in PROFILE.region_cover_pairs()]
    return f"(({evidence}) || '>' || ({claim}) IN ({o.listed(pairs)}))"


def region_sql(normal: str, default: str = "'UNKNOWN'") -> str:
    ordered = ["BE-WAL", "BE-BRU", "BE-VLG", "BE"]
    return o.case([(o.has_term(normal, PROFILE.region_terms[r]), o.quoted(r))
                   for r in ordered], default)


def region_detection(spark, sf):
    return inputs.documents(spark, sf).withColumn(
        "_n", text.normalise(F.col("body"))).select(
            "doc_id", classify.region(F.col("_n"), PROFILE).alias("region"))


REGION_DETECTION = f"""
SELECT doc_id, {region_sql('n')} AS region
FROM (SELECT doc_id, {o.norm('text')} AS n FROM documents)"""


def region_cover(spark, sf):
    """Documents whose region may support the region of their nation's customers."""
    wanted = inputs.table(spark, sf, "nation").join(
        inputs.table(spark, sf, "customer"),
        F.col("n_nationkey") == F.col("c_nationkey")).select(
            "c_custkey", _nation_region(F.col("n_regionkey")).alias("claim_region"))
    evidence = inputs.documents(spark, sf).withColumn(
        "_n", text.normalise(F.col("body"))).groupBy(
            classify.region(F.col("_n"), PROFILE).alias("evidence_region")).agg(
                F.count("*").alias("documents"))
    cover = PROFILE.region_cover(spark)
    usable = cover.join(evidence, "evidence_region").groupBy("claim_region").agg(
        F.sum("documents").alias("documents"))
    return wanted.groupBy("claim_region").agg(F.count("*").alias("customers")).join(
        usable, "claim_region", "left")


_NATION_REGIONS = ("BE", "BE-WAL", "BE-BRU", "BE-VLG", "FR")


def _nation_region(key):
    return F.get(F.array(*[F.lit(r) for r in _NATION_REGIONS]), key)


REGION_COVER = f"""
WITH evidence AS (
  SELECT {region_sql('n')} AS evidence_region, count(*) AS documents
  FROM (SELECT {o.norm('text')} AS n FROM documents) GROUP BY 1),
wanted AS (
  SELECT [{o.listed(_NATION_REGIONS)}][n_regionkey + 1] AS claim_region,
         count(*) AS customers
  FROM nation JOIN customer ON n_nationkey = c_nationkey GROUP BY 1)
SELECT claim_region, customers, sum(documents)::BIGINT AS documents
FROM wanted LEFT JOIN evidence ON {_cover('evidence_region', 'claim_region')}
GROUP BY ALL"""


def authority_candidates(spark, sf):
    parts = inputs.table(spark, sf, "part").select(
        "p_partkey", F.get(F.array(*[F.lit(c) for c in _PART_CATEGORIES]),
                           (F.col("p_size") % len(_PART_CATEGORIES)).cast("int"))
        .alias("category"),
        F.get(F.array(*[F.lit(r) for r in _PART_REGIONS]),
              (F.col("p_partkey") % len(_PART_REGIONS)).cast("int")).alias("region"))
    return authority.candidates(parts, PROFILE).select(
        "p_partkey", "category", "region", "domain", "priority", "authority_region")


_PART_CATEGORIES = ("SUBSIDY", "TAX", "GRID_RULE", "GENERAL")
_PART_REGIONS = ("BE", "BE-WAL", "BE-BRU", "UNKNOWN", "FR")
AUTHORITY_CANDIDATES = o.with_(_registry()) + f"""
SELECT p_partkey, category, p.region AS region, domain, priority,
       r.region AS authority_region
FROM (SELECT p_partkey, [{o.listed(_PART_CATEGORIES)}][p_size % 4 + 1] AS category,
             [{o.listed(_PART_REGIONS)}][p_partkey % 5 + 1] AS region FROM part) p
JOIN registry r ON (len(categories) = 0 OR list_contains(categories, category))
 AND (p.region = 'UNKNOWN' OR {_cover('r.region', 'p.region')}
      OR {_cover('p.region', 'r.region')})"""


# ---------------------------------------------------------------- freshness --
AS_OF_YEAR = 2007


def _dated_pages(spark, sf):
    """Orders as pages that state when they hold."""
    day = F.date_format(F.add_months("o_orderdate", 120), "dd/MM/yyyy")
    orders = inputs.table(spark, sf, "orders")
    body = F.concat(
        F.when(F.col("o_orderpriority") == "1-URGENT", "Page archivée. ")
        .when(F.col("o_orderpriority") == "2-HIGH", "Actuellement ouvert. ")
        .otherwise("Conditions. "),
        F.when(F.col("o_orderstatus") == "P", F.concat(F.lit("Valable jusqu'au "), day))
        .when(F.col("o_orderstatus") == "F", F.concat(
            F.lit("Dernière mise à jour : "), day))
        .otherwise(F.concat(F.lit("Somme "), F.floor("o_totalprice").cast("string"))),
        F.lit("."))
    published = F.when((F.col("o_orderstatus") == "O") & (F.col("o_custkey") % 2 == 0),
                       F.col("o_orderdate").cast("timestamp"))
    return orders.select("o_orderkey", body.alias("body"),
                         published.alias("published_at"))


def freshness(spark, sf):
    rows = _dated_pages(spark, sf).withColumn("_n", text.normalise(F.col("body")))
    return classify.with_freshness(rows, "body", "_n", AS_OF_YEAR).select(
        "o_orderkey", "freshness_status", "effective_until", "freshness_note",
        F.concat_ws("; ", "freshness_signals").alias("signals"))


FRESHNESS = f"""
WITH raw AS (
  SELECT *, strftime(o_orderdate + INTERVAL 120 MONTH, '%d/%m/%Y') AS d FROM orders),
read AS (
  SELECT o_orderkey, o_orderpriority = '1-URGENT' AS hist,
         o_orderpriority = '2-HIGH' AS cur,
         CASE WHEN o_orderstatus = 'F' THEN d END AS updated,
         CASE WHEN o_orderstatus = 'P' THEN d END AS until_,
         year(o_orderdate) + 10 AS y,
         (o_orderstatus = 'O' AND o_custkey % 2 = 0) AS published FROM raw)
SELECT o_orderkey, CASE WHEN hist THEN 'HISTORICAL'
    WHEN until_ IS NOT NULL AND y < {AS_OF_YEAR} AND y >= 2000 THEN 'DATED_EXPIRED'
    WHEN published OR updated IS NOT NULL THEN 'DATED_CURRENT'
    WHEN cur THEN 'UNDATED_CURRENT' ELSE 'UNDATED' END AS freshness_status,
  until_ AS effective_until,
  CASE WHEN hist THEN 'Page presents as no longer in force (archive).'
    WHEN until_ IS NOT NULL AND y < {AS_OF_YEAR} AND y >= 2000
      THEN 'Stated validity ended ' || until_ || '.'
    WHEN published OR updated IS NOT NULL THEN 'Carries a publication or update date.'
    WHEN cur THEN 'No date, but the page presents as in force (actuellement).'
    ELSE 'No date and no currency signal.' END AS freshness_note,
  concat_ws('; ', CASE WHEN hist THEN 'historical_marker:archive' END,
    CASE WHEN cur THEN 'current_marker:actuellement'
         WHEN updated IS NOT NULL THEN 'current_marker:derniere mise a jour' END,
    'updated:' || updated, 'effective_until:' || until_) AS signals
FROM read"""


# -------------------------------------------------------------------- joins --
def existing_titles(spark, sf):
    """Benchmark openings that a document title already uses."""
    drafts = inputs.queries(spark, sf).select("package_id", F.col("query").alias("title"))
    return research.with_existing_title(drafts, inputs.documents(spark, sf)).select(
        "package_id", "title")


EXISTING_TITLES = o.with_(o.DOCUMENTS) + f"""
SELECT item_id AS package_id, {o.first_sentence('text')} AS title FROM benchmark
WHERE {o.norm(o.first_sentence('text'))} IN (SELECT {o.norm('title')} FROM documents_in)"""


def unseeded_keywords(spark, sf):
    """Document titles whose keyword scope no benchmark query has seeded."""
    fresh = inputs.documents(spark, sf).select(
        F.col("title").alias("query"), F.col("lang").alias("language"),
        F.lit("BE").alias("market"))
    seeded = inputs.queries(spark, sf).select(
        "query", F.lit("BE").alias("market"),
        F.explode(text.string_array(PROFILE.languages)).alias("language"))
    return research.unseeded(fresh, seeded).select("normalized_query", "language", "market")


UNSEEDED_KEYWORDS = o.with_(o.DOCUMENTS) + f"""
SELECT DISTINCT {o.norm('title')} AS normalized_query, lang AS language, 'BE' AS market
FROM documents_in
WHERE {o.norm('title')} NOT IN (
  SELECT {o.norm(o.first_sentence('text'))} FROM benchmark)"""


QUERIES = {
    "query_profile": (query_profile, QUERY_PROFILE),
    "relevance_gate_corpus": (relevance_gate_corpus, RELEVANCE_GATE_CORPUS),
    "corpus_relevance_summary": (corpus_relevance_summary, CORPUS_RELEVANCE_SUMMARY),
    "relevance_gate_sources": (relevance_gate_sources, RELEVANCE_GATE_SOURCES),
    "relevance_summary": (relevance_summary, RELEVANCE_SUMMARY),
    "claim_relevance": (claim_relevance, CLAIM_RELEVANCE),
    "ambiguous_review": (ambiguous_review, AMBIGUOUS_REVIEW),
    "intent_classification": (intent_classification, INTENT_CLASSIFICATION),
    "provider_routing": (provider_routing, PROVIDER_ROUTING),
    "source_quality": (source_quality, SOURCE_QUALITY),
    "source_quality_summary": (source_quality_summary, SOURCE_QUALITY_SUMMARY),
    "authority_lookup": (authority_lookup, AUTHORITY_LOOKUP),
    "authority_candidates": (authority_candidates, AUTHORITY_CANDIDATES),
    "region_detection": (region_detection, REGION_DETECTION),
    "region_cover": (region_cover, REGION_COVER),
    "freshness": (freshness, FRESHNESS),
    "existing_titles": (existing_titles, EXISTING_TITLES),
    "unseeded_keywords": (unseeded_keywords, UNSEEDED_KEYWORDS),
}
