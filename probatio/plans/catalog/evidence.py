"""Registered queries: concepts, matching, verdicts, plans and packages."""

from __future__ import annotations

from pyspark.sql import functions as F

from probatio import fixed_values as fv
from probatio.functions import numerics
from probatio.operators import (brief, classify, evidence, package,
                                passages, prices, publication, research)
from probatio.plans import evidence_run, inputs, oracle as o
from probatio.plans.catalog.claims import (CLAIMS, DEDUPED, PASSAGES, POLICY, PRICE_CONTEXTS,
                                           PRICE_TEXTS, _sql_category, price_texts)
from probatio.plans.catalog.relevance import GATED, LOOKED_UP, PROFILES, _cover, region_sql
from probatio.plans.probe import PROFILE
from probatio.sources import sinks

AS_OF_YEAR = 2024


def _run(spark, sf):
    """A run of its own for each query; only the parts that the query reads are made."""
    return evidence_run.driver_tables(spark, sf, PROFILE, AS_OF_YEAR)


def _words(column):
    return F.array_join(column, " ").alias(column)


# ----------------------------------------------------------------- concepts --
def claim_concepts(spark, sf):
    return _run(spark, sf).claims.select(
        "claim_id", _words("topic_terms"), _words("generic_terms"),
        F.array_join(F.array_sort("phrases"), "|").alias("phrases"), "head_phrase",
        "region", "category")


def _concepts(rows: str, key: str, column: str) -> str:
    phrases = PROFILE.phrases
    listed = ", ".join(f"CASE WHEN {o.has_term('n', [p])} THEN {o.quoted(p)} END"
                       for p in phrases)
    found = (f"regexp_extract(n, '{o.whole(phrases).replace('(?:', '(', 1)}', 2)")
    return f"""
{key}_n AS (SELECT *, {o.norm(column)} AS n FROM {rows}),
{key}_t AS (SELECT *, {o.match_tokens(column)} AS toks, {_sql_category(column, 'n')}
              AS category, list_filter([{listed}], lambda p: p IS NOT NULL) AS phrases,
              nullif({found}, '') AS phrase FROM {key}_n),
{key}_g AS (SELECT *, list_sort({o.minus('toks', PROFILE.generic_tokens)}) AS topic,
              list_sort(list_intersect(toks, {o.array(PROFILE.generic_tokens)})) AS generic
            FROM {key}_t),
{key}_c AS (SELECT *, coalesce(phrase, nullif(array_to_string(list_slice(list_filter(
              string_split(n, ' '), lambda w: list_contains(topic, w)), 1, 2), ' '), ''))
              AS head FROM {key}_g)"""


CLAIMS_IN = rf"""
claims_in AS (
  SELECT item_id || '-' || (i - 1) AS claim_id, struct_pack(a := item_id, b := i - 1) AS claim_ord,
         trim(parts[i]) AS claim
  FROM (SELECT item_id, {o.sentences("regexp_replace(text, '\\s+', ' ', 'g')")} AS parts
        FROM benchmark), unnest(generate_series(1, len(parts))) AS u(i)
  WHERE trim(parts[i]) <> '')"""
CLAIM_CONCEPT_CTES = CLAIMS_IN + "," + _concepts("claims_in", "cl", "claim") + f""",
claims_c AS (SELECT *, {region_sql('n')} AS region FROM cl_c)"""
CLAIM_CONCEPTS = o.with_(CLAIM_CONCEPT_CTES) + """
SELECT claim_id, array_to_string(topic, ' ') AS topic_terms,
       array_to_string(generic, ' ') AS generic_terms,
       array_to_string(list_sort(phrases), '|') AS phrases, head AS head_phrase,
       region, category
FROM claims_c"""


def passage_concepts(spark, sf):
    return _run(spark, sf).passages.select(
        "source_ref", "passage_ord", F.size("topic_terms").alias("topic_terms"),
        F.array_join(F.array_sort("phrases"), "|").alias("phrases"), "head_phrase",
        "region", "category")


DIMENSIONS = o.DOCUMENTS + "," + LOOKED_UP + f""",
dims AS (
  SELECT CAST(doc_id AS VARCHAR) AS source_ref, doc_id AS source_ord,
    CASE WHEN authority_type IS NOT NULL THEN 'OFFICIAL' ELSE 'COMMERCIAL' END AS quality,
    CASE WHEN coalesce(authority_region, 'UNKNOWN') <> 'UNKNOWN' THEN authority_region
         ELSE {region_sql(o.norm("title || chr(10) || body"))} END AS region,
    CASE WHEN lang <> 'en' THEN 'DATED_CURRENT' ELSE 'UNDATED' END AS freshness,
    CASE WHEN lang <> 'en' THEN 'OBSERVED' ELSE 'ESTIMATED' END AS observation
  FROM looked_up)"""
PASSAGE_CONCEPT_CTES = PASSAGES + "," + _concepts("kept_passages", "pa", "passage") + """,
passages_c AS (SELECT c.*, d.region FROM pa_c c JOIN dims d USING (source_ref))"""
PASSAGE_CONCEPTS = o.with_(DIMENSIONS, PASSAGE_CONCEPT_CTES) + """
SELECT source_ref, passage_ord, len(topic) AS topic_terms,
       array_to_string(list_sort(phrases), '|') AS phrases, head AS head_phrase, region,
       category
FROM passages_c"""


def typed_quantities(spark, sf):
    """Quantities of every price sentence; each sentence has a known shape."""
    rows = price_texts(spark, sf).withColumn("q", numerics.quantities(F.col("text")))
    return rows.select("l_orderkey", "l_linenumber", F.array_join(
        F.transform("q", lambda n: F.concat_ws(":", n["type"], n["digits"])), " ")
        .alias("quantities"))


TYPED_QUANTITIES = o.with_(PRICE_TEXTS) + r"""
SELECT l_orderkey, l_linenumber,
  -- a rate is typed before the money inside it, years come last
  concat_ws(' ',
    CASE WHEN regexp_matches(text, '€ par (kWc|m²)')
         THEN 'RATE:' || regexp_extract(text, '(\d+) € par', 1) END,
    CASE WHEN regexp_matches(text, '€ par (kWc|m²)')
         THEN nullif('MONEY:' || regexp_extract(text, '(\d+) € et', 1), 'MONEY:')
         WHEN regexp_matches(text, '€ et')
         THEN 'MONEY:' || regexp_extract(text, '(\d+) € et', 1) || ' MONEY:'
              || regexp_extract(text, 'et (\d+) €', 1)
         ELSE 'MONEY:' || regexp_extract(text, '(\d+) €', 1) END,
    CASE WHEN contains(text, '5 kWc') THEN 'POWER:5' END,
    'YEAR:' || regexp_extract(text, 'en (\d{4})\.$', 1)) AS quantities
FROM price_texts"""


# ----------------------------------------------------------------- matching --
def supported_pairs(spark, sf):
    return _run(spark, sf).matches.where("supports").select(
        "claim_id", "source_ref", "passage_ord", "score",
        F.concat_ws(",", "reasons").alias("reasons"))


def _compatible() -> str:
    pairs = [f"{c}>{p}" for c, ps in fv.COMPATIBLE_CATEGORIES.items() for p in ps]
    return (f"(c.category = p.category OR c.category NOT IN "
            f"({o.listed(fv.COMPATIBLE_CATEGORIES)}) OR c.category || '>' || p.category "
            f"IN ({o.listed(pairs)}))")


_MARK = r"regexp_replace({x}, '([\p{{L}}\p{{N}}_]+)', chr(2) || '\1' || chr(2), 'g')"
MATCHED = f"""
claims_m AS (SELECT *, {_MARK.format(x='head')} AS head_m,
               {o.match_tokens('head')} AS head_toks FROM claims_c),
passages_m AS (SELECT *, {_MARK.format(x='n')} AS marked FROM passages_c),
pairs AS (
  SELECT c.claim_id, p.source_ref, p.passage_ord, c.topic AS ct, p.topic AS pt,
         len(list_intersect(c.topic, p.topic)) AS shared, len(c.topic) AS n,
         (coalesce(contains(p.marked, c.head_m), false)
          OR (c.head IS NOT NULL AND list_has_any(c.phrases, p.phrases))) AS headed,
         list_filter(c.topic, lambda t: NOT list_contains(c.head_toks, t)) AS rest
  FROM claims_m c, passages_m p
  WHERE (c.region = 'UNKNOWN' OR p.region = 'UNKNOWN' OR {_cover('p.region', 'c.region')})
    AND {_compatible()}),
judged AS (
  SELECT *, CASE WHEN n > 0 THEN shared / n::DOUBLE ELSE 0.0 END AS cov,
         CASE WHEN len(rest) > 0 THEN len(list_intersect(rest, pt)) / len(rest)::DOUBLE
              ELSE 1.0 END AS rest_cov FROM pairs),
matched AS (
  SELECT *, CASE WHEN headed THEN 0.7 + 0.3::DOUBLE * cov
                 WHEN n < {fv.MIN_TOPIC_OVERLAP} THEN 0.6
                 ELSE 0.4 + 0.5::DOUBLE * cov END AS score,
         CASE WHEN headed THEN 'MATCHED_HEAD_CONCEPT' ELSE 'MATCHED_TOPIC_TERMS' END
           AS reasons
  FROM judged
  WHERE CASE WHEN headed THEN rest_cov >= {fv.MIN_PREDICATE_COVERAGE}
             WHEN shared = 0 THEN false
             WHEN n < {fv.MIN_TOPIC_OVERLAP} AND cov >= 1.0 THEN true
             ELSE shared >= {fv.MIN_TOPIC_OVERLAP} AND cov >= {fv.MIN_TOPIC_COVERAGE} END)"""
MATCH_CTES = (DIMENSIONS, CLAIM_CONCEPT_CTES, PASSAGE_CONCEPT_CTES, MATCHED)
SUPPORTED_PAIRS = o.with_(*MATCH_CTES) + """
SELECT claim_id, source_ref, passage_ord, score, reasons FROM matched"""


def best_passages(spark, sf):
    return evidence.best_passages(_run(spark, sf).matches).select(
        "claim_id", "source_ref", "passage_ord", "supports", "agrees")


BEST = """
best AS (
  SELECT claim_id, source_ref, min(passage_ord) AS passage_ord
  FROM matched GROUP BY 1, 2)"""
BEST_PASSAGES = o.with_(*MATCH_CTES, BEST) + """
SELECT claim_id, source_ref, passage_ord, true AS supports, NULL::BOOLEAN AS agrees
FROM best"""


# ----------------------------------------------------------------- verdicts --
_VERDICT_COLUMNS = ("claim_id", "category", "risk", "evidence_status",
                    "corroborating_sources", "best_source_quality", "has_dated_support",
                    "observability", "reason")


def evidence_verdicts(spark, sf):
    return _run(spark, sf).evaluated.select(*_VERDICT_COLUMNS)


_MISMATCH = """
CASE WHEN first_region = 'UNKNOWN' THEN 'evidence carries no identifiable regional scope'
     WHEN scope = 'UNKNOWN' THEN 'claim carries no identifiable regional scope'
     WHEN first_region || '>' || scope IN ('BE-WAL>BE', 'BE-BRU>BE', 'BE-VLG>BE')
       THEN first_region || ' evidence cannot establish a ' || scope || '-wide claim'
     ELSE first_region || ' evidence does not cover a ' || scope || ' claim' END"""
VERDICTS = POLICY + f""",
need AS (
  SELECT c.claim_id, c.claim_ord, c.claim, c.category,
         CASE WHEN c.region = 'UNKNOWN' THEN 'BE' ELSE c.region END AS scope,
         p.risk, p.authority, p.freshness AS fresh_need, p.minimum, p.rationale
  FROM claims_c c JOIN policy p ON p.category = c.category),
refs AS (
  SELECT n.claim_id, d.*, n.risk <> 'HIGH' OR n.scope = 'UNKNOWN' OR d.region = 'UNKNOWN'
           OR {_cover('d.region', 'n.scope')} AS in_scope,
         {o.rank('d.quality', fv.QUALITY_RANK)} AS q, d.freshness = 'DATED_CURRENT' AS cur
  FROM best b JOIN dims d USING (source_ref) JOIN need n USING (claim_id)),
facts AS (
  SELECT claim_id, count(*) AS ns, count(*) FILTER (in_scope) AS nis,
         count(*) FILTER (in_scope AND cur) AS ncur, bool_or(cur) AS anycur,
         arg_min(region, source_ord) AS first_region,
         arg_max(quality, q) FILTER (in_scope) AS sq, arg_max(quality, q) AS bq,
         arg_min(freshness, source_ord) FILTER (in_scope AND cur) AS curs,
         arg_min(observation, source_ord) AS obs
  FROM refs GROUP BY 1),
ladder AS (
  SELECT n.*, f.*, coalesce(ns, 0) AS k, CASE
      WHEN coalesce(ns, 0) = 0 THEN 1
      WHEN risk = 'HIGH' AND scope <> 'UNKNOWN' AND nis = 0 THEN 2
      WHEN {o.rank('sq', fv.QUALITY_RANK)} < {o.rank('authority', fv.AUTHORITY_RANK)} THEN 3
      WHEN ns < minimum AND sq <> 'OFFICIAL' THEN 4
      WHEN fresh_need = 'REQUIRED' AND ncur = 0 THEN 5 ELSE 6 END AS step
  FROM need n LEFT JOIN facts f ON f.claim_id = n.claim_id),
verdicts AS (
  SELECT claim_id, claim_ord, claim, category, risk, k AS corroborating_sources,
    CASE WHEN step <= 3 THEN 'UNSUPPORTED' WHEN step <= 5 THEN 'PARTIALLY_SUPPORTED'
         ELSE 'SUPPORTED' END AS evidence_status,
    coalesce(bq, 'UNKNOWN') AS best_source_quality,
    coalesce(anycur, false) AS has_dated_support,
    coalesce(obs, 'ESTIMATED') AS observability,
    CASE step WHEN 1 THEN 'No eligible passage materially states this claim.'
      WHEN 2 THEN 'Regional scope mismatch: ' || {_MISMATCH} || '. ' || rationale
      WHEN 3 THEN category || ' claims require a ' || authority
        || ' source; the best supporting source is ' || sq || '. ' || rationale
      WHEN 4 THEN category || ' claims need ' || minimum || ' independent sources; ' || ns
        || ' found. ' || rationale
      WHEN 5 THEN 'Stated by a ' || sq || ' source, but ' || category
        || ' claims depend on when they were published and no supporting source is dated or presents as in force.'
      ELSE 'Materially stated by ' || ns || ' ' || sq || ' source(s) ('
        || coalesce(curs, 'UNDATED') || CASE WHEN scope <> 'UNKNOWN'
             THEN ', scoped ' || scope ELSE '' END || '); meets the ' || category
        || ' bar.' END AS reason
  FROM ladder)"""
VERDICT_CTES = (*MATCH_CTES, BEST, VERDICTS)
EVIDENCE_VERDICTS = o.with_(*VERDICT_CTES) + \
    f"SELECT {', '.join(_VERDICT_COLUMNS)} FROM verdicts"


def evidence_summary(spark, sf):
    return evidence.summary(_run(spark, sf).evaluated)


EVIDENCE_SUMMARY = o.with_(*VERDICT_CTES) + """
SELECT 0 AS package_id, count(*) AS claims_total,
  count(*) FILTER (evidence_status = 'SUPPORTED') AS supported,
  count(*) FILTER (evidence_status = 'PARTIALLY_SUPPORTED') AS partially_supported,
  count(*) FILTER (evidence_status = 'UNSUPPORTED') AS unsupported,
  count(*) FILTER (evidence_status = 'CONFLICTING') AS conflicting,
  count(*) FILTER (risk = 'HIGH') AS high_risk_total,
  count(*) FILTER (risk = 'HIGH' AND evidence_status = 'SUPPORTED') AS high_risk_supported,
  count(*) FILTER (risk = 'HIGH' AND evidence_status <> 'SUPPORTED') AS high_risk_blocked,
  count(*) FILTER (corroborating_sources > 1) AS multi_source_claims
FROM verdicts"""


def unresolved_high_risk(spark, sf):
    return evidence.unresolved_high_risk(_run(spark, sf).evaluated).select(
        "claim_id", "category", "evidence_status")


UNRESOLVED_HIGH_RISK = o.with_(*VERDICT_CTES) + """
SELECT claim_id, category, evidence_status FROM verdicts
WHERE risk = 'HIGH' AND evidence_status <> 'SUPPORTED'"""


def _plan_packages(spark, sf):
    """Documents of each retrieval source as blocked claims of one package."""
    rows = classify.with_category(inputs.documents(spark, sf), "body", PROFILE)
    blocked = classify.claim_requirements(rows.select(
        F.col("source").alias("package_id"), F.col("doc_id").alias("claim_ord"),
        "category"), PROFILE)
    packages = inputs.table(spark, sf, "documents").groupBy(
        F.col("source").alias("package_id")).agg(
            F.concat(F.lit("topic "), F.min("source")).alias("topic")).withColumn(
                "market", F.lit("BE"))
    return blocked.where("risk = 'HIGH'"), packages


def research_plan(spark, sf):
    unresolved, packages = _plan_packages(spark, sf)
    return evidence.research_plan(unresolved, packages, PROFILE).select(
        "package_id", "plan_ord", "query", "category", "reason")


def _templates() -> str:
    rows = []
    for name, template in PROFILE.official_source_policy["query_templates"].items():
        variant = next((v for v in fv.REGIONAL_VARIANTS if name.endswith(v)), "")
        position = fv.REGIONAL_VARIANTS.index(variant) if variant else 3
        base = name[:-len(variant)] if variant else name
        rows.append(f"({o.quoted(base)}, {position}, {o.quoted(variant[1:])}, "
                    f"{o.quoted(template)})")
    return ", ".join(rows)


RESEARCH_PLAN = f"""
WITH blocked AS (
  SELECT package_id, category, count(*) AS n, min(doc_id) AS f FROM (
    SELECT source AS package_id, doc_id, {_sql_category('text', 'n')} AS category
    FROM (SELECT *, {o.norm('text')} AS n FROM documents))
  WHERE category IN ({o.listed(c for c, r, *_ in PROFILE.policy_rows() if r == 'HIGH')})
  GROUP BY 1, 2),
templates(category, position, variant, template) AS (VALUES {_templates()}),
filled AS (
  SELECT package_id, category, n, f, position, variant,
    CASE WHEN variant <> '' THEN template ELSE replace(replace(replace(template,
      '{{topic}}', 'topic ' || package_id), '{{market}}', 'BE'), '{{category}}', category)
    END AS query
  FROM blocked JOIN templates USING (category)),
firsts AS (
  SELECT * FROM filled QUALIFY row_number() OVER (
    PARTITION BY package_id, {o.norm('query')} ORDER BY -n, f, category, position) = 1),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY package_id
                               ORDER BY -n, f, category, position) AS plan_ord FROM firsts)
SELECT package_id, plan_ord, query, category,
  CASE WHEN variant <> '' THEN 'regional variant for ' || variant
         || ': a national query does not reach this region''s authorities'
       ELSE n || ' unresolved ' || category
         || ' claim(s) need a source meeting the {PROFILE.code} authority bar' END AS reason
FROM ranked"""


# ------------------------------------------------------------------ package --
def writer_claims(spark, sf):
    run = _run(spark, sf)
    return package.writer_claims(run.evaluated, run.references, allow_partial=True).select(
        "claim_id", "claim", "category", "evidence_status", "caveat", "source_ref",
        "source_quality")


WRITER_CLAIMS = o.with_(*VERDICT_CTES) + """
SELECT v.claim_id, claim, category, evidence_status,
       CASE WHEN evidence_status <> 'SUPPORTED' THEN reason END AS caveat,
       source_ref, quality AS source_quality
FROM verdicts v JOIN best USING (claim_id) JOIN dims USING (source_ref)
WHERE evidence_status IN ('SUPPORTED', 'PARTIALLY_SUPPORTED')"""


def forbidden_topics(spark, sf):
    return package.forbidden_topics(_run(spark, sf).evaluated)


FORBIDDEN_TOPICS = o.with_(*VERDICT_CTES) + """
SELECT DISTINCT 0 AS package_id, category AS topic,
       'no supporting evidence of sufficient authority' AS reason
FROM verdicts WHERE risk = 'HIGH' AND evidence_status <> 'SUPPORTED'"""


def evidence_sink(spark, sf):
    """Stored evidence rows: a row per claim whose origin source is stored."""
    run = _run(spark, sf)
    return sinks.evidence_rows(run.evaluated, run.sources).select(
        "claim_id", "source_ref", "observability", "evidence_status",
        "corroborating_sources", "evidence_sufficient")


EVIDENCE_SINK = o.with_(*VERDICT_CTES) + """
SELECT claim_id, split_part(claim_id, '-', 1) AS source_ref, observability,
       evidence_status, corroborating_sources,
       evidence_status = 'SUPPORTED' AS evidence_sufficient
FROM verdicts WHERE split_part(claim_id, '-', 1) IN (SELECT source_ref FROM dims)"""


def passage_sink(spark, sf):
    run = _run(spark, sf)
    return sinks.passage_rows(run.references, run.sources).select(
        "claim_id", "source_ref", "supports", "agrees", "observation_status",
        "source_quality", "note")


PASSAGE_SINK = o.with_(*VERDICT_CTES) + """
SELECT b.claim_id, b.source_ref, true AS supports, NULL::BOOLEAN AS agrees,
       observation AS observation_status, quality AS source_quality, reasons AS note
FROM best b JOIN dims USING (source_ref) JOIN matched m
  ON m.claim_id = b.claim_id AND m.source_ref = b.source_ref
 AND m.passage_ord = b.passage_ord"""


def _gated_sources(spark, sf, run=None):
    run = run or _run(spark, sf)
    sizes = inputs.documents(spark, sf).select(
        F.col("doc_id").cast("string").alias("source_ref"), "title",
        F.when(F.length("body") > 1500, "RELEVANT").otherwise("LOW_RELEVANCE")
        .alias("relevance_status"),
        F.least(F.lit(1.0), F.length("body") / 3000).alias("relevance_score"))
    return run.sources.join(sizes, "source_ref").withColumn(
        "relevance_reason", F.lit("length"))


def _passage_counts(spark, sf):
    return passages.drop_summary(passages.passages(inputs.documents(spark, sf).select(
        F.lit(0).alias("package_id"), F.col("doc_id").alias("source_ref"), "body")))


def _states(spark, sf):
    return inputs.table(spark, sf, "events").select(
        F.lit(0).alias("package_id"), F.when(F.col("event_type") == "error", "timeout")
        .otherwise("ok").alias("state"))


def _confidence(spark, sf):
    snapshots = inputs.table(spark, sf, "pages").select(F.lit(0).alias("package_id"))
    run = _run(spark, sf)
    return package.confidence_summary(
        _gated_sources(spark, sf, run), _passage_counts(spark, sf),
        evidence.summary(run.evaluated), _states(spark, sf), snapshots)


def confidence_summary(spark, sf):
    return _confidence(spark, sf).select(
        "package_id", "sources_retrieved", "sources_eligible", "sources_rejected",
        "sources_dated", "sources_undated", F.round("mean_relevance", 6)
        .alias("mean_relevance"), "passages_kept", "passages_dropped", "claims_total",
        "supported", "partial_observation", "serp_available")


CONFIDENCE_SUMMARY = o.with_(*VERDICT_CTES) + """
SELECT 0 AS package_id, count(*) AS sources_retrieved,
  count(*) FILTER (e) AS sources_eligible, count(*) FILTER (NOT e) AS sources_rejected,
  count(*) FILTER (e AND observation = 'OBSERVED') AS sources_dated,
  count(*) FILTER (e AND observation = 'ESTIMATED') AS sources_undated,
  round(avg(least(1.0, length(body) / 3000)), 6) AS mean_relevance,
  (SELECT count(*) FROM all_passages WHERE kept) AS passages_kept,
  (SELECT count(*) FROM all_passages WHERE NOT kept) AS passages_dropped,
  (SELECT count(*) FROM verdicts) AS claims_total,
  (SELECT count(*) FROM verdicts WHERE evidence_status = 'SUPPORTED') AS supported,
  (SELECT bool_or(event_type = 'error') FROM events) AS partial_observation,
  true AS serp_available
FROM (SELECT d.*, body, length(body) > 1500 AS e
      FROM dims d JOIN documents_in ON CAST(doc_id AS VARCHAR) = source_ref)"""


def rejected_report(spark, sf):
    return package.rejected_report(_gated_sources(spark, sf)).select(
        "source_ref", "url", "title", "status", "reason")


REJECTED_REPORT = o.with_(o.DOCUMENTS) + """
SELECT CAST(doc_id AS VARCHAR) AS source_ref, url, title, 'LOW_RELEVANCE' AS status,
       'length' AS reason
FROM documents_in WHERE length(body) <= 1500"""


# ---------------------------------------------------------------- gated run --
def _gated_run(spark, sf):
    """The labelled sources and the run over the relevant ones."""
    return evidence_run.gated_labels(spark, sf, PROFILE, AS_OF_YEAR)


def gated_verdicts(spark, sf):
    """Claims of relevant sources against the relevant sources of their own package."""
    _, run = _gated_run(spark, sf)
    return run.evaluated.select("package_id", *_VERDICT_COLUMNS)


def _swap(sql: str, old: str, new: str) -> str:
    assert sql.count(old) == 1
    return sql.replace(old, new)


RELEVANT = """
relevant AS (
  SELECT package_id, doc_id, body AS text FROM gated WHERE relevance_status = 'RELEVANT')"""
GATED_CTES = (
    PROFILES, o.SOURCES, GATED, RELEVANT, DIMENSIONS.removeprefix(o.DOCUMENTS + ","),
    _swap(_swap(PASSAGES, "source AS package_id", "package_id"), "FROM documents", "FROM relevant"),
    CLAIMS, DEDUPED, """
claims_in AS (
  SELECT package_id, source_ref || '-' || passage_ord || '-' || claim_ord AS claim_id,
         struct_pack(a := doc_id, b := passage_ord, c := claim_ord) AS claim_ord, claim
  FROM deduped)""", CLAIM_CONCEPT_CTES.removeprefix(CLAIMS_IN + ","),
    PASSAGE_CONCEPT_CTES.removeprefix(PASSAGES + ","),
    _swap(MATCHED, "FROM claims_m c, passages_m p\n",
          "FROM claims_m c JOIN passages_m p ON c.package_id = p.package_id\n"), BEST, VERDICTS)
GATED_VERDICTS = o.with_(*GATED_CTES) + f"""
SELECT package_id, {", ".join("v." + c for c in _VERDICT_COLUMNS)}
FROM verdicts v JOIN claims_in USING (claim_id)"""


def _gated_confidence(spark, sf):
    gated, run = _gated_run(spark, sf)
    relevant = gated.where("relevance_status = 'RELEVANT'")
    counts = passages.drop_summary(passages.passages(relevant.select(
        "package_id", "source_ref", "body")))
    seen = run.sources.select("package_id", "source_ref", "observation_status")
    states = inputs.table(spark, sf, "events").select(
        F.col("user_id").alias("package_id"), F.when(F.col("event_type") == "error", "timeout")
        .otherwise("ok").alias("state"))
    snapshots = inputs.table(spark, sf, "pages").select(F.col("page_id").alias("package_id"))
    return package.confidence_summary(
        gated.join(seen, ["package_id", "source_ref"], "left"), counts,
        evidence.summary(run.evaluated), states, snapshots).fillna(
            0, ["claims_total", "supported"])


def gated_confidence(spark, sf):
    """What each package rests on after the gate."""
    return _gated_confidence(spark, sf).select(
        "package_id", "sources_retrieved", "sources_eligible", "sources_rejected",
        "sources_dated", "sources_undated", F.round("mean_relevance", 6)
        .alias("mean_relevance"), "passages_kept", "passages_dropped", "claims_total",
        "supported", "partial_observation", "serp_available")


GATED_CONFIDENCE = o.with_(*GATED_CTES) + """
, read AS (
  SELECT package_id, count(*) AS sources_retrieved, count(*) FILTER (e) AS sources_eligible,
    count(*) FILTER (NOT e) AS sources_rejected,
    count(*) FILTER (e AND lang <> 'en') AS sources_dated,
    count(*) FILTER (e AND lang = 'en') AS sources_undated,
    round(avg(relevance_score), 6) AS mean_relevance
  FROM (SELECT *, relevance_status = 'RELEVANT' AS e FROM gated) GROUP BY 1),
cut AS (SELECT package_id, count(*) FILTER (kept) AS k, count(*) FILTER (NOT kept) AS d
        FROM all_passages GROUP BY 1),
told AS (SELECT package_id, count(*) AS t,
           count(*) FILTER (evidence_status = 'SUPPORTED') AS s
         FROM verdicts JOIN claims_in USING (claim_id) GROUP BY 1)
SELECT package_id, sources_retrieved, sources_eligible, sources_rejected, sources_dated,
  sources_undated, mean_relevance, coalesce(k, 0) AS passages_kept,
  coalesce(d, 0) AS passages_dropped, coalesce(t, 0) AS claims_total,
  coalesce(s, 0) AS supported,
  package_id IN (SELECT user_id FROM events WHERE event_type = 'error') AS partial_observation,
  package_id IN (SELECT page_id FROM pages) AS serp_available
FROM read LEFT JOIN cut USING (package_id) LEFT JOIN told USING (package_id)"""


def gated_header(spark, sf):
    packages = inputs.queries(spark, sf).withColumns({
        "market": F.lit("BE"), "language": F.lit("en"), "intent": F.lit("INFORMATIONAL")})
    return package.package_header(packages, _gated_confidence(spark, sf), version=1).select(
        "package_id", "query", "intent", "summary", "package_version", "version")


GATED_HEADER = f"""
SELECT package_id, query, 'INFORMATIONAL' AS intent, concat_ws('; ', sources_eligible || '/'
    || sources_retrieved || ' sources passed relevance', coalesce(supported, 0) || ' of '
    || coalesce(claims_total, 0) || ' atomic claims supported') AS summary,
  4 AS package_version, 1 AS version
FROM (SELECT item_id AS package_id, {o.first_sentence('text')} AS query FROM benchmark)
LEFT JOIN ({GATED_CONFIDENCE}) USING (package_id)"""


def gated_sections(spark, sf):
    """The items of every package after the gate."""
    gated, run = _gated_run(spark, sf)
    packages = inputs.queries(spark, sf).select(
        "package_id", F.col("query").alias("topic"), F.lit("BE").alias("market"))
    seen = run.sources.select("package_id", "source_ref", "source_quality")
    return _sections(run, packages, gated.drop("body").join(
        seen, ["package_id", "source_ref"], "left"))


GATED_SECTIONS = o.with_(*GATED_CTES) + f""",
told AS (SELECT v.*, c.package_id FROM verdicts v JOIN claims_in c USING (claim_id)),
open_claims AS (
  SELECT *, row_number() OVER (PARTITION BY package_id ORDER BY claim_ord) AS k FROM told
  WHERE risk = 'HIGH' AND evidence_status <> 'SUPPORTED'),
blocked AS (SELECT package_id, category, count(*) AS n, min(claim_ord) AS f
            FROM open_claims GROUP BY 1, 2),
templates(category, position, variant, template) AS (VALUES {_templates()}),
filled AS (
  SELECT package_id, category, n, f, position, CASE WHEN variant <> '' THEN template
    ELSE replace(replace(replace(template, '{{topic}}', q.query), '{{market}}', 'BE'),
                 '{{category}}', category) END AS query
  FROM blocked JOIN templates USING (category) JOIN queries_in q USING (package_id)),
plan AS (
  SELECT package_id, query, row_number() OVER (PARTITION BY package_id
    ORDER BY -n, f, category, position) AS plan_ord
  FROM (SELECT * FROM filled QUALIFY row_number() OVER (
    PARTITION BY package_id, {o.norm('query')} ORDER BY -n, f, category, position) = 1))
SELECT package_id, CASE WHEN relevance_status <> 'RELEVANT' THEN 'rejected_evidence'
    WHEN quality = 'OFFICIAL' THEN 'official_evidence' ELSE 'commercial_evidence' END AS section,
  source_ref AS ord, title AS label
FROM gated JOIN dims USING (source_ref)
UNION ALL SELECT package_id, lower(evidence_status) || '_claims', claim_id, claim FROM told
UNION ALL SELECT package_id, 'evidence', claim_id || '/' || b.source_ref, quality
FROM best b JOIN dims USING (source_ref) JOIN claims_in USING (claim_id)
UNION ALL SELECT package_id, 'unresolved_questions', 'supported/0',
  'No atomic claim reached SUPPORTED. Content must not be generated from model knowledge alone.'
FROM told GROUP BY 1 HAVING count(*) FILTER (evidence_status = 'SUPPORTED') = 0
UNION ALL SELECT package_id, 'unresolved_questions', 'rejected/0', count(*)
  || ' retrieved source(s) were rejected as off-topic and contributed no passages.'
FROM gated WHERE relevance_status <> 'RELEVANT' GROUP BY 1
UNION ALL SELECT package_id, 'unresolved_questions', 'high_risk/' || k, category
  || ' claim unresolved (' || evidence_status || '): ' || claim || ' — ' || reason
FROM open_claims
UNION ALL SELECT package_id, 'unresolved_questions', 'conflict/'
  || row_number() OVER (PARTITION BY package_id ORDER BY claim_ord),
  'CONFLICTING evidence: ' || claim || ' — ' || reason
FROM told WHERE evidence_status = 'CONFLICTING'
UNION ALL SELECT package_id, 'unresolved_questions', 'plan/0', count(*)
  || ' targeted authoritative search(es) proposed to resolve HIGH-risk gaps.'
FROM plan GROUP BY 1
UNION ALL SELECT DISTINCT package_id, 'unresolved_questions', 'provider/1', 'given' FROM told
UNION ALL SELECT package_id, 'authoritative_research_plan', CAST(plan_ord AS VARCHAR), query
FROM plan"""


def gated_rejected(spark, sf):
    gated, _ = _gated_run(spark, sf)
    return package.rejected_report(gated).drop("reason")


GATED_REJECTED = o.with_(PROFILES, o.SOURCES, GATED) + """
SELECT package_id, source_ref, url, title, relevance_status AS status, relevance_score
FROM gated WHERE relevance_status <> 'RELEVANT'"""


def _core(spark, sf):
    packages, evaluated = _priced_packages(spark, sf)
    return prices.core_question(packages, evaluated, PROFILE)


def package_sections(spark, sf):
    """All items of a package as section rows, each with the field it is known by."""
    run = _run(spark, sf)
    packages = run.evaluated.select("package_id").distinct().withColumns({
        "topic": F.lit("probe"), "market": F.lit("BE")})
    return _sections(run, packages, _gated_sources(spark, sf, run))


def _sections(run, packages, gated):
    unresolved = evidence.unresolved_high_risk(run.evaluated)
    plan = evidence.research_plan(unresolved, packages, PROFILE)
    notes = package.unresolved_notes(
        run.evaluated, gated.where("relevance_status <> 'RELEVANT'"), plan,
        run.evaluated.select("package_id").distinct().select(
            "package_id", F.lit(1).alias("ord"), F.lit("given").alias("note")))
    rows = package.package_sections(gated, run.evaluated, run.references, notes, plan)
    field = lambda name: F.get_json_object("payload", f"$.{name}")
    label = (F.when(F.col("section").isin(
                 "rejected_evidence", "official_evidence", "commercial_evidence"), field("title"))
             .when(F.col("section") == "evidence", field("source_quality"))
             .when(F.col("section") == "unresolved_questions", field("note"))
             .when(F.col("section") == "authoritative_research_plan", field("query"))
             .otherwise(field("claim")))
    return rows.select("package_id", "section", "ord", label.alias("label"))


PACKAGE_SECTIONS = o.with_(*VERDICT_CTES) + f""",
open_claims AS (
  SELECT *, row_number() OVER (ORDER BY claim_ord) AS k FROM verdicts
  WHERE risk = 'HIGH' AND evidence_status <> 'SUPPORTED'),
blocked AS (
  SELECT category, count(*) AS n, min(claim_ord) AS f FROM open_claims GROUP BY 1),
templates(category, position, variant, template) AS (VALUES {_templates()}),
filled AS (
  SELECT category, n, f, position, CASE WHEN variant <> '' THEN template
    ELSE replace(replace(replace(template, '{{topic}}', 'probe'), '{{market}}', 'BE'),
                 '{{category}}', category) END AS query
  FROM blocked JOIN templates USING (category)),
plan AS (
  SELECT query, row_number() OVER (ORDER BY -n, f, category, position) AS plan_ord FROM (
    SELECT * FROM filled QUALIFY row_number() OVER (
      PARTITION BY {o.norm('query')} ORDER BY -n, f, category, position) = 1))
SELECT 0 AS package_id, CASE WHEN length(body) <= 1500 THEN 'rejected_evidence'
    WHEN quality = 'OFFICIAL' THEN 'official_evidence' ELSE 'commercial_evidence' END AS section,
  source_ref AS ord, title AS label
FROM dims JOIN documents_in ON CAST(doc_id AS VARCHAR) = source_ref
UNION ALL SELECT 0, lower(evidence_status) || '_claims', claim_id, claim FROM verdicts
UNION ALL SELECT 0, 'evidence', claim_id || '/' || source_ref, quality
FROM best JOIN dims USING (source_ref)
UNION ALL SELECT 0, 'unresolved_questions', 'supported/0',
  'No atomic claim reached SUPPORTED. Content must not be generated from model knowledge alone.'
FROM verdicts HAVING count(*) FILTER (evidence_status = 'SUPPORTED') = 0
UNION ALL SELECT 0, 'unresolved_questions', 'rejected/0', count(*)
  || ' retrieved source(s) were rejected as off-topic and contributed no passages.'
FROM documents_in WHERE length(body) <= 1500 HAVING count(*) > 0
UNION ALL SELECT 0, 'unresolved_questions', 'high_risk/' || k, category
  || ' claim unresolved (' || evidence_status || '): ' || claim || ' — ' || reason
FROM open_claims
UNION ALL SELECT 0, 'unresolved_questions', 'conflict/'
  || row_number() OVER (ORDER BY claim_ord),
  'CONFLICTING evidence: ' || claim || ' — ' || reason
FROM verdicts WHERE evidence_status = 'CONFLICTING'
UNION ALL SELECT 0, 'unresolved_questions', 'plan/0', count(*)
  || ' targeted authoritative search(es) proposed to resolve HIGH-risk gaps.'
FROM plan HAVING count(*) > 0
UNION ALL SELECT 0, 'unresolved_questions', 'provider/1', 'given'
UNION ALL SELECT 0, 'authoritative_research_plan', CAST(plan_ord AS VARCHAR), query FROM plan"""


def package_header(spark, sf):
    packages = inputs.queries(spark, sf).groupBy().agg(
        F.lit(0).alias("package_id"), F.min("query").alias("query")).withColumns({
            "market": F.lit("BE"), "language": F.lit("en"),
            "intent": F.lit("INFORMATIONAL")})
    return package.package_header(packages, _confidence(spark, sf), version=1).select(
        "package_id", "query", "intent", "summary", "package_version", "version")


PACKAGE_HEADER = o.with_(*VERDICT_CTES) + f"""
SELECT 0 AS package_id, (SELECT min({o.first_sentence('text')}) FROM benchmark) AS query,
  'INFORMATIONAL' AS intent,
  (SELECT count(*) FILTER (length(text) > 1500) || '/' || count(*) FROM documents)
    || ' sources passed relevance; '
    || count(*) FILTER (evidence_status = 'SUPPORTED') || ' of ' || count(*)
    || ' atomic claims supported' AS summary,
  4 AS package_version, 1 AS version
FROM verdicts"""


def facts_first_version(spark, sf):
    """Facts of the first package shape: conversation turns citing a document."""
    facts = inputs.table(spark, sf, "conversations").select(
        F.lit(0).alias("package_id"), F.concat_ws(
            "-", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
        .alias("fact_id"), (F.col("conv_id") * 3).cast("string").alias("source_ref"),
        F.when(F.col("role") == "user", "OBSERVED").otherwise("ESTIMATED")
        .alias("observability"))
    sources = inputs.table(spark, sf, "labels").select(
        F.lit(0).alias("package_id"), F.col("doc_id").cast("string").alias("source_ref"))
    return package.facts_first_version(facts, sources).select(
        "fact_id", "source_ref", "observability", "supported")


FACTS_FIRST_VERSION = """
SELECT conv_id || '-' || turn AS fact_id,
  CASE WHEN known THEN CAST(conv_id * 3 AS VARCHAR) END AS source_ref,
  CASE WHEN role = 'user' THEN 'OBSERVED' ELSE 'ESTIMATED' END AS observability,
  known AND role = 'user' AS supported
FROM (SELECT *, conv_id * 3 IN (SELECT doc_id FROM labels) AS known FROM conversations)"""


def facts_second_version(spark, sf):
    facts = inputs.documents(spark, sf).select(
        "doc_id", F.col("title").alias("claim"),
        F.when(F.col("lang") == "en", "OBSERVED").otherwise("ESTIMATED")
        .alias("observability"),
        F.when(F.length("body") > 800, "RELEVANT").otherwise("LOW_RELEVANCE")
        .alias("relevance_status"),
        F.when(F.col("source") == "src1", "INSTITUTIONAL").otherwise("COMMERCIAL")
        .alias("source_quality"))
    return package.facts_second_version(facts, PROFILE).select(
        "doc_id", "claim_risk", "evidence_sufficient", "supported")


FACTS_SECOND_VERSION = o.with_(o.DOCUMENTS) + rf"""
SELECT doc_id, claim_risk, ok AS evidence_sufficient,
       lang = 'en' AND length(body) > 800 AND ok AS supported
FROM (SELECT *, CASE claim_risk WHEN 'HIGH' THEN source = 'src1'
             WHEN 'MEDIUM' THEN source = 'src1' ELSE true END AS ok
      FROM (SELECT *, CASE WHEN {o.contains('n', PROFILE.restricted_claims)}
                             OR {o.contains('n', fv.HIGH_RISK_TERMS)} THEN 'HIGH'
              WHEN regexp_matches(title, '(?i)(^|[^\p{{L}}\p{{N}}_/])\d[\d\s.,]*\s*(?:%|€|\$|£|eur|kw|wc|wp|m²|m2|an|jaar|year)')
              THEN 'MEDIUM' ELSE 'LOW' END AS claim_risk
            FROM (SELECT *, {o.norm('title')} AS n FROM documents_in)))"""


def official_sources(spark, sf):
    """Accept or reject every document for its planned category."""
    rows = inputs.documents(spark, sf).withColumns({
        "category": F.when(F.col("lang") == "fr", "SUBSIDY").otherwise("GRID_RULE"),
        "published_at": F.lit(None).cast("timestamp")})
    from probatio.operators import authority

    return authority.accept_official(rows, PROFILE, AS_OF_YEAR).select(
        "doc_id", "category", "accepted", "rejection_reason", "region")


OFFICIAL_SOURCES = o.with_(o.DOCUMENTS, LOOKED_UP) + f"""
SELECT doc_id, category, authority_domain IS NOT NULL AND entitled AS accepted,
  CASE WHEN authority_domain IS NULL THEN 'not on a configured official domain'
       WHEN NOT entitled THEN authority_domain
         || ' is not configured as an authority for ' || category END AS rejection_reason,
  CASE WHEN coalesce(authority_region, 'UNKNOWN') <> 'UNKNOWN' THEN authority_region
       ELSE {region_sql(o.norm("title || chr(10) || body"))} END AS region
FROM (SELECT *, len(authority_categories) = 0
             OR list_contains(authority_categories, category) AS entitled
      FROM (SELECT *, CASE WHEN lang = 'fr' THEN 'SUBSIDY' ELSE 'GRID_RULE' END AS category
            FROM looked_up))"""


def rebuilt_packages(spark, sf):
    """Packages (retrieval sources) that gained an accepted official page."""
    accepted = official_sources(spark, sf).join(
        inputs.table(spark, sf, "documents").select(
            "doc_id", F.col("source").alias("package_id")), "doc_id")
    packages = inputs.table(spark, sf, "documents").select(
        F.col("source").alias("package_id")).distinct().withColumn("version", F.lit(1))
    return research.affected_packages(packages, accepted)


REBUILT_PACKAGES = f"""
SELECT DISTINCT source AS package_id, 2 AS version, 1 AS supersedes
FROM documents JOIN ({OFFICIAL_SOURCES}) USING (doc_id) WHERE accepted"""


# ------------------------------------------------------------------- prices --
def _priced_packages(spark, sf):
    """Suppliers as packages, their price sentences as evaluated claims."""
    claims = price_texts(spark, sf)
    rows = classify.with_category(claims, "text", PROFILE).select(
        F.col("l_suppkey").alias("package_id"),
        F.struct("l_orderkey", "l_linenumber", "l_partkey", "text").alias("claim_ord"),
        F.col("text").alias("claim"), "category",
        F.when(F.col("l_partkey") % 3 == 0, "SUPPORTED").otherwise("UNSUPPORTED")
        .alias("evidence_status"))
    packages = inputs.table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("package_id"),
        F.when(F.col("s_nationkey") % 2 == 0, F.lit("tion ingeres")).otherwise(
            F.lit("other words")).alias("query"),
        F.when(F.col("s_acctbal") > 0, "COMMERCIAL").otherwise("INFORMATIONAL")
        .alias("intent"))
    return packages, rows


def observed_ranges(spark, sf):
    """Observed price range of each part over all its line items."""
    rows = prices.price_contexts(price_texts(spark, sf), "text").select(
        F.col("l_partkey").alias("package_id"),
        F.struct("l_orderkey", "l_linenumber", "l_partkey", "text").alias("obs_ord"), "price")
    return prices.observed_range(rows)


OBSERVED_RANGES = o.with_(PRICE_TEXTS, PRICE_CONTEXTS) + f"""
SELECT package_id, low, high, basis, vat_status, 'EUR' AS currency, battery_included,
       installation_included, n AS observation_count,
       '{fv.OBSERVED_RANGE_WORDING}' AS wording
FROM (SELECT l_partkey AS package_id, basis, vat_status, battery_included,
             installation_included, count(*) AS n, min(amounts[1]) AS low,
             max(amounts[-1]) AS high, min(struct_pack(a := l_orderkey, b := l_linenumber, c := l_partkey, t := text)) AS f
      FROM priced WHERE basis <> 'UNKNOWN' GROUP BY ALL)
QUALIFY row_number() OVER (PARTITION BY package_id ORDER BY n DESC, f) = 1 AND n >= 2"""

PRICED = o.with_(PRICE_TEXTS, PRICE_CONTEXTS) + f""",
answers AS (
  SELECT *, l_suppkey AS package_id, struct_pack(a := l_orderkey, b := l_linenumber, c := l_partkey, t := text) AS claim_ord
  FROM (SELECT *, {_sql_category('text', 'n')} AS category
        FROM (SELECT *, {o.norm('text')} AS n FROM priced))
  WHERE category IN ({o.listed(fv.PRICE_ANSWER_CATEGORIES)}) AND l_partkey % 3 = 0
    AND basis <> 'UNKNOWN'),
suppliers AS (
  SELECT s_suppkey AS package_id, CASE WHEN s_nationkey % 2 = 0 THEN 'tion ingeres'
           ELSE 'other words' END AS query,
         CASE WHEN s_acctbal > 0 THEN 'COMMERCIAL' ELSE 'INFORMATIONAL' END AS intent
  FROM supplier)"""


def price_gap(spark, sf):
    """Parts whose price question no supported, usable figure answers."""
    evaluated = classify.with_category(price_texts(spark, sf), "text", PROFILE).select(
        F.col("l_partkey").alias("package_id"), F.col("text").alias("claim"), "category",
        F.when(F.col("l_quantity") < 5, "SUPPORTED").otherwise("UNSUPPORTED")
        .alias("evidence_status"))
    packages = inputs.table(spark, sf, "part").select(
        F.col("p_partkey").alias("package_id"),
        F.concat_ws(" ", "p_type", "p_name").alias("query"))
    return prices.price_gap(packages, evaluated, PROFILE)


PRICE_GAP = o.with_(PRICE_TEXTS, PRICE_CONTEXTS) + f"""
SELECT p_partkey AS package_id, concat_ws(' ', p_type, p_name) AS query FROM part
WHERE (contains(lower(concat_ws(' ', p_type, p_name)), 'tion')
       OR contains(lower(concat_ws(' ', p_type, p_name)), 'ing'))
  AND p_partkey NOT IN (
    SELECT l_partkey FROM priced WHERE l_quantity < 5 AND basis <> 'UNKNOWN')"""


def core_question(spark, sf):
    return _core(spark, sf).select(
        "package_id", "core_question", "core_answer_status", "must_answer_directly",
        F.size("answers").alias("n_answers"),
        F.array_join(F.transform("answers", lambda a: a["claim"]), "|").alias("answers"),
        F.col("observed_range.low").alias("low"),
        F.col("observed_range.high").alias("high"),
        F.col("observed_range.observation_count").alias("observation_count"))


CORE_QUESTION = PRICED + """,
top AS (
  SELECT package_id, count(*) AS n, string_agg(text, '|' ORDER BY claim_ord) AS a FROM (
    SELECT * FROM answers) GROUP BY 1),
ranges AS (
  SELECT * FROM (
    SELECT package_id, count(*) AS n, min(amounts[1]) AS low, max(amounts[-1]) AS high,
           min(claim_ord) AS f
    FROM answers GROUP BY package_id, basis, vat_status, battery_included,
                          installation_included)
  QUALIFY row_number() OVER (PARTITION BY package_id ORDER BY n DESC, f) = 1 AND n >= 2)
SELECT s.package_id, CASE WHEN asked THEN query END AS core_question,
  CASE WHEN NOT asked THEN 'NOT_APPLICABLE' WHEN t.n IS NULL THEN 'CORE_QUESTION_UNRESOLVED'
       ELSE 'EVIDENCE_AVAILABLE' END AS core_answer_status,
  asked AND t.n IS NOT NULL AS must_answer_directly,
  CASE WHEN asked THEN t.n END AS n_answers, CASE WHEN asked THEN t.a END AS answers,
  CASE WHEN asked THEN r.low END AS low, CASE WHEN asked THEN r.high END AS high,
  CASE WHEN asked THEN r.n END AS observation_count
FROM (SELECT *, query = 'tion ingeres' AND intent = 'COMMERCIAL' AS asked FROM suppliers) s
LEFT JOIN top t USING (package_id) LEFT JOIN ranges r USING (package_id)"""


def public_price_answers(spark, sf):
    """Price answers as the public page gets them: no addresses, no claim internals."""
    return _core(spark, sf).where("answers is not null").select(
        "package_id", F.inline(publication.public_answers(F.col("answers")))).select(
        "package_id", "claim", "category", "qualification", "currency", "basis", "vat_status",
        "battery_included", "installation_included", "is_range")


PUBLIC_PRICE_ANSWERS = PRICED + """
SELECT package_id, text AS claim, category, CASE WHEN category = 'MARKET_AVERAGE'
    THEN 'an average this source reports' ELSE 'a figure this source reports' END AS qualification,
  'EUR' AS currency, basis, vat_status, battery_included, installation_included,
  len(amounts) > 1 AS is_range
FROM answers JOIN suppliers USING (package_id)
WHERE query = 'tion ingeres' AND intent = 'COMMERCIAL'"""


def conflict_kinds(spark, sf):
    """Consecutive price sentences of an order, classified as disagreements."""
    rows = price_texts(spark, sf).withColumn("region", F.get(
        F.array(*[F.lit(r) for r in _REGIONS]), (F.col("l_suppkey") % 5).cast("int")))
    other = rows.select(
        "l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"),
        F.col("text").alias("other"), F.col("region").alias("other_region"))
    return rows.join(other, ["l_orderkey", "l_linenumber"]).select(
        "l_orderkey", "l_linenumber", classify.conflict_kind(
            F.col("text"), F.col("other"), F.col("region"), F.col("other_region"), PROFILE)
        .alias("conflict_kind"))


_REGIONS = ("BE", "BE-WAL", "BE-BRU", "UNKNOWN", "FR")
_UNITS = o.case([("contains({x}, 'par kWc')", "'per_kwc'"),
                 ("contains({x}, 'par m²')", "'per_m2'")])
CONFLICT_KINDS = o.with_(PRICE_TEXTS) + f""",
tagged AS (
  SELECT *, [{o.listed(_REGIONS)}][l_suppkey % 5 + 1] AS region,
         {_UNITS.format(x='text')} AS unit, right(text, 5) AS y FROM price_texts),
pairs AS (
  SELECT a.l_orderkey, a.l_linenumber, a.text AS t, b.text AS u, a.region AS r,
         b.region AS s, a.unit AS ua, b.unit AS ub, a.y AS ya, b.y AS yb
  FROM tagged a JOIN tagged b
    ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber - 1)
SELECT l_orderkey, l_linenumber, CASE
  WHEN r <> 'UNKNOWN' AND s <> 'UNKNOWN' AND r <> s AND NOT {_cover('r', 's')}
    AND NOT {_cover('s', 'r')} THEN 'REGIONAL_DIFFERENCE'
  WHEN ua <> ub THEN 'SCOPE_DIFFERENCE'
  WHEN ya <> yb THEN 'TIME_DIFFERENCE'
  WHEN t = u THEN 'WORDING_VARIATION' ELSE 'TRUE_CONFLICT' END AS conflict_kind
FROM pairs"""


def conflict_summary(spark, sf):
    return classify.conflict_summary(
        conflict_kinds(spark, sf).withColumn("package_id", F.col("l_linenumber")))


CONFLICT_SUMMARY = f"""
SELECT l_linenumber AS package_id,
  {", ".join(f"count(*) FILTER (conflict_kind = '{k}') AS {k.lower()}" for k in (
      'TRUE_CONFLICT', 'REGIONAL_DIFFERENCE', 'TIME_DIFFERENCE', 'SCOPE_DIFFERENCE',
      'WORDING_VARIATION'))},
  count(*) FILTER (conflict_kind = 'TRUE_CONFLICT') AS blocking,
  count(*) FILTER (conflict_kind <> 'TRUE_CONFLICT') AS non_blocking
FROM ({CONFLICT_KINDS}) GROUP BY 1"""


# -------------------------------------------------------------------- brief --
def brief_facts(spark, sf):
    _, evaluated = _priced_packages(spark, sf)
    return brief.required_facts(
        evaluated.withColumn("source_ref", F.col("package_id").cast("string")),
        _core(spark, sf)).select("package_id", "fact_ord", "fact", "category")


def content_briefs(spark, sf):
    packages, _ = _priced_packages(spark, sf)
    questions = inputs.table(spark, sf, "part").groupBy(
        (F.col("p_partkey") % 100).alias("package_id")).agg(
            F.array_sort(F.collect_set("p_name")).alias("questions"))
    missing = inputs.table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("package_id"), F.array("s_name").alias("notes"),
        (F.col("s_acctbal") < 1000).alias("partial_observation"))
    return brief.briefs(packages, _core(spark, sf), questions, missing, PROFILE).select(
        "package_id", "content_type", "core_answer_status", "recommended_title",
        "recommended_slug", F.size("outline").alias("sections"),
        F.array_join("outline", "|").alias("outline"),
        F.size("key_questions").alias("key_questions"),
        F.col("cta_strategy.code").alias("cta_code"),
        F.size("missing_information").alias("missing"))


CONTENT_BRIEFS = f"""
WITH core AS ({CORE_QUESTION}),
asked AS (SELECT p_partkey % 100 AS package_id, list_sort(list(DISTINCT p_name)) AS q
          FROM part GROUP BY 1),
s AS (SELECT s_suppkey AS package_id, s_acctbal < 1000 AS partial,
        CASE WHEN s_nationkey % 2 = 0 THEN 'tion ingeres' ELSE 'other words' END AS query,
        CASE WHEN s_acctbal > 0 THEN 'COMMERCIAL' ELSE 'INFORMATIONAL' END AS intent
      FROM supplier),
plan AS (
  SELECT *, CASE WHEN intent = 'COMMERCIAL' THEN {o.array(fv.OUTLINES['LANDING_PAGE'])}
                 ELSE {o.array(fv.OUTLINES['GUIDE'])} END AS own FROM s)
SELECT p.package_id, CASE WHEN intent = 'COMMERCIAL' THEN 'LANDING_PAGE' ELSE 'GUIDE' END
         AS content_type, core_answer_status,
  upper(left(query, 1)) || substr(query, 2) AS recommended_title,
  replace(query, ' ', '-') AS recommended_slug,
  len(own) + coalesce(len(q), 0) AS sections,
  array_to_string(list_concat(list_slice(own, 1, len(own) - 1), coalesce(q, []),
    [own[-1]]), '|') AS outline,
  coalesce(len(q), 0) AS key_questions,
  CASE WHEN intent = 'COMMERCIAL' THEN 'quote' ELSE 'guide' END AS cta_code,
  1 + CASE WHEN partial THEN 1 ELSE 0 END
    + CASE WHEN core_answer_status = 'CORE_QUESTION_UNRESOLVED' THEN 1 ELSE 0 END AS missing
FROM plan p JOIN core USING (package_id) LEFT JOIN asked USING (package_id)"""

BRIEF_FACTS = f"""
WITH core AS ({CORE_QUESTION}),
base AS ({PRICED} SELECT l_suppkey AS package_id, struct_pack(a := l_orderkey, b := l_linenumber, c := l_partkey, t := text) AS ord,
         text, category FROM (SELECT *, {_sql_category('text', 'n')} AS category
         FROM (SELECT *, {o.norm('text')} AS n FROM priced)) WHERE l_partkey % 3 = 0),
lead AS (
  SELECT package_id, 0 AS g, i AS ord, parts[i] AS fact
  FROM (SELECT package_id, string_split(answers, '|') AS parts FROM core
        WHERE must_answer_directly), unnest(generate_series(1, len(parts))) AS u(i)),
both_ AS (
  SELECT package_id, g, ord, fact FROM lead
  UNION ALL SELECT package_id, 1, row_number() OVER (PARTITION BY package_id ORDER BY ord),
    text FROM base)
SELECT * FROM (
  SELECT package_id, row_number() OVER (PARTITION BY package_id ORDER BY g, ord)
           AS fact_ord, fact,
         (SELECT any_value(category) FROM base b WHERE b.text = fact) AS category
  FROM both_)"""


def cautionary_topics(spark, sf):
    """Restricted topics per retrieval source, and whether its documents carry them."""
    rows = inputs.documents(spark, sf).select(
        F.col("source").alias("package_id"), F.col("body").alias("claim"),
        F.when(F.col("lang") == "en", "SUPPORTED").otherwise("UNSUPPORTED")
        .alias("evidence_status"))
    return brief.cautionary_topics(
        rows.select("package_id").distinct(), rows, PROFILE).select(
            "package_id", "topic", "has_supported_evidence")


CAUTIONARY_TOPICS = f"""
SELECT source AS package_id, topic,
       bool_or(lang = 'en' AND contains(lower(text), topic)) AS has_supported_evidence
FROM documents, (SELECT unnest({o.array(PROFILE.restricted_claims)}) AS topic)
GROUP BY ALL"""


QUERIES = {
    "claim_concepts": (claim_concepts, CLAIM_CONCEPTS),
    "passage_concepts": (passage_concepts, PASSAGE_CONCEPTS),
    "typed_quantities": (typed_quantities, TYPED_QUANTITIES),
    "supported_pairs": (supported_pairs, SUPPORTED_PAIRS),
    "best_passages": (best_passages, BEST_PASSAGES),
    "evidence_verdicts": (evidence_verdicts, EVIDENCE_VERDICTS),
    "evidence_summary": (evidence_summary, EVIDENCE_SUMMARY),
    "unresolved_high_risk": (unresolved_high_risk, UNRESOLVED_HIGH_RISK),
    "research_plan": (research_plan, RESEARCH_PLAN),
    "writer_claims": (writer_claims, WRITER_CLAIMS),
    "forbidden_topics": (forbidden_topics, FORBIDDEN_TOPICS),
    "evidence_sink": (evidence_sink, EVIDENCE_SINK),
    "passage_sink": (passage_sink, PASSAGE_SINK),
    "confidence_summary": (confidence_summary, CONFIDENCE_SUMMARY),
    "rejected_report": (rejected_report, REJECTED_REPORT),
    "gated_verdicts": (gated_verdicts, GATED_VERDICTS),
    "gated_confidence": (gated_confidence, GATED_CONFIDENCE),
    "gated_header": (gated_header, GATED_HEADER),
    "gated_sections": (gated_sections, GATED_SECTIONS),
    "gated_rejected": (gated_rejected, GATED_REJECTED),
    "package_sections": (package_sections, PACKAGE_SECTIONS),
    "package_header": (package_header, PACKAGE_HEADER),
    "facts_first_version": (facts_first_version, FACTS_FIRST_VERSION),
    "facts_second_version": (facts_second_version, FACTS_SECOND_VERSION),
    "official_sources": (official_sources, OFFICIAL_SOURCES),
    "rebuilt_packages": (rebuilt_packages, REBUILT_PACKAGES),
    "observed_ranges": (observed_ranges, OBSERVED_RANGES),
    "price_gap": (price_gap, PRICE_GAP),
    "core_question": (core_question, CORE_QUESTION),
    "public_price_answers": (public_price_answers, PUBLIC_PRICE_ANSWERS),
    "conflict_kinds": (conflict_kinds, CONFLICT_KINDS),
    "conflict_summary": (conflict_summary, CONFLICT_SUMMARY),
    "brief_facts": (brief_facts, BRIEF_FACTS),
    "content_briefs": (content_briefs, CONTENT_BRIEFS),
    "cautionary_topics": (cautionary_topics, CAUTIONARY_TOPICS),
}
