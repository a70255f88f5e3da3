"""Registered queries: statements with figures, matched, contradicted and judged per part.

Each part is a research package with three claims (price, yield, warranty); each line item
of the part is a source that states one or two figures.  Offers of one part agree, differ,
name another region, year or unit, so every branch of the numeric stage has input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from probatio import fixed_values as fv
from probatio.functions import keys, prices as price_functions, text
from probatio.operators import authority, classify, evidence, gate, matching, prices, research
from probatio.plans import inputs, oracle as o
from probatio.plans.catalog.claims import (
    PASSAGES, POLICY, PRICE_CONTEXTS, PRICE_TEXTS, _sql_category, price_texts,
)
from probatio.plans.catalog.evidence import (
    _MARK, _MISMATCH, _VERDICT_COLUMNS, AS_OF_YEAR, DIMENSIONS, PASSAGE_CONCEPT_CTES, _compatible,
    _concepts, _swap,
)
from probatio.plans.catalog.relevance import _cover, region_sql
from probatio.plans.evidence_run import EvidenceRun
from probatio.plans.probe import PROFILE
from probatio.session import cut_lineage, shuffled
from probatio.sources import sinks

_MARKET = "BE-WAL"  # claims that name no region are about this one
_OFFER_KEY = ("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey")
_REGIONS = (" thth", " thhe", " thha")  # words that name the three regions of the profile


def _statement(kind: Column, price: Column, unit: Column, share: Column, years: Column) -> Column:
    return (F.when(kind == 0, F.concat(F.lit("coûte "), price, F.lit(" €"), unit,
                                       F.lit(" pose comprise")))
            .when(kind == 1, F.concat(F.lit("garde "), share, F.lit(" % de rendement")))
            .otherwise(F.concat(F.lit("reste garanti "), years, F.lit(" ans chez le fabricant"))))


def _pick(n: Column, *texts: str) -> Column:
    chosen = F.lit("")
    for i, value in enumerate(texts):
        chosen = F.when(n == i, value).otherwise(chosen)
    return chosen


def _number(n: Column) -> Column:
    return n.cast("long").cast("string")


def offers(spark, sf) -> DataFrame:
    """One source per line item, with the name of its part in what it states."""
    part = inputs.table(spark, sf, "part").select("p_partkey", "p_name", "p_type")
    rows = inputs.spread(inputs.table(spark, sf, "lineitem"), "l_orderkey").join(
        shuffled(part), F.col("l_partkey") == F.col("p_partkey"))
    line, quantity = F.col("l_linenumber"), F.col("l_quantity").cast("long")
    values = (_number(100 + 10 * (quantity % 5)),
              F.when(F.col("l_tax") >= 0.06, " par m²").otherwise(" par kWc"),
              _number(80 + F.round(F.col("l_discount") * 100) % 4),
              _number(10 + 5 * (quantity % 3)))
    end = F.concat(
        F.when(F.col("l_returnflag") == "A", F.concat(F.lit(" en 20"), F.substring(
            F.year("l_shipdate").cast("string"), 3, 2))).otherwise(""),
        _pick(F.col("l_suppkey") % 6, *_REGIONS), F.lit("."))
    name, kind = F.concat(F.lit(" module "), "p_name"), F.lower("p_type")
    plain = F.concat(F.lit("Le"), name, F.lit(" de la gamme "), kind, F.lit(" "))
    opening = F.when(F.col("l_returnflag") == "R", F.concat(
        F.lit("Dans la gamme "), kind, F.lit(" le "), "p_name", F.lit(" module "))).otherwise(plain)
    body = F.concat(opening, _statement(line % 3, *values), end)
    both = F.when(F.col("l_linestatus") == "O", F.concat(
        body, F.lit("\n\n"), plain, _statement((line + 1) % 3, *values), F.lit("."))).otherwise(body)
    ref = F.concat_ws("-", *(F.col(c).cast("string") for c in _OFFER_KEY),
                      _number(F.round(F.col("l_extendedprice") * 100)))
    return rows.select(
        F.col("l_partkey").alias("package_id"), ref.alias("source_ref"),
        ref.alias("source_ord"), F.lit("").alias("title"), both.alias("body"),
        F.concat(F.lit("https://src"), (F.col("l_suppkey") % 9).cast("string"),
                 F.lit(".example.com/"), ref).alias("url"),
        F.lit("web").alias("source_type"),
        F.when(F.col("l_linestatus") == "O", F.to_timestamp(F.lit("2024-01-01")))
        .alias("published_at"))


def part_claims(spark, sf) -> DataFrame:
    """Three claims per part."""
    key, size = F.col("p_partkey"), F.col("p_size")
    values = (_number(100 + 10 * (size % 5)),
              F.when(key % 7 == 0, "").when(size % 2 == 0, " par m²").otherwise(" par kWc"),
              _number(80 + size % 4), _number(10 + 5 * (size % 3)))
    end = F.concat(
        F.when(key % 3 == 0, F.concat(F.lit(" en 20"), F.element_at(F.array(
            *map(F.lit, ("98", "99", "00", "01"))), (key % 4 + 1).cast("int")))).otherwise(""),
        _pick(key % 5, *_REGIONS[:2]), F.lit("."))
    said = F.concat(F.lit("Le module "), "p_name", F.lit(" de la gamme "), F.lower("p_type"),
                    F.lit(" "), _statement(F.col("kind"), *values), end)
    return inputs.table(spark, sf, "part").withColumn(
        "kind", F.explode(F.array(*map(F.lit, range(3))))).select(
        key.alias("package_id"), F.concat_ws("-", key.cast("string"), F.col("kind").cast(
            "string")).alias("claim_id"), F.col("kind").alias("claim_ord"),
        said.alias("claim"), F.lit(None).cast("string").alias("source_ref"))


def _run(spark, sf) -> EvidenceRun:
    return EvidenceRun(offers(spark, sf), part_claims(spark, sf), _MARKET, PROFILE,
                       AS_OF_YEAR, equal_texts=True)


def _statement_sql(kind: str, price: str, unit: str, share: str, years: str) -> str:
    return (f"CASE {kind} WHEN 0 THEN 'coûte ' || {price} || ' €' || {unit} || ' pose comprise' "
            f"WHEN 1 THEN 'garde ' || {share} || ' % de rendement' "
            f"ELSE 'reste garanti ' || {years} || ' ans chez le fabricant' END")


def _pick_sql(n: str, texts) -> str:
    return "CASE " + n + "".join(f" WHEN {i} THEN '{t}'" for i, t in enumerate(texts)) + \
        " ELSE '' END"


_LINE = ("100 + 10 * (l_quantity::BIGINT % 5)",
         "CASE WHEN l_tax >= 0.06 THEN ' par m²' ELSE ' par kWc' END",
         "80 + round(l_discount * 100)::BIGINT % 4", "10 + 5 * (l_quantity::BIGINT % 3)")
_PART = ("100 + 10 * (p_size % 5)",
         "CASE WHEN p_partkey % 7 = 0 THEN '' WHEN p_size % 2 = 0 THEN ' par m²' ELSE ' par kWc' END",
         "80 + p_size % 4", "10 + 5 * (p_size % 3)")
OFFERS = f"""
worded AS (
  SELECT *, concat_ws('-', {", ".join(_OFFER_KEY)}, round(l_extendedprice * 100)::BIGINT) AS doc_id, 'Le module ' || p_name || ' de la gamme '
      || lower(p_type) || ' ' AS plain,
    CASE WHEN l_returnflag = 'R' THEN 'Dans la gamme ' || lower(p_type) || ' le ' || p_name
      || ' module ' ELSE 'Le module ' || p_name || ' de la gamme ' || lower(p_type) || ' ' END
      || {_statement_sql("l_linenumber % 3", *(f"({v})" for v in _LINE))}
      || CASE WHEN l_returnflag = 'A' THEN ' en 20' || right(year(l_shipdate)::VARCHAR, 2)
           ELSE '' END || {_pick_sql("l_suppkey % 6", _REGIONS)} || '.' AS first
  FROM lineitem JOIN part ON p_partkey = l_partkey),
offers AS (
  SELECT l_partkey AS package_id, doc_id, first || CASE WHEN l_linestatus = 'O' THEN
      chr(10) || chr(10) || plain
      || {_statement_sql("(l_linenumber + 1) % 3", *(f"({v})" for v in _LINE))} || '.'
      ELSE '' END AS text,
    'https://src' || l_suppkey % 9 || '.example.com/' || doc_id AS url,
    CASE WHEN l_linestatus = 'O' THEN 'fr' ELSE 'en' END AS lang
  FROM worded),
documents_in AS (SELECT doc_id, '' AS title, text AS body, url, '' AS source, lang FROM offers)"""
PART_CLAIMS = f"""
claims_in AS (
  SELECT p_partkey AS package_id, p_partkey || '-' || kind AS claim_id, kind AS claim_ord,
    'Le module ' || p_name || ' de la gamme ' || lower(p_type) || ' '
      || {_statement_sql("kind", *(f"({v})" for v in _PART))}
      || CASE WHEN p_partkey % 3 = 0 THEN ' en 20' || ['98', '99', '00', '01'][p_partkey % 4 + 1]
           ELSE '' END || {_pick_sql("p_partkey % 5", _REGIONS[:2])} || '.' AS claim
  FROM part, (SELECT unnest(range(3)) AS kind))"""


def _figures(x: str) -> str:
    """Typed figures: a rate is read before the money inside it."""
    rate = r"(\d+) € par (?:kWc|m²)"
    typed = [("RATE", x, rate), ("PERCENT", x, r"(\d+) %"),
             ("MONEY", f"regexp_replace({x}, '{rate}', '', 'g')", r"(\d+) €"),
             ("DURATION", x, r"(\d+) ans"), ("YEAR", x, r" en (20\d\d)")]
    parts = [f"list_transform(regexp_extract_all({t}, '{p}', 1), lambda v: '{k}:' || v)"
             for k, t, p in typed]
    out = parts[0]
    for part in parts[1:]:
        out = f"list_concat({out}, {part})"
    return out


_KIND = "lambda f: split_part(f, ':', 1)"
_VALUE = "lambda f: split_part(f, ':', 2)"
FIGURE_MATCH = f"""
claims_m AS (SELECT *, {_MARK.format(x='head')} AS head_m, {_figures('claim')} AS cf,
               {o.match_tokens('head')} AS head_toks FROM claims_c),
passages_m AS (SELECT *, {_MARK.format(x='n')} AS marked, {_figures('passage')} AS pf
               FROM passages_c),
pairs AS (
  SELECT c.package_id, c.claim_id, p.source_ref, p.passage_ord, c.claim, p.passage,
         c.topic AS ct, p.topic AS pt, cf, pf,
         len(list_intersect(c.topic, p.topic)) AS shared, len(c.topic) AS n,
         (coalesce(contains(p.marked, c.head_m), false)
          OR (c.head IS NOT NULL AND list_has_any(c.phrases, p.phrases))) AS headed,
         list_filter(c.topic, lambda t: NOT list_contains(c.head_toks, t)) AS rest
  FROM claims_m c JOIN passages_m p ON c.package_id = p.package_id
  WHERE (c.region = 'UNKNOWN' OR p.region = 'UNKNOWN' OR {_cover('p.region', 'c.region')})
    AND {_compatible()}),
judged AS (
  SELECT *, CASE WHEN n > 0 THEN shared / n::DOUBLE ELSE 0.0 END AS cov,
         CASE WHEN len(rest) > 0 THEN len(list_intersect(rest, pt)) / len(rest)::DOUBLE
              ELSE 1.0 END AS rest_cov,
         list_intersect(list_transform(cf, {_KIND}), list_transform(pf, {_KIND})) AS kinds
  FROM pairs),
figured AS (
  SELECT *, CASE WHEN len(cf) = 0 THEN '' WHEN len(kinds) = 0 THEN 'NUMERIC_TYPE_MISMATCH'
      WHEN list_has_any(list_transform(cf, {_VALUE}), list_transform(list_filter(pf,
        lambda f: list_contains(kinds, split_part(f, ':', 1))), {_VALUE}))
      THEN 'NUMERIC_AGREES' ELSE 'NUMERIC_DISAGREES' END AS figure,
    CASE WHEN headed THEN 0.7 + 0.3::DOUBLE * cov WHEN n < {fv.MIN_TOPIC_OVERLAP} THEN 0.6
         ELSE 0.4 + 0.5::DOUBLE * cov END AS score
  FROM judged
  WHERE CASE WHEN headed THEN rest_cov >= {fv.MIN_PREDICATE_COVERAGE}
             WHEN shared = 0 THEN false
             WHEN n < {fv.MIN_TOPIC_OVERLAP} AND cov >= 1.0 THEN true
             ELSE shared >= {fv.MIN_TOPIC_OVERLAP} AND cov >= {fv.MIN_TOPIC_COVERAGE} END),
matched AS (
  SELECT *, figure IN ('', 'NUMERIC_AGREES') AS supports,
    CASE figure WHEN 'NUMERIC_AGREES' THEN true WHEN 'NUMERIC_DISAGREES' THEN false END AS agrees,
    concat_ws(',', CASE WHEN headed THEN 'MATCHED_HEAD_CONCEPT' ELSE 'MATCHED_TOPIC_TERMS' END,
              nullif(figure, '')) AS reasons
  FROM figured)"""
MATCH_CTES = (
    OFFERS, DIMENSIONS.removeprefix(o.DOCUMENTS + ","), PART_CLAIMS,
    _concepts("claims_in", "cl", "claim"), f"claims_c AS (SELECT *, {region_sql('n')} AS region FROM cl_c)",
    _swap(_swap(PASSAGES, "source AS package_id", "package_id"), "FROM documents", "FROM offers"),
    PASSAGE_CONCEPT_CTES.removeprefix(PASSAGES + ","), FIGURE_MATCH)


def offer_matches(spark, sf):
    """Every pair of claim and passage about the same thing, with its numeric outcome."""
    found = _run(spark, sf).matches.where(F.get("reasons", F.lit(0)).startswith("MATCHED")
                                          & ~F.array_contains("reasons", "INSUFFICIENT_TOPIC_ALIGNMENT"))
    return found.select("package_id", "claim_id", "source_ref", "passage_ord", "supports",
                        "agrees", "score", F.concat_ws(",", "reasons").alias("reasons"))


OFFER_MATCHES = o.with_(*MATCH_CTES) + """
SELECT package_id, claim_id, source_ref, passage_ord, supports, agrees, score, reasons
FROM matched"""


def offer_references(spark, sf):
    """The passage that speaks for each source, for or against, and why figures differ."""
    return _run(spark, sf).references.select(
        "package_id", "claim_id", "source_ref", "passage_ord", "supports", "agrees",
        "source_region", "conflict_kind")


_UNITS = ("list_filter([CASE WHEN contains({x}, 'par kWc') THEN 'per_kwc' END, "
          "CASE WHEN contains({x}, 'par m²') THEN 'per_m2' END, "
          "CASE WHEN contains({x}, '%') THEN 'percent' END], lambda u: u IS NOT NULL)")
_YEARS = r"regexp_extract_all({x}, '\b(20\d\d)\b')"


def _disjoint(shape: str) -> str:
    a, b = shape.format(x="claim"), shape.format(x="passage")
    return f"len({a}) > 0 AND len({b}) > 0 AND NOT list_has_any({a}, {b})"


REFERENCES = f"""
spoken AS (
  SELECT package_id, claim_id, source_ref, coalesce(
      min(passage_ord) FILTER (supports), min(passage_ord) FILTER (passage_ord = 0)) AS passage_ord
  FROM matched GROUP BY ALL),
best AS (
  SELECT m.* FROM spoken JOIN matched m USING (package_id, claim_id, source_ref, passage_ord)
  WHERE supports OR agrees IS NOT NULL),
need AS (
  SELECT c.package_id, c.claim_id, c.category,
         CASE WHEN c.region = 'UNKNOWN' THEN '{_MARKET}' ELSE c.region END AS scope,
         p.risk, p.authority, p.freshness AS fresh_need, p.minimum, p.rationale
  FROM claims_c c JOIN policy p ON p.category = c.category),
refs AS (
  SELECT b.*, n.scope, d.region AS source_region, d.quality, d.freshness, d.observation, d.source_ord,
    n.risk <> 'HIGH' OR n.scope = 'UNKNOWN' OR d.region = 'UNKNOWN'
      OR {_cover('d.region', 'n.scope')} AS in_scope,
    {o.rank('d.quality', fv.QUALITY_RANK)} AS q, d.freshness = 'DATED_CURRENT' AS cur,
    CASE WHEN supports THEN NULL
      WHEN d.region <> 'UNKNOWN' AND d.region <> n.scope AND NOT {_cover('d.region', 'n.scope')}
        AND NOT {_cover('n.scope', 'd.region')} THEN 'REGIONAL_DIFFERENCE'
      WHEN {_disjoint(_UNITS)} THEN 'SCOPE_DIFFERENCE'
      WHEN {_disjoint(_YEARS)} THEN 'TIME_DIFFERENCE'
      ELSE 'TRUE_CONFLICT' END AS conflict_kind
  FROM best b JOIN dims d USING (source_ref) JOIN need n USING (package_id, claim_id))"""
REFERENCE_CTES = (*MATCH_CTES, POLICY, REFERENCES)
OFFER_REFERENCES = o.with_(*REFERENCE_CTES) + """
SELECT package_id, claim_id, source_ref, passage_ord, supports, agrees, source_region, conflict_kind
FROM refs"""


def offer_verdicts(spark, sf):
    """Verdict per claim; sources that state another figure make it CONFLICTING."""
    return _run(spark, sf).evaluated.select("package_id", *_VERDICT_COLUMNS, "conflict_kind")


VERDICTS = f"""
facts AS (
  SELECT claim_id, count(*) FILTER (supports) AS ns,
    count(*) FILTER (NOT supports) AS nd,
    count(*) FILTER (conflict_kind = 'TRUE_CONFLICT') AS nc,
    array_to_string(list_sort(list(DISTINCT conflict_kind) FILTER (conflict_kind IS NOT NULL)), ', ')
      AS kinds,
    count(*) FILTER (supports AND in_scope) AS nis,
    count(*) FILTER (supports AND in_scope AND cur) AS ncur,
    coalesce(bool_or(cur) FILTER (supports), false) AS anycur,
    arg_min(source_region, source_ord) FILTER (supports) AS first_region,
    arg_max(quality, q) FILTER (supports AND in_scope) AS sq,
    arg_max(quality, q) FILTER (supports) AS bq,
    arg_min(freshness, source_ord) FILTER (supports AND in_scope AND cur) AS curs,
    arg_min(observation, source_ord) FILTER (supports) AS obs
  FROM refs GROUP BY 1),
ladder AS (
  SELECT n.*, f.*, coalesce(ns, 0) AS k, CASE
      WHEN coalesce(ns, 0) = 0 AND coalesce(nc, 0) > 0 THEN 0
      WHEN coalesce(ns, 0) = 0 THEN 1
      WHEN nc > 0 THEN 7
      WHEN risk = 'HIGH' AND scope <> 'UNKNOWN' AND nis = 0 THEN 2
      WHEN {o.rank('sq', fv.QUALITY_RANK)} < {o.rank('authority', fv.AUTHORITY_RANK)} THEN 3
      WHEN ns < minimum AND sq <> 'OFFICIAL' THEN 4
      WHEN fresh_need = 'REQUIRED' AND ncur = 0 THEN 5 ELSE 6 END AS step
  FROM need n LEFT JOIN facts f USING (claim_id)),
verdicts AS (
  SELECT package_id, claim_id, category, risk, k AS corroborating_sources,
    CASE WHEN step IN (0, 7) THEN 'CONFLICTING' WHEN step <= 3 THEN 'UNSUPPORTED'
         WHEN step <= 5 THEN 'PARTIALLY_SUPPORTED' ELSE 'SUPPORTED' END AS evidence_status,
    coalesce(bq, 'UNKNOWN') AS best_source_quality, coalesce(anycur, false) AS has_dated_support,
    coalesce(obs, 'ESTIMATED') AS observability,
    CASE WHEN nc > 0 THEN 'TRUE_CONFLICT' END AS conflict_kind,
    CASE step
      WHEN 0 THEN nc || ' eligible source(s) state a different figure for the same scope and period.'
      WHEN 1 THEN 'No eligible passage materially states this claim.' || CASE WHEN nd > 0 THEN
        ' ' || nd || ' source(s) differ, but only by ' || kinds || '.' ELSE '' END
      WHEN 7 THEN ns || ' source(s) support this figure and ' || nc
        || ' state a different one for the same scope and period.'
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
OFFER_VERDICTS = o.with_(*REFERENCE_CTES, VERDICTS) + f"""
SELECT package_id, {", ".join(_VERDICT_COLUMNS)}, conflict_kind FROM verdicts"""


def offer_summary(spark, sf):
    return evidence.summary(_run(spark, sf).evaluated)


OFFER_SUMMARY = o.with_(*REFERENCE_CTES, VERDICTS) + """
SELECT package_id, count(*) AS claims_total,
  count(*) FILTER (evidence_status = 'SUPPORTED') AS supported,
  count(*) FILTER (evidence_status = 'PARTIALLY_SUPPORTED') AS partially_supported,
  count(*) FILTER (evidence_status = 'UNSUPPORTED') AS unsupported,
  count(*) FILTER (evidence_status = 'CONFLICTING') AS conflicting,
  count(*) FILTER (risk = 'HIGH') AS high_risk_total,
  count(*) FILTER (risk = 'HIGH' AND evidence_status = 'SUPPORTED') AS high_risk_supported,
  count(*) FILTER (risk = 'HIGH' AND evidence_status <> 'SUPPORTED') AS high_risk_blocked,
  count(*) FILTER (corroborating_sources > 1) AS multi_source_claims
FROM verdicts GROUP BY 1"""


def offer_conflicts(spark, sf):
    """Kinds of disagreement per package."""
    return classify.conflict_summary(
        _run(spark, sf).references.where("conflict_kind is not null"))


OFFER_CONFLICTS = o.with_(*REFERENCE_CTES) + """
SELECT package_id, count(*) FILTER (conflict_kind = 'TRUE_CONFLICT') AS true_conflict,
  count(*) FILTER (conflict_kind = 'REGIONAL_DIFFERENCE') AS regional_difference,
  count(*) FILTER (conflict_kind = 'TIME_DIFFERENCE') AS time_difference,
  count(*) FILTER (conflict_kind = 'SCOPE_DIFFERENCE') AS scope_difference,
  count(*) FILTER (conflict_kind = 'WORDING_VARIATION') AS wording_variation,
  count(*) FILTER (conflict_kind = 'TRUE_CONFLICT') AS blocking,
  count(*) FILTER (conflict_kind <> 'TRUE_CONFLICT') AS non_blocking
FROM refs WHERE conflict_kind IS NOT NULL GROUP BY 1"""


def offer_passage_sink(spark, sf):
    """Stored passage rows, those that contradict a claim included."""
    run = _run(spark, sf)
    return sinks.passage_rows(run.references, run.sources).select(
        "package_id", "claim_id", "source_ref", "supports", "agrees", "observation_status",
        "source_quality", "passage", "note")


OFFER_PASSAGE_SINK = o.with_(*REFERENCE_CTES) + """
SELECT package_id, claim_id, source_ref, supports, agrees, observation AS observation_status,
       quality AS source_quality, passage, replace(reasons, ',', '; ') AS note
FROM refs"""


def figure_spread(spark, sf):
    """Per claim and type of figure: who states the same value, who another one."""
    run = _run(spark, sf)
    return matching.figure_spread(run.claims, run.passages)


FIGURE_SPREAD = o.with_(*MATCH_CTES, f"""
stated AS (
  SELECT DISTINCT package_id, source_ref, split_part(f, ':', 1) AS type, split_part(f, ':', 2) AS digits
  FROM passages_m, unnest(pf) AS u(f)),
asked AS (
  SELECT DISTINCT package_id, claim_id, split_part(f, ':', 1) AS type, split_part(f, ':', 2) AS digits
  FROM claims_m, unnest(cf) AS u(f))""") + """
SELECT a.package_id, a.claim_id, a.type, a.digits,
  count(DISTINCT source_ref) FILTER (s.digits = a.digits) AS same_sources,
  count(DISTINCT source_ref) FILTER (s.digits <> a.digits) AS other_sources,
  count(DISTINCT s.digits) FILTER (s.digits <> a.digits) AS other_values
FROM asked a LEFT JOIN stated s USING (package_id, type) GROUP BY ALL"""


# ------------------------------------------------------------ official pass --
_OFFICIAL_HOST = r"//src[13]\."


def _gate_queries(spark, sf):
    """What each part was searched with; every fifth search was about something else."""
    return inputs.table(spark, sf, "part").select(
        F.col("p_partkey").alias("package_id"),
        F.when(F.col("p_partkey") % 5 == 4, F.concat(
            F.lit("batterie domestique hybride stockage "), "p_name"))
        .otherwise(F.concat(F.lit("module "), "p_name", F.lit(" gamme "), F.lower("p_type")))
        .alias("query"))


def official_rebuild(spark, sf):
    """Verdicts after the official pages of every fourth part came in."""
    everything = offers(spark, sf)
    official = everything.where(F.col("url").rlike(_OFFICIAL_HOST)
                                & (F.col("package_id") % 4 == 0))
    sources = everything.where(~F.col("url").rlike(_OFFICIAL_HOST))
    judged = authority.accept_official(official.withColumn("category", F.when(
        F.col("package_id") % 8 == 0, "GRID_RULE").otherwise("SUBSIDY")), PROFILE, AS_OF_YEAR)
    claims = part_claims(spark, sf)

    def evaluate(chosen, packages=None):
        mine = claims if packages is None else claims.join(
            shuffled(packages), "package_id", "left_semi")
        return EvidenceRun(chosen, mine, _MARKET, PROFILE, AS_OF_YEAR,
                           equal_texts=True).evaluated

    packages = inputs.table(spark, sf, "part").select(
        F.col("p_partkey").alias("package_id"), F.lit(1).alias("version"))
    profiles = gate.query_profile(_gate_queries(spark, sf), PROFILE)
    return research.official_pass(
        packages, cut_lineage(evaluate(sources)), sources, judged, profiles, evaluate
    ).select("package_id", *_VERDICT_COLUMNS, "conflict_kind", "version", "supersedes")


# All is computed again from the pages that count: those of the web, and official ones that
# are accepted and on topic.
_KEPT_OFFERS = _swap(_swap(OFFERS, "offers AS (", "offers_all AS ("), OFFERS[OFFERS.index(
    ",\ndocuments_in AS ("):], f""",
queries_in AS (
  SELECT p_partkey AS package_id, CASE WHEN p_partkey % 5 = 4
    THEN 'batterie domestique hybride stockage ' || p_name
    ELSE 'module ' || p_name || ' gamme ' || lower(p_type) END AS query FROM part),
{o.query_profiles(PROFILE).split("FROM benchmark),")[1].strip()},
accepted AS (
  SELECT package_id, doc_id, '' AS title, text AS body, url FROM offers_all
  WHERE package_id % 4 = 0 AND (contains(url, '//src3.')
    OR contains(url, '//src1.') AND package_id % 8 = 0)),
{o.gate_rows("accepted", PROFILE).strip()},
offers AS (
  SELECT * FROM offers_all WHERE NOT regexp_matches(url, '{_OFFICIAL_HOST}')
    OR doc_id IN (SELECT doc_id FROM gated WHERE relevance_status = 'RELEVANT'))"""
) + OFFERS[OFFERS.index(",\ndocuments_in AS ("):]
OFFICIAL_REBUILD = o.with_(_KEPT_OFFERS, *REFERENCE_CTES[1:], VERDICTS) + f"""
SELECT package_id, {", ".join(_VERDICT_COLUMNS)}, conflict_kind,
  CASE WHEN package_id IN (SELECT package_id FROM accepted) THEN 2 ELSE 1 END AS version,
  CASE WHEN package_id IN (SELECT package_id FROM accepted) THEN 1 END AS supersedes
FROM verdicts"""


def official_plan(spark, sf):
    """Searches for parts whose price question the evidence left open."""
    evaluated = _run(spark, sf).evaluated
    packages = inputs.table(spark, sf, "part").select(
        F.col("p_partkey").alias("package_id"),
        F.concat_ws(" ", "p_name", "p_type").alias("query"),
        F.concat_ws(" ", "p_name", "p_type").alias("topic"), F.lit(PROFILE.market).alias("market"))
    blocked = evidence.blocked_claims(evaluated, prices.price_gap(packages, evaluated, PROFILE))
    return evidence.research_plan(
        blocked, packages.drop("query"), PROFILE).select("package_id", "plan_ord", "query",
                                                         "category", "reason")


OFFICIAL_PLAN = o.with_(*REFERENCE_CTES, VERDICTS, f"""
asked AS (
  SELECT p_partkey AS package_id, p_name || ' ' || p_type AS query FROM part
  WHERE regexp_matches(lower(p_name || ' ' || p_type), 'tion|ing')),
answered AS (
  SELECT package_id FROM verdicts JOIN claims_in USING (package_id, claim_id)
  WHERE evidence_status = 'SUPPORTED' AND category IN ({o.listed(fv.PRICE_ANSWER_CATEGORIES)})
    AND regexp_matches(claim, '€ par (kWc|m²)')),
blocked AS (
  SELECT package_id, category, count(*) AS n FROM verdicts
  WHERE evidence_status <> 'SUPPORTED' AND (risk = 'HIGH'
    OR category IN ({o.listed(fv.PRICE_ANSWER_CATEGORIES)})
      AND package_id IN (SELECT package_id FROM asked)
      AND package_id NOT IN (SELECT package_id FROM answered)) GROUP BY ALL)""") + f"""
SELECT package_id, 1 AS plan_ord, p_name || ' ' || p_type || ' reference price BE' AS query, category,
  n || ' unresolved ' || category || ' claim(s) need a source meeting the {PROFILE.code} authority bar'
    AS reason
FROM blocked JOIN part ON p_partkey = package_id WHERE category = 'MARKET_PRICE'"""


def due_runs(spark, sf):
    """Orders as search requests; what was served the same day is not run again."""
    orders = inputs.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("run_id"), F.concat(F.lit("Prix É "), F.col("o_orderpriority"))
        .alias("query"), F.lit("BE").alias("market"), F.lit("fr").alias("language"),
        F.col("o_orderdate").cast("timestamp").alias("requested_at"), "o_orderstatus")
    key = keys.run_key(text.normalise(F.col("query")), F.col("market"), F.col("language"),
                       F.date_format("requested_at", "yyyy-MM-dd"))
    runs = orders.where("run_id % 50 = 0").select(key.alias("idempotency_key"), F.when(
        F.col("o_orderstatus") == "O", "FAILED").when(F.col("o_orderstatus") == "P", "PARTIAL")
        .otherwise("SUCCEEDED").alias("status"))
    return research.due_runs(orders.where("run_id % 50 > 0").drop("o_orderstatus"), runs).select(
        "idempotency_key", "run_id", "query", "requests")


DUE_RUNS = """
WITH keyed AS (
  SELECT *, 'Prix É ' || o_orderpriority AS query, sha256('prix e ' || lower(o_orderpriority)
    || '|BE|fr|' || strftime(o_orderdate, '%Y-%m-%d')) AS idempotency_key FROM orders),
served AS (
  SELECT idempotency_key FROM keyed WHERE o_orderkey % 50 = 0 AND o_orderstatus <> 'O')
SELECT idempotency_key, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS run_id,
       arg_min(query, (o_orderdate, o_orderkey)) AS query, count(*) AS requests
FROM keyed WHERE o_orderkey % 50 > 0 AND idempotency_key NOT IN (SELECT idempotency_key FROM served)
GROUP BY 1"""


def shown_prices(spark, sf):
    """Prices as readers of the site see them."""
    rows = classify.with_category(price_texts(spark, sf), "text", PROFILE)
    read = price_functions.with_price_context(rows, "text", "p")
    return read.select(
        "l_orderkey", "l_linenumber", price_functions.shown_price(F.col("p")).alias("price"),
        price_functions.shown_basis(F.col("p.basis")).alias("basis"),
        price_functions.shown_vat(F.col("p.vat_status")).alias("vat"),
        price_functions.shown_size(F.col("p.system_size_kwp")).alias("system_size"),
        price_functions.shown_qualification(F.col("category")).alias("qualification"),
        price_functions.shown_amount(F.col("l_quantity") / 7, F.lit("CHF")).alias("small_amount"))


def _grouped(x: str) -> str:
    return (f"replace(format('{{:,}}', {x}::BIGINT), ',', chr(8239))")


def _labels(x: str, labels: dict, other: str) -> str:
    return o.case([(f"{x} = {o.quoted(k)}", o.quoted(v)) for k, v in labels.items() if k != other],
                  o.quoted(labels[other]))


SHOWN_PRICES = o.with_(PRICE_TEXTS, PRICE_CONTEXTS) + f"""
, named AS (SELECT *, {_sql_category('text', 'n')} AS category
            FROM (SELECT *, {o.norm('text')} AS n FROM priced))
SELECT l_orderkey, l_linenumber,
  {_grouped("amounts[1]")} || ' €' || CASE WHEN len(amounts) > 1
    THEN ' – ' || {_grouped("amounts[-1]")} || ' €' ELSE '' END AS price,
  {_labels("basis", fv.SHOWN_BASIS, "UNKNOWN")} AS basis,
  {_labels("vat_status", fv.SHOWN_VAT, "UNKNOWN")} AS vat,
  CASE WHEN contains(text, '5 kWc') THEN '5 kWc' END AS system_size,
  {_labels("category", fv.SHOWN_QUALIFICATION, "OTHER")} AS qualification,
  CASE WHEN l_quantity / 7 < 10 THEN replace(rtrim(rtrim(CAST(round(CAST(l_quantity / 7
      AS DECIMAL(18, 6)), 2)::DECIMAL(18, 2) AS VARCHAR), '0'), '.'), '.', ',')
    ELSE CAST(round(l_quantity / 7)::BIGINT AS VARCHAR) END || ' CHF' AS small_amount
FROM named"""


QUERIES = {
    "official_rebuild": (official_rebuild, OFFICIAL_REBUILD),
    "official_plan": (official_plan, OFFICIAL_PLAN),
    "due_runs": (due_runs, DUE_RUNS),
    "shown_prices": (shown_prices, SHOWN_PRICES),
    "offer_matches": (offer_matches, OFFER_MATCHES),
    "offer_references": (offer_references, OFFER_REFERENCES),
    "offer_verdicts": (offer_verdicts, OFFER_VERDICTS),
    "offer_summary": (offer_summary, OFFER_SUMMARY),
    "offer_conflicts": (offer_conflicts, OFFER_CONFLICTS),
    "offer_passage_sink": (offer_passage_sink, OFFER_PASSAGE_SINK),
    "figure_spread": (figure_spread, FIGURE_SPREAD),
}
