"""Result sinks and the constraint audit."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from probatio import fixed_values as fv
from probatio.session import shuffled


def source_rows(sources: DataFrame, outcomes: DataFrame, decisions: DataFrame) -> DataFrame:
    """Sources with their gate decision, plus a row per outcome without an item.

    ``sources``: run_id, source_ref, source_type, url, state.  ``outcomes``: run_id,
    source_type, state.  ``decisions``: run_id, source_ref, relevance_*.
    """
    kept = sources.join(decisions, ["run_id", "source_ref"], "left").withColumn(
        "no_item_reason", F.lit(None).cast("string"))
    silent = outcomes.select("run_id", "source_type", "state").join(
        sources.select("run_id", "source_type"), ["run_id", "source_type"], "left_anti"
    ).withColumn("no_item_reason", F.col("state"))
    return kept.unionByName(silent, allowMissingColumns=True)


def evidence_rows(evaluated: DataFrame, sources: DataFrame) -> DataFrame:
    """One evidence row per claim whose origin source is stored."""
    known = sources.select("package_id", "source_ref").distinct()
    return evaluated.join(known, ["package_id", "source_ref"]).select(
        "package_id", "source_ref", "claim_id", F.col("claim").alias("fact"),
        F.lit("atomic_claim").alias("evidence_type"), "observability", "risk",
        "category", "evidence_status", "authority_requirement", "freshness_requirement",
        "corroborating_sources", F.col("reason").alias("evaluation_reason"),
        (F.col("evidence_status") == "SUPPORTED").alias("evidence_sufficient"))


def passage_rows(references: DataFrame, sources: DataFrame) -> DataFrame:
    """One row per (claim, source) reference."""
    known = sources.select("package_id", "source_ref").distinct()
    return references.join(
        shuffled(known), ["package_id", "source_ref"], "left_semi").select(
        "package_id", "claim_id", "source_ref",
        "passage", "supports",
        "agrees", "observation_status", "source_quality",
        F.concat_ws("; ", "reasons").alias("note"))


def write_table(rows: DataFrame, path: str, partition_by: list[str] | None = None,
                mode: str = "append") -> None:
    writer = rows.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


# ------------------------------------------------------------------- audits --
# table -> (column, allowed values, NULL allowed)
CHECKS = {
    "research_run": [("status", fv.RUN_STATUSES, False)],
    "research_source": [("status", fv.SOURCE_STATES, False),
                        ("relevance_status", fv.RELEVANCE_STATUSES, True),
                        ("source_quality", tuple(fv.QUALITY_RANK), True)],
    "research_evidence": [("observability", fv.OBSERVATIONS, False),
                          ("evidence_status", fv.EVIDENCE_STATUSES, True),
                          ("category", fv.CLAIM_CATEGORIES, True),
                          ("risk", tuple(fv.RISK_MINIMUM_QUALITY), True),
                          ("authority_requirement", tuple(fv.AUTHORITY_RANK), True),
                          ("freshness_requirement", fv.FRESHNESS_REQUIREMENTS, True)],
    "serp_question": [("kind", ("PAA", "RELATED"), False)],
    "keyword_metric": [("observability", fv.OBSERVATIONS, False)],
    "content_brief": [("content_type", fv.CONTENT_TYPES, False),
                      ("search_intent", fv.INTENTS, False)],
    "qa_review": [("status", fv.QA_STATUSES, False), ("qa_type", fv.QA_TYPES, False),
                  ("layer", fv.QA_LAYERS, True)],
    "approval": [("state", fv.APPROVAL_STATES, False)],
    "published_content": [("state", fv.PUBLICATION_STATES, False)],
    "captured_lead": [("state", fv.LEAD_STATES, False),
                      ("conversion_type", fv.CONVERSION_TYPES, False)],
    "site_event": [("event_type", fv.EVENT_TYPES, False)],
}
# table -> (column, lowest, highest); NULL is allowed
RANGES = {"seo_opportunity": [("overall_score", 0, 100)]}
# table -> columns that are always filled
FILLED = {
    "keyword_metric": ("provider", "metric_type", "retrieved_at"),
    "evidence_passage": ("supports",),
}
# table -> (name, columns it reads, condition that no row may meet)
TOGETHER = {
    "evidence_passage": [("support_that_disagrees", ("supports", "agrees"),
                          "supports AND NOT agrees")],
    "keyword_metric": [("metric_without_value", ("value", "value_text"),
                        "value IS NULL AND value_text IS NULL")],
}
UNIQUE = {
    "vertical": [("code",)],
    "site": [("domain",)],
    "seed_keyword": [("vertical", "normalized_query", "language", "market")],
    "research_run": [("idempotency_key",)],
    "approval": [("draft_id",)],
    "published_content": [("site_id", "locale", "slug", "version")],
    "captured_lead": [("external_correlation_id",)],
    "lead_attribution": [("lead_id",)],
}


def _rules(name: str) -> list[tuple[str, tuple[str, ...], Column, str]]:
    """(rule, columns, test, label) of a table; a UNIQUE rule takes every filled key."""
    found = []
    for column, allowed, nullable in CHECKS.get(name, ()):
        found.append(("CHECK", (column,), F.coalesce(
            ~F.col(column).isin(*allowed), F.lit(not nullable)), column))
    for column, low, high in RANGES.get(name, ()):
        found.append(("RANGE", (column,), ~F.col(column).between(low, high), column))
    for column in FILLED.get(name, ()):
        found.append(("NOT NULL", (column,), F.col(column).isNull(), column))
    for label, columns, condition in TOGETHER.get(name, ()):
        found.append(("TOGETHER", columns, F.expr(condition), label))
    for columns in UNIQUE.get(name, ()):
        # As in SQL, NULL keys never collide.
        filled = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns])
        found.append(("UNIQUE", columns, filled, ",".join(columns)))
    return found


def audit(tables: dict[str, DataFrame]) -> DataFrame:
    """All violations as (table, rule, key, value, rows).

    A table is read once, however many rules it has: each row gives the rules it breaks and
    its unique keys, and one count per (rule, values) covers them all.  Values are counted,
    not listed row by row, so a column that is wrong everywhere still gives one violation
    row per distinct value.
    """
    parts = []
    for name, rows in tables.items():
        entries = [F.when(test, F.struct(
            F.lit(rule).alias("rule"), F.lit(label).alias("key"),
            F.array(*[F.col(c).cast("string") for c in columns]).alias("values")))
            for rule, columns, test, label in _rules(name) if set(columns) <= set(rows.columns)]
        if not entries:
            continue
        counted = rows.select(F.explode(F.array_compact(F.array(*entries))).alias("e")).groupBy(
            "e.rule", "e.key", "e.values").agg(F.count("*").alias("rows"))
        shown = F.when(F.size("values") > 1, F.array_join("values", "|", "NULL")).otherwise(
            F.get("values", F.lit(0)))
        parts.append(counted.where("rule <> 'UNIQUE' OR rows > 1").select(
            F.lit(name).alias("table"), "rule", "key", shown.alias("value"), "rows"))
    return reduce(lambda a, b: a.unionByName(b), parts)


def audit_sites(sites: DataFrame) -> DataFrame:
    """Site documents that contradict themselves, one row per broken rule."""
    origin = F.lower(F.coalesce("canonical_origin", F.lit("")))
    no_domain = F.coalesce("domain", F.lit("")) == ""
    internal = F.lit(False)
    for part in fv.FORBIDDEN_ORIGIN_PARTS:
        internal = internal | origin.contains(part)
    languages = F.when(F.size("supported_languages") > 0, F.col("supported_languages")) \
        .otherwise(F.array("default_language"))
    rules = (
        ("origin_not_https", (origin != "") & ~origin.startswith("https://")),
        ("origin_trailing_slash", origin.endswith("/")),
        ("origin_internal_host", (origin != "") & internal),
        ("origin_not_domain", (origin != "") & ~no_domain
         & ~origin.contains(F.lower("domain"))),
        ("no_domain_not_staging", no_domain & ~F.col("staging")),
        ("staging_indexed", F.col("staging") & F.col("allow_indexing")),
        ("indexing_without_publication",
         F.col("allow_indexing") & ~F.col("allow_publication")),
        ("publication_without_domain", F.col("allow_publication") & no_domain),
        ("default_language_unsupported",
         ~F.array_contains(languages, F.col("default_language"))),
    )
    broken = F.array_compact(F.array(*[F.when(test, F.lit(n)) for n, test in rules]))
    return sites.select("site_id", F.explode(broken).alias("rule"))


def with_context(requests: DataFrame, contexts: DataFrame) -> DataFrame:
    """Attach the search context; an unknown (market, language) keeps a refusal.

    ``requests``: market, language, device.
    """
    shaped = requests.withColumns({"market": F.upper("market"),
                                   "language": F.lower("language")})
    return shaped.join(contexts, ["market", "language", "device"], "left").withColumn(
        "refusal", F.when(F.col("location_code").isNull(), F.concat(
            F.lit("no search context configured for market="), "market",
            F.lit(" language="), "language")))
