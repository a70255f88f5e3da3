"""From matched pairs to a verdict per claim.

Everything is an aggregation with map-side partials; no claim's evidence is ever
collected into a list to be decided on.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from probatio import fixed_values as fv
from probatio.functions import text
from probatio.operators import classify
from probatio.profiles import Profile, dimension
from probatio.session import shuffled

_PAIR = ["package_id", "claim_id", "source_ref"]


def best_passages(matches: DataFrame) -> DataFrame:
    """One row per (claim, source): the passage that speaks for the source.

    The first supporting passage wins; without one the source's first passage
    speaks, and counts only when its figure agrees or disagrees.  Other rows cannot speak
    and go before the shuffle.
    """
    order = F.col("passage_ord")
    speaks = F.col("supports") | ((order == 0) & F.col("agrees").isNotNull())
    outcome = F.struct("passage_ord", "supports", "agrees", "score", "reasons")
    best = F.coalesce(
        F.min_by(outcome, F.when(F.col("supports"), order)),
        F.min_by(outcome, F.when(order == 0, order)))
    return (
        matches.where(speaks).groupBy(*_PAIR).agg(best.alias("b")).select(*_PAIR, "b.*"))


def evidence_references(best: DataFrame, claims: DataFrame, passages: DataFrame,
                        sources: DataFrame, profile: Profile) -> DataFrame:
    """Complete each reference with its passage, source dimensions and conflict kind.

    ``sources``: package_id, source_ref, source_ord, source_quality, region,
    freshness_status, observation_status.
    """
    shaped = (
        best
        .join(shuffled(passages.select(
            "package_id", "source_ref", "passage_ord", "passage",
            F.col("norm").alias("_said"))), ["package_id", "source_ref", "passage_ord"])
        .join(shuffled(sources.select(
            "package_id", "source_ref", "source_ord", "source_quality",
            F.col("region").alias("source_region"), "freshness_status",
            "observation_status")), ["package_id", "source_ref"])
        .join(shuffled(claims.select(
            "package_id", "claim_id", "claim", "claim_region",
            F.col("norm").alias("_claimed"))), ["package_id", "claim_id"])
    )
    disagrees = ~F.col("supports") & (F.col("agrees") == F.lit(False))
    kind = classify.conflict_kind(F.col("claim"), F.col("passage"), F.col("claim_region"),
                                  F.col("source_region"), profile,
                                  F.col("_claimed") == F.col("_said"))
    return shaped.withColumn("conflict_kind", F.when(disagrees, kind)).drop(
        "claim", "claim_region", "_claimed", "_said")


def with_claim_region(claims: DataFrame, market: str, profile: Profile) -> DataFrame:
    """Region of a claim for the verdict: the market's when the claim names none."""
    default = market.upper() if market.upper() in profile.region_parent else "UNKNOWN"
    return claims.withColumn("claim_region", F.when(
        F.col("region") == "UNKNOWN", F.lit(default)).otherwise(F.col("region")))


def verdicts(claims: DataFrame, references: DataFrame, profile: Profile) -> DataFrame:
    """Evidence status and reason of every claim.

    ``claims``: package_id, claim_id, claim_region plus the requirement columns
    (risk, authority_requirement, freshness_requirement, min_sources, rationale,
    category).
    """
    supports = F.col("supports")
    true_conflict = F.col("conflict_kind") == "TRUE_CONFLICT"
    base = claims.select("package_id", "claim_id", "claim_region", "risk")
    # Regional scope binds HIGH-risk claims only.
    bound = (F.col("risk") == "HIGH") & (F.col("claim_region") != "UNKNOWN")
    in_scope = supports & (~bound | (F.col("source_region") == "UNKNOWN") | classify.covers(
        F.col("source_region"), F.col("claim_region"), profile))
    quality = classify.quality_rank(F.col("source_quality"))
    current = F.col("freshness_status").isin(*fv.FRESHNESS_CURRENT)
    past = F.col("freshness_status").isin(*fv.FRESHNESS_PAST)
    order = F.struct("source_ord", "source_ref")
    facts = references.join(shuffled(base), ["package_id", "claim_id"]).groupBy(
        "package_id", "claim_id"
    ).agg(
        F.count_if(supports).alias("n_supporting"),
        F.count_if(F.col("conflict_kind").isNotNull()).alias("n_disagreeing"),
        F.count_if(true_conflict).alias("n_true_conflicts"),
        F.array_sort(F.collect_set("conflict_kind")).alias("conflict_kinds"),
        F.count_if(in_scope).alias("n_in_scope"),
        F.count_if(in_scope & current).alias("n_current"),
        F.min_by("source_region", F.when(supports, order)).alias("first_region"),
        F.max_by("source_quality", F.when(in_scope, quality)).alias("scope_quality"),
        F.max_by("source_quality", F.when(supports, quality)).alias("best_quality"),
        F.min_by("freshness_status", F.when(in_scope & past, order)).alias("past_status"),
        F.min_by("freshness_status", F.when(in_scope & current, order))
        .alias("current_status"),
        F.count_if(supports & current).alias("n_current_all"),
        F.min_by("observation_status", F.when(supports, order)).alias("observability"),
    )
    return _decide(claims.join(shuffled(facts), ["package_id", "claim_id"], "left"), profile)


def _decide(rows: DataFrame, profile: Profile) -> DataFrame:
    def known(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(0))

    n, conflicts = known("n_supporting"), known("n_true_conflicts")
    bound = (F.col("risk") == "HIGH") & (F.col("claim_region") != "UNKNOWN")
    rank = classify.quality_rank(F.col("scope_quality"))
    needed = classify.rank(F.col("authority_requirement"), fv.AUTHORITY_RANK)
    short = (n < F.col("min_sources")) & (F.col("scope_quality") != "OFFICIAL")
    stale = (F.col("freshness_requirement") == "REQUIRED") & (known("n_current") == 0)

    def words(*parts) -> Column:
        return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])

    number = n.cast("string")
    category, scope = F.col("category"), F.col("scope_quality")
    differ = F.when(known("n_disagreeing") > 0, words(
        " ", known("n_disagreeing").cast("string"), " source(s) differ, but only by ",
        F.concat_ws(", ", "conflict_kinds"), ".")).otherwise("")
    ladder = [
        ((n == 0) & (conflicts > 0), "CONFLICTING", words(
            conflicts.cast("string"), " eligible source(s) state a different figure for "
            "the same scope and period.")),
        (n == 0, "UNSUPPORTED", words(
            "No eligible passage materially states this claim.", differ)),
        (conflicts > 0, "CONFLICTING", words(
            number, " source(s) support this figure and ", conflicts.cast("string"),
            " state a different one for the same scope and period.")),
        (bound & (known("n_in_scope") == 0), "UNSUPPORTED", words(
            "Regional scope mismatch: ", classify.region_mismatch(
                F.col("first_region"), F.col("claim_region"), profile), ". ",
            F.col("rationale"))),
        (rank < needed, "UNSUPPORTED", words(
            category, " claims require a ", F.col("authority_requirement"),
            " source; the best supporting source is ", scope, ". ", F.col("rationale"))),
        (short, "PARTIALLY_SUPPORTED", words(
            category, " claims need ", F.col("min_sources").cast("string"),
            " independent sources; ", number, " found. ", F.col("rationale"))),
        (stale, "PARTIALLY_SUPPORTED", F.when(
            F.col("past_status").isNotNull(), words(
                "Stated by a ", scope, " source, but that source is ",
                F.col("past_status"), " and cannot establish a current ", category,
                " claim.")
        ).otherwise(words(
            "Stated by a ", scope, " source, but ", category, " claims depend on when "
            "they were published and no supporting source is dated or presents as in "
            "force."))),
    ]
    supported = words(
        "Materially stated by ", number, " ", scope, " source(s) (",
        F.coalesce("current_status", F.lit("UNDATED")),
        F.when(F.col("claim_region") != "UNKNOWN",
               words(", scoped ", F.col("claim_region"))).otherwise(""),
        "); meets the ", category, " bar.")
    status = reason = None
    for test, label, why in ladder:
        status = F.when(test, label) if status is None else status.when(test, label)
        reason = F.when(test, why) if reason is None else reason.when(test, why)
    return rows.withColumns({
        "evidence_status": status.otherwise("SUPPORTED"),
        "reason": reason.otherwise(supported),
        "corroborating_sources": n,
        "best_source_quality": F.coalesce("best_quality", F.lit("UNKNOWN")),
        "has_dated_support": known("n_current_all") > 0,
        "conflict_kind": F.when(conflicts > 0, "TRUE_CONFLICT"),
        "observability": F.coalesce("observability", F.lit("ESTIMATED")),
    }).drop("n_supporting", "n_disagreeing", "n_true_conflicts", "conflict_kinds",
            "n_in_scope", "n_current", "first_region", "scope_quality", "best_quality",
            "past_status", "current_status", "n_current_all")


def summary(evaluated: DataFrame) -> DataFrame:
    """Verdict counts per package."""
    def count(status: str) -> Column:
        return F.count_if(F.col("evidence_status") == status)

    high = F.col("risk") == "HIGH"
    done = F.col("evidence_status") == "SUPPORTED"
    return evaluated.groupBy("package_id").agg(
        F.count("*").alias("claims_total"),
        *[count(s).alias(s.lower()) for s in fv.EVIDENCE_STATUSES],
        F.count_if(high).alias("high_risk_total"),
        F.count_if(high & done).alias("high_risk_supported"),
        F.count_if(high & ~done).alias("high_risk_blocked"),
        F.count_if(F.col("corroborating_sources") > 1).alias("multi_source_claims"))


def unresolved_high_risk(evaluated: DataFrame) -> DataFrame:
    return evaluated.where(
        (F.col("risk") == "HIGH") & (F.col("evidence_status") != "SUPPORTED"))


def blocked_claims(evaluated: DataFrame, price_gaps: DataFrame) -> DataFrame:
    """Claims that better sources are looked for: HIGH-risk ones, and price claims of
    packages (``price_gaps``: package_id) whose price question has no usable answer."""
    gaps = price_gaps.select("package_id").distinct().withColumn("_gap", F.lit(True))
    price = F.col("_gap").isNotNull() & F.col("category").isin(*fv.PRICE_ANSWER_CATEGORIES)
    return evaluated.join(shuffled(gaps), "package_id", "left").where(
        ((F.col("risk") == "HIGH") | price) & (F.col("evidence_status") != "SUPPORTED")
    ).drop("_gap")


def _unknown_placeholders(template: str) -> set[str]:
    return set(re.findall(r"{(\w+)}", template)) - {"topic", "market", "category"}


def research_plan(unresolved: DataFrame, packages: DataFrame, profile: Profile) -> DataFrame:
    """Targeted searches per package: one per unresolved category, most blocked first.

    ``packages``: package_id, topic, market.  ``unresolved`` carries category and,
    for ties, claim_ord.  Regional variants come before the national template.
    """
    policy = profile.official_source_policy
    templates = policy.get("query_templates") or {}
    spark = unresolved.sparkSession
    limit = policy.get("max_queries")  # of the profile; without it all are planned
    rows = []
    if policy.get("enabled") and profile.official_domains:
        for category in fv.CLAIM_CATEGORIES:
            for position, suffix in enumerate((*fv.REGIONAL_VARIANTS, "")):
                template = templates.get(category + suffix)
                if template and not _unknown_placeholders(template):
                    rows.append((category, position, suffix.lstrip("_") or None, template))
    shapes = dimension(spark, rows,
                       "category string, position int, variant string, template string")
    blocked = unresolved.groupBy("package_id", "category").agg(
        F.count("*").alias("unresolved"), F.min("claim_ord").alias("first_claim"))
    topic = F.col("template")
    for name in ("topic", "market", "category"):
        topic = F.replace(topic, F.lit("{" + name + "}"), F.col(name))
    planned = (
        blocked.join(shapes, "category").join(shuffled(packages), "package_id")
        .withColumn("query", F.trim(F.when(F.col("variant").isNull(), topic)
                                    .otherwise(F.col("template"))))
    )
    order = F.struct((-F.col("unresolved")).alias("a"), F.col("first_claim").alias("b"),
                     F.col("category").alias("c"), F.col("position").alias("d"))
    # At most a few dozen template rows exist per package, so these windows are small.
    once = planned.withColumn("_key", text.normalise(F.col("query"))).withColumn(
        "_first", F.row_number().over(
            Window.partitionBy("package_id", "_key").orderBy(order))).where("_first = 1")
    ranked = once.withColumn("plan_ord", F.row_number().over(
        Window.partitionBy("package_id").orderBy(order)))
    # A national query still goes out when its own regional variants use up the limit.
    if limit:
        opened = F.min("plan_ord").over(Window.partitionBy("package_id", "category"))
        ranked = ranked.withColumn("_opened", opened).where(
            F.when(F.col("variant").isNull(), F.col("_opened")).otherwise(F.col("plan_ord"))
            <= int(limit))
    return ranked.select(
        "package_id", "plan_ord", "query", "category",
        F.when(F.col("variant").isNotNull(), F.concat(
            F.lit("regional variant for "), "variant", F.lit(
                ": a national query does not reach this region's authorities")))
        .otherwise(F.concat(
            F.col("unresolved").cast("string"), F.lit(" unresolved "), "category",
            F.lit(f" claim(s) need a source meeting the {profile.code} authority bar")))
        .alias("reason"))
