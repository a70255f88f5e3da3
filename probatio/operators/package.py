"""Package assembly.

A package is one header row plus section rows ``(package_id, section, ord,
payload)`` with a JSON payload per item.  Nesting every claim and passage of a
package into one record would push a large package through a single task, so
items stay rows and are only written next to each other.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from probatio import fixed_values as fv
from probatio.functions import text
from probatio.operators import classify
from probatio.profiles import Profile

PACKAGE_VERSION = 4


# ------------------------------------------------------------ older package --
def facts_first_version(facts: DataFrame, sources: DataFrame) -> DataFrame:
    """A fact is supported when its source resolves and it is dated."""
    known = sources.select("package_id", F.col("source_ref"), F.lit(True).alias("_known"))
    joined = facts.join(known.distinct(), ["package_id", "source_ref"], "left")
    resolves = F.col("_known").isNotNull()
    return joined.withColumn(
        "supported", resolves & (F.col("observability") == "OBSERVED")
    ).withColumn("source_ref", F.when(resolves, F.col("source_ref"))).drop("_known")


def facts_second_version(facts: DataFrame, profile: Profile) -> DataFrame:
    """Adds first-model risk and sufficiency to gated facts of eligible sources.

    ``facts``: claim, observability, relevance_status (of the claim),
    source_quality.
    """
    read = text.once(
        text.once(facts, _norm=text.normalise(F.col("claim"))),
        claim_risk=classify.simple_risk(F.col("claim"), F.col("_norm"), profile))
    judged = read.withColumn("_s", classify.simple_sufficiency(
        F.col("claim_risk"), F.col("source_quality")))
    return judged.withColumns({
        "evidence_sufficient": F.col("_s.sufficient"),
        "notes": F.col("_s.reason"),
        "supported": (F.col("observability") == "OBSERVED")
        & (F.col("relevance_status") == "RELEVANT") & F.col("_s.sufficient"),
    }).drop("_norm", "_s")


# ---------------------------------------------------------------- summaries --
def _mean(score: str) -> Column:
    """Mean of scores from 0 to 1, the same in whatever order rows are added.

    A sum of doubles depends on their order, so a mean that ends in 5 falls to either
    side when it is shown; decimals add up exactly, and twelve places keep such a tie.
    """
    exact = F.sum(F.col(score).cast("decimal(18,15)")).cast("decimal(38,15)")
    return F.round(exact.cast("decimal(28,15)") / F.count(score), 12).cast("double")


def confidence_summary(sources: DataFrame, passage_counts: DataFrame,
                       evidence: DataFrame, outcomes: DataFrame,
                       snapshots: DataFrame) -> DataFrame:
    """What a package rests on, as one row of plain counts.

    ``sources``: package_id, relevance_status, relevance_score, observation_status.
    ``passage_counts``: package_id, reason, passages.  ``evidence``: the verdict
    summary.  ``outcomes``: package_id, state.  ``snapshots``: package_id.
    """
    eligible = F.col("relevance_status") == "RELEVANT"
    read = sources.groupBy("package_id").agg(
        F.count("*").alias("sources_retrieved"),
        F.count_if(eligible).alias("sources_eligible"),
        F.count_if(~eligible).alias("sources_rejected"),
        F.count_if(eligible & (F.col("observation_status") == "OBSERVED"))
        .alias("sources_dated"),
        F.count_if(eligible & (F.col("observation_status") == "ESTIMATED"))
        .alias("sources_undated"),
        _mean("relevance_score").alias("mean_relevance"))
    kept = F.col("reason") == "kept"
    cut = passage_counts.groupBy("package_id").agg(
        F.sum(F.when(kept, F.col("passages")).otherwise(0)).alias("passages_kept"),
        F.sum(F.when(~kept, F.col("passages")).otherwise(0)).alias("passages_dropped"))
    partial = outcomes.groupBy("package_id").agg(F.bool_or(
        F.col("state").isin(*fv.STATES_DEGRADED)).alias("partial_observation"))
    seen = snapshots.select("package_id").distinct().withColumn(
        "serp_available", F.lit(True))
    joined = read
    for part in (cut, evidence, partial, seen):
        joined = joined.join(part, "package_id", "left")
    return joined.fillna(0, ["passages_kept", "passages_dropped"]).fillna(
        False, ["partial_observation", "serp_available"])


def rejected_report(decisions: DataFrame) -> DataFrame:
    """Every source the gate threw away, and why."""
    return decisions.where("relevance_status != 'RELEVANT'").select(
        "package_id", "source_ref", "url", "title",
        F.col("relevance_status").alias("status"),
        F.col("relevance_reason").alias("reason"), "relevance_score")


# -------------------------------------------------------------- writer view --
def writer_claims(evaluated: DataFrame, references: DataFrame,
                  allow_partial: bool = False) -> DataFrame:
    """Claims a writer may use, one row per supporting source."""
    wanted = ["SUPPORTED", "PARTIALLY_SUPPORTED"] if allow_partial else ["SUPPORTED"]
    usable = evaluated.where(F.col("evidence_status").isin(*wanted)).select(
        "package_id", "claim_id", "claim", "category", "evidence_status",
        F.when(F.col("evidence_status") != "SUPPORTED", F.col("reason")).alias("caveat"))
    shown = references.where("supports").select(
        "package_id", "claim_id", "source_ref", "source_quality",
        "passage")
    return usable.join(shown, ["package_id", "claim_id"])


def forbidden_topics(evaluated: DataFrame) -> DataFrame:
    """High-risk categories that failed their own bar."""
    failed = (F.col("risk") == "HIGH") & (F.col("evidence_status") != "SUPPORTED")
    return evaluated.where(failed).select(
        "package_id", F.col("category").alias("topic")).distinct().withColumn(
            "reason", F.lit("no supporting evidence of sufficient authority"))


def unresolved_notes(evaluated: DataFrame, rejected: DataFrame,
                     plan: DataFrame, provider_notes: DataFrame) -> DataFrame:
    """What the package could not establish: (package_id, kind, ord, note)."""
    from pyspark.sql import Window

    status = F.col("evidence_status")
    order = Window.partitionBy("package_id").orderBy("claim_ord")

    def ordered(rows: DataFrame) -> DataFrame:
        return rows.withColumn("ord", F.row_number().over(order))

    short, why = F.col("claim"), F.col("reason")
    nothing = evaluated.groupBy("package_id").agg(
        F.count_if(status == "SUPPORTED").alias("n")).where("n = 0").select(
            "package_id", F.lit("supported").alias("kind"), F.lit(0).alias("ord"),
            F.lit("No atomic claim reached SUPPORTED. Content must not be generated "
                  "from model knowledge alone.").alias("note"))
    thrown = rejected.groupBy("package_id").agg(F.count("*").alias("n")).select(
        "package_id", F.lit("rejected"), F.lit(0), F.concat(
            F.col("n").cast("string"), F.lit(
                " retrieved source(s) were rejected as off-topic and contributed no "
                "passages.")))
    high = ordered(evaluated.where(
        (F.col("risk") == "HIGH") & (status != "SUPPORTED"))).select(
        "package_id", F.lit("high_risk"), "ord", F.concat(
            "category", F.lit(" claim unresolved ("), "evidence_status", F.lit("): "),
            short, F.lit(" — "), why))
    clash = ordered(evaluated.where(status == "CONFLICTING")).select(
        "package_id", F.lit("conflict"), "ord",
        F.concat(F.lit("CONFLICTING evidence: "), short, F.lit(" — "), why))
    searches = plan.groupBy("package_id").agg(F.count("*").alias("n")).select(
        "package_id", F.lit("plan"), F.lit(0), F.concat(
            F.col("n").cast("string"), F.lit(
                " targeted authoritative search(es) proposed to resolve HIGH-risk "
                "gaps.")))
    given = provider_notes.select("package_id", F.lit("provider"), "ord", "note")
    return reduce(lambda a, b: a.union(b), (nothing, thrown, high, clash, searches, given))


# ----------------------------------------------------------------- assembly --
def _section(rows: DataFrame, name: Column | str, order: str) -> DataFrame:
    items = [c for c in rows.columns if c not in ("package_id", order)]
    return rows.select(
        "package_id", (F.lit(name) if isinstance(name, str) else name).alias("section"),
        F.col(order).cast("string").alias("ord"),
        F.to_json(F.struct(*items)).alias("payload"))


def package_sections(sources: DataFrame, evaluated: DataFrame, references: DataFrame,
                     notes: DataFrame, plan: DataFrame) -> DataFrame:
    """All items of all packages as section rows.

    Claims appear once, in the section of their verdict; sources once as eligible
    (official or commercial) or rejected.
    """
    eligible = F.col("relevance_status") == "RELEVANT"
    source_section = (
        F.when(~eligible, "rejected_evidence")
        .when(F.col("source_quality") == "OFFICIAL", "official_evidence")
        .otherwise("commercial_evidence"))
    claim_section = F.concat(F.lower("evidence_status"), F.lit("_claims"))
    parts = [
        _section(sources.withColumn("_o", F.col("source_ref")), source_section, "_o"),
        _section(evaluated, claim_section, "claim_id"),
        _section(references.withColumn("_o", F.concat_ws("/", "claim_id", "source_ref")),
                 "evidence", "_o"),
        _section(notes.withColumn("_o", F.concat_ws("/", "kind", "ord")),
                 "unresolved_questions", "_o"),
        _section(plan, "authoritative_research_plan", "plan_ord"),
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)


def package_header(packages: DataFrame, confidence: DataFrame, version: int,
                   analysis: DataFrame | None = None) -> DataFrame:
    """One sealed header row per package.

    ``packages``: package_id, query, market, language, intent.
    """
    rows = packages.join(confidence, "package_id", "left")
    framing = F.lit(None).cast("string")
    if analysis is not None:
        rows = rows.join(analysis.select(
            F.col("snapshot_id").alias("package_id"), "dominant_framing"),
            "package_id", "left")
        framing = F.col("dominant_framing")
    return rows.withColumn("summary", F.concat_ws(
        "; ",
        F.when(framing.isNotNull(), F.concat(F.lit("SERP framing is "), framing)),
        F.concat(F.col("sources_eligible").cast("string"), F.lit("/"),
                 F.col("sources_retrieved").cast("string"),
                 F.lit(" sources passed relevance")),
        F.concat(F.coalesce("supported", F.lit(0)).cast("string"), F.lit(" of "),
                 F.coalesce("claims_total", F.lit(0)).cast("string"),
                 F.lit(" atomic claims supported")),
    )).withColumns({"package_version": F.lit(PACKAGE_VERSION), "version": F.lit(version)})


def write_package(header: DataFrame, sections: DataFrame, path: str, vertical: str) -> None:
    """Header and sections as parquet, partitioned by vertical and section."""
    for name, rows, by in (("header", header, ["vertical"]),
                           ("sections", sections, ["vertical", "section"])):
        rows.withColumn("vertical", F.lit(vertical)).write.mode("append") \
            .partitionBy(*by).parquet(f"{path}/{name}")
