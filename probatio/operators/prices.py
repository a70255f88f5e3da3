"""Comparable price observations and the price question of a package."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from probatio import fixed_values as fv
from probatio.functions import prices, text
from probatio.profiles import Profile
from probatio.session import shuffled

COMPARABLE = ["basis", "vat_status", "currency", "battery_included",
              "installation_included"]


def price_contexts(texts: DataFrame, column: str) -> DataFrame:
    """Add ``price``: the stated context, NULL when the text carries no price."""
    return prices.with_price_context(texts, column)


def observed_range(contexts: DataFrame, minimum: int = 2) -> DataFrame:
    """Low and high of the largest comparable group of each package.

    ``contexts``: package_id, obs_ord, price.  Unknown inclusions are a value of
    their own (NULL groups with NULL).  A tie goes to the group seen first.  No
    row means no range may be stated.
    """
    rows = contexts.where("price is not null and price.usable").select(
        "package_id", "obs_ord", F.col("price.basis").alias("basis"),
        F.col("price.vat_status").alias("vat_status"),
        F.coalesce("price.currency", F.lit("EUR")).alias("currency"),
        F.col("price.battery_included").alias("battery_included"),
        F.col("price.installation_included").alias("installation_included"),
        F.array_min("price.amounts").alias("lowest"),
        F.array_max("price.amounts").alias("highest"))
    groups = rows.groupBy("package_id", *COMPARABLE).agg(
        F.count("*").alias("observation_count"), F.min("obs_ord").alias("_first"),
        F.min("lowest").alias("low"), F.max("highest").alias("high"))
    best = groups.groupBy("package_id").agg(F.min_by(
        F.struct("low", "high", *COMPARABLE, "observation_count"),
        F.struct(-F.col("observation_count"), F.col("_first"))).alias("r"))
    return best.select("package_id", "r.*").where(
        F.col("observation_count") >= minimum
    ).withColumn("wording", F.lit(fv.OBSERVED_RANGE_WORDING))


def is_price_query(query: Column, profile: Profile) -> Column:
    policy = profile.price_policy
    terms = [t.casefold() for t in policy.get("price_query_terms") or ()]
    if not policy.get("enabled") or not terms:
        return F.lit(False)
    lowered, test = F.lower(query), F.lit(False)
    for term in terms:
        test = test | lowered.contains(term)
    return test


def price_answers(evaluated: DataFrame) -> DataFrame:
    """Supported price claims with a usable context."""
    return price_contexts(
        evaluated.where(F.col("category").isin(*fv.PRICE_ANSWER_CATEGORIES)
                        & (F.col("evidence_status") == "SUPPORTED")), "claim"
    ).where("price is not null and price.usable")


def price_gap(packages: DataFrame, evaluated: DataFrame, profile: Profile) -> DataFrame:
    """Price questions that ended with no usable, supported figure."""
    return packages.where(is_price_query(F.col("query"), profile)).join(
        shuffled(price_answers(evaluated).select("package_id").distinct()), "package_id",
        "left_anti")


def core_question(packages: DataFrame, evaluated: DataFrame, profile: Profile) -> DataFrame:
    """What each page must answer and whether the evidence lets it.

    ``packages``: package_id, query, intent.  ``evaluated``: package_id, claim_ord,
    claim, category, evidence_status and optionally source_urls.
    """
    policy = profile.price_policy
    required = [i.upper() for i in policy.get("answer_required_intents") or ()]
    asked = is_price_query(F.col("query"), profile) & F.col("intent").isin(*required)
    urls = (F.col("source_urls") if "source_urls" in evaluated.columns
            else text.string_array([]))
    answers = price_answers(evaluated)
    minimum = int(policy.get("observed_range_min_sources") or 2)
    ranges = observed_range(
        answers.withColumnRenamed("claim_ord", "obs_ord"), minimum
    ).select("package_id", F.struct(
        "low", "high", *COMPARABLE, "observation_count", "wording").alias("price_range"))
    top = (
        answers.groupBy("package_id").agg(F.array_sort(F.collect_list(F.struct(
            "claim_ord", "claim", "category", "price",
            prices.qualification_label(F.col("category")).alias("qualification"),
            urls.alias("source_urls")))).alias("answers"))
    )
    joined = packages.join(top, "package_id", "left").join(ranges, "package_id", "left")
    status = (F.when(~asked, "NOT_APPLICABLE")
              .when(F.col("answers").isNull(), "CORE_QUESTION_UNRESOLVED")
              .otherwise("EVIDENCE_AVAILABLE"))
    available = F.col("status") == "EVIDENCE_AVAILABLE"
    return joined.withColumn("status", status).select(
        *packages.columns,
        F.when(asked, F.trim("query")).alias("core_question"),
        F.col("status").alias("core_answer_status"),
        available.alias("must_answer_directly"),
        F.when(available, F.col("answers")).alias("answers"),
        F.when(available, F.col("price_range")).alias("observed_range"),
        F.when(F.col("status") == "CORE_QUESTION_UNRESOLVED", F.lit(
            "The core question of this page is unresolved: no price claim reached "
            "SUPPORTED with a stated basis. The page must say so plainly rather than "
            "imply an answer the research did not produce.")).alias("note"))
