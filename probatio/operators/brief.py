"""Content briefs: facts, sources, cautions, outline and what is missing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from probatio import fixed_values as fv
from probatio.functions import text
from probatio.operators import classify
from probatio.profiles import Profile


def required_facts(evaluated: DataFrame, core: DataFrame) -> DataFrame:
    """Facts of each package in order; answers to the core question lead."""
    order = Window.partitionBy("package_id").orderBy("claim_ord")
    facts = evaluated.where("evidence_status = 'SUPPORTED'").withColumn(
        "_n", F.row_number().over(order))
    stated = facts.select(
        "package_id", F.lit(1).alias("_group"), F.col("_n").alias("_ord"),
        F.col("claim").alias("fact"), "source_ref", "category")
    leading = core.where("must_answer_directly").select(
        "package_id", F.posexplode("answers").alias("_ord", "a")
    ).select("package_id", F.lit(0).alias("_group"), "_ord", F.col("a.claim").alias("fact"),
             F.lit(None).cast("string").alias("source_ref"),
             F.col("a.category").alias("category"))
    both = leading.unionByName(stated)
    place = F.row_number().over(
        Window.partitionBy("package_id").orderBy("_group", "_ord"))
    return both.withColumn("fact_ord", place).select("package_id", "fact_ord", "fact", "source_ref", "category")


def required_sources(facts: DataFrame, sources: DataFrame) -> DataFrame:
    used = facts.where("source_ref is not null").select("package_id", "source_ref") \
        .distinct()
    return sources.where("url is not null").join(
        used, ["package_id", "source_ref"], "left_semi")


def cautionary_topics(packages: DataFrame, evaluated: DataFrame,
                      profile: Profile) -> DataFrame:
    """Restricted topics and whether a supported claim carries them."""
    topics = F.array(*[F.lit(t) for t in profile.restricted_claims]) \
        if profile.restricted_claims else text.string_array([])
    said = evaluated.where("evidence_status = 'SUPPORTED'").withColumn(
        "_claim", F.lower("claim")).select("package_id", F.explode(F.filter(
            topics, lambda t: F.col("_claim").contains(F.lower(t)))).alias("topic"))
    carried = said.distinct().withColumn("_carried", F.lit(True))
    return packages.select("package_id", F.explode(topics).alias("topic")).join(
        carried, ["package_id", "topic"], "left"
    ).select("package_id", "topic",
             F.lit("may_not_be_asserted_without_dated_source").alias("rule"),
             F.col("_carried").isNotNull().alias("has_supported_evidence"))


def outline(content_type: Column, questions: Column) -> Column:
    """Section headings: the type's own, observed themes before the last one."""
    plans = F.create_map(*[x for kind, headings in fv.OUTLINES.items()
                           for x in (F.lit(kind), text.string_array(headings))])
    own = F.coalesce(plans[content_type], text.string_array(fv.OUTLINES["ARTICLE"]))
    themes = F.coalesce(questions, text.string_array([]))
    body = F.slice(own, F.lit(1), F.size(own) - 1)
    return F.concat(body, themes, F.array(F.element_at(own, -1)))


def briefs(packages: DataFrame, core: DataFrame, questions: DataFrame,
           missing: DataFrame, profile: Profile) -> DataFrame:
    """One brief per package; facts, sources and cautions stay child tables.

    ``packages``: package_id, query.  ``core``: the core-question job, with intent.
    ``questions``: package_id, questions (array).  ``missing``: package_id, notes
    (array), partial_observation.
    """
    query = F.trim("query")
    joined = (
        packages.select("package_id", "query")
        .join(core.drop("query"), "package_id")
        .join(questions, "package_id", "left")
        .join(missing, "package_id", "left")
        .withColumn("_norm", text.normalise(F.col("query")))
    )
    kind = classify.content_type(F.col("_norm"), F.col("intent"), profile)
    notes = F.concat(
        F.when(F.col("note").isNotNull(), F.array("note")).otherwise(
            text.string_array([])),
        F.coalesce("notes", text.string_array([])),
        F.when(F.col("partial_observation"), F.array(F.lit(
            "Research was partial: at least one source could not be observed. Coverage "
            "gaps must not be presented as absence of information."))).otherwise(
                text.string_array([])))
    return joined.withColumn("content_type", kind).select(
        "package_id", F.col("query").alias("primary_query"),
        F.col("intent").alias("search_intent"), "content_type", "core_question",
        "core_answer_status", "must_answer_directly", "answers", "observed_range",
        F.when(query == "", "Untitled").otherwise(F.concat(
            F.upper(F.left(query, F.lit(1))), F.substring(query, F.lit(2), F.length(query))))
        .alias("recommended_title"),
        text.slug(F.col("query")).alias("recommended_slug"),
        outline(F.col("content_type"), F.col("questions")).alias("outline"),
        F.coalesce("questions", text.string_array([])).alias("key_questions"),
        classify.call_to_action(F.col("intent"), profile).alias("cta_strategy"),
        F.lit(profile.target_audience).alias("target_audience"),
        F.lit(profile.business_objective).alias("objective"),
        notes.alias("missing_information"))
