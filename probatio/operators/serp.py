"""Result-page analysis and the opportunity score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from probatio import fixed_values as fv
from probatio.functions import text
from probatio.functions.rounding import round_tenth
from probatio.profiles import Profile


def page_shapes(results: DataFrame) -> DataFrame:
    """One boolean per page shape, read from the title; plus bare host and local TLD."""
    shaped = text.once(
        results, _title=text.normalise(F.coalesce("title", F.lit(""))),
        host=text.bare_host(F.col("url")))
    local = F.lit(False)
    for tld in fv.LOCAL_TLDS:
        local = local | F.col("host").endswith(tld)
    return text.once(
        shaped, local_domain=F.coalesce(local, F.lit(False)),
        **{name: text.contains_any(F.col("_title"), hints)
           for name, hints in fv.PAGE_SHAPE_HINTS.items()}).drop("_title")


def analyse(snapshots: DataFrame, results: DataFrame, questions: DataFrame,
            features: DataFrame) -> DataFrame:
    """Structure of each result page.

    ``snapshots``: snapshot_id.  ``results``: snapshot_id, result_ord, url, title.
    ``questions``: snapshot_id, question_ord, kind, text.  ``features``:
    snapshot_id, item_type.  No competitor text leaves this job.
    """
    shaped = page_shapes(results)
    counts = shaped.groupBy("snapshot_id").agg(
        F.count("*").alias("organic_count"),
        *[F.count_if(name).alias(name) for name in fv.PAGE_SHAPE_HINTS],
        F.count_if("local_domain").alias("local_domain"))
    hosts = shaped.where("host is not null").groupBy("snapshot_id", "host").agg(
        F.count("*").alias("n"), F.min("result_ord").alias("_first"))
    distinct = hosts.groupBy("snapshot_id").agg(F.count("*").alias("distinct_domains"))
    place = F.row_number().over(
        Window.partitionBy("snapshot_id").orderBy(F.desc("n"), "_first"))
    leading = hosts.withColumn("place", place).groupBy("snapshot_id").agg(F.array_sort(F.collect_list(F.struct(
            "place", F.col("host").alias("domain"), F.col("n").alias("count")))
        ).alias("_top"))
    asked = questions.groupBy("snapshot_id").agg(
        _texts("PAA").alias("questions"), _texts("RELATED").alias("related_searches"))
    seen = features.groupBy("snapshot_id").agg(
        F.array_sort(F.collect_set("item_type")).alias("serp_features"))
    joined = snapshots.select("snapshot_id")
    for part in (counts, distinct, leading, asked, seen):
        joined = joined.join(part, "snapshot_id", "left")
    zero = ["organic_count", *fv.PAGE_SHAPE_HINTS, "local_domain", "distinct_domains"]
    lists = ["questions", "related_searches", "serp_features"]
    filled = joined.withColumns({
        **{c: F.coalesce(c, F.lit(0)) for c in zero},
        **{c: F.coalesce(c, text.string_array([])) for c in lists},
    })
    return _observe(filled)


def _texts(kind: str) -> Column:
    rows = F.collect_list(F.when(F.col("kind") == kind, F.struct("question_ord", "text")))
    return F.transform(F.array_sort(rows), lambda q: q["text"])


def _observe(rows: DataFrame) -> DataFrame:
    total = F.col("organic_count")
    commercial = F.col("price_focused") + F.col("listing") + F.col("comparison")
    informational = F.col("guide")
    top = F.coalesce("_top", F.array().cast(
        "array<struct<place:int,domain:string,count:bigint>>"))
    repeated = F.transform(
        F.filter(top, lambda d: d["count"] > 1), lambda d: d["domain"])

    def line(pattern: str, *columns: Column) -> Column:
        return F.format_string(pattern, *columns)

    def only(test: Column, column: Column) -> Column:
        return F.when(test, column)

    named = rows.withColumns({
        "commercial_signals": commercial,
        "dominant_framing": F.when(commercial > informational, "commercial")
        .when(informational > commercial, "informational").otherwise("mixed"),
        "top_domains": F.transform(top, lambda d: F.struct(d["domain"], d["count"])),
        "repeated_domains": repeated,
    })
    observations = F.array_compact(F.array(
        line("%d organic results analysed; %d distinct domains.", total,
             F.col("distinct_domains")),
        line("Dominant page framing: %s (%d commercial vs %d informational signals).",
             F.col("dominant_framing"), F.col("commercial_signals"), informational),
        only(F.col("calculator") > 0, line(
            "%d of %d results present a calculator or simulator — searchers expect an "
            "interactive estimate.", F.col("calculator"), total)),
        only(F.col("comparison") > 0, line("%d of %d results are comparison pages.",
                                           F.col("comparison"), total)),
        only(F.col("price_focused") > 0, line(
            "%d of %d results lead with price framing.", F.col("price_focused"), total)),
        F.when(F.col("local_domain") > 0, line(
            "%d of %d results sit on .be domains — the SERP is locally held.",
            F.col("local_domain"), total))
        .otherwise("No .be domain appears in the organic results, which is unusual for "
                   "a Belgian query and may indicate a local content gap."),
        only(F.size("repeated_domains") > 0, F.concat(
            F.lit("Domains appearing more than once: "),
            F.concat_ws(", ", "repeated_domains"), F.lit("."))),
        only(F.size("serp_features") > 0, F.concat(
            F.lit("SERP features present: "), F.concat_ws(", ", "serp_features"),
            F.lit("."))),
    ))
    gaps = F.array_compact(F.array(*[
        only(F.col(column) == 0, F.lit(message)) for column, message in (
            ("calculator", "No calculator or simulator appears in the top results."),
            ("comparison", "No comparison page appears in the top results."),
            ("local_domain", "No Belgian-domain result appears in the top results."),
            ("guide", "No explanatory guide appears in the top results."))]))
    empty = total == 0
    return named.withColumns({
        "observations": F.when(empty, F.array(F.lit(
            "The SERP returned no organic results to analyse."))).otherwise(observations),
        "content_gap": F.when(empty, text.string_array([])).otherwise(gaps),
        "dominant_framing": F.when(~empty, F.col("dominant_framing")),
    }).drop("_top")


def opportunity_score(keywords: DataFrame, profile: Profile) -> DataFrame:
    """Weighted mean over the known components only.

    ``keywords``: intent, topic_alignment, organic_count, distinct_domains,
    feature_count, gap_count, search_volume, competition_index, eligible_count.
    A NULL input is unknown: it is left out and named, never scored as zero.
    """
    served = sorted({i for o in profile.cta_options for i in o.get("intents") or ()})
    organic = F.col("organic_count")
    has_serp = F.coalesce(organic, F.lit(0)) > 0
    intents = F.create_map(*[F.lit(x) for kv in fv.INTENT_SCORES.items() for x in kv])
    spread = F.col("distinct_domains") / organic * 100 - F.least(
        F.lit(30.0), 6.0 * F.col("feature_count"))
    values = {
        "commercial_intent": F.coalesce(intents[F.col("intent")], F.lit(40.0)),
        "business_relevance": round_tenth(F.col("topic_alignment") * 100),
        "conversion_potential":
            F.when(F.col("intent").isin(*served), 90.0).otherwise(40.0)
            if profile.cta_options else F.lit(None).cast("double"),
        "content_gap": F.when(has_serp, F.least(F.lit(100.0), 25.0 * F.col("gap_count"))),
        "serp_opportunity": F.when(has_serp, round_tenth(
            F.greatest(F.lit(0.0), F.least(F.lit(100.0), spread)))),
        "search_demand": F.when(F.col("search_volume").isNotNull(), round_tenth(
            F.least(F.lit(100.0), 20.0 * F.log10(
                F.greatest("search_volume", F.lit(1.0)) + 1)))),
        "competition": F.when(F.col("competition_index").isNotNull(), round_tenth(
            F.greatest(F.lit(0.0), 100.0 - F.col("competition_index")))),
    }
    scored = keywords.withColumns(values)
    total = known = F.lit(0.0)
    for name, weight in fv.SCORE_WEIGHTS.items():
        present = F.col(name).isNotNull()
        total = total + F.when(present, F.col(name) * weight).otherwise(0.0)
        known = known + F.when(present, F.lit(weight)).otherwise(0.0)
    everything = F.lit(0.0)
    for weight in fv.SCORE_WEIGHTS.values():
        everything = everything + F.lit(weight)
    missing = F.array_compact(F.array(
        *[F.when(F.col(n).isNull(), F.lit(n)) for n in fv.SCORE_WEIGHTS],
        F.when(F.col("eligible_count") == 0, "eligible_evidence")))
    return scored.withColumn("_known", known).withColumns({
        "overall_score": F.when(F.col("_known") > 0,
                                F.bround(total / F.col("_known"), 0).cast("int")),
        "confidence": F.col("_known") / everything,
        "missing_inputs": missing,
    }).drop("_known")


def first_metric(metrics: DataFrame, metric_type: str) -> DataFrame:
    """First metric of a type that carries a value, per keyword."""
    usable = F.col("value").isNotNull() | F.col("value_text").isNotNull()
    return metrics.where((F.col("metric_type") == metric_type) & usable) \
        .groupBy("keyword").agg(
            F.min_by(F.struct("value", "value_text"), "metric_ord").alias("m")) \
        .select("keyword", F.col("m.value").alias("value"),
                F.col("m.value_text").alias("value_text"))
