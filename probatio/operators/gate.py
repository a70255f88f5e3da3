"""Query profiles and the relevance gate.

Two shapes of the same gate:

* :func:`gate_sources` — every source belongs to a package and is judged against
  that package's query.  One join on ``package_id``; every row is kept, labelled.
* :func:`gate_corpus` — every query against every document.  A document that
  shares no topic token with a query is IRRELEVANT by definition, so an inverted
  index on topic tokens finds all the others.  Only (query, token) hits are ever
  shuffled, never the documents and never a query × document product.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from probatio import fixed_values as fv
from probatio.functions import text
from probatio.profiles import Profile
from probatio.session import cut_lineage


def query_profile(queries: DataFrame, profile: Profile) -> DataFrame:
    """Split query tokens into topic, modifier and market tokens."""
    modifiers = text.string_array(profile.modifier_tokens)
    markets = text.string_array(profile.market_tokens)
    return (
        queries.withColumn("query_tokens", text.gate_tokens(F.col("query")))
        .withColumn("topic_tokens", F.array_sort(F.array_except(
            F.array_except("query_tokens", modifiers), markets)))
        .withColumn("modifier_tokens",
                    F.array_sort(F.array_intersect("query_tokens", modifiers)))
        .withColumn("market_tokens",
                    F.array_sort(F.array_intersect("query_tokens", markets)))
        .drop("query_tokens")
    )


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def _score(n_topic, n_modifier, in_title, in_body, in_domain, modifier_hits) -> Column:
    title, body = _share(in_title, n_topic), _share(in_body, n_topic)
    best = F.greatest(fv.TITLE_WEIGHT * title + fv.BODY_WEIGHT * body,
                      fv.BODY_ONLY_WEIGHT * body,
                      fv.DOMAIN_WEIGHT * _share(in_domain, n_topic))
    bonus = fv.MODIFIER_WEIGHT * _share(modifier_hits, n_modifier)
    return F.least(F.lit(1.0), best + bonus)


def _status(score: Column) -> Column:
    return (F.when(score >= fv.RELEVANT_AT, "RELEVANT")
            .when(score >= fv.LOW_RELEVANCE_AT, "LOW_RELEVANCE")
            .otherwise("IRRELEVANT"))


def _host_words(url: Column) -> Column:
    return F.coalesce(F.replace(text.host(url), F.lit("."), F.lit(" ")), F.lit(""))


def gate_sources(sources: DataFrame, profiles: DataFrame) -> DataFrame:
    """Label every source of every package.

    ``sources``: package_id, title, body, url, …  ``profiles``: the output of
    :func:`query_profile`, one row per package.
    """
    wanted = profiles.select("package_id", "topic_tokens", "modifier_tokens")
    # Tokens are read before the join, so the wide text columns of a source that
    # needs no text downstream can be dropped on the scan side.
    tokenised = text.once(
        sources,
        _title=text.gate_tokens(F.col("title")), _body=text.gate_tokens(F.col("body")),
        _domain=text.gate_tokens(_host_words(F.col("url"))))
    joined = tokenised.join(wanted, "package_id", "left").withColumn(
        "_all", F.array_union("_title", "_body"))
    matched = text.once(
        joined,
        topic_matched=F.array_sort(F.array_intersect(
            "topic_tokens", F.array_union("_all", "_domain"))),
        modifier_matched=F.array_sort(F.array_intersect("modifier_tokens", "_all")))
    hits = text.once(matched, _score=_score(
        F.size("topic_tokens"), F.size("modifier_tokens"),
        F.size(F.array_intersect("topic_tokens", "_title")),
        F.size(F.array_intersect("topic_tokens", "_body")),
        F.size(F.array_intersect("topic_tokens", "_domain")),
        F.size("modifier_matched")))
    no_topic = F.coalesce(F.size("topic_tokens"), F.lit(0)) == 0
    unmatched = F.size("topic_matched") == 0
    labelled = hits.withColumn(
        "relevance_status",
        F.when(no_topic, "UNKNOWN").when(unmatched, "IRRELEVANT")
        .otherwise(_status(F.col("_score")))
    ).withColumn("relevance_score",
                 F.when(no_topic | unmatched, F.lit(0.0)).otherwise(F.col("_score")))
    return labelled.withColumn("relevance_reason", _reason()).drop(
        "_title", "_body", "_domain", "_all", "_score")


def _reason() -> Column:
    shown = F.format_number("relevance_score", 2)
    others = F.concat_ws(", ", "modifier_matched")
    return (
        F.when(F.col("relevance_status") == "UNKNOWN",
               "Query carries no topical tokens; relevance cannot be assessed "
               "deterministically.")
        .when(F.size("topic_matched") == 0, F.concat(
            F.lit("No topical overlap with the query. The query is about "),
            F.concat_ws(", ", "topic_tokens"), F.lit("; this source matched only "),
            F.when(others == "", "nothing").otherwise(others), F.lit(".")))
        .when(F.col("relevance_status") == "RELEVANT", F.format_string(
            "Covers %d/%d topic tokens (score %s).", F.size("topic_matched"),
            F.size("topic_tokens"), shown))
        .when(F.col("relevance_status") == "LOW_RELEVANCE", F.format_string(
            f"Partial topical match, score %s below the {fv.RELEVANT_AT:.2f} threshold.",
            shown))
        .otherwise(F.format_string(
            f"Topical match too weak, score %s below the {fv.LOW_RELEVANCE_AT:.2f} "
            f"floor.", shown))
    )


def _tokens_of(documents: DataFrame) -> DataFrame:
    """One row per (document, place, token); place is t(itle), b(ody) or d(omain)."""
    def placed(place: str, value: Column) -> Column:
        return F.transform(text.gate_tokens(value), lambda token: F.struct(
            F.lit(place).alias("place"), token.alias("token")))

    return documents.select("doc_id", F.inline(F.concat(
        placed("t", F.col("title")), placed("b", F.col("body")),
        placed("d", _host_words(F.col("url"))))))


def gate_corpus(profiles: DataFrame, documents: DataFrame) -> DataFrame:
    """Every (query, document) pair that shares a topic token, scored.

    Pairs that are absent are IRRELEVANT with score 0 (or UNKNOWN when the query
    has no topic); :func:`relevance_summary` counts them without producing them.
    The tokens of the queries are written first, so Spark knows their size: it broadcasts
    them when that is small, and then a token that no query has is dropped where it is read;
    otherwise the join shuffles on the token.
    """
    wanted = cut_lineage(profiles.select(
        "package_id", F.explode(F.concat(
            F.transform("topic_tokens", lambda t: F.struct(
                t.alias("token"), F.lit(True).alias("is_topic"))),
            F.transform("modifier_tokens", lambda t: F.struct(
                t.alias("token"), F.lit(False).alias("is_topic"))))).alias("w")
    ).select("package_id", "w.token", "w.is_topic"))
    sizes = profiles.where(F.size("topic_tokens") > 0).select(
        "package_id", F.size("topic_tokens").alias("n_topic"),
        F.size("modifier_tokens").alias("n_modifier"))

    topic, place = F.col("is_topic"), F.col("place")

    def distinct(test: Column) -> Column:
        return F.size(F.collect_set(F.when(test, F.col("token"))))  # of one query's tokens

    matched = (
        _tokens_of(documents).join(wanted, "token")
        .groupBy("package_id", "doc_id")
        .agg(distinct(topic).alias("topic_hits"),
             F.count_if(topic & (place == "t")).alias("title_hits"),
             F.count_if(topic & (place == "b")).alias("body_hits"),
             F.count_if(topic & (place == "d")).alias("domain_hits"),
             distinct(~topic & (place != "d")).alias("modifier_hits"))
        .where("topic_hits > 0")
    )
    score = _score(F.col("n_topic"), F.col("n_modifier"), F.col("title_hits"),
                   F.col("body_hits"), F.col("domain_hits"), F.col("modifier_hits"))
    return (
        matched.join(sizes, "package_id")
        .withColumn("relevance_score", score)
        .withColumn("relevance_status", _status(F.col("relevance_score")))
        .select("package_id", "doc_id", "n_topic", "topic_hits", "title_hits",
                "body_hits", "domain_hits", "modifier_hits", "relevance_score",
                "relevance_status")
    )


def relevance_summary(decisions: DataFrame) -> DataFrame:
    """Evaluated, eligible and rejected sources per package, by status."""
    def count(status: str) -> Column:
        return F.count_if(F.col("relevance_status") == status)

    return decisions.groupBy("package_id").agg(
        F.count("*").alias("evaluated"),
        count("RELEVANT").alias("eligible"),
        F.count_if(F.col("relevance_status") != "RELEVANT").alias("rejected"),
        count("LOW_RELEVANCE").alias("low_relevance"),
        count("IRRELEVANT").alias("irrelevant"),
        count("UNKNOWN").alias("unknown"),
        F.avg("relevance_score").alias("mean_relevance"))


def corpus_summary(profiles: DataFrame, documents: DataFrame) -> DataFrame:
    """The summary of an open-corpus run, absent pairs counted by subtraction."""
    corpus_size = documents.agg(F.count("*")).scalar()
    found = gate_corpus(profiles, documents).groupBy("package_id").agg(
        F.count("*").alias("candidates"),
        F.count_if(F.col("relevance_status") == "RELEVANT").alias("eligible"),
        F.count_if(F.col("relevance_status") == "LOW_RELEVANCE").alias("low_relevance"),
        F.count_if(F.col("relevance_status") == "IRRELEVANT").alias("weak"),
        F.sum("relevance_score").alias("score_sum"))
    has_topic = F.size("topic_tokens") > 0

    def zero(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(0))

    return (
        profiles.select("package_id", has_topic.alias("has_topic"))
        .join(found, "package_id", "left")
        .withColumn("evaluated", corpus_size)
        .select(
            "package_id", "evaluated", zero("eligible").alias("eligible"),
            (F.col("evaluated") - zero("eligible")).alias("rejected"),
            zero("low_relevance").alias("low_relevance"),
            F.when(F.col("has_topic"), zero("weak")).otherwise(0).alias("weak_match"),
            F.when(F.col("has_topic"), F.col("evaluated") - zero("candidates"))
            .otherwise(0).alias("no_topic_overlap"),
            F.when(F.col("has_topic"), 0).otherwise(F.col("evaluated"))
            .alias("unknown"),
            (F.coalesce(F.col("score_sum"), F.lit(0.0)) / F.col("evaluated"))
            .alias("mean_relevance"))
    )


def gate_claims(claims: DataFrame, decisions: DataFrame, profiles: DataFrame) -> DataFrame:
    """Relevance of each claim; a claim never outranks its source.

    ``decisions``: package_id, source_ref, relevance_status of the source.
    """
    parents = decisions.select("package_id", "source_ref",
                               F.col("relevance_status").alias("source_status"))
    joined = claims.join(parents, ["package_id", "source_ref"], "left")
    shaped = joined.withColumns({
        "title": F.lit(None).cast("string"), "body": F.col("claim"),
        "url": F.lit(None).cast("string")})
    scored = gate_sources(shaped, profiles).drop("title", "body", "url")
    rejected = F.col("source_status") == "IRRELEVANT"
    clamped = ((F.col("source_status") == "LOW_RELEVANCE")
               & (F.col("relevance_status") == "RELEVANT"))
    return scored.withColumns({
        "relevance_reason": F.when(rejected, "Parent source was rejected as irrelevant.")
        .when(clamped, "Claim reads on-topic but its source is only weakly relevant; "
                       "clamped to the source's status.")
        .otherwise(F.col("relevance_reason")),
        "relevance_score": F.when(rejected, 0.0).otherwise(F.col("relevance_score")),
        "relevance_status": F.when(rejected, "IRRELEVANT")
        .when(clamped, "LOW_RELEVANCE").otherwise(F.col("relevance_status")),
    })


def review_ambiguous(decisions: DataFrame,
                     review: Callable[[pd.DataFrame], pd.DataFrame]) -> DataFrame:
    """Let a caller's batch function settle the ambiguous middle.

    ``review`` gets LOW_RELEVANCE rows and returns ``verdict`` (RELEVANT,
    IRRELEVANT or anything else) and ``verdict_reason``.  Only LOW_RELEVANCE rows
    can move, and an error or an odd answer changes nothing.
    """
    schema = decisions.withColumn("relevance_stage", F.lit("")).schema

    def apply(batches):
        for batch in batches:
            batch = batch.assign(relevance_stage="deterministic")
            middle = batch["relevance_status"] == "LOW_RELEVANCE"
            if middle.any():
                try:
                    answer = review(batch[middle].copy())
                    verdict = answer["verdict"].reindex(batch.index)
                    why = answer["verdict_reason"].reindex(batch.index)
                except Exception:  # noqa: BLE001 - an optional review never breaks a job
                    verdict = why = None
                if verdict is not None:
                    up = middle & (verdict == "RELEVANT")
                    down = middle & (verdict == "IRRELEVANT")
                    score = batch["relevance_score"]
                    batch.loc[up, "relevance_score"] = score[up].clip(
                        lower=fv.REVIEW_PROMOTED_FLOOR)
                    batch.loc[down, "relevance_score"] = score[down].clip(
                        upper=fv.REVIEW_DEMOTED_CEILING)
                    for rows, status in ((up, "RELEVANT"), (down, "IRRELEVANT")):
                        batch.loc[rows, "relevance_status"] = status
                        batch.loc[rows, "relevance_stage"] = "semantic"
                        batch.loc[rows, "relevance_reason"] = (
                            "Semantic review: " + why[rows].astype(str))
            yield batch[[f.name for f in schema]]

    return decisions.mapInPandas(apply, schema)
