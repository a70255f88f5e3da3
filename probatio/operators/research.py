"""Research runs: outcomes, reuse, provider unions and keyword scope."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from probatio import fixed_values as fv
from probatio.functions import keys, text
from probatio.operators import gate
from probatio.session import cut_lineage, shuffled


def _state_in(states) -> Column:
    return F.col("state").isin(*states)


def outcome_summary(outcomes: DataFrame) -> DataFrame:
    """What each run could observe; partial means "nothing found" proves nothing.

    ``outcomes``: run_id, source_type, state, item_count.
    """
    return outcomes.groupBy("run_id").agg(
        F.count_if(_state_in(fv.STATES_DEGRADED)).alias("degraded"),
        F.count_if(_state_in([fv.STATE_UNCONFIGURED])).alias("unconfigured"),
        F.count_if(_state_in(fv.STATES_CLEAN_EMPTY)).alias("clean_empty"),
        F.count_if(F.col("item_count") > 0).alias("with_items"),
        F.count_if(_state_in(fv.STATES_WITH_ITEMS) & (F.col("item_count") == 0))
        .alias("ok_but_empty"),
        F.bool_or(_state_in(fv.STATES_DEGRADED)).alias("is_partial"))


def union_results(*results: DataFrame) -> DataFrame:
    """Provider results in one shape; columns a provider lacks become NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), results)


def affected_packages(packages: DataFrame, official: DataFrame) -> DataFrame:
    """Packages that gained an accepted official page and must be rebuilt."""
    gained = official.where("accepted").select("package_id").distinct()
    return packages.join(shuffled(gained), "package_id", "left_semi").withColumns({
        "supersedes": F.col("version"), "version": F.col("version") + 1})


def fold_official(official: DataFrame) -> DataFrame:
    """Accepted official pages as ordinary sources, re-gated like any other."""
    return official.where("accepted").select(
        "package_id", "source_ref", "source_ord", "title", "body", "url",
        F.lit("official").alias("source_type"), "published_at")


def official_pass(packages: DataFrame, stored: DataFrame, sources: DataFrame,
                  official: DataFrame, profiles: DataFrame,
                  evaluate: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """Verdicts after official pages came in: changed packages anew, the others as stored.

    ``packages``: package_id, version.  ``stored``: verdicts of the stored version.
    ``sources``: what that version rests on.  ``official``: pages with ``accepted``.
    ``profiles``: query profiles.  ``evaluate(sources, packages)`` gives verdicts.

    A package that gained an accepted page gets a version of its own that supersedes the
    stored one.  Its official pages pass the relevance gate first: being official does not
    put a page on topic.  Only sources of changed packages are read again.
    """
    changed = cut_lineage(affected_packages(packages, official))
    mine = changed.select("package_id")
    folded = fold_official(official)
    on_topic = gate.gate_sources(folded, shuffled(profiles)).where(
        "relevance_status = 'RELEVANT'").select(*folded.columns)
    merged = union_results(sources.join(shuffled(mine), "package_id", "left_semi"), on_topic)
    rebuilt = evaluate(merged, mine).join(
        shuffled(changed.select("package_id", "version", "supersedes")), "package_id")
    kept = stored.join(shuffled(mine), "package_id", "left_anti").join(
        shuffled(packages.select("package_id", "version")), "package_id").withColumn(
            "supersedes", F.lit(None).cast("int"))
    return rebuilt.unionByName(kept)


def due_runs(requests: DataFrame, runs: DataFrame) -> DataFrame:
    """Requests that no run of the same key and day has served, each once.

    ``requests``: run_id, query, market, language, requested_at; ``runs``:
    idempotency_key, status.  A failed run does not count as served.
    """
    day = F.date_format(F.col("requested_at").cast("timestamp"), "yyyy-MM-dd")
    keyed = requests.withColumn("idempotency_key", keys.run_key(
        text.normalise(F.col("query")), F.col("market"), F.col("language"), day))
    served = runs.where(F.col("status").isin(*fv.RUN_REUSABLE)).select("idempotency_key").distinct()
    first = keyed.groupBy("idempotency_key").agg(
        F.min_by(F.struct(*requests.columns), F.struct("requested_at", "run_id")).alias("r"),
        F.count("*").alias("requests"))
    return first.join(served, "idempotency_key", "left_anti").select(
        "idempotency_key", "r.*", "requests")


def unseeded(keywords: DataFrame, seeded: DataFrame) -> DataFrame:
    """Keywords whose scope (normalised query, language, market) is not seeded yet."""
    scope = ["normalized_query", "language", "market"]
    fresh = keywords.withColumn("normalized_query", text.normalise(F.col("query")))
    known = seeded.withColumn("normalized_query", text.normalise(F.col("query")))
    return fresh.dropDuplicates(scope).join(known.select(*scope), scope, "left_anti")


def with_existing_title(drafts: DataFrame, published: DataFrame) -> DataFrame:
    """Drafts whose normalised title another draft already uses."""
    titles = published.select(text.normalise(F.col("title")).alias("_title")).distinct()
    return drafts.withColumn("_title", text.normalise(F.col("title"))).join(
        titles, "_title", "left_semi").drop("_title")


def ordered_distinct(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """First row of each key; the rest of the order is kept in ``order``."""
    others = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(
        F.min_by(F.struct(*others), order).alias("_first")).select(*keys, "_first.*")
