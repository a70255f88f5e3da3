"""Provider spend, call budgets and cached research."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from probatio import fixed_values as fv


def provider_ledger(events: DataFrame) -> DataFrame:
    """Spend per job and provider; cost stays NULL when nothing was priced."""
    priced = F.col("cost_usd").isNotNull()
    return events.groupBy("correlation_id", "provider").agg(
        F.sum("requests").alias("requests"),
        F.coalesce(F.sum("units"), F.lit(0)).alias("units"),
        F.round(F.sum("cost_usd"), 6).alias("cost_usd"),
        F.coalesce(F.bool_or(F.when(priced, F.col("cost_is_actual"))), F.lit(False))
        .alias("cost_is_actual"))


def operation_ledger(events: DataFrame) -> DataFrame:
    return events.groupBy("correlation_id", "provider", "operation").agg(
        F.sum("requests").alias("requests"))


def job_totals(events: DataFrame) -> DataFrame:
    """Totals per job: an unpriced job has unknown spend, not zero."""
    priced = F.col("cost_usd").isNotNull()
    return events.groupBy("correlation_id").agg(
        F.round(F.sum("cost_usd"), 6).alias("total_cost_usd"),
        F.sum("requests").alias("total_requests"),
        F.count_if(priced).alias("priced_events"),
        F.count_if(~priced).alias("unpriced_events"))


def backstop(calls: DataFrame, events: DataFrame) -> DataFrame:
    """Usage with a row of unknown cost for every call that left none."""
    keys = ["correlation_id", "provider", "operation"]
    missing = calls.select(*keys, "duration_ms").dropDuplicates(keys).join(
        events.select(*keys), keys, "left_anti")
    return events.unionByName(missing.withColumns({
        "requests": F.lit(1).cast("bigint"), "units": F.lit(None).cast("bigint"),
        "cost_usd": F.lit(None).cast("double"), "cost_is_actual": F.lit(False),
    }), allowMissingColumns=True)


def enforce_budget(calls: DataFrame, keys: list[str], order: list[str],
                   limit: int = fv.MAX_CALLS_PER_JOB) -> DataFrame:
    """Mark each call allowed or refused under a per-key call limit.

    Only the first ``limit`` calls of a key are ranked (Spark keeps that many per
    task before it shuffles); the last of them is the threshold the other calls
    are compared with, so a key holding most calls is not sorted in one task.
    """
    stamp = F.struct(*order)
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    last = (
        calls.select(*keys, *order).withColumn("_n", place).where(F.col("_n") <= limit)
        .groupBy(*keys).agg(F.max(stamp).alias("_last"))
    )
    return calls.join(last, keys).withColumn("allowed", stamp <= F.col("_last")) \
        .drop("_last")


def ttl(kind: Column) -> Column:
    hours = F.create_map(*[F.lit(x) for kv in fv.CACHE_TTL_HOURS.items() for x in kv])
    return F.make_dt_interval(F.lit(0), hours[kind])


def cached(lookups: DataFrame, snapshots: DataFrame, as_of: Column) -> DataFrame:
    """Latest snapshot per cache key and whether it is still fresh enough to reuse.

    ``lookups``: cache_key, kind.  ``snapshots``: cache_key, snapshot_id,
    retrieved_at.  A key never seen keeps NULLs and ``usable`` false.
    """
    latest = snapshots.groupBy("cache_key").agg(
        F.max_by("snapshot_id", F.struct("retrieved_at", "snapshot_id"))
        .alias("snapshot_id"),
        F.max("retrieved_at").alias("retrieved_at"))
    return lookups.join(latest, "cache_key", "left").withColumn(
        "usable", F.coalesce(as_of - F.col("retrieved_at") < ttl(F.col("kind")),
                             F.lit(False)))
