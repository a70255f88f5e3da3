"""Site events: validation, funnel steps and counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from probatio import fixed_values as fv


def validate_events(events: DataFrame) -> DataFrame:
    """Refuse unknown types; the detail map of the others stays as it is.

    ``events``: event_type, detail (map<string,string>).
    """
    known = F.coalesce(F.col("event_type").isin(*fv.EVENT_TYPES), F.lit(False))
    return events.withColumn("accepted", known).withColumn(
        "rejection_reason", F.when(~known, "UNKNOWN_EVENT_TYPE")).withColumn(
            "detail", F.when(known, F.col("detail")))


def step(event_type: Column) -> Column:
    """Position of an event in the funnel, from 1."""
    return F.coalesce(*[F.when(event_type == name, i + 1)
                        for i, name in enumerate(fv.EVENT_TYPES)])


def session_funnel(events: DataFrame) -> DataFrame:
    """Furthest step of each session and whether it was abandoned there.

    ``events``: session_id, event_type, ts.
    """
    return events.withColumn("_step", step(F.col("event_type"))).where(
        "_step is not null").groupBy("session_id").agg(
            F.max("_step").alias("furthest_step"),
            F.count("*").alias("events"),
            F.min("ts").alias("started_at"), F.max("ts").alias("ended_at")
    ).withColumn("furthest", F.get(
        F.array(*[F.lit(n) for n in fv.EVENT_TYPES]), F.col("furthest_step") - 1)
    ).withColumn("abandoned", F.col("furthest_step") < len(fv.EVENT_TYPES))


def gap_sessions(events: DataFrame, gap_seconds: int = 1800) -> DataFrame:
    """Sessions of each session_id: a pause longer than ``gap_seconds`` starts another, as in
    ``session_window``.

    ``events``: session_id, event_type, ts; others than funnel steps are ignored.  Events
    are first counted per slice of time as long as the gap, within which no pause can lie.
    What is then put in order are slices, of which a session_id has as many as its time
    holds, however many its events are.
    """
    gap = gap_seconds * 1_000_000
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    slices = events.select(
        "session_id", step(F.col("event_type")).alias("_step"), micros.alias("_at")
    ).where("_step is not null and _at is not null").groupBy(
        "session_id", F.floor(F.col("_at") / gap).alias("_slice")).agg(
        F.min("_at").alias("_from"), F.max("_at").alias("_to"), F.max("_step").alias("_step"),
        F.count("*").alias("events"))
    order = Window.partitionBy("session_id").orderBy("_slice")
    begins = F.coalesce(F.col("_from") - F.lag("_to").over(order) > gap, F.lit(True))
    return (
        slices.withColumn("_begins", begins.cast("int"))
        .withColumn("_n", F.sum("_begins").over(order)).groupBy("session_id", "_n").agg(
            F.timestamp_micros(F.min("_from")).alias("started_at"),
            F.timestamp_micros(F.max("_to") + gap).alias("closed_at"),
            F.max("_step").alias("furthest_step"), F.sum("events").alias("events"))
        .drop("_n")
        .withColumn("abandoned", F.col("furthest_step") < len(fv.EVENT_TYPES)))


def funnel(events: DataFrame, by: list[str]) -> DataFrame:
    """Sessions reaching each step, by any grouping; plus the final conversion rate.

    Two aggregations: per session first, so a step repeated many times in a
    session counts once.
    """
    reached = events.withColumn("_step", step(F.col("event_type"))).where(
        "_step is not null").groupBy(*by, "session_id").agg(F.max("_step").alias("_max"))
    counts = [F.count_if(F.col("_max") >= i + 1).alias(name.lower())
              for i, name in enumerate(fv.EVENT_TYPES)]
    return reached.groupBy(*by).agg(F.count("*").alias("sessions"), *counts).withColumn(
        "conversion_rate", F.col("lead_created") / F.col("sessions"))


def hourly_counts(events: DataFrame, by: list[str]) -> DataFrame:
    """Tumbling one-hour counts; the batch twin of the stream."""
    return events.groupBy(F.window("ts", "1 hour").alias("w"), *by).agg(
        F.count("*").alias("events")).select(
            F.col("w.start").alias("hour"), *by, "events")
