"""Streaming twins of the event and run rules; ``ordered`` has those that need order.

Every function takes a streaming (or batch) DataFrame and returns one; the caller
chooses the sink.  State is bounded by the watermark.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from probatio import fixed_values as fv
from probatio.operators import funnel
from probatio.session import shared_folder


def with_event_time(events: DataFrame, column: str = "ts",
                    delay: str = "10 minutes") -> DataFrame:
    """Watermarked events; a zone-less timestamp is read as UTC first."""
    return events.withColumn(column, F.col(column).cast("timestamp")) \
        .withWatermark(column, delay)


def hourly_counts(events: DataFrame, by: list[str], delay: str = "10 minutes") -> DataFrame:
    """Tumbling one-hour counts; spend per provider is the same with a sum."""
    return funnel.hourly_counts(with_event_time(events, delay=delay), by)


def hourly_spend(usage: DataFrame, delay: str = "10 minutes") -> DataFrame:
    return with_event_time(usage, delay=delay).groupBy(
        F.window("ts", "1 hour").alias("w"), "provider").agg(
            F.sum("requests").alias("requests"), F.sum("cost_usd").alias("cost_usd")
    ).select(F.col("w.start").alias("hour"), "provider", "requests", "cost_usd")


def funnel_sessions(events: DataFrame, gap: str = "30 minutes",
                    delay: str = "10 minutes") -> DataFrame:
    """Furthest funnel step per session; late events are dropped by the watermark.

    ``events``: session_id, event_type, ts.
    """
    stepped = with_event_time(events, delay=delay).withColumn(
        "_step", funnel.step(F.col("event_type"))).where("_step is not null")
    return stepped.groupBy(F.session_window("ts", gap).alias("w"), "session_id").agg(
        F.max("_step").alias("furthest_step"), F.count("*").alias("events")).select(
            "session_id", F.col("w.start").alias("started_at"),
            F.col("w.end").alias("closed_at"), "furthest_step", "events",
            (F.col("furthest_step") < len(fv.EVENT_TYPES)).alias("abandoned"))


def ingest_once(rows: DataFrame, key: str, delay: str = "1 day") -> DataFrame:
    """First row of each key within the watermark: a run per day, a deposit per id."""
    return with_event_time(rows, delay=delay).dropDuplicatesWithinWatermark([key])


def upsert_once(target: str, key: str, time: str = "ts"):
    """A ``foreachBatch`` writer that stores each (day, key) once, whatever is replayed.

    The target is laid out as day=.../batch=...: the batch id is the manifest.  A batch
    replaces its own folders only, so a batch that failed half way, or comes twice, leaves
    what it would have left at once; and it looks for known keys in the folders of its own
    days only.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        fresh = batch.where(F.col(time).isNotNull()).withColumn(
            "day", F.to_date(time)).groupBy("day", key).agg(F.min(time).alias(time))
        days = [row.day for row in fresh.select("day").distinct().collect()]
        stored = _stored(spark, target)
        if stored is not None:
            known = stored.where(F.col("day").isin(days) & (F.col("batch") != batch_id))
            fresh = fresh.join(known.select("day", key), ["day", key], "left_anti")
        fresh.withColumn("batch", F.lit(batch_id).cast("bigint")).write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic").partitionBy("day", "batch").parquet(target)

    return write


def _stored(spark: SparkSession, target: str) -> DataFrame | None:
    try:
        return spark.read.parquet(target)
    except AnalysisException as problem:  # the first batch finds no target, or an empty one
        if problem.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def table_stream(spark: SparkSession, path: str) -> DataFrame:
    """A stored table, a file or a folder of files, as a stream that reads every row once.

    A plain path must be a folder for Spark; as a pattern that matches it alone it may be
    either.
    """
    folder, _, name = path.rstrip("/").rpartition("/")
    only = f"{folder}/[{name[0]}]{name[1:]}"
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(only)


def _folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/probatio/stream-{uuid.uuid4().hex}"


def run_once(stream: DataFrame) -> DataFrame:
    """Run a stream over all that is there and return its output as a table."""
    spark, folder = stream.sparkSession, _folder(stream.sparkSession)
    query = (stream.writeStream.format("parquet").outputMode("append")
             .option("checkpointLocation", f"{folder}/state").option("path", f"{folder}/rows")
             .trigger(availableNow=True).start())
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")


def store_once(stream: DataFrame, key: str, time: str = "ts") -> DataFrame:
    """Run a stream into ``upsert_once`` and return what the target holds."""
    spark, folder = stream.sparkSession, _folder(stream.sparkSession)
    query = (stream.writeStream.foreachBatch(upsert_once(f"{folder}/rows", key, time))
             .option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start())
    query.awaitTermination()
    return spark.read.parquet(f"{folder}/rows")
