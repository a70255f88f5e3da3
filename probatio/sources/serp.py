"""Search-result and keyword-metric JSON."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from probatio import fixed_values as fv
from probatio.functions import keys

_ITEM = (
    "struct<type:string,rank_group:int,rank_absolute:int,domain:string,url:string,"
    "title:string,description:string,breadcrumb:string,website_name:string,items:string>"
)
_RESPONSE = (
    "struct<status_code:int,status_message:string,cost:double,tasks:array<struct<"
    "id:string,status_code:int,status_message:string,result:array<struct<"
    "keyword:string,datetime:string,se_results_count:bigint,check_url:string,"
    f"items:array<{_ITEM}>>>>>>"
)
_METRICS = (
    "struct<status_code:int,tasks:array<struct<status_code:int,result:array<struct<"
    "keyword:string,search_volume:double,cpc:double,competition_index:double,"
    "competition:string>>>>>"
)


@dataclass(frozen=True)
class SerpTables:
    snapshot: DataFrame
    result: DataFrame
    question: DataFrame
    feature: DataFrame
    quarantine: DataFrame


def _filled(value: Column) -> Column:
    tidy = F.trim(value)
    return F.when(tidy != "", tidy)


def ingest_serp(raw: DataFrame) -> SerpTables:
    """Split stored responses into snapshots, results, questions and features.

    ``raw``: snapshot_id, payload (JSON text).  Envelope and task must both report
    success, otherwise the response is quarantined with the reason; a success
    without a result block is a valid empty snapshot.
    """
    parsed = raw.withColumn("r", F.from_json("payload", _RESPONSE)).withColumn(
        "task", F.get("r.tasks", F.lit(0)))
    envelope, task = F.col("r.status_code"), F.col("task.status_code")

    def failed(code: Column) -> Column:
        return code.isNotNull() & (code != fv.SERP_STATUS_OK)

    reason = (
        F.when(F.col("r").isNull(), "response is not a JSON object")
        .when(failed(envelope), F.concat(
            F.lit("envelope status "), envelope.cast("string"), F.lit(": "),
            F.coalesce(_filled(F.col("r.status_message")), F.lit("no message"))))
        .when(F.col("task").isNull(), "response carries no tasks")
        .when(failed(task), F.concat(
            F.lit("task status "), task.cast("string"), F.lit(": "),
            F.coalesce(_filled(F.col("task.status_message")), F.lit("no message"))))
    )
    judged = parsed.withColumn("reason", reason)
    good = judged.where("reason is null").withColumn(
        "result", F.get("task.result", F.lit(0)))
    items = good.select("snapshot_id", F.posexplode("result.items").alias(
        "item_ord", "item")).withColumn(
            "raw_type", F.coalesce(_filled(F.col("item.type")), F.lit("unknown")))
    kinds = F.create_map(*[F.lit(x) for kv in fv.SERP_ITEM_TYPES.items() for x in kv])
    typed = items.withColumn("item_type", F.coalesce(kinds[F.col("raw_type")],
                                                     F.lit("OTHER")))
    organic = typed.where("item_type = 'ORGANIC'")
    counts = organic.groupBy("snapshot_id").agg(F.count("*").alias("organic_count"))
    snapshot = good.select(
        "snapshot_id", F.col("task.id").alias("task_id"),
        keys.timestamp_or_null(F.col("result.datetime")).alias("retrieved_at"),
        F.coalesce(F.size("result.items"), F.lit(0)).alias("_n"),
        F.col("r.cost").alias("provider_cost_usd"),
        F.col("result.se_results_count").alias("se_results_count"),
        F.col("result.check_url").alias("check_url"),
    ).join(counts, "snapshot_id", "left").select(
        "snapshot_id", "task_id", "retrieved_at",
        F.greatest("_n", F.lit(0)).alias("total_items"),
        F.coalesce("organic_count", F.lit(0)).alias("organic_count"),
        "provider_cost_usd", "se_results_count", "check_url")
    result = organic.select(
        "snapshot_id", F.col("item_ord").alias("result_ord"),
        *[F.col(f"item.{n}").alias(n) for n in ("rank_group", "rank_absolute")],
        *[_filled(F.col(f"item.{n}")).alias(n) for n in (
            "domain", "url", "title", "description", "breadcrumb")])
    return SerpTables(snapshot, result, _questions(typed), _features(typed),
                      judged.where("reason is not null").select("snapshot_id", "reason"))


def _questions(typed: DataFrame) -> DataFrame:
    """Nested questions are objects, nested related searches plain strings."""
    entries = typed.where(
        "raw_type in ('people_also_ask', 'related_searches')").select(
            "snapshot_id", "item_ord", "raw_type",
            F.col("item.rank_absolute").alias("rank_absolute"),
            F.posexplode(F.from_json("item.items", "array<string>"))
            .alias("entry_ord", "entry"))
    is_object = F.ltrim("entry").startswith("{")
    title = _filled(F.get_json_object("entry", "$.title"))
    asked = F.coalesce(title, _filled(F.get_json_object("entry", "$.question")))
    words = F.when(F.col("raw_type") == "people_also_ask", F.when(is_object, asked)) \
        .otherwise(F.when(is_object, title).otherwise(_filled(F.col("entry"))))
    return entries.select(
        "snapshot_id", "item_ord", "entry_ord",
        F.when(F.col("raw_type") == "people_also_ask", "PAA").otherwise("RELATED")
        .alias("kind"), words.alias("text"), "rank_absolute").where("text is not null")


def _features(typed: DataFrame) -> DataFrame:
    return typed.groupBy("snapshot_id", "raw_type").agg(
        F.first("item_type").alias("item_type"),
        F.count("*").alias("count"),
        F.min_by("item.rank_absolute", "item_ord").alias("rank_absolute"))


def ingest_metrics(raw: DataFrame) -> DataFrame:
    """Keyword metrics, wide to long; an absent metric leaves no row.

    ``raw``: batch_id, payload (JSON text).
    """
    parsed = raw.withColumn("r", F.from_json("payload", _METRICS))
    entries = parsed.where(
        F.coalesce("r.status_code", F.lit(fv.SERP_STATUS_OK)) == fv.SERP_STATUS_OK
    ).select("batch_id", F.explode(F.get("r.tasks", F.lit(0))["result"]).alias("e"))
    return long_metrics(entries.select("batch_id", "e.*"))


def long_metrics(wide: DataFrame) -> DataFrame:
    """``wide``: keyword, search_volume, cpc, competition_index, competition."""
    none = F.lit(None)

    def metric(order: int, name: str, value, text_value, currency) -> Column:
        return F.struct(
            F.lit(order).alias("metric_ord"), F.lit(name).alias("metric_type"),
            value.cast("double").alias("value"),
            text_value.cast("string").alias("value_text"),
            F.lit(currency).cast("string").alias("currency"))

    rows = F.array(
        metric(0, "search_volume", F.col("search_volume"), none, None),
        metric(1, "cpc", F.col("cpc"), none, "USD"),
        metric(2, "competition_index", F.col("competition_index"), none, None),
        metric(3, "competition", none, _filled(F.col("competition")), None))
    present = F.filter(rows, lambda m: m["value"].isNotNull()
                       | m["value_text"].isNotNull())
    return wide.where(_filled(F.col("keyword")).isNotNull()).select(
        F.trim("keyword").alias("keyword"), F.inline(present))
