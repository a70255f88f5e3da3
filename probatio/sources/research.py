"""Web-search and community-report JSON in one provider-neutral shape."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from probatio import fixed_values as fv
from probatio.functions import keys

_WEB = (
    "struct<request_id:string,response_time:double,results:array<struct<id:string,"
    "url:string,title:string,content:string,score:double,published_date:string>>>"
)
_COMMUNITY = (
    "struct<schema_version:string,generated_at:string,window_days:int,"
    "source_status:map<string,string>,freshness_verdicts:array<struct<"
    "candidate_id:string,verdict:string,detail:string>>,clusters:array<struct<"
    "title:string>>,results:array<struct<candidate_id:string,title:string,"
    "source:string,url:string,published_at:string,summary:string,"
    "relevance_score:double>>>"
)


@dataclass(frozen=True)
class ResearchTables:
    run: DataFrame
    source: DataFrame
    fact: DataFrame
    outcome: DataFrame
    question: DataFrame
    note: DataFrame
    quarantine: DataFrame


def _filled(value: Column) -> Column:
    tidy = F.trim(value)
    return F.when(tidy != "", tidy)


def ingest_web(raw: DataFrame, provider: str = "tavily") -> ResearchTables:
    """``raw``: run_id, payload.  Entries without URL are dropped; a reference is the
    entry's id or the provider name with its original index."""
    parsed = raw.withColumn("r", F.from_json("payload", _WEB))
    good = parsed.where("r.results is not null")
    entries = good.select("run_id", F.posexplode("r.results").alias("entry_ord", "e"))
    source = entries.select(
        "run_id", "entry_ord",
        F.coalesce(_filled(F.col("e.id")), F.format_string(
            provider + "-%03d", "entry_ord")).alias("source_ref"),
        F.lit("web").alias("source_type"), F.lit("ok").alias("state"),
        _filled(F.col("e.url")).alias("url"), _filled(F.col("e.title")).alias("title"),
        _filled(F.col("e.content")).alias("body"),
        keys.timestamp_or_null(F.col("e.published_date")).alias("published_at"),
        F.col("e.score").alias("provider_score"),
    ).where("url is not null")
    dated = F.col("published_at").isNotNull()
    fact = source.where("body is not null").select(
        "run_id", "source_ref", F.col("body").alias("fact"),
        F.lit("retrieved_excerpt").alias("evidence_type"),
        F.when(dated, "OBSERVED").otherwise("ESTIMATED").alias("observability"))
    counts = good.select("run_id").join(source.groupBy("run_id").agg(
        F.count("*").alias("items"), F.count_if(~dated).alias("undated")),
        "run_id", "left").fillna(0)
    items, undated = F.col("items"), F.col("undated")
    outcome = counts.select(
        "run_id", F.lit("web").alias("source_type"),
        F.when(items > 0, "ok").otherwise("no-results").alias("state"),
        items.alias("item_count"))
    run = counts.select("run_id", F.when(items > 0, "SUCCEEDED").otherwise("PARTIAL")
                        .alias("status"))
    note = counts.select("run_id", F.explode(F.array_compact(F.array(
        F.when(items == 0, "The web search completed cleanly and returned no web sources "
                           "for this query."),
        F.when(undated > 0, F.format_string(
            "%d of %d web sources carry no publication date; their claims cannot be "
            "placed in time and are marked ESTIMATED.", undated, items))))).alias("note"))
    question = good.select("run_id", F.lit("").alias("question")).where("false")
    bad = parsed.where("r.results is null").select(
        "run_id", F.lit("response has no results array").alias("reason"))
    return ResearchTables(run, source, fact, outcome, question, note, bad)


def check_contract(version: Column) -> Column:
    """Why a report version is refused, NULL when it is supported."""
    parts = F.split(version, r"\.", 2)
    major = F.get(parts, F.lit(0)).try_cast("int")
    minor_text = F.coalesce(F.get(parts, F.lit(1)), F.lit(""))
    minor = F.when(minor_text == "", 0).otherwise(minor_text.try_cast("int"))
    return (
        F.when(version.isNull(), "report has no schema_version")
        .when(major.isNull() | minor.isNull(),
              F.concat(F.lit("malformed schema_version: "), version))
        .when(major != fv.CONTRACT_MAJOR, F.concat(
            F.lit("unsupported contract major "), major.cast("string")))
        .when(minor < fv.CONTRACT_MINIMUM_MINOR, F.concat(
            F.lit("contract minor "), minor.cast("string"), F.lit(" below minimum "),
            F.lit(str(fv.CONTRACT_MINIMUM_MINOR))))
    )


def known_state(state: Column) -> Column:
    """An unknown state is drift, never success."""
    return F.when(state.isin(*fv.SOURCE_STATES), state).otherwise("schema-drift")


def observability(verdict: Column, published_at: Column) -> Column:
    return (
        F.when(verdict.isin("contradicted", "unsupported"), "UNKNOWN")
        .when((verdict == "stale") | published_at.isNull(), "ESTIMATED")
        .otherwise("OBSERVED"))


def ingest_community(raw: DataFrame) -> ResearchTables:
    """``raw``: run_id, payload (the report).  Every source that was asked gets an
    outcome row, item or no item."""
    parsed = raw.withColumn("r", F.from_json("payload", _COMMUNITY))
    refusal = F.coalesce(
        F.when(F.col("r").isNull(), "report is not a JSON object"),
        check_contract(F.col("r.schema_version")),
        F.when(F.col("r.source_status").isNull(), "report has no source_status map"))
    judged = parsed.withColumn("reason", refusal)
    good = judged.where("reason is null")
    states = good.select("run_id", F.explode("r.source_status").alias(
        "source_type", "_state")).select(
            "run_id", "source_type", known_state(F.col("_state")).alias("state"))
    verdicts = good.select("run_id", F.explode("r.freshness_verdicts").alias("v")).where(
        F.col("v.candidate_id").isNotNull()
        & F.col("v.verdict").isin(*fv.FRESHNESS_VERDICTS)
    ).groupBy("run_id", F.col("v.candidate_id").alias("source_ref")).agg(
        F.last("v.verdict").alias("freshness_verdict"))
    items = good.select(
        "run_id", keys.timestamp_or_null(F.col("r.generated_at")).alias("retrieved_at"),
        F.posexplode("r.results").alias("entry_ord", "e")
    ).select(
        "run_id", "retrieved_at", "entry_ord",
        F.coalesce(_filled(F.col("e.source")), F.lit("unknown")).alias("source_type"),
        F.col("e.candidate_id").alias("source_ref"),
        _filled(F.col("e.url")).alias("url"), _filled(F.col("e.title")).alias("title"),
        _filled(F.col("e.summary")).alias("body"),
        keys.timestamp_or_null(F.col("e.published_at")).alias("published_at"),
        F.col("e.relevance_score").alias("confidence"))
    source = items.join(states, ["run_id", "source_type"], "left").join(
        verdicts, ["run_id", "source_ref"], "left").withColumn(
            "state", F.coalesce("state", F.lit("ok")))
    words = F.coalesce("body", "title")
    fact = source.where(words.isNotNull() & F.col("url").isNotNull()).select(
        "run_id", "source_ref", words.alias("fact"),
        F.lit("reported").alias("evidence_type"),
        observability(F.col("freshness_verdict"), F.col("published_at"))
        .alias("observability"), "confidence")
    counts = items.groupBy("run_id", "source_type").agg(F.count("*").alias("item_count"))
    outcome = states.join(counts, ["run_id", "source_type"], "left").fillna(
        0, ["item_count"])
    degraded = F.col("state").isin(*fv.STATES_DEGRADED)
    note = outcome.select("run_id", F.when(degraded, F.concat(
        F.lit("Source '"), "source_type", F.lit("' could not be observed ("), "state",
        F.lit("); absence of results from it is not evidence of absence."))
    ).when(F.col("state") == fv.STATE_UNCONFIGURED, F.concat(
        F.lit("Source '"), "source_type",
        F.lit("' was not configured and was never queried."))).alias("note")).where(
            "note is not null")
    per_run = outcome.groupBy("run_id").agg(
        F.bool_or(degraded).alias("_bad"),
        F.bool_or(F.col("state").isin(*fv.STATES_CLEAN_EMPTY)).alias("_empty"))
    facts = fact.groupBy("run_id").agg(F.count("*").alias("_facts"))
    run = good.select("run_id").join(per_run, "run_id", "left").join(
        facts, "run_id", "left").select("run_id", F.when(
            F.coalesce("_bad", F.lit(False))
            | (F.col("_facts").isNull() & ~F.coalesce("_empty", F.lit(False))), "PARTIAL")
            .otherwise("SUCCEEDED").alias("status"))
    question = good.select("run_id", F.explode("r.clusters.title").alias("question")).where(
        "question != ''")
    return ResearchTables(run, source, fact, outcome, question, note, judged.where(
        "reason is not null").select("run_id", "reason"))
