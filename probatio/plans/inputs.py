"""Views of the driver tables in the shape the jobs expect."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from probatio.functions import text


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Use all cores when a scan yields fewer splits than there are cores.

    A single-file test table is one split; on a cluster a table has thousands and
    this does nothing, so large text is never shuffled for it.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, *keys) if df.rdd.getNumPartitions() < cores else df


def first_sentence(body: Column) -> Column:
    return F.regexp_extract(body, r"^[^.!?\n]*", 0)


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One search query per benchmark item: its first sentence."""
    return table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("package_id"), first_sentence(F.col("text")).alias("query"))


def document_url() -> Column:
    """A host derived from the retrieval source and the language of a document."""
    top = (F.when(F.col("lang") == "fr", "net").when(F.col("lang") == "es", "org")
           .otherwise("com"))
    return F.concat(F.lit("https://"), F.col("source"), F.lit(".example."), top,
                    F.lit("/"), F.col("doc_id").cast("string"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as retrieved sources."""
    return spread(table(spark, sf_dir, "documents"), "doc_id").select(
        "doc_id", first_sentence(F.col("text")).alias("title"),
        F.col("text").alias("body"), document_url().alias("url"), "source", "lang")


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents dealt to the benchmark queries; every document has one package."""
    size = table(spark, sf_dir, "benchmark").agg(F.count("*")).scalar()
    return documents(spark, sf_dir).select(
        (F.col("doc_id") % size).alias("package_id"), "doc_id",
        F.col("doc_id").cast("string").alias("source_ref"), "title", "body", "url",
        "source", "lang")


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark sentences as claims of one research package."""
    return table(spark, sf_dir, "benchmark").select(
        F.col("item_id"),
        F.posexplode(text.split_sentences(
            F.regexp_replace("text", r"\s+", " "))).alias("claim_ord", "claim")
    ).where(F.length(F.trim("claim")) > 0)
