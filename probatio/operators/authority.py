"""Authority registry joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from probatio import fixed_values as fv
from probatio.functions import text
from probatio.operators import classify
from probatio.profiles import MAX_BROADCAST_ROWS, Profile


def host_suffixes(host: Column) -> Column:
    """``a.b.c`` -> [a.b.c, b.c, c]: longest first."""
    parts = F.split(host, r"\.")
    return F.transform(
        F.sequence(F.lit(1), F.size(parts)),
        lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


def lookup(sources: DataFrame, profile: Profile) -> DataFrame:
    """Attach the most specific registry entry of each URL (NULLs when none).

    The longest registered suffix of the host is found inside the row, so the
    join to the registry is a single equality and no source row is multiplied.
    """
    domains = text.string_array(row[0] for row in profile.registry_rows())
    found = F.filter(host_suffixes(text.bare_host(F.col("url"))),
                     lambda s: F.array_contains(domains, s))
    entries = profile.registry(sources.sparkSession).select(
        F.col("domain").alias("authority_domain"), "authority_type",
        F.col("region").alias("authority_region"),
        F.col("claim_categories").alias("authority_categories"),
        F.col("priority").alias("authority_priority"))
    return text.once(sources, authority_domain=F.get(found, F.lit(0))).join(
        entries, "authority_domain", "left")


def speaks_for(categories: Column, category: Column) -> Column:
    """An entry without categories is a general authority."""
    return (F.size(categories) == 0) | F.array_contains(categories, category)


def candidates(wanted: DataFrame, profile: Profile) -> DataFrame:
    """Entitled domains for each (category, region), best first.

    General authorities are expanded to every category so the match is an
    equality on the category.
    """
    every = text.string_array(fv.CLAIM_CATEGORIES)
    entries = profile.registry(wanted.sparkSession).select(
        "domain", "priority", F.col("region").alias("authority_region"),
        F.explode(F.when(F.size("claim_categories") == 0, every)
                  .otherwise(F.col("claim_categories"))).alias("category"))
    region = F.coalesce(F.col("region"), F.lit("UNKNOWN"))
    related = ((region == "UNKNOWN")
               | classify.covers(F.col("authority_region"), region, profile)
               | classify.covers(region, F.col("authority_region"), profile))
    # every registry row is at most one row per category
    most = len(profile.registry_rows()) * len(fv.CLAIM_CATEGORIES)
    small = F.broadcast(entries) if most <= MAX_BROADCAST_ROWS else entries
    return wanted.join(small, "category").where(related)


def accept_official(retrieved: DataFrame, profile: Profile, as_of_year: int) -> DataFrame:
    """Accept or reject pages of a targeted search, with the reason.

    ``retrieved``: url, title, body, published_at, category (the planned one).
    """
    known = F.col("authority_domain").isNotNull()
    entitled = speaks_for(F.col("authority_categories"), F.col("category"))
    return _with_region_and_freshness(lookup(retrieved, profile), profile, as_of_year) \
        .withColumn("accepted", F.coalesce(known & entitled, F.lit(False))) \
        .withColumn(
            "rejection_reason",
            F.when(~known, "not on a configured official domain")
            .when(~entitled, F.concat(
                "authority_domain", F.lit(" is not configured as an authority for "),
                "category")))


def _with_region_and_freshness(pages: DataFrame, profile: Profile, as_of_year: int,
                               equal_texts: bool = False) -> DataFrame:
    """An authority's own region is definitive; the page text decides otherwise."""
    own = F.coalesce(F.col("authority_region"), F.lit("UNKNOWN"))

    def read(rows: DataFrame, default: Column) -> DataFrame:
        page = F.concat_ws("\n", F.coalesce("title", F.lit("")), F.coalesce("body", F.lit("")))
        plain = text.once(text.once(rows, _page=page), _norm=text.normalise(F.col("_page")))
        return classify.with_freshness(plain, "_page", "_norm", as_of_year).withColumn(
            "region", F.when(default != "UNKNOWN", default).otherwise(
                classify.region(F.col("_norm"), profile))).drop("_page", "_norm")

    if not equal_texts:
        return read(pages, own)
    return text.per_distinct(
        pages, ["title", "body", "published_at"], lambda rows: read(rows, F.lit("UNKNOWN"))
    ).withColumn("region", F.when(own != "UNKNOWN", own).otherwise(F.col("region")))


def describe_sources(sources: DataFrame, profile: Profile, as_of_year: int,
                     equal_texts: bool = False) -> DataFrame:
    """Authority, freshness and region of each source, kept as separate columns.

    ``sources``: url, title, body, source_type, published_at.  With ``equal_texts`` each
    distinct text is read once.
    """
    registered = F.when(F.col("authority_type") == "UNKNOWN", "UNKNOWN").when(
        F.col("authority_type").isNotNull(), "OFFICIAL")
    named = lookup(sources, profile).withColumn("_host", text.bare_host(F.col("url")))
    rated = named.withColumn("source_quality", F.coalesce(
        registered, classify.source_quality(
            F.col("url"), F.col("_host"), F.col("source_type")))).drop("_host")
    return _with_region_and_freshness(rated, profile, as_of_year, equal_texts).withColumn(
        "observation_status",
        F.when(F.col("published_at").isNotNull(), "OBSERVED").otherwise("ESTIMATED"))
