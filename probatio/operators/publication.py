"""Publication gate, versions, live rows and serving views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from probatio import fixed_values as fv
from probatio.functions import text
from probatio.operators import sections
from probatio.profiles import Site

ADDRESS = ["site_id", "locale", "slug"]


def review_layer(layer: Column, codes: Column, score: Column) -> Column:
    """Layer of a review; rows without one are told apart by their finding codes."""
    inferred = (
        F.when(F.arrays_overlap(codes, text.string_array(fv.FACTUAL_REVIEW_CODES)),
               "FACTUAL")
        .when(F.arrays_overlap(codes, text.string_array(fv.SEO_REVIEW_CODES)), "SEO")
        .when(score == 100, "FACTUAL").otherwise("SEO"))
    return F.coalesce(F.when(layer != "", layer), inferred)


def gate(drafts: DataFrame, reviews: DataFrame, approvals: DataFrame) -> DataFrame:
    """Whether each draft may be staged, with every failing condition.

    ``reviews``: draft_id, qa_type, layer, status, score, codes (array),
    blocking_issues (count).  ``approvals``: draft_id, state.
    """
    kept = reviews.where("qa_type = 'DETERMINISTIC'").withColumn(
        "_layer", review_layer(F.col("layer"), F.col("codes"), F.col("score")))
    good = (F.col("status") == "PASSED") & (F.col("blocking_issues") == 0)

    def passed(layer: str) -> list[Column]:
        mine = F.col("_layer") == layer
        return [F.count_if(mine).alias(f"n_{layer.lower()}"),
                (F.count_if(mine & ~good) == 0).alias(f"ok_{layer.lower()}")]

    per = kept.groupBy("draft_id").agg(*passed("FACTUAL"), *passed("SEO"))
    rows = drafts.join(per, "draft_id", "left").join(
        approvals.select("draft_id", F.col("state").alias("approval_state")),
        "draft_id", "left")

    def holds(layer: str) -> tuple[Column, Column]:
        seen = F.coalesce(F.col(f"n_{layer}"), F.lit(0)) > 0
        return seen, seen & F.coalesce(F.col(f"ok_{layer}"), F.lit(False))

    factual_seen, factual = holds("factual")
    seo_seen, seo = holds("seo")
    approved = F.coalesce(F.col("approval_state") == "APPROVED", F.lit(False))
    clean = ~sections.has_external_link(F.col("body"))
    reasons = F.array_compact(F.array(
        F.when(~factual_seen, "no factual QA review is recorded for this draft")
        .when(~factual, "factual QA did not pass"),
        F.when(~seo_seen, "no SEO QA review is recorded for this draft")
        .when(~seo, "SEO QA did not pass"),
        F.when(F.col("approval_state").isNull(), "no human approval recorded")
        .when(~approved, F.concat(F.lit("approval state is "), "approval_state",
                                  F.lit(", not APPROVED"))),
        F.when(~clean, "the draft body contains an outbound link")))
    return rows.select(
        "draft_id", factual.alias("factual_qa"), seo.alias("seo_qa"),
        approved.alias("approved"), clean.alias("no_external_links"),
        (factual & seo & approved & clean).alias("passed"), reasons.alias("reasons"))


def canonical_path(locale: Column, slug: Column, site: Site) -> Column:
    prefixes = F.create_map(*[F.lit(x) for kv in site.locale_paths.items() for x in kv]) \
        if site.locale_paths else None
    prefix = F.concat(F.lit("/"), locale)
    if prefixes is not None:
        prefix = F.coalesce(prefixes[locale], prefix)
    return F.replace(F.concat(prefix, F.lit("/"), slug), F.lit("//"), F.lit("/"))


def canonical_url(path: Column, site: Site) -> Column:
    """Absolute when the site has an origin, else the path itself."""
    rooted = F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path))
    return F.concat(F.lit((site.canonical_origin or "").rstrip("/")), rooted)


def stage(approved: DataFrame, published: DataFrame, site: Site) -> DataFrame:
    """New STAGED snapshots of gated drafts, versioned per address.

    ``approved``: draft_id, locale, slug, staged_at of drafts that passed the gate.
    An unsupported locale is refused and kept with its reason.
    """
    latest = published.groupBy(*ADDRESS).agg(F.max("version").alias("_base"))
    rows = approved.withColumns({
        "site_id": F.lit(site.site_id),
        "locale": F.coalesce("locale", F.lit(site.default_language)),
        "slug": text.page_slug(F.col("slug")),
    })
    refused = ~F.col("locale").isin(*site.languages)
    place = F.row_number().over(
        Window.partitionBy(*ADDRESS).orderBy("staged_at", "draft_id"))
    return (
        rows.join(latest, ADDRESS, "left")
        .withColumn("version", F.coalesce("_base", F.lit(0)) + place)
        .withColumn("refusal", F.when(refused, F.concat(
            F.lit("locale '"), "locale", F.lit(f"' is not supported by site "
                                               f"{site.site_id}"))))
        .withColumn("state", F.when(~refused, "STAGED"))
        .withColumn("canonical_path", canonical_path(F.col("locale"), F.col("slug"), site))
        .withColumn("noindex", F.lit(not site.is_indexable)).drop("_base")
    )


def next_version(published: DataFrame) -> DataFrame:
    return published.groupBy(*ADDRESS).agg(
        (F.max("version") + 1).alias("next_version"))


def archive_superseded(published: DataFrame) -> DataFrame:
    """At most one live row per address: older live rows become ARCHIVED.

    The newest live version is found by aggregation and joined back, so a crowded
    address is not sorted in one task.
    """
    live = published.where("state = 'PUBLISHED'").groupBy(*ADDRESS).agg(
        F.max("version").alias("_live"))
    older = (F.col("state") == "PUBLISHED") & (F.col("version") < F.col("_live"))
    return published.join(live, ADDRESS, "left").withColumn(
        "state", F.when(older, "ARCHIVED").otherwise(F.col("state"))).drop("_live")


def preview_rows(published: DataFrame) -> DataFrame:
    """Newest staged or published row of each address."""
    columns = [c for c in published.columns if c not in ADDRESS]
    shown = published.where("state in ('STAGED', 'PUBLISHED')")
    return shown.groupBy(*ADDRESS).agg(
        F.max_by(F.struct(*columns), "version").alias("r")).select(*ADDRESS, "r.*")


def public_pages(published: DataFrame, site: Site) -> DataFrame:
    """The publication-safe view of live rows."""
    rows = published.where((F.col("state") == "PUBLISHED")
                           & F.lit(site.is_publishable))
    return _serving(rows, site, F.lit(not site.is_indexable))


def preview_pages(published: DataFrame, site: Site) -> DataFrame:
    """What an owner may look at; never indexable."""
    return _serving(preview_rows(published), site, F.lit(True)).withColumn(
        "preview", F.lit(True))


def _serving(rows: DataFrame, site: Site, noindex: Column) -> DataFrame:
    title = F.coalesce(F.when(F.col("meta_title") != "", F.col("meta_title")), "title")
    own = F.coalesce("noindex", F.lit(False))
    return rows.select(
        *ADDRESS, "version", "state", "title", title.alias("meta_title"),
        "meta_description", "canonical_path",
        canonical_url(F.coalesce("canonical_path", F.lit("/")), site)
        .alias("canonical_url"),
        (own | noindex).alias("noindex"),
        F.lit(site.primary_cta).alias("primary_cta"),
        F.lit(site.primary_cta_label).alias("primary_cta_label"),
        F.lit(site.secondary_cta).alias("secondary_cta"),
        F.lit(site.secondary_cta_label).alias("secondary_cta_label"))


def draft_preview(drafts: DataFrame, gates: DataFrame, site: Site) -> DataFrame:
    """An unapproved draft for review, with what is still missing."""
    slug = text.page_slug(F.coalesce("recommended_slug", "primary_query"))
    path = canonical_path(F.lit(site.default_language), slug, site)
    return drafts.join(gates, "draft_id").select(
        "draft_id", F.lit(site.default_language).alias("locale"), slug.alias("slug"),
        "title", path.alias("canonical_path"),
        canonical_url(path, site).alias("canonical_url"),
        F.lit(True).alias("noindex"), F.lit(0).alias("version"),
        F.lit("DRAFT_PREVIEW").alias("state"), F.col("passed").alias("gate_passed"),
        F.col("reasons").alias("gate_reasons"))


def public_answers(answers: Column) -> Column:
    """Price answers without source addresses or claim internals."""
    return F.transform(answers, lambda a: F.struct(
        a["claim"].alias("claim"), a["category"].alias("category"),
        a["qualification"].alias("qualification"), *[
            a["price"][name].alias(name) for name in (
                "amounts", "currency", "basis", "vat_status", "system_size_kwp",
                "battery_included", "installation_included", "is_range")]))


def sitemap(published: DataFrame, site: Site) -> DataFrame:
    """Absolute addresses of live rows of an indexable site."""
    rows = published.where((F.col("state") == "PUBLISHED") & F.lit(site.is_indexable)
                           & ~F.coalesce("noindex", F.lit(False)))
    return rows.select("site_id", "locale", canonical_url(
        F.coalesce("canonical_path", F.lit("/")), site).alias("url"), "updated_at")


def pending_approvals(drafts: DataFrame, approvals: DataFrame) -> DataFrame:
    """All open approvals, newest first."""
    return approvals.where("state in ('PENDING', 'NEEDS_REVISION')").join(
        drafts.select("draft_id", "title"), "draft_id"
    ).orderBy(F.desc("created_at"), "draft_id")
