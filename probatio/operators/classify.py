"""Labels for queries, sources and claims.

Each label is a column expression over constant vocabulary, so a labelling job
is one projection; requirement rows come from a small broadcast policy table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from probatio import fixed_values as fv
from probatio.functions import text
from probatio.profiles import Profile


# ------------------------------------------------------------------ queries --
def without_market(normal: Column, profile: Profile) -> Column:
    """Normalised query with the market's own names taken out."""
    plain = normal
    for term in profile.market_terms:
        plain = F.replace(plain, F.lit(text.local_normalise(term)), F.lit(" "))
    return text.squeeze(plain)


def intent(plain: Column, profile: Profile) -> Column:
    """Search intent of a query without its market names."""
    local = text.contains_any(plain, profile.local_terms)
    question = plain.rlike(r"(?U)\b(" + "|".join(fv.QUESTION_WORDS) + r")\b")
    return (
        F.when(text.contains_any(plain, profile.comparison_terms), "COMMERCIAL")
        .when(text.contains_any(plain, profile.commercial_terms),
              F.when(local, "LOCAL").otherwise("COMMERCIAL"))
        .when(question, "INFORMATIONAL")
        .when(local, "LOCAL")
        .otherwise("INFORMATIONAL")
    )


def content_type(normal: Column, intent_: Column, profile: Profile) -> Column:
    """First allowed candidate for the intent, else the first allowed type."""
    allowed = profile.content_types

    def first(*candidates: str) -> Column:
        return F.lit(next((c for c in candidates if c in allowed), allowed[0]))

    comparison = text.contains_any(normal, profile.comparison_terms)
    return (
        F.when(comparison, first("COMPARISON", "GUIDE"))
        .when(intent_.isin("COMMERCIAL", "TRANSACTIONAL", "LOCAL"),
              first("LANDING_PAGE", "GUIDE"))
        .when(intent_ == "INFORMATIONAL", first("GUIDE", "ARTICLE"))
        .otherwise(F.lit(allowed[0]))
    )


def call_to_action(intent_: Column, profile: Profile) -> Column:
    """First option that lists the intent, else the first option, else NULLs."""
    def option(code, label, reason: Column) -> Column:
        return F.struct(F.lit(code).cast("string").alias("code"),
                        F.lit(label).cast("string").alias("label"),
                        reason.alias("reason"))

    if not profile.cta_options:
        return option(None, None, F.lit("no CTA configured for this vertical — must be "
                                        "resolved before publication"))
    matches = [
        F.when(intent_.isin(*o["intents"]),
               option(o["code"], o["label"],
                      F.concat(F.lit("matches "), intent_, F.lit(" intent"))))
        for o in profile.cta_options if o.get("intents")
    ]
    default = profile.cta_options[0]
    return F.coalesce(*matches, option(default["code"], default["label"],
                                       F.lit("vertical default")))


def classify_queries(queries: DataFrame, profile: Profile) -> DataFrame:
    return (
        text.once(text.once(
            text.once(queries, _norm=text.normalise(F.col("query"))),
            _plain=without_market(F.col("_norm"), profile)),
            intent=intent(F.col("_plain"), profile))
        .withColumn("content_type", content_type(F.col("_norm"), F.col("intent"), profile))
        .withColumn("cta", call_to_action(F.col("intent"), profile))
        .drop("_norm", "_plain")
    )


def provider_plan(queries: DataFrame, profile: Profile,
                  force_community: str | None = None) -> DataFrame:
    """Which providers run for a query, with the reason for each.

    ``queries`` carries ``intent``; ``force_community`` names an optional boolean
    column by which an operator overrides the community decision.
    """
    forced = F.col(force_community) if force_community else F.lit(None).cast("boolean")
    buying = F.col("intent").isin("COMMERCIAL", "TRANSACTIONAL")
    enabled = F.lit(profile.community_research_enabled)
    return queries.select(
        "*",
        F.lit(True).alias("serp"),
        F.lit(True).alias("web_research"),
        F.coalesce(forced, enabled & ~buying).alias("community"),
        F.lit(profile.keyword_metrics_enabled).alias("keyword_metrics"),
        F.lit("SERP structure is required for every query").alias("serp_reason"),
        F.lit("web research supplies the source-backed evidence set").alias("web_reason"),
        F.when(forced, "explicitly forced on by the operator")
        .when(~forced, "explicitly forced off by the operator")
        .when(~enabled, f"vertical {profile.code} does not enable community research "
              f"(its audience is not the technical community this provider indexes)")
        .when(buying, F.concat("intent", F.lit(
            " intent — community discussion rarely carries purchase-stage facts")))
        .otherwise(F.concat(F.lit(
            "vertical enables community research and intent is "), "intent"))
        .alias("community_reason"),
        F.lit("enabled for this vertical" if profile.keyword_metrics_enabled else
              "disabled for this vertical — metrics cost money per call")
        .alias("metrics_reason"),
    )


# ------------------------------------------------------------------ sources --
def _ends_with_any(value: Column, suffixes) -> Column:
    test = F.lit(False)
    for suffix in suffixes:
        test = test | value.endswith(suffix)
    return test


def source_quality(url: Column, name: Column, source_type: Column | None = None) -> Column:
    """Weight of a source by bare host, with the provider's channel as fallback."""
    channel = (F.coalesce(source_type, F.lit("")) if source_type is not None
               else F.lit("")).isin(*fv.COMMUNITY_CHANNELS)
    specialist = F.lit(False)
    for hint in fv.SPECIALIST_HINTS:
        specialist = specialist | name.contains(hint)
    missing = url.isNull() | (url == "")
    return (
        F.when(missing, F.when(channel, "COMMUNITY").otherwise("UNKNOWN"))
        .when(name.isNull(), "UNKNOWN")
        .when(name.isin(*fv.OFFICIAL_HOSTS)
              | _ends_with_any(name, fv.OFFICIAL_SUFFIXES), "OFFICIAL")
        .when(name.isin(*fv.INSTITUTIONAL_HOSTS)
              | _ends_with_any(name, fv.INSTITUTIONAL_SUFFIXES), "INSTITUTIONAL")
        .when(_ends_with_any(name, fv.COMMUNITY_HOSTS) | channel, "COMMUNITY")
        .when(specialist, "SPECIALIST")
        .otherwise("COMMERCIAL")
    )


def rank(value: Column, ranks: dict[str, int]) -> Column:
    """Ordinal of a label; NULL for a label that has none."""
    ladder = None
    for name, number in ranks.items():
        ladder = (F.when(value == name, number) if ladder is None
                  else ladder.when(value == name, number))
    return ladder


def quality_rank(quality: Column) -> Column:
    return rank(quality, fv.QUALITY_RANK)


def acceptable_qualities(requirement: Column) -> Column:
    """Qualities that meet a requirement, best first."""
    needed = rank(requirement, fv.AUTHORITY_RANK)
    ranked = F.array(*[F.struct(F.lit(q).alias("q"), F.lit(r).alias("r"))
                       for q, r in fv.QUALITY_RANK.items() if q != "UNKNOWN"])
    return F.transform(F.filter(ranked, lambda x: x["r"] >= needed), lambda x: x["q"])


def quality_summary(sources: DataFrame) -> DataFrame:
    """Counts by quality and the best one, per package."""
    def count(q: str) -> Column:
        return F.count_if(F.col("source_quality") == q)

    return sources.groupBy("package_id").agg(
        *[count(q).alias(q.lower()) for q in fv.QUALITY_RANK],
        (count("OFFICIAL") > 0).alias("has_official"),
        (count("INSTITUTIONAL") > 0).alias("has_institutional"),
        F.max_by("source_quality", quality_rank(F.col("source_quality"))).alias("best"))


# ------------------------------------------------------------------ regions --
def region(normal: Column, profile: Profile, default: str | Column = "UNKNOWN") -> Column:
    """Most specific region a normalised text names: sub-national regions first."""
    ordered = sorted(profile.region_terms,
                     key=lambda code: profile.region_parent.get(code) is None)
    tests = [F.when(text.has_term(normal, profile.region_terms[code]), F.lit(code))
             for code in ordered]
    fallback = default if isinstance(default, Column) else F.lit(default)
    return F.coalesce(*tests, fallback)


def market_region(market: Column, profile: Profile) -> Column:
    code = F.upper(market)
    return F.when(code.isin(*profile.region_parent), code).otherwise("UNKNOWN")


def covers(evidence: Column, claim: Column, profile: Profile) -> Column:
    """Whether evidence of one region may support a claim about another."""
    pairs = [f"{e}>{c}" for e, c in profile.region_cover_pairs()]
    return F.concat_ws(">", evidence, claim).isin(*pairs)


def region_mismatch(evidence: Column, claim: Column, profile: Profile) -> Column:
    parents = [f"{c}>{p}" for c, p in profile.region_parent.items() if p]
    return (
        F.when(evidence == "UNKNOWN", "evidence carries no identifiable regional scope")
        .when(claim == "UNKNOWN", "claim carries no identifiable regional scope")
        .when(F.concat_ws(">", evidence, claim).isin(*parents), F.concat(
            evidence, F.lit(" evidence cannot establish a "), claim,
            F.lit("-wide claim")))
        .otherwise(F.concat(evidence, F.lit(" evidence does not cover a "), claim,
                            F.lit(" claim")))
    )


# ---------------------------------------------------------------- freshness --
def _holds(normal: Column, pieces: tuple[str, ...]) -> Column:
    """A byte search that spares most texts a costly pattern."""
    test = F.lit(False)
    for piece in pieces:
        test = test | normal.contains(piece)
    return test


def with_freshness(pages: DataFrame, body: str, normal: str, as_of_year: int) -> DataFrame:
    """Add freshness status, the raw dates a page states, signals and a note.

    ``body`` and ``normal`` name the text and its normalised form; ``published_at``
    may be NULL.  A date is never invented.
    """
    value, plain = F.col(body), F.col(normal)

    # Each stated date carries a digit and a piece of its introduction, so that most
    # pages skip the patterns.
    def stated(pattern: str, pieces: tuple[str, ...]) -> Column:
        found = F.trim(F.regexp_extract(value, pattern, 1))
        return F.when(_holds(plain, pieces) & value.rlike("[0-9]") & (found != ""), found)

    read = text.once(
        pages,
        _historical=text.first_contained(plain, fv.HISTORICAL_MARKERS),
        _current=text.first_contained(plain, fv.CURRENT_MARKERS),
        _updated=stated(fv.UPDATED_PATTERN, fv.UPDATED_PIECES),
        effective_from=stated(fv.EFFECTIVE_FROM_PATTERN, fv.EFFECTIVE_FROM_PIECES),
        effective_until=stated(fv.EFFECTIVE_UNTIL_PATTERN, fv.EFFECTIVE_UNTIL_PIECES),
    )
    historical, current = F.col("_historical"), F.col("_current")
    updated, since = F.col("_updated"), F.col("effective_from")
    until = F.col("effective_until")
    years = F.transform(F.regexp_extract_all(until, F.lit(fv.YEAR_PATTERN), F.lit(1)),
                        lambda y: y.cast("int"))
    dated = F.col("published_at").isNotNull() | updated.isNotNull()
    expired = F.coalesce(F.array_max(years) < as_of_year, F.lit(False))
    status = (
        F.when(historical.isNotNull(), "HISTORICAL")
        .when(expired, "DATED_EXPIRED")
        .when(dated, "DATED_CURRENT")
        .when(current.isNotNull(), "UNDATED_CURRENT")
        .otherwise("UNDATED")
    )
    note = (
        F.when(historical.isNotNull(), F.concat(
            F.lit("Page presents as no longer in force ("), historical, F.lit(").")))
        .when(expired, F.concat(F.lit("Stated validity ended "), until, F.lit(".")))
        .when(dated, "Carries a publication or update date.")
        .when(current.isNotNull(), F.concat(
            F.lit("No date, but the page presents as in force ("), current,
            F.lit(").")))
        .otherwise("No date and no currency signal.")
    )
    signals = F.array_compact(F.array(*[
        F.concat(F.lit(name + ":"), column) for name, column in (
            ("historical_marker", historical), ("current_marker", current),
            ("updated", updated), ("effective_from", since),
            ("effective_until", until))]))
    return read.withColumns({
        "freshness_status": status, "freshness_signals": signals, "freshness_note": note,
    }).drop("_historical", "_current", "_updated")


# ------------------------------------------------------------------- claims --
def category(claim: Column, normal: Column, profile: Profile) -> Column:
    """What kind of assertion a text makes; vertical vocabulary comes first.

    Pass the normalised text as a materialised column: it is tested many times.
    """
    vat_only = claim.rlike(fv.VAT_AS_QUALIFIER_PATTERN) & ~claim.rlike(fv.TAX_RATE_PATTERN)
    tests = [F.when(_holds(normal, fv.GUARANTEED_PIECES)
                    & normal.rlike(fv.GUARANTEED_OUTCOME_PATTERN), "GUARANTEED_SAVINGS")]
    configured = {name.upper(): terms for name, terms in profile.claim_categories.items()
                  if name.upper() in fv.CLAIM_CATEGORIES}
    for vocabulary in (configured, fv.UNIVERSAL_CATEGORY_HINTS):
        for name, terms in vocabulary.items():
            found = text.has_term(normal, terms)
            found = found & ~vat_only if name == "TAX" else found
            tests.append(F.when(found, F.lit(name)))
    priced = (text.contains_any(normal, fv.PRICE_WORDS)
              | claim.rlike("[" + "".join(fv.CURRENCY_SIGNS) + "]"))
    tests.append(F.when(
        priced,
        F.when(text.contains_any(normal, fv.VENDOR_MARKERS), "VENDOR_PRICE")
        .when(text.contains_any(normal, fv.AVERAGE_MARKERS), "MARKET_AVERAGE")
        .when(claim.rlike(fv.RANGE_PATTERN)
              | text.contains_any(normal, fv.RANGE_MARKERS), "OBSERVED_PRICE_RANGE")
        .otherwise("MARKET_PRICE")))
    return F.coalesce(*tests, F.lit("GENERAL"))


def with_category(rows: DataFrame, column: str, profile: Profile) -> DataFrame:
    """Add ``category`` of a text column, its normalised form computed once."""
    read = text.once(rows, _norm=text.normalise(F.coalesce(F.col(column), F.lit(""))))
    return text.once(read, category=category(
        F.col(column), F.col("_norm"), profile)).drop("_norm")


def claim_requirements(claims: DataFrame, profile: Profile) -> DataFrame:
    """Attach the bar each claim must clear; ``category`` must be present.

    A category without a policy row keeps NULL requirements, see
    :func:`quarantine_without_policy`.
    """
    return claims.join(profile.policy(claims.sparkSession), "category", "left")


def quarantine_without_policy(claims: DataFrame) -> tuple[DataFrame, DataFrame]:
    return claims.where("risk is not null"), claims.where("risk is null")


def claim_summary(claims: DataFrame) -> DataFrame:
    """Claims by risk and category per package, one row per pair."""
    return claims.groupBy("package_id", "category", "risk").agg(
        F.count("*").alias("claims"))


def simple_risk(claim: Column, normal: Column, profile: Profile) -> Column:
    """First risk model: consequence if wrong."""
    return (
        F.when(text.contains_any(normal, profile.restricted_claims)
               | text.contains_any(normal, fv.HIGH_RISK_TERMS), "HIGH")
        .when(claim.rlike(fv.RISK_QUANTIFIED_PATTERN), "MEDIUM")
        .otherwise("LOW")
    )


def minimum_quality_rank(risk: Column) -> Column:
    return rank(risk, {r: fv.QUALITY_RANK[q] for r, q in fv.RISK_MINIMUM_QUALITY.items()})


def simple_sufficiency(risk: Column, quality: Column) -> Column:
    """Struct (sufficient, reason) of the first risk model."""
    needed = F.create_map(*[F.lit(x) for kv in fv.RISK_MINIMUM_QUALITY.items()
                            for x in kv])[risk]
    enough = quality_rank(quality) >= minimum_quality_rank(risk)
    reason = F.when(enough, F.concat(
        risk, F.lit("-risk claim supported by a "), quality, F.lit(" source (minimum "),
        needed, F.lit(").")
    )).otherwise(F.concat(
        risk, F.lit("-risk claim needs at least a "), needed,
        F.lit(" source; this one is "), quality, F.lit(".")))
    return F.struct(enough.alias("sufficient"), reason.alias("reason"))


# ---------------------------------------------------------------- conflicts --
def units(body: Column) -> Column:
    low = F.lower(body)
    return F.array_compact(F.array(*[
        F.when(_holds(low, fv.UNIT_PIECES[name]) & body.rlike(pattern), F.lit(name))
        for name, pattern in fv.UNIT_PATTERNS]))


def years(body: Column) -> Column:
    found = F.when(body.contains("20"), F.regexp_extract_all(
        body, F.lit(fv.PERIOD_PATTERN), F.lit(1))).otherwise(
            F.when(body.isNotNull(), text.string_array([])))
    return F.array_sort(F.array_distinct(F.transform(found, lambda y: y.cast("int"))))


def conflict_kind(claim: Column, other: Column, claim_region: Column, other_region: Column,
                  profile: Profile, same_wording: Column | None = None) -> Column:
    """Why two figures differ; only TRUE_CONFLICT blocks a claim.

    ``same_wording``: whether the normalised texts are equal, where they are known.
    """
    if same_wording is None:
        same_wording = text.normalise(claim) == text.normalise(other)
    named = (claim_region != "UNKNOWN") & (other_region != "UNKNOWN")
    apart = (named & (claim_region != other_region)
             & ~covers(claim_region, other_region, profile)
             & ~covers(other_region, claim_region, profile))

    def disjoint(a: Column, b: Column) -> Column:
        return (F.size(a) > 0) & (F.size(b) > 0) & ~F.arrays_overlap(a, b)

    return (
        F.when(apart, "REGIONAL_DIFFERENCE")
        .when(disjoint(units(claim), units(other)), "SCOPE_DIFFERENCE")
        .when(disjoint(years(claim), years(other)), "TIME_DIFFERENCE")
        .when(same_wording, "WORDING_VARIATION")
        .otherwise("TRUE_CONFLICT")
    )


def conflict_summary(conflicts: DataFrame) -> DataFrame:
    return conflicts.groupBy("package_id").agg(
        *[F.count_if(F.col("conflict_kind") == k).alias(k.lower()) for k in (
            "TRUE_CONFLICT", "REGIONAL_DIFFERENCE", "TIME_DIFFERENCE",
            "SCOPE_DIFFERENCE", "WORDING_VARIATION")],
        F.count_if(F.col("conflict_kind") == "TRUE_CONFLICT").alias("blocking"),
        F.count_if(F.col("conflict_kind") != "TRUE_CONFLICT").alias("non_blocking"))
