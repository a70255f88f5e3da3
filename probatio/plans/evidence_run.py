"""The whole evidence run as one chain of jobs: sources and claims in, verdicts out."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from probatio.functions import text
from probatio.operators import authority, classify, evidence, gate, matching, passages
from probatio.plans import inputs
from probatio.profiles import Profile
from probatio.session import cut_lineage, shuffled


class EvidenceRun:
    """Claims evaluated against the passages of eligible sources, part by part.

    ``sources``: package_id, source_ref, source_ord, title, body, url, source_type,
    published_at, already filtered to RELEVANT.  ``claims``: package_id, claim_id,
    claim_ord, claim, source_ref.

    A part is made when it is first asked for.  Concepts are read once per passage and
    once per claim and materialised, because the index, the matcher and the references
    all use them.  With ``equal_texts`` (sources repeat each other's wording) each distinct
    text is read once, whatever the number of sources that hold it.
    """

    def __init__(self, sources: DataFrame, claims: DataFrame, market: str, profile: Profile,
                 as_of_year: int, equal_texts: bool = False):
        self._sources, self._claims = sources, claims
        self._market, self._profile, self._year = market, profile, as_of_year
        self._equal_texts = equal_texts

    @cached_property
    def _described(self) -> DataFrame:
        """Sources with their text, read once for their dimensions and for passages."""
        # The distinct texts and the join back both read the sources.
        sources = cut_lineage(self._sources) if self._equal_texts else self._sources
        described = authority.describe_sources(
            sources, self._profile, self._year, self._equal_texts)
        return cut_lineage(described.select(
            "package_id", "source_ref", "source_ord", "url", "source_quality", "region",
            "freshness_status", "observation_status", "body"))

    @cached_property
    def sources(self) -> DataFrame:
        return self._described.drop("body")

    @cached_property
    def passages(self) -> DataFrame:
        sources = self._described.select("package_id", "source_ref", "region", "body")

        def read(rows: DataFrame) -> DataFrame:
            return matching.concepts(passages.kept_passages(rows), "passage", self._profile)

        if not self._equal_texts:
            # The region comes along with the text; a join would shuffle every passage.
            return cut_lineage(read(sources))
        # The region of a passage is that of its source, so the text is read without one.
        unread = F.lit(None).cast("string")
        return cut_lineage(text.per_distinct(sources, ["body"], lambda texts: read(
            texts.select("*", F.col("body").alias("_body"), unread.alias("region"))
        ).drop("region").withColumnRenamed("_body", "body")).drop("body"))

    @cached_property
    def claims(self) -> DataFrame:
        def read(rows: DataFrame) -> DataFrame:
            return matching.concepts(rows, "claim", self._profile)

        said = text.per_distinct(self._claims, ["claim"], read) if self._equal_texts \
            else read(self._claims)
        return cut_lineage(classify.claim_requirements(evidence.with_claim_region(
            said, self._market, self._profile), self._profile))

    @cached_property
    def matches(self) -> DataFrame:
        """Pairs about the same thing; refused ones would be most and nothing reads them."""
        return cut_lineage(matching.match(
            self.claims, self.passages, self._profile, refused=False))

    @cached_property
    def references(self) -> DataFrame:
        return evidence.evidence_references(
            evidence.best_passages(self.matches), self.claims, self.passages, self.sources,
            self._profile)

    @cached_property
    def evaluated(self) -> DataFrame:
        stated = self.claims.select(
            *self._claims.columns, "category", "claim_region", "risk",
            "authority_requirement", "freshness_requirement", "min_sources", "rationale")
        return evidence.verdicts(stated, self.references, self._profile)


def driver_tables(spark: SparkSession, sf_dir: str, profile: Profile,
                  as_of_year: int) -> EvidenceRun:
    """Benchmark sentences as claims of one package over all documents."""
    package = F.lit(0).alias("package_id")
    sources = inputs.documents(spark, sf_dir).select(
        package, F.col("doc_id").cast("string").alias("source_ref"),
        F.col("doc_id").alias("source_ord"), "title", "body", "url",
        F.lit("web").alias("source_type"),
        F.when(F.col("lang") != "en", F.to_timestamp(F.lit("2024-01-01")))
        .alias("published_at"))
    claims = inputs.claims(spark, sf_dir).select(
        package, F.concat_ws("-", F.col("item_id").cast("string"),
                             F.col("claim_ord").cast("string")).alias("claim_id"),
        F.struct("item_id", "claim_ord").alias("claim_ord"),
        F.trim("claim").alias("claim"),
        F.col("item_id").cast("string").alias("source_ref"))
    return EvidenceRun(sources, claims, profile.market, profile, as_of_year)


def gated_tables(spark: SparkSession, sf_dir: str, profile: Profile,
                 as_of_year: int) -> tuple[DataFrame, EvidenceRun]:
    """The labelled sources of every package with their texts, and the run over the relevant
    ones (``gated_labels``)."""
    labels, run = gated_labels(spark, sf_dir, profile, as_of_year)
    texts = inputs.sources(spark, sf_dir).select("package_id", "source_ref", "body")
    return labels.drop("body").join(shuffled(texts), ["package_id", "source_ref"]), run


def gated_labels(spark: SparkSession, sf_dir: str, profile: Profile,
                 as_of_year: int) -> tuple[DataFrame, EvidenceRun]:
    """The labelled sources of every package, and the run over the relevant ones.  Only those
    are read on, so only their texts are stored; ``body`` of the others is NULL.

    Sources are judged against the query of their package.  Passages and claims come from
    RELEVANT rows only; equal claims of a package are one, known by their first place.
    """
    profiles = gate.query_profile(inputs.queries(spark, sf_dir), profile)
    body = F.when(F.col("relevance_status") == "RELEVANT", F.col("body")).alias("body")
    gated = cut_lineage(gate.gate_sources(inputs.sources(spark, sf_dir), profiles).select(
        "package_id", "source_ref", F.col("doc_id").alias("source_ord"), "title", body, "url",
        F.lit("web").alias("source_type"),
        F.when(F.col("lang") != "en", F.to_timestamp(F.lit("2024-01-01")))
        .alias("published_at"), "relevance_status", "relevance_score", "relevance_reason"))
    relevant = gated.where("relevance_status = 'RELEVANT'")
    said = passages.claims(passages.kept_passages(relevant.select(
        "package_id", "source_ref", "source_ord", "body")))
    places = ["source_ord", "passage_ord", "claim_ord"]
    claims = passages.dedupe_claims(said.select(
        "package_id", "source_ref", *places, "claim", "quantified"), places)
    return gated, EvidenceRun(relevant, claims.select(
        "package_id", F.concat_ws("-", "source_ref", "passage_ord", "claim_ord")
        .alias("claim_id"), F.struct(*places).alias("claim_ord"), "claim", "source_ref"),
        profile.market, profile, as_of_year)
