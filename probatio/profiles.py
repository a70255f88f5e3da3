"""Vertical and site profiles: the vocabulary every job is parameterised with.

A profile is a small configuration document.  It is read on the driver and
turned either into constant column expressions (term lists) or into dimension
tables of a few dozen rows.  Dimension tables are broadcast only because their
row count is known before the plan is built; see :func:`dimension`.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from probatio import fixed_values as fv
from probatio.functions import text

# A configured table above this many rows is joined like any other table.
MAX_BROADCAST_ROWS = 20_000


def dimension(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """Configuration rows as a table; hinted for broadcast only when provably small."""
    table = spark.createDataFrame(list(rows), schema)
    return F.broadcast(table) if len(rows) <= MAX_BROADCAST_ROWS else table


@dataclass(frozen=True)
class Profile:
    """One vertical.  Every list keeps its configured order."""

    code: str
    market: str = ""
    languages: tuple[str, ...] = ()
    default_language: str = ""
    target_audience: str = ""
    business_objective: str = ""
    cta_options: tuple[dict, ...] = ()
    preferred_content_types: tuple[str, ...] = ()
    restricted_claims: tuple[str, ...] = ()
    forbidden_phrases: tuple[str, ...] = ()
    commercial_terms: tuple[str, ...] = ()
    comparison_terms: tuple[str, ...] = ()
    local_terms: tuple[str, ...] = ()
    market_terms: tuple[str, ...] = ()
    community_research_enabled: bool = False
    keyword_metrics_enabled: bool = True
    authoritative_domains: tuple[str, ...] = ()
    claim_categories: dict = field(default_factory=dict)
    authority_policy: dict = field(default_factory=dict)
    official_source_policy: dict = field(default_factory=dict)
    price_policy: dict = field(default_factory=dict)
    generic_terms: tuple[str, ...] = ()
    concept_phrases: tuple[str, ...] = ()
    # Region vocabulary is data as well; the default is the published one.
    region_terms: dict = field(default_factory=lambda: dict(fv.REGION_TERMS))
    region_parent: dict = field(default_factory=lambda: dict(fv.REGION_PARENT))

    @classmethod
    def from_dict(cls, raw: dict) -> "Profile":
        known = cls.__dataclass_fields__
        values = {}
        for name, value in raw.items():
            if name in known and value is not None:
                values[name] = tuple(value) if isinstance(value, list) else value
        return cls(**values)

    # -- derived vocabulary -------------------------------------------------
    @property
    def modifier_tokens(self) -> list[str]:
        return _token_list((*self.commercial_terms, *self.comparison_terms),
                           fv.GATE_STOPWORDS)

    @property
    def market_tokens(self) -> list[str]:
        return _token_list(self.market_terms, fv.GATE_STOPWORDS)

    @property
    def generic_tokens(self) -> list[str]:
        return _token_list(self.generic_terms, fv.MATCH_STOPWORDS)

    @property
    def phrases(self) -> list[str]:
        """Multi-word concepts, longest first."""
        raw = list(self.concept_phrases)
        for terms in self.claim_categories.values():
            raw.extend(t for t in terms if " " in t)
        normal = {text.local_normalise(p) for p in raw}
        return sorted((p for p in normal if p), key=lambda p: (-len(p), p))

    @property
    def content_types(self) -> list[str]:
        chosen = [t for t in self.preferred_content_types
                  if t in fv.SELECTABLE_CONTENT_TYPES]
        return chosen or ["ARTICLE"]

    @property
    def official_domains(self) -> list[str]:
        names: list[str] = []
        for entry in self.official_source_policy.get("domains") or []:
            name = entry if isinstance(entry, str) else (entry or {}).get("domain", "")
            names.append(str(name).strip().lower())
        names.extend(d.strip().lower() for d in self.authoritative_domains)
        return list(dict.fromkeys(n for n in names if n))

    # -- dimension tables ---------------------------------------------------
    def region_cover(self, spark: SparkSession) -> DataFrame:
        """(evidence_region, claim_region) pairs where the first covers the second."""
        return dimension(spark, self.region_cover_pairs(),
                         "evidence_region string, claim_region string")

    def region_cover_pairs(self) -> list[tuple[str, str]]:
        same = [(code, code) for code in self.region_parent]
        parents = [(p, code) for code, p in self.region_parent.items() if p]
        return same + parents

    def policy_rows(self) -> list[tuple]:
        """Default requirements with this vertical's valid overrides applied."""
        rows = []
        for category, row in fv.DEFAULT_POLICY.items():
            rows.append((category, *_overridden(row, self.authority_policy.get(category))))
        return rows

    def policy(self, spark: SparkSession) -> DataFrame:
        return dimension(
            spark, self.policy_rows(),
            "category string, risk string, authority_requirement string, "
            "freshness_requirement string, min_sources int, rationale string")

    def registry_rows(self) -> list[tuple]:
        """Authority entries; the first definition of a domain wins."""
        entries: dict[str, tuple] = {}

        def add(domain, kind, region, market, languages, categories, priority, name):
            domain = str(domain or "").strip().lower()
            if domain and domain not in entries:
                entries[domain] = (domain, kind, region, market, list(languages),
                                   sorted(categories), priority, name or domain)

        for raw in self.official_source_policy.get("domains") or []:
            if isinstance(raw, str):
                add(raw, "PUBLIC_AGENCY", "UNKNOWN", self.market, self.languages, [], 50,
                    None)
            elif isinstance(raw, dict):
                kind = str(raw.get("authority_type", "")).upper()
                region = str(raw.get("region", "")).upper()
                wanted = {str(c).upper() for c in raw.get("claim_categories") or []}
                add(raw.get("domain"),
                    kind if kind in fv.AUTHORITY_TYPES else "PUBLIC_AGENCY",
                    region if region in self.region_parent else "UNKNOWN",
                    str(raw.get("market") or self.market).upper(),
                    raw.get("languages") or self.languages,
                    wanted & set(fv.CLAIM_CATEGORIES),
                    int(raw.get("priority", 50) or 50), raw.get("name"))
        for domain in self.authoritative_domains:
            add(domain, "PUBLIC_AGENCY", "UNKNOWN", self.market, self.languages, [], 40,
                None)
        return list(entries.values())

    def registry(self, spark: SparkSession) -> DataFrame:
        return dimension(
            spark, self.registry_rows(),
            "domain string, authority_type string, region string, market string, "
            "languages array<string>, claim_categories array<string>, priority int, "
            "name string")

    def terms(self, spark: SparkSession) -> DataFrame:
        """Every vocabulary list as (vertical, list, ord, term)."""
        lists = {
            "commercial": self.commercial_terms, "comparison": self.comparison_terms,
            "local": self.local_terms, "market": self.market_terms,
            "generic": self.generic_terms, "concept": self.concept_phrases,
            "restricted": self.restricted_claims, "forbidden": self.forbidden_phrases,
            **{f"category:{c}": t for c, t in self.claim_categories.items()},
        }
        rows = [(self.code, name, i, term) for name, terms in lists.items()
                for i, term in enumerate(terms)]
        return dimension(spark, rows, "vertical string, list string, ord int, term string")


def _token_list(terms: Iterable[str], stopwords: Sequence[str]) -> list[str]:
    found: dict[str, None] = {}
    for term in terms:
        found.update(dict.fromkeys(text.local_tokens(term, stopwords)))
    return list(found)


def _overridden(row: tuple, override: dict | None) -> tuple:
    risk, authority, freshness, minimum, rationale = row
    if not isinstance(override, dict):
        return row
    wanted = str(override.get("authority", "")).upper()
    authority = wanted if wanted in fv.AUTHORITY_RANK else authority
    wanted = str(override.get("freshness", "")).upper()
    freshness = wanted if wanted in fv.FRESHNESS_REQUIREMENTS else freshness
    risk = str(override["risk"]).upper() if "risk" in override else risk
    try:
        minimum = max(1, int(override["min_corroborating_sources"]))
    except (KeyError, TypeError, ValueError):
        pass
    return risk, authority, freshness, minimum, override.get("rationale") or rationale


@dataclass(frozen=True)
class Site:
    """One site's configuration document, flattened to what the jobs read."""

    site_id: str
    vertical: str = ""
    market: str = ""
    default_language: str = ""
    supported_languages: tuple[str, ...] = ()
    domain: str | None = None
    staging: bool = True
    locale_paths: dict = field(default_factory=dict)
    canonical_origin: str | None = None
    allow_publication: bool = False
    allow_indexing: bool = False
    consent_required: bool = True
    consent_version: str = "placeholder-v0"
    first_party_events: bool = True
    primary_cta: str | None = None
    primary_cta_label: str | None = None
    secondary_cta: str | None = None
    secondary_cta_label: str | None = None
    fields: tuple[dict, ...] = ()

    @classmethod
    def from_dict(cls, raw: dict) -> "Site":
        flat = dict(raw)
        for block in ("seo", "conversion", "legal", "analytics"):
            flat.update(raw.get(block) or {})
        known = cls.__dataclass_fields__
        return cls(**{k: tuple(v) if isinstance(v, list) else v
                      for k, v in flat.items() if k in known and v is not None})

    @property
    def languages(self) -> list[str]:
        return list(self.supported_languages) or [self.default_language]

    @property
    def is_publishable(self) -> bool:
        return bool(self.domain) and self.allow_publication

    @property
    def is_indexable(self) -> bool:
        return bool(self.domain) and not self.staging and self.allow_indexing

    def form_fields(self, spark: SparkSession) -> DataFrame:
        rows = [
            (f["key"], f.get("type", "text"), bool(f.get("required")),
             [str(o.get("value")) for o in f.get("options") or []],
             _number(f.get("min")), _number(f.get("max")), f.get("pattern"),
             f.get("max_length"))
            for f in self.fields if f.get("key")
        ]
        return dimension(
            spark, rows,
            "key string, kind string, required boolean, options array<string>, "
            "low double, high double, pattern string, max_length int")

    def as_row(self) -> tuple:
        return (self.site_id, self.vertical, self.market, self.default_language,
                list(self.supported_languages), self.domain, self.staging,
                self.canonical_origin, self.allow_publication, self.allow_indexing,
                self.consent_required, dict(self.locale_paths))


SITE_SCHEMA = (
    "site_id string, vertical string, market string, default_language string, "
    "supported_languages array<string>, domain string, staging boolean, "
    "canonical_origin string, allow_publication boolean, allow_indexing boolean, "
    "consent_required boolean, locale_paths map<string,string>"
)


def sites_table(spark: SparkSession, sites: Iterable[Site]) -> DataFrame:
    return dimension(spark, [s.as_row() for s in sites], SITE_SCHEMA)


def _number(value) -> float | None:
    return None if value is None else float(value)


def read_document(path: str | Path) -> dict:
    """A profile document, JSON or (when the library is present) YAML."""
    body = Path(path).read_text(encoding="utf-8")
    if str(path).endswith(".json"):
        return json.loads(body)
    try:
        import yaml
    except ImportError as missing:  # pragma: no cover - depends on the image
        raise RuntimeError("YAML profiles need PyYAML; use JSON instead") from missing
    return yaml.safe_load(body) or {}


def load_profile(path: str | Path) -> Profile:
    return Profile.from_dict(read_document(path))


def load_profiles(spark: SparkSession, path: str | Path) -> dict[str, DataFrame]:
    """All profiles of a folder as one set of dimension tables."""
    profiles = [load_profile(p) for p in sorted(Path(path).iterdir())
                if p.suffix in (".json", ".yaml", ".yml")]
    return profile_tables(spark, profiles)


def profile_tables(spark: SparkSession, profiles: Sequence[Profile]) -> dict[str, DataFrame]:
    tables: dict[str, DataFrame] = {}
    for profile in profiles:
        parts = {"terms": profile.terms(spark)}
        for name in ("policy", "registry", "region_cover"):
            parts[name] = getattr(profile, name)(spark).select(
                F.lit(profile.code).alias("vertical"), "*")
        for name, part in parts.items():
            tables[name] = tables[name].unionByName(part) if name in tables else part
    return tables


def contexts(spark: SparkSession) -> DataFrame:
    """Search contexts per (market, language, device); mobile is its own context."""
    rows = [(m, l, device, code, place, name, domain,
             "android" if device == "mobile" else "windows")
            for m, l, code, place, name, domain in fv.SEARCH_CONTEXTS
            for device in ("desktop", "mobile")]
    return dimension(
        spark, rows,
        "market string, language string, device string, location_code int, "
        "location_name string, language_name string, se_domain string, os string")
