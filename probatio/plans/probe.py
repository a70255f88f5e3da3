"""A profile whose vocabulary occurs in the invented prose of the driver tables.

The tables contain no real words about any vertical, so every list below was
picked from tokens that do occur in them.  It exercises each branch of the jobs;
it says nothing about any market.
"""

from __future__ import annotations

from probatio.profiles import Profile, Site

PROFILE = Profile(
    code="PROBE",
    market="BE",
    languages=("en", "fr", "de", "es"),
    default_language="en",
    target_audience="readers of invented prose",
    business_objective="exercise every rule",
    cta_options=(
        {"code": "quote", "label": "Ask for a quote",
         "intents": ["COMMERCIAL", "TRANSACTIONAL"]},
        {"code": "callback", "label": "Be called back",
         "intents": ["COMMERCIAL", "TRANSACTIONAL", "LOCAL"]},
        {"code": "guide", "label": "Get the guide", "intents": ["INFORMATIONAL"]},
    ),
    preferred_content_types=("GUIDE", "COMPARISON", "LANDING_PAGE", "ARTICLE"),
    restricted_claims=("tion", "thanedble", "onheer"),
    forbidden_phrases=("anea eriner", "ndnd onre"),
    commercial_terms=("that", "this", "tion"),
    comparison_terms=("from", "thre"),
    local_terms=("thes", "erin"),
    market_terms=("was", "der"),
    claim_categories={
        "SUBSIDY": ["thanedble", "theaeati ingre"],
        "TAX": ["onbleea", "inin"],
        "REGULATION": ["therble"],
        "GRID_RULE": ["onanshat", "esndha reedes"],
        "ELIGIBILITY": ["atshsh erin"],
        "ROI": ["therhean", "hein"],
        "MARKET_AVERAGE": ["eriner"],
        "VENDOR_PRICE": ["attion"],
        "PRODUCT_SPEC": ["thor", "thea"],
    },
    authority_policy={
        "SUBSIDY": {"authority": "OFFICIAL", "freshness": "NOT_REQUIRED",
                    "min_corroborating_sources": 2},
        "MARKET_AVERAGE": {"authority": "ANY", "min_corroborating_sources": 4},
        "PRODUCT_SPEC": {"authority": "SPECIALIST", "min_corroborating_sources": "two"},
        "GENERAL": {"authority": "COMMERCIAL_ONLY", "min_corroborating_sources": 2},
    },
    official_source_policy={
        "enabled": True,
        "max_queries": 5,
        "domains": [
            {"domain": "example.net", "authority_type": "GOVERNMENT",
             "region": "BE-WAL", "priority": 90,
             "claim_categories": ["SUBSIDY", "TAX", "ROI"]},
            {"domain": "src1.example.com", "authority_type": "REGULATOR",
             "region": "BE-BRU", "priority": 95, "claim_categories": ["GRID_RULE"]},
            {"domain": "src2.example.com", "authority_type": "GRID_OPERATOR",
             "region": "BE", "priority": 95},
            "src3.example.com",
        ],
        "query_templates": {
            "SUBSIDY": "{topic} support in {market}",
            "SUBSIDY_VLG": "steun voorwaarden",
            "GRID_RULE": "grid rule {topic}",
            "TAX": "tax rate {topic} {category}",
            "ROI": "grid rule {topic}",
            "MARKET_PRICE": "{topic} reference price {market}",
        },
    },
    authoritative_domains=("src4.example.com", "src1.example.com"),
    price_policy={
        "enabled": True, "observed_range_min_sources": 2,
        "answer_required_intents": ["COMMERCIAL", "TRANSACTIONAL"],
        "price_query_terms": ["tion", "ing"],
    },
    generic_terms=("the", "and", "that", "with", "this", "for", "from", "was"),
    concept_phrases=(
        "and attion", "attion to", "anea eriner", "eriner thanea", "to thanedble",
        "thanedble the", "in onbleea", "onbleea of", "ofonrereer thndly",
        "thndly thtithly", "eswher thintion", "der die",
    ),
    region_terms={
        "BE-WAL": ("thth", "theaeati"),
        "BE-BRU": ("thhe", "der die"),
        "BE-VLG": ("thha",),
        "BE": ("that", "que"),
    },
)

SITE = Site(
    site_id="probe", vertical="PROBE", market="BE", default_language="fr",
    supported_languages=("fr", "nl"), domain="probe.example.com", staging=False,
    locale_paths={"fr": "", "nl": "/nl"}, canonical_origin="https://probe.example.com",
    allow_publication=True, allow_indexing=True, consent_version="v1",
    primary_cta="ESTIMATE_REQUEST", primary_cta_label="Estimate",
    secondary_cta="CALLBACK_REQUEST", secondary_cta_label="Call back",
    fields=(
        {"key": "owner_status", "type": "choice", "required": True,
         "options": [{"value": "HOUSEHOLD"}, {"value": "BUILDING"},
                     {"value": "FURNITURE"}]},
        {"key": "postcode", "type": "postcode", "required": True,
         "pattern": "^[1-9][0-9]{3}$"},
        {"key": "balance", "type": "number", "min": 0, "max": 5000},
        {"key": "first_name", "type": "text", "max_length": 12},
        {"key": "email", "type": "email", "required": True},
        {"key": "consent_processing", "type": "consent", "required": True},
    ),
)
