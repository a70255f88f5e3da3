from __future__ import annotations

import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path[:0] = [str(ROOT), str(ROOT / "tools")]

from probatio.profiles import Profile  # noqa: E402
from probatio.session import build_session  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "local[8]", app="tests", shuffle_partitions=4,
        **{"spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false",
           "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse")),
           "spark.checkpoint.dir": str(tmp_path_factory.mktemp("checkpoints"))})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def solar() -> Profile:
    """A small profile for price questions about solar panels."""
    return Profile(
        code="DEMO", market="BE", languages=("fr",), default_language="fr",
        cta_options=({"code": "quote", "label": "q",
                      "intents": ["COMMERCIAL", "TRANSACTIONAL"]},),
        preferred_content_types=("GUIDE", "COMPARISON", "LANDING_PAGE"),
        restricted_claims=("prime", "tva"),
        commercial_terms=("prix", "coût", "tarif", "devis"),
        comparison_terms=("comparatif", "meilleur"),
        local_terms=("wallonie", "namur"), market_terms=("belgique",),
        claim_categories={"SUBSIDY": ["prime", "primes"], "TAX": ["tva", "taux de tva"],
                          "GRID_RULE": ["tarif prosumer", "raccordement"]},
        generic_terms=("prix", "tarif", "solaire", "panneau", "installation", "belgique"),
        concept_phrases=("tarif prosumer", "puissance installee", "retour sur "
                         "investissement"),
        price_policy={"enabled": True, "observed_range_min_sources": 2,
                      "answer_required_intents": ["COMMERCIAL"],
                      "price_query_terms": ["prix"]})


@pytest.fixture(scope="session")
def generic() -> Profile:
    """A second, unrelated vertical that shares no vocabulary with the first."""
    return Profile(
        code="GENERIC", market="FR", languages=("en",), default_language="en",
        commercial_terms=("price", "quote"), comparison_terms=("versus", "best"),
        local_terms=("paris",), community_research_enabled=True,
        keyword_metrics_enabled=False,
        claim_categories={"REGULATION": ["statutory requirement"]})
