"""Every registered query against its SQL twin, and the shape of its plan."""

from __future__ import annotations

import pytest
from check_oracles import compare, connect

import __spark_entry__ as entry
from conftest import SF
from probatio.operators import leads
from probatio.plans import catalog
from probatio.plans.probe import PROFILE, SITE
from probatio.profiles import Profile, Site, load_profiles, read_document

NAMES = sorted(catalog.all_queries())
# These two summarise one constant package: the key folds away and what is left to
# join are single aggregate rows.
ONE_ROW_JOINS = {"confidence_summary", "package_header"}


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, duck, name):
    frame = entry.queries()[name](spark, SF)
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
    assert name in ONE_ROW_JOINS or "BroadcastNestedLoopJoin" not in plan
    outcome = compare(spark, duck, name, SF)
    assert outcome.split()[0] in ("match", "rows"), outcome


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def test_all_queries_have_a_twin():
    assert all(sql for _run, sql in catalog.all_queries().values())


def test_scans_read_only_what_they_need(spark):
    plan = entry.queries()["attribution_counts"](
        spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "o_totalprice" not in plan.split("ReadSchema", 1)[1]
    waiting = spark.createDataFrame([(1, "NEW", 2)], "lead_id int, state string, created_at int")
    few = leads.export_queue(waiting, limit=5)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in few


def test_profiles_load_from_documents(spark, tmp_path):
    (tmp_path / "a.json").write_text(
        '{"code": "A", "market": "BE", "concept_phrases": ["x y"], "authority_policy": '
        '{"TAX": {"authority": "nonsense", "min_corroborating_sources": 0}}, '
        '"official_source_policy": {"domains": ["Flat.be", {"domain": "rich.be", '
        '"region": "BE-WAL", "priority": 70}, {"domain": "flat.be", "priority": 99}]}, '
        '"authoritative_domains": ["rich.be", "old.be"]}')
    tables = load_profiles(spark, tmp_path)
    registry = {r.domain: (r.priority, r.region) for r in tables["registry"].collect()}
    assert registry == {"flat.be": (50, "UNKNOWN"), "rich.be": (70, "BE-WAL"),
                        "old.be": (40, "UNKNOWN")}
    tax = tables["policy"].where("category = 'TAX'").first()
    assert (tax.authority_requirement, tax.min_sources) == ("OFFICIAL", 1)
    assert Profile.from_dict(read_document(tmp_path / "a.json")).phrases == ["x y"]
    assert PROFILE.official_domains[0] == "example.net" and SITE.is_indexable
    assert not Site.from_dict({"site_id": "s", "staging": True, "domain": "x.be",
                               "seo": {"allow_indexing": True}}).is_indexable
