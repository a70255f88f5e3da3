"""Gate, categories, matching, verdicts and prices on small golden rows."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from probatio.operators import (classify, evidence, gate, matching, passages, prices,
                                serp, usage)

QUERY = "prix panneaux solaires Belgique"


def gate_one(spark, solar, title, body="", url=None):
    queries = spark.createDataFrame([(1, QUERY)], "package_id int, query string")
    sources = spark.createDataFrame([(1, title, body, url)],
                                    "package_id int, title string, body string, url string")
    return gate.gate_sources(sources, gate.query_profile(queries, solar)).first()


def test_query_profile_splits_tokens(spark, solar):
    row = gate.query_profile(spark.createDataFrame([(1, QUERY)], "package_id int, "
                                                   "query string"), solar).first()
    assert row.topic_tokens == ["panneau", "solaire"]
    assert row.modifier_tokens == ["prix"] and row.market_tokens == ["belgique"]


@pytest.mark.parametrize("title, body, url, status", [
    ("Grand Prix Circuit game modification", "", None, "IRRELEVANT"),
    ("Le panneau solaire résidentiel", "panneau solaire prix", None, "RELEVANT"),
    ("Nos tarifs", "", "https://panneaux-solaires-belgique.be/tarifs", "LOW_RELEVANCE"),
    ("Belgian waffles", "recette de gaufres belges", None, "IRRELEVANT")])
def test_gate_golden(spark, solar, title, body, url, status):
    row = gate_one(spark, solar, title, body, url)
    assert row.relevance_status == status
    if "Grand Prix" in title:
        assert row.relevance_reason.endswith("this source matched only prix.")


def test_gate_needs_a_topic(spark, solar):
    queries = spark.createDataFrame([(1, "prix belgique")], "package_id int, query string")
    sources = spark.createDataFrame([(1, "panneau", "", None)],
                                    "package_id int, title string, body string, url string")
    row = gate.gate_sources(sources, gate.query_profile(queries, solar)).first()
    assert (row.relevance_status, row.relevance_score) == ("UNKNOWN", 0.0)


def test_review_moves_only_the_middle_and_survives_errors(spark):
    rows = spark.createDataFrame(
        [(1, "RELEVANT", 0.7, "r"), (2, "LOW_RELEVANCE", 0.4, "l"),
         (3, "LOW_RELEVANCE", 0.5, "l"), (4, "IRRELEVANT", 0.0, "i")],
        "id int, relevance_status string, relevance_score double, relevance_reason string")

    def review(batch):
        return batch.assign(verdict=["RELEVANT" if i % 2 == 0 else "IRRELEVANT"
                                     for i in batch["id"]], verdict_reason="why")

    def broken(batch):
        raise ValueError("model down")

    moved = {r.id: (r.relevance_status, r.relevance_score)
             for r in gate.review_ambiguous(rows, review).collect()}
    assert moved == {1: ("RELEVANT", 0.7), 2: ("RELEVANT", 0.6), 3: ("IRRELEVANT", 0.2),
                     4: ("IRRELEVANT", 0.0)}
    kept = gate.review_ambiguous(rows, broken).drop("relevance_stage")
    assert sorted(kept.collect()) == sorted(rows.collect())


CATEGORIES = [
    ("La prime régionale s'élève à 1 750 € en Wallonie.", "SUBSIDY"),
    ("Le taux de TVA applicable est de 6%.", "TAX"),
    ("Entre 4.000 € et 14.000 € TVAC pour une installation de 3 à 10 kWc.",
     "OBSERVED_PRICE_RANGE"),
    ("Le rendement est garanti pendant 25 ans.", "GUARANTEED_SAVINGS"),
    ("Nos tarifs pour 5 kWc sont de 4 400 €.", "VENDOR_PRICE"),
    ("Le prix moyen d'une installation est de 5 000 €", "MARKET_AVERAGE"),
    ("Les panneaux se posent au sud.", "GENERAL"),
    ("Une onduleur de bonne valeur.", "MARKET_PRICE")]


def test_category_golden(spark, solar):
    rows = spark.createDataFrame([(t,) for t, _ in CATEGORIES], "t string")
    got = {r.t: r.category for r in classify.with_category(rows, "t", solar).collect()}
    assert got == dict(CATEGORIES)


def test_second_vertical_uses_its_own_words(spark, generic):
    rows = spark.createDataFrame([("A statutory requirement applies.",)], "t string")
    assert classify.with_category(rows, "t", generic).first().category == "REGULATION"
    queries = spark.createDataFrame([("how it works",), ("best price",)], "query string")
    plans = classify.provider_plan(classify.classify_queries(queries, generic), generic)
    assert {r.query: (r.intent, r.community, r.keyword_metrics) for r in plans.collect()} \
        == {"how it works": ("INFORMATIONAL", True, False),
            "best price": ("COMMERCIAL", False, False)}


PAGE = """Aller au contenu

Accepter les cookies

ChatGPT Claude Perplexity

# Une installation photovoltaïque de 5 kWc coûte environ 6 500 € TVAC en Belgique. Elle dure 25 ans.

4.400 € 625 €/an 7 ans 5 kWc 12 % 3 000 € 10 kWc 9 000 €"""


def test_passages_drop_furniture_with_a_reason(spark):
    rows = spark.createDataFrame([(1, "s", PAGE)],
                                 "package_id int, source_ref string, body string")
    got = [(r.drop_reason, r.passage[:20]) for r in passages.passages(rows).orderBy(
        "block_ord").collect()]
    assert [g[0] for g in got] == ["too_short", "too_short", "too_short", None,
                                   "low_alpha_ratio"]
    assert got[3][1] == "Une installation pho"
    claims = passages.claims(passages.kept_passages(rows)).collect()
    assert [(c.claim_ord, c.quantified) for c in claims] == [(0, True)]


# ----------------------------------------------------------------- matching --
def pair(spark, solar, claim, passage, claim_category=None, claim_region=None):
    claims = matching.concepts(spark.createDataFrame(
        [(1, "c", claim)], "package_id int, claim_id string, claim string"), "claim", solar)
    found = matching.concepts(spark.createDataFrame(
        [(1, "s", 0, passage)],
        "package_id int, source_ref string, passage_ord int, passage string"),
        "passage", solar)
    if claim_category:
        claims = claims.withColumn("category", F.lit(claim_category))
    pairs = claims.select("package_id", "claim_id").join(
        found.select("package_id", "source_ref", "passage_ord"), "package_id")
    row = matching.match_pairs(pairs, claims, found, solar).first()
    return row.supports, row.agrees, row.reasons


@pytest.mark.parametrize("claim, passage, supports, agrees, reason", [
    ("Le tarif prosumer dépend de la puissance de l'onduleur.",
     "Le prix moyen d'une installation solaire dépend de la marque choisie.", False, None,
     "CATEGORY_MISMATCH"),
    ("La prime de Bruxelles couvre la moitié du montant.",
     "La prime en Wallonie couvre la moitié du montant.", False, None, "REGION_MISMATCH"),
    ("Une batterie domestique moderne vaut 100 €.",
     "Une batterie domestique moderne vaut 100 €.", True, True, "NUMERIC_AGREES"),
    ("Une batterie domestique moderne vaut 100 €.",
     "Une batterie domestique moderne vaut 250 €.", False, False, "NUMERIC_DISAGREES"),
    ("Une batterie domestique moderne vaut 5000 €.",
     "Une batterie domestique moderne, prix en € selon modele, vaut 5 ans.", False, None,
     "NUMERIC_TYPE_MISMATCH")])
def test_match_golden(spark, solar, claim, passage, supports, agrees, reason):
    got = pair(spark, solar, claim, passage)
    assert got[:2] == (supports, agrees) and reason in got[2]


def test_vendor_passage_is_no_market_average(spark, solar):
    got = pair(spark, solar, "Le prix moyen est de 5 000 €", "Nos tarifs sont de 5 000 €")
    assert got == (False, None, ["CATEGORY_MISMATCH"])


def test_blocking_loses_no_pair(spark, solar):
    """Random texts with figures, phrases and regions: index against all pairs."""
    rng = random.Random(11)
    words = ["tarif prosumer", "batterie", "onduleur", "garantie", "toiture", "puissance",
             "cable", "rendement", "wallonie", "bruxelles", "100 €", "250 €", "5 ans",
             "20 %", "puissance installee", "prime", "compteur", "digital", "classs"]

    def sentence(n):
        return " ".join(rng.choice(words) for _ in range(n)) + "."

    claims = matching.concepts(spark.createDataFrame(
        [(i % 2, str(i), sentence(rng.randint(1, 8))) for i in range(60)],
        "package_id int, claim_id string, claim string"), "claim", solar).cache()
    found = matching.concepts(spark.createDataFrame(
        [(i % 2, str(i // 4), i % 4, sentence(rng.randint(3, 20))) for i in range(160)],
        "package_id int, source_ref string, passage_ord int, passage string"),
        "passage", solar).cache()
    every = claims.select("package_id", "claim_id").join(
        found.select("package_id", "source_ref", "passage_ord"), "package_id")
    matters = "supports or agrees is not null"
    brute = matching.match_pairs(every, claims, found, solar).where(matters)
    blocked = matching.match(claims, found, solar).where(matters)
    expected, got = sorted(brute.collect()), sorted(blocked.collect())
    assert expected == got and len(expected) > 100
    assert any(r.agrees is False for r in got) and any(r.agrees for r in got)


def test_first_passage_speaks_without_support(spark):
    rows = spark.createDataFrame(
        [(1, "a", "s", 0, False, False), (1, "a", "s", 1, False, None),
         (1, "a", "t", 1, False, False), (1, "a", "u", 0, False, False),
         (1, "a", "u", 2, True, True), (1, "b", "s", 0, False, None)],
        "package_id int, claim_id string, source_ref string, passage_ord int, "
        "supports boolean, agrees boolean").withColumns({
            "score": F.lit(0.7), "reasons": F.array(F.lit("x"))})
    got = {(r.claim_id, r.source_ref): (r.passage_ord, r.supports)
           for r in evidence.best_passages(rows).collect()}
    assert got == {("a", "s"): (0, False), ("a", "u"): (2, True)}


# ----------------------------------------------------------------- verdicts --
def verdict(spark, solar, refs, risk="LOW", authority="ANY", fresh="NOT_REQUIRED",
            minimum=1, region="BE"):
    claims = spark.createDataFrame(
        [(1, "c", region, "SUBSIDY", risk, authority, fresh, minimum, "Why.")],
        "package_id int, claim_id string, claim_region string, category string, "
        "risk string, authority_requirement string, freshness_requirement string, "
        "min_sources int, rationale string")
    rows = spark.createDataFrame(
        [(1, "c", f"s{i}", i, *r) for i, r in enumerate(refs)],
        "package_id int, claim_id string, source_ref string, source_ord int, "
        "supports boolean, conflict_kind string, source_quality string, "
        "source_region string, freshness_status string").withColumn(
            "observation_status", F.lit("ESTIMATED"))
    row = evidence.verdicts(claims, rows, solar).first()
    return row.evidence_status, row.reason


GOOD = (True, None, "OFFICIAL", "UNKNOWN", "DATED_CURRENT")
SHOP = (True, None, "COMMERCIAL", "UNKNOWN", "UNDATED")
CLASH = (False, "TRUE_CONFLICT", "COMMERCIAL", "UNKNOWN", "UNDATED")
LATER = (False, "TIME_DIFFERENCE", "COMMERCIAL", "UNKNOWN", "UNDATED")


@pytest.mark.parametrize("refs, rules, status, words", [
    ([], {}, "UNSUPPORTED", "No eligible passage"),
    ([LATER], {}, "UNSUPPORTED", "differ, but only by TIME_DIFFERENCE"),
    ([CLASH], {}, "CONFLICTING", "1 eligible source(s)"),
    ([GOOD, CLASH], {}, "CONFLICTING", "1 source(s) support"),
    ([(True, None, "OFFICIAL", "BE-WAL", "DATED_CURRENT")], {"risk": "HIGH"},
     "UNSUPPORTED", "BE-WAL evidence cannot establish a BE-wide claim"),
    ([(True, None, "OFFICIAL", "BE", "DATED_CURRENT")],
     {"risk": "HIGH", "region": "BE-WAL"}, "SUPPORTED", "scoped BE-WAL"),
    ([SHOP], {"authority": "OFFICIAL"}, "UNSUPPORTED", "best supporting source is COMM"),
    ([SHOP], {"minimum": 2}, "PARTIALLY_SUPPORTED", "need 2 independent"),
    ([GOOD], {"minimum": 2}, "SUPPORTED", "1 OFFICIAL"),
    ([SHOP], {"fresh": "REQUIRED"}, "PARTIALLY_SUPPORTED", "no supporting source is dated"),
    ([(True, None, "OFFICIAL", "UNKNOWN", "HISTORICAL")], {"fresh": "REQUIRED"},
     "PARTIALLY_SUPPORTED", "source is HISTORICAL"),
    ([GOOD, SHOP], {"fresh": "REQUIRED"}, "SUPPORTED", "(DATED_CURRENT, scoped BE)")])
def test_verdict_ladder(spark, solar, refs, rules, status, words):
    got = verdict(spark, solar, refs, **rules)
    assert got[0] == status and words in got[1]


# ------------------------------------------------------------------- prices --
RANGE = ["Entre 4.000 € et 14.000 € TVAC pour une installation de 3 à 10 kWc, pose comprise.",
         "Une installation standard de 5 kWc coûte environ 6.500 € à 8.500 € TVAC, pose "
         "comprise."]


def observed(spark, texts):
    rows = spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)],
                                 "package_id int, obs_ord int, t string")
    return prices.observed_range(prices.price_contexts(rows, "t")).first()


def test_observed_range_golden(spark):
    row = observed(spark, RANGE)
    assert (row.low, row.high, row.basis, row.vat_status, row.observation_count,
            row.installation_included, row.battery_included) == (
                4000, 14000, "TOTAL", "INCLUDED", 2, True, None)


@pytest.mark.parametrize("texts", [
    ["1 300 € par kWc", "6 500 € pour une installation"],
    ["6 500 € TVAC pour une installation", "6 500 € HTVA pour une installation"],
    ["6 500 € pour une installation"], ["6 500 €", "7 000 €"]])
def test_no_range_over_what_is_not_comparable(spark, texts):
    assert observed(spark, texts) is None


def test_price_per_square_metre(spark):
    rows = spark.createDataFrame([("130 € par m² en 2024",), ("1,50 € /m2",)], "t string")
    got = [(r.price.basis, r.price.amounts) for r in prices.price_contexts(
        rows, "t").collect()]
    assert got == [("PER_M2", [130]), ("PER_M2", [150])]


def test_opportunity_score_golden(spark, solar):
    row = serp.opportunity_score(spark.createDataFrame(
        [("COMMERCIAL", 0.9, 10, 8, 2, 1, 1000.0, 40.0, 5)],
        "intent string, topic_alignment double, organic_count int, distinct_domains int, "
        "feature_count int, gap_count int, search_volume double, competition_index double, "
        "eligible_count int"), solar).first()
    assert row.overall_score == 72 and row.confidence == pytest.approx(1.0)


def test_unpriced_job_has_unknown_cost(spark):
    rows = spark.createDataFrame(
        [("a", "p", "o", 1, None, None, False), ("b", "p", "o", 1, None, 0.002, True),
         ("b", "q", "o", 1, None, None, False)],
        "correlation_id string, provider string, operation string, requests int, "
        "units int, cost_usd double, cost_is_actual boolean")
    got = {r.correlation_id: (r.total_cost_usd, r.priced_events, r.unpriced_events)
           for r in usage.job_totals(rows).collect()}
    assert got == {"a": (None, 0, 1), "b": (0.002, 1, 1)}


def test_nothing_is_cut_beyond_the_old_limits(spark):
    """More claims, longer claims, more qualification keys and more list items than once fitted."""
    from probatio.functions import contacts
    from probatio.operators import funnel, passages, sections

    sentence = "Le prix moyen constaté est de {} € pour une installation de panneaux solaires"
    body = ". ".join(sentence.format(1000 + n) for n in range(12)) + "."
    kept = spark.createDataFrame([("p", body)], "package_id string, passage string")
    assert passages.claims(kept).count() == 12
    tail = " et " + "bien " * 80
    claims = spark.createDataFrame(
        [("p", n, "Même début " + "long " * 60 + tail + str(n)) for n in range(3)],
        "package_id string, claim_ord int, claim string")
    assert passages.dedupe_claims(claims, ["claim_ord"]).count() == 3
    events = spark.createDataFrame(
        [("FORM_STARTED", {f"{'k' * 50}{n}": "v" * 500 for n in range(20)})],
        "event_type string, detail map<string,string>")
    detail = funnel.validate_events(events).first().detail
    assert len(detail) == 20 and {len(v) for v in detail.values()} == {500}
    assert spark.createDataFrame([("x" * 999,)], "v string").select(
        contacts.clean(F.col("v")).alias("v")).first().v == "x" * 999
    draft = spark.createDataFrame(
        [(1, "# T\n\n" + "\n".join(f"- item {n}" for n in range(70)) + "".join(
            f"\n\nParagraphe {n}." for n in range(80)))], "draft_id int, body string")
    found = sections.sections(draft).collect()
    assert max(len(r["items"] or []) for r in found) == 70 and len(found) >= 81


def test_few_claims_are_met_beside_the_passages(spark, solar, monkeypatch):
    """Neither way loses or doubles a pair, and only the join on keys shuffles passages."""
    said = ["Le tarif prosumer coute 100 € en wallonie", "la garantie onduleur dure 5 ans",
            "puissance installee batterie toiture cable", "compteur digital prime",
            "onduleur batterie neuve maison verte"]
    claims = matching.concepts(spark.createDataFrame(
        [(1, str(i), c) for i, c in enumerate(said)],
        "package_id int, claim_id string, claim string"), "claim", solar).cache()
    found = matching.concepts(spark.createDataFrame(
        [(1, str(i), i % 2, f"{said[i % 4]} texte{i} {said[i * 7 % 4]}.") for i in range(700)],
        "package_id int, source_ref string, passage_ord int, passage string"),
        "passage", solar).cache()

    def rows(refused):
        return sorted(map(str, matching.match(claims, found, solar, refused).collect()))

    beside, met = rows(True), rows(False)
    monkeypatch.setattr(matching, "_postings", None)
    assert rows(True) == beside
    monkeypatch.undo()
    monkeypatch.setattr(matching, "FEW_CLAIMS", 0)
    assert rows(True) == beside and rows(False) == met
    assert len(set(beside)) == len(beside) >= len(met) >= 700


def test_only_pairs_that_may_matter_are_shuffled(spark, solar):
    """Random texts: what shares too little goes inside the join, and no match with it."""
    rng = random.Random(7)
    words = ["tarif prosumer", "batteries", "onduleur", "garantie", "toiture", "puissance",
             "cables", "rendement", "wallonie", "100 €", "5 ans", "puissance installee",
             "compteur", "digital", "classs", "maison", "vert", "neuf", "chantiers", "reseau"]

    def sentence(n):
        return " ".join(rng.choice(words) for _ in range(n)) + "."

    claims = matching.concepts(spark.createDataFrame(
        [(i % 2, str(i), sentence(rng.randint(1, 9))) for i in range(120)],
        "package_id int, claim_id string, claim string"), "claim", solar).cache()
    found = matching.concepts(spark.createDataFrame(
        [(i % 2, str(i // 4), i % 4, sentence(rng.randint(2, 12))) for i in range(240)],
        "package_id int, source_ref string, passage_ord int, passage string"),
        "passage", solar).cache()
    ids = ["package_id", "claim_id", "source_ref", "passage_ord"]
    every = claims.select("package_id", "claim_id").join(
        found.select("package_id", "source_ref", "passage_ord"), "package_id")
    brute = matching.match_pairs(every, claims, found, solar, refused=False)
    met = matching.candidates(claims, found, solar)
    kept = matching.candidates(claims, found, solar, refused=False)
    matched = {tuple(r) for r in brute.select(*ids).collect()}
    pairs = [tuple(r) for r in kept.collect()]
    assert len(pairs) == len(set(pairs)) and matched <= set(pairs)
    assert len(pairs) * 1.5 < met.count()
