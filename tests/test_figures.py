"""Figures of claims and passages: agreement, disagreement and what follows from them."""

from __future__ import annotations

from pyspark.sql import functions as F

from conftest import SF
from probatio import fixed_values as fv
from probatio.operators import (classify, evidence, matching, package, prices as prices_of,
                                research)
from probatio.plans.catalog import offers
from probatio.plans.evidence_run import EvidenceRun
from probatio.functions import prices, text
from probatio.plans.probe import PROFILE
from probatio.sources import sinks


def test_every_numeric_branch_occurs(spark):
    """All reasons, conflict kinds and both CONFLICTING rungs have rows on the tables."""
    run = offers._run(spark, SF)
    reasons = {r for (rs,) in run.matches.select("reasons").distinct().collect() for r in rs}
    assert {"NUMERIC_AGREES", "NUMERIC_DISAGREES", "NUMERIC_TYPE_MISMATCH",
            "MATCHED_HEAD_CONCEPT", "MATCHED_TOPIC_TERMS"} <= reasons
    kinds = {k for (k,) in run.references.select("conflict_kind").distinct().collect()}
    assert {None, "TRUE_CONFLICT", "REGIONAL_DIFFERENCE", "SCOPE_DIFFERENCE",
            "TIME_DIFFERENCE"} <= kinds
    judged = run.evaluated.select("evidence_status", F.col("corroborating_sources") > 0).distinct()
    found = {tuple(r) for r in judged.collect()}
    assert {("CONFLICTING", True), ("CONFLICTING", False), ("SUPPORTED", True),
            ("UNSUPPORTED", False)} <= found
    disagreeing = run.references.where("not agrees")
    assert disagreeing.count() > 0 and disagreeing.where("supports").count() == 0


CLAIM = "package_id int, claim_id string, claim string"
PASSAGE = "package_id int, source_ref string, passage_ord int, passage string, region string"


def test_a_term_in_half_of_all_passages_is_spread(spark, monkeypatch):
    """Only hot keys are repeated, and no pair is lost or doubled."""
    claims = matching.concepts(spark.createDataFrame(
        [(1, f"c{i}", f"Le module solaire numero{i} coute 100 euros par panneau pose")
         for i in range(6)], CLAIM), "claim", PROFILE)
    passages = matching.concepts(spark.createDataFrame(
        [(1, f"s{i}", 0, f"Le module solaire numero{i % 6} coute {100 + i % 3} euros par panneau "
          "pose" if i % 2 else f"autre phrase mot{i} texte{i} sans rapport", "UNKNOWN")
         for i in range(300)], PASSAGE), "passage", PROFILE)
    pairs = matching.candidates(claims, passages, PROFILE)
    found = [tuple(r) for r in pairs.collect()]
    assert len(found) == len(set(found))
    every = claims.select("package_id", "claim_id").join(
        passages.select("package_id", "source_ref", "passage_ord"), "package_id")
    wanted = {tuple(r)[:4] for r in matching.match_pairs(every, claims, passages, PROFILE).where(
        "supports or agrees is not null").collect()}
    assert wanted and wanted <= set(found)
    counts = matching._postings(passages).groupBy("package_id", "key").agg(
        F.count("*").alias("passages"))
    hot = {r.key: r._parts for r in matching.hot_keys(counts).collect()}
    total = counts.agg(F.sum("passages")).first()[0]
    sizes = {r.key: r.passages for r in counts.collect()}
    assert hot and all(parts == -(-sizes[k] * 1000 // total) for k, parts in hot.items())
    assert all(n * 1000 <= total for k, n in sizes.items() if k not in hot)


def test_spread_of_figures(spark):
    rows = matching.concepts(spark.createDataFrame(
        [(1, s, n, text, "UNKNOWN") for s, n, text in [
            ("a", 0, "Cela coute 100 €"), ("a", 1, "ou bien 120 € ailleurs"), ("b", 0, "prix 100 €"),
            ("c", 0, "prix 130 €"), ("d", 0, "garanti 10 ans")]], PASSAGE), "passage", PROFILE)
    asked = matching.concepts(spark.createDataFrame(
        [(1, "x", "vaut 100 €"), (1, "y", "vaut 999 €"), (2, "z", "vaut 100 €")], CLAIM),
        "claim", PROFILE)
    got = {(r.claim_id, r.type, r.digits): (r.same_sources, r.other_sources, r.other_values)
           for r in matching.figure_spread(asked, rows).collect()}
    assert got == {("x", "MONEY", "100"): (2, 2, 2), ("y", "MONEY", "999"): (0, 3, 3),
                   ("z", "MONEY", "100"): (0, 0, 0)}


def test_price_gap_asks_for_better_sources(spark):
    rows = [(1, "a", "MARKET_PRICE", "LOW", "UNSUPPORTED"), (1, "b", "GENERAL", "LOW", "UNSUPPORTED"),
            (1, "c", "TAX", "HIGH", "CONFLICTING"), (2, "d", "MARKET_PRICE", "LOW", "UNSUPPORTED"),
            (1, "e", "MARKET_PRICE", "LOW", "SUPPORTED")]
    evaluated = spark.createDataFrame(
        rows, "package_id int, claim_id string, category string, risk string, evidence_status string")
    gaps = spark.createDataFrame([(1,), (1,)], "package_id int")
    found = evidence.blocked_claims(evaluated, gaps)
    assert sorted(r.claim_id for r in found.collect()) == ["a", "c"]


def test_official_pass_reads_changed_packages_only(spark):
    packages = spark.createDataFrame([(1, 4), (2, 1), (3, 1)], "package_id int, version int")
    source = ("package_id int, source_ref string, source_ord string, title string, body string, "
              "url string, source_type string, published_at timestamp")
    web = spark.createDataFrame([(p, f"w{p}", "1", "", "solar price", "https://a.be", "web", None)
                                 for p in (1, 2, 3)], source)
    official = spark.createDataFrame(
        [(1, "o1", "2", "", "solar panels price", "https://b.be", "web", None),
         (1, "o2", "3", "", "nothing of it", "https://b.be", "web", None),
         (2, "o3", "4", "", "solar price", "https://b.be", "web", None)], source).withColumn(
        "accepted", F.col("package_id") == 1)
    profiles = spark.createDataFrame([(p, ["solar"], []) for p in (1, 2, 3)],
                                     "package_id int, topic_tokens array<string>, "
                                     "modifier_tokens array<string>")
    seen = []

    def evaluate(sources, mine):
        seen.extend((r.package_id, r.source_ref) for r in sources.collect())
        return mine.withColumn("evidence_status", F.lit("NEW"))

    stored = packages.select("package_id", F.lit("OLD").alias("evidence_status"))
    got = research.official_pass(packages, stored, web, official, profiles, evaluate)
    assert sorted(tuple(r) for r in got.select(
        "package_id", "evidence_status", "version", "supersedes").collect()) == [
        (1, "NEW", 5, 4), (2, "OLD", 1, None), (3, "OLD", 1, None)]
    assert sorted(seen) == [(1, "o1"), (1, "w1")]


def test_audit_reads_each_table_once(spark):
    rows = spark.createDataFrame(
        [("MEASURED", None, "v", None, 1.0, None), ("OBSERVED", "p", "v", 1, None, None),
         (None, "p", None, 1, None, "x")],
        "observability string, provider string, metric_type string, retrieved_at int, "
        "value double, value_text string")
    found = sinks.audit({"keyword_metric": rows, "seo_opportunity": spark.createDataFrame(
        [(101.0,), (None,), (-1.0,), (100.0,)], "overall_score double")})
    assert sorted(((r.table, r.rule, r.key, r.value, r.rows) for r in found.collect()), key=str) == sorted([
        ("keyword_metric", "CHECK", "observability", "MEASURED", 1),
        ("keyword_metric", "CHECK", "observability", None, 1),
        ("keyword_metric", "NOT NULL", "provider", None, 1),
        ("keyword_metric", "NOT NULL", "metric_type", None, 1),
        ("keyword_metric", "NOT NULL", "retrieved_at", None, 1),
        ("keyword_metric", "TOGETHER", "metric_without_value", "NULL|NULL", 1),
        ("seo_opportunity", "RANGE", "overall_score", "101.0", 1),
        ("seo_opportunity", "RANGE", "overall_score", "-1.0", 1)], key=str)
    plan = sinks.audit({"keyword_metric": rows})._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") <= 1


def test_prices_are_shown_as_readers_write_them(spark):
    rows = spark.createDataFrame(
        [([9.999, 12345.5], "EUR", True), ([1234567.0], "CHF", False), ([0.5], None, False),
         ([], "EUR", False), (None, None, None)],
        "amounts array<double>, currency string, is_range boolean")
    got = [r[0] for r in rows.select(prices.shown_price(F.struct("*"))).collect()]
    assert got == ["10 € – 12 346 €", "1 234 567 CHF", "0,5 €", "—", "—"]
    sizes = spark.createDataFrame([([5.0],), ([3.5, 10.0],), ([],), (None,)], "s array<double>")
    assert [r[0] for r in sizes.select(prices.shown_size(F.col("s"))).collect()] == [
        "5 kWc", "3.5–10 kWc", None, None]


def test_an_amount_of_money_is_no_year(spark):
    rows = spark.createDataFrame([
        ("Comptez 2098 € en 2001.", "Comptez 2098 € en 2003."),
        ("Prix de $2050 en 2001.", "Prix de 2050 euros en 2001."),
        ("Prix 10 € en 2001.", "Prix 11 € en 2001.")], "a string, b string")
    kinds = [r[0] for r in rows.select(classify.conflict_kind(
        F.col("a"), F.col("b"), F.lit("UNKNOWN"), F.lit("UNKNOWN"), PROFILE)).collect()]
    assert kinds == ["TIME_DIFFERENCE", "TRUE_CONFLICT", "TRUE_CONFLICT"]
    read = rows.select(classify.years(F.col("a")), classify.years(F.col("b"))).collect()
    assert [tuple(r) for r in read] == [([2001], [2003]), ([2001], [2001]), ([2001], [2001])]


def test_mean_relevance_does_not_depend_on_the_order_of_rows(spark):
    scores = [0.1, 0.7, 0.2, 0.3, 0.6, 0.100001, 0.3, 0.400001] * 5
    means = set()
    for values in (scores, scores[::-1], sorted(scores)):
        rows = spark.createDataFrame([(0, v) for v in values], "package_id int, s double")
        means.add(rows.coalesce(1).groupBy("package_id").agg(package._mean("s").alias("m")).first().m)
    assert means == {0.33750025}


def test_small_packages_are_compared_whole(spark, monkeypatch):
    """Offers have few pairs a package, so no key is looked up; what counts stays the same."""
    run = offers._run(spark, SF)
    matters = "supports or agrees is not null"

    def rows():
        found = matching.match(run.claims, run.passages, PROFILE).where(matters)
        return sorted(map(str, found.collect()))

    monkeypatch.setattr(matching, "SMALL_PACKAGE", 0)
    indexed = rows()
    monkeypatch.setattr(matching, "SMALL_PACKAGE", 100)  # some packages are above
    mixed = rows()
    monkeypatch.undo()
    monkeypatch.setattr(matching, "candidates", None)
    assert indexed and rows() == indexed == mixed


def test_sources_are_read_once_for_dimensions_and_passages(spark):
    """The region of a passage comes along with it; no join moves the text."""
    run = offers._run(spark, SF)
    assert run._described.columns[-1] == "body" and "body" not in run.sources.columns
    homes = {(r.package_id, r.source_ref): r.region for r in run.sources.collect()}
    assert {homes[r.package_id, r.source_ref] == r.region for r in run.passages.collect()} == {True}


def test_searched_pieces_lose_no_date_and_no_outcome(spark):
    said = [("mise à jour le 12/03/2024", "updated"), ("LAST UPDATED: 2024-01-02", "updated"),
            ("laatst bijgewerkt 1.2.2023", "updated"), ("à partir du 01/02/2024", "since"),
            ("Depuis le 3 mars 2024", "since"), ("effective from 2024-01-01", "since"),
            ("vanaf 01-02-2024", "since"), ("jusqu'au 31/12/2023", "until"),
            ("valable jusqu'à 1 mai 2023", "until"), ("until 2023-01-01", "until"),
            ("tot en met 01/02/2023", "until"), ("en vigueur à partir du 1/2/2024", "since")]
    rows = text.once(spark.createDataFrame(said, "body string, kind string").withColumn(
        "published_at", F.lit(None).cast("timestamp")), n=text.normalise(F.col("body")))
    patterns = {"updated": (fv.UPDATED_PATTERN, fv.UPDATED_PIECES),
                "since": (fv.EFFECTIVE_FROM_PATTERN, fv.EFFECTIVE_FROM_PIECES),
                "until": (fv.EFFECTIVE_UNTIL_PATTERN, fv.EFFECTIVE_UNTIL_PIECES)}
    for kind, (pattern, pieces) in patterns.items():
        hits = rows.where(F.col("body").rlike(pattern))
        assert hits.where(F.col("kind") == kind).count() == sum(k == kind for _, k in said)
        assert hits.where(~classify._holds(F.col("n"), pieces)).count() == 0


def test_equal_texts_are_read_once(spark, monkeypatch):
    """As many texts are read as there are different ones; every row is as if read alone."""
    lines = offers.offers(spark, SF).limit(40).localCheckpoint()
    copies = lines.unionByName(lines.withColumns({
        "source_ref": F.concat("source_ref", F.lit("-again")), "url": F.lit(None).cast("string")}))
    copies = copies.unionByName(lines.limit(1).withColumns({
        "source_ref": F.lit("none"), "body": F.lit(None).cast("string")})).localCheckpoint()
    claims, read = offers.part_claims(spark, SF), []
    concepts = matching.concepts

    def counted(texts, *args, **kwargs):
        read.append(texts.count())
        return concepts(texts, *args, **kwargs)

    monkeypatch.setattr(matching, "concepts", counted)

    def rows(equal_texts):
        run = EvidenceRun(copies, claims, offers._MARKET, PROFILE, 2024, equal_texts)
        parts = [run.sources, run.passages, run.references]
        return [sorted(map(str, r.select(*sorted(r.columns)).collect())) for r in parts]

    alone, together = rows(False), rows(True)
    assert all(alone) and alone == together
    assert read[2] * 2 <= read[0]


def test_unit_pieces_lose_no_unit(spark):
    said = [("1 € par KWC", "per_kwc"), ("1 € / \u212aWh", "per_kwh"), ("9 € par M²", "per_m2"),
            ("9 €/m2", "per_m2"), ("2 € par Watt-Crête", "per_wp"), ("2 €/WP", "per_wp"),
            ("100 € PAR AN", "per_year"), ("3 %", "percent"), ("AU TOTAL", "total"),
            ("Inve\u017ftissement", "total"), ("\u0131nvestissement", "total"), ("Budget", "total")]
    rows = spark.createDataFrame(said, "body string, unit string")
    plain = F.array_compact(F.array(*[
        F.when(F.col("body").rlike(p), F.lit(n)) for n, p in fv.UNIT_PATTERNS]))
    for r in rows.select("unit", classify.units(F.col("body")).alias("u"), plain.alias("p")).collect():
        assert r.u == r.p and r.unit in r.u


def test_rows_that_grow_with_the_data_are_not_broadcast(spark):
    """Small files hold many equal rows: what Spark takes for small is joined by sorting."""
    run = offers._run(spark, SF)
    packages = run.claims.select("package_id", F.lit("prix").alias("query")).distinct()
    gaps = packages.select("package_id")
    planned = {
        "offers": offers.offers(spark, SF),
        "per_distinct": text.per_distinct(offers.part_claims(spark, SF), ["claim"], lambda t: t),
        "within": matching._match_within(run.claims, run.passages, PROFILE, False),
        "pairs": matching.match_pairs(run.matches.select(
            "package_id", "claim_id", "source_ref", "passage_ord"), run.claims, run.passages,
            PROFILE),
        "references": run.references, "evaluated": run.evaluated,
        "spread": matching.figure_spread(run.claims, run.passages),
        "blocked": evidence.blocked_claims(run.claims.withColumn(
            "evidence_status", F.lit("UNSUPPORTED")), gaps),
        "gap": prices_of.price_gap(packages, run.evaluated, PROFILE),
        "sink": sinks.passage_rows(run.references, run.sources)}
    for name, rows in planned.items():
        assert "Broadcast" not in rows._jdf.queryExecution().sparkPlan().toString(), name
