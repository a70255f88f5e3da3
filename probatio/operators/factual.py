"""Draft sentences against the claim ledger."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from probatio import fixed_values as fv
from probatio.functions import text
from probatio.operators import classify
from probatio.profiles import Profile
from probatio.session import cut_lineage

SENTENCE = ["draft_id", "package_id", "sentence_ord"]


def draft_sentences(drafts: DataFrame) -> DataFrame:
    """Sentences of each draft that state a figure with a unit."""
    body = F.regexp_replace(F.col("body"), r"(?m)^\s{0,3}#{1,6}\s+", "")
    body = F.regexp_replace(body, r"(?m)^\s*[-*+]\s+", "")
    parts = F.transform(F.split(body, rf"(?<=[.!?]){text.SPACES}|\n+"), text.strip)
    factual = F.filter(parts, lambda s: s.rlike(fv.FACTUAL_SENTENCE_PATTERN))
    return drafts.where(F.col("body").rlike("[0-9]")).select(
        "draft_id", "package_id",
        F.posexplode(factual).alias("sentence_ord", "sentence"))


def _with_words(rows: DataFrame, column: str) -> DataFrame:
    return rows.withColumns({
        "words": text.long_words(F.col(column)),
        "numbers": text.number_set(F.col(column), fv.LEDGER_NUMBER_PATTERN)})


def _candidates(sentences: DataFrame, claims: DataFrame) -> DataFrame:
    """(sentence, claim) pairs that can match.

    A sentence with figures always needs a figure of the claim, so it is looked up
    by figure.  One without figures needs two shared words: it is looked up under
    all its words but the most frequent one, which any such pair must hit.
    """
    counts = claims.select("package_id", F.explode("words").alias("key")).groupBy(
        "package_id", "key").agg(F.count("*").alias("n"))
    figures = sentences.where(F.size("numbers") > 0).select(
        *SENTENCE, F.explode(F.transform(
            "numbers", lambda n: F.concat(F.lit("n:"), n))).alias("key"))
    plain = sentences.where((F.size("numbers") == 0) & (F.size("words") > 1)).select(
        *SENTENCE, F.explode("words").alias("key"))
    # A sentence holds a bounded number of words.
    ranked = plain.join(counts, ["package_id", "key"], "left").groupBy(*SENTENCE).agg(
        F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "key")))
        .alias("_r"))
    words = ranked.select(*SENTENCE, F.explode(
        F.slice("_r", F.lit(1), F.size("_r") - 1)).alias("r")).select(
            *SENTENCE, F.concat(F.lit("w:"), "r.key").alias("key"))
    ledger = claims.select("package_id", "claim_id", F.explode(F.concat(
        F.transform("numbers", lambda n: F.concat(F.lit("n:"), n)),
        F.transform("words", lambda w: F.concat(F.lit("w:"), w)))).alias("key"))
    return figures.unionByName(words).join(ledger, ["package_id", "key"]).select(
        *SENTENCE, "claim_id").distinct()


def match_ledger(sentences: DataFrame, claims: DataFrame) -> DataFrame:
    """Pairs where a draft sentence corresponds to a ledger claim.

    Either every figure of the sentence is in the claim and one long word is
    shared, or two long words are shared and, for a sentence with figures, one
    figure as well.
    """
    said, ledger = _with_words(sentences, "sentence"), _with_words(claims, "claim")
    left = said.select(*SENTENCE, F.col("words").alias("s_words"),
                       F.col("numbers").alias("s_numbers"))
    right = ledger.select("package_id", "claim_id", F.col("words").alias("c_words"),
                          F.col("numbers").alias("c_numbers"))
    shared = F.size(F.array_intersect("s_words", "c_words"))
    figures = F.size("s_numbers") > 0
    whole = figures & (F.size(F.array_except("s_numbers", "c_numbers")) == 0)
    some = ~figures | F.arrays_overlap("s_numbers", "c_numbers")
    return (
        _candidates(said, ledger).join(left, SENTENCE)
        .join(right, ["package_id", "claim_id"])
        .where((whole & (shared >= 1)) | ((shared >= 2) & some))
        .select(*SENTENCE, "claim_id")
    )


def _finding(test: Column, code: str, message: Column, detail: Column) -> Column:
    return F.when(test, F.struct(
        F.lit(code).alias("code"), message.alias("message"), F.lit(True).alias("blocking"),
        detail.alias("detail")))


def _listed(rows: DataFrame, *findings: Column) -> DataFrame:
    return rows.select("draft_id", F.inline(F.array_compact(F.array(*findings))))


def ledger_review(drafts: DataFrame, claims: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Findings and verdict of each draft against its package's evaluated claims.

    ``claims``: package_id, claim_id, claim, category, risk, evidence_status, reason.

    Sentences, claims and their pairs are written once.  One aggregate per draft over its
    sentences and one over the claims it asserts hold all that findings and verdict need.
    """
    sentences = cut_lineage(draft_sentences(drafts))
    ledger = cut_lineage(claims.select("package_id", "claim_id", "claim", "category", "risk",
                                       "evidence_status", "reason"))
    pairs = cut_lineage(match_ledger(
        sentences, ledger.select("package_id", "claim_id", "claim")).join(
        ledger.select("package_id", "claim_id", "evidence_status"), ["package_id", "claim_id"]))
    backed = pairs.where("evidence_status = 'SUPPORTED'").select(*SENTENCE).distinct()
    lone = F.when(F.col("_backed").isNull(), F.struct("sentence_ord", "sentence"))
    said = sentences.join(backed.withColumn("_backed", F.lit(True)), SENTENCE, "left").groupBy(
        "draft_id", "package_id").agg(
        F.count("*").alias("sentences"), F.count(lone).alias("unmatched"),
        F.array_join(F.transform(F.array_sort(F.collect_list(lone)), lambda x: x["sentence"]),
                     " | ").alias("shown"))
    carried = ledger.where("evidence_status = 'SUPPORTED'").select("package_id").distinct()
    per_draft = said.join(carried.withColumn("_carried", F.lit(True)), "package_id", "left")
    asserted = pairs.select("draft_id", "package_id", "claim_id").distinct().join(
        ledger, ["package_id", "claim_id"])

    unproven = (F.col("risk") == "HIGH") & (F.col("evidence_status") != "SUPPORTED")
    clashing = F.col("evidence_status") == "CONFLICTING"
    lost, bare = F.col("unmatched") > 0, F.col("_carried").isNull()
    findings = _listed(
        asserted,
        _finding(unproven, "HIGH_RISK_CLAIM_ASSERTED", F.concat(
            F.lit("The draft asserts a HIGH-risk "), "category",
            F.lit(" claim that the evidence set could not establish ("),
            "evidence_status", F.lit("): "), "reason"), F.col("claim")),
        _finding(clashing, "CONFLICTING_EVIDENCE_ASSERTED", F.concat(
            F.lit("The draft asserts a claim whose evidence conflicts: "), "reason"),
            F.col("claim")),
    ).unionByName(_listed(
        per_draft,
        _finding(lost, "UNSUPPORTED_DRAFT_CLAIM", F.concat(
            F.col("unmatched").cast("string"), F.lit(
                " factual sentence(s) in the draft do not correspond to any SUPPORTED "
                "claim in the evidence ledger.")), F.col("shown")),
        _finding(bare, "NO_SUPPORTED_CLAIMS", F.concat(
            F.lit("The draft makes "), F.col("sentences").cast("string"), F.lit(
                " factual claim(s) but the package carries no SUPPORTED claim at all.")),
            F.lit(""))))

    claimed = asserted.groupBy("draft_id").agg(
        (F.count_if(unproven) + F.count_if(clashing)).alias("claim_issues"))
    n, missing = F.coalesce("sentences", F.lit(0)), F.coalesce("unmatched", F.lit(0))
    has_body = F.coalesce("body", F.lit("")).rlike(r"\S")
    blocking = (F.coalesce("claim_issues", F.lit(0)) + F.coalesce(lost, F.lit(False)).cast("int")
                + ((n > 0) & bare).cast("int"))
    result = (
        drafts.select("draft_id", has_body.alias("_body"))
        .join(per_draft, "draft_id", "left").join(claimed, "draft_id", "left")
        .select(
            "draft_id", n.alias("sentences"), (n - missing).alias("matched"),
            F.when(~F.col("_body"), 0).when(n == 0, 100)
            .otherwise(F.bround(100 * (n - missing) / n, 0).cast("int")).alias("score"),
            blocking.alias("blocking_issues"),
            F.when(blocking > 0, "FAILED").otherwise("PASSED").alias("status"))
    )
    return findings, result


def bind_sentences(drafts: DataFrame, facts: DataFrame, profile: Profile) -> DataFrame:
    """First factual model: bind each draft sentence to the best on-topic fact.

    ``facts``: package_id, fact_ord, fact, source_ref, source_quality (supported
    facts only).  On topic means two shared long words.
    """
    sentences = draft_sentences(drafts).withColumns({
        "words": text.long_words(F.col("sentence")),
        "numbers": text.number_set(F.col("sentence"), fv.LEDGER_NUMBER_PATTERN),
        "_norm": text.normalise(F.col("sentence"))})
    known = _with_words(facts, "fact")
    counts = known.select("package_id", F.explode("words").alias("key")).groupBy(
        "package_id", "key").agg(F.count("*").alias("n"))
    ranked = sentences.select(*SENTENCE, F.explode("words").alias("key")).join(
        counts, ["package_id", "key"], "left").groupBy(*SENTENCE).agg(
            F.array_sort(F.collect_list(F.struct(
                F.coalesce("n", F.lit(0)).alias("n"), "key"))).alias("_r"))
    # Two words must be shared, so the most frequent one need not be looked up.
    lookups = ranked.where(F.size("_r") > 1).select(*SENTENCE, F.explode(
        F.slice("_r", F.lit(1), F.size("_r") - 1)).alias("r")).select(
            *SENTENCE, F.col("r.key").alias("key"))
    postings = known.select("package_id", "fact_ord", F.explode("words").alias("key"))
    pairs = lookups.join(postings, ["package_id", "key"]).select(
        *SENTENCE, "fact_ord").distinct()
    shared = F.size(F.array_intersect("words", "f_words"))
    on_topic = (
        pairs.join(sentences.select(*SENTENCE, "words", "numbers"), SENTENCE)
        .join(known.select("package_id", "fact_ord", "source_ref", "source_quality",
                           F.col("words").alias("f_words"),
                           F.col("numbers").alias("f_numbers")),
              ["package_id", "fact_ord"])
        .where(shared >= 2)
        .withColumn("_same", (F.size("numbers") == 0)
                    | F.arrays_overlap("numbers", "f_numbers"))
    )
    fact = F.struct("source_ref", "source_quality")
    best_first = F.struct(classify.quality_rank(F.col("source_quality")),
                          (-F.col("fact_ord")).alias("o"))
    bound = on_topic.groupBy(*SENTENCE).agg(
        F.count("*").alias("on_topic"),
        F.count_if("_same").alias("matching"),
        F.max_by(fact, F.when(F.col("_same"), best_first)).alias("best"),
        F.min_by(fact, "fact_ord").alias("first"))
    rows = sentences.join(bound, SENTENCE, "left").withColumn(
        "claim_risk", classify.simple_risk(F.col("sentence"), F.col("_norm"), profile))
    enough = (classify.quality_rank(F.col("best.source_quality"))
              >= classify.minimum_quality_rank(F.col("claim_risk")))
    rows = rows.withColumn(
        "support_status",
        F.when(F.col("on_topic").isNull(), "UNSUPPORTED")
        .when(F.col("matching") == 0, "CONFLICTING")
        .when(enough, "SUPPORTED").otherwise("PARTIALLY_SUPPORTED"))
    chosen = F.when(F.col("matching") == 0, F.col("first")).otherwise(F.col("best"))
    return rows.withColumns({
        "evidence_ref": chosen["source_ref"],
        "source_quality": chosen["source_quality"],
        "blocking": (F.col("support_status") != "SUPPORTED")
        & (F.col("claim_risk") == "HIGH"),
    }).select(*SENTENCE, "sentence", "claim_risk", "support_status", "evidence_ref",
              "source_quality", "blocking")


def first_version_verdict(drafts: DataFrame, bound: DataFrame,
                          facts: DataFrame) -> DataFrame:
    """Score and status of the first factual model."""
    have = facts.select("package_id").distinct().withColumn("_have", F.lit(True))
    per = bound.groupBy("draft_id").agg(
        F.count("*").alias("claims"),
        F.count_if(F.col("support_status") == "SUPPORTED").alias("supported"),
        F.count_if("blocking").alias("blocking"))
    rows = drafts.select("draft_id", "package_id").join(per, "draft_id", "left").join(
        have, "package_id", "left")
    n = F.coalesce("claims", F.lit(0))
    no_evidence = F.col("_have").isNull() & (n > 0)
    blocking = F.coalesce("blocking", F.lit(0)) + F.when(no_evidence, 1).otherwise(0)
    return rows.select(
        "draft_id", n.alias("claims"),
        F.when(n == 0, 100).otherwise(
            F.bround(F.try_divide(100 * F.col("supported"), n), 0).cast("int"))
        .alias("score"),
        blocking.alias("blocking_issues"),
        F.when(blocking > 0, "FAILED").otherwise("PASSED").alias("status"))


def claim_ledger(claims: DataFrame) -> DataFrame:
    """Ledger counts per package."""
    return claims.groupBy("package_id").agg(
        F.count("*").alias("total"),
        *[F.count_if(F.col("evidence_status") == s).alias(s.lower())
          for s in fv.EVIDENCE_STATUSES])


