"""Draft checks: one findings row per failed rule, and the verdict over them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from probatio import fixed_values as fv
from probatio.functions import text
from probatio.profiles import Profile
from probatio.session import cut_lineage

RESTRICTED_WINDOW = 120


def prepare(drafts: DataFrame) -> DataFrame:
    """Trim the fields once and keep the normalised body beside them.

    ``drafts``: draft_id, package_id, title, body, meta_title, meta_description,
    primary_query, search_intent, content_type, cta_code, required_sources.
    """
    trimmed = drafts.withColumns({
        name: text.strip(F.coalesce(name, F.lit("")))
        for name in ("title", "body", "meta_title", "meta_description")})
    return text.once(
        trimmed, norm_body=text.normalise(F.col("body")),
        n_words=text.word_count(text.squeeze(F.col("body"))))


def _finding(test: Column, code: str, message, blocking, detail=None) -> Column:
    def column(value, kind: str) -> Column:
        return (value if isinstance(value, Column) else F.lit(value)).cast(kind)

    return F.when(test, F.struct(
        F.lit(code).alias("code"), column(message, "string").alias("message"),
        column(blocking, "boolean").alias("blocking"),
        F.coalesce(column(detail, "string"), F.lit("")).alias("detail")))


def _rows(prepared: DataFrame, findings: list[Column]) -> DataFrame:
    return prepared.select("draft_id", F.explode(F.array_compact(F.array(*findings)))
                           .alias("f")).select("draft_id", "f.*")


def _lines(body: Column, pattern: str) -> Column:
    return F.size(F.regexp_extract_all(body, F.lit(pattern), F.lit(0)))


def structure_findings(prepared: DataFrame, profile: Profile) -> DataFrame:
    """Presence, length, heading, placeholder, phrase, density and CTA rules."""
    title, body = F.col("title"), F.col("body")
    has_body = body != ""
    h1, h2 = _lines(body, r"(?m)^#\s+.+$"), _lines(body, r"(?m)^##\s+.+$")
    leak = F.coalesce(*[
        F.when(body.rlike(p), F.regexp_extract(body, p, 0))
        for p in fv.PLACEHOLDER_PATTERNS])
    primary = text.normalise(F.coalesce("primary_query", F.lit("")))
    count = F.when(primary == "", 0).otherwise(
        (F.length("norm_body") - F.length(F.replace(F.col("norm_body"), primary,
                                                    F.lit("")))) / F.length(primary))
    density = F.try_divide(count * text.word_count(primary), F.col("n_words"))
    meta_title, meta_text = F.col("meta_title"), F.col("meta_description")

    def counted(pattern: str, *columns: Column) -> Column:
        return F.format_string(pattern, *columns)

    always = [
        _finding(title == "", "MISSING_TITLE", "Draft has no title", True),
        _finding(~has_body, "MISSING_BODY", "Draft has no body", True),
        _finding(meta_title == "", "MISSING_META_TITLE", "No meta title", True),
        _finding(F.length(meta_title) > fv.META_TITLE_MAX, "META_TITLE_TOO_LONG",
                 counted(f"Meta title is %d chars (max {fv.META_TITLE_MAX})",
                         F.length(meta_title)), False),
        _finding(meta_text == "", "MISSING_META_DESCRIPTION", "No meta description", True),
        _finding(F.length(meta_text) > fv.META_DESCRIPTION_MAX,
                 "META_DESCRIPTION_TOO_LONG", counted(
                     f"Meta description is %d chars (max {fv.META_DESCRIPTION_MAX})",
                     F.length(meta_text)), False),
    ]
    with_body = [
        _finding(F.col("n_words") < fv.MIN_BODY_WORDS, "BODY_TOO_SHORT", counted(
            f"Body has %d words (minimum {fv.MIN_BODY_WORDS})", F.col("n_words")), True),
        _finding(h1 == 0, "NO_H1", "Body has no H1 heading", True),
        _finding(h1 > 1, "MULTIPLE_H1", counted(
            "Body has %d H1 headings, expected 1", h1), True),
        _finding(h2 < 2, "WEAK_STRUCTURE", counted(
            "Body has %d H2 sections, expected at least 2", h2), False),
        _finding(leak.isNotNull(), "PLACEHOLDER_LEAKED",
                 "Body contains unfilled placeholder text", True, leak),
        *[_finding(F.col("norm_body").contains(text.local_normalise(p)),
                   "FORBIDDEN_PHRASE", f"Body contains a forbidden phrase: {p!r}", True)
          for p in profile.forbidden_phrases],
        _finding(F.coalesce("required_sources", F.lit(0)) == 0, "NO_TRACEABLE_SOURCES",
                 "Brief carries no source URLs, so no claim in the draft is traceable",
                 True),
        _finding(density > fv.KEYWORD_DENSITY_MAX, "KEYWORD_STUFFING", counted(
            "Primary query appears %d times in the body", count.cast("int")), True),
        _finding(F.col("cta_code").isNull(), "NO_CTA",
                 "No conversion strategy is defined; a page that only ranks is not "
                 "publishable", True),
    ]
    return _rows(prepared, always + [F.when(has_body, f) for f in with_body])


# ------------------------------------------------------------------ numbers --
def evidence_numbers(texts: DataFrame) -> DataFrame:
    """Distinct digits-only figures stated by a package's evidence.

    ``texts``: package_id, text (supported claims and source titles).
    """
    stated = F.array_union(
        text.number_set(F.col("text"), fv.DRAFT_NUMBER_PATTERN, keep_years=True),
        text.number_set(F.col("text"), fv.DRAFT_PERCENT_PATTERN, keep_years=True))
    return texts.select("package_id", F.explode(stated).alias("number")).distinct()


def unsupported_numbers(prepared: DataFrame, numbers: DataFrame) -> DataFrame:
    """Figures a draft states that no retrieved source does.

    Figures of the query itself and plausible years do not count; percentages are
    checked on their own, years included.
    """
    body = F.col("body")
    found = F.regexp_extract_all(body, F.lit(fv.DRAFT_NUMBER_PATTERN), F.lit(1))
    shares = F.regexp_extract_all(body, F.lit(fv.DRAFT_PERCENT_PATTERN), F.lit(0))
    asked = text.number_set(F.col("primary_query"), fv.DRAFT_NUMBER_PATTERN, True)
    plain = F.filter(
        F.transform(found, lambda r: F.struct(
            text.digits(r).alias("number"), F.trim(r).alias("raw"))),
        lambda n: (n["number"] != "") & ~text.is_year(n["number"])
        & ~F.array_contains(F.col("_asked"), n["number"]))
    percents = F.transform(shares, lambda r: F.struct(
        text.digits(r).alias("number"), F.trim(r).alias("raw")))
    stated = prepared.where(body.rlike("[0-9]")).withColumn("_asked", asked).select(
        "draft_id", "package_id",
        F.explode(F.array_distinct(F.concat(plain, percents))).alias("n")
    ).select("draft_id", "package_id", "n.number", "n.raw")
    return stated.join(numbers, ["package_id", "number"], "left_anti")


def number_findings(prepared: DataFrame, numbers: DataFrame) -> DataFrame:
    """One blocking finding per draft with unsupported figures."""
    missing = unsupported_numbers(prepared, numbers).select("draft_id", "raw").distinct()
    shown = missing.groupBy("draft_id").agg(
        F.concat_ws(", ", F.array_sort(F.collect_list("raw"))).alias("_shown"))
    counts = missing.groupBy("draft_id").agg(F.count("*").alias("n"))
    return _rows(counts.join(shown, "draft_id"), [_finding(
        F.col("n") > 0, "UNSUPPORTED_NUMERIC_CLAIM", F.format_string(
            "%d numeric value(s) appear in the body but in no retrieved source",
            F.col("n")), True, F.col("_shown"))])


def restricted_findings(prepared: DataFrame, cautions: DataFrame) -> DataFrame:
    """A restricted topic near a digit without supporting evidence.

    ``cautions``: package_id, topic, has_supported_evidence.
    """
    open_topics = cautions.where(~F.col("has_supported_evidence")).select(
        "package_id", "topic", text.normalise(F.col("topic")).alias("_topic"))
    body, topic = F.col("norm_body"), F.col("_topic")
    # Gaps between a topic and the nearest digit, cut at each mention of the topic.
    pieces = F.split(body, F.concat(F.lit(r"\Q"), topic, F.lit(r"\E")))
    last = F.size(pieces) - 1
    near = F.exists(F.transform(pieces, lambda p, i: (
        (i > 0) & F.left(p, F.lit(RESTRICTED_WINDOW + 1)).rlike("[0-9]"))
        | ((i < last) & F.right(p, F.lit(RESTRICTED_WINDOW + 1)).rlike("[0-9]"))),
        lambda hit: hit)
    rows = prepared.where(body.rlike("[0-9]")).join(open_topics, "package_id").where(
        (topic != "") & body.contains(topic) & near)
    return _rows(rows, [_finding(
        F.lit(True), "RESTRICTED_CLAIM_QUANTIFIED", F.concat(
            F.lit("Restricted topic '"), "topic",
            F.lit("' appears with a figure but no dated source supports it")), True)])


def _echoed(words: Column, body: Column) -> Column:
    """A majority of the distinctive words appear in the body."""
    hits = F.size(F.filter(words, lambda w: body.contains(w)))
    half = F.floor(F.size(words) / 2)
    return (F.size(words) > 0) & (hits >= F.greatest(F.lit(2), half))


def _distinctive(value: Column) -> Column:
    return F.filter(F.split(text.normalise(value), " "), lambda w: F.length(w) > 4)


def fact_usage(prepared: DataFrame, facts: DataFrame) -> DataFrame:
    """Required facts of each draft and how many its body echoes."""
    wanted = facts.select("package_id", _distinctive(F.col("fact")).alias("_words"))
    used = prepared.where("body != ''").select("draft_id", "package_id", "norm_body").join(
        wanted, "package_id").groupBy("draft_id").agg(
            F.count("*").alias("required"),
            F.count_if(_echoed(F.col("_words"), F.col("norm_body"))).alias("used"))
    return prepared.where("body != ''").select("draft_id").join(
        used, "draft_id", "left").fillna(0, ["required", "used"])


def fact_findings(prepared: DataFrame, facts: DataFrame) -> DataFrame:
    required, used = F.col("required"), F.col("used")
    return _rows(fact_usage(prepared, facts), [
        _finding(required == 0, "NO_SUPPORTED_EVIDENCE",
                 "The research package contained no supported facts, so this draft "
                 "cannot be evidence-based", True),
        _finding((required > 0) & (used == 0), "REQUIRED_FACTS_UNUSED", F.format_string(
            "None of the %d supported facts appear in the body", required), True),
        _finding((used > 0) & (used < F.greatest(F.lit(1), F.floor(required / 3))),
                 "REQUIRED_FACTS_UNDERUSED", F.format_string(
                     "Only %d of %d supported facts appear in the body", used, required),
                 False),
    ])


def duplicate_title_findings(prepared: DataFrame, existing: DataFrame) -> DataFrame:
    """``existing``: title of every earlier draft."""
    titles = existing.select(text.normalise(F.col("title")).alias("_t")).distinct()
    rows = prepared.where("body != ''").withColumn(
        "_t", text.normalise(F.col("title"))).join(titles, "_t", "left_semi")
    return _rows(rows, [_finding(F.lit(True), "DUPLICATE_TITLE",
                                 "A draft with this title already exists", True)])


def deterministic_findings(drafts: DataFrame, facts: DataFrame, cautions: DataFrame,
                           numbers: DataFrame, existing: DataFrame,
                           profile: Profile) -> DataFrame:
    prepared = cut_lineage(prepare(drafts))  # normalised once for all five groups of rules
    return reduce(lambda a, b: a.unionByName(b), (
        structure_findings(prepared, profile),
        number_findings(prepared, numbers),
        restricted_findings(prepared, cautions),
        fact_findings(prepared, facts),
        duplicate_title_findings(prepared, existing)))


# ---------------------------------------------------------------- SEO layer --
def question_coverage(prepared: DataFrame, questions: DataFrame) -> DataFrame:
    """How many of the surfaced questions each draft addresses.

    ``questions``: package_id, question_ord (from 0), question.
    """
    asked = questions.where(F.col("question") != "").withColumn("_words", _distinctive(F.col("question")))
    return prepared.where("body != ''").select("draft_id", "package_id", "norm_body").join(
        asked, "package_id").groupBy("draft_id").agg(
            F.count("*").alias("questions"),
            F.count_if(_echoed(F.col("_words"), F.col("norm_body"))).alias("covered"))


def repeated_openings(prepared: DataFrame) -> DataFrame:
    """Sentence openings that occur more than once in a draft."""
    parts = F.filter(F.split("body", rf"(?<=[.!?]){text.SPACES}"),
                     lambda s: F.length(s) > 40)
    keyed = prepared.select("draft_id", F.explode(parts).alias("_s")).select(
        "draft_id", text.normalise(F.col("_s")).alias("opening"))
    return keyed.groupBy("draft_id", "opening").agg(F.count("*").alias("n")).where(
        "n > 1").groupBy("draft_id").agg(F.count("*").alias("repeats"))


def seo_findings(drafts: DataFrame, questions: DataFrame, gaps: DataFrame,
                 answers: DataFrame, profile: Profile) -> DataFrame:
    """The rules that need result-page and brief context.

    ``gaps``: package_id, gap_ord (from 0), gap.  ``answers``: package_id, answers
    (count), unknown_vat (count), must_answer_directly, core_question.
    """
    prepared = prepare(drafts).where("body != ''")
    body, norm = F.col("body"), F.col("norm_body")
    buying = F.col("search_intent").isin("COMMERCIAL", "TRANSACTIONAL")
    rows = (
        prepared
        .join(question_coverage(prepared, questions), "draft_id", "left")
        .join(repeated_openings(prepared), "draft_id", "left")
        .join(answers, "package_id", "left")
        .withColumn("_title", text.normalise(F.col("title")))
        .withColumn("_topic", F.filter(
            F.split(text.normalise(F.coalesce("primary_query", F.lit(""))), " "),
            lambda w: F.length(w) > 3))
        .withColumn("_links", F.regexp_extract_all(
            body, F.lit(r"\]\((https?://[^)]+)\)"), F.lit(1)))
    )
    ratio = F.col("covered") / F.col("questions")
    pipes = F.length(body) - F.length(F.replace(body, F.lit("|"), F.lit("")))
    # The sentence carrying a VAT statement plus what follows it closely.
    sentence = F.regexp_extract(
        body, f"(?s)({fv.VAT_GENERALISED_PATTERN}).{{0,60}}", 0)
    must = F.coalesce("must_answer_directly", F.lit(False))
    findings = [
        _finding(F.col("covered") == 0, "PAA_COVERAGE_NONE", F.format_string(
            "The draft addresses none of the %d questions Google surfaces for this "
            "query.", F.col("questions")), False),
        _finding((F.col("covered") > 0) & (ratio < fv.PAA_LOW_RATIO), "PAA_COVERAGE_LOW",
                 F.format_string("The draft addresses %d of %d questions Google "
                                 "surfaces.", F.col("covered"), F.col("questions")),
                 False),
        _finding(buying & ~text.contains_any(norm, profile.commercial_terms),
                 "INTENT_MISALIGNED", F.concat(
                     F.lit("Brief targets "), "search_intent", F.lit(
                         " intent but the body never addresses cost, price or "
                         "quotation. A searcher with buying intent will bounce.")), True),
        _finding((F.col("_title") != "") & (F.size("_topic") > 0)
                 & ~F.arrays_overlap("_topic", F.split("_title", " ")),
                 "TITLE_OFF_TOPIC",
                 "The title shares no distinctive term with the target query.", True),
        _finding((F.col("content_type") == "COMPARISON") & (pipes < 4)
                 & (_lines(body, r"(?m)^\s*[-*]\s+") < 4), "COMPARISON_UNSTRUCTURED",
                 "A COMPARISON page carries neither a table nor a comparative list.",
                 False),
        _finding(F.col("repeats") > 0, "REPETITION", F.format_string(
            "%d sentence opening(s) repeat almost verbatim.", F.col("repeats")), False),
        _finding(F.size("_links") > 0, "EXTERNAL_LINK_IN_BODY", F.format_string(
            "The draft emits %d outbound link(s). Sources belong in the evidence "
            "ledger, not in the copy.", F.size("_links")), True,
            F.concat_ws(", ", "_links")),
        _finding(buying & ~body.rlike(fv.QUANTIFIED_ANSWER_PATTERN),
                 "NO_QUANTIFIED_ANSWER", F.when(must, F.format_string(
                     "The brief supplied %d evidence-backed figure(s) and required a "
                     "direct answer, but the body states no figure at all.",
                     F.coalesce("answers", F.lit(0)))
                 ).otherwise(F.concat(F.lit("Brief targets "), "search_intent", F.lit(
                     " intent but the body states no figure at all. The page may be "
                     "honest and still not answer the query."))), must),
        _finding((F.col("answers") > 0) & (F.col("unknown_vat") > 0) & (sentence != "")
                 & ~sentence.rlike(fv.VAT_QUALIFIED_PATTERN), "VAT_STATUS_GENERALISED",
                 F.format_string(
                     "The body states a VAT treatment for the prices as a group, but %d "
                     "of %d supplied figures carry no VAT status in their source. VAT "
                     "belongs to one figure, not a list.",
                     F.col("unknown_vat"), F.col("answers")), True),
    ]
    opportunities = prepared.join(
        gaps, "package_id")
    return _rows(rows, findings).unionByName(_rows(opportunities, [_finding(
        F.lit(True), "SERP_CONTENT_GAP",
        F.concat(F.lit("Opportunity: "), "gap"), False)]))


# ------------------------------------------------------------------ verdict --
def verdict(drafts: DataFrame, findings: DataFrame) -> DataFrame:
    """Score and status per draft; any blocking finding fails it."""
    counts = findings.groupBy("draft_id").agg(
        F.count_if("blocking").alias("blocking_issues"),
        F.count_if(~F.col("blocking")).alias("advisory"))
    joined = drafts.select("draft_id").join(counts, "draft_id", "left").fillna(
        0, ["blocking_issues", "advisory"])
    return joined.select(
        "draft_id", "blocking_issues", "advisory",
        F.greatest(F.lit(0), 100 - 25 * F.col("blocking_issues") - 5 * F.col("advisory"))
        .alias("score"),
        F.when(F.col("blocking_issues") > 0, "FAILED").otherwise("PASSED")
        .alias("status"))
