"""Registered queries: draft checks, factual review and page sections."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from probatio import fixed_values as fv
from probatio.functions import text
from probatio.operators import drafts, factual, sections
from probatio.plans import inputs, oracle as o
from probatio.plans.probe import PROFILE


# ------------------------------------------------------------------- inputs --
def _drafts(spark, sf):
    """Every conversation turn as a markdown draft of its conversation's package."""
    c = inputs.table(spark, sf, "conversations")
    title = inputs.first_sentence(F.col("text"))
    amount = (F.length("text") * 10).cast("string")
    body = F.concat(
        F.lit("# "), title, F.lit("\n\n"), F.col("text"), F.lit("\n## Prix\n- "), amount,
        F.lit(" € par an pour une installation\n- tarif de "),
        (F.col("turn") + 10).cast("string"), F.lit(" %\n"),
        F.when(F.col("role") == "user", "## Suite\nCes prix sont TVAC.\n")
        .otherwise("Voir [offre](https://shop.example/x) **gras** et `code`.\n"),
        F.when(F.col("turn") % 4 == 3, "TODO plus tard.\n").otherwise(""))
    return c.select(
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
        .alias("draft_id"),
        F.col("conv_id").alias("package_id"), F.when(F.col("turn") > 0, title)
        .alias("title"), body.alias("body"),
        title.alias("meta_title"),
        F.when(F.col("turn") != 2, F.col("text")).alias("meta_description"),
        F.concat(F.lit("prix "), F.split(title, " ")[0]).alias("primary_query"),
        F.when(F.col("role") == "user", "COMMERCIAL").otherwise("INFORMATIONAL")
        .alias("search_intent"),
        F.when(F.col("turn") == 1, "COMPARISON").otherwise("GUIDE").alias("content_type"),
        F.when(F.col("turn") % 3 != 0, "quote").alias("cta_code"),
        (F.col("turn") % 2).alias("required_sources"))


DRAFTS = r"""
conv AS (
  SELECT *, regexp_extract(text, '^[^.!?\n]*') AS t FROM conversations),
drafts_in AS (
  SELECT conv_id || '-' || turn AS draft_id, conv_id AS package_id, turn, role,
    CASE WHEN turn > 0 THEN t END AS title,
    '# ' || t || chr(10) || chr(10) || text || chr(10) || '## Prix' || chr(10) || '- '
      || length(text) * 10 || ' € par an pour une installation' || chr(10) || '- tarif de '
      || (turn + 10) || ' %' || chr(10)
      || CASE WHEN role = 'user' THEN '## Suite' || chr(10) || 'Ces prix sont TVAC.'
         ELSE 'Voir [offre](https://shop.example/x) **gras** et `code`.' END || chr(10)
      || CASE WHEN turn % 4 = 3 THEN 'TODO plus tard.' || chr(10) ELSE '' END AS raw_body,
    t AS mt, CASE WHEN turn <> 2 THEN text END AS md,
    'prix ' || string_split(t, ' ')[1] AS pq,
    CASE WHEN role = 'user' THEN 'COMMERCIAL' ELSE 'INFORMATIONAL' END AS intent,
    CASE WHEN turn = 1 THEN 'COMPARISON' ELSE 'GUIDE' END AS ctype,
    CASE WHEN turn % 3 <> 0 THEN 'quote' END AS cta, turn % 2 AS nsrc
  FROM conv),
prepared AS (
  SELECT *, regexp_replace(raw_body, '^\s+|\s+$', '', 'g') AS body,
    regexp_replace(coalesce(title, ''), '^\s+|\s+$', '', 'g') AS ti,
    regexp_replace(mt, '^\s+|\s+$', '', 'g') AS mti,
    regexp_replace(coalesce(md, ''), '^\s+|\s+$', '', 'g') AS mde FROM drafts_in),
normal AS (
  SELECT *, """ + o.norm("body") + r""" AS nb, """ + o.norm("pq") + r""" AS npq,
    len(regexp_extract_all(body, '\S+')) AS nw FROM prepared)"""


def _facts(spark, sf):
    """Required facts of a package: the sentences of all its turns."""
    said = inputs.table(spark, sf, "conversations").select(
        F.col("conv_id").alias("package_id"), "turn", F.posexplode(text.split_sentences(
            F.regexp_replace("text", r"\s+", " "))).alias("place", "fact"))
    order = Window.partitionBy("package_id").orderBy("turn", "place")
    return said.select("package_id", (F.row_number().over(order) - 1).alias("fact_ord"),
                       "fact")


FACTS = rf"""
facts AS (
  SELECT conv_id AS package_id, parts[i] AS fact,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn, i) - 1 AS fact_ord
  FROM (SELECT conv_id, turn, {o.sentences("regexp_replace(text, '\\s+', ' ', 'g')")} AS parts
        FROM conversations), unnest(generate_series(1, len(parts))) AS u(i))"""


def _numbers(spark, sf):
    """Figures the package's evidence states: those of what the user said."""
    rows = _drafts(spark, sf).where("search_intent = 'COMMERCIAL'")
    return drafts.evidence_numbers(rows.select("package_id", F.col("body").alias("text")))


# ------------------------------------------------------------- deterministic --
def draft_structure(spark, sf):
    return drafts.structure_findings(
        drafts.prepare(_drafts(spark, sf)), PROFILE).select("draft_id", "code", "blocking",
                                                            "detail")


_RULES = [
    ("ti = ''", "MISSING_TITLE", "true"),
    ("mti = ''", "MISSING_META_TITLE", "true"),
    (f"length(mti) > {fv.META_TITLE_MAX}", "META_TITLE_TOO_LONG", "false"),
    ("mde = ''", "MISSING_META_DESCRIPTION", "true"),
    (f"length(mde) > {fv.META_DESCRIPTION_MAX}", "META_DESCRIPTION_TOO_LONG", "false"),
    (f"nw < {fv.MIN_BODY_WORDS}", "BODY_TOO_SHORT", "true"),
    ("len(regexp_extract_all(body, '(?m)^#\\s+.+$')) = 0", "NO_H1", "true"),
    ("len(regexp_extract_all(body, '(?m)^#\\s+.+$')) > 1", "MULTIPLE_H1", "true"),
    ("len(regexp_extract_all(body, '(?m)^##\\s+.+$')) < 2", "WEAK_STRUCTURE", "false"),
    ("nsrc = 0", "NO_TRACEABLE_SOURCES", "true"),
    ("(length(nb) - length(replace(nb, npq, ''))) / length(npq)::DOUBLE "
     "* len(string_split(npq, ' ')) / nw > 0.025", "KEYWORD_STUFFING", "true"),
    ("cta IS NULL", "NO_CTA", "true"),
]
STRUCTURE = ",\nstructure AS (" + "\nUNION ALL ".join(
    [f"SELECT draft_id, '{code}' AS code, {blocking} AS blocking, '' AS detail FROM normal "
     f"WHERE {test}" for test, code, blocking in _RULES]
    + ["SELECT draft_id, 'PLACEHOLDER_LEAKED', true, 'TODO' FROM normal "
       "WHERE contains(body, 'TODO')"]
    + [f"SELECT draft_id, 'FORBIDDEN_PHRASE', true, '' FROM normal WHERE contains(nb, "
       f"{o.quoted(p)})" for p in PROFILE.forbidden_phrases]) + ")"
DRAFT_STRUCTURE = o.with_(DRAFTS) + STRUCTURE + " SELECT * FROM structure"


def keyword_density(spark, sf):
    """Share of body words taken by the primary query."""
    rows = drafts.prepare(_drafts(spark, sf)).withColumn(
        "_q", text.normalise(F.col("primary_query")))
    used = (F.length("norm_body") - F.length(F.replace(
        F.col("norm_body"), F.col("_q"), F.lit("")))) / F.length("_q")
    return rows.select("draft_id", used.cast("bigint").alias("occurrences"), F.round(
        used * text.word_count(F.col("_q")) / F.col("n_words"), 6).alias("density"))


KEYWORD_DENSITY = o.with_(DRAFTS) + """
SELECT draft_id, n::BIGINT AS occurrences,
       round(n * len(string_split(npq, ' ')) / nw, 6) AS density
FROM (SELECT *, (length(nb) - length(replace(nb, npq, ''))) / length(npq)::DOUBLE AS n
      FROM normal)"""


def unsupported_numbers(spark, sf):
    return drafts.unsupported_numbers(
        drafts.prepare(_drafts(spark, sf)), _numbers(spark, sf)).select(
            "draft_id", "package_id", "number", "raw").distinct()


# In these drafts every number is the turn's own amount (four digits or more) or its
# percentage, so the figures can be stated without the number patterns.
NUMBERS = """,
stated AS (
  SELECT draft_id, package_id, n AS number, n AS raw FROM (
    SELECT *, regexp_extract(raw_body, '- (\\d+) € par an', 1) AS n FROM normal)
  WHERE length(n) >= 4 AND NOT (length(n) = 4 AND n BETWEEN '1900' AND '2100')
  UNION ALL
  SELECT draft_id, package_id, CAST(turn + 10 AS VARCHAR), (turn + 10) || ' %' FROM normal),
known AS (
  SELECT package_id, regexp_extract(raw_body, '- (\\d+) € par an', 1) AS number
  FROM normal WHERE role = 'user'
    AND length(regexp_extract(raw_body, '- (\\d+) € par an', 1)) >= 4
  UNION SELECT package_id, CAST(turn + 10 AS VARCHAR) FROM normal WHERE role = 'user')"""
UNSUPPORTED_NUMBERS = o.with_(DRAFTS) + NUMBERS + """
SELECT DISTINCT draft_id, package_id, number, raw FROM stated s
WHERE NOT EXISTS (SELECT 1 FROM known k
                  WHERE k.package_id = s.package_id AND k.number = s.number)"""


def restricted_topics(spark, sf):
    """Restricted topics near a figure: "tarif" sits next to one in every draft."""
    packages = inputs.table(spark, sf, "conversations").select(
        F.col("conv_id").alias("package_id")).distinct()
    cautions = packages.select(
        "package_id", F.explode(F.array(F.lit("tarif"), F.lit("TVAC"), F.lit("suite"),
                                        F.lit("nowhere"))).alias("topic"),
        (F.col("package_id") % 5 == 0).alias("has_supported_evidence"))
    return drafts.restricted_findings(
        drafts.prepare(_drafts(spark, sf)), cautions).select("draft_id", "code", "message")


RESTRICTED_TOPICS = o.with_(DRAFTS) + """
SELECT draft_id, 'RESTRICTED_CLAIM_QUANTIFIED' AS code, 'Restricted topic ''' || topic
  || ''' appears with a figure but no dated source supports it' AS message
FROM normal, (SELECT unnest(['tarif', 'TVAC', 'suite', 'nowhere']) AS topic)
WHERE package_id % 5 <> 0 AND (
  regexp_matches(nb, '(?s)' || lower(topic) || '.{0,120}\\d')
  OR regexp_matches(nb, '(?s)\\d.{0,120}' || lower(topic)))"""


def required_fact_usage(spark, sf):
    return drafts.fact_usage(drafts.prepare(_drafts(spark, sf)), _facts(spark, sf))


_LONG = f"list_filter(string_split({o.norm('{x}')}, ' '), lambda w: length(w) > 4)"


def _echo(words: str, body: str) -> str:
    return (f"(len({words}) > 0 AND len(list_filter({words}, lambda w: contains({body}, w)))"
            f" >= greatest(2, len({words}) // 2))")


REQUIRED_FACT_USAGE = o.with_(DRAFTS, FACTS) + f"""
SELECT draft_id, count(w) AS required, count(*) FILTER ({_echo('w', 'nb')}) AS used
FROM normal n LEFT JOIN (SELECT package_id, {_LONG.format(x='fact')} AS w FROM facts) f
  ON f.package_id = n.package_id
GROUP BY 1"""


def qa_verdict(spark, sf):
    """Score of every draft over all deterministic findings."""
    rows = _drafts(spark, sf)
    cautions = rows.select("package_id").distinct().select(
        "package_id", F.lit("tarif").alias("topic"), F.lit(False)
        .alias("has_supported_evidence"))
    existing = inputs.queries(spark, sf).select(F.col("query").alias("title"))
    findings = drafts.deterministic_findings(
        rows, _facts(spark, sf), cautions, _numbers(spark, sf), existing, PROFILE)
    return drafts.verdict(rows, findings)


QA_VERDICT = o.with_(DRAFTS, FACTS) + STRUCTURE + NUMBERS + f""",
fact_use AS (
  SELECT draft_id, count(w) AS required, count(*) FILTER ({_echo('w', 'nb')}) AS used
  FROM normal n LEFT JOIN (SELECT package_id, {_LONG.format(x='fact')} AS w FROM facts) f
    ON f.package_id = n.package_id GROUP BY 1),
found AS (
  SELECT draft_id, blocking FROM structure
  UNION ALL SELECT DISTINCT draft_id, true FROM stated s WHERE NOT EXISTS (
    SELECT 1 FROM known k WHERE k.package_id = s.package_id AND k.number = s.number)
  UNION ALL SELECT draft_id, true FROM normal
  UNION ALL SELECT draft_id, true FROM fact_use WHERE required = 0 OR used = 0
  UNION ALL SELECT draft_id, false FROM fact_use
    WHERE used > 0 AND used < greatest(1, required // 3)
  UNION ALL SELECT draft_id, true FROM normal WHERE {o.norm('ti')} IN (
    SELECT {o.norm(o.first_sentence('text'))} FROM benchmark)),
counts AS (
  SELECT draft_id, count(*) FILTER (blocking) AS b, count(*) FILTER (NOT blocking) AS a
  FROM found GROUP BY 1)
SELECT draft_id, b AS blocking_issues, a AS advisory,
       greatest(0, 100 - 25 * b - 5 * a) AS score,
       CASE WHEN b > 0 THEN 'FAILED' ELSE 'PASSED' END AS status
FROM counts"""


# ---------------------------------------------------------------- SEO layer --
def seo_review(spark, sf):
    turns = inputs.table(spark, sf, "conversations")
    questions = turns.select(
        F.col("conv_id").alias("package_id"), F.col("turn").alias("question_ord"),
        inputs.first_sentence(F.col("text")).alias("question"))
    gaps = turns.where("role = 'system'").select(
        F.col("conv_id").alias("package_id"), F.col("turn").alias("gap_ord"),
        F.lit("a gap").alias("gap"))
    answers = turns.select(F.col("conv_id").alias("package_id")).distinct().select(
        "package_id", F.lit(3).alias("answers"), (F.col("package_id") % 3)
        .alias("unknown_vat"), F.lit(True).alias("must_answer_directly"))
    return drafts.seo_findings(_drafts(spark, sf), questions, gaps, answers, PROFILE) \
        .select("draft_id", "code", "blocking")


SEO_REVIEW = o.with_(DRAFTS) + f""",
questions AS (
  SELECT conv_id AS package_id, {_LONG.format(x='t')} AS w FROM conv
  WHERE t <> ''),
cover AS (
  SELECT draft_id, count(*) AS q, count(*) FILTER ({_echo('w', 'nb')}) AS c
  FROM normal JOIN questions USING (package_id) GROUP BY 1),
openings AS (
  SELECT draft_id, k, count(*) AS n FROM (
    SELECT draft_id, {o.norm('p')} AS k FROM (
      SELECT draft_id, unnest(string_split(regexp_replace(body, '([.!?])\\s+',
             '\\1' || chr(31), 'g'), chr(31))) AS p FROM normal) WHERE length(p) > 40)
  GROUP BY 1, 2),
topics AS (SELECT *, list_filter(string_split(npq, ' '), lambda w: length(w) > 3) AS tq,
             {o.norm('ti')} AS nt FROM normal)
SELECT draft_id, 'PAA_COVERAGE_NONE' AS code, false AS blocking FROM cover WHERE c = 0
UNION ALL SELECT draft_id, 'PAA_COVERAGE_LOW', false FROM cover
  WHERE c > 0 AND c / q < {fv.PAA_LOW_RATIO}
UNION ALL SELECT draft_id, 'INTENT_MISALIGNED', true FROM normal
  WHERE intent = 'COMMERCIAL' AND NOT {o.contains('nb', PROFILE.commercial_terms)}
UNION ALL SELECT draft_id, 'TITLE_OFF_TOPIC', true FROM topics
  WHERE nt <> '' AND len(tq) > 0 AND NOT list_has_any(tq, string_split(nt, ' '))
UNION ALL SELECT draft_id, 'COMPARISON_UNSTRUCTURED', false FROM normal
  WHERE ctype = 'COMPARISON' AND length(body) - length(replace(body, '|', '')) < 4
    AND len(regexp_extract_all(body, '(?m)^\\s*[-*]\\s+')) < 4
UNION ALL SELECT draft_id, 'REPETITION', false FROM openings GROUP BY 1
  HAVING count(*) FILTER (n > 1) > 0
UNION ALL SELECT draft_id, 'EXTERNAL_LINK_IN_BODY', true FROM normal WHERE role <> 'user'
UNION ALL SELECT draft_id, 'VAT_STATUS_GENERALISED', true FROM normal
  WHERE role = 'user' AND package_id % 3 > 0
UNION ALL SELECT draft_id, 'SERP_CONTENT_GAP', false
  FROM normal n JOIN conversations c ON c.conv_id = n.package_id
  WHERE c.role = 'system'"""


# ------------------------------------------------------------------ factual --
def _ledger(spark, sf):
    """Facts as evaluated claims: each repeats a figure of some turn."""
    facts = _facts(spark, sf)
    amount = F.concat(F.col("fact"), F.lit(" Une installation coûte "), F.when(
        F.col("fact_ord") % 2 == 0, "1180").otherwise("12"), F.lit(" € par tarif."))
    status = F.get(F.array(*[F.lit(s) for s in fv.EVIDENCE_STATUSES]),
                   (F.col("fact_ord") % 4).cast("int"))
    return facts.select(
        "package_id", F.concat_ws("-", F.col("package_id").cast("string"),
                                  F.col("fact_ord").cast("string")).alias("claim_id"),
        amount.alias("claim"), F.lit("TAX").alias("category"),
        F.when(F.col("fact_ord") % 3 == 0, "HIGH").otherwise("LOW").alias("risk"),
        status.alias("evidence_status"), F.lit("why").alias("reason"))


def ledger_matches(spark, sf):
    sentences = factual.draft_sentences(_drafts(spark, sf))
    return factual.match_ledger(sentences, _ledger(spark, sf).select(
        "package_id", "claim_id", "claim"))


_SENTENCES = rf"""
said AS (
  SELECT draft_id, package_id, parts[i] AS sentence, i - 1 AS sentence_ord
  FROM (SELECT draft_id, package_id, list_filter(list_transform(regexp_split_to_array(
          regexp_replace(regexp_replace(regexp_replace(raw_body,
            '(?m)^\s{{0,3}}#{{1,6}}\s+', '', 'g'), '(?m)^\s*[-*+]\s+', '', 'g'),
            '([.!?])\s+', '\1' || chr(10), 'g'), '\n+'),
          lambda p: regexp_replace(p, '^\s+|\s+$', '', 'g')), lambda p: regexp_matches(p,
          '(?i)\d[\d\s.,]*\s*(?:%|€|\$|£|eur|euros?|kwh|kwc|kwp|wc|wp|m²|m2|ans?|jaar|years?)'))
          AS parts FROM normal), unnest(generate_series(1, len(parts))) AS u(i)),
said_w AS (
  SELECT *, list_distinct(list_filter(string_split({o.norm('sentence')}, ' '),
              lambda w: length(w) > 4)) AS sw,
    list_filter(list_distinct(regexp_extract_all(sentence, '\d\d+')), lambda n:
      NOT (length(n) = 4 AND n BETWEEN '1900' AND '2100')) AS sn
  FROM said),
ledger AS (
  SELECT package_id, package_id || '-' || fact_ord AS claim_id, fact_ord,
    fact || ' Une installation coûte ' || CASE WHEN fact_ord % 2 = 0 THEN '1180' ELSE '12' END
      || ' € par tarif.' AS claim, CASE WHEN fact_ord % 3 = 0 THEN 'HIGH' ELSE 'LOW' END AS risk,
    [{o.listed(fv.EVIDENCE_STATUSES)}][fact_ord % 4 + 1] AS evidence_status FROM facts),
ledger_w AS (
  SELECT *, list_distinct(list_filter(string_split({o.norm('claim')}, ' '),
              lambda w: length(w) > 4)) AS cw,
    [CASE WHEN fact_ord % 2 = 0 THEN '1180' ELSE '12' END] AS cn FROM ledger),
ledger_pairs AS (
  SELECT draft_id, package_id, sentence_ord, claim_id, risk, evidence_status
  FROM (SELECT *, len(list_intersect(sw, cw)) AS shared,
               len(list_filter(sn, lambda n: NOT list_contains(cn, n))) = 0 AS whole,
               list_has_any(sn, cn) AS some_
        FROM said_w JOIN ledger_w USING (package_id))
  WHERE (len(sn) > 0 AND whole AND shared >= 1)
     OR (shared >= 2 AND (len(sn) = 0 OR some_)))"""
LEDGER_MATCHES = o.with_(DRAFTS, FACTS, _SENTENCES) + """
SELECT draft_id, package_id, sentence_ord, claim_id FROM ledger_pairs"""


def ledger_review(spark, sf):
    return factual.ledger_review(_drafts(spark, sf), _ledger(spark, sf))[1]


LEDGER_REVIEW = o.with_(DRAFTS, FACTS, _SENTENCES) + """,
backed AS (SELECT DISTINCT draft_id, sentence_ord FROM ledger_pairs
           WHERE evidence_status = 'SUPPORTED'),
totals AS (
  SELECT s.draft_id, any_value(s.package_id) AS package_id, count(*) AS n,
         count(b.sentence_ord) AS m
  FROM said_w s LEFT JOIN backed b
    ON b.draft_id = s.draft_id AND b.sentence_ord = s.sentence_ord GROUP BY 1),
asserted AS (SELECT DISTINCT draft_id, claim_id, risk, evidence_status FROM ledger_pairs),
blocks AS (
  SELECT draft_id FROM asserted WHERE risk = 'HIGH' AND evidence_status <> 'SUPPORTED'
  UNION ALL SELECT draft_id FROM asserted WHERE evidence_status = 'CONFLICTING'
  UNION ALL SELECT draft_id FROM totals WHERE m < n
  UNION ALL SELECT draft_id FROM totals WHERE package_id NOT IN (
    SELECT package_id FROM ledger WHERE evidence_status = 'SUPPORTED')),
counted AS (SELECT draft_id, count(*) AS b FROM blocks GROUP BY 1)
SELECT d.draft_id, coalesce(n, 0) AS sentences, coalesce(m, 0) AS matched,
  CASE WHEN coalesce(n, 0) = 0 THEN 100 ELSE round_even(100 * m / n, 0)::INT END AS score,
  coalesce(b, 0) AS blocking_issues,
  CASE WHEN b > 0 THEN 'FAILED' ELSE 'PASSED' END AS status
FROM normal d LEFT JOIN totals USING (draft_id) LEFT JOIN counted USING (draft_id)"""


def ledger_findings(spark, sf):
    return factual.ledger_review(_drafts(spark, sf), _ledger(spark, sf))[0].groupBy(
        "draft_id", "code").agg(F.count("*").alias("findings"))


LEDGER_FINDINGS = LEDGER_REVIEW.split("blocks AS (")[0].rstrip().rstrip(",") + """
SELECT draft_id, 'HIGH_RISK_CLAIM_ASSERTED' AS code, count(*) AS findings FROM asserted
  WHERE risk = 'HIGH' AND evidence_status <> 'SUPPORTED' GROUP BY 1
UNION ALL SELECT draft_id, 'CONFLICTING_EVIDENCE_ASSERTED', count(*) FROM asserted
  WHERE evidence_status = 'CONFLICTING' GROUP BY 1
UNION ALL SELECT draft_id, 'UNSUPPORTED_DRAFT_CLAIM', 1 FROM totals WHERE m < n
UNION ALL SELECT draft_id, 'NO_SUPPORTED_CLAIMS', 1 FROM totals WHERE package_id NOT IN (
  SELECT package_id FROM ledger WHERE evidence_status = 'SUPPORTED')"""


def claim_ledger(spark, sf):
    return factual.claim_ledger(_ledger(spark, sf))


CLAIM_LEDGER = o.with_(DRAFTS, FACTS, _SENTENCES) + f"""
SELECT package_id, count(*) AS total,
  {", ".join(f"count(*) FILTER (evidence_status = '{s}') AS {s.lower()}"
             for s in fv.EVIDENCE_STATUSES)}
FROM ledger GROUP BY 1"""


def _ranked_facts(spark, sf):
    return _ledger(spark, sf).select(
        "package_id", F.split("claim_id", "-")[1].cast("int").alias("fact_ord"),
        F.col("claim").alias("fact"), F.col("claim_id").alias("source_ref"),
        F.when(F.col("risk") == "HIGH", "OFFICIAL").otherwise("COMMERCIAL")
        .alias("source_quality"))


def bound_sentences(spark, sf):
    """First factual model over the same drafts, facts ranked by source quality."""
    return factual.bind_sentences(
        _drafts(spark, sf), _ranked_facts(spark, sf), PROFILE).select(
        "draft_id", "sentence_ord", "claim_risk", "support_status", "evidence_ref",
        "source_quality", "blocking")


BOUND_SENTENCES = o.with_(DRAFTS, FACTS, _SENTENCES) + f""",
topical AS (
  SELECT *, CASE WHEN risk = 'HIGH' THEN 5 ELSE 2 END AS q,
         len(sn) = 0 OR list_has_any(sn, cn) AS same
  FROM said_w JOIN ledger_w USING (package_id)
  WHERE len(list_intersect(sw, cw)) >= 2),
best AS (
  SELECT draft_id, sentence_ord, count(*) FILTER (same) AS nm,
    arg_max(claim_id, (q, -fact_ord)) FILTER (same) AS b,
    max(q) FILTER (same) AS bq, arg_min(claim_id, fact_ord) AS f,
    arg_min(q, fact_ord) AS fq FROM topical GROUP BY 1, 2),
rated AS (
  SELECT s.*, nm, b, bq, f, fq, CASE WHEN {o.contains('n', PROFILE.restricted_claims)}
      OR {o.contains('n', fv.HIGH_RISK_TERMS)} THEN 'HIGH'
    ELSE 'MEDIUM' END AS claim_risk
  FROM (SELECT *, {o.norm('sentence')} AS n FROM said_w) s
  LEFT JOIN best USING (draft_id, sentence_ord)),
ruled AS (
  SELECT *, CASE WHEN nm IS NULL THEN 'UNSUPPORTED' WHEN nm = 0 THEN 'CONFLICTING'
      WHEN bq >= CASE claim_risk WHEN 'HIGH' THEN 4 ELSE 3 END THEN 'SUPPORTED'
      ELSE 'PARTIALLY_SUPPORTED' END AS support_status,
    CASE WHEN nm = 0 THEN f ELSE b END AS evidence_ref,
    CASE WHEN nm = 0 THEN fq ELSE bq END AS eq FROM rated)
SELECT draft_id, sentence_ord, claim_risk, support_status, evidence_ref,
  CASE eq WHEN 5 THEN 'OFFICIAL' WHEN 2 THEN 'COMMERCIAL' END AS source_quality,
  support_status <> 'SUPPORTED' AND claim_risk = 'HIGH' AS blocking
FROM ruled"""


def first_model_verdicts(spark, sf):
    """Score and status of every draft under the first factual model."""
    drafts, facts = _drafts(spark, sf), _ranked_facts(spark, sf)
    return factual.first_version_verdict(
        drafts, factual.bind_sentences(drafts, facts, PROFILE), facts)


FIRST_MODEL_VERDICTS = f"""
WITH bound AS ({BOUND_SENTENCES}),
per AS (
  SELECT draft_id, count(*) AS n, count(*) FILTER (support_status = 'SUPPORTED') AS s,
         count(*) FILTER (blocking) AS b FROM bound GROUP BY 1),
have AS (SELECT DISTINCT package_id FROM ({CLAIM_LEDGER})),
rows_ AS (
  SELECT d.draft_id, coalesce(n, 0) AS claims, coalesce(s, 0) AS s,
    coalesce(b, 0) + CASE WHEN h.package_id IS NULL AND n > 0 THEN 1 ELSE 0 END AS blocking_issues
  FROM ({o.with_(DRAFTS, FACTS, _SENTENCES)} SELECT draft_id, package_id FROM normal) d LEFT JOIN per USING (draft_id) LEFT JOIN have h USING (package_id))
SELECT draft_id, claims, CASE WHEN claims = 0 THEN 100
    ELSE CAST(round_even(100 * s / claims, 0) AS INTEGER) END AS score, blocking_issues,
  CASE WHEN blocking_issues > 0 THEN 'FAILED' ELSE 'PASSED' END AS status
FROM rows_"""


# ----------------------------------------------------------------- sections --
def page_sections(spark, sf):
    return sections.sections(_drafts(spark, sf)).select(
        "draft_id", "section_ord", "kind", "level", "text",
        F.array_join(F.transform("items", lambda i: i["text"]), "|").alias("items"))


PAGE_SECTIONS = o.with_(DRAFTS) + r""",
lines AS (
  SELECT draft_id, i, rtrim(parts[i]) AS ln
  FROM (SELECT draft_id, string_split(raw_body, chr(10)) AS parts FROM normal),
       unnest(generate_series(1, len(parts))) AS u(i)),
typed AS (
  SELECT *, CASE WHEN trim(ln) = '' THEN 'blank' WHEN ln LIKE '# %' OR ln LIKE '## %'
      THEN 'heading' WHEN ln LIKE '- %' THEN 'list' ELSE 'paragraph' END AS kind FROM lines),
runs AS (
  SELECT *, sum(CASE WHEN kind = prev AND kind <> 'heading' THEN 0 ELSE 1 END)
    OVER (PARTITION BY draft_id ORDER BY i) AS r
  FROM (SELECT *, lag(kind) OVER (PARTITION BY draft_id ORDER BY i) AS prev FROM typed)),
plain AS (
  SELECT *, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(ln,
    '\[([^\]]*)\]\(([^)]*)\)', '\1', 'g'), '\*\*(.+?)\*\*', '\1', 'g'),
    '`([^`]+)`', '\1', 'g'), '\s+', ' ', 'g')) AS p
  FROM runs WHERE kind <> 'blank')
SELECT draft_id, row_number() OVER (PARTITION BY draft_id ORDER BY r) AS section_ord,
  CASE WHEN kind = 'list' THEN 'price_list' ELSE kind END AS kind,
  CASE WHEN kind = 'heading' THEN CASE WHEN min(ln) LIKE '## %' THEN 2 ELSE 1 END END AS level,
  CASE WHEN kind <> 'list' THEN trim(string_agg(CASE WHEN kind = 'heading'
    THEN regexp_replace(p, '^#+ ', '') ELSE p END, ' ' ORDER BY i)) END AS text,
  CASE WHEN kind = 'list' THEN string_agg(regexp_replace(p, '^- ', ''), '|' ORDER BY i)
    END AS items
FROM plain GROUP BY draft_id, r, kind"""


QUERIES = {
    "draft_structure": (draft_structure, DRAFT_STRUCTURE),
    "keyword_density": (keyword_density, KEYWORD_DENSITY),
    "unsupported_numbers": (unsupported_numbers, UNSUPPORTED_NUMBERS),
    "restricted_topics": (restricted_topics, RESTRICTED_TOPICS),
    "required_fact_usage": (required_fact_usage, REQUIRED_FACT_USAGE),
    "qa_verdict": (qa_verdict, QA_VERDICT),
    "seo_review": (seo_review, SEO_REVIEW),
    "ledger_matches": (ledger_matches, LEDGER_MATCHES),
    "ledger_review": (ledger_review, LEDGER_REVIEW),
    "ledger_findings": (ledger_findings, LEDGER_FINDINGS),
    "claim_ledger": (claim_ledger, CLAIM_LEDGER),
    "bound_sentences": (bound_sentences, BOUND_SENTENCES),
    "first_model_verdicts": (first_model_verdicts, FIRST_MODEL_VERDICTS),
    "page_sections": (page_sections, PAGE_SECTIONS),
}
