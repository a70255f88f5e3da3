"""Registered queries: passages, atomic claims, categories and requirements."""

from __future__ import annotations

from pyspark.sql import functions as F

from probatio import fixed_values as fv
from probatio.functions import prices, text
from probatio.operators import classify, passages
from probatio.plans import inputs, oracle as o
from probatio.plans.probe import PROFILE

_ORDER = ["doc_id", "passage_ord", "claim_ord"]


def _sources(spark, sf):
    """Documents in one package per retrieval source."""
    return inputs.documents(spark, sf).select(
        F.col("source").alias("package_id"), "doc_id",
        F.col("doc_id").cast("string").alias("source_ref"), "body")


def passage_extraction(spark, sf):
    return passages.passages(_sources(spark, sf)).select(
        "package_id", "source_ref", "block_ord", "group_ord", "passage", "kept",
        "drop_reason")


def _fold(x: str) -> str:
    return f"replace(strip_accents(lower({x})), 'ß', 'ss')"


_FIRST_PHRASE = o.case([(f"contains(folded, {o.quoted(p)})", o.quoted(p))
                        for p in fv.FURNITURE_PHRASES])
_ANY_PHRASE = o.contains(_fold("ln"), fv.FURNITURE_PHRASES)
PASSAGES = rf"""
pieces AS (
  SELECT source AS package_id, doc_id, CAST(doc_id AS VARCHAR) AS source_ref,
         regexp_split_to_array(text, '\n\s*\n|\r\n\s*\r\n') AS parts FROM documents
  WHERE regexp_matches(text, '\S')),
raw_blocks AS (
  SELECT package_id, doc_id, source_ref, i - 1 AS block_ord, parts[i] AS raw
  FROM pieces, unnest(generate_series(1, len(parts))) AS u(i)),
tidy_blocks AS (
  SELECT *, array_to_string(list_filter(string_split(raw, chr(10)),
    lambda ln: regexp_matches(ln, '\S') AND NOT (
      len(regexp_extract_all(ln, '\S+')) < {fv.FURNITURE_LINE_WORDS} AND {_ANY_PHRASE})),
    chr(10)) AS block FROM raw_blocks),
judged_blocks AS (
  SELECT *, regexp_replace(block, '^\s+|\s+$', '', 'g') AS stripped,
         {_fold('block')} AS folded,
         trim(regexp_replace(regexp_replace(regexp_replace(block,
           '^\s*(#{{1,6}}\s*|[-*+]\s+|\d+[.)]\s+|>\s*)', ''),
           'https?://\S+|\S+@\S+\.\S+', '', 'g'), '\s+', ' ', 'g')) AS cleaned
  FROM tidy_blocks),
reasoned AS (
  SELECT *, len(regexp_extract_all(stripped, '\S+')) AS n_words,
         {_FIRST_PHRASE} AS phrase FROM judged_blocks),
dropped AS (
  SELECT *, CASE WHEN length(stripped) < {fv.MIN_BLOCK_CHARS} THEN 'too_short'
    WHEN n_words < {fv.MIN_BLOCK_WORDS} THEN 'too_few_words'
    WHEN phrase IS NOT NULL AND n_words < {fv.FURNITURE_BLOCK_WORDS}
      THEN 'boilerplate:' || phrase
    WHEN length(regexp_replace(stripped, '[^\p{{L}}]', '', 'g'))
      < {fv.MIN_LETTER_SHARE} * length(stripped) THEN 'low_alpha_ratio'
    WHEN NOT contains(stripped, '.')
      AND length(stripped) - length(replace(stripped, chr(10), '')) >= 2
      THEN 'unpunctuated_list' END AS drop_reason
  FROM reasoned),
grouped AS (
  SELECT package_id, doc_id, source_ref, block_ord, drop_reason,
    CASE WHEN drop_reason IS NOT NULL THEN [cleaned]
         WHEN length(cleaned) <= {fv.MAX_PASSAGE_CHARS} THEN [cleaned]
         ELSE string_split(list_reduce({o.sentences('cleaned', '.!?;:')},
           lambda acc, x: CASE
             WHEN length(split_part(acc, chr(30), -1)) + length(x) + 1
                    > {fv.MAX_PASSAGE_CHARS}
             THEN acc || chr(30) || x ELSE acc || ' ' || x END), chr(30)) END AS texts
  FROM dropped),
all_passages AS (
  SELECT package_id, doc_id, source_ref, block_ord, g - 1 AS group_ord,
         texts[g] AS passage, drop_reason IS NULL AS kept, drop_reason
  FROM grouped, unnest(generate_series(1, len(texts))) AS u(g)
  WHERE drop_reason IS NOT NULL OR texts[g] <> ''),
kept_passages AS (
  SELECT package_id, doc_id, source_ref, passage, row_number() OVER (
    PARTITION BY doc_id ORDER BY block_ord, group_ord) - 1 AS passage_ord
  FROM all_passages WHERE kept)"""
PASSAGE_EXTRACTION = o.with_(PASSAGES) + """
SELECT package_id, source_ref, block_ord, group_ord, passage, kept, drop_reason
FROM all_passages"""


def passage_drop_summary(spark, sf):
    return passages.drop_summary(passages.passages(_sources(spark, sf)))


PASSAGE_DROP_SUMMARY = o.with_(PASSAGES) + """
SELECT package_id, coalesce(drop_reason, 'kept') AS reason, count(*) AS passages
FROM all_passages GROUP BY ALL"""


def _claims(spark, sf):
    return passages.claims(passages.kept_passages(_sources(spark, sf)))


def atomic_claims(spark, sf):
    return _claims(spark, sf).select(
        "package_id", "source_ref", "passage_ord", "claim_ord", "claim", "quantified")


_W = r"[\p{L}\p{N}_]"
_NW = r"[^\p{L}\p{N}_]"


def _word(alternatives: str) -> str:
    return rf"(^|{_NW})(?:{alternatives})({_NW}|$)".replace("'", "''")


_VERBS = fv.VERB_PATTERN[len(r"(?iU)\b(?:"):].split(r")\b|\b\w{3,}")[0]
_UNITS = fv.QUANTITY_PATTERN.split("(?:", 1)[1][:-1]
_QUANTITY = rf"(?i)(^|[^\p{{L}}\p{{N}}_/])\d[\d\s.,]*\s*(?:{_UNITS})"
_BARE = r"(^|[^\p{L}\p{N}_/])\d\d+([^\p{L}\p{N}_/]|$)"
_OPENERS = fv.NON_ASSERTION_PATTERN.split("(?:", 1)[1][:-len(r")\b")]
_PROMO = fv.PROMOTIONAL_PATTERN[len(r"(?iU)\b(?:"):-len(r")\b")]
_SEPARATOR = (r"(?i)\s*(?:;|\.\s+|\s+(?:et|ou|mais|tandis que|alors que|and|or|but|while|"
              r"whereas|en)\s+((?:la|le|les|un|une|des|il|elle|on|the|a|an|it)\s))")
CLAIMS = rf"""
said AS (
  SELECT package_id, doc_id, source_ref, passage_ord, passage, s - 1 AS s_ord,
         trim(parts[s]) AS sentence
  FROM (SELECT *, {o.sentences('passage')} AS parts FROM kept_passages),
       unnest(generate_series(1, len(parts))) AS u(s) WHERE trim(parts[s]) <> ''),
clauses AS (
  SELECT *, len(regexp_extract_all(sentence, '{_QUANTITY}')) > 1
            OR length(sentence) > {fv.MAX_CLAIM_CHARS} AS several,
         list_filter(list_transform(string_split(regexp_replace(regexp_replace(sentence,
           '{_SEPARATOR}', chr(31) || '\1', 'g'), '{_SEPARATOR}', chr(31) || '\1', 'g'),
           chr(31)), lambda p: trim(p)), lambda p: p <> '') AS cl
  FROM said),
merged AS (
  SELECT *, CASE WHEN several AND len(cl) > 1 THEN string_split(list_reduce(cl,
    lambda acc, x: CASE WHEN len(regexp_extract_all(x, '\S+')) < 4
      THEN acc || ' ' || x ELSE acc || chr(31) || x END), chr(31))
    ELSE [sentence] END AS props FROM clauses),
proposed AS (
  SELECT package_id, doc_id, source_ref, passage_ord, passage, s_ord, p AS p_ord,
         regexp_replace(props[p], '^[ ,;:]+|[ ,;:]+$', '', 'g') AS c
  FROM merged, unnest(generate_series(1, len(props))) AS u(p)),
measured AS (
  SELECT *, list_filter(regexp_extract_all(c, '\S+'), lambda w: length(w) > 2) AS lw,
    regexp_matches(c, '(?i){_word(_VERBS)}')
    OR len(list_filter(regexp_extract_all(lower(c), '{_W}+'), lambda w: length(w) >= 6
           AND ends_with(w, 'ent') AND NOT ends_with(w, 'mentent'))) > 0
    OR regexp_matches(c, '(?i)(^|{_NW}){_W}{{3,}}(?:aient|ait|eront|era|issent)({_NW}|$)')
      AS verb
  FROM proposed),
asserted AS (
  SELECT * FROM measured WHERE length(c) >= {fv.MIN_CLAIM_CHARS}
    AND NOT regexp_matches(c, '\?\s*$') AND len(lw) >= 5
    AND NOT regexp_matches(c, '(?i)^\s*(?:{_OPENERS.replace("'", "''")})({_NW}|$)')
    AND NOT regexp_matches(c, '(?i){_word(_PROMO)}')
    AND (verb OR NOT (
      regexp_matches(c, '\s[|–—]\s|^\s*[A-ZÉÈÀ][A-ZÉÈÀ]+\s*:')
      OR len(list_filter(lw, lambda w: regexp_matches(w, '^\p{{Lu}}')))
         >= greatest(2.0, len(lw) * {fv.TITLE_CAPITAL_SHARE})
      OR NOT regexp_matches(rtrim(c), '[.!]$')))),
all_claims AS (
  SELECT package_id, doc_id, source_ref, passage_ord, passage,
    row_number() OVER w - 1 AS claim_ord, c AS claim,
    regexp_matches(c, '{_QUANTITY}') OR regexp_matches(c, '{_BARE}') AS quantified
  FROM asserted
  WINDOW w AS (PARTITION BY doc_id, passage_ord ORDER BY s_ord, p_ord))"""
ATOMIC_CLAIMS = o.with_(PASSAGES, CLAIMS) + """
SELECT package_id, source_ref, passage_ord, claim_ord, claim, quantified FROM all_claims"""


def _deduped(spark, sf):
    return passages.dedupe_claims(
        _claims(spark, sf).select("package_id", "doc_id", "source_ref", "passage_ord",
                                  "claim_ord", "claim", "quantified"), _ORDER)


def deduplicated_claims(spark, sf):
    return _deduped(spark, sf).select(
        "package_id", "claim", "source_ref", "passage_ord", "claim_ord", "occurrences")


DEDUPED = f"""
deduped AS (
  SELECT *, count(*) OVER (PARTITION BY package_id, k) AS occurrences FROM (
    SELECT *, trim(regexp_replace(lower(claim), '\\s+', ' ', 'g')) AS k FROM all_claims)
  QUALIFY row_number() OVER (PARTITION BY package_id, k
                             ORDER BY doc_id, passage_ord, claim_ord) = 1)"""
DEDUPLICATED_CLAIMS = o.with_(PASSAGES, CLAIMS, DEDUPED) + """
SELECT package_id, claim, source_ref, passage_ord, claim_ord, occurrences FROM deduped"""


def claim_set_summary(spark, sf):
    return passages.claim_set_summary(_deduped(spark, sf))


CLAIM_SET_SUMMARY = o.with_(PASSAGES, CLAIMS, DEDUPED) + """
SELECT package_id, count(*) AS claims, sum(occurrences - 1)::BIGINT AS skipped_fragments,
       count(*) FILTER (quantified) AS quantified
FROM deduped GROUP BY 1"""


# ------------------------------------------------------------- price texts --
def price_texts(spark, sf):
    """One sentence per line item that states its price the way pages do."""
    amount = F.floor("l_extendedprice").cast("string")
    flag, line = F.col("l_returnflag"), F.col("l_linenumber") % 4
    body = F.concat(
        F.when(flag == "A", "Le prix moyen est de ").when(flag == "N", "Comptez entre ")
        .otherwise("Nos tarifs sont de "), amount,
        F.when(flag == "N", F.concat(F.lit(" € et "), F.floor(
            F.col("l_extendedprice") * 2).cast("string"))).otherwise(""),
        F.lit(" € "),
        F.when(line == 0, "par kWc").when(line == 1, "pour une installation de 5 kWc")
        .when(line == 2, "par m²").otherwise("par panneau"),
        F.when(F.col("l_linestatus") == "O", " TVAC").otherwise(" hors TVA"),
        F.when(F.col("l_tax") > 0.04, ", pose comprise")
        .when(F.col("l_tax") < 0.02, ", hors pose").otherwise(""),
        F.when(F.col("l_discount") > 0.05, " avec batterie").otherwise(""),
        F.lit(" en "), F.lit("20"), F.substring(F.year("l_shipdate").cast("string"), 3, 2),
        F.lit("."))
    return inputs.spread(inputs.table(spark, sf, "lineitem"), "l_orderkey").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity",
        body.alias("text"))


PRICE_TEXTS = """
price_texts AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity,
    CASE l_returnflag WHEN 'A' THEN 'Le prix moyen est de ' WHEN 'N' THEN 'Comptez entre '
         ELSE 'Nos tarifs sont de ' END || floor(l_extendedprice)::BIGINT
    || CASE WHEN l_returnflag = 'N' THEN ' € et ' || floor(l_extendedprice * 2)::BIGINT
            ELSE '' END || ' € '
    || CASE l_linenumber % 4 WHEN 0 THEN 'par kWc' WHEN 1 THEN 'pour une installation de 5 kWc'
            WHEN 2 THEN 'par m²' ELSE 'par panneau' END
    || CASE WHEN l_linestatus = 'O' THEN ' TVAC' ELSE ' hors TVA' END
    || CASE WHEN l_tax > 0.04 THEN ', pose comprise' WHEN l_tax < 0.02 THEN ', hors pose'
            ELSE '' END
    || CASE WHEN l_discount > 0.05 THEN ' avec batterie' ELSE '' END
    || ' en 20' || right(CAST(year(l_shipdate) AS VARCHAR), 2) || '.' AS text
  FROM lineitem)"""


# --------------------------------------------------------------- categories --
def _sql_category(raw: str, normal: str) -> str:
    vat = (f"regexp_matches({raw}, '{o.pattern(fv.VAT_AS_QUALIFIER_PATTERN)}') AND NOT "
           f"regexp_matches({raw}, '{o.pattern(fv.TAX_RATE_PATTERN)}')")
    pairs = [(f"regexp_matches({normal}, '{o.pattern(fv.GUARANTEED_OUTCOME_PATTERN)}')",
              "'GUARANTEED_SAVINGS'")]
    for vocabulary in (PROFILE.claim_categories, fv.UNIVERSAL_CATEGORY_HINTS):
        for name, terms in vocabulary.items():
            test = o.has_term(normal, terms)
            pairs.append((f"{test} AND NOT ({vat})" if name == "TAX" else test,
                          o.quoted(name)))
    priced = f"{o.contains(normal, fv.PRICE_WORDS)} OR regexp_matches({raw}, '[€$£]')"
    split = o.case([
        (o.contains(normal, fv.VENDOR_MARKERS), "'VENDOR_PRICE'"),
        (o.contains(normal, fv.AVERAGE_MARKERS), "'MARKET_AVERAGE'"),
        (f"regexp_matches({raw}, '{o.pattern(fv.RANGE_PATTERN)}') OR "
         f"{o.contains(normal, fv.RANGE_MARKERS)}", "'OBSERVED_PRICE_RANGE'")],
        "'MARKET_PRICE'")
    return o.case([*pairs, (priced, split)], "'GENERAL'")


def _categorised(rows, column: str):
    return classify.with_category(rows, column, PROFILE)


def claim_category_documents(spark, sf):
    return _categorised(inputs.documents(spark, sf), "body").select("doc_id", "category")


CATEGORISED_DOCUMENTS = f"""
categorised AS (
  SELECT doc_id, text, {_sql_category('text', 'n')} AS category
  FROM (SELECT doc_id, text, {o.norm('text')} AS n FROM documents))"""
CLAIM_CATEGORY_DOCUMENTS = o.with_(CATEGORISED_DOCUMENTS) + \
    "SELECT doc_id, category FROM categorised"


def claim_category_prices(spark, sf):
    return _categorised(price_texts(spark, sf), "text").select(
        "l_orderkey", "l_linenumber", "text", "category")


CLAIM_CATEGORY_PRICES = o.with_(PRICE_TEXTS) + f"""
SELECT l_orderkey, l_linenumber, text, {_sql_category('text', 'n')} AS category
FROM (SELECT *, {o.norm('text')} AS n FROM price_texts)"""


POLICY = "policy(category, risk, authority, freshness, minimum, rationale) AS (VALUES " \
    + ", ".join(f"({o.quoted(c)}, {o.quoted(r)}, {o.quoted(a)}, {o.quoted(f)}, {m}, "
                f"{o.quoted(why)})" for c, r, a, f, m, why in PROFILE.policy_rows()) + ")"


def claim_requirements(spark, sf):
    """Requirements of each document's category; some rows name one without policy."""
    rows = _categorised(inputs.documents(spark, sf), "body").withColumn(
        "category", F.when(F.col("lang") == "de", "TARIFF").otherwise(F.col("category")))
    return classify.claim_requirements(rows, PROFILE).select(
        "doc_id", "category", "risk", "authority_requirement", "freshness_requirement",
        "min_sources", F.col("risk").isNull().alias("quarantined"),
        F.concat_ws(" ", classify.acceptable_qualities(F.col("authority_requirement")))
        .alias("acceptable"))


CLAIM_REQUIREMENTS = o.with_(CATEGORISED_DOCUMENTS, POLICY) + f"""
SELECT doc_id, c.category AS category, risk, authority AS authority_requirement,
       freshness AS freshness_requirement, minimum AS min_sources,
       risk IS NULL AS quarantined,
       CASE authority {" ".join(f"WHEN '{a}' THEN '" + " ".join(
           q for q, r in fv.QUALITY_RANK.items() if r >= n and q != 'UNKNOWN') + "'"
           for a, n in fv.AUTHORITY_RANK.items())} ELSE '' END AS acceptable
FROM (SELECT k.doc_id, CASE WHEN d.lang = 'de' THEN 'TARIFF' ELSE k.category END AS category
      FROM categorised k JOIN documents d USING (doc_id)) c
LEFT JOIN policy p ON p.category = c.category"""


def claim_requirement_summary(spark, sf):
    rows = _categorised(inputs.documents(spark, sf), "body").withColumn(
        "package_id", F.col("source"))
    return classify.claim_summary(classify.claim_requirements(rows, PROFILE))


CLAIM_REQUIREMENT_SUMMARY = o.with_(CATEGORISED_DOCUMENTS, POLICY) + """
SELECT d.source AS package_id, k.category AS category, risk, count(*) AS claims
FROM categorised k JOIN documents d USING (doc_id) JOIN policy p ON p.category = k.category
GROUP BY ALL"""


def claim_risk(spark, sf):
    rows = inputs.documents(spark, sf).withColumns({
        "_n": text.normalise(F.col("body")), "host": text.bare_host(F.col("url"))})
    judged = rows.withColumn("risk", classify.simple_risk(
        F.col("body"), F.col("_n"), PROFILE)).withColumn(
            "quality", F.when(F.col("source") == "src5", "INSTITUTIONAL").otherwise(
                classify.source_quality(F.col("url"), F.col("host"), F.lit("web"))))
    s = classify.simple_sufficiency(F.col("risk"), F.col("quality"))
    return judged.select("doc_id", "risk", "quality", s["sufficient"].alias("sufficient"),
                         s["reason"].alias("reason"))


_RISK_UNITS = fv.RISK_QUANTIFIED_PATTERN.split("(?:", 1)[1]
CLAIM_RISK = rf"""
WITH judged AS (
  SELECT doc_id, CASE WHEN {o.contains('n', PROFILE.restricted_claims)}
                        OR {o.contains('n', fv.HIGH_RISK_TERMS)} THEN 'HIGH'
    WHEN regexp_matches(text, '(?i)(^|[^\p{{L}}\p{{N}}_/])\d[\d\s.,]*\s*(?:{_RISK_UNITS}')
      THEN 'MEDIUM' ELSE 'LOW' END AS risk,
    CASE WHEN source = 'src5' THEN 'INSTITUTIONAL' ELSE 'COMMERCIAL' END AS quality
  FROM (SELECT *, {o.norm('text')} AS n FROM documents)),
needs AS (
  SELECT *, CASE risk WHEN 'HIGH' THEN 'INSTITUTIONAL' WHEN 'MEDIUM' THEN 'SPECIALIST'
                      ELSE 'COMMUNITY' END AS needed FROM judged),
ruled AS (SELECT *, {o.rank('quality', fv.QUALITY_RANK)}
            >= {o.rank('needed', fv.QUALITY_RANK)} AS sufficient FROM needs)
SELECT doc_id, risk, quality, sufficient,
  CASE WHEN sufficient THEN risk || '-risk claim supported by a ' || quality
            || ' source (minimum ' || needed || ').'
       ELSE risk || '-risk claim needs at least a ' || needed || ' source; this one is '
            || quality || '.' END AS reason
FROM ruled"""


def price_context(spark, sf):
    rows = prices.with_price_context(price_texts(spark, sf), "text", "p")
    return rows.select(
        "l_orderkey", "l_linenumber",
        F.concat_ws(",", F.transform("p.amounts", lambda a: a.cast("string")))
        .alias("amounts"), "p.currency", "p.basis", "p.vat_status",
        "p.battery_included", "p.installation_included", "p.is_range", "p.usable",
        prices.describe(F.col("p")).alias("description"))


PRICE_CONTEXTS = r"""
priced AS (
  SELECT *, list_sort(list_distinct(list_transform(
           regexp_extract_all(text, '(\d[\d\s.,]*)\s*(?:€|eur\b|euros?\b)', 1),
           lambda a: regexp_replace(a, '[^0-9]', '', 'g')::BIGINT))) AS amounts,
    CASE WHEN regexp_matches(text, '(?:/|par\s+)\s*kw(?:c|p)\b', 'i') THEN 'PER_KWP'
         WHEN regexp_matches(text, '(?:/|par\s+)\s*m[²2]') THEN 'PER_M2'
         WHEN regexp_matches(text, '\binstallation\b') THEN 'TOTAL'
         ELSE 'UNKNOWN' END AS basis,
    CASE WHEN regexp_matches(text, '\bTVAC\b') THEN 'INCLUDED'
         WHEN regexp_matches(text, '\bhors\s+TVA\b') THEN 'EXCLUDED'
         ELSE 'UNKNOWN' END AS vat_status,
    CASE WHEN contains(text, 'avec batterie') THEN true END AS battery_included,
    CASE WHEN contains(text, 'pose comprise') THEN true
         WHEN contains(text, 'hors pose') THEN false END AS installation_included
  FROM price_texts)"""
PRICE_CONTEXT = o.with_(PRICE_TEXTS, PRICE_CONTEXTS) + """
SELECT l_orderkey, l_linenumber,
  array_to_string(amounts, ',') AS amounts, 'EUR' AS currency, basis, vat_status,
  battery_included, installation_included, len(amounts) > 1 AS is_range,
  basis <> 'UNKNOWN' AS usable,
  concat_ws(', ', CASE WHEN len(amounts) > 1 THEN amounts[1] || '–' || amounts[-1]
                       ELSE amounts[1]::VARCHAR END || ' EUR',
    CASE basis WHEN 'TOTAL' THEN 'for the whole installation' WHEN 'PER_KWP' THEN 'per kWc'
         WHEN 'PER_M2' THEN 'per m²' ELSE 'basis not stated' END,
    CASE WHEN contains(text, '5 kWc') THEN '5 kWc' END,
    CASE vat_status WHEN 'INCLUDED' THEN 'VAT included' ELSE 'VAT excluded' END,
    CASE WHEN installation_included THEN 'installation included'
         WHEN NOT installation_included THEN 'installation excluded' END,
    CASE WHEN battery_included THEN 'battery included' END) AS description
FROM priced"""


QUERIES = {
    "passage_extraction": (passage_extraction, PASSAGE_EXTRACTION),
    "passage_drop_summary": (passage_drop_summary, PASSAGE_DROP_SUMMARY),
    "atomic_claims": (atomic_claims, ATOMIC_CLAIMS),
    "deduplicated_claims": (deduplicated_claims, DEDUPLICATED_CLAIMS),
    "claim_set_summary": (claim_set_summary, CLAIM_SET_SUMMARY),
    "claim_category_documents": (claim_category_documents, CLAIM_CATEGORY_DOCUMENTS),
    "claim_category_prices": (claim_category_prices, CLAIM_CATEGORY_PRICES),
    "claim_requirements": (claim_requirements, CLAIM_REQUIREMENTS),
    "claim_requirement_summary": (claim_requirement_summary, CLAIM_REQUIREMENT_SUMMARY),
    "claim_risk": (claim_risk, CLAIM_RISK),
    "price_context": (price_context, PRICE_CONTEXT),
}
