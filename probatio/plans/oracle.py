"""SQL snippets for the DuckDB twins of the registered queries.

The twins restate each job independently in SQL; they share only the vocabulary.
"""

from __future__ import annotations

import re

from probatio import fixed_values as fv
from probatio.functions import text


def quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def listed(values) -> str:
    return ", ".join(quoted(v) for v in values)


def array(values) -> str:
    return f"[{listed(values)}]::VARCHAR[]"


def norm(x: str) -> str:
    return (f"trim(regexp_replace(replace(strip_accents(lower(coalesce({x}, ''))), "
            f"'ß', 'ss'), '\\s+', ' ', 'g'))")


def stem(w: str) -> str:
    return (f"CASE WHEN length({w}) <= 4 THEN {w} "
            f"WHEN {w} LIKE '%eaux' THEN left({w}, length({w}) - 1) "
            f"WHEN {w} LIKE '%aux' THEN left({w}, length({w}) - 3) || 'al' "
            f"WHEN right({w}, 1) IN ('s', 'x') THEN left({w}, length({w}) - 1) "
            f"ELSE {w} END")


def tokens(x: str, stopwords=fv.GATE_STOPWORDS) -> str:
    return (f"list_distinct(list_transform(list_filter(regexp_extract_all({norm(x)}, "
            f"'[a-z0-9]+'), lambda w: length(w) > 2 AND w NOT IN ({listed(stopwords)})), "
            f"lambda w: {stem('w')}))")


def match_tokens(x: str) -> str:
    return tokens(x, fv.MATCH_STOPWORDS)


def minus(a: str, values) -> str:
    """List difference against constants (a list or SQL text)."""
    other = values if isinstance(values, str) else array(values)
    return f"list_filter({a}, lambda v: NOT list_contains({other}, v))"


def alternation(terms) -> str:
    body = text._alternation(terms) or "\\b\\B"
    return body.replace("'", "''")


def whole(terms) -> str:
    return (r"(^|[^\p{L}\p{N}_])(?:" + alternation(terms) + r")([^\p{L}\p{N}_]|$)")


def has_term(x: str, terms) -> str:
    return f"regexp_matches({x}, '{whole(terms)}')" if list(terms) else "false"


def contains(x: str, terms) -> str:
    return f"regexp_matches({x}, '{alternation(terms)}')" if list(terms) else "false"


def pattern(java: str) -> str:
    """A fixed pattern for RE2: flags adapted, the rest unchanged."""
    flags = re.match(r"\(\?([a-zA-Z]+)\)", java)
    body = java[flags.end():] if flags else java
    kept = "".join(f for f in (flags.group(1) if flags else "") if f in "ism")
    body = (f"(?{kept})" if kept else "") + body
    return body.replace("'", "''")


def first_sentence(x: str) -> str:
    return f"regexp_extract({x}, '^[^.!?\\n]*')"


def sentences(x: str, closers: str = ".!?") -> str:
    """Sentence list: a marker goes where a closer meets a capital or a digit."""
    return (f"string_split(regexp_replace({x}, '([{closers}])\\s+([A-ZÀ-ÿ0-9])', "
            f"'\\1' || chr(31) || '\\2', 'g'), chr(31))")


def host(url: str) -> str:
    return (f"nullif(lower(regexp_extract({url}, '^[a-zA-Z]+://([^/?#:]+)', 1)), '')")


def bare_host(url: str) -> str:
    return f"regexp_replace({host(url)}, '^www\\.', '')"


def case(pairs, default: str = "NULL") -> str:
    body = " ".join(f"WHEN {test} THEN {value}" for test, value in pairs)
    return f"CASE {body} ELSE {default} END"


def rank(x: str, ranks: dict[str, int]) -> str:
    return case([(f"{x} = {quoted(k)}", str(v)) for k, v in ranks.items()])


def tenth(x: str) -> str:
    """One decimal, half to even on the exact binary value, in whole numbers."""
    n = f"(({x})::DOUBLE * {float(2 ** 56)!r})::HUGEINT * 10"
    unit, half = 2 ** 56, 2 ** 55
    q, r = f"(({n}) // {unit})", f"(({n}) % {unit})"
    return (f"(({q} + CASE WHEN {r} > {half} OR ({r} = {half} AND {q} % 2 = 1) THEN 1 "
            f"ELSE 0 END)::DOUBLE / 10)")


DOCUMENT_URL = ("'https://' || source || '.example.' || CASE lang WHEN 'fr' THEN 'net' "
                "WHEN 'es' THEN 'org' ELSE 'com' END || '/' || doc_id")

DOCUMENTS = f"""
documents_in AS (
  SELECT doc_id, {first_sentence('text')} AS title, text AS body,
         {DOCUMENT_URL} AS url, source, lang
  FROM documents)"""

SOURCES = DOCUMENTS + """,
sources_in AS (
  SELECT doc_id % (SELECT count(*) FROM benchmark) AS package_id, doc_id,
         CAST(doc_id AS VARCHAR) AS source_ref, title, body, url, source, lang
  FROM documents_in)"""


def query_profiles(profile) -> str:
    gate = tokens("query")
    return f"""
queries_in AS (
  SELECT item_id AS package_id, {first_sentence('text')} AS query FROM benchmark),
query_tokens AS (SELECT package_id, query, {gate} AS toks FROM queries_in),
profiles AS (
  SELECT package_id, query,
         list_sort({minus(minus('toks', profile.modifier_tokens), profile.market_tokens)})
           AS topic,
         list_sort(list_intersect(toks, {array(profile.modifier_tokens)})) AS modifier,
         list_sort(list_intersect(toks, {array(profile.market_tokens)})) AS market
  FROM query_tokens)"""


def gate_score(topic: str, modifier: str, title: str, body: str, domain: str,
               hits: str) -> str:
    def share(part: str, whole_: str) -> str:
        return f"(CASE WHEN {whole_} > 0 THEN ({part}) / {whole_}::DOUBLE ELSE 0.0::DOUBLE END)"

    t, b, d = share(title, topic), share(body, topic), share(domain, topic)
    return (f"least(1.0::DOUBLE, greatest({fv.TITLE_WEIGHT}::DOUBLE * {t} + "
            f"{fv.BODY_WEIGHT}::DOUBLE * {b}, {fv.BODY_ONLY_WEIGHT}::DOUBLE * {b}, "
            f"{fv.DOMAIN_WEIGHT}::DOUBLE * {d}) + {fv.MODIFIER_WEIGHT}::DOUBLE * "
            f"{share(hits, modifier)})")


def gate_status(score: str) -> str:
    return (f"CASE WHEN {score} >= {fv.RELEVANT_AT} THEN 'RELEVANT' "
            f"WHEN {score} >= {fv.LOW_RELEVANCE_AT} THEN 'LOW_RELEVANCE' "
            f"ELSE 'IRRELEVANT' END")


def gate_rows(rows: str, profile) -> str:
    """CTEs that label the rows of a source-shaped CTE: gated."""
    host_words = f"replace(coalesce({host('url')}, ''), '.', ' ')"
    return f"""
tokenised AS (
  SELECT s.*, p.topic, p.modifier, {tokens('s.title')} AS tt, {tokens('s.body')} AS bt,
         {tokens(host_words)} AS dt
  FROM {rows} s LEFT JOIN profiles p USING (package_id)),
counted AS (
  SELECT *, list_sort(list_intersect(topic, list_distinct(list_concat(tt, bt, dt))))
              AS topic_matched,
         list_sort(list_intersect(modifier, list_distinct(list_concat(tt, bt))))
              AS modifier_matched,
         len(list_intersect(topic, tt)) AS nt, len(list_intersect(topic, bt)) AS nb,
         len(list_intersect(topic, dt)) AS nd
  FROM tokenised),
scored AS (
  SELECT *, {gate_score('len(topic)', 'len(modifier)', 'nt', 'nb', 'nd',
                        'len(modifier_matched)')} AS raw_score FROM counted),
gated AS (
  SELECT *, CASE WHEN coalesce(len(topic), 0) = 0 THEN 'UNKNOWN'
                 WHEN len(topic_matched) = 0 THEN 'IRRELEVANT'
                 ELSE {gate_status('raw_score')} END AS relevance_status,
         CASE WHEN coalesce(len(topic), 0) = 0 OR len(topic_matched) = 0 THEN 0.0
              ELSE raw_score END AS relevance_score
  FROM scored)"""


def with_(*ctes: str) -> str:
    return "WITH " + ",".join(c.strip().rstrip(",") for c in ctes) + "\n"
