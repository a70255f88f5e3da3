"""Registered queries: leads, export, approvals, publication and audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from probatio import fixed_values as fv
from probatio.functions import contacts, keys
from probatio.operators import leads, publication, transitions
from probatio.plans import inputs, oracle as o
from probatio.plans.probe import SITE
from probatio.sources import sinks


# --------------------------------------------------------------------- leads --
def _leads(spark, sf):
    """Orders as captured leads of their customers."""
    orders, customers = (inputs.table(spark, sf, n) for n in ("orders", "customer"))
    state = (F.when(F.col("o_orderstatus") == "O", "NEW")
             .when(F.col("o_orderstatus") == "P", "PENDING_EXPORT").otherwise("EXPORTED"))
    return orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("lead_id"), state.alias("state"),
        F.concat(F.replace(F.lower("c_name"), F.lit("#"), F.lit(".")),
                 F.lit("@example.com")).alias("email"),
        F.when(F.col("c_acctbal") > 0, F.concat(F.lit("+32 2 "), F.col("o_custkey")
                                                .cast("string"), F.lit("0000")))
        .alias("phone"), F.col("o_orderdate").cast("timestamp").alias("created_at"))


LEADS = """
leads AS (
  SELECT o_orderkey AS lead_id, CASE o_orderstatus WHEN 'O' THEN 'NEW'
      WHEN 'P' THEN 'PENDING_EXPORT' ELSE 'EXPORTED' END AS state,
    replace(lower(c_name), '#', '.') || '@example.com' AS email,
    CASE WHEN c_acctbal > 0 THEN '+32 2 ' || o_custkey || '0000' END AS phone,
    o_orderdate AS created_at
  FROM orders JOIN customer ON o_custkey = c_custkey)"""


def _attribution(spark, sf):
    orders, customers = (inputs.table(spark, sf, n) for n in ("orders", "customer"))
    named = F.col("o_orderpriority") != "4-NOT SPECIFIED"
    return orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("lead_id"),
        F.when(named, F.col("o_orderpriority")).alias("utm_source"),
        F.when(named, F.col("c_mktsegment")).alias("channel"))


def attribution_counts(spark, sf):
    return leads.attribution_counts(
        _leads(spark, sf), _attribution(spark, sf), ["utm_source", "channel"])


ATTRIBUTION_COUNTS = """
SELECT CASE WHEN o_orderpriority <> '4-NOT SPECIFIED' THEN o_orderpriority END AS utm_source,
  CASE WHEN o_orderpriority <> '4-NOT SPECIFIED' THEN c_mktsegment END AS channel,
  count(*) AS leads, count(*) FILTER (o_orderstatus = 'F') AS exported
FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2"""


def lead_listing(spark, sf):
    return leads.listing(_leads(spark, sf), _attribution(spark, sf)).select(
        "lead_id", "state", "email", "has_phone", "channel")


LEAD_LISTING = o.with_(LEADS) + f"""
SELECT l.lead_id, l.state, left(email, 2) || '***@example.com' AS email,
  phone IS NOT NULL AS has_phone,
  CASE WHEN o_orderpriority <> '4-NOT SPECIFIED' THEN c_mktsegment END AS channel
FROM leads l
JOIN orders ON o_orderkey = lead_id JOIN customer ON o_custkey = c_custkey"""


def export_queue(spark, sf):
    return leads.export_queue(_leads(spark, sf)).select("lead_id", "state")


EXPORT_QUEUE = o.with_(LEADS) + f"""
SELECT lead_id, state FROM leads WHERE state IN ('NEW', 'PENDING_EXPORT')
ORDER BY created_at, lead_id"""


def _submissions(spark, sf):
    """Customers as form submissions with good and bad answers."""
    c = inputs.table(spark, sf, "customer")
    key, balance = F.col("c_custkey"), F.col("c_acctbal")
    postcode = F.when(key % 5 == 0, "0123").otherwise(
        F.concat(F.lit(" "), (1000 + key % 9000).cast("string")))
    answers = F.create_map(
        F.lit("owner_status"), F.col("c_mktsegment"), F.lit("postcode"), postcode,
        F.lit("balance"), balance.cast("string"), F.lit("first_name"), F.col("c_name"),
        F.lit("unknown"), F.lit("x"))
    return c.select(
        key.alias("submission_id"), answers.alias("qualification"),
        F.when(key % 13 == 0, "not an address").otherwise(F.concat(
            F.lit(" "), F.regexp_replace("c_name", "[^A-Za-z0-9]", "."),
            F.lit("@Example.com"))).alias("email"),
        F.when(key % 17 == 0, "NEWSLETTER").otherwise("CONTACT").alias("conversion_type"),
        (key % 19 != 0).alias("consent_processing"),
        F.when(key % 2 == 0, "nl").otherwise("de").alias("language"),
        F.when(key % 3 == 0, "0032 2/123.45.67").when(key % 3 == 1, "12")
        .otherwise("02-123 45 67").alias("phone"),
        F.lit(None).cast("string").alias("postcode"),
        F.col("c_name").alias("first_name"), F.lit("\u0001 x ").alias("last_name"),
        F.when(key % 23 == 0, "honeypot field was filled").alias("spam_reason"))


def lead_validation(spark, sf):
    return leads.validate(_submissions(spark, sf), SITE).select(
        "submission_id", "accepted", "rejection_reason", "email", "phone", "postcode",
        "language", "last_name", "state")


LEAD_VALIDATION = """
WITH s AS (
  SELECT *, c_custkey AS k, ' ' || regexp_replace(c_name, '[^A-Za-z0-9]', '.', 'g')
           || '@Example.com' AS addr,
    c_mktsegment IN ('HOUSEHOLD', 'BUILDING', 'FURNITURE') AS owner, c_custkey % 5 <> 0 AS post
  FROM customer),
r AS (
  SELECT *, CASE WHEN k % 23 = 0 THEN 'submission rejected: honeypot field was filled'
    WHEN k % 17 = 0 THEN 'unknown conversion type ''NEWSLETTER'''
    WHEN k % 19 = 0 THEN 'consent to process the request is required'
    WHEN k % 13 = 0 THEN 'not a usable email address: ''not an address'''
    WHEN NOT owner OR NOT post THEN 'missing required answer(s): '
      || concat_ws(', ', CASE WHEN NOT owner THEN 'owner_status' END,
                   CASE WHEN NOT post THEN 'postcode' END) END AS reason FROM s)
SELECT k AS submission_id, reason IS NULL AS accepted, reason AS rejection_reason,
  CASE WHEN k % 13 <> 0 THEN lower(trim(addr)) END AS email,
  CASE k % 3 WHEN 0 THEN '+3221234567' WHEN 2 THEN '021234567' END AS phone,
  CASE WHEN post THEN CAST(1000 + k % 9000 AS VARCHAR) END AS postcode,
  CASE WHEN k % 2 = 0 THEN 'nl' ELSE 'fr' END AS language, 'x' AS last_name,
  CASE WHEN reason IS NULL THEN 'PENDING_EXPORT' END AS state
FROM r"""


def qualification_answers(spark, sf):
    return leads.validate(_submissions(spark, sf), SITE).select(
        "submission_id", F.explode("qualification").alias("key", "value"))


QUALIFICATION_ANSWERS = """
SELECT c_custkey AS submission_id, 'owner_status' AS key, c_mktsegment AS value
FROM customer WHERE c_mktsegment IN ('HOUSEHOLD', 'BUILDING', 'FURNITURE')
UNION ALL
SELECT c_custkey, 'postcode', CAST(1000 + c_custkey % 9000 AS VARCHAR)
FROM customer WHERE c_custkey % 5 <> 0
UNION ALL
SELECT c_custkey, 'balance', CASE WHEN c_acctbal = floor(c_acctbal)
  THEN CAST(floor(c_acctbal)::BIGINT AS VARCHAR) ELSE CAST(c_acctbal AS VARCHAR) END
FROM customer WHERE c_acctbal >= 0 AND c_acctbal <= 5000
UNION ALL
SELECT c_custkey, 'first_name', left(c_name, 12) FROM customer"""


def _spam_rows(spark, sf):
    """Events as submissions; a client is a user, some hit a honeypot or are too fast."""
    e = inputs.table(spark, sf, "events")
    return e.select(
        F.col("event_id").alias("submission_id"),
        keys.client_key(F.lit("salt"), F.col("user_id").cast("string")).alias("client_key"),
        F.col("ts").cast("timestamp").alias("submitted_at"),
        F.when(F.col("event_type") == "error", "filled").alias("honeypot"),
        F.when(F.col("value") < 2, 80).otherwise(5000).alias("elapsed_ms"))


def spam_verdicts(spark, sf):
    return leads.spam_verdicts(_spam_rows(spark, sf)).select(
        "submission_id", F.col("spam_reason").isNull().alias("accepted"), "spam_reason")


SPAM_VERDICTS = f"""
WITH RECURSIVE s AS (
  SELECT event_id, user_id, ts, event_type = 'error' AS honey, value < 2 AS fast
  FROM events),
q AS (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n
  FROM s WHERE NOT honey AND NOT fast),
walk AS (
  SELECT user_id, 0::BIGINT AS n, 0::BIGINT AS event_id, []::TIMESTAMP[] AS seen,
         true AS ok FROM (SELECT DISTINCT user_id FROM q)
  UNION ALL
  SELECT q.user_id, q.n, q.event_id,
    CASE WHEN len(list_filter(seen, lambda t: t >= q.ts - INTERVAL 3600 SECOND)) < 5
         THEN list_append(list_filter(seen, lambda t: t >= q.ts - INTERVAL 3600 SECOND),
                          q.ts)
         ELSE list_filter(seen, lambda t: t >= q.ts - INTERVAL 3600 SECOND) END,
    len(list_filter(seen, lambda t: t >= q.ts - INTERVAL 3600 SECOND)) < 5
  FROM walk JOIN q ON q.user_id = walk.user_id AND q.n = walk.n + 1)
SELECT event_id AS submission_id, false AS accepted,
  CASE WHEN honey THEN 'honeypot field was filled'
       ELSE 'submitted in 80ms, under the 2500ms floor' END AS spam_reason
FROM s WHERE honey OR fast
UNION ALL
SELECT event_id, ok, CASE WHEN NOT ok THEN '{leads.RATE_REASON}' END
FROM walk WHERE n > 0"""


def lead_export(spark, sf):
    """Line items as export attempts of their order's lead; part of the leads are
    exported or failed already, and some have earlier attempts."""
    statuses = F.array(*[F.lit(s).cast("int") for s in _STATUSES])
    attempts = inputs.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("lead_id"),
        F.col("l_shipdate").cast("timestamp").alias("attempt_ts"),
        F.struct("l_linenumber", "l_partkey").alias("attempt_id"),
        F.get(statuses, (F.col("l_partkey") % len(_STATUSES)).cast("int"))
        .alias("http_status"), F.col("l_partkey").cast("string").alias("prospect_id"))
    stored = _leads(spark, sf).select(
        "lead_id", F.when((F.col("state") == "EXPORTED") & (F.col("lead_id") % 3 == 0),
                          "EXPORT_FAILED").otherwise(F.col("state")).alias("state"),
        F.when(F.col("state") != "NEW", F.col("lead_id") % 6).alias("export_attempts"))
    return leads.fold_exports(stored, attempts).select(
        "lead_id", "state", "outcome", "export_attempts", "export_error",
        "remote_prospect_id", "ignored_attempts")


_STATUSES = (503, None, 429, 500, 503, 429, 201, 502, 503, 500, 200, 409, 503, 401, 422)
_STATUS_SQL = "[" + ", ".join("NULL" if s is None else str(s) for s in _STATUSES) + "]"
LEAD_EXPORT = o.with_(LEADS) + f""",
stored AS (
  SELECT lead_id, CASE WHEN state = 'EXPORTED' AND lead_id % 3 = 0 THEN 'EXPORT_FAILED'
      ELSE state END AS state,
    CASE WHEN state <> 'NEW' THEN lead_id % 6 ELSE 0 END AS had FROM leads),
tries AS (
  SELECT l_orderkey AS lead_id, l_partkey, row_number() OVER (PARTITION BY l_orderkey
           ORDER BY l_shipdate, l_linenumber, l_partkey) AS n,
         {_STATUS_SQL}[l_partkey % {len(_STATUSES)} + 1] AS st FROM lineitem),
classed AS (
  SELECT tries.*, state, had, CASE WHEN st = 201 THEN 'CREATED' WHEN st = 200 THEN 'REPLAY'
      WHEN st = 409 THEN 'CONFLICT' WHEN st IN (401, 403) THEN 'UNAUTHORIZED'
      WHEN st IS NULL OR st = 429 OR st BETWEEN 500 AND 599 THEN 'RETRYABLE'
      ELSE 'REJECTED' END AS c FROM tries JOIN stored USING (lead_id)),
stops AS (
  SELECT lead_id, min(n) AS stop FROM classed
  WHERE c <> 'RETRYABLE' OR had + n >= {fv.MAX_EXPORT_ATTEMPTS} GROUP BY 1),
applied AS (
  SELECT classed.* FROM classed LEFT JOIN stops USING (lead_id)
  WHERE state IN ('NEW', 'PENDING_EXPORT') AND n <= coalesce(stop, n)),
told AS (
  SELECT lead_id, max(n) AS k, last(st ORDER BY n) AS ls, last(c ORDER BY n) AS lc,
    last(l_partkey ORDER BY n) AS lp FROM applied GROUP BY 1)
SELECT s.lead_id,
  CASE WHEN k IS NULL THEN state WHEN lc IN ('CREATED', 'REPLAY') THEN 'EXPORTED'
       WHEN lc <> 'RETRYABLE' OR had + k >= {fv.MAX_EXPORT_ATTEMPTS} THEN 'EXPORT_FAILED'
       ELSE 'PENDING_EXPORT' END AS state,
  lc AS outcome, had + coalesce(k, 0) AS export_attempts,
  CASE WHEN k IS NULL OR lc IN ('CREATED', 'REPLAY') THEN NULL
       WHEN lc = 'CONFLICT' THEN 'CONFLICT: same correlation, divergent fingerprint'
       WHEN lc = 'UNAUTHORIZED' THEN 'UNAUTHORIZED: producer credential rejected (' || ls || ')'
       WHEN lc = 'REJECTED' THEN 'REJECTED: ' || ls
       WHEN had + k >= {fv.MAX_EXPORT_ATTEMPTS} THEN 'RETRY_EXHAUSTED after ' || (had + k)
         || ' attempt(s): ' || coalesce(CAST(ls AS VARCHAR), 'no response')
       ELSE 'RETRYABLE: ' || coalesce(CAST(ls AS VARCHAR), 'no response') END
    AS export_error,
  CASE WHEN lc <> 'RETRYABLE' THEN CAST(lp AS VARCHAR) END AS remote_prospect_id,
  coalesce(all_n, 0) - coalesce(k, 0) AS ignored_attempts
FROM stored s LEFT JOIN told USING (lead_id)
LEFT JOIN (SELECT lead_id, count(*) AS all_n FROM tries GROUP BY 1) USING (lead_id)"""


def export_payloads(spark, sf):
    """Frozen payloads: minted once, kept when already present."""
    rows = _leads(spark, sf).withColumns({
        "first_name": F.lit(None).cast("string"), "last_name": F.lit("x"),
        "qualification": F.create_map(F.lit("postcode"), F.lit("1000"), F.lit("other"),
                                      F.lit("y")),
        "consent_version": F.lit("v1"), "consent_timestamp": F.col("created_at"),
        "conversion_type": F.lit("CONTACT"),
        "external_correlation_id": F.when(F.col("lead_id") % 4 == 0, F.concat(
            F.lit("sl-old-"), F.col("lead_id").cast("string"))),
        "export_payload": F.when(F.col("lead_id") % 4 == 0, F.lit("{}"))})
    attribution = _attribution(spark, sf).withColumns({
        name: F.lit(None).cast("string") for name in (
            "source", "landing_path", "search_intent", "utm_medium", "utm_campaign")})
    frozen = leads.export_payload(rows, attribution, ["postcode"], "probe")
    return frozen.select(
        "lead_id", "external_correlation_id",
        F.get_json_object("export_payload", "$.contact.email").alias("email"),
        F.get_json_object("export_payload", "$.project.postcode").alias("postcode"),
        F.get_json_object("export_payload", "$.project.other").alias("other"),
        F.get_json_object("export_payload", "$.attribution.channel").alias("channel"))


EXPORT_PAYLOADS = o.with_(LEADS) + """
SELECT lead_id, CASE WHEN old THEN 'sl-old-' || lead_id
         ELSE 'sl-' || sha256('probe|' || lead_id) END AS external_correlation_id,
  CASE WHEN NOT old THEN email END AS email, CASE WHEN NOT old THEN '1000' END AS postcode,
  NULL::VARCHAR AS other,
  CASE WHEN NOT old AND o_orderpriority <> '4-NOT SPECIFIED' THEN c_mktsegment END AS channel
FROM (SELECT *, lead_id % 4 = 0 AS old FROM leads)
JOIN orders ON o_orderkey = lead_id JOIN customer ON o_custkey = c_custkey"""


def redacted_text(spark, sf):
    """Documents with secrets taken out of their text."""
    return inputs.documents(spark, sf).select(
        "doc_id", contacts.redact(F.col("body")).alias("text"))


REDACTED_TEXT = rf"""
SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text,
  '(?i)\b(api[_-]?key|secret|password|token|authorization|bearer)("?\s*[=:]\s*"?)([^\s"'',}}]+)',
  '\1\2{fv.REDACTED}', 'g'), '\b(sk-[A-Za-z0-9_\-]{{8,}})', '{fv.REDACTED}', 'g'),
  '\b(gh[pousr]_[A-Za-z0-9]{{8,}})', '{fv.REDACTED}', 'g') AS text
FROM documents"""


# -------------------------------------------------------------- transitions --
def _log(spark, sf, names):
    mapped = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return inputs.table(spark, sf, "events").select(
        F.concat_ws("/", F.col("user_id").cast("string"), F.floor(
            F.col("value") / 10).cast("string")).alias("key"),
        F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("step_id"),
        mapped[F.col("event_type")].alias("requested"))


_APPROVAL = {"view": "NEEDS_REVISION", "click": "NEEDS_REVISION", "signup": "PENDING",
             "purchase": "APPROVED", "error": "REJECTED"}
_PUBLICATION = {"view": "PENDING_APPROVAL", "click": "APPROVED", "signup": "STAGED",
                "purchase": "PUBLISHED", "error": "QA_FAILED"}


def approval_audit(spark, sf):
    return transitions.approval_audit(_log(spark, sf, _APPROVAL))


def publication_audit(spark, sf):
    return transitions.publication_audit(_log(spark, sf, _PUBLICATION))


def _walk(names: dict, table: dict, initial: str) -> str:
    requested = o.case([(f"event_type = '{a}'", f"'{b}'") for a, b in names.items()])
    allowed = ", ".join(f"'{a}>{b}'" for a, b in transitions.transition_rows(table))
    return f"""
WITH RECURSIVE log AS (
  SELECT user_id || '/' || floor(value / 10)::BIGINT AS key, {requested} AS requested,
         row_number() OVER (PARTITION BY user_id, floor(value / 10)
                            ORDER BY ts, event_id) AS n
  FROM events),
walk AS (
  SELECT DISTINCT key, 0::BIGINT AS n, '{initial}' AS state, false AS refused FROM log
  UNION ALL
  SELECT l.key, l.n,
    CASE WHEN w.state || '>' || l.requested IN ({allowed}) THEN l.requested
         ELSE w.state END,
    w.state || '>' || l.requested NOT IN ({allowed})
  FROM walk w JOIN log l ON l.key = w.key AND l.n = w.n + 1)
SELECT key, arg_max(state, n) AS final_state, count(*) FILTER (n > 0) AS attempts,
       count(*) FILTER (refused) AS refused
FROM walk GROUP BY 1"""


APPROVAL_AUDIT = _walk(_APPROVAL, fv.APPROVAL_TRANSITIONS, "PENDING")
PUBLICATION_AUDIT = _walk(_PUBLICATION, fv.PUBLICATION_TRANSITIONS, "DRAFT")


def pending_approvals(spark, sf):
    approvals = inputs.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("draft_id"),
        F.when(F.col("o_orderstatus") == "O", "PENDING").when(
            F.col("o_orderstatus") == "P", "NEEDS_REVISION").otherwise("APPROVED")
        .alias("state"), F.col("o_orderdate").cast("timestamp").alias("created_at"))
    drafts = inputs.table(spark, sf, "documents").select(
        F.col("doc_id").alias("draft_id"), inputs.first_sentence(F.col("text"))
        .alias("title"))
    return publication.pending_approvals(drafts, approvals).select(
        "draft_id", "state", "title")


PENDING_APPROVALS = o.with_(o.DOCUMENTS) + f"""
SELECT o_orderkey AS draft_id, CASE o_orderstatus WHEN 'O' THEN 'PENDING'
         ELSE 'NEEDS_REVISION' END AS state, title
FROM orders JOIN documents_in ON doc_id = o_orderkey WHERE o_orderstatus IN ('O', 'P')
ORDER BY o_orderdate DESC, o_orderkey"""


# -------------------------------------------------------------- publication --
def _published(spark, sf):
    """Orders as snapshots: an address per customer and locale."""
    orders = inputs.table(spark, sf, "orders")
    locale = F.when(F.col("o_orderpriority") < "3", "fr").otherwise("nl")
    slug = F.concat(F.lit("page-"), F.col("o_custkey").cast("string"))
    state = (F.when(F.col("o_orderstatus") == "F", "PUBLISHED")
             .when(F.col("o_orderstatus") == "O", "STAGED").otherwise("ARCHIVED"))
    return orders.select(
        F.lit(SITE.site_id).alias("site_id"), locale.alias("locale"), slug.alias("slug"),
        F.col("o_orderkey").alias("version"), state.alias("state"),
        F.concat(F.lit("Title "), slug).alias("title"),
        F.when(F.col("o_totalprice") > 100000, F.lit("Meta")).alias("meta_title"),
        F.lit("d").alias("meta_description"),
        publication.canonical_path(locale, slug, SITE).alias("canonical_path"),
        (F.col("o_totalprice") < 50000).alias("noindex"),
        F.col("o_orderdate").cast("timestamp").alias("updated_at"))


PUBLISHED = """
published AS (
  SELECT 'probe' AS site_id, CASE WHEN o_orderpriority < '3' THEN 'fr' ELSE 'nl' END
           AS locale, 'page-' || o_custkey AS slug, o_orderkey AS version,
    CASE o_orderstatus WHEN 'F' THEN 'PUBLISHED' WHEN 'O' THEN 'STAGED'
         ELSE 'ARCHIVED' END AS state,
    CASE WHEN o_totalprice > 100000 THEN 'Meta' ELSE 'Title page-' || o_custkey END
      AS meta_title,
    CASE WHEN o_orderpriority < '3' THEN '/' ELSE '/nl/' END || 'page-' || o_custkey
      AS canonical_path, o_totalprice < 50000 AS noindex FROM orders)"""


def next_versions(spark, sf):
    return publication.next_version(_published(spark, sf))


NEXT_VERSIONS = o.with_(PUBLISHED) + """
SELECT site_id, locale, slug, max(version) + 1 AS next_version FROM published
GROUP BY ALL"""


def staged_snapshots(spark, sf):
    """Documents staged to addresses, some of which exist already."""
    published = _published(spark, sf).withColumn("version", F.col("version") % 10)
    approved = inputs.table(spark, sf, "documents").select(
        F.col("doc_id").alias("draft_id"), F.when(F.col("lang") == "fr", "fr").when(
            F.col("lang") == "de", "de").alias("locale"),
        F.concat(F.lit("Page "), (F.col("doc_id") % 50).cast("string")).alias("slug"),
        F.to_timestamp(F.lit("2024-01-01")).alias("staged_at"))
    return publication.stage(approved, published, SITE).select(
        "draft_id", "locale", "slug", "version", "state", "refusal", "canonical_path",
        "noindex")


STAGED_SNAPSHOTS = o.with_(PUBLISHED) + """,
latest AS (SELECT locale, slug, max(version % 10) AS base FROM published GROUP BY 1, 2),
drafts AS (
  SELECT doc_id AS draft_id, CASE lang WHEN 'de' THEN 'de' ELSE 'fr' END AS locale,
         'page-' || doc_id % 50 AS slug FROM documents)
SELECT draft_id, d.locale AS locale, d.slug AS slug, coalesce(base, 0) + row_number() OVER (
    PARTITION BY d.locale, d.slug ORDER BY draft_id) AS version,
  CASE WHEN d.locale = 'fr' THEN 'STAGED' END AS state,
  CASE WHEN d.locale = 'de' THEN 'locale ''de'' is not supported by site probe' END
    AS refusal,
  CASE WHEN d.locale = 'fr' THEN '/' ELSE '/de/' END || d.slug AS canonical_path,
  false AS noindex
FROM drafts d LEFT JOIN latest l ON l.locale = d.locale AND l.slug = d.slug"""


def archived_superseded(spark, sf):
    return publication.archive_superseded(_published(spark, sf)).select(
        "locale", "slug", "version", "state")


ARCHIVED_SUPERSEDED = o.with_(PUBLISHED) + """
SELECT locale, slug, version, CASE WHEN state = 'PUBLISHED' AND version < max(version)
    FILTER (state = 'PUBLISHED') OVER (PARTITION BY locale, slug) THEN 'ARCHIVED'
  ELSE state END AS state
FROM published"""


def preview_pages(spark, sf):
    return publication.preview_pages(_published(spark, sf), SITE).select(
        "locale", "slug", "version", "state", "meta_title", "canonical_url", "noindex")


PREVIEW_PAGES = o.with_(PUBLISHED) + """
SELECT locale, slug, version, state, meta_title,
       'https://probe.example.com' || canonical_path AS canonical_url, true AS noindex
FROM published WHERE state IN ('STAGED', 'PUBLISHED')
QUALIFY row_number() OVER (PARTITION BY locale, slug ORDER BY version DESC) = 1"""


def public_pages(spark, sf):
    live = publication.archive_superseded(_published(spark, sf))
    return publication.public_pages(live, SITE).select(
        "locale", "slug", "version", "meta_title", "canonical_url", "noindex",
        "primary_cta")


PUBLIC_PAGES = o.with_(PUBLISHED) + """
SELECT locale, slug, version, meta_title,
       'https://probe.example.com' || canonical_path AS canonical_url, noindex,
       'ESTIMATE_REQUEST' AS primary_cta
FROM published WHERE state = 'PUBLISHED'
QUALIFY row_number() OVER (PARTITION BY locale, slug ORDER BY version DESC) = 1"""


def sitemap(spark, sf):
    live = publication.archive_superseded(_published(spark, sf))
    return publication.sitemap(live, SITE).select("locale", "url")


SITEMAP = f"""
SELECT locale, canonical_url AS url FROM ({PUBLIC_PAGES}) WHERE NOT noindex"""


def publication_gate(spark, sf):
    """Documents as drafts, events as reviews, orders as approvals."""
    drafts = inputs.table(spark, sf, "documents").select(
        F.col("doc_id").alias("draft_id"), F.when(
            F.col("lang") == "es", F.concat("text", F.lit(" [x](https://a.example)")))
        .otherwise(F.col("text")).alias("body"))
    kind = F.col("event_id") % 5
    reviews = inputs.table(spark, sf, "events").select(
        F.col("user_id").alias("draft_id"), F.lit("DETERMINISTIC").alias("qa_type"),
        F.when(kind < 2, "FACTUAL").when(kind < 4, "SEO").alias("layer"),
        F.when(F.col("event_type") == "error", "FAILED").otherwise("PASSED")
        .alias("status"), F.when(F.col("value") < 30, 100).otherwise(75).alias("score"),
        F.when(F.col("event_type") == "signup", F.array(F.lit("WEAK_STRUCTURE")))
        .when(F.col("event_type") == "view", F.array(F.lit("UNSUPPORTED_DRAFT_CLAIM")))
        .otherwise(F.array().cast("array<string>")).alias("codes"),
        F.when(F.col("value") > 60, 1).otherwise(0).alias("blocking_issues")
    )
    approvals = inputs.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("draft_id"), F.when(
            F.col("o_orderstatus") == "P", "PENDING").otherwise("APPROVED").alias("state"))
    return publication.gate(drafts, reviews, approvals).select(
        "draft_id", "factual_qa", "seo_qa", "approved", "no_external_links", "passed",
        F.array_join("reasons", "; ").alias("reasons"))


def draft_previews(spark, sf):
    """Every document as a draft for review, with what its gate still asks for."""
    drafts = inputs.table(spark, sf, "documents").select(
        F.col("doc_id").alias("draft_id"), F.concat(F.lit("Titre É "), "source").alias("title"),
        F.when(F.col("lang") == "fr", F.concat(F.lit("Page Ü/"), F.col("doc_id").cast("string")))
        .alias("recommended_slug"), F.concat(F.lit("--"), F.coalesce("lang", F.lit("")))
        .alias("primary_query"))
    return publication.draft_preview(drafts, publication_gate(spark, sf), SITE).select(
        "draft_id", "locale", "slug", "title", "canonical_path", "canonical_url", "noindex",
        "version", "state", "gate_passed", "gate_reasons")


PUBLICATION_GATE = """
WITH reviews AS (
  SELECT user_id AS draft_id, CASE WHEN event_id % 5 < 2 THEN 'FACTUAL'
      WHEN event_id % 5 < 4 THEN 'SEO' WHEN event_type = 'view' THEN 'FACTUAL'
      WHEN event_type = 'signup' THEN 'SEO' WHEN value < 30 THEN 'FACTUAL'
      ELSE 'SEO' END AS layer,
    event_type <> 'error' AND NOT value > 60 AS good
  FROM events),
per AS (
  SELECT draft_id, count(*) FILTER (layer = 'FACTUAL') AS nf,
    count(*) FILTER (layer = 'SEO') AS ns,
    count(*) FILTER (layer = 'FACTUAL' AND NOT good) = 0 AS okf,
    count(*) FILTER (layer = 'SEO' AND NOT good) = 0 AS oks FROM reviews GROUP BY 1),
rows_ AS (
  SELECT doc_id, coalesce(nf, 0) AS nf, coalesce(ns, 0) AS ns,
    coalesce(nf > 0 AND okf, false) AS f, coalesce(ns > 0 AND oks, false) AS s,
    CASE WHEN o_orderkey IS NULL THEN NULL WHEN o_orderstatus = 'P' THEN 'PENDING'
         ELSE 'APPROVED' END AS st,
    NOT (lang = 'es' OR regexp_matches(text, '\\[([^\\]]*)\\]\\(([^)]*)\\)')
         OR regexp_matches(text, '(?i)https?://\\S+|www\\.\\S+')) AS clean
  FROM documents LEFT JOIN per ON draft_id = doc_id LEFT JOIN orders ON o_orderkey = doc_id)
SELECT doc_id AS draft_id, f AS factual_qa, s AS seo_qa,
  coalesce(st = 'APPROVED', false) AS approved, clean AS no_external_links,
  f AND s AND coalesce(st = 'APPROVED', false) AND clean AS passed,
  concat_ws('; ', CASE WHEN nf = 0 THEN 'no factual QA review is recorded for this draft'
                       WHEN NOT f THEN 'factual QA did not pass' END,
    CASE WHEN ns = 0 THEN 'no SEO QA review is recorded for this draft'
         WHEN NOT s THEN 'SEO QA did not pass' END,
    CASE WHEN st IS NULL THEN 'no human approval recorded'
         WHEN st <> 'APPROVED' THEN 'approval state is ' || st || ', not APPROVED' END,
    CASE WHEN NOT clean THEN 'the draft body contains an outbound link' END) AS reasons
FROM rows_"""


# ------------------------------------------------------------------- audits --
def constraint_audit(spark, sf):
    """Driver tables seen as stored tables; several rules are broken on purpose."""
    orders, events, part, line, supplier = (
        inputs.table(spark, sf, n) for n in ("orders", "events", "part", "lineitem", "supplier"))
    size = F.col("p_size")
    return sinks.audit({
        "captured_lead": orders.select(
            F.col("o_orderstatus").alias("state"), F.lit("CONTACT")
            .alias("conversion_type"),
            F.col("o_custkey").cast("string").alias("external_correlation_id")),
        "site_event": events.select(F.upper("event_type").alias("event_type")),
        "approval": events.select(
            F.when(F.col("value") > 50, "APPROVED").alias("state"),
            F.col("event_id").alias("draft_id")),
        "keyword_metric": part.select(
            F.get(F.array(*map(F.lit, ("OBSERVED", "UNKNOWN", "MEASURED", None))),
                  (size % 4).cast("int")).alias("observability"),
            F.when(size % 7 > 0, F.col("p_brand")).alias("provider"),
            F.lit("search_volume").alias("metric_type"),
            F.when(size % 5 > 0, F.current_timestamp()).alias("retrieved_at"),
            F.when(size % 3 > 0, F.col("p_retailprice")).alias("value"),
            F.when(size % 2 > 0, F.col("p_type")).alias("value_text")),
        "seo_opportunity": supplier.select(
            F.floor(F.col("s_acctbal") / 50).alias("overall_score")),
        "research_evidence": line.select(
            F.lit("OBSERVED").alias("observability"),
            F.when(F.col("l_linenumber") > 3, "OFFICIAL").when(F.col("l_linenumber") > 1, "any")
            .alias("authority_requirement"),
            F.when(F.col("l_tax") > 0.04, "REQUIRED").when(F.col("l_tax") > 0.02, "SOON")
            .alias("freshness_requirement")),
        "evidence_passage": line.select(
            F.when(F.col("l_returnflag") == "A", True).when(F.col("l_returnflag") == "N", False)
            .alias("supports"),
            F.when(F.col("l_discount") > 0.05, F.col("l_linestatus") == "O").alias("agrees")),
    })


CONSTRAINT_AUDIT = """
SELECT 'captured_lead' AS "table", 'CHECK' AS rule, 'state' AS key,
       o_orderstatus AS value, count(*) AS rows FROM orders GROUP BY 4
UNION ALL SELECT 'captured_lead', 'UNIQUE', 'external_correlation_id',
       CAST(o_custkey AS VARCHAR), count(*) FROM orders GROUP BY 4 HAVING count(*) > 1
UNION ALL SELECT 'site_event', 'CHECK', 'event_type', upper(event_type), count(*)
  FROM events GROUP BY 4
UNION ALL SELECT 'approval', 'CHECK', 'state', NULL, count(*)
  FROM events WHERE NOT value > 50 HAVING count(*) > 0
UNION ALL SELECT 'keyword_metric', 'CHECK', 'observability',
       CASE WHEN p_size % 4 = 2 THEN 'MEASURED' END, count(*) FROM part WHERE p_size % 4 > 1
  GROUP BY 4
UNION ALL SELECT 'keyword_metric', 'NOT NULL', 'provider', NULL, count(*) FROM part
  WHERE p_size % 7 = 0 HAVING count(*) > 0
UNION ALL SELECT 'keyword_metric', 'NOT NULL', 'retrieved_at', NULL, count(*) FROM part
  WHERE p_size % 5 = 0 HAVING count(*) > 0
UNION ALL SELECT 'keyword_metric', 'TOGETHER', 'metric_without_value', 'NULL|NULL', count(*) FROM part
  WHERE p_size % 6 = 0 HAVING count(*) > 0
UNION ALL SELECT 'seo_opportunity', 'RANGE', 'overall_score',
       CAST(floor(s_acctbal / 50)::BIGINT AS VARCHAR), count(*) FROM supplier
  WHERE floor(s_acctbal / 50) NOT BETWEEN 0 AND 100 GROUP BY 4
UNION ALL SELECT 'research_evidence', 'CHECK', 'authority_requirement', 'any', count(*)
  FROM lineitem WHERE l_linenumber IN (2, 3) HAVING count(*) > 0
UNION ALL SELECT 'research_evidence', 'CHECK', 'freshness_requirement', 'SOON', count(*)
  FROM lineitem WHERE l_tax > 0.02 AND NOT l_tax > 0.04 HAVING count(*) > 0
UNION ALL SELECT 'evidence_passage', 'NOT NULL', 'supports', NULL, count(*)
  FROM lineitem WHERE l_returnflag NOT IN ('A', 'N') HAVING count(*) > 0
UNION ALL SELECT 'evidence_passage', 'TOGETHER', 'support_that_disagrees', 'true|false', count(*)
  FROM lineitem WHERE l_returnflag = 'A' AND l_discount > 0.05 AND l_linestatus <> 'O'
  HAVING count(*) > 0"""


def site_audit(spark, sf):
    """Suppliers as site documents."""
    s = inputs.table(spark, sf, "supplier")
    key = F.col("s_suppkey")
    return sinks.audit_sites(s.select(
        key.alias("site_id"), F.when(key % 2 == 0, F.concat(
            F.lit("s"), key.cast("string"), F.lit(".example"))).alias("domain"),
        (key % 3 == 0).alias("staging"),
        F.when(key % 5 == 0, "http://localhost/").when(key % 5 == 1, F.concat(
            F.lit("https://s"), key.cast("string"), F.lit(".example")))
        .alias("canonical_origin"),
        (key % 7 < 4).alias("allow_publication"), (key % 7 < 2).alias("allow_indexing"),
        F.when(key % 11 == 0, "xx").otherwise("fr").alias("default_language"),
        F.array(F.lit("fr"), F.lit("nl")).alias("supported_languages")))


SITE_AUDIT = """
WITH s AS (
  SELECT s_suppkey AS k, CASE WHEN s_suppkey % 2 = 0 THEN 's' || s_suppkey || '.example' END
           AS domain, CASE s_suppkey % 5 WHEN 0 THEN 'http://localhost/'
           WHEN 1 THEN 'https://s' || s_suppkey || '.example' ELSE '' END AS o,
         s_suppkey % 3 = 0 AS staging, s_suppkey % 7 < 4 AS pub, s_suppkey % 7 < 2 AS idx
  FROM supplier)
SELECT k AS site_id, unnest(list_filter([
  CASE WHEN o LIKE 'http:%' THEN 'origin_not_https' END,
  CASE WHEN o LIKE '%/' THEN 'origin_trailing_slash' END,
  CASE WHEN o LIKE '%localhost%' THEN 'origin_internal_host' END,
  CASE WHEN o <> '' AND domain IS NOT NULL AND NOT contains(o, domain)
       THEN 'origin_not_domain' END,
  CASE WHEN domain IS NULL AND NOT staging THEN 'no_domain_not_staging' END,
  CASE WHEN staging AND idx THEN 'staging_indexed' END,
  CASE WHEN idx AND NOT pub THEN 'indexing_without_publication' END,
  CASE WHEN pub AND domain IS NULL THEN 'publication_without_domain' END,
  CASE WHEN k % 11 = 0 THEN 'default_language_unsupported' END],
  lambda r: r IS NOT NULL)) AS rule
FROM s"""


DRAFT_PREVIEWS = f"""
WITH slugged AS (
  SELECT doc_id, 'Titre É ' || source AS title, CASE WHEN lang = 'fr' THEN 'page-u-' || doc_id
    WHEN coalesce(lang, '') = '' THEN 'page' ELSE lang END AS slug FROM documents)
SELECT draft_id, 'fr' AS locale, slug, title, '/' || slug AS canonical_path,
  'https://probe.example.com/' || slug AS canonical_url, true AS noindex, 0 AS version,
  'DRAFT_PREVIEW' AS state, passed AS gate_passed, reasons AS gate_reasons
FROM ({PUBLICATION_GATE}) JOIN slugged ON doc_id = draft_id"""


QUERIES = {
    "draft_previews": (draft_previews, DRAFT_PREVIEWS),
    "attribution_counts": (attribution_counts, ATTRIBUTION_COUNTS),
    "lead_listing": (lead_listing, LEAD_LISTING),
    "export_queue": (export_queue, EXPORT_QUEUE),
    "lead_validation": (lead_validation, LEAD_VALIDATION),
    "qualification_answers": (qualification_answers, QUALIFICATION_ANSWERS),
    "spam_verdicts": (spam_verdicts, SPAM_VERDICTS),
    "lead_export": (lead_export, LEAD_EXPORT),
    "export_payloads": (export_payloads, EXPORT_PAYLOADS),
    "redacted_text": (redacted_text, REDACTED_TEXT),
    "approval_audit": (approval_audit, APPROVAL_AUDIT),
    "publication_audit": (publication_audit, PUBLICATION_AUDIT),
    "pending_approvals": (pending_approvals, PENDING_APPROVALS),
    "next_versions": (next_versions, NEXT_VERSIONS),
    "staged_snapshots": (staged_snapshots, STAGED_SNAPSHOTS),
    "archived_superseded": (archived_superseded, ARCHIVED_SUPERSEDED),
    "preview_pages": (preview_pages, PREVIEW_PAGES),
    "public_pages": (public_pages, PUBLIC_PAGES),
    "sitemap": (sitemap, SITEMAP),
    "publication_gate": (publication_gate, PUBLICATION_GATE),
    "constraint_audit": (constraint_audit, CONSTRAINT_AUDIT),
    "site_audit": (site_audit, SITE_AUDIT),
}
