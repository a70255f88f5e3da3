"""Lead validation, spam verdicts, export folding and listings."""

from __future__ import annotations

from collections import deque

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from probatio import fixed_values as fv
from probatio.functions import contacts, text
from probatio.profiles import Site

PREFIX = "sl"  # fixed value: correlation ids are "<prefix>-<id>"


# ------------------------------------------------------------ qualification --
def qualification(raw: Column, site: Site) -> Column:
    """Answers the site defined, coerced to their type; unknown keys are dropped.

    Field definitions are configuration, so each becomes one expression and no row
    is exploded or regrouped.
    """
    entries = []
    for field in site.fields:
        key, kind = field.get("key"), field.get("type", "text")
        if not key or kind == "consent":
            continue
        answer = F.try_element_at(raw, F.lit(key))
        entries.append(F.when(_answer(answer, kind, field).isNotNull(), F.struct(
            F.lit(key).alias("key"), _answer(answer, kind, field).alias("value"))))
    if not entries:
        return F.create_map().cast("map<string,string>")
    return F.map_from_entries(F.array_compact(F.array(*entries)))


def _answer(answer: Column, kind: str, field: dict) -> Column:
    if kind == "choice":
        allowed = [str(o.get("value")) for o in field.get("options") or []]
        return F.when(answer.isin(*allowed), answer)
    if kind == "number":
        number = answer.try_cast("double")
        test = number.isNotNull()
        if field.get("min") is not None:
            test = test & (number >= float(field["min"]))
        if field.get("max") is not None:
            test = test & (number <= float(field["max"]))
        shown = F.when(number == F.floor(number), F.floor(number).cast("string")) \
            .otherwise(number.cast("string"))
        return F.when(test, shown)
    if kind == "postcode":
        code = contacts.postcode(answer)
        pattern = field.get("pattern")
        fits = F.trim(answer).rlike(pattern) if pattern else F.lit(True)
        return F.when(fits, code)
    return contacts.clean(answer, field.get("max_length"))


# --------------------------------------------------------------- validation --
def validate(submissions: DataFrame, site: Site) -> DataFrame:
    """Label each submission accepted or refused with the first failing reason.

    ``submissions``: conversion_type, email, language, phone, postcode, first_name,
    last_name, qualification (map), consent_processing, spam_reason (NULL when the
    spam verdict accepted it).
    """
    cleaned = submissions.withColumns({
        "raw_email": F.col("email"),
        "email": contacts.email(F.col("email")),
        "phone": contacts.phone(F.col("phone")),
        "qualification": qualification(F.col("qualification"), site),
        "first_name": contacts.clean(F.col("first_name")),
        "last_name": contacts.clean(F.col("last_name")),
    })
    missing = []
    for field in site.fields:
        key = field.get("key")
        if not field.get("required") or not key or key == "email" \
                or field.get("type") == "consent":
            continue
        absent = F.try_element_at("qualification", F.lit(key)).isNull()
        if key in submissions.columns:
            absent = absent & (F.coalesce(F.col(key), F.lit("")) == "")
        missing.append(F.when(absent, F.lit(key)))
    lacking = F.array_compact(F.array(*missing)) if missing else text.string_array([])
    language = contacts.clean(F.col("language"))
    reason = (
        F.when(F.col("spam_reason").isNotNull(),
               F.concat(F.lit("submission rejected: "), "spam_reason"))
        .when(~F.coalesce(F.col("conversion_type"), F.lit("")).isin(*fv.CONVERSION_TYPES),
              F.concat(F.lit("unknown conversion type '"), "conversion_type", F.lit("'")))
        .when(F.lit(site.consent_required)
              & ~F.coalesce("consent_processing", F.lit(False)),
              "consent to process the request is required")
        .when(F.col("email").isNull(), F.concat(
            F.lit("not a usable email address: '"),
            F.coalesce("raw_email", F.lit("")), F.lit("'")))
        .when(F.size("_lacking") > 0, F.concat(
            F.lit("missing required answer(s): "), F.concat_ws(", ", "_lacking")))
    )
    return (
        cleaned.withColumn("_lacking", lacking).withColumn("rejection_reason", reason)
        .withColumns({
            "accepted": F.col("rejection_reason").isNull(),
            "language": F.when(language.isin(*site.languages), language).otherwise(
                F.lit(site.default_language)),
            "postcode": contacts.postcode(F.coalesce(
                F.when(F.col("postcode") != "", F.col("postcode")),
                F.try_element_at("qualification", F.lit("postcode")))),
            "state": F.when(F.col("rejection_reason").isNull(), "PENDING_EXPORT"),
            "consent_version": F.lit(site.consent_version),
        }).drop("_lacking", "raw_email")
    )


# --------------------------------------------------------------------- spam --
def spam_rules(submissions: DataFrame) -> DataFrame:
    """The two checks that need no history: honeypot and fill time."""
    fast = F.col("elapsed_ms") < fv.MIN_ELAPSED_MS
    return submissions.withColumn(
        "spam_reason",
        F.when(F.coalesce("honeypot", F.lit("")) != "", "honeypot field was filled")
        .when(fast, F.format_string(
            f"submitted in %dms, under the {fv.MIN_ELAPSED_MS}ms floor",
            F.col("elapsed_ms"))))


RATE_REASON = (f"more than {fv.RATE_MAX_SUBMISSIONS} submissions in "
               f"{fv.RATE_WINDOW_SECONDS // 60} minutes")


def accept_in_window(accepted: deque, now: float,
                     window: float = fv.RATE_WINDOW_SECONDS) -> bool:
    """One step of the rate rule: refused submissions leave no trace."""
    while accepted and now - accepted[0] > window:
        accepted.popleft()
    if len(accepted) >= fv.RATE_MAX_SUBMISSIONS:
        return False
    accepted.append(now)
    return True


def _traffic_runs(counted: DataFrame) -> DataFrame:
    """``_run`` of each (client, window-long slice of time): slices that follow each other.

    Between two runs lies a whole empty slice, so nothing accepted before it still counts.
    One row per client and slice is ranked, not one per submission.
    """
    slices = counted.select("client_key", "_slice").distinct()
    rank = F.row_number().over(Window.partitionBy("client_key").orderBy("_slice"))
    return slices.withColumn("_run", F.col("_slice") - rank)


def spam_verdicts(submissions: DataFrame) -> DataFrame:
    """All three spam checks over a stored batch.

    ``submissions``: submission_id, client_key, submitted_at, honeypot, elapsed_ms.
    The rate rule forgets everything over a gap longer than its window, so each client's
    runs of traffic are apart from each other and spread over the tasks.  A run is
    streamed in order with at most five timestamps of state; what is refused until the
    oldest of them expires is found by one search per batch.
    """
    checked = spam_rules(submissions)
    limited_rows = F.col("spam_reason").isNull() & F.col("client_key").isNotNull()
    micros = F.unix_micros(F.col("submitted_at").cast("timestamp"))
    window = fv.RATE_WINDOW_SECONDS * 1_000_000
    counted = checked.where(limited_rows).withColumns({
        "_micros": micros, "_slice": F.floor(micros / window)})
    schema = checked.schema

    def limit(batches):
        last, accepted = None, deque()
        for batch in batches:
            place, runs = 0, batch.groupby(["client_key", "_run"], sort=False, dropna=False)
            reasons = np.full(len(batch), RATE_REASON, dtype=object)
            for key, rows in runs:
                if key != last:
                    last, accepted = key, deque()
                times = rows["_micros"].to_numpy()
                i = 0
                while i < len(times):
                    if accept_in_window(accepted, times[i], window):
                        reasons[place + i] = None
                        i += 1
                    else:
                        i = int(np.searchsorted(times, accepted[0] + window, "right"))
                place += len(rows)
            yield batch.assign(spam_reason=reasons)[[f.name for f in schema]]

    limited = (
        counted.join(_traffic_runs(counted), ["client_key", "_slice"])
        .repartition("client_key", "_run")
        .sortWithinPartitions("client_key", "_run", "_micros", "submission_id")
        .mapInPandas(limit, schema)
    )
    return limited.unionByName(checked.where(~limited_rows))


# ------------------------------------------------------------------- export --
def export_queue(leads: DataFrame, limit: int | None = None) -> DataFrame:
    """Leads that still wait for export, oldest first; the caller may take some only."""
    waiting = leads.where("state in ('NEW', 'PENDING_EXPORT')").orderBy(
        "created_at", "lead_id")
    return waiting if limit is None else waiting.limit(limit)


def export_payload(leads: DataFrame, attribution: DataFrame, project: list[str],
                   source_system: str) -> DataFrame:
    """Mint the correlation id once and freeze the payload before any attempt.

    A lead that already has both keeps them unchanged.
    """
    joined = leads.join(attribution.withColumnRenamed("language", "_l")
                        if "language" in attribution.columns else attribution,
                        "lead_id", "left")
    own = F.coalesce("external_correlation_id", F.concat(
        F.lit(f"{PREFIX}-"), F.sha2(F.concat_ws("|", F.lit(source_system), "lead_id"),
                                    256)))
    answers = F.map_filter(F.coalesce(
        "qualification", F.create_map().cast("map<string,string>")),
        lambda k, v: k.isin(*project) & v.isNotNull())
    payload = F.to_json(F.struct(
        own.alias("external_correlation_id"), F.lit(source_system).alias("source_system"),
        F.struct("first_name", "last_name", "email", "phone").alias("contact"),
        answers.alias("project"),
        F.struct(F.lit(True).alias("processing"), F.col("consent_version")
                 .alias("version"), F.date_format(
                     "consent_timestamp", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"))
        .alias("consent"),
        F.struct("source", "channel", "landing_path", "search_intent", "utm_source",
                 "utm_medium", "utm_campaign", F.col("conversion_type").alias("cta"))
        .alias("attribution")))
    return joined.select(
        "lead_id", own.alias("external_correlation_id"),
        F.coalesce("export_payload", payload).alias("export_payload"))


def outcome_class(status: Column) -> Column:
    """What an attempt's HTTP status means; NULL status is a lost response."""
    return (
        F.when(status == 201, "CREATED").when(status == 200, "REPLAY")
        .when(status == 409, "CONFLICT").when(status.isin(401, 403), "UNAUTHORIZED")
        .when(status.isNull() | (status == 429) | status.between(500, 599), "RETRYABLE")
        .otherwise("REJECTED"))


def fold_exports(leads: DataFrame, attempts: DataFrame, consent_required: bool = True,
                 limit: int = fv.MAX_EXPORT_ATTEMPTS) -> DataFrame:
    """Next state of each lead after a batch of recorded attempts.

    ``leads``: lead_id, state, and where stored export_attempts, export_error and
    remote_prospect_id.  ``attempts``: lead_id, attempt_ts, attempt_id, http_status,
    prospect_id.  Only leads that wait for export move; attempts add to the stored
    count.  The first outcome that is not retryable decides, or the retry that reaches
    the limit.  What was recorded after that, or for a lead already exported or failed, is
    not applied and counted in ``ignored_attempts``.
    """
    def stored(name: str, kind: str) -> Column:
        return F.col(name).cast(kind) if name in leads.columns else F.lit(None).cast(kind)

    before = F.coalesce(stored("export_attempts", "long"), F.lit(0))
    kept = [c for c in leads.columns if c not in (
        "state", "export_attempts", "export_error", "remote_prospect_id")]
    waiting = F.col("state").isin("NEW", "PENDING_EXPORT")
    if not consent_required:
        return leads.select(
            *kept, "state", F.lit("REFUSED").alias("outcome"), before.alias("export_attempts"),
            stored("remote_prospect_id", "string").alias("remote_prospect_id"),
            F.lit("the captured lead does not prove processing consent").alias("export_error"),
            F.lit(0).cast("long").alias("ignored_attempts"))
    place = F.row_number().over(
        Window.partitionBy("lead_id").orderBy("attempt_ts", "attempt_id"))
    room = leads.select("lead_id", F.when(waiting, F.greatest(
        F.lit(1), F.lit(limit) - before)).otherwise(0).alias("_room"))
    tried = attempts.withColumn("_n", place).join(room, "lead_id").withColumn(
        "_class", outcome_class(F.col("http_status")))
    inside = F.col("_n") <= F.col("_room")
    final = inside & (F.col("_class") != "RETRYABLE")
    told = tried.groupBy("lead_id").agg(
        F.min_by(F.struct("_class", "_n", "http_status", "prospect_id"),
                 F.when(final, F.col("_n"))).alias("d"),
        F.max(F.when(inside, F.col("_n"))).alias("tries"), F.count("*").alias("_recorded"),
        F.max_by("http_status", F.when(inside, F.col("_n"))).alias("last_status"))
    rows = leads.join(told, "lead_id", "left")
    decided, applied = F.col("d._class"), F.coalesce("d._n", "tries", F.lit(0))
    total = before + applied
    exhausted = decided.isNull() & (F.col("tries") > 0) & (total >= limit)
    detail = F.coalesce(F.col("last_status").cast("string"), F.lit("no response"))
    moved = applied > 0
    return rows.select(
        *kept,
        F.when(decided.isin("CREATED", "REPLAY"), "EXPORTED")
        .when(decided.isNotNull() | exhausted, "EXPORT_FAILED")
        .when(moved, "PENDING_EXPORT").otherwise(F.col("state")).alias("state"),
        F.coalesce(decided, F.when(moved, "RETRYABLE")).alias("outcome"),
        total.alias("export_attempts"),
        F.coalesce("d.prospect_id", stored("remote_prospect_id", "string"))
        .alias("remote_prospect_id"),
        F.when(decided == "CONFLICT", "CONFLICT: same correlation, divergent fingerprint")
        .when(decided == "UNAUTHORIZED", F.concat(
            F.lit("UNAUTHORIZED: producer credential rejected ("),
            F.col("d.http_status").cast("string"), F.lit(")")))
        .when(decided == "REJECTED", F.concat(
            F.lit("REJECTED: "), F.col("d.http_status").cast("string")))
        .when(exhausted, F.concat(
            F.lit("RETRY_EXHAUSTED after "), total.cast("string"),
            F.lit(" attempt(s): "), detail))
        .when(decided.isNull() & moved, F.concat(F.lit("RETRYABLE: "), detail))
        .when(~moved, stored("export_error", "string")).alias("export_error"),
        (F.coalesce("_recorded", F.lit(0)) - applied).alias("ignored_attempts"))


# ----------------------------------------------------------------- listings --
def listing(leads: DataFrame, attribution: DataFrame,
            limit: int | None = None) -> DataFrame:
    """Leads with masked contact details; with a limit the newest ones."""
    newest = leads if limit is None else leads.orderBy(
        F.desc("created_at"), "lead_id").limit(limit)
    return newest.select(
        "lead_id", "state", "created_at",
        contacts.mask_email(F.col("email")).alias("email"),
        F.coalesce(F.col("phone") != "", F.lit(False)).alias("has_phone")
    ).join(attribution, "lead_id", "left")


def attribution_counts(leads: DataFrame, attribution: DataFrame,
                       by: list[str]) -> DataFrame:
    """Leads per attribution dimension; leads without attribution group under NULL."""
    return leads.join(attribution, "lead_id", "left").groupBy(*by).agg(
        F.count("*").alias("leads"),
        F.count_if(F.col("state") == "EXPORTED").alias("exported"))
