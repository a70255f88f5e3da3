"""Contact fields: cleaning, normalising, masking and secret redaction."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from probatio import fixed_values as fv


def clean(value: Column, limit: int | None = None) -> Column:
    """Control characters out, trimmed; NULL when nothing is left.  ``limit`` is the
    length that a site's own field definition allows."""
    tidy = F.regexp_replace(value, r"[\x00-\x1f\x7f]", "")
    tidy = F.regexp_replace(tidy, r"(?U)^\s+|\s+$", "")
    cut = tidy if limit is None else F.left(tidy, F.lit(int(limit)))
    return F.when(cut != "", cut)


def email(value: Column) -> Column:
    """Lower-case address, NULL when the shape is not usable."""
    tidy = F.lower(clean(value))
    return F.when(tidy.rlike(fv.EMAIL_PATTERN), tidy)


def phone(value: Column) -> Column:
    raw = F.regexp_replace(value, r"[^\d+]", "")
    raw = F.regexp_replace(raw, "^00", "+")
    number = F.regexp_replace(raw, r"^\++", "")
    usable = number.rlike(r"^\d{6,15}$")
    return F.when(usable & raw.startswith("+"), F.concat(F.lit("+"), number)) \
        .when(usable, number)


def postcode(value: Column) -> Column:
    tidy = F.upper(F.regexp_replace(value, r"(?U)[^\w]", ""))
    return F.when(tidy != "", tidy)


def mask_email(value: Column) -> Column:
    address = F.coalesce(value, F.lit(""))
    at = F.instr(address, "@")
    local = F.when(at > 0, F.substring(address, F.lit(1), at - 1)).otherwise(address)
    domain = F.when(at > 0, F.substring(address, at + 1, F.length(address)))
    head = F.when(F.length(local) > 2, F.left(local, F.lit(2))).otherwise(
        F.left(local, F.lit(1)))
    return F.when(F.coalesce(domain, F.lit("")) != "",
                  F.concat(head, F.lit("***@"), domain)).otherwise(F.lit("***"))


def redact(text: Column) -> Column:
    """Secrets out of log text: assignments first, then known key prefixes."""
    safe = F.regexp_replace(text, fv.SECRET_ASSIGNMENT_PATTERN, f"$1$2{fv.REDACTED}")
    for pattern in fv.SECRET_PREFIX_PATTERNS:
        safe = F.regexp_replace(safe, pattern, fv.REDACTED)
    return safe
