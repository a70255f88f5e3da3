"""Deterministic keys and tolerant timestamps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from probatio.functions import text


def key(*parts: Column) -> Column:
    """Stable identifier: re-running a job writes the same key."""
    return F.sha2(F.concat_ws("|", *parts), 256)


def search_cache_key(query: Column, location: Column, language: Column,
                     device: Column) -> Column:
    return key(text.normalise(query), location.cast("string"), F.lower(language), device)


def run_key(query: Column, market: Column, language: Column, day: Column) -> Column:
    return key(query, market, language, day)


def client_key(salt: Column, address: Column) -> Column:
    """Coarse, salted client identifier; the address itself is never stored."""
    return F.sha2(F.concat(salt, F.lit(":"), address), 256)


def timestamp_or_null(value: Column) -> Column:
    """ISO instants, dates and ``YYYY-MM-DD HH:MM:SS +00:00``; anything else is NULL."""
    tidy = F.regexp_replace(F.trim(value), r"\s+([+-]\d{2}:\d{2})$", "$1")
    iso = tidy.rlike(r"^\d{4}-\d{2}-\d{2}([ T]\d{2}:\d{2}(:\d{2}(\.\d{1,9})?)?"
                     r"(Z|[+-]\d{2}:?\d{2})?)?$")
    return F.when(iso, tidy.try_cast("timestamp"))
