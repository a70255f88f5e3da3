"""Typed quantities in a text.

A quantity that overlaps one already read under a more specific type is skipped.
Spark SQL exposes no match positions, so this one rule runs as an Arrow UDF; texts
without a digit never enter the loop, and a pattern only those that hold a piece of it.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from probatio import fixed_values as fv

NUMERIC_TYPE = T.ArrayType(T.StructType([
    T.StructField("type", T.StringType()),
    T.StructField("digits", T.StringType()),
    T.StructField("raw", T.StringType()),
]))


def read_quantities(text: str, patterns) -> list[tuple[str, str, str]]:
    """(type, digits, raw) of every quantity.  ``patterns``: type, compiled pattern and the
    pieces of which a lower-cased text holds one wherever the pattern matches."""
    taken: list[tuple[int, int]] = []
    found = []
    lower = text.lower()
    for kind, pattern, pieces in patterns:
        if pieces and not any(piece in lower for piece in pieces):
            continue
        for hit in pattern.finditer(text):
            start, end = hit.span()
            if any(start < stop and begin < end for begin, stop in taken):
                continue
            raw = next((g for g in hit.groups() if g), hit.group())
            only_digits = re.sub(r"\D", "", raw)
            if only_digits:
                taken.append((start, end))
                found.append((kind, only_digits, raw.strip()))
    return found


def compiled_patterns() -> list[tuple]:
    return [(kind, re.compile(p, 0 if kind in ("PERCENT", "DATE", "YEAR", "COUNT")
                              else re.IGNORECASE), fv.NUMERIC_PIECES.get(kind, ()))
            for kind, p in fv.NUMERIC_PATTERNS]


@F.arrow_udf(NUMERIC_TYPE)
def _quantities(texts: pa.Array) -> pa.Array:
    patterns, ends, rows = compiled_patterns(), [0], []
    for body in texts.to_pylist():
        if body:
            rows.extend(read_quantities(body, patterns))
        ends.append(len(rows))
    columns = zip(*rows) if rows else ((), (), ())
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(
        [pa.array(c, pa.string()) for c in columns], ["type", "digits", "raw"]))


def quantities(text: Column) -> Column:
    return _quantities(F.when(text.rlike(r"\d"), text))


def type_digits(numerics: Column) -> Column:
    """``TYPE:digits`` strings, which compare type and value in one set operation."""
    return F.array_distinct(
        F.transform(numerics, lambda n: F.concat_ws(":", n["type"], n["digits"])))
