"""Text expressions: normalising, tokenising and term matching.

Everything is a column expression, so Catalyst keeps it inside whole-stage
codegen.  The ``local_*`` twins exist only to prepare vocabulary on the driver
(a few hundred configured terms), never to touch rows.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterable, Sequence
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from probatio import fixed_values as fv
from probatio.session import shuffled

# Scripts whose accented or compatibility letters fold to one plain letter.
_FOLDED_RANGES = (
    (0x0080, 0x024F), (0x0300, 0x0527), (0x1E00, 0x1FFF), (0x2000, 0x218F),
    (0x2460, 0x24FF), (0x3000, 0x3000), (0xFF01, 0xFF5E),
)
# Letters that fold to several characters (fixed values).
_EXPANSIONS = (
    ("ß", "ss"), ("…", "..."), ("½", "1⁄2"), ("¼", "1⁄4"), ("¾", "3⁄4"),
    ("ﬁ", "fi"), ("ﬂ", "fl"), ("ĳ", "ij"), ("™", "TM"), ("№", "No"),
)
# What Python's str.split() and \\s treat as white space, spelled out: an explicit
# class is much cheaper for the JVM than switching a pattern to Unicode mode.
SPACE = (r"\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000")
SPACES = f"[{SPACE}]+"
WORD = f"[^{SPACE}]+"
# White space that is not one plain space already: what is left to squeeze.  Most texts hold
# none, and every match that is replaced costs more than testing a whole word.
_UNEVEN = r"\s{2,}|[\t\n\x0b\f\r]"
# The white space beyond ASCII, as characters (fixed values).
_WIDE_SPACES = ("\x1c\x1d\x1e\x1f\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200b)))
                + "\u2028\u2029\u202f\u205f\u3000")


def local_normalise(text: str) -> str:
    folded = unicodedata.normalize("NFKD", (text or "").casefold())
    kept = (c for c in folded if not unicodedata.combining(c))
    return " ".join("".join(kept).split())


@lru_cache(maxsize=1)
def _fold_table() -> tuple[str, str]:
    """Single-letter folds derived from the Unicode data, as translate() arguments."""
    mapped, deleted = [], []
    for low, high in _FOLDED_RANGES:
        for code in range(low, high + 1):
            char = chr(code)
            if char != char.lower():
                continue
            if char in _WIDE_SPACES:
                mapped.append((char, " "))
                continue
            folded = "".join(
                c for c in unicodedata.normalize("NFKD", char.casefold())
                if not unicodedata.combining(c)
            )
            if folded == char or len(folded) > 1:
                continue
            if folded:
                mapped.append((char, folded))
            else:
                deleted.append(char)
    return ("".join(c for c, _ in mapped) + "".join(deleted),
            "".join(t for _, t in mapped))


def fold(text: Column) -> Column:
    """Lower-case and strip accents; whitespace is left alone."""
    source, target = _fold_table()
    folded = F.translate(F.lower(text), source, target)
    for char, replacement in _EXPANSIONS:
        folded = F.replace(folded, F.lit(char), F.lit(replacement))
    return folded


def squeeze(text: Column) -> Column:
    """Collapse white space; the wide spaces are mapped first where there may be any.

    The test range is wider than needed: two ranges are far cheaper to test on every
    letter than the exact list.
    """
    plain = F.when(text.rlike(r"[\x1c-\x1f\x85\xa0\u1680-\u3000]"), F.translate(
        text, _WIDE_SPACES, " " * len(_WIDE_SPACES))).otherwise(text)
    return F.trim(F.regexp_replace(plain, _UNEVEN, " "))


def normalise(text: Column) -> Column:
    # Folding already turns every wide space into a plain one.
    return F.trim(F.regexp_replace(fold(text), _UNEVEN, " "))


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add costly columns so that each is computed once per row.

    A plain ``withColumn`` is not enough: a later filter on a derived column is
    pushed down through the projection with the whole expression copied into it,
    once per use.  A generator over a one-row array is a boundary no expression is
    copied through, and it stays inside whole-stage codegen.
    """
    row = F.struct(*[value.alias(name) for name, value in columns.items()])
    return df.select("*", F.inline(F.array(row)))


def per_distinct(rows: DataFrame, columns: Sequence[str],
                 read: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``read`` applied to each distinct combination of ``columns``, joined back to all rows.

    ``read`` keeps the columns and adds others; it may return several rows or none for one
    combination.  NULLs are equal.  Pays where texts recur: equal ones are read once.  The
    texts are compared whole, but a hash goes first, so the join does not sort by long
    common beginnings.
    """
    mine = {c: f"_distinct_{c}" for c in columns}
    found = read(rows.select(*columns).distinct()).withColumnsRenamed(mine)
    found = found.withColumn("_distinct", F.xxhash64(*mine.values()))
    same = [F.col("_hash") == F.col("_distinct"),
            *[F.col(c).eqNullSafe(F.col(other)) for c, other in mine.items()]]
    return rows.withColumn("_hash", F.xxhash64(*columns)).join(shuffled(found), same).drop(
        "_hash", "_distinct", *mine.values())


def string_array(values: Iterable[str]) -> Column:
    items = [F.lit(v) for v in values]
    return F.array(*items) if items else F.array().cast("array<string>")


# ------------------------------------------------------------------ tokens --
def local_stem(token: str) -> str:
    if len(token) <= 4:
        return token
    if token.endswith("eaux"):
        return token[:-1]
    if token.endswith("aux"):
        return token[:-3] + "al"
    return token[:-1] if token[-1] in "sx" else token


def local_tokens(text: str, stopwords: Sequence[str]) -> list[str]:
    words = re.findall(r"[a-z0-9]+", local_normalise(text))
    return [local_stem(w) for w in words if len(w) > 2 and w not in stopwords]


def stem(token: Column) -> Column:
    length = F.length(token)
    return (
        F.when(length <= 4, token)
        .when(token.endswith("eaux"), F.substring(token, F.lit(1), length - 1))
        .when(token.endswith("aux"),
              F.concat(F.substring(token, F.lit(1), length - 3), F.lit("al")))
        .when(token.endswith("s") | token.endswith("x"),
              F.substring(token, F.lit(1), length - 1))
        .otherwise(token)
    )


def token_set(normalised: Column, stopwords: Sequence[str]) -> Column:
    """Distinct stems of an already normalised text."""
    words = F.regexp_extract_all(normalised, F.lit("[a-z0-9]{3,}"), F.lit(0))
    kept = F.filter(F.array_distinct(words), lambda w: ~w.isin(*stopwords))
    return F.array_distinct(F.transform(kept, stem))


def gate_tokens(text: Column) -> Column:
    return token_set(normalise(F.coalesce(text, F.lit(""))), fv.GATE_STOPWORDS)


def match_tokens(text: Column) -> Column:
    return token_set(normalise(F.coalesce(text, F.lit(""))), fv.MATCH_STOPWORDS)


def words(text: Column) -> Column:
    """Whitespace-separated words, as ``str.split()`` gives them."""
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def word_count(squeezed: Column) -> Column:
    """Words of a text whose white space is already squeezed."""
    spaces = F.length(squeezed) - F.length(F.replace(squeezed, F.lit(" "), F.lit("")))
    return F.when(squeezed == "", 0).otherwise(spaces + 1)


def long_words(text: Column) -> Column:
    """Distinct normalised words longer than four characters."""
    parts = F.split(normalise(F.coalesce(text, F.lit(""))), " ")
    return F.array_distinct(F.filter(parts, lambda w: F.length(w) > 4))


def digits(text: Column) -> Column:
    return F.regexp_replace(text, r"\D", "")


def number_set(text: Column, pattern: str, keep_years: bool = False) -> Column:
    """Digits-only forms of every number in a text; plausible years are dropped."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(1))
    values = F.filter(F.transform(found, digits), lambda n: n != "")
    if not keep_years:
        values = F.filter(values, lambda n: ~is_year(n))
    return F.array_distinct(values)


def is_year(number: Column) -> Column:
    return (F.length(number) == 4) & number.between("1900", "2100")


# ----------------------------------------------------------- term matching --
def _normal_terms(terms: Iterable[str]) -> list[str]:
    """Distinct normalised terms, longest first."""
    found = dict.fromkeys(local_normalise(term) for term in terms)
    return sorted((t for t in found if t), key=len, reverse=True)


def _alternation(terms: Iterable[str]) -> str | None:
    normal = _normal_terms(terms)
    return "|".join(re.escape(t).replace(r"\ ", " ") for t in normal) or None


def whole_word_pattern(terms: Iterable[str]) -> str | None:
    body = _alternation(terms)
    return rf"(?U)(?<!\w)(?:{body})(?!\w)" if body else None


def contains_any(normalised: Column, terms: Iterable[str]) -> Column:
    """Any configured term present as a plain substring.

    A row of byte searches: much cheaper than one alternation tried at every letter.  A term
    that holds another one needs no search of its own.
    """
    test, normal = F.lit(False), _normal_terms(terms)
    for term in normal:
        if not any(other != term and other in term for other in normal):
            test = test | normalised.contains(term)
    return test


def has_term(normalised: Column, terms: Iterable[str]) -> Column:
    """Any configured term present as a whole word; the pattern runs only on texts
    that contain a term at all."""
    pattern = whole_word_pattern(terms)
    if not pattern:
        return F.lit(False)
    return contains_any(normalised, terms) & normalised.rlike(pattern)


def first_contained(normalised: Column, terms: Sequence[str]) -> Column:
    """First term, in list order, that the text contains; NULL when none."""
    tests = [F.when(normalised.contains(local_normalise(t)), F.lit(t)) for t in terms]
    return F.coalesce(*tests) if tests else F.lit(None).cast("string")


# -------------------------------------------------------------------- urls --
def host(url: Column) -> Column:
    """Lower-case host, NULL when the URL has none or does not parse."""
    found = F.lower(F.try_parse_url(url, F.lit("HOST")))
    return F.when(found != "", found)


def bare_host(url: Column) -> Column:
    return F.regexp_replace(host(url), r"^www\.", "")


# ------------------------------------------------------------------- slugs --
def slug(text: Column) -> Column:
    """Readable slug of the whole text, so different titles keep different slugs."""
    full = F.regexp_replace(
        F.regexp_replace(normalise(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(full == "", F.lit("untitled")).otherwise(full)


def page_slug(text: Column) -> Column:
    """Slug of a published address, ``page`` when nothing is left."""
    plain = F.regexp_replace(fold(F.coalesce(text, F.lit(""))), r"[^\x00-\x7f]", "")
    full = F.regexp_replace(F.regexp_replace(plain, "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(full == "", F.lit("page")).otherwise(full)


# --------------------------------------------------------------- sentences --
def split_sentences(text: Column, closers: str = ".!?") -> Column:
    """Sentences end at a closer followed by space and a capital or a digit."""
    pattern = rf"(?<=[{closers}]){SPACES}(?=[A-ZÀ-ÿ0-9])"
    return F.split(text, pattern)


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(" \t\n\x0b\f\r" + _WIDE_SPACES))
