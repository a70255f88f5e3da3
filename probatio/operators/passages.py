"""Passages and atomic claims.

Block and sentence handling stays in arrays inside each row until a passage or a
claim exists; only then is it exploded.  The greedy grouping of sentences into
passages is a left fold over the sentence array.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from probatio import fixed_values as fv
from probatio.functions import text

_FIVE_ASCII_WORDS = rf"(?:\S+\s+){{{fv.FURNITURE_LINE_WORDS - 1}}}\S"
_FIVE_WORDS = (f"(?:{text.WORD}{text.SPACES}){{{fv.FURNITURE_LINE_WORDS - 1}}}"
               f"{text.WORD}")
_UNIT = "\u001e"  # separates grouped sentences while the fold runs


def _clean(flat: Column) -> Column:
    """List and heading marks, addresses and links out of a squeezed block."""
    tidy = F.regexp_replace(flat, r"^(#{1,6}\s*|[-*+]\s+|\d+[.)]\s+|>\s*)", "")
    # The address can only start where a run of non-spaces starts; most blocks hold none.
    tidy = F.when(tidy.contains("://") | tidy.contains("@"), F.regexp_replace(
        tidy, r"https?://\S+|(?<!\S)\S+@\S+\.\S+", "")).otherwise(tidy)
    return F.trim(F.regexp_replace(tidy, " {2,}", " "))


def _without_furniture_lines(block: Column) -> Column:
    """Drop short lines that carry a furniture phrase."""
    lines = F.filter(F.split(block, r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"),
                     lambda ln: ln.rlike(text.WORD))
    # Most lines pass the cheap first test; wide spaces can only add words.
    kept = F.filter(lines, lambda ln: ln.rlike(_FIVE_ASCII_WORDS) | ~(
        ~ln.rlike(_FIVE_WORDS)
        & text.contains_any(text.fold(ln), fv.FURNITURE_PHRASES)))
    return F.array_join(kept, "\n")


def _drop_reason(block: Column) -> Column:
    """Why a block is furniture; ``block``: stripped, n_words, folded when short."""
    stripped, n_words = block["stripped"], block["n_words"]
    phrase = text.first_contained(block["folded"], fv.FURNITURE_PHRASES)
    letters = F.length(F.regexp_replace(stripped, r"[^\p{L}]+", ""))
    breaks = F.length(stripped) - F.length(F.replace(stripped, F.lit("\n"), F.lit("")))
    return (
        F.when(F.length(stripped) < fv.MIN_BLOCK_CHARS, "too_short")
        .when(n_words < fv.MIN_BLOCK_WORDS, "too_few_words")
        .when((n_words < fv.FURNITURE_BLOCK_WORDS) & phrase.isNotNull(),
              F.concat(F.lit("boilerplate:"), phrase))
        .when(letters < fv.MIN_LETTER_SHARE * F.length(stripped), "low_alpha_ratio")
        .when(~stripped.contains(".") & (breaks >= 2), "unpunctuated_list")
    )


def _group(cleaned: Column) -> Column:
    """Sentences folded into groups of at most the quotable length."""
    sentences = text.split_sentences(cleaned, ".!?;:")
    state = F.struct(F.lit("").alias("done"), F.lit("").alias("current"))

    def step(acc: Column, sentence: Column) -> Column:
        full = ((F.length(acc["current"]) + F.length(sentence) + 1
                 > fv.MAX_PASSAGE_CHARS) & (acc["current"] != ""))
        return F.struct(
            F.when(full, F.concat(acc["done"], acc["current"], F.lit(_UNIT)))
            .otherwise(acc["done"]).alias("done"),
            F.when(full, sentence).otherwise(
                F.trim(F.concat_ws(" ", acc["current"], sentence))).alias("current"))

    grouped = F.aggregate(
        sentences, state, step,
        lambda acc: F.split(F.concat(acc["done"], acc["current"]), _UNIT))
    return F.when(F.length(cleaned) <= fv.MAX_PASSAGE_CHARS, F.array(cleaned)) \
        .otherwise(grouped)


def _cut(body: Column) -> Column:
    """Array of (block_ord, group_ord, passage, drop_reason) of one source text.

    Each stage is its own ``transform`` so that an intermediate is computed once
    per block.  Everything stays inside the row: positions need no window and the
    text is never shuffled.
    """
    pieces = F.split(body, r"\n\s*\n|\r\n\s*\r\n")
    lines = F.transform(pieces, _without_furniture_lines)
    flat = F.transform(lines, lambda b: F.struct(
        text.strip(b).alias("stripped"), text.squeeze(b).alias("flat")))
    counted = F.transform(flat, lambda b: F.struct(
        b["stripped"].alias("stripped"), b["flat"].alias("flat"),
        text.word_count(b["flat"]).alias("n_words")))
    seen = F.transform(counted, lambda b: F.struct(
        b["stripped"].alias("stripped"), b["flat"].alias("flat"),
        b["n_words"].alias("n_words"),
        F.when(b["n_words"] < fv.FURNITURE_BLOCK_WORDS, text.fold(b["stripped"]))
        .alias("folded")))
    judged = F.transform(seen, lambda b: F.struct(
        _drop_reason(b).alias("reason"), _clean(b["flat"]).alias("cleaned")))
    grouped = F.transform(judged, lambda b: F.struct(
        b["reason"].alias("reason"),
        F.when(b["reason"].isNotNull(),
               F.array(b["cleaned"]))
        .otherwise(_group(b["cleaned"])).alias("texts")))
    rows = F.transform(grouped, lambda b, i: F.transform(
        b["texts"], lambda t, j: F.struct(
            i.alias("block_ord"), j.alias("group_ord"), t.alias("passage"),
            b["reason"].alias("drop_reason"))))
    return F.filter(F.flatten(rows),
                    lambda p: p["drop_reason"].isNotNull() | (p["passage"] != ""))


def _others(sources: DataFrame) -> list[str]:
    return [c for c in sources.columns if c != "body"]


def passages(sources: DataFrame) -> DataFrame:
    """Kept and dropped passages of each source, in order, with the drop reason.

    ``sources``: package_id, source_ref, body and any other column.  Apply the
    relevance filter before this job.
    """
    # The array goes straight into the generator: as a named column it would be
    # computed again for the not-empty filter Catalyst infers from a generator.
    return sources.where(F.col("body").rlike(r"\S")).select(
        *_others(sources), F.inline(_cut(F.col("body"))),
    ).withColumn("kept", F.col("drop_reason").isNull())


def kept_passages(sources: DataFrame) -> DataFrame:
    """Kept passages only, numbered from 0 within their source."""
    kept = F.transform(
        F.filter(_cut(F.col("body")), lambda p: p["drop_reason"].isNull()),
        lambda p, i: F.struct(i.alias("passage_ord"), p["passage"].alias("passage")))
    return sources.where(F.col("body").rlike(r"\S")).select(
        *_others(sources), F.inline(kept))


def drop_summary(all_passages: DataFrame) -> DataFrame:
    """Kept and dropped passages by reason."""
    reason = F.coalesce("drop_reason", F.lit("kept"))
    return all_passages.groupBy("package_id", reason.alias("reason")).agg(
        F.count("*").alias("passages"))


# ------------------------------------------------------------------- claims --
def _propositions(sentence: Column) -> Column:
    """Split a sentence that carries several quantities or is very long."""
    several = (F.regexp_count(sentence, F.lit(fv.QUANTITY_PATTERN)) > 1) \
        | (F.length(sentence) > fv.MAX_CLAIM_CHARS)
    parts = F.filter(
        F.transform(F.split(sentence, fv.CLAUSE_SEPARATOR_PATTERN), lambda p: F.trim(p)),
        lambda p: p != "")

    def rejoin(acc: Column, part: Column) -> Column:
        short = (F.size(acc) > 0) & (text.word_count(text.squeeze(part)) < 4)
        last = F.concat_ws(" ", F.element_at(acc, -1), part)
        return F.when(
            short,
            F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(last))
        ).otherwise(F.concat(acc, F.array(part)))

    merged = F.aggregate(parts, text.string_array([]), rejoin)
    return F.when(several & (F.size(parts) > 1), merged).otherwise(F.array(sentence))


# Claims are cut from squeezed passages, so one space separates their words.  The
# tests below are ordered from cheap to costly and stop at the first that decides.
_FIVE_LONG_WORDS = "(?:[^ ]{3,} (?:[^ ]{1,2} )*){4}[^ ]{3}"
_CAPITAL_WORD = r"(?<![^ ])\p{Lu}[^ ]{2,}"


def is_title_fragment(body: Column) -> Column:
    """A heading or a name rather than a statement: no verb, mostly capitals."""
    capitals = F.regexp_count(body, F.lit(_CAPITAL_WORD))
    long_words = F.size(F.filter(F.split(body, " "), lambda w: F.length(w) > 2))
    mostly = (capitals >= 2) & (capitals >= long_words * fv.TITLE_CAPITAL_SHARE)
    open_ended = ~F.rtrim(body).rlike(r"[.!]$")
    label = (open_ended | ~body.rlike("[^ ]{3}") | mostly
             | body.rlike(fv.TITLE_SEPARATOR_PATTERN))
    return label & ~body.rlike(fv.VERB_PATTERN)


def is_assertion(body: Column) -> Column:
    return (
        (F.length(body) >= fv.MIN_CLAIM_CHARS)
        & ~body.rlike(r"\?\s*$")
        & body.rlike(_FIVE_LONG_WORDS)
        & ~body.rlike(fv.NON_ASSERTION_PATTERN)
        & ~body.rlike(fv.PROMOTIONAL_PATTERN)
        & ~is_title_fragment(body)
    )


def is_quantified(body: Column) -> Column:
    return body.rlike(fv.QUANTITY_PATTERN) | body.rlike(fv.BARE_NUMBER_PATTERN)


def claims(kept: DataFrame) -> DataFrame:
    """Atomic claims of kept passages, in order."""
    # A bare F.trim would be handed each position as the characters to cut off.
    sentences = F.filter(F.transform(
        text.split_sentences(F.col("passage")), lambda s: F.trim(s)), lambda s: s != "")
    candidates = F.transform(
        F.flatten(F.transform(sentences, _propositions)),
        lambda p: F.trim(F.regexp_replace(p, r"^[ ,;:]+|[ ,;:]+$", "")))
    kept_claims = F.filter(candidates, is_assertion)
    return kept.select("*", F.posexplode(kept_claims).alias("claim_ord", "claim")).withColumn(
        "quantified", is_quantified(F.col("claim")))


def claim_key(claim: Column) -> Column:
    """The whole claim, whitespace and case ignored."""
    return text.squeeze(F.lower(claim))


def dedupe_claims(all_claims: DataFrame, order: list[str]) -> DataFrame:
    """First occurrence of each claim in a package, plus how many it stands for.

    ``min_by`` keeps partial aggregation on the map side, so a sentence copied
    into a third of all sources shrinks before the shuffle; a window would move
    and sort every copy.
    """
    rest = [c for c in all_claims.columns if c != "package_id"]
    return (
        all_claims.withColumn("claim_key", claim_key(F.col("claim")))
        .groupBy("package_id", "claim_key")
        .agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_first"),
             F.count("*").alias("occurrences"))
        .select("package_id", "claim_key", "_first.*", "occurrences")
    )


def claim_set_summary(deduped: DataFrame) -> DataFrame:
    return deduped.groupBy("package_id").agg(
        F.count("*").alias("claims"),
        F.sum(F.col("occurrences") - 1).alias("skipped_fragments"),
        F.count_if("quantified").alias("quantified"))
