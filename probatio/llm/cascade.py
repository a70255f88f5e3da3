"""Quality rules as a short-circuit cascade.

Every rule's cost and selectivity are estimated on a sample: the seconds it takes and
the share of the sample it rejects.  Rules then stand in the order of rejection per cost
in one CASE expression, which stops at the first that rejects.  The order decides
what a run costs and which rule is named, never which documents are kept.

Rows: a NULL text has no words.  Repeated rows are judged alike.  Words are runs without
the white space characters U+0020 and U+0009 to U+000D.  An empty table gives an empty result
(all rules cost the same then, and stand in order of name).
"""

from __future__ import annotations

import time
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from probatio.llm.common import WORD, fresh, let, order_key, stage

COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
SAMPLE = 1000  # documents whose rules are timed
SYMBOLS = r"[#*$%&|<>]"
LETTER_WORD = r"[^\x20\x09-\x0D]*\p{L}[^\x20\x09-\x0D]*"
BULLET = r"^[\x20\x09-\x0D]*[-*•]"
ELLIPSIS = r"(\.\.\.|…)[\x20\x09-\x0D]*$"


@dataclass(frozen=True)
class Rule:
    """A rule rejects a document where ``rejects`` is true."""

    name: str
    rejects: Column


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda total, v: total + v)


def repeated_words(words: Column) -> Column:
    """Words inside 3-word windows that occur twice or more in the list.

    Windows are compared by 64-bit hashes within the one text; sorted by hash, equal
    windows are neighbours, so the cost is that of a sort and not of all pairs.
    """
    def positions(w: Column) -> Column:
        windows = F.transform(F.slice(w, 1, F.greatest(F.size(w) - 2, F.lit(0))),
                              lambda x, i: F.struct(F.xxhash64(
                                  x, F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("i")))
        return let(F.sort_array(windows), lambda s: F.sort_array(F.transform(F.filter(
            F.transform(s, lambda e, k: F.struct(
                e["i"].alias("i"),
                (e["h"].eqNullSafe(F.get(s, k - 1)["h"])
                 | e["h"].eqNullSafe(F.get(s, k + 1)["h"])).alias("twice"))),
            lambda e: e["twice"]), lambda e: e["i"])))

    def covered(p: Column) -> Column:
        return _sum(F.transform(p, lambda x, k: F.least(
            F.lit(3), F.coalesce(F.get(p, k + 1) - x, F.lit(3))).cast("long")))

    return let(words, lambda w: let(positions(w), covered))


def with_counts(docs: DataFrame) -> DataFrame:
    """``docs`` with the columns ``COUNTS``, which replace columns of the same name.

    The counts leave a generator, so that later expressions read them and do not repeat
    them.
    """
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
    per_line = let(lines, lambda x: F.struct(
        F.size(x).cast("long").alias("lines"),
        (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("twice")))
    per_word = let(F.regexp_extract_all(text, F.lit(f"({WORD})")), lambda w: F.struct(
        F.size(w).cast("long").alias("words"),
        _sum(F.transform(w, lambda x: F.length(x).cast("long"))).alias("chars"),
        repeated_words(w).alias("repeated")))
    counts = F.struct(per_word.alias("w"), per_line.alias("l"),
                      F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("symbols"))
    name, = fresh(docs, "counts")
    each = F.col(name)
    found = (each["w"]["words"], each["w"]["chars"], each["symbols"], each["l"]["lines"],
             each["l"]["twice"], each["w"]["repeated"])
    return docs.withColumn(name, F.explode(F.array(counts))).select(
        *(c for c in docs.columns if c not in COUNTS),
        *(c.alias(n) for c, n in zip(found, COUNTS, strict=True)))


def prose_rules() -> list[Rule]:
    """Rules over the text and the counts of ``with_counts``."""
    text = F.coalesce("text", F.lit(""))

    def line_count(pattern: str) -> Column:
        return F.size(F.filter(F.split(text, "\n"), lambda x: x.rlike(pattern)))

    return [
        Rule("bullet_lines", 10 * line_count(BULLET) > 9 * F.col("n_lines")),
        Rule("ellipsis_lines", 10 * line_count(ELLIPSIS) > 3 * F.col("n_lines")),
        Rule("letterless_words",
             10 * F.regexp_count(text, F.lit(LETTER_WORD)) < 8 * F.col("n_words")),
        Rule("repeated_lines", 2 * F.col("n_dup_lines") > F.col("n_lines")),
        Rule("symbols", 10 * F.col("n_symbols") > F.col("n_words")),
        Rule("word_length", (F.col("word_chars") < 3 * F.col("n_words"))
             | (F.col("word_chars") > 10 * F.col("n_words"))),
    ]


def _sampled(docs: DataFrame, size: int) -> DataFrame:
    ids = docs.select("doc_id", order_key().alias("k")).orderBy("k", "doc_id").limit(size)
    chosen = ids.select(F.col("doc_id").alias("chosen_id")).distinct()
    return docs.join(F.broadcast(chosen), F.col("doc_id").eqNullSafe(F.col("chosen_id"))
                     ).drop("chosen_id")


def ordered_rules(sample: DataFrame, rules: Sequence[Rule]) -> list[Rule]:
    """Rules by rejected share per second on the sample, then by name."""
    def timed(rejects: Column) -> tuple[float, float]:
        began = time.perf_counter()
        share = sample.agg(F.avg(rejects.cast("double")).alias("share")).first()["share"]
        return time.perf_counter() - began, share or 0.0

    timed(F.length("text") > 0)  # compiled code and open files
    idle = min(timed(F.length("text") > 0)[0] for _ in range(2))
    worth = {}
    for rule in rules:
        seconds, share = timed(rule.rejects)
        worth[rule.name] = share / max(seconds - idle, 0.001)
    return sorted(rules, key=lambda r: (-worth[r.name], r.name))


def judge(docs: DataFrame, rules: Sequence[Rule] | None = None,
          first: Rule | None = None, sample_size: int = SAMPLE) -> DataFrame:
    """``docs`` with counts, ``failed_rule`` (NULL where none rejects) and ``kept``.

    ``first`` stands before all others without being estimated.
    """
    rules = prose_rules() if rules is None else rules
    sample = with_counts(stage(_sampled(docs.select("doc_id", "text"), sample_size), "sample"))
    chain = [first] if first else []
    chain += ordered_rules(stage(sample, "sample-counts"), rules)
    failed = F.lit(None).cast("string")
    for rule in reversed(chain):
        failed = F.when(rule.rejects, F.lit(rule.name)).otherwise(failed)
    return with_counts(docs).withColumn("failed_rule", failed).withColumn(
        "kept", F.col("failed_rule").isNull())
