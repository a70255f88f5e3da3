"""Line deduplication with a tree of log templates.

The tree has a fixed depth: a line goes by its number of words and its first ``DEPTH``
words to a leaf; words with a digit are variable fields from the start.  Within a leaf
a word is constant at its place if at least ``min_documents`` lines have it there, else it
is a variable field too.  Lines with the same constants are one template.  A template
that at least ``min_documents`` documents contain and most of whose words are constant
recurs: its lines stay in the document with the smallest doc_id and go from all others.

Lines whose words are all the same, digits included, need no such support: of whatever
length, such a line recurs from two documents on.

Everything is counted over all lines.  Equal lines are put together before words are
counted, so a line in a third of all documents is one row there.

Rows: a line without ``min_words`` words has no template, one without a word always stays; a
NULL text has no lines and stays NULL.  Repeated rows are one document.  Lines of rows without
doc_id go where they or their template recur.  An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from probatio.llm.common import WORD, fresh, let, stage

DEPTH = 4
MIN_WORDS = 3  # of a line with variable fields
MIN_DOCUMENTS = 10  # of a template with variable fields
CONSTANT = 0.7  # share of constant words in a template that may recur
FIELD = "<*>"
VARIABLE = r"[^\x20\x09-\x0D0-9]*+[0-9][^\x20\x09-\x0D]*+"
WHITE = ("  ", "\t", "\x0b", "\x0c", "\r")  # other than single spaces between words


def even_line(line: Column) -> Column:
    """The words of a line with single spaces between them.

    The expensive pattern runs only on lines that need it.
    """
    uneven = F.startswith(line, F.lit(" ")) | F.endswith(line, F.lit(" "))
    for white in WHITE:
        uneven = uneven | F.contains(line, F.lit(white))
    return F.when(uneven, F.array_join(F.regexp_extract_all(
        line, F.lit(f"({WORD})")), " ")).otherwise(line)


def masked_line(line: Column) -> Column:
    """The same with words with a digit as a field."""
    return let(F.when(line.rlike("[0-9]"), F.regexp_replace(line, VARIABLE, FIELD))
               .otherwise(line), even_line)


def _words(line: Column) -> Column:
    """Number of words of a masked line."""
    spaces = F.octet_length(line) - F.octet_length(F.replace(line, F.lit(" "), F.lit("")))
    return F.when(line == "", 0).otherwise(spaces + 1)


def _leaf(line: Column) -> Column:
    return F.concat_ws(" ", _words(line).cast("string"), F.substring_index(line, " ", DEPTH))


def _equal(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, place): lines whose words stand in the same order in a line of a
    document before.

    Lines are known by 128 bits of their words, so text is read once and never shuffled.
    """
    keys = F.transform(F.split("text", "\n"), lambda raw: let(even_line(raw), lambda x: F.when(
        x != "", F.struct(F.xxhash64(x).alias("a"), F.xxhash64(F.lit(1), x).alias("b")))))
    lines = stage(docs.select("doc_id", F.xxhash64("text").alias("text_key"),
                              F.posexplode(keys).alias("place", "line"))
                  .where(F.col("line").isNotNull())
                  .select("doc_id", "text_key", "place", "line.a", "line.b"), "equal-lines")
    first, last = F.col("first_id"), F.col("last_id")
    repeated = stage(lines.groupBy("a", "b").agg(
        F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"),
        F.bool_or(F.col("doc_id").isNull()).alias("unnamed")).where(
        (first < last) | (first.isNotNull() & F.col("unnamed"))).select(
        "a", "b", "first_id"), "repeated-lines")
    return stage(lines.join(repeated, ["a", "b"]).where(
        ~F.col("doc_id").eqNullSafe(first)).select("doc_id", "text_key", "place"), "equal-places")


def _recurring(docs: DataFrame, min_documents: int, min_words: int,
               constant: float) -> DataFrame:
    """(doc_id, text_key, place): lines that go since their template recurs."""
    keyed = docs.select("doc_id", F.xxhash64("text").alias("text_key"),
                        F.split("text", "\n").alias("lines"))
    parsed = F.filter(F.transform("lines", masked_line), lambda x: _words(x) >= min_words)
    leaves = stage(
        keyed.select(F.explode(F.array_distinct(F.transform(parsed, _leaf))).alias("leaf"))
        .groupBy("leaf").agg(F.count("*").alias("n")).where(F.col("n") >= min_documents)
        .select("leaf", F.monotonically_increasing_id().alias("leaf_id")), "leaves")
    line = F.col("line")
    lines = (keyed.select("doc_id", "text_key", F.posexplode("lines").alias("place", "raw"))
             .select("doc_id", "text_key", "place",
                     F.explode(F.array(masked_line(F.col("raw")))).alias("line"))
             .where(_words(line) >= min_words)
             .select("doc_id", "text_key", "place", _leaf(line).alias("leaf"), "line"))
    found = stage(lines.join(leaves, "leaf").drop("leaf"), "leaf-lines")
    distinct = stage(found.groupBy("leaf_id", "line").agg(F.count("*").alias("n")).select(
        F.monotonically_increasing_id().alias("line_id"), "leaf_id", "line", "n"), "lines")
    tokens = distinct.select("line_id", "leaf_id", "n",
                             F.posexplode(F.split("line", " ")).alias("at", "word"))
    constants = stage(tokens.where(F.col("word") != FIELD).groupBy(
        "leaf_id", "at", "word").agg(F.sum("n").alias("n")).where(
        F.col("n") >= min_documents).select("leaf_id", "at", "word",
                                            F.lit(True).alias("fixed")), "constants")
    word = F.when(F.col("fixed"), F.col("word")).otherwise(FIELD)
    shaped = tokens.join(constants, ["leaf_id", "at", "word"], "left").groupBy(
        "line_id").agg(
        F.sort_array(F.collect_list(F.struct("at", word.alias("word")))).alias("words"),
        (F.count("fixed") / F.count("*") >= constant).alias("solid")).where("solid").select(
        "line_id", F.array_join(F.transform("words", lambda w: w["word"]), " ")
        .alias("template"))
    shaped = stage(distinct.select("line_id", "leaf_id", "line").join(shaped, "line_id").select(
        "leaf_id", "line", "template"), "templates")
    placed = stage(found.join(shaped, ["leaf_id", "line"]).drop("line"), "template-lines")
    recurring = stage(placed.select("leaf_id", "template", "doc_id").distinct().groupBy(
        "leaf_id", "template").agg(F.count("*").alias("documents"),
                                   F.min("doc_id").alias("first_id")).where(
        F.col("documents") >= min_documents).drop("documents"), "recurring")
    return placed.join(recurring, ["leaf_id", "template"]).where(
        ~F.col("doc_id").eqNullSafe(F.col("first_id"))).select("doc_id", "text_key", "place")


def drop_recurring_lines(docs: DataFrame, equal_lines: bool = True,
                         min_documents: int = MIN_DOCUMENTS, min_words: int = MIN_WORDS,
                         constant: float = CONSTANT) -> DataFrame:
    """``docs`` with ``text`` without the lines that recur, then n_lines and n_dropped
    (these two replace columns of the same name).

    ``equal_lines`` False leaves lines in place that are equal in fewer than
    ``min_documents`` documents.
    """
    texts = docs.select("doc_id", "text")
    gone = _recurring(texts, min_documents, min_words, constant)
    return _without(docs, _equal(texts).unionByName(gone) if equal_lines else gone)


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    own_id, own_key, places = fresh(docs, "own_id", "own_key", "places")
    dropped = stage(gone.groupBy("doc_id", "text_key").agg(
        F.collect_set("place").alias("dropped")), "dropped").select(
        F.col("doc_id").alias(own_id), F.col("text_key").alias(own_key),
        F.col("dropped").alias(places))
    joined = docs.join(dropped, F.col("doc_id").eqNullSafe(F.col(own_id))
                       & (F.xxhash64("text") == F.col(own_key)), "left")
    original, lines = F.col("text"), F.split("text", "\n")
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(places))
    text = F.when(F.col(places).isNull(), F.col("text")).otherwise(
        F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n"))
    return joined.select(
        *(text.alias(c) if c == "text" else F.col(c) for c in docs.columns
          if c not in ("n_lines", "n_dropped")),
        F.coalesce(1 + F.octet_length(original) - F.octet_length(
            F.replace(original, F.lit("\n"), F.lit(""))), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size(places), F.lit(0)).cast("long").alias("n_dropped"))
