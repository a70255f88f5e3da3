"""Draft bodies as typed, sanitised page sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from probatio import fixed_values as fv
from probatio.functions import text

_EDGE = "\u0001"
_MARKED = r"\*\*(.+?)\*\*|`([^`]+)`|(?<!\*)\*(?!\*)(.+?)(?<!\*)\*(?!\*)"


def strip_unsafe(value: Column) -> Column:
    """Remove anything executable, embeddable or navigable."""
    safe = value
    for pattern in (fv.DANGEROUS_BLOCK_PATTERN, fv.ENCODED_ANGLE_PATTERN,
                    fv.ANY_TAG_PATTERN, fv.DANGEROUS_SCHEME_PATTERN):
        safe = F.regexp_replace(safe, pattern, " ")
    return safe


def _without_links(value: Column) -> Column:
    flat = F.regexp_replace(strip_unsafe(value), fv.MARKDOWN_LINK_PATTERN, "$1")
    return F.regexp_replace(flat, fv.BARE_URL_PATTERN, " ")


def plain(value: Column) -> Column:
    bare = F.regexp_replace(_without_links(value), r"\*\*(.+?)\*\*", "$1")
    bare = F.regexp_replace(bare, r"(?<!\*)\*(?!\*)(.+?)(?<!\*)\*(?!\*)", "$1")
    bare = F.regexp_replace(bare, r"`([^`]+)`", "$1")
    return text.squeeze(bare)


def runs(value: Column) -> Column:
    """Text runs with an allowlisted mark; links are flattened to their label."""
    cut = F.split(F.regexp_replace(_without_links(value), _MARKED, f"{_EDGE}$0{_EDGE}"),
                  _EDGE)

    def run(piece: Column, i: Column) -> Column:
        marked = i % 2 == 1
        inner = (F.when(piece.startswith("**"), F.regexp_replace(
            piece, r"^\*\*|\*\*$", "")).otherwise(F.regexp_replace(
                piece, r"^[`*]|[`*]$", "")))
        mark = (F.when(piece.startswith("**"), "strong")
                .when(piece.startswith("`"), "code").otherwise("em"))
        return F.struct(
            F.when(marked, inner).otherwise(piece).alias("text"),
            F.when(marked, mark).alias("mark"))

    return F.filter(F.transform(cut, run),
                    lambda r: r["mark"].isNotNull() | r["text"].rlike(r"\S"))


def has_external_link(body: Column) -> Column:
    value = F.coalesce(body, F.lit(""))
    return value.rlike(fv.MARKDOWN_LINK_PATTERN) | value.rlike(fv.BARE_URL_PATTERN)


def sections(drafts: DataFrame) -> DataFrame:
    """One row per section: kind, level, text, items.

    Lines are classified, then runs of equal kind become one section.  A draft is
    one page, so its lines form a small window partition.
    """
    bullet, ordered = r"^\s*[-*+]\s+(.*)$", r"^\s*\d+[.)]\s+(.*)$"
    lines = drafts.select("draft_id", F.posexplode(F.split(
        F.coalesce("body", F.lit("")), r"\r\n|[\n\r\x0b\x0c]")).alias("line_ord", "_raw"))
    line = F.rtrim(F.col("_raw"))
    kind = (
        F.when(~line.rlike(r"\S"), "blank")
        .when(line.rlike(r"^#{1,6}\s+"), "heading")
        .when(line.rlike(bullet) | line.rlike(ordered), "list")
        .otherwise("paragraph")
    )
    item = F.when(line.rlike(bullet), F.regexp_extract(line, bullet, 1)).otherwise(
        F.regexp_extract(line, ordered, 1))
    in_order = Window.partitionBy("draft_id").orderBy("line_ord")
    typed = lines.withColumn("kind", kind).withColumn("content", (
        F.when(F.col("kind") == "heading", F.regexp_extract(line, r"^#{1,6}\s+(.*)$", 1))
        .when(F.col("kind") == "list", item).otherwise(F.trim(line)))
    ).withColumn("level", F.when(F.col("kind") == "heading", F.length(
        F.regexp_extract(line, r"^(#{1,6})", 1))))
    starts = ((F.col("kind") != F.lag("kind").over(in_order))
              | F.lag("kind").over(in_order).isNull() | (F.col("kind") == "heading"))
    numbered = typed.withColumn("_start", starts.cast("int")).withColumn(
        "_run", F.sum("_start").over(in_order)).where("kind != 'blank'")
    grouped = numbered.groupBy("draft_id", "_run").agg(
        F.first("kind").alias("kind"), F.first("level").alias("level"),
        F.transform(F.array_sort(F.collect_list(F.struct("line_ord", "content"))),
                    lambda x: x["content"]).alias("_lines"))
    joined = F.array_join("_lines", " ")
    priced = F.size(F.filter("_lines", lambda x: x.rlike(fv.PRICE_ITEM_PATTERN)))
    is_list = F.col("kind") == "list"
    built = grouped.select(
        "draft_id", "_run",
        F.when(is_list & (priced > 0) & (priced * 2 >= F.size("_lines")), "price_list")
        .otherwise(F.col("kind")).alias("kind"),
        "level",
        F.when(~is_list, plain(joined)).alias("text"),
        F.when(F.col("kind") == "paragraph", runs(joined)).alias("runs"),
        F.when(is_list, F.transform(
            "_lines", lambda x: F.struct(plain(x).alias("text"), runs(x).alias("runs"))))
        .alias("items"),
    ).where("kind != 'heading' or text != ''")
    place = F.row_number().over(Window.partitionBy("draft_id").orderBy("_run"))
    return built.withColumn("section_ord", place).drop("_run")
