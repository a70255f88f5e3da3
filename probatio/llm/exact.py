"""Exact deduplication by deterministic block naming.

A normalised text is cut into blocks of a fixed number of bytes.  Distinct blocks are
sorted and numbered; then adjacent names are paired, distinct pairs sorted and
numbered, and so on until each text has a single name.  Two texts get the same
(level, name) if and only if they are equal.

Blocks are sorted by a 128-bit key instead of their bytes, so that text moves through
one shuffle only (pre-aggregated to distinct blocks in each task).  That every key
stands for one block is verified over all blocks; after a collision the keys are drawn
anew from another seed.

Rows: NULL counts as the empty text, which is one block of no bytes.  Of rows that are
equal in text and doc_id, one stays.  A NULL doc_id counts as the smallest.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from probatio.llm.common import fresh, let, stage

BLOCK_BYTES = 8192


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only; pure ASCII takes the fast built-in."""
    return (F.when(F.octet_length(text) == F.length(text), F.lower(text))
            .otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase)))


def _blocks(normal: Column, size: int) -> Column:
    """Slices of the text's bytes; the bytes are taken once, not once per block."""
    return let(normal.cast("binary"), lambda data: F.transform(
        F.sequence(F.lit(0), F.floor((F.greatest(F.octet_length(data), F.lit(1)) - 1) / size)
                   .cast("int")),
        lambda i: F.substring(data, i * size + 1, F.lit(size))))


def _keys(block: Column, seed: int) -> tuple[Column, Column]:
    return F.xxhash64(F.lit(2 * seed), block), F.xxhash64(F.lit(2 * seed + 1), block)


def _named(distinct: DataFrame, *keys: str) -> DataFrame:
    """Distinct rows with integer names in sort order, fixed by writing them."""
    return stage(distinct.repartitionByRange(*keys).sortWithinPartitions(*keys).select(
        *keys, F.monotonically_increasing_id().alias("name")), "names")


def _first_names(texts: DataFrame, size: int, seed: int) -> DataFrame | None:
    """Names of all distinct blocks, or None if two blocks share a key."""
    block = F.col("block")
    h1, h2 = _keys(block, seed)
    distinct = (texts.select(F.explode(_blocks(F.col("normal"), size)).alias("block"))
                .select(h1.alias("h1"), h2.alias("h2"), "block").distinct())
    keys = stage(distinct.groupBy("h1", "h2").agg(F.count("*").alias("n")), "block-keys")
    if keys.where("n > 1").take(1):
        return None
    return _named(keys, "h1", "h2")


def name_texts(docs: DataFrame, normalise=lower_ascii,
               block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): row, doc_id, text_sha256, level, name."""
    texts = docs.select("doc_id", normalise(F.coalesce("text", F.lit(""))).alias("normal"))
    seed, names = 0, None
    while names is None:
        names = _first_names(texts, block_bytes, seed)
        seed += 1
    block_keys = F.transform(_blocks(F.col("normal"), block_bytes), lambda b: F.struct(
        *(k.alias(n) for k, n in zip(_keys(b, seed - 1), ("h1", "h2"), strict=True))))
    rows = stage(texts.select(
        F.monotonically_increasing_id().alias("row"), "doc_id",
        F.sha2("normal", 256).alias("text_sha256"), block_keys.alias("keys")), "texts")
    parts = rows.select("row", F.size("keys").alias("n"),
                        F.posexplode("keys").alias("pos", "key")).select(
        "row", "n", "pos", "key.h1", "key.h2")
    state = stage(parts.join(names, ["h1", "h2"]).select("row", "n", "pos", "name"), "level-0")
    level, finished = 0, []
    while True:
        finished.append(state.where("n = 1").select("row", F.lit(level).alias("level"), "name"))
        if not state.where("n > 1").take(1):
            break
        half = (F.col("pos") / 2).cast("int")
        side = lambda odd: F.max(F.when(F.col("pos") % 2 == odd, F.col("name")))
        pairs = state.where("n > 1").groupBy(
            "row", "n", half.alias("pos")).agg(
            side(0).alias("left"), F.coalesce(side(1), F.lit(-1)).alias("right"))
        names = _named(pairs.select("left", "right").distinct(), "left", "right")
        level += 1
        state = stage(pairs.join(names, ["left", "right"]).select(
            "row", F.ceil(F.col("n") / 2).cast("int").alias("n"), "pos", "name"),
            f"level-{level}")
    done = finished[0]
    for more in finished[1:]:
        done = done.unionByName(more)
    return stage(rows.drop("keys").join(done, "row"), "identities")


def deduplicate(docs: DataFrame, normalise=lower_ascii,
                block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the largest doc_id is kept.
    """
    rows = name_texts(docs, normalise, block_bytes)
    groups = stage(rows.groupBy("level", "name").agg(
        F.max(F.struct("doc_id", "row")).alias("keep"),
        F.count("*").alias("n")).where("n > 1"), "copies")
    joined = rows.join(groups, ["level", "name"], "left")
    return joined.select(
        "doc_id",
        F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("keep.doc_id"))
        .alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("keep.row") == F.col("row"), F.lit(True)).alias("kept"),
        "text_sha256")


def without_copies(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group of equal texts."""
    own, kept_id, kept_sha = fresh(docs, "own_sha", "kept_id", "kept_sha")
    kept = deduplicate(docs).where("kept").select(
        F.col("doc_id").alias(kept_id), F.col("text_sha256").alias(kept_sha))
    once = docs.withColumn(own, F.sha2(lower_ascii(F.coalesce("text", F.lit(""))), 256)
                           ).dropDuplicates(["doc_id", own])
    return once.join(kept, F.col("doc_id").eqNullSafe(F.col(kept_id))
                     & (F.col(own) == F.col(kept_sha)), "left_semi").drop(own)
