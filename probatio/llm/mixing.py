"""Mix sources to target weights with a low-discrepancy schedule.

Each source is a stream: its documents in a fixed pseudo-random order, repeated, and
cut into blocks of ``block_tokens`` words.  A slot t of the schedule gets the van der
Corput point of t; the point, mapped through the cumulative shares of the sources,
names the source, and the k-th slot of a source takes the k-th block of its stream.
The schedule repeats after a power of two of slots, so the rank of a slot within its
source follows from a table of one period; no window runs over all slots.  A source's
slots beyond its quota stay empty, which makes its taken words equal its target,
rounded down.

Rows: a NULL text has no words, a NULL source is a source of its own.  Repeated rows
and repeated doc_ids are separate rows of the stream.  A source without words takes
none.  With an empty table the result is empty.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from probatio.llm.common import fresh, order_key, stage, with_start, word_count

BLOCK_TOKENS = 2048
PERIOD_SHARES = 4096  # resolution of the shares within one period of the schedule


def cyclic_weights(sources: DataFrame, cycle: Sequence[float]) -> DataFrame:
    """Weights that repeat along the sources, by code point, NULL last (one row per source)."""
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    weights = F.array(*(F.lit(float(w)) for w in cycle))
    place = F.row_number().over(by_name) - 1
    return sources.withColumn("weight", F.element_at(weights, (place % len(cycle) + 1)
                                                     .cast("int")))


def solve_targets(sources: DataFrame, share: float, least: int, most: int) -> DataFrame:
    """Targets proportional to weight, from ``least`` to ``most`` times the source's size.

    target = weight x level within these bounds; the level at which the targets sum to
    ``share`` of all sizes is found between two of the bounds, sorted by the level
    at which they are met (two rows per source).
    """
    low, high = F.col("source_size") * least, F.col("source_size") * most
    zero = F.lit(0).cast("long")
    events = sources.select(F.explode(F.array(
        F.struct((low / F.col("weight")).alias("at"), F.lit(0).alias("ends"),
                 F.col("weight").alias("slope"), low.alias("low"), zero.alias("high"),
                 F.col("source_size").alias("size")),
        F.struct((high / F.col("weight")).alias("at"), F.lit(1).alias("ends"),
                 (-F.col("weight")).alias("slope"), zero.alias("low"), high.alias("high"),
                 zero.alias("size"))
    )).alias("e")).select("e.*")
    so_far = Window.orderBy("at", "ends").rowsBetween(Window.unboundedPreceding, 0)
    everything = Window.orderBy("at", "ends").rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing)
    flat = (F.sum("low").over(everything) - F.sum("low").over(so_far)
            + F.sum("high").over(so_far))
    steps = events.select("at", flat.alias("flat"), F.sum("slope").over(so_far).alias("slope"),
                          (F.sum("size").over(everything) * share).alias("wanted"))
    found = (steps.where(F.col("flat") + F.col("slope") * F.col("at") <= F.col("wanted"))
             .agg(F.max_by(F.struct("at", "flat", "slope", "wanted"),
                           F.struct("at", "flat")).alias("s"))
             .select(F.when(F.col("s").isNull(), F.lit(0.0))
                     .when(F.col("s.slope") > 0,
                           (F.col("s.wanted") - F.col("s.flat")) / F.col("s.slope"))
                     .otherwise(F.col("s.at")).alias("level")))
    level = F.lit(float(found.first()["level"]))  # a single number
    return sources.select(*sources.columns, F.least(high.cast("double"), F.greatest(
        low.cast("double"), level * F.col("weight"))).alias("target"))


def _period(sources: DataFrame) -> tuple[DataFrame, int]:
    """One period of the schedule, (key, rank, slot, per_period), and its length."""
    spark = sources.sparkSession
    whole = Window.partitionBy()
    cells = F.greatest(F.lit(1), F.round(
        PERIOD_SHARES * F.col("quota") / F.sum("quota").over(whole))).cast("long")
    sized = sources.where("quota > 0").select("key", cells.alias("cells"))
    before = Window.orderBy("key").rowsBetween(Window.unboundedPreceding, 0)
    sized = sized.withColumn("upto", F.sum("cells").over(before))
    total = sized.agg(F.coalesce(F.max("upto"), F.lit(1)).alias("n")).first()["n"]
    bits = max(1, (total - 1).bit_length())
    length = 1 << bits
    point = F.conv(F.reverse(F.lpad(F.bin("id"), bits, "0")), 2, 10).cast("long")
    slots = spark.range(length).select(
        F.col("id").alias("slot"), F.floor(point * total / length).alias("cell"))
    owners = sized.select("key", F.explode(F.sequence(
        F.col("upto") - F.col("cells"), F.col("upto") - 1)).alias("cell"))
    mine = Window.partitionBy("key")
    period = slots.join(owners, "cell").select(
        "key", (F.row_number().over(mine.orderBy("slot")) - 1).cast("long").alias("rank"),
        "slot", F.count("*").over(mine).alias("per_period"))
    return stage(period, "period"), length


def mix(docs: DataFrame, cycle: Sequence[float], share: float = 1.5, least: int = 0,
        most: int = 2, block_tokens: int = BLOCK_TOKENS,
        size: Column | None = None) -> DataFrame:
    """The mix as pieces of documents: the words [from_word, to_word) of a document that
    slot ``slot`` takes in pass ``epoch`` over its source.

    Order by (slot, epoch, start) to read the mix.  A document of which nothing is
    taken has one row with NULLs in the piece's columns.  ``bucket`` and ``ordinal``
    with ``key`` identify the row of ``docs``.
    """
    size = word_count(F.col("text")) if size is None else size
    rows = stage(docs.select(
        "doc_id", "source", size.alias("size"), order_key().alias("order_key"),
        F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")).alias("key")), "sizes")
    sources = rows.groupBy("key", "source").agg(F.sum("size").alias("source_size"))
    targets = solve_targets(cyclic_weights(sources, cycle), share, least, most)
    targets = stage(targets.withColumn("quota", F.floor("target")).drop("source"), "targets")
    period, length = _period(targets)
    per_period = period.groupBy("key").agg(F.first("per_period").alias("per_period"))
    placed = with_start(
        rows, ["key"], ["order_key", "doc_id", "size"], F.col("size"),
        targets.join(per_period, "key", "left").select(
            "key", "source_size", "target", "quota", "per_period"))

    def piece(epoch: Column) -> Column:
        begin = epoch * F.col("source_size") + F.col("start")
        end = F.least(begin + F.col("size"), F.col("quota"))
        blocks = F.sequence(F.expr("0L") + F.floor(begin / block_tokens),
                            F.floor((end - 1) / block_tokens))
        return F.when(end > begin, F.transform(blocks, lambda k: F.struct(
            epoch.alias("epoch"), k.alias("block"),
            (F.greatest(begin, k * block_tokens) - begin).alias("from_word"),
            (F.least(end, (k + 1) * block_tokens) - begin).alias("to_word")))
        ).otherwise(F.array())

    epochs = F.sequence(F.lit(0).cast("long"), F.lit(most - 1).cast("long"))
    pieces = placed.withColumn("piece", F.explode_outer(F.flatten(
        F.transform(epochs, piece)))).select(
        "key", "bucket", "ordinal", "doc_id", "source", "size", "source_size", "target",
        "start", "per_period", "piece.*").withColumn(
        "rank", F.col("block") % F.col("per_period"))
    slot = F.floor(F.col("block") / F.col("per_period")) * length + F.col("slot")
    return pieces.join(period.select("key", "rank", "slot"), ["key", "rank"], "left").select(
        "key", "bucket", "ordinal", "doc_id", "source", "size", "source_size", "target",
        "start", slot.alias("slot"), "block", "epoch", "from_word", "to_word")


def taken(pieces: DataFrame) -> DataFrame:
    """Per document: size, source_size, target, words taken, and copies begun."""
    return pieces.groupBy("key", "bucket", "ordinal", "doc_id", "size", "source_size",
                          "target").agg(
        F.coalesce(F.sum(F.col("to_word") - F.col("from_word")), F.lit(0)).alias("taken"),
        F.count(F.when(F.col("from_word") == 0, 1)).alias("copies"))


def mixed_documents(docs: DataFrame, cycle: Sequence[float], share: float = 1.5,
                    least: int = 0, most: int = 2) -> DataFrame:
    """``docs`` with each document as often as the mix begins to read it.

    doc_id names a document here.  With ``least`` = 1 every document with words is read
    once at least; documents without words are never read.
    """
    mixed_id, copies, copy = fresh(docs, "mixed_id", "copies", "copy")
    counted = taken(mix(docs, cycle, share, least, most)).groupBy(
        F.col("doc_id").alias(mixed_id)).agg(F.max("copies").alias(copies)).where(
        F.col(copies) > 0)
    return docs.join(counted, F.col("doc_id").eqNullSafe(F.col(mixed_id))).select(
        *docs.columns, F.explode(F.sequence(F.lit(1).cast("long"), copies)).alias(copy)
    ).drop(copy)
