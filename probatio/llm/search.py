"""Ranked lexical search by pipelined term partitioning.

Terms belong to owners by how rare they are (``RARITY``: rarest first), and the postings of
an owner are a table of their own.  Items travel in bundles from owner to owner.  A bundle
carries, per item, a sparse accumulator: the documents met so far with their sums.  At each
owner a ``cogroup`` brings bundle and postings together, and the owner adds its integer
contributions.  After the last owner the best documents remain.

Postings and accumulators are cut into slices of about ``SLICE`` documents, so a term that
most documents hold is spread over as many tasks as there are slices; a group holds one
bundle and one slice.  A document leaves an accumulator early only if it cannot come back:
when its sum and the most that later owners could add stay below the k-th sum of the slice.

Terms of documents that no item asks for are left out by a filter of fixed size
(2**``FILTER_BITS`` bits) while a text is read.  It never hides a term that is asked for,
and a join removes what it lets through besides.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from probatio.llm.common import stage

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FILTER_BITS = 20
RARITY = (256, 16)  # owners: terms in under 1/256 of the documents, in under 1/16, in more
SLICE = 8192  # documents
BUNDLE = 128  # items

_TERM = re.compile(TERM)
_LOWER = str.maketrans(UPPER, LOWER)


def item_terms(items: DataFrame) -> DataFrame:
    """item_id, term, repeats.  Rows of one item_id make one item; equal rows count once."""
    lowered = F.translate(F.coalesce("text", F.lit("")), UPPER, LOWER)
    return (items.select("item_id", "text").distinct()
            .select("item_id", F.explode(F.regexp_extract_all(
                lowered, F.lit(TERM), F.lit(0))).alias("term"))
            .groupBy("item_id", "term").agg(F.count("*").alias("repeats")))


def _counts(batches, bits: bytes):
    """Per document: its number of terms, and how often it holds those that pass the filter."""
    last = (1 << FILTER_BITS) - 1
    passes: dict[str, str | None] = {}  # terms as written -> lower-cased, or None
    for batch in batches:
        sizes, terms, counts = [], [], []
        for text in batch.column("text").to_pylist():
            found = Counter(_TERM.findall(text or ""))
            held: dict[str, int] = {}
            for word, count in found.items():
                if word not in passes:
                    if len(passes) >= 200_000:
                        passes.clear()
                    low = word.lower() if word.isascii() else word.translate(_LOWER)
                    at = zlib.crc32(low.encode()) & last
                    passes[word] = low if bits[at >> 3] >> (at & 7) & 1 else None
                low = passes[word]
                if low is not None:
                    held[low] = held.get(low, 0) + count
            sizes.append(sum(found.values()))
            terms.append(list(held))
            counts.append(list(held.values()))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(sizes, pa.int64()),
             pa.array(terms, pa.list_(pa.string())), pa.array(counts, pa.list_(pa.int64()))],
            names=["doc_id", "n", "terms", "counts"])


def term_filter(terms: DataFrame) -> bytes:
    """A bit for each hash of a term; 2**FILTER_BITS bits, whatever the number of terms."""
    places = F.crc32(F.col("term").cast("binary")).bitwiseAND((1 << FILTER_BITS) - 1)
    bits = bytearray(1 << FILTER_BITS >> 3)
    for (at,) in terms.select(places.alias("at")).distinct().collect():
        bits[at >> 3] |= 1 << (at & 7)
    return bytes(bits)


def _runs(keys: np.ndarray, wanted: np.ndarray):
    return np.searchsorted(keys, wanted, "left"), np.searchsorted(keys, wanted, "right")


def owner_visit(k: int, last: bool):
    """The step of a bundle at one owner, for ``cogroup``."""
    def step(bundle: pa.Table, postings: pa.Table) -> pa.Table:
        return _visit(bundle, postings, k, last)
    return step


def _visit(bundle: pa.Table, postings: pa.Table, k: int, last: bool) -> pa.Table:
    """One bundle at one owner, within one slice of the documents."""
    carried = bundle.filter(pc.is_valid(bundle.column("rows")))
    plan = bundle.filter(pc.is_null(bundle.column("rows")))
    flat = lambda name: carried.column(name).combine_chunks().flatten()
    rows = np.concatenate([postings.column("row").to_numpy(), flat("rows").to_numpy()])
    docs = pa.concat_arrays([postings.column("doc_id").combine_chunks(), flat("docs")])
    rows, first, local = np.unique(rows, return_index=True, return_inverse=True)
    docs = docs.take(pa.array(first))
    missing = np.asarray(docs.is_null())
    names = np.asarray(docs.fill_null(0))

    terms = postings.column("term_no").to_numpy()
    by_term = np.argsort(terms, kind="stable")
    terms = terms[by_term]
    at = local[:len(terms)][by_term]
    impact = postings.column("impact").to_numpy()[by_term]
    old = {}
    place, sums = len(by_term), flat("sums").to_numpy()
    for item, n in zip(carried.column("item").to_pylist(),
                       pc.list_value_length(carried.column("rows")).to_pylist()):
        old[item] = (local[place:place + n], sums[place - len(by_term):place - len(by_term) + n])
        place += n

    out = {"item": [], "rows": [], "docs": [], "sums": []}
    for row in plan.to_pylist():
        total = np.zeros(len(rows), dtype=np.int64)
        if row["item"] in old:
            where, before = old[row["item"]]
            total[where] = before
        for weight, a, b in zip(row["weights"], *_runs(
                terms, np.array(row["terms"], dtype=np.int64))):
            total[at[a:b]] += weight * impact[a:b]
        live = np.flatnonzero(total)
        if len(live) > k:
            least = np.partition(total[live], len(live) - k)[len(live) - k]
            live = live[total[live] + row["rest"] >= least]
        if last:
            live = live[np.lexsort((rows[live], names[live], missing[live], -total[live]))[:k]]
        if len(live):
            out["item"].append(row["item"])
            out["rows"].append(rows[live])
            out["docs"].append(docs.take(pa.array(live)))
            out["sums"].append(total[live])
    head = bundle.slice(0, 1)
    n = len(out["item"])
    lists = [pa.array([x.tolist() if isinstance(x, np.ndarray) else x.to_pylist()
                       for x in out[name]], pa.list_(pa.int64()))
             for name in ("rows", "docs", "sums")]
    return pa.table([
        pa.array([head.column("slice")[0].as_py()] * n, pa.int32()),
        pa.array([head.column("bundle")[0].as_py()] * n, pa.int32()),
        pa.array(out["item"], pa.int64()), *lists],
        names=["slice", "bundle", "item", "rows", "docs", "sums"])


CARRIED = ("slice int, bundle int, item long, rows array<long>, docs array<long>, "
           "sums array<long>")
PLAN = "terms array<long>, weights array<long>, rest long"


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 10,
                   slice_size: int = SLICE, bundle_size: int = BUNDLE) -> DataFrame:
    """item_id, rank, doc_id, score: for each item its ``k`` documents of the highest score
    above 0, equal scores by ascending doc_id (NULL last).

    A term is a maximal run of letters, digits and characters beyond ASCII, A-Z
    lower-cased.  A NULL or empty text has none.  Each row of ``docs`` is a document, so a
    repeated row is ranked as often as it is there.  Rows of one item_id (NULL too) make one
    item, equal rows of ``items`` count once, and an item without a term or a match gives no
    row.  Columns other than doc_id and text, item_id and text are ignored.  Without
    documents or items nothing comes out.
    """
    spark = docs.sparkSession
    wanted = stage(item_terms(items), "search-item-terms")
    bits = spark.sparkContext.broadcast(term_filter(wanted.select("term")))
    index = stage(docs.select("doc_id", "text").mapInArrow(
        lambda batches: _counts(batches, bits.value),
        "doc_id long, n long, terms array<string>, counts array<long>").select(
        F.monotonically_increasing_id().alias("row"), "*"), "search-index")
    all_rows, worded, length = index.agg(
        F.count("*"), F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    slices = max(1, -(-all_rows // slice_size))

    penalty = F.lit(25) + F.call_function(
        "div", F.lit(75) * F.col("n") * F.lit(worded), F.lit(max(1, length)))
    tf = F.col("counts")
    held = index.where("n > 0").select(
        "row", "doc_id", penalty.alias("m"), F.inline(F.arrays_zip("terms", "counts"))).select(
        "row", "doc_id", F.col("terms").alias("term"), F.call_function(
            "div", F.lit(1_000_000_000) * tf, F.lit(1000) * tf + F.lit(8) * F.col("m"))
        .alias("impact"))
    items_of = stage(wanted.groupBy("item_id").agg(F.count("*").alias("n_terms")).select(
        F.monotonically_increasing_id().alias("item"), "item_id"), "search-items")
    n_items = items_of.count()
    bundles = max(1, -(-n_items // bundle_size))
    asked = wanted.join(items_of, wanted["item_id"].eqNullSafe(items_of["item_id"])).select(
        "item", "term", "repeats",
        F.pmod(F.xxhash64("item"), F.lit(bundles)).cast("int").alias("bundle"))
    counted = held.groupBy("term").agg(F.count("*").alias("df"), F.max("impact").alias("top"))
    owner = F.lit(len(RARITY))
    for number, share in reversed(list(enumerate(RARITY))):
        owner = F.when(F.col("df") * share < worded, number).otherwise(owner)
    lexicon = stage(
        asked.groupBy("term").agg(F.collect_set("bundle").alias("bundles")).join(
            counted, "term").select(
            F.monotonically_increasing_id().alias("term_no"), "term", "bundles", "top",
            owner.alias("owner"),
            F.floor(1000 * F.log((F.lit(2.0) * worded + 2) / (F.lit(2.0) * F.col("df") + 1)))
            .cast("long").alias("weight")), "search-lexicon")

    entries = stage(held.join(lexicon.select("term", "term_no", "owner", "bundles"), "term")
                    .select("owner", F.pmod(F.xxhash64("row"), F.lit(slices)).cast("int")
                            .alias("slice"), F.explode("bundles").alias("bundle"),
                            "row", "doc_id", "term_no", "impact"), "search-postings", "owner")
    steps = stage(asked.join(lexicon, "term").groupBy("bundle", "item", "owner").agg(
        F.collect_list(F.struct("term_no", (F.col("repeats") * F.col("weight")).alias("w")))
        .alias("terms"),
        F.sum(F.col("repeats") * F.col("weight") * F.col("top")).alias("most")), "search-plan")

    carried = spark.createDataFrame([], CARRIED)
    everywhere = F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice")
    here = {n: F.col("owner") == n for n in range(len(RARITY) + 1)}
    for number in here:
        mine = F.flatten(F.collect_list(F.when(here[number], F.col("terms"))))
        plan = steps.groupBy("bundle", "item").agg(
            mine.alias("t"), F.coalesce(F.sum(F.when(F.col("owner") > number, F.col("most"))),
                                        F.lit(0)).alias("rest")).select(
            everywhere, "bundle", "item", F.transform("t", lambda x: x["term_no"])
            .alias("terms"), F.transform("t", lambda x: x["w"]).alias("weights"), "rest")
        bundle = carried.unionByName(plan, allowMissingColumns=True)
        carried = bundle.groupBy("slice", "bundle").cogroup(
            entries.where(here[number]).groupBy("slice", "bundle")).applyInArrow(
            owner_visit(k, number == len(RARITY)), CARRIED)

    hits = carried.select("item", "slice", F.inline(F.arrays_zip("rows", "docs", "sums")))
    order = [F.desc("sums"), F.asc_nulls_last("docs"), "rows"]
    for key in (["item", "part"], ["item"]):  # the slices of an item in parts, then all
        if "part" in key:
            hits = hits.withColumn("part", F.pmod("slice", F.lit(64)))
        hits = hits.withColumn("rank", F.row_number().over(
            Window.partitionBy(*key).orderBy(*order))).where(F.col("rank") <= k)
    return hits.join(items_of, "item").select(
        "item_id", "rank", F.col("docs").alias("doc_id"), F.col("sums").alias("score"))
