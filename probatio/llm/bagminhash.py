"""Near-duplicate detection by BagMinHash signatures, banding and exact verification.

A document is the multiset of its five-word shingles; similarity is the weighted
Jaccard index, 0.8 or more.  A signature slot holds the first point of a Poisson
process over (shingle, weight): for each shingle the weights 0 to its count are covered
by intervals (0,1], (1,2], (2,4], (4,8], ...  A point of a wide interval is drawn
first and its interval is split in halves only while the point could still win a slot,
so a count of thousands costs little more than a count of one.

1. Documents with the same words are one class; the rest works on classes.
2. 128 slots in 32 bands of 4: a pair at 0.8 shares no band once in 20 million times.
3. In each band bucket all members are compared with one pivot, the member with the
   most company over all bands.  That is one pair per member, however large the bucket.
4. Links make components.  Where members other than the pivot still lie in different
   components, they may be linked with each other: such residual members are cut into
   blocks of about 256, and every pair of blocks is compared as a matrix product in one
   task.  Only links that join components are returned, so no link that matters is
   lost and no group's pairs are emitted.

Rows: words are runs without white space, A-Z count as a-z.  A document without
words (NULL, empty) is a class of its own row.  Repeated rows are one class.  With an
empty table the result is empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probatio.llm import shingles as sh
from probatio.llm.common import fresh, stage
from probatio.llm.graph import components

SLOTS, ROWS = 128, 4
THRESHOLD = 0.8
BLOCK = 256
U64 = np.uint64
SALT = [U64(0xD1B54A32D192ED03 + 2 * k * 0x9E3779B9) for k in range(8)]


def _exponential(bits: np.ndarray) -> np.ndarray:
    return -np.log(((bits >> U64(11)).astype(np.float64) + 0.5) / 2.0**53)


def signatures(shingle: np.ndarray, text: np.ndarray, count: np.ndarray, texts: int,
               slots: int = SLOTS) -> np.ndarray:
    """[texts, slots] ids of the winning points; texts without shingles keep zeros."""
    best = np.full(texts * slots, np.inf)
    ids = np.zeros(texts * slots, U64)
    low, high = 0, 1
    state = []
    while True:
        held = np.flatnonzero(count > low)
        if not len(held):
            break
        key = sh.mix(shingle[held] ^ sh.mix(np.array([low], U64) * SALT[0] + U64(high)))
        state.append((held, np.full(len(held), low), np.full(len(held), high), key,
                      _exponential(key) / (slots * (high - low))))
        low, high = high, 2 * high
    if not state:
        return ids.reshape(texts, slots)
    item, low, high, key, time = (np.concatenate(x) for x in zip(*state, strict=True))
    while len(item):
        leaf = high - low == 1
        # points of single weights: they are in slots now, the process goes on
        at, point = item[leaf], key[leaf]
        place = text[at] * slots + (sh.mix(point ^ SALT[1]) % U64(slots)).astype(np.int64)
        when = time[leaf]
        np.minimum.at(best, place, when)
        won = best[place] == when
        ids[place[won]] = point[won]
        later = sh.mix(point ^ SALT[2])
        nodes = [(at, low[leaf], high[leaf], later, when + _exponential(later) / slots)]
        if not leaf.all():
            # wide intervals: the point falls into one half, the other half draws its own
            at, lo, hi, point, when = (x[~leaf] for x in (item, low, high, key, time))
            middle, half = (lo + hi) // 2, (hi - lo) // 2
            right = (sh.mix(point ^ SALT[3]) >> U64(63)).astype(bool)
            same, other = sh.mix(point ^ SALT[4]), sh.mix(point ^ SALT[5])
            nodes.append((at, np.where(right, middle, lo), np.where(right, hi, middle),
                          same, when))
            nodes.append((at, np.where(right, lo, middle), np.where(right, middle, hi),
                          other, when + _exponential(other) / (slots * half)))
        item, low, high, key, time = (np.concatenate(x) for x in zip(*nodes, strict=True))
        limit = best.reshape(texts, slots).max(axis=1)
        go = (low < count[item]) & (time < limit[text[item]])
        item, low, high, key, time = (x[go] for x in (item, low, high, key, time))
    return ids.reshape(texts, slots)


def _digests(words: np.ndarray, counts: np.ndarray) -> list[bytes | None]:
    """128 bits of each text's sequence of words."""
    begin = np.cumsum(counts) - counts
    place = (np.arange(len(words)) - np.repeat(begin, counts)).astype(U64)
    full = np.flatnonzero(counts)
    sums = [np.add.reduceat(sh.mix(words * s + place * sh.GOLDEN), begin[full])
            if len(full) else np.zeros(0, U64) for s in SALT[:2]]
    pairs = np.stack([sh.mix(s + counts[full].astype(U64)) for s in sums], axis=1)
    found: list[bytes | None] = [None] * len(counts)
    for at, pair in zip(full, pairs, strict=True):
        found[at] = pair.tobytes()
    return found


def _sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for begin, run in sh.pieces(batch["text"]):
            words, counts = sh.word_hashes(run)
            signed = signatures(*sh.multiset(*sh.shingle_hashes(words, counts)), len(run))
            grouped = signed.reshape(len(run), SLOTS // ROWS, ROWS)
            band = np.broadcast_to(np.arange(SLOTS // ROWS, dtype=U64), grouped.shape[:2])
            for k in range(ROWS):
                band = sh.mix(band * sh.ODD + grouped[:, :, k] + U64(k))
            digests = _digests(words, counts)
            yield pd.DataFrame({
                "doc_id": batch["doc_id"].iloc[begin:begin + len(run)].array,
                "text_key": batch["text_key"].iloc[begin:begin + len(run)].array,
                "digest": digests,
                "bands": [b.view(np.int64) if d else None
                          for b, d in zip(band, digests, strict=True)]})


def _texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of rows with one doc_id, those that are the class's own text."""
    for batch in batches:
        for begin, run in sh.pieces(batch["text"]):
            part = batch.iloc[begin:begin + len(run)]
            own = [a == b for a, b in zip(_digests(*sh.word_hashes(run)), part["digest"],
                                          strict=True)]
            yield part.loc[own, ["class", "text"]]


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two sets of numbered shingles (the weighted index of the multisets)."""
    common = len(np.intersect1d(a, b, assume_unique=True))
    union = len(a) + len(b) - common
    return common / union if union else 0.0


def _verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    known: dict[int, np.ndarray] = {}  # of the pivot at hand

    def elements(node: int, text: str) -> np.ndarray:
        return sh.element_sets([text.encode("utf-8", "surrogatepass")])[0]

    for batch in batches:
        linked = []
        for a, b, left, right in zip(batch["a"], batch["b"], batch["left"], batch["right"],
                                     strict=True):
            if a not in known:
                known = {a: elements(a, left)}
            linked.append(jaccard(known[a], elements(b, right)) >= THRESHOLD)
        yield batch.loc[linked, ["a", "b"]]


def _block_links(rows: pd.DataFrame) -> pd.DataFrame:
    """Links between two blocks (or inside one) that join different components."""
    rows = rows.sort_values("class").reset_index(drop=True)
    sets = []
    for _, run in sh.pieces(rows["text"]):
        sets += sh.element_sets(run)
    sizes = np.array([len(s) for s in sets])
    element = np.concatenate(sets) if sets else np.zeros(0, U64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(element, kind="stable")
    element, owner = element[order], owner[order]
    new = np.append(True, element[1:] != element[:-1]) if len(element) else np.zeros(0, bool)
    column = np.cumsum(new) - 1
    shared = np.bincount(column) > 1 if len(column) else np.zeros(0, bool)
    keep = shared[column] if len(column) else np.zeros(0, bool)
    column, owner = (np.cumsum(shared) - 1)[column[keep]], owner[keep]
    common = np.zeros((len(sets), len(sets)), np.float64)
    for begin in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
        lo, hi = np.searchsorted(column, (begin, begin + 4096))
        held = np.zeros((len(sets), 4096), np.float32)
        held[owner[lo:hi], column[lo:hi] - begin] = 1
        common += held @ held.T
    near = common >= THRESHOLD * (sizes[:, None] + sizes[None, :] - common) - 1e-9
    component, block = rows["component"].to_numpy().copy(), rows["block"].to_numpy()
    near &= component[:, None] != component[None, :]
    if rows["i"].iloc[0] != rows["j"].iloc[0]:
        near &= block[:, None] != block[None, :]
    links = []
    for a, b in np.argwhere(np.triu(near, 1)):
        if component[a] != component[b]:
            component[component == component[b]] = component[a]
            links.append((rows["class"][a], rows["class"][b]))
    return pd.DataFrame(links, columns=["a", "b"], dtype="int64")


def _residual_links(members: DataFrame, texts: DataFrame, linked: DataFrame) -> DataFrame:
    """Links that no pivot shows, from buckets that still hold several components."""
    placed = members.where("class <> pivot").join(
        linked.withColumnRenamed("node", "class"), "class", "left").select(
        "key", "class", F.coalesce("component", "class").alias("component"))
    open_keys = placed.groupBy("key").agg(
        F.min("component").alias("first"), F.max("component").alias("last"),
        F.min("class").alias("hub")).where("first <> last").select("key", "hub")
    rest = stage(placed.join(open_keys, "key"), "residual")
    clusters = components(rest.select(F.col("class").alias("a"), F.col("hub").alias("b")))
    clusters = stage(rest.select("class", "component").distinct().join(
        clusters.select(F.col("node").alias("class"), F.col("component").alias("cluster")),
        "class"), "clusters")
    blocks = stage(clusters.groupBy("cluster").agg(
        F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")), "cluster-blocks")
    block = F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    spread = clusters.join(blocks, "cluster").withColumn("block", block).withColumn(
        "other", other).select(
        "class", "component", "cluster", "block", F.least("block", "other").alias("i"),
        F.greatest("block", "other").alias("j"))
    return spread.join(texts, "class").groupBy("cluster", "i", "j").applyInPandas(
        _block_links, "a long, b long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, text_key, class_id, class_size, kept.

    ``class_id`` is the largest doc_id of the class; that document is kept.
    """
    key = F.xxhash64("text").alias("text_key")
    signed = stage(docs.select("doc_id", key, "text").mapInPandas(
        _sign, "doc_id long, text_key long, digest binary, bands array<long>"), "signatures")
    classes = stage(signed.where("digest is not null").groupBy("digest").agg(
        F.min("doc_id").alias("doc_id"), F.first("bands").alias("bands")).select(
        F.monotonically_increasing_id().alias("class"), "digest", "doc_id", "bands"),
        "classes")
    banded = classes.select("class", F.explode("bands").alias("key"))
    company = banded.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    shared = stage(banded.join(company, "key"), "shared-bands")
    rank = shared.groupBy("class").agg(F.sum("n").alias("company"))
    ranked = shared.join(rank, "class")
    pivots = ranked.groupBy("key").agg(
        F.max(F.struct("company", "class"))["class"].alias("pivot"))
    members = stage(shared.join(pivots, "key").select("key", "class", "pivot"), "members")
    wanted = members.select("class").distinct().join(
        classes.select("class", "digest", F.col("doc_id").alias("first_id")), "class")
    texts = stage(docs.select("doc_id", "text").join(
        wanted, F.col("doc_id").eqNullSafe(F.col("first_id"))).select(
        "class", "digest", "text").mapInPandas(_texts, "class long, text string")
        .groupBy("class").agg(F.first("text").alias("text")), "texts")
    pairs = stage(members.where("class <> pivot").select(
        F.col("pivot").alias("a"), F.col("class").alias("b")).distinct(), "pairs")
    links = stage(pairs.join(texts.select(F.col("class").alias("b"), F.col("text").alias(
        "right")), "b").join(texts.select(F.col("class").alias("a"), F.col("text").alias(
            "left")), "a").mapInPandas(_verify, "a long, b long"), "links")
    linked = components(links)
    more = stage(_residual_links(members, texts, linked), "residual-links")
    if more.take(1):
        linked = components(links.union(more))
    named = stage(classes.select("class", "digest").join(
        linked.withColumnRenamed("node", "class"), "class", "left").select(
        "digest", F.coalesce("component", "class").alias("component")), "named")
    placed = stage(signed.select(
        F.monotonically_increasing_id().alias("row"), "doc_id", "text_key", "digest").join(
        named, "digest", "left"), "placed")
    groups = stage(placed.where("component is not null").groupBy("component").agg(
        F.max(F.struct("doc_id", "row")).alias("keep"), F.count("*").alias("n")), "groups")
    return placed.join(groups, "component", "left").select(
        "doc_id", "text_key", F.coalesce("keep.doc_id", "doc_id").alias("class_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("class_size"),
        F.coalesce(F.col("keep.row") == F.col("row"), F.lit(True)).alias("kept"))


def without_near_duplicates(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each class."""
    kept_id, kept_key = fresh(docs, "kept_id", "kept_key")
    kept = near_duplicates(docs).where("kept").select(
        F.col("doc_id").alias(kept_id), F.col("text_key").alias(kept_key))
    return docs.join(kept, F.col("doc_id").eqNullSafe(F.col(kept_id))
                     & (F.xxhash64("text") == F.col(kept_key)), "left_semi")
