"""Nearest neighbours by collision counting over single-projection sorted arrays.

Every vector is projected on ``PROJECTIONS`` random lines.  A slice of the vectors keeps,
for each line, its projections in one sorted array.  A query opens a window around its own
projection in every array; the radius grows round by round (virtual rehashing: one array
serves all radii) and only the rims of a window are read again.  A vector that lies in the
windows of ``THRESHOLD`` lines or more is verified by its exact distance.  A query ends when
the radius has reached its k-th distance: of vectors at that very distance 97% pass the
threshold, of nearer ones more.

All vectors are indexed.  The first slice answers every query and so gives a first k-th
distance; it is as good as a random sample, since slices are dealt by a hash.  The other
slices only look within that radius.  Slices (``SLICE`` vectors) meet blocks of queries
(``BLOCK``), so a task holds one of each, however many there are.

Equal vectors are searched once: their class stands for them and carries its k + 1 smallest
ids, of which no query can need more.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from probatio.llm.common import stage

PROJECTIONS = 40
THRESHOLD = 22  # of 40 windows; a vector at the radius lies in each with a chance of 0.683
GROWTH = 1.5  # of the radius from round to round
SLICE = 8192  # vectors that share sorted arrays
BLOCK = 4096  # queries that meet a slice at once
FIRST_BLOCK = 64  # the same for the first slice, which all queries visit
SEED = 20


def usable(vector: Column) -> Column:
    """Neither NULL nor zero nor with a component that is NULL or not finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x)
                      & (F.abs(x) < F.lit(float("inf"))))
    return vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0)


def classes(rows: DataFrame, keep: int) -> DataFrame:
    """One row per different vector: ``ids``, its ``keep`` smallest ids in order, and
    ``asked``, whether a query has it.  ``rows`` has vec_id, vector, asked."""
    rows = rows.groupBy("vector", "vec_id").agg(F.max("asked").alias("asked"))
    part = F.pmod(F.xxhash64("vec_id"), F.lit(64))
    for key in (["vector", "part"], ["vector"]):  # a frequent vector is cut down in parts
        smallest = Window.partitionBy(*key).orderBy("vec_id")
        if "part" in key:
            asked = rows.where("asked").select("vector").distinct()
            rows = rows.drop("asked").withColumn("part", part)
        rows = rows.withColumn("place", F.row_number().over(smallest)).where(
            F.col("place") <= keep)
    named = rows.groupBy("vector").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    return named.join(asked.withColumn("asked", F.lit(True)), "vector", "left").select(
        F.monotonically_increasing_id().alias("class"), "vector", "ids",
        F.coalesce("asked", F.lit(False)).alias("asked"), F.size("vector").alias("dim"))


def _lines(dim: int) -> np.ndarray:
    return np.random.default_rng(SEED).standard_normal((dim, PROJECTIONS))


def _matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy().reshape(-1, dim)


class SortedArrays:
    """The vectors of a slice with one sorted array per line."""

    def __init__(self, vectors: np.ndarray, names: np.ndarray, firsts: np.ndarray):
        order = np.lexsort((names, firsts))
        self.vectors, self.names, self.firsts = vectors[order], names[order], firsts[order]
        self.lines = _lines(vectors.shape[1])
        on_lines = self.vectors @ self.lines
        self.order = np.ascontiguousarray(np.argsort(on_lines, axis=0, kind="stable").T)
        self.values = np.ascontiguousarray(np.sort(on_lines, axis=0).T)

    def distances(self, query: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Exact distances, summed from the first component to the last."""
        return np.sqrt(np.cumsum((self.vectors[rows] - query) ** 2, axis=1)[:, -1])

    def first_radius(self, place: np.ndarray, k: int) -> float:
        gaps = np.partition(np.abs(self.values - place[:, None]), k - 1, axis=1)[:, k - 1]
        return float(np.median(gaps))

    def nearest(self, query: np.ndarray, k: int, known: np.ndarray):
        """Rows and distances of the ``k`` nearest vectors found (ties to the smaller
        first id); ``known`` are distances found elsewhere, which bound the radius."""
        size = len(self.vectors)
        place = query @ self.lines
        counts = np.zeros(size, dtype=np.int16)
        seen = np.zeros(size, dtype=bool)
        low = [int(np.searchsorted(v, p)) for v, p in zip(self.values, place)]
        high = list(low)
        rows, found = np.empty(0, dtype=np.int64), np.empty(0)
        bound = float(known[k - 1]) if len(known) >= k else np.inf
        radius = bound / GROWTH ** 2 if bound < np.inf else self.first_radius(
            place, min(k, size))
        while True:
            whole = True
            for i in range(PROJECTIONS):
                values, order = self.values[i], self.order[i]
                left = int(np.searchsorted(values, place[i] - radius, "left"))
                right = int(np.searchsorted(values, place[i] + radius, "right"))
                left, right = min(left, low[i]), max(right, high[i])
                counts[order[left:low[i]]] += 1
                counts[order[high[i]:right]] += 1
                low[i], high[i] = left, right
                whole = whole and left == 0 and right == size
            new = np.flatnonzero((counts >= THRESHOLD) & ~seen)
            if len(new):
                seen[new] = True
                rows = np.concatenate([rows, new])
                found = np.concatenate([found, self.distances(query, new)])
                best = np.lexsort((rows, found))[:k]
                rows, found = rows[best], found[best]
                together = np.sort(np.concatenate([known, found]))
                if len(together) >= k:
                    bound = min(bound, float(together[k - 1]))
            if whole or radius >= bound:
                return rows, found
            radius = min(max(radius * GROWTH, np.finfo(float).tiny), bound)


def _answers(vectors: pa.Table, queries: pa.Table, k: int) -> pa.Table:
    """One row per query of the block: the nearest classes of the slice."""
    asked, lists, scores = [], [], []
    if vectors.num_rows and queries.num_rows:
        dim = vectors.column("dim")[0].as_py()
        slice_ = SortedArrays(_matrix(vectors.column("vector"), dim),
                              vectors.column("class").to_numpy(),
                              vectors.column("first").to_numpy())
        known = queries.column("known").to_pylist()
        points = _matrix(queries.column("vector"), dim)
        for name, point, distances in zip(queries.column("class").to_pylist(), points, known):
            rows, found = slice_.nearest(point, k, np.sort(np.array(distances, dtype=float)))
            asked.append(name)
            lists.append(slice_.names[rows].tolist())
            scores.append(found.tolist())
    return pa.table({"query": pa.array(asked, pa.int64()),
                     "classes": pa.array(lists, pa.list_(pa.int64())),
                     "scores": pa.array(scores, pa.list_(pa.float64()))})


ANSWER = "query long, classes array<long>, scores array<double>"


def _meet(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    key = ("dim", "slice", "block")
    vectors = vectors.select(*(F.col(c).alias(c) for c in vectors.columns))  # both of one table
    return vectors.groupBy(*key).cogroup(queries.groupBy(*key)).applyInArrow(
        lambda left, right: _answers(left, right, k), ANSWER)


def _dealt(df: DataFrame, name: str, parts: int) -> DataFrame:
    return df.withColumn(name, F.pmod(F.xxhash64("class"), F.lit(parts)).cast("int"))


def _to_each(df: DataFrame, name: str, parts: int) -> DataFrame:
    return df.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))


def nearest(vectors: DataFrame, is_query: Column, k: int = 10,
            slice_size: int = SLICE, block_size: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest vectors found for each row of
    ``vectors`` (vec_id, embedding) that ``is_query`` holds for, by Euclidean distance in
    doubles, ties to the smaller vec_id; all others, if there are fewer.

    Rows with a NULL id, and vectors that are NULL, empty, zero, or hold a component that
    is NULL or not finite, take no part.  Only vectors of the query's length are
    candidates.  Rows equal in id and vector count once, and rows with the query's own id
    are not its neighbours; one id with two vectors is a candidate with both.  Other columns
    are ignored.  An empty table gives no row.
    """
    rows = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.col("embedding").cast("array<double>").alias("vector"),
        F.coalesce(is_query, F.lit(False)).alias("asked"),
    ).where(F.col("vec_id").isNotNull() & usable(F.col("vector")))
    known = stage(classes(rows, k + 1), "ann-classes")
    size, asked = known.agg(F.count("*"), F.count_if(F.col("asked"))).first()
    slices = max(1, -(-size // slice_size))
    points = _dealt(known.select("class", "dim", "vector", F.col("ids")[0].alias("first")),
                    "slice", slices)
    queries = known.where("asked").select("class", "dim", "vector")

    blocks = max(1, -(-asked // FIRST_BLOCK))
    start = stage(_meet(
        _to_each(points.where("slice = 0"), "block", blocks),
        _dealt(queries, "block", blocks).withColumn("slice", F.lit(0)).withColumn(
            "known", F.array().cast("array<double>")), k + 1), "ann-first")

    blocks = max(1, -(-asked // block_size))
    bounded = _dealt(queries.join(
        start.select(F.col("query").alias("class"), F.col("scores").alias("known")),
        "class", "left").withColumn("known", F.coalesce(
            "known", F.array().cast("array<double>"))), "block", blocks)
    rest = _meet(_to_each(points.where("slice > 0"), "block", blocks),
                 _to_each(bounded, "slice", slices).where("slice > 0"), k + 1)

    pairs = start.unionByName(rest).select(
        "query", F.inline(F.arrays_zip("classes", "scores")))
    named = pairs.join(known.select(F.col("class").alias("classes"), "ids"), "classes").select(
        "query", F.col("scores").alias("score"), F.explode("ids").alias("vec_id"))
    order = Window.partitionBy("query").orderBy("score", "vec_id")
    lists = (named.withColumn("place", F.row_number().over(order))
             .where(F.col("place") <= k + 1).groupBy(F.col("query").alias("class"))
             .agg(F.array_sort(F.collect_list(F.struct("place", "vec_id", "score")))
                  .alias("near")))
    asking = rows.where("asked").select("vec_id", "vector").distinct().join(
        known.where("asked").select("class", "vector"), "vector").select(
        F.col("vec_id").alias("query_id"), "class")
    others = F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    return (asking.join(lists, "class")
            .select("query_id", F.posexplode(others).alias("at", "hit"))
            .select("query_id", (F.col("at") + 1).cast("int").alias("rank"),
                    "hit.vec_id", "hit.score"))
