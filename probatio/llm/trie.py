"""Prefix trie of conversations, by ternary search trees over ranges of sorted sequences.

Turns are replaced by ids of an order-keeping dictionary (by SHA-256 of role and text), so
texts are read once and never shuffled.  Sequences of ids are sorted into range shards.
Each shard builds a ternary search tree, inserting the median of its sorted sequences first
and then the medians of both halves, which keeps every level balanced.  One walk with an
explicit stack lists the tree and a pass back over the list sums members, leaves and savings.

Since shards are ranges, only prefixes of the first and the last sequence of a shard can
reach into another one.  These open nodes are merged 64 neighbouring shards at a time, and
again, until one range is left; each round closes the nodes inside its range.

Limits: the turn ids of one conversation (8 bytes a turn) stand in one row.  A digest over
the members that end in one node reads their ids in order in one task, as a stream.
"""

from __future__ import annotations

import hashlib
import struct
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probatio.llm.common import join_entries, stage

SHARD = 20_000  # turns and conversations in a range shard, about
MERGED = 64  # neighbouring ranges that one merge closes
SHARED_TURNS = 9  # h is below this
NOTHING = hashlib.sha256(b"").hexdigest()


def turn_key(role, text):
    """SHA-256 of a turn: characters of the role, a colon, role and text."""
    return F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)


def sequences(conversations: DataFrame) -> DataFrame:
    """conv_id, path (ids of its turns in order), sizes (UTF-8 bytes of their texts)."""
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    turns = stage(conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn",
        F.unhex(turn_key(role, text)).alias("key"),
        F.octet_length(text).cast("long").alias("bytes")), "trie-turns")
    entries = turns.groupBy("key").agg(F.count("*").alias("n"), F.first("bytes").alias("bytes"))
    dictionary = stage(entries.repartitionByRange("key").sortWithinPartitions("key").select(
        "key", "n", "bytes", F.monotonically_increasing_id().alias("id")), "trie-dictionary")
    coded = join_entries(turns.select("conv_id", "turn", "key"), dictionary, "key", "n")
    ordered = F.array_sort(F.collect_list(F.struct("turn", "id", "bytes")))
    return coded.groupBy("conv_id").agg(ordered.alias("t")).select(
        "conv_id", F.transform("t", lambda x: x["id"]).alias("path"),
        F.transform("t", lambda x: x["bytes"]).alias("sizes"))


def rebuilt(own: DataFrame) -> DataFrame:
    """Each conversation c after the first h turns of c - c % 5 in place of its own."""
    shared = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % SHARED_TURNS).cast("int")
    heads = own.select(F.col("conv_id").alias("base"), *(
        F.slice(c, 1, SHARED_TURNS).alias(f"{c}_head") for c in ("path", "sizes")))
    joined = own.withColumn("base", F.col("conv_id") - F.col("conv_id") % 5).join(
        heads, "base", "left").withColumn("h", shared)
    none = F.array().cast("array<long>")
    return joined.select("conv_id", *(F.concat(
        F.coalesce(F.slice(f"{c}_head", F.lit(1), F.col("h")), none),
        F.slice(c, F.col("h") + 1, F.size(c))).alias(c) for c in ("path", "sizes")))


class TernaryTree:
    """Turn ids in nodes with smaller, equal and greater branches; node 0 is the root."""

    def __init__(self):
        self.turn, self.size, self.parent, self.depth = [0], [0], [-1], [0]
        self.low, self.equal, self.high = [-1], [-1], [-1]
        self.ends: list[list[int]] = [[]]

    def _node(self, turn: int, size: int, parent: int) -> int:
        for column, value in ((self.turn, turn), (self.size, size), (self.parent, parent),
                              (self.depth, self.depth[parent] + 1), (self.low, -1),
                              (self.equal, -1), (self.high, -1), (self.ends, [])):
            column.append(value)
        return len(self.turn) - 1

    def insert(self, path: list[int], sizes: list[int]) -> int:
        """The node of a sequence, made where it is missing."""
        parent = 0
        for turn, size in zip(path, sizes):
            links, at = self.equal, parent
            while links[at] >= 0:
                at = links[at]
                if turn == self.turn[at]:
                    break
                links = self.low if turn < self.turn[at] else self.high
            else:
                links[at] = made = self._node(turn, size, parent)
                at = made
            parent = at
        return parent

    def child(self, parent: int, turn: int) -> int:
        at = self.equal[parent]
        while self.turn[at] != turn:
            at = self.low[at] if turn < self.turn[at] else self.high[at]
        return at

    def listed(self) -> list[int]:
        """All nodes, every one after its parent."""
        found, stack = [], [0]
        while stack:
            at = stack.pop()
            found.append(at)
            stack += [n for n in (self.low[at], self.high[at], self.equal[at]) if n >= 0]
        return sorted(found, key=self.depth.__getitem__)


def _halves(count: int) -> Iterator[int]:
    """0 to count - 1, the median first, then the medians of both halves, and so on."""
    stack = [(0, count)]
    while stack:
        a, b = stack.pop()
        if a < b:
            middle = (a + b) // 2
            yield middle
            stack += [(middle + 1, b), (a, middle)]


def _digest(ids) -> str:
    return hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


#: ``kind`` is node (final), open (a node that may go on in other shards) or ends (a
#: piece of the members that end in an open node).  Of an open node n_children, n_leaves
#: and saved_tokens count its final children only.
ROWS = ("kind string, shard int, key binary, parent_key binary, conv_id long, depth long, "
        "parent_conv_id long, bytes long, n_convs long, n_children long, n_leaves long, "
        "saved_tokens long, ends string, first boolean, last boolean")
FIELDS = [f.split()[0] for f in ROWS.split(", ")]
TYPES = {"string": pa.string(), "int": pa.int32(), "binary": pa.binary(), "long": pa.int64(),
         "boolean": pa.bool_()}
ARROW = pa.schema([(f.split()[0], TYPES[f.split()[1]]) for f in ROWS.split(", ")])


def _shard(batches) -> Iterator[pa.RecordBatch]:
    """The trie of one range of sequences, which arrive sorted by path and conv_id."""
    convs, paths, sizes, shard = [], [], [], None
    for batch in batches:
        shard = batch.column("shard")[0].as_py() if batch.num_rows else shard
        convs += batch.column("conv_id").to_pylist()
        paths += batch.column("path").to_pylist()
        sizes += batch.column("sizes").to_pylist()
    if not convs:
        return
    starts = [i for i in range(len(paths)) if i == 0 or paths[i] != paths[i - 1]]
    tree = TernaryTree()
    for n in _halves(len(starts)):
        i = starts[n]
        stop = starts[n + 1] if n + 1 < len(starts) else len(paths)
        tree.ends[tree.insert(paths[i], sizes[i])] = convs[i:stop]

    open_keys = defaultdict(lambda: [b"", b"", False, False])  # node -> key, parent's, first, last
    for path, edge in ((paths[0], 2), (paths[-1], 3)):
        digest, key, at = hashlib.sha256(), b"", 0
        open_keys[0][edge] = True
        for turn in path:
            digest.update(struct.pack(">q", turn))
            at, above, key = tree.child(at, turn), key, digest.digest()
            open_keys[at][:2] = key, above
            open_keys[at][edge] = True

    listed = tree.listed()
    count = len(tree.turn)
    members, least = [0] * count, [None] * count
    children, leaves, saved = [0] * count, [0] * count, [0] * count
    for at in reversed(listed):
        here = tree.ends[at]
        members[at] += len(here)
        if here:
            least[at] = here[0] if least[at] is None else min(least[at], here[0])
        up = tree.parent[at]
        if at not in open_keys:
            leaves[at] = leaves[at] or 1
            saved[at] += (members[at] - 1) * tree.size[at]
            children[up] += 1
            leaves[up] += leaves[at]
            saved[up] += saved[at]
        if up >= 0:
            members[up] += members[at]
            least[up] = least[at] if least[up] is None else min(least[up], least[at])

    rows = []
    for at in listed:
        up = tree.parent[at]
        row = dict.fromkeys(FIELDS)
        row |= {"shard": shard, "conv_id": least[at], "depth": tree.depth[at],
                "bytes": tree.size[at], "n_convs": members[at], "n_children": children[at],
                "n_leaves": leaves[at], "saved_tokens": saved[at]}
        if at in open_keys:
            key, above, first, last = open_keys[at]
            row |= {"kind": "open", "key": key, "parent_key": above if up >= 0 else None,
                    "first": first, "last": last}
            if tree.ends[at]:
                rows.append(dict.fromkeys(FIELDS) | {
                    "kind": "ends", "shard": shard, "key": key,
                    "ends": ",".join(map(str, tree.ends[at]))})
        else:
            row |= {"kind": "node", "ends": _digest(tree.ends[at])}
            if up in open_keys:
                row["parent_key"] = open_keys[up][0]
            else:
                row["parent_conv_id"] = least[up]
        rows.append(row)
    for i in range(0, len(rows), 10_000):
        yield pa.RecordBatch.from_pylist(rows[i:i + 10_000], schema=ARROW)


def _merge_all(table: pa.Table) -> pa.Table:
    return _merge(table, all_of_it=True)


def _merge(table: pa.Table, *, all_of_it: bool = False) -> pa.Table:
    """Open nodes of neighbouring ranges become those of one range, or final ones."""
    rows = sorted(table.select(FIELDS).to_pylist(), key=lambda r: r["shard"])
    if not rows:
        return ARROW.empty_table()
    ends = {True: rows[0]["shard"], False: rows[-1]["shard"]}
    nodes: dict[bytes, dict] = {}
    for row in rows:
        row["first"] = row["first"] and row["shard"] == ends[True]
        row["last"] = row["last"] and row["shard"] == ends[False]
        node = nodes.get(row["key"])
        if node is None:
            nodes[row["key"]] = row
            continue
        for name in ("n_convs", "n_children", "n_leaves", "saved_tokens"):
            node[name] += row[name]
        node["conv_id"] = min(node["conv_id"], row["conv_id"])
        node["first"] = node["first"] or row["first"]
        node["last"] = node["last"] or row["last"]
    for node in sorted(nodes.values(), key=lambda r: -r["depth"]):
        node["shard"] = rows[0]["shard"] // MERGED
        if all_of_it or not (node["first"] or node["last"]):
            node["kind"] = "node"
            node["n_leaves"] = node["n_leaves"] or 1
            node["saved_tokens"] += (node["n_convs"] - 1) * node["bytes"]
            if node["parent_key"] is not None:
                above = nodes[node["parent_key"]]
                above["n_children"] += 1
                above["n_leaves"] += node["n_leaves"]
                above["saved_tokens"] += node["saved_tokens"]
    return pa.Table.from_pylist(list(nodes.values()), schema=ARROW)


def _end_digests(batches) -> Iterator[pa.RecordBatch]:
    """Digest of the pieces of each key; they arrive sorted by key and shard."""
    key = digest = None
    for batch in batches:
        done = []
        for at, piece in zip(batch.column("key").to_pylist(), batch.column("ends").to_pylist()):
            if at == key and digest is not None:
                digest.update(b",")
            else:
                if digest is not None:
                    done.append((key, digest.hexdigest()))
                key, digest = at, hashlib.sha256()
            digest.update(piece.encode())
        yield pa.RecordBatch.from_arrays(
            [pa.array([k for k, _ in done], pa.binary()), pa.array([d for _, d in done],
                                                                  pa.string())],
            names=["key", "digest"])
    if digest is not None:
        yield pa.RecordBatch.from_arrays(
            [pa.array([key], pa.binary()), pa.array([digest.hexdigest()])],
            names=["key", "digest"])


def prefix_trie(paths: DataFrame, shard_size: int = SHARD) -> DataFrame:
    """One row per node of the trie of ``paths`` (conv_id, path, sizes; conv_id unique):
    conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256.  An empty path ends in the root; without rows there is no root."""
    paths = stage(paths, "trie-paths")
    total = paths.agg(F.coalesce(F.sum(F.size("path") + 1), F.lit(0))).first()[0]
    shards = max(1, -(-total // shard_size))
    ranged = paths.repartitionByRange(shards, "path", "conv_id").sortWithinPartitions(
        "path", "conv_id").withColumn("shard", F.spark_partition_id())
    found = stage(ranged.mapInArrow(_shard, ROWS), "trie-shards", "kind")

    opened = found.where("kind = 'open'")
    closed, ranges = [], shards
    level = opened
    while True:
        ranges = -(-ranges // MERGED)
        merged = stage(level.groupBy(F.expr(f"shard div {MERGED}")).applyInArrow(
            _merge_all if ranges == 1 else _merge, ROWS), "trie-merged", "kind")
        closed.append(merged.where("kind = 'node'"))
        if ranges == 1:
            break
        level = merged.where("kind = 'open'")
    skeleton = closed[0]
    for more in closed[1:]:
        skeleton = skeleton.unionByName(more)
    pieces = found.where("kind = 'ends'").select("key", "shard", "ends")
    digests = pieces.repartition("key").sortWithinPartitions("key", "shard").select(
        "key", "ends").mapInArrow(_end_digests, "key binary, digest string")

    names = skeleton.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("above"))
    own = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves",
           "saved_tokens")
    joints = skeleton.drop("parent_conv_id").join(names, "parent_key", "left").withColumnRenamed(
        "above", "parent_conv_id").join(digests, "key", "left").select(
        *own, F.coalesce("digest", F.lit(NOTHING)).alias("ends_sha256"))
    # each shard looks its own open nodes up, so the many children of the root stay spread
    known = opened.select("shard", F.col("key").alias("parent_key")).join(names, "parent_key")
    inner = found.where("kind = 'node'").join(known, ["shard", "parent_key"], "left").withColumn(
        "parent_conv_id", F.coalesce("parent_conv_id", "above")).select(
        *own, F.col("ends").alias("ends_sha256"))
    return inner.unionByName(joints)


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """The trie of all rebuilt conversations (see ``rebuilt`` and ``prefix_trie``).

    Rows (conv_id, turn, role, text; other columns are ignored) are ordered by turn, NULL
    first, rows of one turn by ``turn_key``.  A NULL role or text is empty, and equal rows
    are turns each.  Rows without conv_id take no part.  Without rows nothing comes out.
    """
    return prefix_trie(rebuilt(sequences(conversations)))
