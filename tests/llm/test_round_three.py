"""Nearest vectors, conversation trie and ranked search against plain versions."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from probatio.llm import ann, search, trie
from probatio.llm.common import join_entries, table

import llm_helpers as h
from llm_helpers import SF

# 11 nearest vectors

VECTORS = "vec_id long, embedding array<float>"
NAN, INF = float("nan"), float("inf")


def exact(rows, asked, k):
    """query -> [(distance, id)] by comparing with every row."""
    fine = {(i, tuple(v)) for i, v in rows
            if i is not None and v and all(x is not None and math.isfinite(x) for x in v)
            and any(v)}
    found = {}
    for q, v in fine:
        if asked(q):
            near = sorted(((sum((a - b) ** 2 for a, b in zip(v, w)) ** 0.5, i)
                           for i, w in fine if i != q and len(w) == len(v)))
            found[q] = near[:k]
    return found


def answers(df):
    got = defaultdict(dict)
    for r in df.collect():
        assert r["rank"] not in got[r["query_id"]]
        got[r["query_id"]][r["rank"]] = (r["score"], r["vec_id"])
    for ranks in got.values():
        assert sorted(ranks) == list(range(1, len(ranks) + 1))
    return {q: [ranks[n] for n in sorted(ranks)] for q, ranks in got.items()}


def test_recall_on_the_table(spark):
    vectors = table(spark, SF, "embeddings")
    rows = [(r["vec_id"], r["embedding"]) for r in vectors.collect()]
    wanted = exact(rows, lambda q: q % 20 == 0, 10)
    got = answers(ann.nearest(vectors, F.col("vec_id") % 20 == 0, slice_size=120, block_size=7))
    assert got.keys() == wanted.keys()
    hits = sum(len({i for _, i in got[q]} & {i for _, i in wanted[q]}) for q in wanted)
    assert hits >= 0.95 * sum(map(len, wanted.values()))
    assert all(len(near) == 10 and near == sorted(near) for near in got.values())


def test_vectors_that_take_no_part(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, None), (4, [0.0, 0.0]), (5, [1.0, None]),
            (6, [NAN, 1.0]), (7, [INF, 1.0]), (8, []), (None, [1.0, 1.0]), (9, [1.0, 0.0, 0.0]),
            (10, [1.0, 0.0]), (10, [1.0, 0.0]), (11, [3.0, 0.0])]
    df = spark.createDataFrame(rows, VECTORS).select(
        "*", *(F.lit("x").alias(c) for c in ("class", "vector", "dim", "slice", "query", "asked")))
    got = answers(ann.nearest(df, F.col("vec_id") < 100, k=3))
    assert got == {q: n for q, n in exact(rows, lambda q: True, 3).items() if n}
    assert 9 not in got  # alone in its dimension
    assert ann.nearest(df.limit(0), F.col("vec_id") < 100).count() == 0


def test_frequent_vector_and_ties(spark):
    rows = [(i, [1.0, 2.0, 3.0, 4.0]) for i in range(400)]
    rows += [(1000 + i, [1.0, 2.0, 3.0, 4.0 + i % 7]) for i in range(300)]
    got = answers(ann.nearest(spark.createDataFrame(rows, VECTORS), F.col("vec_id") % 50 == 0,
                              slice_size=3))
    wanted = exact(rows, lambda q: q % 50 == 0, 10)
    assert got == wanted


def test_windows_grow_to_the_whole_slice():
    rng = np.random.default_rng(2)
    vectors = rng.standard_normal((30, 8))
    arrays = ann.SortedArrays(vectors, np.arange(30), np.arange(30))
    rows, found = arrays.nearest(vectors[3], 30, np.empty(0))
    assert sorted(arrays.names[rows]) == list(range(30)) and found[0] == 0.0


# 12 conversation trie

TURNS = "conv_id long, turn long, role string, text string"


def plain_trie(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            key = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()
            own[conv].append(((turn is not None, turn or 0, key), (role, text)))
    own = {c: [t for _, t in sorted(turns)] for c, turns in own.items()}
    full = {}
    for c, turns in own.items():
        step = zlib.crc32(str(c).encode()) % 9
        full[c] = own.get(c - int(math.fmod(c, 5)), [])[:step] + turns[step:]
    members = defaultdict(list)
    for c, path in full.items():
        for d in range(len(path) + 1):
            members[tuple(path[:d])].append(c)
    out = set()
    for node, convs in members.items():
        below = [n for n in members if n[:len(node)] == node]
        leaf = [n for n in below if not any(m[:len(n)] == n and len(m) == len(n) + 1
                                            for m in below)]
        ends = sorted(c for c in convs if len(full[c]) == len(node))
        out.add((min(convs), len(node), min(members[node[:-1]]) if node else None, len(convs),
                 sum(len(n) == len(node) + 1 for n in below), len(leaf),
                 sum((len(members[n]) - 1) * len(n[-1][1].encode()) for n in below if n),
                 hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return out


NODE = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves",
        "saved_tokens", "ends_sha256")


def nodes(df):
    rows = [tuple(r[c] for c in NODE) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def awkward_turns():
    rows = [(1, None, "user", "é"), (1, 0, None, None), (1, 0, "a", "b"), (1, 0, "a", "b"),
            (0, 0, "user", "same"), (0, 1, "assistant", "x" * 50_000), (None, 0, "user", "no id"),
            (-3, 0, "user", "minus"), (-7, 0, "user", "</s>[INST] ok [/INST]")]
    rows += [(2, n, "user", f"deep {n % 3}") for n in range(60)]
    rows += [(c, n, "user", f"t{c % 3 if n > 2 else n}") for c in range(10, 60)
             for n in range(c % 9)]
    return rows


def test_trie_against_all_prefixes(spark):
    rows = awkward_turns()
    df = spark.createDataFrame(rows, TURNS).select("*", *(F.lit("x").alias(c) for c in (
        "path", "sizes", "key", "id", "shard", "kind", "h", "base", "n")))
    assert nodes(trie.conversation_trie(df)) == plain_trie(rows)
    assert trie.conversation_trie(df.limit(0)).count() == 0


@pytest.mark.parametrize("shard_size", [3, 17])
def test_trie_over_many_shards(spark, monkeypatch, shard_size):
    """Nodes open in many shards, merged in several rounds; a third of all conversations equal."""
    monkeypatch.setattr(trie, "MERGED", 3)
    rows = awkward_turns() + [(1000 + 9 * c, n, "user", "hot") for c in range(40)
                              for n in range(2)]
    paths = trie.rebuilt(trie.sequences(spark.createDataFrame(rows, TURNS)))
    assert nodes(trie.prefix_trie(paths, shard_size=shard_size)) == plain_trie(rows)


def test_median_insertion_keeps_levels_balanced():
    assert sorted(trie._halves(1000)) == list(range(1000))
    tree = trie.TernaryTree()
    for n in trie._halves(1000):
        tree.insert([n], [1])
    deepest, stack = 0, [(tree.equal[0], 1)]
    while stack:
        at, level = stack.pop()
        deepest = max(deepest, level)
        stack += [(n, level + 1) for n in (tree.low[at], tree.high[at]) if n >= 0]
    assert deepest == 10


def test_join_entries_keeps_every_row(spark):
    rows = spark.range(5000).select(F.when(F.col("id") < 3000, 0).otherwise(
        F.col("id")).alias("key"), "id")
    entries = rows.groupBy("key").agg(F.count("*").alias("n"), F.max("id").alias("top"))
    joined = join_entries(rows, entries, "key", "n")
    assert joined.count() == 5000 and joined.where("top < id").count() == 0


# 13 ranked search

DOCS = "doc_id long, text string"
TERM = re.compile(search.TERM)


def terms(text):
    return TERM.findall(h.lower_ascii(text or ""))


def plain_rank(docs, items, k=10):
    bags = [(i, Counter(terms(t))) for i, t in docs]
    bags = [(i, b) for i, b in bags if b]
    count, length = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    found = []
    wanted = defaultdict(Counter)
    for item, text in set(items):
        wanted[item] += Counter(terms(text))
    for item, bag in wanted.items():
        scored = []
        for row, (doc, held) in enumerate(bags):
            m = 100 - 75 + (75 * sum(held.values()) * count) // length
            score = sum(n * math.floor(1000 * math.log((2 * count + 2) / (2 * df[t] + 1)))
                        * ((1_000_000_000 * held[t]) // (1000 * held[t] + 8 * m))
                        for t, n in bag.items() if t in held)
            if score:
                scored.append((-score, doc is None, doc or 0, row))
        found += [(item, n, None if missing else doc, -score) for n, (score, missing, doc, _)
                  in enumerate(sorted(scored)[:k], 1)]
    return sorted(found, key=str)


def ranked(df):
    return sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in df.collect()),
                  key=str)


def test_ranking_on_awkward_rows(spark):
    docs = [(i, t) for i, t, *_ in h.AWKWARD] + [(20 + n, "tie of words") for n in range(15)]
    items = [(1, "One two, words!"), (2, None), (3, ""), (4, "éa word word"), (4, "tie"),
             (5, "x" * 30000), (1, "One two, words!"), (None, "id at all"), (6, "unseen")]
    frame = spark.createDataFrame(docs, DOCS).select("*", *(F.lit(1).alias(c) for c in (
        "row", "n", "terms", "counts", "slice", "item", "term", "bundle")))
    asked = spark.createDataFrame(items, "item_id long, text string")
    wanted = plain_rank(docs, items)
    assert ranked(search.rank_documents(frame, asked)) == wanted
    assert ranked(search.rank_documents(frame, asked, slice_size=4, bundle_size=2)) == wanted
    assert search.rank_documents(frame.limit(0), asked).count() == 0
    assert search.rank_documents(frame, asked.limit(0)).count() == 0


def test_ranking_on_the_tables_in_many_slices(spark):
    docs = [(r["doc_id"], r["text"]) for r in table(spark, SF, "documents").collect()]
    items = [(r["item_id"], r["text"]) for r in table(spark, SF, "benchmark").collect()]
    found = search.rank_documents(table(spark, SF, "documents"), table(spark, SF, "benchmark"),
                                  k=3, slice_size=20, bundle_size=11)
    assert ranked(found) == plain_rank(docs, items, 3)


def test_filter_lets_every_wanted_term_pass(spark):
    wanted = spark.createDataFrame([("ab",), ("é9",), ("x",)], "term string")
    bits = search.term_filter(wanted)
    assert len(bits) * 8 == 1 << search.FILTER_BITS
    for term in ("ab", "é9", "x"):
        at = zlib.crc32(term.encode()) & ((1 << search.FILTER_BITS) - 1)
        assert bits[at >> 3] >> (at & 7) & 1
