"""Plain Python versions of the operators' rules, for small tables."""

from __future__ import annotations

import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return WORD.findall(text or "")


def lower_ascii(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def shingles(text):
    w = [lower_ascii(x) for x in words(text)]
    if not w:
        return Counter()
    return Counter(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4)))


def jaccard(a, b):
    common = sum((a & b).values())
    union = sum(a.values()) + sum(b.values()) - common
    return common / union if union else 0.0


def near_classes(rows, threshold=0.8):
    """doc_id -> largest doc_id of its class, by comparing all pairs."""
    bags = {i: shingles(t) for i, t in rows}
    parent = {i: i for i in bags}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(bags)
    for n, a in enumerate(ids):
        for b in ids[n + 1:]:
            if bags[a] and bags[b] and jaccard(bags[a], bags[b]) >= threshold:
                x, y = sorted((root(a), root(b)))
                parent[x] = y
    return {i: root(i) for i in ids}


#: NULLs, empty and white texts, ties, repeated rows, a long text.
AWKWARD = [
    (1, None, None, None, None), (2, "", "en", "b", 0), (3, " \n\t ", "fr", "a", 4),
    (4, "one two three four five six", "en", None, 1),
    (5, "One two three four five six", "en", "a", 1),
    (6, "one two three four five six", None, "a", 1),
    (6, "one two three four five six", None, "a", 1),
    (7, "éa ÉA " * 40, "fr", "", 5), (8, "x" * 30000, "en", "b", 1),
    (9, "word " * 20000, "en", "b", 1), (None, "no id at all", "en", "a", 1),
    (10, "1 2 3\n1 2 3\n\n1 2 4", "de", "c", 1), (11, "</s>~0[INST]<|endoftext|>", "de", "c", 1),
]
#: Columns that operators might use for themselves.
EXTRA = ("key", "row", "name", "n", "class", "digest", "bands", "found", "coded", "counted",
         "counts", "start", "bucket", "ordinal", "kept_id", "own_sha", "copies", "own_id",
         "places", "level", "size", "dropped")


def awkward(spark):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame(AWKWARD, SCHEMA)
    return docs.select("*", *(F.lit("extra").alias(c) for c in EXTRA))
