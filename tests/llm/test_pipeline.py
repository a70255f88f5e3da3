"""Every stage of the pipeline against a plain version of its rule, on its own input."""

from collections import Counter

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from probatio.llm.common import stage, table

import llm_helpers as h
from llm_helpers import SF


def test_stages(spark):
    from tokenizers import Tokenizer

    docs = table(spark, SF, "documents")
    before = {r["doc_id"]: r for r in docs.collect()}
    steps = dict(pipeline.STAGES)
    kept = stage(steps["language_id"](spark, docs, SF), "t1")
    assert kept.columns == docs.columns
    first = {r["doc_id"]: r for r in kept.collect()}
    assert all(any(c.isalpha() for c in r["text"]) for r in first.values())
    assert len(first) >= 0.97 * len(before)

    exact = stage(steps["exact_dedup"](spark, kept, SF), "t2")
    largest = {}
    for i, r in first.items():
        text = h.lower_ascii(r["text"])
        largest[text] = max(largest.get(text, i), i)
    second = {r["doc_id"]: r for r in exact.collect()}
    assert exact.columns == docs.columns and set(second) == set(largest.values())

    near = stage(steps["near_dedup"](spark, exact, SF), "t3")
    third = {r["doc_id"]: r for r in near.collect()}
    classes = h.near_classes([(i, r["text"]) for i, r in second.items()])
    assert near.columns == docs.columns and set(third) == set(classes.values())

    mixed = stage(steps["source_mix"](spark, near, SF), "t4")
    rows = mixed.collect()
    copies = Counter(r["doc_id"] for r in rows)
    assert mixed.columns == docs.columns and set(copies) == {
        i for i, r in third.items() if h.words(r["text"])}
    assert max(copies.values()) <= 2
    taken = sum(len(h.words(r["text"])) for r in rows)
    total = sum(len(h.words(r["text"])) for r in third.values())
    slack = sum(max(len(h.words(r["text"])) for r in third.values() if r["source"] == s)
                for s in {r["source"] for r in third.values()})
    assert abs(taken - 1.5 * total) <= slack

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokens = steps["bpe_tokens"](spark, mixed, SF).collect()
    assert len(tokens) == len(rows)
    for r in tokens:
        wanted = library.encode(before[r["doc_id"]]["text"], add_special_tokens=False).ids
        assert np.frombuffer(r["ids"], "<u4").tolist() == wanted
        assert r["n_tokens"] == len(wanted) and r["lossless"]


def test_awkward_rows_pass_every_stage(spark):
    docs = h.awkward(spark)
    for name, apply in pipeline.STAGES[:-1]:
        result = stage(apply(spark, docs, SF), f"a-{name}")
        assert result.columns == docs.columns
        docs = result
    last = pipeline.STAGES[-1][1](spark, docs, SF)
    assert last.count() == docs.count() > 0
    empty = h.awkward(spark).where(F.lit(False))
    for _, apply in pipeline.STAGES:
        assert apply(spark, empty, SF).count() == 0
