"""From raw documents to token ids in stages; each works on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from probatio.llm import bagminhash, bpe, exact, langid, mixing
from probatio.llm.common import stage, table
from probatio.llm.queries import WEIGHT_CYCLE, byte_bpe_path


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is in a learnt language; learnt from the labelled ones of them."""
    labelled = docs.where(~langid.held_out() & F.col("lang").isNotNull())
    return langid.understood(docs, labelled)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal but for the case of A-Z, the one with the largest doc_id."""
    return exact.without_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates, the one with the largest doc_id."""
    return bagminhash.without_near_duplicates(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """150% of all words by the sources' weights; every document once at least, no more than
    twice, so the mix repeats documents and loses none."""
    return mixing.mixed_documents(docs, WEIGHT_CYCLE, share=1.5, least=1, most=2)


def bpe_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids (binary, little-endian unsigned 32-bit integers) and digests; ``lossless``
    says whether the ids decode to the text."""
    rows = docs.select("doc_id", "source", "text")
    coded = F.col("coded")
    return bpe.encode_documents(rows, byte_bpe_path()).select(
        "doc_id", "source", coded["ids"].alias("ids"), *bpe.token_digests(coded),
        (coded["decoded"] == F.coalesce("text", F.lit(""))).alias("lossless"))


STAGES = [
    ("language_id", language_id), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup),
    ("source_mix", source_mix), ("bpe_tokens", bpe_tokens),
]
#: Language models, signatures and tokens are no SQL; tests/llm/test_pipeline.py has a
#: brute-force version of every stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``, writing and rereading each result."""
    docs = table(spark, sf_dir, "documents")
    for name, apply in STAGES[:-1]:
        docs = stage(apply(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
