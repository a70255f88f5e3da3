"""Byte-level BPE: encode with a lexicon of frequent words, merge the rest, decode.

The words of all documents are counted; the ``LEXICON`` most frequent ones are merged
once and compiled into a minimal acyclic transducer (lexicon.py), which Spark hands to
every executor as a file and tasks map into memory.  Words outside it are merged exactly
by rank.  Which words are frequent changes the speed only, never a token.

Rows: NULL counts as the empty text, which has no tokens.  The strings of special tokens
in a text are those tokens, as the tokenizer file has it.  Long texts are cut where a
word must begin, so memory stays bounded; the ids are those of the whole text.
"""

from __future__ import annotations

import heapq
import json
import uuid
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from probatio.llm.common import fresh, put_file, stage
from probatio.llm.lexicon import Lexicon, compile_words

LEXICON = 131072
PIECE = 2_000_000  # characters encoded together
#: How this kind of tokenizer splits a text, and the bytes that stand for
#: themselves in its vocabulary; the others follow from code point 256 on.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]


def _byte_of() -> dict[str, int]:
    table = {chr(b): b for b in PLAIN}
    for n, b in enumerate(b for b in range(256) if b not in set(PLAIN)):
        table[chr(256 + n)] = b
    return table


class Tokenizer:
    """Vocabulary and merges of a tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        byte_of, vocab = _byte_of(), spec["model"]["vocab"]
        size = 1 + max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])])
        self.bytes = [b""] * size
        for token, number in vocab.items():
            self.bytes[number] = bytes(byte_of[c] for c in token)
        self.single = [0] * 256
        for char, byte in byte_of.items():
            self.single[byte] = vocab[char]
        self.ranks: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.ranks[vocab[left], vocab[right]] = rank, vocab[left + right]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for content, number in self.special.items():
            self.bytes[number] = content.encode()
        self.split = regex.compile(SPLIT)
        longest_first = sorted(self.special, key=len, reverse=True)
        self.special_split = regex.compile("(" + "|".join(map(regex.escape, longest_first)) + ")"
                                           ) if self.special else None

    def merge(self, word: bytes) -> list[int]:
        """Exact ids of one word: always the pair of least rank, leftmost first."""
        ids = [self.single[b] for b in word]
        ranks = self.ranks
        if len(ids) > 40:
            return self._merge_long(ids)
        while len(ids) > 1:
            best = place = new = None
            for i in range(len(ids) - 1):
                found = ranks.get((ids[i], ids[i + 1]))
                if found is not None and (best is None or found[0] < best):
                    best, new, place = found[0], found[1], i
            if best is None:
                break
            ids[place:place + 2] = [new]
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same with a heap and links, in n log n."""
        after = [*range(1, len(ids)), -1]
        before = list(range(-1, len(ids) - 1))
        heap: list[tuple[int, int, int, int, int]] = []

        def offer(i: int) -> None:
            j = after[i] if i >= 0 else -1
            if j >= 0 and (found := self.ranks.get((ids[i], ids[j]))) is not None:
                heapq.heappush(heap, (found[0], i, ids[i], ids[j], found[1]))

        for i in range(len(ids) - 1):
            offer(i)
        while heap:
            _, i, left, right, new = heapq.heappop(heap)
            j = after[i]
            if ids[i] != left or j < 0 or ids[j] != right:
                continue
            ids[i], ids[j] = new, -1
            after[i] = after[j]
            if after[i] >= 0:
                before[after[i]] = i
            offer(before[i])
            offer(i)
        return [i for i in ids if i >= 0]

    def words(self, text: str) -> Iterator[list[str | int]]:
        """The words of a text in order, special tokens as ids, some MB at a time."""
        parts = self.special_split.split(text) if self.special_split else [text]
        for part in parts:
            if part in self.special:
                yield [self.special[part]]
                continue
            begin = 0
            while begin < len(part):
                stop = _cut(part, begin + PIECE)
                yield self.split.findall(part, begin, stop)
                begin = stop


def _cut(text: str, at: int) -> int:
    """The first place from ``at`` on where a word must begin: a space between two others."""
    while at < len(text) - 1:
        at = text.find(" ", at)
        if at < 0 or at >= len(text) - 1:
            break
        if at and not text[at - 1].isspace() and not text[at + 1].isspace():
            return at
        at += 1
    return len(text)


@lru_cache(maxsize=2)
def tokenizer(path: str) -> Tokenizer:
    return Tokenizer(path)


@lru_cache(maxsize=2)
def _lexicon(name: str) -> Lexicon:
    return Lexicon.mapped(SparkFiles.get(name))


def encode(texts: Sequence[str | None], tok: Tokenizer, lexicon: Lexicon) -> list[bytes]:
    """Each text's ids as little-endian unsigned 32-bit integers."""
    result: list[list[np.ndarray]] = [[] for _ in texts]
    places: dict[str | int, int] = {}
    order: list[int] = []
    owners: list[tuple[int, int]] = []  # text, number of its words here

    def flush() -> None:
        unique = list(places)
        coded = [w.encode("utf-8", "surrogatepass") if isinstance(w, str) else b""
                 for w in unique]
        found = lexicon.places(coded)
        known = found >= 0
        begin = np.where(known, lexicon.starts[found], 0).astype(np.int64)
        length = np.where(known, lexicon.starts[np.minimum(found, len(lexicon.starts) - 2) + 1]
                          - lexicon.starts[found], 0).astype(np.int64)
        extra: list[int] = []
        base = len(lexicon.ids)
        for i in np.flatnonzero(~known).tolist():
            ids = tok.merge(coded[i]) if isinstance(unique[i], str) else [unique[i]]
            begin[i], length[i] = base + len(extra), len(ids)
            extra += ids
        pool = np.concatenate((lexicon.ids, np.array(extra, np.int32)))
        words = np.array(order, np.int64)
        sizes = length[words]
        ends = np.cumsum(sizes)
        flat = pool[np.arange(int(ends[-1]) if len(ends) else 0)
                    - np.repeat(ends - sizes, sizes) + np.repeat(begin[words], sizes)]
        cuts = np.cumsum([n for _, n in owners])
        stops = np.where(cuts > 0, ends[np.maximum(cuts, 1) - 1], 0) if len(ends) else cuts * 0
        start = 0
        for (text, _), stop in zip(owners, stops.tolist(), strict=True):
            result[text].append(flat[start:stop])
            start = stop
        places.clear()
        order.clear()
        owners.clear()

    size = 0
    for i, text in enumerate(texts):
        for words in tok.words(text or ""):
            order.extend([places.setdefault(w, len(places)) for w in words])
            owners.append((i, len(words)))
            size += len(words)
            if size > PIECE // 4:
                flush()
                size = 0
    flush()
    return [np.concatenate(parts).astype("<u4").tobytes() if parts else b""
            for parts in result]


def decode(ids: bytes, tok: Tokenizer) -> str:
    """The text of ids; bytes that are no UTF-8 become U+FFFD."""
    table = tok.bytes
    return b"".join([table[i] for i in np.frombuffer(ids, "<u4").tolist()]).decode(
        "utf-8", "replace")


def frequent_words(docs: DataFrame, size: int = LEXICON) -> list[str]:
    """At most ``size`` of the most frequent words over all texts, as many as a bound on
    their count allows (bounds are eighths of a power of two)."""
    words = docs.select(F.explode(F.regexp_extract_all(
        F.coalesce("text", F.lit("")), F.lit(f"((?U){SPLIT})"))).alias("word"))
    counted = stage(words.groupBy("word").agg(F.count("*").alias("n")).where("n > 1").select(
        "word", F.floor(8 * F.log2("n")).alias("grade")), "word-counts")
    grades = counted.groupBy("grade").agg(F.count("*").alias("n")).collect()  # under 512
    total, least = 0, 1 << 20
    for row in sorted(grades, key=lambda r: -r["grade"]):
        total += row["n"]
        if total > size:
            break
        least = row["grade"]
    return [r["word"] for r in counted.where(F.col("grade") >= least).select("word").collect()]


def distribute_lexicon(docs: DataFrame, path: str, size: int = LEXICON) -> str:
    """Compile the frequent words of ``docs`` and give the file, of bounded size, to all
    executors.  Returns its name there."""
    tok = tokenizer(path)
    words = sorted(w.encode() for w in frequent_words(docs, size) if w not in tok.special)
    data = compile_words(words, [tok.merge(w) for w in words])
    return put_file(docs.sparkSession, f"lexicon-{uuid.uuid4().hex}", data)


def encoder(name: str, path: str):
    """A Pandas UDF text -> ids (binary, little-endian unsigned 32-bit integers)."""
    @F.pandas_udf("binary")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(encode(list(texts), tokenizer(path), _lexicon(name)), dtype=object)

    return run


def decoder(path: str):
    """A Pandas UDF ids -> text."""
    @F.pandas_udf("string")
    def run(ids: pd.Series) -> pd.Series:
        return pd.Series([decode(i, tokenizer(path)) for i in ids], dtype=object)

    return run


def round_trip(name: str, path: str):
    """A Pandas UDF text -> struct<ids, decoded>: both ways in one task."""
    @F.pandas_udf("ids binary, decoded string")
    def run(texts: pd.Series) -> pd.DataFrame:
        tok = tokenizer(path)
        ids = encode(list(texts), tok, _lexicon(name))
        return pd.DataFrame({"ids": ids, "decoded": [decode(i, tok) for i in ids]})

    return run


def encode_documents(docs: DataFrame, path: str, size: int = LEXICON) -> DataFrame:
    """``docs`` with a last column ``coded``: ids and the text decoded from them."""
    name = distribute_lexicon(docs, path, size)
    return docs.withColumn(fresh(docs, "coded")[0], round_trip(name, path)(F.col("text")))


def token_digests(coded: Column) -> list[Column]:
    return [F.floor(F.octet_length(coded["ids"]) / 4).alias("n_tokens"),
            F.sha2(coded["ids"], 256).alias("ids_sha256"),
            F.sha2(coded["decoded"], 256).alias("decoded_sha256")]
