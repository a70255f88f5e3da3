"""Language identification with a bit-sliced Bloom filter of character n-grams.

Each slot of the filter holds one bit per language, in words of 64.  An n-gram is hashed to three slots,
and the AND of the three masks gives all languages whose filter contains it.  A text's
n-grams are counted per language by these masks; the share a language would reach by false
positives alone, known from how full its slice is, is taken out; the language with the
largest corrected count wins.

The filter is learnt from a bounded sample of labelled documents (``SAMPLE`` per
language, whole texts): an n-gram enters the slice of a language if its frequency there
is at least a third of its largest frequency in any language.  The filter has a fixed size, whatever the corpus.

Rows: a text that is NULL or has no letter is ``und`` with score 0.  Upper and lower case
are the same, runs of other characters than letters are one boundary.  Nothing but the
text is an input of a prediction.  With no labelled row every text is ``und``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from probatio.llm.common import fresh, order_key, stage
from probatio.llm.shingles import GOLDEN, U64, mix

SAMPLE = 2000  # labelled documents per language, in a fixed pseudo-random order
SHARE = 1 / 3
SIZES = (1, 2, 3, 4)
SLOT_BITS = 22
PROBES = 3
WORD_BITS = 64  # languages of one mask word of a slot
CHUNK = 1_000_000  # characters looked at together
UNKNOWN = "und"
COVERAGE = 0.5  # share of n-grams that a text's language must hold to be taken as that language

_letters: np.ndarray | None = None


def _letter_table() -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _letters


def ngrams(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(hash, place of the text) of all n-grams, for runs of texts at a time.

    Long runs are cut with an overlap of the longest n-gram, so none is lost.
    """
    letters = _letter_table()
    for begin, run in _runs(texts):
        codes = np.frombuffer("".join(f"{t}\n" for t in run).encode(
            "utf-32-le", "surrogatepass"), np.uint32)
        owner = np.repeat(np.arange(begin, begin + len(run)), [len(t) + 1 for t in run])
        inside = letters[codes]
        # a boundary stays where a run of other characters follows a letter
        keep = inside | np.append(True, inside[:-1])
        keep |= np.append(True, owner[1:] != owner[:-1])
        codes = np.where(inside, codes, 0)[keep].astype(U64)
        owner = owner[keep]
        for cut in range(0, len(codes), CHUNK):
            part = codes[cut:cut + CHUNK + max(SIZES) - 1]
            held = owner[cut:cut + CHUNK + max(SIZES) - 1]
            for size in SIZES:
                count = min(CHUNK, len(part) - size + 1)
                if count <= 0:
                    continue
                total = np.full(count, U64(size))
                for k in range(size):
                    total = mix(total * GOLDEN + part[k:k + count])
                same = held[:count] == held[size - 1:size - 1 + count]
                if size == 1:
                    same = same & (part[:count] != 0)
                yield total[same], held[:count][same]


def _runs(texts: list[str | None]) -> Iterator[tuple[int, list[str]]]:
    run, begin, size = [], 0, 0
    for place, text in enumerate(texts):
        low = (text or "").lower()
        if run and size + len(low) > CHUNK:
            yield begin, run
            run, begin, size = [], place, 0
        run.append(low)
        size += len(low)
    if run:
        yield begin, run


def _slots(grams: np.ndarray) -> list[np.ndarray]:
    step = mix(grams ^ GOLDEN) | U64(1)
    return [((grams + U64(k) * step) >> U64(64 - SLOT_BITS)).astype(np.int64)
            for k in range(PROBES)]


def _count_documents(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        langs = batch["lang"].to_numpy()
        codes, names = pd.factorize(langs)
        for grams, owner in ngrams(list(batch["text"])):
            pairs = pd.DataFrame({"gram": grams.view(np.int64), "owner": owner}).drop_duplicates()
            pairs["lang"] = codes[pairs["owner"]]
            found = pairs.groupby(["gram", "lang"]).size().reset_index(name="n")
            found["lang"] = names[found["lang"]]
            yield found[["gram", "lang", "n"]]


class Model:
    """Languages, the masks of each slot, and each language's rate of false positives.

    A slot has one mask word for every ``WORD_BITS`` languages.
    """

    def __init__(self, languages: list[str], slots: np.ndarray, words: np.ndarray,
                 masks: np.ndarray):
        self.languages = languages
        self.filters, chances = [], []
        for first in range(0, len(languages), WORD_BITS):
            count = min(WORD_BITS, len(languages) - first)
            width = next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64)
                         if count <= np.dtype(t).itemsize * 8)
            mine = words == first // WORD_BITS
            filled = np.zeros(1 << SLOT_BITS, width)
            filled[slots[mine]] = masks[mine].astype(np.uint64).astype(width)
            self.filters.append((filled, width, first, count))
            chances += [((filled >> width(k)) & width(1)).mean() for k in range(count)]
        self.chance = np.array(chances) ** PROBES

    def rates(self, texts: list[str | None]) -> np.ndarray:
        """[texts, languages] corrected shares of n-grams found."""
        hits = np.zeros((len(texts), len(self.languages)))
        total = np.zeros(len(texts))
        for grams, owner in ngrams(texts):
            places = _slots(grams)
            total += np.bincount(owner, minlength=len(texts))
            for filled, width, first, count in self.filters:
                one, two, three = (filled[s] for s in places)
                mask = one & two & three
                for k in range(count):
                    has = ((mask >> width(k)) & width(1)).astype(bool)
                    hits[:, first + k] += np.bincount(owner[has], minlength=len(texts))
        found = hits / np.maximum(total, 1)[:, None]
        return np.clip((found - self.chance) / (1 - self.chance), 0, 1)

    def predict(self, texts: list[str | None]) -> pd.DataFrame:
        rates = self.rates(texts)
        has_letter = np.array([any(c.isalpha() for c in t) if t else False for t in texts], bool)
        if not self.languages:
            return pd.DataFrame({"lang_pred": [UNKNOWN] * len(texts), "score": 0.0,
                                 "coverage": 0.0})
        best = rates.argmax(axis=1)
        top = rates.max(axis=1)
        others = rates.sum(axis=1)
        score = np.where(has_letter & (others > 0), top / np.maximum(others, 1e-12), 0.0)
        names = np.array(self.languages, object)[best]
        return pd.DataFrame({"lang_pred": np.where(has_letter, names, UNKNOWN),
                             "score": score, "coverage": np.where(has_letter, top, 0.0)})


def training_sample(labelled: DataFrame, per_language: int = SAMPLE) -> DataFrame:
    """(text, lang) of at most ``per_language`` documents of each language.

    Only documents in the first part of the pseudo-random order, twice the sample on
    average, are ranked, so a language with a third of all rows is no large window.
    """
    labelled = labelled.select("doc_id", "text", "lang")
    ids = labelled.where("lang is not null").select("doc_id", "lang", order_key().alias("k"))
    sizes = ids.groupBy("lang").agg(F.count("*").alias("n"))
    part = F.conv(F.substring("k", 1, 8), 16, 10).cast("double") / 2**32
    early = ids.join(F.broadcast(sizes), "lang").where(  # one row per language
        part * F.col("n") < 2 * per_language)
    place = F.row_number().over(Window.partitionBy("lang").orderBy("k", "doc_id"))
    chosen = early.withColumn("place", place).where(F.col("place") <= per_language).select(
        F.col("doc_id").alias("chosen_id"), F.col("lang").alias("chosen_lang")).distinct()
    # at most per_language ids for each language
    return labelled.join(F.broadcast(chosen), F.col("doc_id").eqNullSafe(F.col("chosen_id"))
                         & (F.col("lang") == F.col("chosen_lang"))).select("text", "lang")


def fit(labelled: DataFrame) -> Model:
    """Learn from ``labelled`` (doc_id, text, lang)."""
    names = [r["lang"] for r in labelled.where("lang is not null").select("lang").distinct()
             .orderBy("lang").collect()]  # one row per language
    sample = stage(training_sample(labelled), "language-sample")
    documents = sample.groupBy("lang").agg(F.count("*").alias("documents"))
    counts = sample.mapInPandas(_count_documents, "gram long, lang string, n long").groupBy(
        "gram", "lang").agg(F.sum("n").alias("n"))
    bit = F.create_map(*(x for k, name in enumerate(names)
                         for x in (F.lit(name), F.lit(k)))) if names else None
    if not names:
        return Model([], *(np.zeros(0, np.int64),) * 3)
    rated = counts.join(F.broadcast(documents), "lang").select(  # one row per language
        "gram", F.element_at(bit, F.col("lang")).alias("bit"),
        (F.col("n") / F.col("documents")).alias("rate"))
    kept = rated.groupBy("gram").agg(
        F.max("rate").alias("top"), F.collect_list(F.struct("bit", "rate")).alias("each"))
    words = -(-len(names) // WORD_BITS)

    def mask(word: int) -> Column:
        mine = F.filter("each", lambda e: (F.floor(e["bit"] / WORD_BITS) == word)
                        & (e["rate"] >= F.col("top") * SHARE))
        return F.aggregate(mine, F.lit(0).cast("long"), lambda m, e: m.bitwiseOR(
            _shift((e["bit"] % WORD_BITS).cast("int"))))

    masks = kept.select("gram", F.array(*map(mask, range(words))).alias("masks"))
    slots = masks.mapInPandas(_to_slots, "slot long, word int, mask long").groupBy(
        "slot", "word").agg(F.bit_or("mask").alias("mask"))
    found = slots.toPandas()  # at most one row per slot and mask word of the filter
    return Model(names, *(found[c].to_numpy(np.int64) for c in ("slot", "word", "mask")))


def _shift(bit: Column) -> Column:
    """2 to the power of ``bit``, from a table since the shift built-in takes a literal."""
    return F.element_at(F.array(*(F.lit((1 << k) - (1 << 64 if k == 63 else 0)).cast("long")
                                  for k in range(WORD_BITS))), bit + 1)


def _to_slots(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        grams = batch["gram"].to_numpy(np.int64).view(U64)
        slots = np.concatenate(_slots(grams)) if len(grams) else np.zeros(0, np.int64)
        masks = np.stack(batch["masks"]) if len(grams) else np.zeros((0, 0), np.int64)
        for word in range(masks.shape[1]):
            mine = np.tile(masks[:, word], PROBES)
            yield pd.DataFrame({"slot": slots, "word": word, "mask": mine})[mine != 0]


def predictor(spark: SparkSession, model: Model):
    """A Pandas UDF text -> struct<lang_pred, score, coverage>; the filter is broadcast."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double, coverage double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        return shared.value.predict(list(texts))

    return predict


def _identified(docs: DataFrame, model: Model) -> DataFrame:
    return docs.withColumn(fresh(docs, "found")[0], predictor(docs.sparkSession, model)(
        F.col("text")))


def identify(docs: DataFrame, labelled: DataFrame) -> DataFrame:
    """``docs`` with a last column ``found``: lang_pred, score (share of the winner in all
    corrected counts) and coverage (share of n-grams that the winner's filter holds).

    Repeated rows get the same answer.  Without a labelled row every text is ``und``.
    """
    return _identified(docs, fit(labelled))


def understood(docs: DataFrame, labelled: DataFrame, least: float = COVERAGE) -> DataFrame:
    """``docs`` without texts that have no letter or fit no learnt language.

    Without a labelled row no language is known that a text could fail to fit: every text
    with a letter stays.
    """
    model = fit(labelled)
    found = _identified(docs, model)
    name = found.columns[-1]
    if not model.languages:
        return found.where(F.col("text").rlike(r"\p{L}")).drop(name)
    return found.where((F.col(name)["lang_pred"] != UNKNOWN)
                       & (F.col(name)["coverage"] >= least)).drop(name)


def held_out(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % 4 == 2
