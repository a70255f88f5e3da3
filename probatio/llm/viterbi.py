"""Token counts of a unigram vocabulary without tokenizing: count-only Viterbi.

An Aho-Corasick automaton lists all vocabulary pieces that end at each character; dynamic
programming carries the best score and its number of pieces from left to right and
keeps no path.  Ties go to the piece that starts first, as in unigram tokenizers: a later
candidate must score strictly more.  Scores add up as doubles.  A character that no piece
covers alone costs the least score minus 10 and counts as its UTF-8 bytes.

A text is written with a leading and for each space a U+2581 mark.  Where no piece has the
mark after another character, the best segmentation of a text is that of its marked
words one by one, so each distinct word is looked at once (in a bounded memory per task).

Rows: NULL and empty texts have no tokens and score 0.  Repeated rows count alike.
"""

from __future__ import annotations

import re
from functools import lru_cache

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probatio.llm.common import fresh

MARK = "▁"
PENALTY = 10.0
REMEMBERED = 300_000


class Unigram(dict):
    """word -> number of an entry in ``counts`` and ``scores``."""

    def __init__(self, pieces: dict[str, float]):
        super().__init__()
        self.pieces = pieces
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces.items():
            self.automaton.add_word(piece, (len(piece), score))
        if pieces:
            self.automaton.make_automaton()
        self.single = {p for p in pieces if len(p) == 1}
        self.unknown = min(pieces.values(), default=0.0) - PENALTY
        inner = any(MARK in p.lstrip(MARK) for p in pieces)
        line = "" if any("\n" in p for p in pieces) else "\n"
        self.words = re.compile("(?s).+" if inner else
                                f"{MARK}*[^{MARK}{line}]+|{MARK}+" + ("|\n" if line else ""))
        self.counts = np.zeros(1024, np.int64)
        self.scores = np.zeros(1024)

    def best(self, text: str) -> tuple[float, int]:
        """Score and number of pieces of the best segmentation."""
        scores, counts = [-np.inf] * (len(text) + 1), [0] * (len(text) + 1)
        scores[0], done = 0.0, 0

        def single(at: int) -> None:
            char = text[at - 1]
            if char not in self.single and scores[at - 1] + self.unknown > scores[at]:
                scores[at] = scores[at - 1] + self.unknown
                counts[at] = counts[at - 1] + len(char.encode("utf-8", "surrogatepass"))

        for last, (length, score) in self.automaton.iter(text) if self.pieces else ():
            end = last + 1
            while done < end - 1:
                done += 1
                single(done)
            candidate = scores[end - length] + score
            if candidate > scores[end]:
                scores[end], counts[end] = candidate, counts[end - length] + 1
        while done < len(text):
            done += 1
            single(done)
        return scores[-1], counts[-1]

    def __missing__(self, word: str) -> int:
        number = len(self)
        if number >= len(self.counts):
            self.counts = np.resize(self.counts, 2 * number)
            self.scores = np.resize(self.scores, 2 * number)
        self.scores[number], self.counts[number] = self.best(word)
        self[word] = number
        return number

    def count(self, text: str | None) -> tuple[int, float]:
        if not text:
            return 0, 0.0
        total, score = 0, 0.0
        run: list[int] = []
        for match in self.words.finditer(MARK + text.replace(" ", MARK)):
            run.append(self[match.group()])
            if len(run) >= REMEMBERED:
                total, score = self._add(run, total, score)
        total, score = self._add(run, total, score)
        return total, score

    def _add(self, run: list[int], total: int, score: float) -> tuple[int, float]:
        numbers = np.array(run, np.int64)
        total += int(self.counts[numbers].sum())
        score += float(self.scores[numbers].sum())
        run.clear()
        if len(self) > REMEMBERED:
            self.clear()
        return total, score


def read_pieces(path: str) -> dict[str, float]:
    """Pieces and scores of a SentencePiece file, without control, unknown and byte pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return {model.id_to_piece(i): model.get_score(i) for i in range(model.get_piece_size())
            if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)
                    or model.is_unused(i))}


@lru_cache(maxsize=2)
def unigram(path: str) -> Unigram:
    return Unigram(read_pieces(path))


def count_tokens(docs: DataFrame, path: str) -> DataFrame:
    """``docs`` with a last column ``counted``: n_tokens and score."""
    @F.pandas_udf("n_tokens long, score double")
    def run(texts: pd.Series) -> pd.DataFrame:
        model = unigram(path)
        return pd.DataFrame([model.count(t) for t in texts], columns=["n_tokens", "score"])

    return docs.withColumn(fresh(docs, "counted")[0], run(F.col("text")))
