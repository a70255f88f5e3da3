"""Word shingles of a batch of texts as arrays of hashes (numpy, inside tasks)."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

U64 = np.uint64
GOLDEN = U64(0x9E3779B97F4A7C15)
ODD = U64(0x100000001B3)
WORDS = 5
PIECE_BYTES = 4_000_000

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32  # A-Z
_LOWER[[32, *range(9, 14)]] = 0


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; equal on every machine."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def pieces(texts: Sequence[str | None]) -> Iterator[tuple[int, list[bytes]]]:
    """Consecutive runs of whole texts of a few MB, with the place of the first."""
    run, begin, size = [], 0, 0
    for place, text in enumerate(texts):
        data = (text or "").encode("utf-8", "surrogatepass")
        if run and size + len(data) > PIECE_BYTES:
            yield begin, run
            run, begin, size = [], place, 0
        run.append(data)
        size += len(data)
    if run:
        yield begin, run


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, A-Z in lower case, and for each text the number of its words."""
    data = _LOWER[np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)]
    ends = np.cumsum([len(t) + 1 for t in texts])
    inside = data != 0
    starts = np.flatnonzero(inside & ~np.concatenate(([False], inside[:-1])))
    counts = np.diff(np.concatenate(([0], np.searchsorted(starts, ends))))
    if not len(starts):
        return np.zeros(0, U64), counts
    places = np.flatnonzero(inside)
    first = np.searchsorted(places, starts)
    lengths = np.diff(np.append(first, len(places)))
    offset = np.arange(len(places)) - np.repeat(first, lengths)
    powers = np.cumprod(np.full(int(lengths.max()), ODD, U64))
    values = (data[places].astype(U64) + U64(1)) * powers[offset]
    return mix(np.add.reduceat(values, first) + GOLDEN * lengths.astype(U64)), counts


def shingle_hashes(words: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's five-word shingles and their text; a text of one to four
    words is a single shingle, one without words has none."""
    padded = np.concatenate((words, np.zeros(WORDS, U64)))
    begin = np.cumsum(counts) - counts
    made = np.where(counts == 0, 0, np.maximum(counts - WORDS + 1, 1))
    text = np.repeat(np.arange(len(counts)), made)
    at = np.arange(len(text)) - np.repeat(np.cumsum(made) - made, made) + begin[text]
    left = np.minimum(counts[text] - (at - begin[text]), WORDS)
    total = np.zeros(len(text), U64)
    for k in range(WORDS):
        word = np.where(k < left, padded[at + k], U64(0))
        total = mix(total * ODD + word + U64(k + 1))
    return total, text


def multiset(shingles: np.ndarray, text: np.ndarray
             ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, shingle) with counts."""
    order = np.lexsort((shingles, text))
    shingles, text = shingles[order], text[order]
    if not len(text):
        return shingles, text, np.zeros(0, np.int64)
    new = np.append(True, (shingles[1:] != shingles[:-1]) | (text[1:] != text[:-1]))
    first = np.flatnonzero(new)
    return shingles[first], text[first], np.diff(np.append(first, len(text)))


def numbered(shingles: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The multiset as a set: the n-th copy of a shingle in a text is an element of its own."""
    values, owner, count = multiset(shingles, text)
    copy = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    return mix(np.repeat(values, count) + GOLDEN * copy.astype(U64)), np.repeat(owner, count)


def element_sets(texts: list[bytes]) -> list[np.ndarray]:
    """Each text's multiset of shingles as a sorted array of elements."""
    words, counts = word_hashes(texts)
    elements, owner = numbered(*shingle_hashes(words, counts))
    cuts = np.searchsorted(owner, np.arange(1, len(texts)))
    return [np.sort(x) for x in np.split(elements, cuts)]
