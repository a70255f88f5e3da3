"""A minimal acyclic transducer: a sorted list of words compiled into a shared-suffix
automaton whose transitions carry numbers; their sum along a word is the word's place in
the list, and that place gives the word's token ids.

The automaton is one flat file, so that tasks of a machine map the same pages.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

import numpy as np

PARTS = (("keys", np.int64), ("ids", np.int32), ("starts", np.int32), ("target", np.int32),
         ("skip", np.int32), ("final", np.uint8))


def compile_words(words: Sequence[bytes], ids: Sequence[Sequence[int]]) -> bytes:
    """The file for ``words`` (sorted, distinct, not empty) with their token ids.

    Incremental construction: a state that can't change any more is replaced by an equal
    one that is already registered.
    """
    registry: dict[tuple, int] = {}
    frozen: list[tuple[bool, tuple]] = []
    path: list[list] = [[False, []]]  # of the word at hand: is it an end, [(byte, state)]
    letters: list[int] = []

    def freeze(depth: int) -> None:
        while len(path) > depth + 1:
            final, edges = path.pop()
            key = (final, tuple(edges))
            state = registry.get(key)
            if state is None:
                state = registry[key] = len(frozen)
                frozen.append(key)
            path[-1][1].append((letters.pop(), state))

    last = b""
    for word in words:
        common = 0
        for a, b in zip(word, last):
            if a != b:
                break
            common += 1
        freeze(common)
        for byte in word[common:]:
            letters.append(byte)
            path.append([False, []])
        path[-1][0] = True
        last = word
    freeze(0)
    frozen.append((path[0][0], tuple(path[0][1])))
    below = []  # words that end at or below a state; children precede their parents
    for final, edges in frozen:
        below.append(final + sum(below[state] for _, state in edges))
    root = len(frozen) - 1
    keys, target, skip = [], [], []
    for state, (final, edges) in enumerate(frozen):
        passed = int(final)
        for byte, child in edges:
            keys.append((root - state) * 256 + byte)  # the root is state 0
            target.append(root - child)
            skip.append(passed)
            passed += below[child]
    order = np.argsort(keys) if keys else np.zeros(0, np.int64)
    arrays = {
        "keys": np.array(keys, np.int64)[order], "target": np.array(target, np.int32)[order],
        "skip": np.array(skip, np.int32)[order],
        "final": np.array([final for final, _ in reversed(frozen)], np.uint8),
        "starts": np.cumsum([0, *map(len, ids)]).astype(np.int32),
        "ids": np.array([i for row in ids for i in row], np.int32)}
    sizes = np.array([*(len(arrays[name]) for name, _ in PARTS),
                      max(map(len, words), default=0)], np.int64)
    return sizes.tobytes() + b"".join(arrays[name].astype(kind).tobytes() for name, kind in PARTS)


class Lexicon:
    """Looks many words up at once in a compiled file."""

    def __init__(self, data: np.ndarray):
        sizes = data[:8 * (len(PARTS) + 1)].view(np.int64)
        at, self.longest = 8 * (len(PARTS) + 1), int(sizes[-1])
        for (name, kind), size in zip(PARTS, sizes, strict=False):
            stop = at + int(size) * np.dtype(kind).itemsize
            setattr(self, name, data[at:stop].view(kind))
            at = stop

    @classmethod
    def mapped(cls, path: str) -> Lexicon:
        return cls(np.memmap(path, np.uint8, mode="r"))

    def places(self, words: Iterable[bytes]) -> np.ndarray:
        """Each word's place in the list, -1 where it is not in it."""
        words = list(words)
        lengths = np.array([len(w) for w in words], np.int64)
        short = np.flatnonzero((lengths <= self.longest) & (lengths > 0))
        short = short[np.argsort(-lengths[short], kind="stable")]  # those still read come first
        result = np.full(len(words), -1, np.int64)
        if not len(short) or not len(self.keys):
            return result
        left = lengths[short]
        text = np.frombuffer(b"".join(words[i] for i in short.tolist()), np.uint8)
        begin = np.cumsum(left) - left
        state = np.zeros(len(short), np.int64)
        total = np.zeros(len(short), np.int64)
        for depth in range(int(left[0])):
            reading = int(np.searchsorted(-left, -depth, side="left"))
            rows = np.flatnonzero(state[:reading] >= 0)
            key = state[rows] * 256 + text[begin[rows] + depth]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            known = self.keys[at] == key
            state[rows] = np.where(known, self.target[at], -1)
            total[rows] += self.skip[at]
        found = (state >= 0) & (self.final[np.maximum(state, 0)] == 1)
        result[short[found]] = total[found]
        return result
