"""Ids of words, each distinct word encoded once per worker while it is remembered.

A tokenizer whose units never cross a word bound gives a text the ids of its
words in turn.  ``WordCache`` keeps the ids of words it has met in one flat pool
and gathers the ids of all words of a slice in a few vector steps.  It holds two
generations of at most ``size`` words, so its memory is bounded.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np


class WordCache:
    def __init__(self, encode: Callable[[list[str]], Sequence[Sequence[int] | bytes]], size: int = 250_000):
        self.encode, self.size = encode, size
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def ids(self, words: list[str]) -> list[bytes]:
        """The ids of each word as 32-bit integers."""
        young, old = self.young, self.old
        found: list[bytes | None] = [None] * len(words)
        missing: list[int] = []
        for i, w in enumerate(words):
            hit = young.get(w)
            if hit is None:
                hit = old.get(w)
                if hit is None:
                    missing.append(i)
                    continue
                young[w] = hit
            found[i] = hit
        if missing:
            fresh = [words[i] for i in missing]
            for i, w, got in zip(missing, fresh, self.encode(fresh), strict=True):
                found[i] = young[w] = got if isinstance(got, bytes) else np.array(got, np.uint32).tobytes()
        if len(young) > self.size:
            self.old, self.young = young, {}
        return found

    def gathered(self, words: list[str], codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the occurrences ``words[codes]`` in turn, and how many each occurrence has."""
        parts = self.ids(words)
        lengths = np.fromiter((len(p) for p in parts), np.int64, len(parts)) // 4
        return ragged(np.frombuffer(b"".join(parts), np.uint32), lengths, codes)


def ragged(flat: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pick pieces ``codes`` of ``flat``, whose piece i has ``lengths[i]`` entries: the entries in turn and the picked lengths."""
    starts = np.cumsum(lengths) - lengths
    n = lengths[codes]
    total = int(n.sum())
    shift = np.repeat(starts[codes] - (np.cumsum(n) - n), n)
    return flat[np.arange(total) + shift] if total else np.zeros(0, flat.dtype), n
