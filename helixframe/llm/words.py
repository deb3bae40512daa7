"""Words, shingles and hashes of whole texts, a few megabytes at a time.

A word is a maximal run of characters other than space, tab, LF, VT, FF and CR.
Texts come as Arrow arrays.  Each step works on flat arrays over all words of a
slice: splitting and dictionary encoding run in Arrow, per-word work is done
once per distinct word, and window arithmetic is vectorised.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Text bytes that are worked on at once.
SLICE_BYTES = 4 << 20


def text_slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``limit`` text bytes: smaller batches are joined, larger ones cut; one longer
    text is a batch of its own."""
    held: list[pa.RecordBatch] = []
    total = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(size)
        first = 0
        while first < batch.num_rows:
            base = ends[first - 1] if first else 0
            last = int(np.searchsorted(ends, base + limit - total, side="right"))
            if last <= first:
                if held:
                    yield _joined(held)
                    held, total = [], 0
                    continue
                last = first + 1
            held.append(batch.slice(first, last - first))
            total += int(ends[last - 1] - base)
            first = last
    if held:
        yield _joined(held)
    held = []
    _give_back()


#: glibc's way to return freed memory to the system; absent elsewhere.
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def _give_back() -> None:
    """Workers are used again by later tasks: what the slices of this one took must not stay with them."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def _joined(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return batches[0] if len(batches) == 1 else pa.Table.from_batches(batches).combine_chunks().to_batches()[0]


def filled(texts: pa.Array) -> pa.Array:
    return pc.fill_null(texts, "")


@dataclass
class Words:
    """Words of a slice: ``codes[i]`` is the place of word i in ``distinct``; document d has words bounds[d]:bounds[d+1]."""

    codes: np.ndarray
    distinct: pa.Array
    bounds: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), self.counts)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash for each word occurrence."""
        return hashed(self.distinct)[self.codes]


def words_of(texts: pa.Array) -> Words:
    split = pc.ascii_split_whitespace(filled(texts))
    flat = split.flatten()
    bounds = split.offsets.to_numpy().astype(np.int64)
    bounds = bounds - bounds[0]
    keep = pc.not_equal(flat, "")
    kept = keep.to_numpy(zero_copy_only=False)
    if not kept.all():
        flat = flat.filter(keep)
        bounds = np.concatenate([[0], np.cumsum(kept)]).astype(np.int64)[bounds]
    coded = flat.dictionary_encode()
    return Words(coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary, bounds)


def hashed(strings: pa.Array) -> np.ndarray:
    digest = xxhash.xxh3_64_intdigest
    return np.fromiter((digest(s) for s in strings.cast(pa.binary()).to_pylist()), np.uint64, len(strings))


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective finisher: every output bit depends on every input bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


_MULTIPLIERS = mixed(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


def windows(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of ``k`` consecutive entries (over document bounds too; see ``inside``)."""
    if len(h) < k:
        return np.zeros(0, np.uint64)
    n = len(h) - k + 1
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out += h[j : j + n] * _MULTIPLIERS[j]
    return mixed(out)


def inside(bounds: np.ndarray, k: int) -> np.ndarray:
    """Starts of the windows of ``k`` words that lie in one document."""
    counts = np.diff(bounds)
    total = int(bounds[-1])
    starts = np.arange(total)
    ends = np.repeat(bounds[1:], counts)
    return starts[starts + k <= ends]


def covered(n: int, starts: np.ndarray, k: int) -> np.ndarray:
    """Whether each of ``n`` words lies in a window of ``k`` words that begins at one of ``starts``."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, np.minimum(starts + k, n), -1)
    return np.cumsum(step[:-1]) > 0
