"""Numbers of byte runs, such as the token ids of words, remembered by a Python worker.

Texts are cut into runs; a run is looked up by its 64-bit hash in a sorted table, and what
belongs to all runs of many texts is put together by offsets, without a Python object for each
run. Only runs that aren't known yet are handed to a tokenizer.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

from .words import PIECE, text_bytes, word_hashes


def slices(texts: pa.Array, size: int = PIECE) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Whole texts, about ``size`` bytes together: the first row, the bytes, the offsets of texts."""
    data, offsets = text_bytes(texts)
    first = 0
    while first < len(offsets) - 1:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1)
        yield first, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """``starts[i], starts[i] + 1, ...``, ``sizes[i]`` of them, for every i in a row."""
    before = np.cumsum(sizes) - sizes
    return np.repeat(starts - before, sizes) + np.arange(int(sizes.sum()))


def totals(values: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between neighbouring ``edges``."""
    sums = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
    return sums[edges[1:]] - sums[edges[:-1]]


class Memory:
    """Rows of numbers by the hash of a run, in one or more columns of lists.

    When more than ``most`` numbers are held, runs that were met once are forgotten, and all
    are if that doesn't halve them; this costs work and nothing else.
    """

    def __init__(self, columns: int = 1, most: int = 4_000_000):
        self.columns, self.most = columns, most
        self.clear()

    def clear(self) -> None:
        self.keys = np.empty(0, np.uint64)
        self.seen = np.empty(0, np.int32)
        self.starts = [np.empty(0, np.int64) for _ in range(self.columns)]
        self.sizes = [np.empty(0, np.int64) for _ in range(self.columns)]
        self.values = [np.empty(0, np.uint32) for _ in range(self.columns)]

    def _forget(self) -> None:
        kept = self.seen > 0
        if sum(int(size[kept].sum()) for size in self.sizes) > self.most // 2:
            self.clear()
            return
        self.keys, self.seen = self.keys[kept], np.zeros(int(kept.sum()), np.int32)
        for c in range(self.columns):
            starts, sizes = self.starts[c][kept], self.sizes[c][kept]
            self.values[c] = self.values[c][ragged(starts, sizes)]
            self.starts[c], self.sizes[c] = np.cumsum(sizes) - sizes, sizes

    def _add(self, keys: np.ndarray, found: list[tuple[np.ndarray, np.ndarray]]) -> None:
        """``keys`` are sorted and new; ``found`` has the sizes and values of each column."""
        place = np.searchsorted(self.keys, keys)
        self.keys = np.insert(self.keys, place, keys)
        self.seen = np.insert(self.seen, place, 0)
        for c, (sizes, values) in enumerate(found):
            starts = np.cumsum(sizes) - sizes + len(self.values[c])
            self.starts[c] = np.insert(self.starts[c], place, starts)
            self.sizes[c] = np.insert(self.sizes[c], place, sizes)
            self.values[c] = np.concatenate((self.values[c], values.astype(np.uint32)))

    def look_up(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, encode: Callable[[list[bytes]], list[tuple[np.ndarray, np.ndarray]]], lower: bool = False) -> list[tuple[np.ndarray, np.ndarray]]:
        """Of each column, how many numbers every run has, and the numbers of all runs in a row.

        ``encode`` gives the sizes and the values of each column for a list of runs; with ``lower``
        runs that differ in A-Z and a-z only are one.
        """
        if sum(map(len, self.values)) > self.most:
            self._forget()
        keys, first, back = np.unique(word_hashes(data, starts, ends, lower), return_index=True, return_inverse=True)
        at = np.searchsorted(self.keys, keys)
        old = at < len(self.keys)
        old[old] = self.keys[at[old]] == keys[old]
        self.seen[at[old]] += 1
        new = ~old
        if new.any():
            at = first[new]
            self._add(keys[new], encode([data[a:b].tobytes() for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)]))
        row = np.searchsorted(self.keys, keys)[back]
        return [(size[row], values[ragged(start[row], size[row])]) for start, size, values in zip(self.starts, self.sizes, self.values, strict=True)]
