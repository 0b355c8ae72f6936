"""Words of texts as arrays: positions, hashes and n-grams, for use inside Arrow tasks.

A word is a run of bytes other than space and ``\\t\\n\\v\\f\\r``. Texts are handled in
pieces of about ``PIECE`` bytes, so memory does not follow the size of an Arrow batch.
Hashes have 64 bits; two different words or n-grams are taken for equal with a chance of
2^-64 a pair.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

PIECE = 1 << 20
#: Bytes of an Arrow batch of texts; by rows alone a batch of long texts has no bound. ``LEAN`` is for tasks
#: that run where other steps have filled the executor's memory before; Spark keeps batches outside its heap.
BATCH, LEAN = 4 << 20, 1 << 20

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_STEP = np.uint64(0xD6E8FEB86659FD93)


def bound_batches(docs: DataFrame, size: int = BATCH) -> DataFrame:
    """Have Spark cut the batches it sends to tasks by bytes too; returns ``docs`` as it is."""
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))
    return docs


def fresh(docs: DataFrame, *names: str) -> list[str]:
    """The names with underscores behind, as many as it takes to be unlike all columns of ``docs``."""
    taken, tail = {c.lower() for c in docs.columns}, "_"
    while any(n + tail in taken for n in names):
        tail += "_"
    return [n + tail for n in names]


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for mapInArrow, with freed memory given back to the system before and after.

    A Python worker serves many tasks, and what one has freed would stay with it otherwise. What
    leaves the task is cut into batches of about ``LEAN`` bytes, of one row at least.
    """

    def give_back() -> None:
        _Powers.drop()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # there is no such call outside of glibc
            ctypes.CDLL("libc.so.6").malloc_trim(0)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        for out in run(batches):
            rows = max(1, len(out) * LEAN // max(LEAN, out.nbytes))
            for first in range(0, max(1, len(out)), rows):
                yield out.slice(first, rows)
        give_back()

    return task


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit values over all bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * _BASE)
_LOWER = _BYTES.copy()
_LOWER[65:91] = _BYTES[97:123]


def _powers(n: int, base: np.uint64) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


class _Powers:
    """Powers of the base and of its inverse for a piece, from the first use in a task to its end."""

    up = down = np.empty(0, np.uint64)

    @classmethod
    def drop(cls) -> None:
        cls.up = cls.down = np.empty(0, np.uint64)

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if not len(cls.up):
            cls.up, cls.down = _powers(PIECE + 1, _BASE), _powers(PIECE + 1, _INVERSE)
        if n > len(cls.up):
            return _powers(n, _BASE), _powers(n, _INVERSE)
        return cls.up[:n], cls.down[:n]


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array and the offsets of its texts; null counts as empty."""
    texts = pc.fill_null(texts, "")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    wide = pa.types.is_large_string(texts.type)
    _, where, data = texts.buffers()
    offsets = np.frombuffer(where, dtype=np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, np.uint8)
    return data, offsets


def bounds(data: np.ndarray, edges: np.ndarray, between: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every word; no word runs over one of ``edges`` (text offsets).

    ``between`` marks the bytes that stand between words.
    """
    if not len(data):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    word = ~between[data]
    before, after = np.empty_like(word), np.empty_like(word)
    before[0], before[1:] = False, word[:-1]
    after[-1], after[:-1] = False, word[1:]
    inner = edges[(edges > 0) & (edges < len(data))]
    before[inner], after[inner - 1] = False, False
    return np.flatnonzero(word & ~before), np.flatnonzero(word & ~after) + 1


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool) -> np.ndarray:
    """64-bit hash of each word, by a polynomial over its bytes; A-Z as a-z if ``lower``."""
    out = np.empty(len(starts), dtype=np.uint64)
    table, first = (_LOWER if lower else _BYTES), 0
    while first < len(starts):
        base = starts[first]
        last = max(first + 1, int(np.searchsorted(ends, base + PIECE, "right")))
        part = data[base : ends[last - 1]]
        up, down = _Powers.of(len(part) + 1)
        total = np.empty(len(part) + 1, dtype=np.uint64)
        total[0] = 0
        np.cumsum(table[part] * up[:-1], out=total[1:])
        a, b = starts[first:last] - base, ends[first:last] - base
        out[first:last] = mix((total[b] - total[a]) * down[a] + (b - a).astype(np.uint64))
        first = last
    return out


@dataclass
class Piece:
    """Some whole texts of a batch: rows ``first`` and on, and their words."""

    first: int
    data: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    per_text: np.ndarray  #: of each text, the index of its first word; one more at the end

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def hashes(self, lower: bool = False) -> np.ndarray:
        return word_hashes(self.data, self.starts, self.ends, lower)


def pieces(texts: pa.Array) -> Iterator[Piece]:
    """Cut a string array into pieces of whole texts, about ``PIECE`` bytes each."""
    data, offsets = text_bytes(texts)
    first = 0
    while first < len(offsets) - 1:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + PIECE, "right")) - 1)
        part = data[offsets[first] : offsets[last]]
        edges = offsets[first : last + 1] - offsets[first]
        starts, ends = bounds(part, edges)
        yield Piece(first, part, edges, starts, ends, np.searchsorted(starts, edges, "left"))
        first = last


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of every window of ``n`` words; the caller cuts windows that cross texts."""
    if len(hashes) < n:
        return np.empty(0, np.uint64)
    out = np.zeros(len(hashes) - n + 1, dtype=np.uint64)
    for i in range(n):
        out = out * _STEP + hashes[i : len(out) + i]
    return mix(out + np.uint64(n))


def shingle_sets(texts: pa.Array, n: int, lower: bool) -> Iterator[tuple[int, np.ndarray]]:
    """Row and sorted distinct ``n``-word shingles of every text.

    A text of fewer words has its whole sequence as one shingle; one without words has none.
    """
    for piece in pieces(texts):
        hashes = piece.hashes(lower)
        every = grams(hashes, n)
        for i in range(len(piece)):
            a, b = piece.per_text[i], piece.per_text[i + 1]
            if b - a >= n:
                found = np.sort(every[a : b - n + 1])
                yield piece.first + i, found[np.concatenate(([True], found[1:] != found[:-1]))]
            else:
                yield piece.first + i, grams(hashes[a:b], int(b - a)) if b > a else np.empty(0, np.uint64)
