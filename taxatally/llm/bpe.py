"""Byte-pair encoding by a pair occurrence index, and decoding.

The distinct pre-tokens of an Arrow batch are laid out as one array of symbols. An index maps
the rank of every pair to all positions where that pair stands. The active ranks are taken
in ascending order: all occurrences of a pair are merged at once, and the lists of the pairs
that arise to their left and right are updated. A merge never makes a pair of lower rank than
its own (checked when the file is loaded), so this gives what word-by-word merging gives.

Null and empty texts have no ids and decode to the empty text. Every row is encoded on its
own, so repeated rows and ties need no rule; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import LEAN, bound_batches, tidy

#: Pre-token pattern of byte-level vocabularies. Fixed value: it must equal that of the file's library.
PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")

#: Distinct pre-tokens that a task remembers from batch to batch; only saves work.
REMEMBERED = 60_000
#: Places that are looked up at once when the index is made.
STEP = 1 << 16
#: Bytes of texts that are encoded together, and of ids that leave a task together. A worker of the
#: first stages holds about 80 MB already when this one begins, and an executor has several.
GATHER, OUT = 1 << 20, 1 << 19


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(256))
    return [chr(b) if b in plain else chr(256 + next(rest)) for b in range(256)]


class Bpe:
    """Vocabulary and merges of one byte-level BPE file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocab = spec["model"]["vocab"]
        chars = byte_characters()
        to_byte = {c: b for b, c in enumerate(chars)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of = [b""] * (1 + max([*vocab.values(), *self.special.values()]))
        for token, i in vocab.items():
            self.bytes_of[i] = bytes(to_byte[c] for c in token)
        for token, i in self.special.items():
            self.bytes_of[i] = token.encode()
        self.byte_id = np.array([vocab[c] for c in chars], dtype=np.int32)
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.left = np.array([vocab[a] for a, _ in merges], dtype=np.int64)
        self.right = np.array([vocab[b] for _, b in merges], dtype=np.int64)
        self.new = np.array([vocab[a + b] for a, b in merges], dtype=np.int64)
        self.size = len(self.bytes_of)
        born = np.full(self.size, -1)
        born[self.new[::-1]] = np.arange(len(merges))[::-1]
        rank = np.arange(len(merges))
        if (born[self.left] >= rank).any() or (born[self.right] >= rank).any() or len(set(self.new.tolist())) < len(merges):
            raise ValueError("the merges are not in ascending order of dependence")
        keys = self.left * self.size + self.right
        self.rank = np.argsort(keys)
        self.keys = keys[self.rank]
        self.cuts = regex.compile("|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True))) if self.special else None

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 where there is no merge of it."""
        keys = left.astype(np.int64) * self.size + right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.rank[at], -1)

    def words(self, text: str) -> list[str]:
        """Pre-tokens of a text; the strings of added tokens stand alone."""
        if self.cuts is None or not self.cuts.search(text):
            return PATTERN.findall(text)
        out, at = [], 0
        for m in self.cuts.finditer(text):
            out += PATTERN.findall(text[at : m.start()])
            out.append(m[0])
            at = m.end()
        return out + PATTERN.findall(text[at:])

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Ids of each word as little-endian unsigned 32-bit integers."""
        raw = [w.encode() for w in words]
        sizes = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
        if not sizes.sum():
            return [b""] * len(words)
        data = np.frombuffer(b"".join(raw), dtype=np.uint8)
        n = len(data)
        last = np.cumsum(sizes)
        # One place more stands for "no neighbour".
        symbol = np.append(self.byte_id[data], np.int32(-1))
        follower, leader = np.arange(1, n + 2, dtype=np.int32), np.arange(-1, n, dtype=np.int32)
        follower[n] = n
        follower[last[sizes > 0] - 1] = n
        leader[(last - sizes)[sizes > 0]] = n

        index: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def note(places: np.ndarray) -> None:
            rank = self.ranks(symbol[places], symbol[follower[places]])
            known = rank >= 0
            places, rank = places[known], rank[known]
            if not len(rank):
                return
            order = np.argsort(rank, kind="stable")
            places, rank = places[order], rank[order]
            cut = np.flatnonzero(rank[1:] != rank[:-1]) + 1
            for r, a, b in zip(rank[np.append(0, cut)].tolist(), np.append(0, cut).tolist(), np.append(cut, len(rank)).tolist(), strict=True):
                if r in index:
                    index[r].append(places[a:b])
                else:
                    index[r] = [places[a:b]]
                    heapq.heappush(active, r)

        for first in range(0, n, STEP):
            note(np.arange(first, min(n, first + STEP), dtype=np.int32))
        while active:
            r = heapq.heappop(active)
            lists = index.pop(r)
            places = np.unique(np.concatenate(lists)) if len(lists) > 1 else np.sort(lists[0])
            a, b = self.left[r], self.right[r]
            places = places[(symbol[places] == a) & (symbol[follower[places]] == b)]
            if a == b and len(places) > 1:
                # In a run of one symbol every second place merges, from the left.
                at = np.arange(len(places))
                begins = np.append(True, follower[places[:-1]] != places[1:])
                places = places[(at - np.maximum.accumulate(np.where(begins, at, 0))) % 2 == 0]
            if not len(places):
                continue
            gone = follower[places]
            beyond = follower[gone]
            symbol[places], symbol[gone] = self.new[r], -1
            follower[places], leader[beyond] = beyond, places
            note(np.unique(np.concatenate((leader[places], places))))
        left = symbol[:n] >= 0
        ids = symbol[:n][left].astype("<u4").tobytes()
        ends = np.append(0, np.cumsum(left))[last] * 4
        return [ids[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]

    def encode(self, texts: Iterable[str], known: dict[str, bytes]) -> Iterator[bytes]:
        """Ids of every text; ``known`` keeps the ids of pre-tokens seen before."""
        cut = [self.words(text) for text in texts]
        fresh = set().union(*cut)
        fresh.difference_update(known)
        for token, i in self.special.items():
            known[token] = np.array([i], dtype="<u4").tobytes()
            fresh.discard(token)
        new = list(fresh)
        known.update(zip(new, self.encode_words(new), strict=True))
        for words in cut:
            yield b"".join(map(known.__getitem__, words))

    def decode(self, ids: bytes) -> str:
        """The text of ids, the strings of added tokens included."""
        parts = map(self.bytes_of.__getitem__, np.frombuffer(ids, dtype="<u4").tolist())
        return b"".join(parts).decode("utf-8", errors="replace")


@lru_cache(maxsize=2)
def load(path: str) -> Bpe:
    return Bpe(path)


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches put together to about ``GATHER`` bytes; the index pays off over many words."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= GATHER:
            whole, held, size = pa.concat_batches(held), [], 0
            yield whole
            del whole
    if held:
        yield pa.concat_batches(held)


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ``ids`` (binary, little-endian unsigned 32-bit) and ``decoded`` of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, known = load(path), {}
        for batch in _gathered(batches):
            texts = [x or "" for x in batch.column(1).to_pylist()]
            if len(known) > REMEMBERED:
                known.clear()
            ids, held, first = [], 0, 0
            for at, found in enumerate(bpe.encode(texts, known), 1):
                ids.append(found)
                held += len(found)
                if held > OUT or at == len(texts):
                    columns = [batch.column(0).slice(first, at - first), pa.array(ids, pa.binary()), pa.array(map(bpe.decode, ids), pa.string())]
                    yield pa.RecordBatch.from_arrays(columns, ["doc_id", "ids", "decoded"])
                    ids, held, first = [], 0, at
            del texts
        # The worker goes on to other tasks; what this one held should not stay with it.
        known.clear()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return bound_batches(docs, LEAN).select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(tidy(run), f"doc_id {kind}, ids binary, decoded string")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """Digest of encoding and decoding: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return encoded(docs, path).select(
        "doc_id",
        F.expr("cast(octet_length(ids) div 4 as bigint)").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
