"""Token ids in files of directly addressable codes.

An id is split into levels of 8 bits, lowest first. A level holds, in order, one byte of every
id that reaches it and one bit that says whether the id goes on; before every 512 bits the
number of ones so far is kept. The byte of an id on the next level stands at the rank of its
bit, so any token or stretch of tokens is read by looking up ranks, with no block to decode.

A store is a Parquet folder. A row is a segment of whole documents in ascending doc_id order
(null first, ties by a hash of the text): the ids before it, its documents, their starts and
the three arrays of each level. Segments hold about ``SEGMENT`` tokens, more only for a longer
document. Null and empty texts hold the end id alone. Repeated rows are kept. An empty table
gives an empty store. Extra columns are not read.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import new_path
from .chunks import Memory, slices, totals
from .words import bound_batches, bounds

SEGMENT = 1 << 18
#: Ids of words that a Python worker remembers; only saves work.
REMEMBERED = 5_000_000
#: What stands between words.
_BETWEEN = np.zeros(256, dtype=bool)
_BETWEEN[[0x20, 0x0A]] = True
_STOP, _LETTER = np.zeros(256, dtype=bool), np.zeros(256, dtype=bool)
_STOP[list(b".,")] = True
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_BLOCK = 64  # bytes of a bitmap between two entries of the rank directory


@dataclass(frozen=True)
class Codes:
    """Levels of directly addressable codes: bytes, continuation bits, ranks."""

    chunks: list[bytes]
    bits: list[bytes]
    ranks: list[bytes]

    @classmethod
    def of(cls, ids: np.ndarray) -> Codes:
        chunks, bits, ranks, left = [], [], [], ids.astype(np.uint32)
        while True:
            more = left > 255
            packed = np.packbits(more, bitorder="little")
            chunks.append((left & 255).astype(np.uint8).tobytes())
            bits.append(packed.tobytes())
            ones = np.bitwise_count(packed).astype(np.uint32)
            per_block = np.add.reduceat(ones, np.arange(0, len(ones), _BLOCK)) if len(ones) else ones
            ranks.append((np.cumsum(per_block) - per_block).astype("<u4").tobytes())
            left = left[more] >> 8
            if not len(left):
                return cls(chunks, bits, ranks)

    def rank(self, level: int, at: int) -> int:
        """Ones among the first ``at`` bits of a level."""
        block, directory = at // 8 // _BLOCK, np.frombuffer(self.ranks[level], "<u4")
        if block >= len(directory):
            block = len(directory) - 1
        if block < 0:
            return 0
        part = np.frombuffer(self.bits[level], np.uint8)[block * _BLOCK : -(-at // 8)]
        ones = int(np.bitwise_count(part).sum())
        if at % 8 and len(part):
            ones -= (int(part[-1]) >> (at % 8)).bit_count()
        return int(directory[block]) + ones

    def read(self, start: int, stop: int, level: int = 0) -> np.ndarray:
        """The ids from ``start`` up to ``stop``."""
        out = np.frombuffer(self.chunks[level], np.uint8)[start:stop].astype(np.uint32)
        if level + 1 < len(self.chunks) and stop > start:
            first = start // 8
            packed = np.frombuffer(self.bits[level], np.uint8)[first : -(-stop // 8)]
            more = np.unpackbits(packed, bitorder="little")[start - 8 * first : stop - 8 * first].astype(bool)
            if more.any():
                at = self.rank(level, start)
                out[more] |= self.read(at, at + int(more.sum()), level + 1) << np.uint32(8)
        return out

    def __getitem__(self, at: int) -> int:
        return int(self.read(at, at + 1)[0])


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    """The tokenizer of a file, and of each id whether its token ends a word."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks share the cores already
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    vocab = tokenizer.get_vocab(with_added_tokens=True)
    ends = np.zeros(max(vocab.values()) + 1, dtype=bool)
    ends[[i for token, i in vocab.items() if token.endswith("</w>")]] = True
    return tokenizer, ends


_KNOWN: dict[str, Memory] = {}


def _parted(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words with one stop or comma behind an ASCII letter parted from it, as the tokenizer does."""
    last = ends - 1
    cut = last[(ends - starts > 1) & _STOP[data[last]] & _LETTER[data[last - 1]]]
    if not len(cut):
        return starts, ends
    return np.sort(np.concatenate((starts, cut))), np.sort(np.concatenate((ends, cut)))


class WordEncoder:
    """Encodes texts by their words, for tokenizers that treat blanks as ends of words only.

    A word is a run of bytes other than space and line end, a stop or comma at its end apart; A-Z count
    as a-z. The ids of words seen before are remembered by the Python worker. Words of letters of the Latin blocks, and such with one
    stop or comma behind, are encoded many in a call and told apart by the tokens that end a
    word; all others go one by one.
    """

    def __init__(self, path: str):
        self.tokenizer, self.ends = _tokenizer(path)
        self.known = _KNOWN.setdefault(path, Memory(most=REMEMBERED))

    def _one_by_one(self, words: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def _together(self, words: list[str]) -> list[list[int]]:
        """Ids of plain words; one by one if the ends of words don't come out as expected."""
        ids = self.tokenizer.encode_batch_fast(["\n".join(words)], add_special_tokens=False)[0].ids
        cuts = np.flatnonzero(self.ends[ids]) + 1
        last = np.cumsum([1 + (w[-1] in ".,") for w in words]) - 1
        if len(cuts) != last[-1] + 1:
            return self._one_by_one(words)
        stops = cuts[last].tolist()
        return [ids[a:b] for a, b in zip([0, *stops[:-1]], stops, strict=True)]

    def _encode(self, words: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
        texts = [w.decode() for w in words]
        out: list[list[int]] = [[]] * len(texts)
        plain: list[int] = []
        other: list[int] = []
        for i, w in enumerate(texts):
            (plain if (w.isalpha() or w[-1] in ".," and w[:-1].isalpha()) and max(w) < "\u0180" else other).append(i)
        for part, encode in ((plain, self._together), (other, self._one_by_one)):
            for first in range(0, len(part), 2000):
                some = part[first : first + 2000]
                for i, ids in zip(some, encode([texts[i] for i in some]), strict=True):
                    out[i] = ids
        sizes = np.fromiter(map(len, out), np.int64, len(out))
        return [(sizes, np.fromiter(chain.from_iterable(out), np.uint32, int(sizes.sum())))]

    def __call__(self, texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """The first row, the number of ids of every text and all ids, for some texts after others."""
        for first, data, edges in slices(texts):
            starts, ends = _parted(data, *bounds(data, edges, _BETWEEN))
            sizes, ids = self.known.look_up(data, starts, ends, self._encode, lower=True)[0] if len(starts) else (np.empty(0, np.int64), np.empty(0, np.uint32))
            yield first, totals(sizes, np.searchsorted(starts, edges)), ids


_LEVEL = "array<binary>"
SCHEMA = f"part int, inside long, n_tokens long, first_doc {{kind}}, last_doc {{kind}}, doc_ids array<{{kind}}>, starts array<long>, chunks {_LEVEL}, bits {_LEVEL}, ranks {_LEVEL}"


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int) -> None:
    """Encode ``text`` of every row and write the store to ``path``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, inside = WordEncoder(tokenizer), TaskContext.get().partitionId(), 0
        held: list[tuple[pa.Array, np.ndarray, np.ndarray]] = []
        size = 0

        def segment() -> pa.RecordBatch:
            nonlocal inside
            doc_ids, lengths = pa.concat_arrays([x[0] for x in held]), np.concatenate([x[1] for x in held])
            codes, n = Codes.of(np.concatenate([x[2] for x in held])), int(lengths.sum())
            row = [[part], [inside], [n], doc_ids.slice(0, 1), doc_ids.slice(len(doc_ids) - 1, 1), pa.ListArray.from_arrays(pa.array([0, len(doc_ids)], pa.int32()), doc_ids), [np.cumsum(lengths) - lengths], [codes.chunks], [codes.bits], [codes.ranks]]
            kinds = [pa.int32(), pa.int64(), pa.int64(), None, None, None, pa.list_(pa.int64()), *[pa.list_(pa.binary())] * 3]
            inside += n
            held.clear()
            return pa.RecordBatch.from_arrays([v if k is None else pa.array(v, k) for v, k in zip(row, kinds, strict=True)], names)

        for batch in batches:
            for first, lengths, ids in encode(batch.column(1)):
                doc_ids = batch.column(0).slice(first, len(lengths))
                lengths, ids = lengths + 1, np.insert(ids, np.cumsum(lengths), end_id)
                ends, begin = np.cumsum(lengths), 0
                while begin < len(lengths):
                    before = int(ends[begin - 1]) if begin else 0
                    stop = min(len(lengths), int(np.searchsorted(ends, before + SEGMENT - size)) + 1)
                    held.append((doc_ids.slice(begin, stop - begin), lengths[begin:stop], ids[before : ends[stop - 1]]))
                    size += int(ends[stop - 1]) - before
                    begin = stop
                    if size >= SEGMENT:
                        yield segment()
                        size = 0
        if held:
            yield segment()

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = SCHEMA.format(kind=kind)
    names = [f.split()[0] for f in schema.split(", ")]
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("tie"))
    dealt = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    bound_batches(dealt).mapInArrow(run, schema).write.parquet(f"{path}/segments")


def open_store(spark: SparkSession, path: str) -> DataFrame:
    """The segments of a store with ``first_token``, the ids of all segments before.

    Each segment knows the ids before it in its part; the sum over parts has a row per part.
    """
    segments = spark.read.parquet(f"{path}/segments")
    totals = segments.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").toArrow()
    n = totals.column(1).to_numpy()
    before = spark.createDataFrame(pa.table({"part": totals.column(0), "before": pa.array(np.cumsum(n) - n, pa.int64())}))
    return segments.join(before, "part").withColumn("first_token", F.col("before") + F.col("inside")).drop("before", "inside")


def documents(store: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, read from the segments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(len(batch)):
                base, total, starts, chunks, bits, ranks = (batch.column(i)[row].as_py() for i in (0, 1, 3, 4, 5, 6))
                doc_ids, codes = batch.column(2)[row].values, Codes(chunks, bits, ranks)
                ends = [*starts[1:], total]
                sums = [zlib.crc32(codes.read(a, b).astype("<u4").tobytes()) for a, b in zip(starts, ends, strict=True)]
                columns = [doc_ids, pa.array([base + a for a in starts], pa.int64()), pa.array([b - a for a, b in zip(starts, ends, strict=True)], pa.int64()), pa.array(sums, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32"])

    kind = store.schema["first_doc"].dataType.simpleString()
    needed = store.select("first_token", "n_tokens", "doc_ids", "starts", "chunks", "bits", "ranks")
    return needed.mapInArrow(run, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long")


def read_tokens(store: DataFrame, start: int, stop: int) -> np.ndarray:
    """The ids at places ``start`` up to ``stop`` of all ids of an opened store.

    Only segments that hold some of them are read, and of these only the codes of those ids.
    """
    inside = store.filter((F.col("first_token") < stop) & (F.col("first_token") + F.col("n_tokens") > start))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(len(batch)):
                base, total, chunks, bits, ranks = (batch.column(i)[row].as_py() for i in range(5))
                ids = Codes(chunks, bits, ranks).read(max(0, start - base), min(total, stop - base))
                yield pa.RecordBatch.from_arrays([pa.array([base], pa.int64()), pa.array([ids.astype("<u4").tobytes()], pa.binary())], ["first_token", "ids"])

    found = inside.select("first_token", "n_tokens", "chunks", "bits", "ranks").mapInArrow(run, "first_token long, ids binary").orderBy("first_token").toArrow()
    return np.frombuffer(b"".join(found.column(1).to_pylist()), dtype="<u4")


def round_trip(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """Write a store below the shared folder and read every document back from it."""
    path = new_path(docs.sparkSession, "tokens")
    write(docs, path, tokenizer, end_id)
    return documents(open_store(docs.sparkSession, path))
