"""Tokens of two tokenizers aligned where they end at the same byte.

A is a byte-level BPE file, whose texts get a space in front; B is a sentencepiece BPE model
that adds this space itself. Both are read as bytes of ``space + text``. Byte offsets where a
token of A and one of B end are cuts; between neighbouring cuts stands a group of tokens of both.

Cuts are found by divide and conquer: of an interval of A tokens, a common end as near to its
middle as can be is located by bisecting the ends of B, and both halves are treated the same
way. An interval without an inner common end is a group. All intervals of one depth, of many
texts, are treated together, and candidates further from the middle are tried in windows that
double, so a long interval without cuts costs its length once.

Tokens that end together are linked. Of two byte strings that end together the shorter is a
suffix of the longer, so the pairs of ids that can be linked at all follow from the vocabularies
(about 300,000); they are numbered, and counts over the corpus are one number for each.

Null and empty texts have no tokens, nor do texts of which one tokenizer doesn't give back the
bytes (such as texts with U+2581). Special tokens in texts are plain text. Every row, whether
repeated or not, is aligned and counted on its own; a null id stays null; an empty table gives
an empty result; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .bpe import byte_characters
from .chunks import Memory, ragged, slices, totals
from .words import bound_batches

#: Bytes that are white space for neither tokenizer, whatever stands around them.
_PLAIN = np.zeros(256, dtype=bool)
_PLAIN[0x21:0x7F] = True


def chunk_bounds(data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of the chunks of texts: cuts before spaces where both tokenizers begin anew.

    The space must have a visible ASCII character on one side and no space before it. Then no
    pre-token of A runs over it, nor a piece of B, as no piece has a space behind other characters.
    """
    if not len(data):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    at = np.flatnonzero(data == 0x20)
    before, after = data[np.maximum(at - 1, 0)], data[np.minimum(at + 1, len(data) - 1)]
    at = at[(before != 0x20) & (_PLAIN[before] | _PLAIN[after] & (before >= 0x80))]
    starts = np.unique(np.concatenate((edges[:-1][np.diff(edges) > 0], at)))
    return starts, np.append(starts[1:], edges[-1])


def common_ends(a_ends: np.ndarray, b_ends: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """Indexes of the A tokens that end where a B token does, in ascending order.

    ``texts`` are the edges of the texts in A tokens; the last tokens of a text end together.
    Ends ascend over all texts.
    """
    low, high = texts[:-1], texts[1:] - 1  # candidates are low up to high, high itself excluded
    found = [high[high >= low]]
    low, high = low[high > low], high[high > low]
    while len(low):
        middle = (low + high) >> 1
        cut = np.full(len(low), -1)
        open_ = np.arange(len(low))
        near, width = 0, 1
        while len(open_):
            # Windows at distances near to near + width - 1 on both sides of the middle.
            m, a, b = middle[open_], low[open_], high[open_]
            left0, left1 = np.maximum(m - near - width + 1, a), m - near + 1
            right0, right1 = m + max(near, 1), np.minimum(m + near + width, b)
            starts = np.concatenate((left0, right0))
            sizes = np.maximum(np.concatenate((left1, right1)) - starts, 0)
            candidate = ragged(starts, sizes)
            owner = np.repeat(np.concatenate((open_, open_)), sizes)
            place = np.searchsorted(b_ends, a_ends[candidate])
            hit = b_ends[place] == a_ends[candidate]
            candidate, owner = candidate[hit], owner[hit]
            order = np.lexsort((np.abs(candidate - middle[owner]), owner))
            candidate, owner = candidate[order], owner[order]
            nearest = np.append(True, owner[1:] != owner[:-1]) if len(owner) else np.zeros(0, bool)
            cut[owner[nearest]] = candidate[nearest]
            near, width = near + width, 2 * width
            open_ = open_[(cut[open_] < 0) & ((m - near >= a) | (m + near < b))]
        done = cut >= 0
        cut, low, high = cut[done], low[done], high[done]
        found.append(cut)
        low, high = np.concatenate((low, cut + 1)), np.concatenate((cut, high))
        some = high > low
        low, high = low[some], high[some]
    return np.sort(np.concatenate(found))


@dataclass
class Aligned:
    """Some texts: ids of both sides, their edges by text, and the last tokens of all groups."""

    first: int
    a_ids: np.ndarray
    b_ids: np.ndarray
    a_edges: np.ndarray
    b_edges: np.ndarray
    a_cuts: np.ndarray
    b_cuts: np.ndarray
    cut_edges: np.ndarray

    def __len__(self) -> int:
        return len(self.a_edges) - 1


class Aligner:
    """Both tokenizers, the bytes of their tokens and the numbered pairs that can be linked."""

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks share the cores already
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_file=b_path)
        byte = {c: i for i, c in enumerate(byte_characters())}
        special = set(self.a.get_added_tokens_decoder())
        vocab = self.a.get_vocab(with_added_tokens=False)
        a_bytes = {i: bytes(byte[c] for c in token) for token, i in vocab.items() if i not in special}
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if any("▁" in p.lstrip("▁") for p in pieces):
            raise ValueError("a piece goes over the space between words")
        b_bytes = {i: bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces) if not (self.b.is_control(i) or self.b.is_unknown(i))}
        self.a_size, self.b_size = max(vocab.values()) + 1, len(pieces)
        self.a_length, self.b_length = np.zeros(self.a_size, np.int64), np.zeros(self.b_size, np.int64)
        for lengths, known in ((self.a_length, a_bytes), (self.b_length, b_bytes)):
            for i, x in known.items():
                lengths[i] = len(x)
        self.b_bytes = b_bytes
        self.space = self.b.piece_to_id("▁")
        self.memory = Memory(3, most=10_000_000)
        a_of: dict[bytes, list[int]] = {}
        b_of: dict[bytes, list[int]] = {}
        for of, known in ((a_of, a_bytes), (b_of, b_bytes)):
            for i, x in known.items():
                of.setdefault(x, []).append(i)
        keys = {a * self.b_size + b for x, ids in a_of.items() for k in range(len(x)) for b in b_of.get(x[k:], ()) for a in ids}
        keys |= {a * self.b_size + b for x, ids in b_of.items() for k in range(len(x)) for a in a_of.get(x[k:], ()) for b in ids}
        #: Every pair of ids that can be linked as ``a * b_size + b``, ascending; its place is its number.
        self.pairs = np.array(sorted(keys), dtype=np.int64)

    def _sides(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids of both for a text that begins with a space."""
        a = self.a.encode_batch_fast([text], add_special_tokens=False)[0].ids
        # B adds the space that a text begins with; it gives nothing at all for nothing else.
        return np.array(a, np.uint32), np.array(self.b.encode(text[1:]) or [self.space], np.uint32)

    def _one(self, chunk: bytes) -> tuple[np.ndarray, np.ndarray, bool]:
        a, b = self._sides(chunk.decode())
        return a, b, int(self.a_length[a].sum()) == len(chunk) and b"".join(self.b_bytes.get(i, b"") for i in b.tolist()) == chunk

    def _together(self, chunks: list[bytes], between: bytes) -> list[tuple[np.ndarray, np.ndarray, bool]]:
        """Chunks that both tokenizers part from ``between``, or from each other, in any order."""
        raw = between.join(chunks) + between
        stops = np.cumsum(np.fromiter(map(len, chunks), np.int64, len(chunks)) + len(between))
        sides, cuts = self._sides(raw.decode()), []
        for ids, lengths in zip(sides, (self.a_length, self.b_length), strict=True):
            ends = np.cumsum(lengths[ids])
            inner = np.searchsorted(ends, stops - len(between))
            if ends[-1] != len(raw) or (ends[inner] != stops - len(between)).any():
                return list(map(self._one, chunks))
            begins = np.append(0, np.searchsorted(ends, stops)[:-1] + 1)
            cuts.append((begins, inner + 1))
        if b"".join(map(self.b_bytes.__getitem__, sides[1].tolist())) != raw:
            return list(map(self._one, chunks))
        parts = [[ids[x:y] for x, y in zip(*map(np.ndarray.tolist, cut), strict=True)] for ids, cut in zip(sides, cuts, strict=True)]
        return [(x, y, True) for x, y in zip(*parts, strict=True)]

    def _encode(self, chunks: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
        # Behind a visible ASCII character a space always begins a token; behind other letters it
        # does if a visible one follows.
        kinds: tuple[list[int], list[int], list[int]] = ([], [], [])
        for i, c in enumerate(chunks):
            kinds[0 if _PLAIN[c[-1]] else 1 if c[-1] >= 0x80 else 2].append(i)
        found: list[tuple[np.ndarray, np.ndarray, bool]] = [None] * len(chunks)
        for kind, between in zip(kinds[:2], (b"", b" ."), strict=True):
            for first in range(0, len(kind), 500):
                some = kind[first : first + 500]
                for i, x in zip(some, self._together([chunks[i] for i in some], between), strict=True):
                    found[i] = x
        for i in kinds[2]:
            found[i] = self._one(chunks[i])
        lists = [[f[side] for f in found] for side in (0, 1)]
        good = np.array([f[2] for f in found], np.uint32)
        return [*((np.fromiter(map(len, x), np.int64, len(x)), np.concatenate(x)) for x in lists), (np.ones(len(chunks), np.int64), good)]

    def __call__(self, texts: pa.Array) -> Iterator[Aligned]:
        """Align all texts, some at a time."""
        filled = pc.fill_null(texts, "")
        # Chunks begin with a space; a text that is empty gets none.
        spaced = pc.if_else(pc.equal(pc.binary_length(filled), 0), "", pc.binary_join_element_wise("", filled, " "))
        for first, data, edges in slices(spaced):
            starts, ends = chunk_bounds(data, edges)
            of_text = np.searchsorted(starts, edges)
            if not len(starts):
                none, zero = np.empty(0, np.int64), np.zeros(len(edges), np.int64)
                yield Aligned(first, none, none, zero, zero, none, none, zero)
                continue
            (a_sizes, a_ids), (b_sizes, b_ids), (_, good) = self.memory.look_up(data, starts, ends, self._encode)
            whole = totals(1 - good.astype(np.int64), of_text) == 0
            if not whole.all():
                kept = np.repeat(whole, np.diff(of_text))
                a_ids, b_ids = a_ids[np.repeat(kept, a_sizes)], b_ids[np.repeat(kept, b_sizes)]
                a_sizes, b_sizes = np.where(kept, a_sizes, 0), np.where(kept, b_sizes, 0)
            a_edges = np.concatenate(([0], np.cumsum(totals(a_sizes, of_text))))
            b_edges = np.concatenate(([0], np.cumsum(totals(b_sizes, of_text))))
            a_ends, b_ends = np.cumsum(self.a_length[a_ids]), np.cumsum(self.b_length[b_ids])
            a_cuts = common_ends(a_ends, b_ends, a_edges)
            yield Aligned(first, a_ids, b_ids, a_edges, b_edges, a_cuts, np.searchsorted(b_ends, a_ends[a_cuts]), np.searchsorted(a_cuts, a_edges))

    def links(self, x: Aligned) -> np.ndarray:
        """Number of the pair of ids that ends each group."""
        return np.searchsorted(self.pairs, x.a_ids[x.a_cuts].astype(np.int64) * self.b_size + x.b_ids[x.b_cuts]).astype(np.int32)


@lru_cache(maxsize=2)
def load(a_path: str, b_path: str) -> Aligner:
    return Aligner(a_path, b_path)


def _lists(values: np.ndarray, edges: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(values, kind))


def aligned(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """``doc_id, a_ids, b_ids, a_stops, b_stops`` of every row.

    Group g holds the A tokens up to ``a_stops[g]`` and the B tokens up to ``b_stops[g]`` that
    come after those of group g - 1.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        align = load(a_path, b_path)
        for batch in batches:
            for x in align(batch.column(1)):
                groups = np.diff(x.cut_edges)
                stops = [cuts + 1 - np.repeat(edges[:-1], groups) for cuts, edges in ((x.a_cuts, x.a_edges), (x.b_cuts, x.b_edges))]
                lists = [_lists(v, e, pa.int32()) for v, e in ((x.a_ids, x.a_edges), (x.b_ids, x.b_edges), (stops[0], x.cut_edges), (stops[1], x.cut_edges))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(x.first, len(x)), *lists], ["doc_id", "a_ids", "b_ids", "a_stops", "b_stops"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, a_ids array<int>, b_ids array<int>, a_stops array<int>, b_stops array<int>"
    return bound_batches(docs).select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


class GroupText:
    """Groups written as ``a1,a2|b1;a3|b2,b3``."""

    def __init__(self, most: int):
        self.forms = pa.array([f"{i}{end}" for end in ",|;" for i in range(most)])
        self.most = most

    def __call__(self, x: Aligned) -> tuple[memoryview, np.ndarray]:
        """The groups of all texts in a row, and where each text ends there."""
        a_last, b_last = np.zeros(len(x.a_ids), bool), np.zeros(len(x.b_ids), bool)
        a_last[x.a_cuts], b_last[x.b_cuts] = True, True
        a_group, b_group = np.cumsum(a_last) - a_last, np.cumsum(b_last) - b_last
        b_before, a_before = np.append(-1, x.b_cuts) + 1, np.append(x.a_cuts, -1) + 1
        form = np.empty(len(x.a_ids) + len(x.b_ids), np.int64)
        form[np.arange(len(x.a_ids)) + b_before[a_group]] = x.a_ids + self.most * a_last
        form[np.arange(len(x.b_ids)) + a_before[b_group]] = x.b_ids + 2 * self.most * b_last
        written = self.forms.take(pa.array(form))
        _, where, data = written.buffers()
        ends = np.frombuffer(where, np.int32)[: len(form) + 1]
        return memoryview(data) if data is not None else memoryview(b""), ends[x.a_edges + x.b_edges]


def digests(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, groups_sha256, links`` of every row.

    ``links`` has the number of the pair of ids of every link of the text, in order.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        align = load(a_path, b_path)
        write = GroupText(max(align.a_size, align.b_size))
        for batch in batches:
            for x in align(batch.column(1)):
                text, ends = write(x)
                sums = [hashlib.sha256(text[a : b - 1]).hexdigest() if b > a else "" for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
                counts = [pa.array(np.diff(e), pa.int64()) for e in (x.a_edges, x.b_edges, x.cut_edges)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(x.first, len(x)), *counts, pa.array(sums, pa.string()), _lists(align.links(x), x.cut_edges, pa.int32())], names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_a long, n_b long, n_groups long, groups_sha256 string, links array<int>"
    names = [f.split()[0] for f in schema.split(", ")]
    return bound_batches(docs).select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def link_counts(rows: DataFrame, n_pairs: int) -> np.ndarray:
    """How many links of all rows hold each pair; tasks add up before anything is sent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(n_pairs, np.int64)
        for batch in batches:
            counts += np.bincount(batch.column(0).flatten().to_numpy(), minlength=n_pairs)
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(counts[some])], ["pair", "n"])

    # A row for each pair at most, and their number is fixed by the vocabularies.
    summed = rows.select("links").mapInArrow(run, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(n_pairs, np.int64)
    out[summed.column(0).to_numpy()] = summed.column(1).to_numpy()
    return out


def scored(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Digest of the alignment of every row and of how usual its links are in all rows.

    ``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``: ``n_best`` counts
    the links whose pair is, over the corpus, the most frequent of its B id, ties included;
    ``count_sum`` adds up the counts of the pairs of all links.
    """
    rows = stored(digests(docs, a_path, b_path), "alignment")
    aligner = load(a_path, b_path)
    counts = link_counts(rows, len(aligner.pairs))
    b_of = aligner.pairs % aligner.b_size
    best = np.zeros(aligner.b_size, np.int64)
    np.maximum.at(best, b_of, counts)
    shared = docs.sparkSession.sparkContext.broadcast((counts, counts == best[b_of]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, is_best = shared.value
        for batch in batches:
            links = batch.column(6)
            edges = np.concatenate(([0], np.cumsum(pc.list_value_length(links).to_numpy())))
            at = links.flatten().to_numpy()
            sums = [pa.array(totals(v[at], edges), pa.int64()) for v in (is_best, counts)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(5)), *sums, batch.column(5)], names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    names = [f.split()[0] for f in schema.split(", ")]
    # Of the tokens that end at a cut each side has one, so links and groups are as many.
    return rows.select("doc_id", "n_a", "n_b", "n_groups", F.size("links").cast("long").alias("n_links"), "groups_sha256", "links").mapInArrow(run, schema)
