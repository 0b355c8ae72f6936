"""Passages that repeat across documents, found at places that content selects.

Of every ``LENGTH`` words in a row, the place of the smallest hash of ``GRAM`` words is selected. Two
equal stretches of ``LENGTH`` words select the same place in them, so none is lost. Places are grouped
by the hash of their ``GRAM`` words; around those that stand in several texts, all stretches of
``LENGTH`` words that selected them are grouped by theirs. Stretches found are joined to spans. No
suffix is put in order and no common length is computed: hash groups replace both.

A task settles what repeats among its own texts and passes on one row for it, so a passage that
very many texts share doesn't meet in one task.

Words are compared as they are. A span is counted in words, from ``start`` up to ``stop``. A
text that stands in several rows repeats as a whole. What repeats only inside one text doesn't
count. Texts of fewer than ``LENGTH`` words, null and empty ones have no spans. Null and
repeated doc_ids are no hindrance: texts are told apart by a 64-bit hash. An empty table gives an
empty result. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .words import Piece, grams, mix, pieces

LENGTH, GRAM = 50, 25
#: Rows that a task compares among themselves before it passes them on.
HOLD = 1 << 19
#: Buckets of doc_ids by which the second scan drops most texts it doesn't need; at most so many
#: rows are broadcast.
BUCKETS = 1 << 20

_ROWS = "key long, text long, place int, sure boolean"


def _selected(piece: Piece) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of all stretches of ``LENGTH`` words, the places they select, hashes of ``GRAM`` words."""
    hashes = grams(piece.hashes(), GRAM)
    if len(hashes) <= LENGTH - GRAM:
        return np.empty(0, np.int64), np.empty(0, np.int64), hashes
    starts = np.arange(len(hashes) - (LENGTH - GRAM))
    text = np.searchsorted(piece.per_text, starts, "right") - 1
    starts = starts[starts + LENGTH <= piece.per_text[text + 1]]
    near = np.lib.stride_tricks.sliding_window_view(hashes, LENGTH - GRAM + 1)
    return starts, starts + near[starts].argmin(axis=1), hashes


class _Sink:
    """Collects rows of a task; finds what repeats among them before they are passed on."""

    def __init__(self):
        self.held: list[tuple] = []
        self.rows = 0

    def add(self, key: np.ndarray, text: np.ndarray, place: np.ndarray) -> bool:
        self.held.append((key, text, place))
        self.rows += len(key)
        return self.rows >= HOLD

    def flush(self) -> pa.RecordBatch:
        key, text, place = (np.concatenate(x) for x in zip(*self.held, strict=True))
        self.held, self.rows = [], 0
        order = np.lexsort((place, text, key))
        key, text, place = key[order], text[order], place[order]
        first = np.append(True, key[1:] != key[:-1])
        group = np.cumsum(first) - 1
        begin = np.flatnonzero(first)
        end = np.append(begin[1:], len(key))
        sure = (text[begin] != text[end - 1])[group]
        # One row of each group goes on under its key, the sure ones under a key of their own.
        aside = mix(text.view(np.uint64) * np.uint64(31) + place.astype(np.uint64)).view(np.int64)
        rows = np.flatnonzero(sure)
        on = np.flatnonzero(~sure | first)
        columns = (np.concatenate((key[on], aside[rows])), np.concatenate((text[on], text[rows])), np.concatenate((place[on], place[rows])).astype(np.int32), np.append(np.zeros(len(on), bool), np.ones(len(rows), bool)))
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["key", "text", "place", "sure"])


def _repeated(rows: DataFrame) -> DataFrame:
    """``text, place`` of the rows whose key stands in another text too, neighbours in key order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = tuple(np.empty(0, t) for t in (np.int64, np.int64, np.int32, bool))

        def found(key, text, place, sure) -> pa.RecordBatch | None:
            if not len(key):
                return None
            first = np.append(True, key[1:] != key[:-1])
            begin = np.flatnonzero(first)
            end = np.append(begin[1:], len(key))
            hit = np.flatnonzero((text[begin] != text[end - 1])[np.cumsum(first) - 1] | sure)
            return pa.RecordBatch.from_arrays([pa.array(text[hit]), pa.array(place[hit])], ["text", "place"]) if len(hit) else None

        for batch in batches:
            key, text, place, sure = (np.concatenate((r, batch.column(i).to_numpy(zero_copy_only=False))) for i, r in enumerate(rest))
            cut = int(np.searchsorted(key, key[-1], "left")) if len(key) else 0
            if len(key) and text[cut] != text[-1]:
                # The last group repeats already; its first row stands for it from here on.
                out = found(key, text, place, sure)
                rest = tuple(x[cut : cut + 1] for x in (key, text, place, sure))
            else:
                out = found(key[:cut], text[:cut], place[:cut], sure[:cut])
                rest = tuple(x[cut:] for x in (key, text, place, sure))
            if out is not None:
                yield out
        out = found(*rest)
        if out is not None:
            yield out

    ordered = rows.repartition("key").sortWithinPartitions("key", "text")
    return ordered.mapInArrow(run, "text long, place int")


def _suffixes(docs: DataFrame) -> DataFrame:
    """The suffixes of all texts under the hash of their first words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sink, seen = _Sink(), set()
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            for piece in pieces(batch.column(1)):
                _, places, hashes = _selected(piece)
                places = np.unique(places)
                text = np.searchsorted(piece.per_text, places, "right") - 1
                key = keys[piece.first : piece.first + len(piece)]
                new = np.array([k not in seen and not seen.add(k) for k in key.tolist()], dtype=bool)
                places, text = places[new[text]], text[new[text]]
                if sink.add(hashes[places].view(np.int64), key[text], places - piece.per_text[text]):
                    yield sink.flush()
                    seen.clear()
        if sink.rows:
            yield sink.flush()

    return docs.select("text_key", "text").mapInArrow(run, _ROWS)


def _extensions(texts: DataFrame) -> DataFrame:
    """All stretches that selected one of the ``places`` of a text, under their hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sink = _Sink()
        for batch in batches:
            keys, known = batch.column(0).to_numpy(zero_copy_only=False), batch.column(2)
            for piece in pieces(batch.column(1)):
                starts, places, hashes = _selected(piece)
                text = np.searchsorted(piece.per_text, starts, "right") - 1
                sizes = np.append(0, np.cumsum([len(known[piece.first + i]) for i in range(len(piece))]))
                kept = known.slice(piece.first, len(piece)).flatten().to_numpy(zero_copy_only=False) + np.repeat(piece.per_text[:-1], np.diff(sizes))
                mask = np.zeros(len(piece.starts) + 1, dtype=bool)
                mask[kept] = True
                on = mask[places]
                starts, text = starts[on], text[on]
                key = mix(hashes[starts] * np.uint64(0x9E3779B97F4A7C15) + hashes[starts + LENGTH - GRAM])
                if sink.add(key.view(np.int64), keys[piece.first : piece.first + len(piece)][text], starts - piece.per_text[text]):
                    yield sink.flush()
        if sink.rows:
            yield sink.flush()

    return texts.select("text_key", "text", "places").mapInArrow(run, _ROWS)


def _joined(starts: DataFrame) -> DataFrame:
    """``text, spans`` from ``text, starts`` (places where a repeated stretch begins)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = []
            for x in batch.column(1):
                at = np.unique(x.values.to_numpy())
                gap = np.flatnonzero(np.diff(at) > LENGTH)
                spans.append([{"start": a, "stop": b + LENGTH} for a, b in zip(at[np.append(0, gap + 1)].tolist(), at[np.append(gap, len(at) - 1)].tolist(), strict=True)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())])))], ["text", "spans"])

    return starts.mapInArrow(run, "text long, spans array<struct<start:int,stop:int>>")


def _counted(docs: DataFrame) -> DataFrame:
    """``text_key, doc_id, n_words`` of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = [np.diff(p.per_text) for p in pieces(batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.concatenate(counts) if counts else np.empty(0, np.int64))], ["text_key", "doc_id", "n_words"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("text_key", "doc_id", "text").mapInArrow(run, f"text_key long, doc_id {kind}, n_words long")


def repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, repeated_words and the spans of repeated passages of every row."""
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("text_key", F.xxhash64("text"))
    bucket = F.pmod(F.xxhash64("doc_id"), F.lit(BUCKETS))
    counted = stored(_counted(rows), "counted")
    texts = counted.groupBy("text_key").agg(F.count("*").alias("copies"), F.min(bucket).alias("bucket"))

    places = stored(_repeated(_suffixes(rows)).groupBy("text").agg(F.collect_set("place").alias("places")), "places")
    wanted = stored(places.join(texts, F.col("text") == F.col("text_key")).select("bucket").distinct(), "wanted")
    # At most BUCKETS rows, so the broadcast is bounded.
    near = rows.withColumn("bucket", bucket).join(F.broadcast(wanted), "bucket", "left_semi").select("text_key", "text")
    near = near.join(places.select(F.col("text").alias("text_key"), "places"), "text_key")
    found = _repeated(_extensions(near)).groupBy("text").agg(F.collect_set("place").alias("starts"))
    spans = stored(_joined(found), "spans").withColumnRenamed("text", "text_key")

    out = counted.join(texts.filter("copies > 1").select("text_key", "copies"), "text_key", "left").join(spans, "text_key", "left")
    whole = F.array(F.struct(F.lit(0).alias("start"), F.col("n_words").cast("int").alias("stop")))
    none = F.array().cast("array<struct<start:int,stop:int>>")
    out = out.withColumn("spans", F.when((F.col("copies") > 1) & (F.col("n_words") >= LENGTH), whole).otherwise(F.coalesce("spans", none)))
    total = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["stop"] - x["start"])
    return out.select("doc_id", "n_words", total.alias("repeated_words"), "spans")
