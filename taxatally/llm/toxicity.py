"""Toxicity of texts by a classifier with a counterfactual penalty.

A logistic model over the words of a text (each once, A-Z as a-z, without ASCII punctuation at
its ends). Identity terms are swapped for others of their group in the labelled texts, and a
change of the score is penalised, so that a group's mention by itself carries no weight.

The model is fitted on at most ``TRAIN_ROWS`` labelled rows, those smallest by a hash of their
id; which words it uses is decided from counts over these rows. Every text is scored whole.
Scores use the text alone.

Null and empty texts have no words and get the score of none. Labels other than 0 and 1 and
null ids are not learned from; a label given more than once counts as 1 if it ever is. Without any
usable label every score is 0.5. Repeated rows get equal scores; an empty table gives an empty
result. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .words import Piece, pieces, word_hashes

TRAIN_ROWS = 12_000
#: Words that the model uses, rows in which each must stand at least, strength of the ridge.
WORDS, SEEN, RIDGE = 400, 5, 0.5
#: Weight of the squared change of a score by a swap, against one labelled row.
SWAP_WEIGHT = 10.0
THRESHOLD = 0.3

#: Terms that name a group, in groups whose members can stand for each other.
IDENTITY_GROUPS: tuple[tuple[str, ...], ...] = (
    ("women", "men"), ("woman", "man"), ("girls", "boys"), ("she", "he"), ("female", "male"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "african", "european"),
    ("gay", "straight", "lesbian", "bisexual", "transgender", "queer"),
    ("immigrants", "refugees", "natives"), ("disabled", "deaf", "blind"), ("old", "young"),
    ("mujeres", "hombres"), ("femmes", "hommes"), ("frauen", "männer"),
)

_PUNCTUATION = np.zeros(256, dtype=bool)
_PUNCTUATION[[b for b in range(33, 127) if not chr(b).isalnum()]] = True


def trimmed_hashes(piece: Piece) -> np.ndarray:
    """Hash of each word without ASCII punctuation at its ends; 0 where nothing is left."""
    starts, ends = piece.starts.copy(), piece.ends.copy()
    for at, step, edge in ((ends, -1, -1), (starts, 1, 0)):
        open_ = np.arange(len(starts))
        while len(open_):
            open_ = open_[(starts[open_] < ends[open_]) & _PUNCTUATION[piece.data[np.clip(at[open_] + edge, 0, len(piece.data) - 1)]]]
            at[open_] += step
    return np.where(starts < ends, word_hashes(piece.data, starts, ends, lower=True), 0)


def term_hash(word: str) -> int:
    raw = np.frombuffer(word.encode(), np.uint8)
    return int(word_hashes(raw, np.array([0]), np.array([len(raw)]), lower=True)[0])


@dataclass(frozen=True)
class Model:
    words: np.ndarray  #: hashes, ascending
    weights: np.ndarray
    bias: float

    def scores(self, piece: Piece) -> np.ndarray:
        z = np.full(len(piece), self.bias)
        if len(self.words):
            hashes = trimmed_hashes(piece)
            at = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
            hit = np.flatnonzero(self.words[at] == hashes)
            text = np.searchsorted(piece.per_text, hit, "right") - 1
            for key in np.unique(text * len(self.words) + at[hit]):
                z[key // len(self.words)] += self.weights[key % len(self.words)]
        return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def _swaps(groups: Sequence[Sequence[str]]) -> dict[int, list[int]]:
    """Of each identity term the terms that can stand for it."""
    out: dict[int, list[int]] = {}
    for group in groups:
        hashes = [term_hash(w) for w in group]
        for h in hashes:
            out.setdefault(h, []).extend(x for x in hashes if x != h)
    return out


def _newton(x: np.ndarray, y: np.ndarray, change: np.ndarray, ridge: float, swap_weight: float) -> tuple[np.ndarray, float]:
    """Weights and bias of the penalised logistic fit.

    Minimises the log loss + ridge / 2 * |w|^2 + swap_weight / 2 * sum of (change of score)^2.
    """
    design = np.column_stack((x, np.ones(len(x))))
    fixed = np.diag(np.append(np.full(x.shape[1], ridge), 1e-6))
    if len(change):
        fixed[:-1, :-1] += swap_weight * change.T @ change
    w = np.zeros(design.shape[1])
    w[-1] = np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))

    def loss(w: np.ndarray) -> float:
        z = design @ w
        return float(np.logaddexp(0, z).sum() - y @ z + w @ fixed @ w / 2)

    now = loss(w)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -35, 35)))
        gradient = design.T @ (p - y) + fixed @ w
        step = np.linalg.solve(design.T @ (design * (p * (1 - p))[:, None]) + fixed, gradient)
        size = 1.0
        while loss(w - size * step) > now and size > 1e-6:
            size /= 2
        w = w - size * step
        before, now = now, loss(w)
        if before - now < 1e-9 * max(1.0, abs(now)):
            break
    return w[:-1], float(w[-1])


def fit(labelled: DataFrame, rows: int = TRAIN_ROWS, groups: Sequence[Sequence[str]] = IDENTITY_GROUPS, swap_weight: float = SWAP_WEIGHT) -> Model:
    """The model of ``labelled`` (``text, label``); the caller bounds its rows by ``rows``."""

    def of_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, labels = 0, batch.column(1)
            for piece in pieces(batch.column(0)):
                hashes = trimmed_hashes(piece)
                found = [np.setdiff1d(hashes[a:b], [0]).astype(np.uint64).view(np.int64) for a, b in zip(piece.per_text, piece.per_text[1:])]
                yield pa.RecordBatch.from_arrays([labels.slice(first, len(piece)), pa.array(found, pa.list_(pa.int64()))], ["label", "words"])
                first += len(piece)

    spark = labelled.sparkSession
    held = stored(labelled.select("text", F.col("label").cast("int").alias("label")).limit(rows).mapInArrow(of_words, "label int, words array<long>"), "labelled")
    n, positive = (int(v or 0) for v in held.agg(F.count("*"), F.sum("label")).first())
    if not 0 < n:
        return Model(np.empty(0, np.uint64), np.empty(0), 0.0)
    counts = held.select("label", F.explode("words").alias("word")).groupBy("word").agg(F.sum("label").alias("a"), F.count("*").alias("m"))
    # The larger the chi-square of a word, the more its rows' labels differ from the rest.
    off = F.col("a") - F.col("m") * F.lit(positive / n)
    best = counts.filter(F.col("m") >= SEEN).withColumn("chi", off * off * F.lit(float(n)) / (F.col("m") * (n - F.col("m") + 1.0))).orderBy(F.desc("chi"), "word").limit(WORDS)
    chosen = {int(np.int64(r.word).view(np.uint64)) for r in best.select("word").collect()}
    swaps = _swaps(groups)
    words = np.array(sorted(chosen | set(swaps)), dtype=np.uint64)
    place = {int(h): i for i, h in enumerate(words)}
    listed = spark.createDataFrame(pa.table({"word": pa.array(words.view(np.int64)), "place": pa.array(np.arange(len(words)), pa.int32())}))
    # At most WORDS and the identity terms, so the broadcast is bounded.
    rows_of = held.withColumn("row", F.monotonically_increasing_id())
    present = rows_of.select("row", F.explode("words").alias("word")).join(F.broadcast(listed), "word").groupBy("row").agg(F.collect_list("place").alias("places"))
    got = stored(rows_of.select("row", "label").join(present, "row", "left").select("label", F.coalesce("places", F.array().cast("array<int>")).alias("places")), "design").toArrow()
    x = np.zeros((n, len(words)))
    change = []
    for i, at in enumerate(got.column("places").to_pylist()):
        x[i, at] = 1
        for p in at:
            others = swaps.get(int(words[p]), ())
            for h in others:
                row = np.zeros(len(words))
                row[p], row[place[h]] = -1, (0 if place[h] in at else 1)
                change.append(row / len(others) ** 0.5)
    y = got.column("label").to_numpy().astype(float)
    w, bias = _newton(x, y, np.array(change), RIDGE, swap_weight)
    return Model(words, w, bias)


def fold():
    """crc32 of the id as text, mod 4."""
    return F.crc32(F.col("doc_id").cast("string")) % 4


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, **options) -> Model:
    """Fit on labelled rows that are not held out."""
    known = labels.filter("toxic in (0, 1) and doc_id is not null").filter(fold() != 2).groupBy("doc_id").agg(F.max("toxic").alias("label"))
    some = stored(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows), "training_ids")
    # At most ``rows`` rows, so the broadcast is bounded.
    return fit(docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(some), "doc_id").select("text", "label"), rows, **options)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [model.scores(p) for p in pieces(batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.concatenate(scores) if scores else np.empty(0))], ["doc_id", "held_out", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.coalesce(fold() == 2, F.lit(False)).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double").withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
