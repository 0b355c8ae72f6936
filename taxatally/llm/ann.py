"""Nearest neighbours by multiprobe p-stable hashing.

Vectors are scaled to length one; a table hashes them by ``width`` wide stripes along ``bits``
random directions. A query looks into its own bucket and into the buckets next to it, in the
order of the expected success of the perturbation; the order of the perturbation sets is made
once, from the expected distances to the stripe edges, and mapped to each query by sorting its
own distances. Candidates of all tables are put together and ranked by the exact cosine.

Where the fit takes as many probes as a table has buckets around a query (the last options), all of them
are looked at and the order plays no part; on evenly spread vectors that is nearly a full scan.

Rows are spread over shards by a hash of their id; a shard builds its tables in one task and
the queries pass by it in a stream. Every row is indexed; a bucket has no cap. A hot vector
is spread over the shards like any other rows.

The parameters are fitted on a sample of at most ``SAMPLE`` rows: the first of ``OPTIONS``
that finds ``AIM`` of the true neighbours inside the sample, else the last. More rows bring
neighbours nearer, so recall over all rows is higher than in the sample.

Vectors that are null, zero, of another length than most of the sample's, or that hold null
or non-finite components take no part, nor do rows without an id. A query never finds rows of
its own id; a repeated id counts once for each different vector. Ties fall to the smaller id.
Fewer rows than asked for give fewer neighbours; an empty table gives an empty result. Extra
columns are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLE, SAMPLE_QUERIES, AIM = 4096, 64, 0.97
#: Bytes of vectors in a shard, and shards at least.
SHARD, SHARDS = 1 << 25, 16


@dataclass(frozen=True)
class Option:
    bits: int
    width: float
    tables: int
    probes: int


OPTIONS = [Option(10, 0.6, 8, 64), Option(8, 0.8, 12, 128), Option(6, 0.8, 16, 512), Option(6, 0.8, 24, 512), Option(5, 0.9, 28, 243), Option(4, 1.2, 32, 81), Option(3, 2.0, 32, 27)]


def perturbations(bits: int, probes: int) -> np.ndarray:
    """The ``probes`` best sets of perturbations as rows of 0/1 over ranked stripe edges.

    Ranks go by the distance to the edge, ``2 * bits`` of them; rank j and its mirror image are
    the two sides of one direction and exclude each other. The empty set comes first.
    """
    m = bits
    j = np.arange(1, m + 1)
    near = j * (j + 1) / (4.0 * (m + 1) * (m + 2))
    mirrored = np.arange(m + 1, 2 * m + 1)
    far = 1 - (2 * m + 1 - mirrored) / (m + 1) + (2 * m + 1 - mirrored) * (2 * m + 2 - mirrored) / (4.0 * (m + 1) * (m + 2))
    score = np.concatenate((near, far))
    rows, heap = [()], [(score[0], (0,))]
    while heap and len(rows) < probes:
        total, chosen = heapq.heappop(heap)
        last = chosen[-1]
        if last + 1 < 2 * m:
            heapq.heappush(heap, (total - score[last] + score[last + 1], (*chosen[:-1], last + 1)))
            heapq.heappush(heap, (total + score[last + 1], (*chosen, last + 1)))
        if not any(2 * m - 1 - x in chosen for x in chosen):
            rows.append(chosen)
    out = np.zeros((len(rows), 2 * m), dtype=np.int64)
    for i, chosen in enumerate(rows):
        out[i, list(chosen)] = 1
    return out


class Hashes:
    """Directions, offsets and probing order of all tables, the same for one seed everywhere."""

    def __init__(self, option: Option, dim: int, seed: int = 0):
        self.option, rng = option, np.random.default_rng(seed)
        self.directions = rng.standard_normal((dim, option.tables * option.bits)) / option.width
        self.offsets = rng.random(option.tables * option.bits)
        self.weights = rng.integers(-(2**62), 2**62, option.bits)
        self.sets = perturbations(option.bits, option.probes)

    def places(self, units: np.ndarray) -> np.ndarray:
        return (units @ self.directions + self.offsets).reshape(len(units), self.option.tables, self.option.bits)

    def codes(self, units: np.ndarray) -> np.ndarray:
        """Bucket of each row in each table."""
        return np.floor(self.places(units)).astype(np.int64) @ self.weights

    def probes(self, unit: np.ndarray) -> np.ndarray:
        """Buckets to look into, by table, in order of expected success."""
        place = self.places(unit[None])[0]
        low = np.floor(place)
        inside = place - low
        edges = np.concatenate((inside, 1 - inside), axis=1)
        order = np.argsort(edges, axis=1, kind="stable")
        change = np.concatenate((-self.weights, self.weights))[order]
        return (low.astype(np.int64) @ self.weights)[:, None] + change @ self.sets.T


class Shard:
    """Some vectors and their tables."""

    def __init__(self, hashes: Hashes, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.hashes, self.ids, self.vectors = hashes, ids[order], vectors[order]
        self.norms = np.sqrt((self.vectors * self.vectors).sum(axis=1))
        codes = hashes.codes(self.vectors / self.norms[:, None])
        self.rows = np.argsort(codes, axis=0, kind="stable").T
        self.codes = np.take_along_axis(codes.T, self.rows, axis=1)

    def nearest(self, own: int, vector: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and exact cosines of the ``k`` nearest candidates, ties to the smaller id."""
        norm = np.sqrt((vector * vector).sum())
        found = np.zeros(len(self.ids), dtype=bool)
        for codes, rows, probes in zip(self.codes, self.rows, self.hashes.probes(vector / norm), strict=True):
            begin, end = np.searchsorted(codes, probes, "left"), np.searchsorted(codes, probes, "right")
            some = end > begin
            mark = np.zeros(len(rows) + 1, dtype=np.int64)
            np.add.at(mark, begin[some], 1)
            np.add.at(mark, end[some], -1)
            found[rows[np.cumsum(mark[:-1]) > 0]] = True
        found &= self.ids != own
        at = np.flatnonzero(found)
        # Row by row, so that equal vectors get equal scores.
        score = (self.vectors[at] * vector).sum(axis=1) / (self.norms[at] * norm)
        best = np.lexsort((self.ids[at], -score))[:k]
        return self.ids[at][best], score[best]


def fit(ids: np.ndarray, vectors: np.ndarray, k: int) -> Option:
    """The first option whose recall inside the sample reaches ``AIM``."""
    if len(ids) < 2:
        return OPTIONS[0]
    norms = np.sqrt((vectors * vectors).sum(axis=1))
    asked = np.linspace(0, len(ids) - 1, min(SAMPLE_QUERIES, len(ids))).astype(int)
    truth = []
    for q in asked:
        score = (vectors * vectors[q]).sum(axis=1) / (norms * norms[q])
        score[ids == ids[q]] = -2
        truth.append(set(ids[np.lexsort((ids, -score))[:k]].tolist()))
    for option in OPTIONS:
        shard = Shard(Hashes(option, vectors.shape[1]), ids, vectors)
        hits = [len(t & set(shard.nearest(ids[q], vectors[q], k)[0].tolist())) / max(1, len(t)) for q, t in zip(asked, truth, strict=True)]
        if np.mean(hits) >= AIM:
            return option
    return OPTIONS[-1]


def usable(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """``vec_id, vector`` (doubles) of the rows that can take part."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(column).cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.filter(F.col("vec_id").isNotNull() & F.col("vector").isNotNull()).filter(finite & F.exists("vector", lambda x: x != 0))


def search(vectors: DataFrame, asked: DataFrame, k: int = 5, seed: int = 0) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the ``k`` nearest ``vectors`` of each of ``asked``.

    Both have ``vec_id, vector`` as ``usable`` gives them.
    """
    spark = vectors.sparkSession
    sample = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).toPandas()
    if not len(sample):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim = int(sample["vector"].map(len).mode()[0])
    sample = sample[sample["vector"].map(len) == dim]
    option = fit(sample["vec_id"].to_numpy(), np.stack(sample["vector"].to_numpy()).astype(float), k)
    rows = vectors.filter(F.size("vector") == dim).distinct()
    asked = asked.filter(F.size("vector") == dim).distinct()
    shards = max(SHARDS, -(-vectors.count() * dim * 8 // SHARD))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, now, shard = Hashes(option, dim, seed), None, None
        ids: list[np.ndarray] = []
        held: list[np.ndarray] = []
        for batch in batches:
            number, query, vec_id = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            values = batch.column(3).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
            out: list[tuple] = []
            for part in np.unique(number):
                mine = number == part
                if part != now:
                    now, shard = part, None
                    ids.clear()
                    held.clear()
                new = mine & (query == 0)
                if new.any():
                    ids.append(vec_id[new])
                    held.append(values[new])
                for i in np.flatnonzero(mine & (query == 1)):
                    if not ids:
                        continue
                    if shard is None:
                        shard = Shard(hashes, np.concatenate(ids), np.concatenate(held))
                    near, score = shard.nearest(vec_id[i], values[i], k)
                    out.append((np.full(len(near), vec_id[i]), near, score))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], ["query_id", "vec_id", "score"])

    own = rows.select(F.pmod(F.xxhash64("vec_id"), F.lit(shards)).alias("shard"), F.lit(0).alias("query"), "vec_id", "vector")
    sent = asked.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard"), F.lit(1).alias("query"), "vec_id", "vector")
    dealt = own.union(sent).repartition(shards, "shard").sortWithinPartitions("shard", "query")
    found = dealt.mapInArrow(run, "query_id long, vec_id long, score double")
    # Of each query a shard sends k rows at most.
    best = found.groupBy("query_id").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("far"), "vec_id", "score"))), 1, k).alias("best"))
    return best.select("query_id", F.posexplode("best").alias("place", "b")).select("query_id", (F.col("place") + 1).cast("int").alias("rank"), "b.vec_id", "b.score")


def divisible(vectors: DataFrame, step: int = 50, k: int = 5) -> DataFrame:
    """The search of all rows whose id is divisible by ``step`` among all rows."""
    rows = usable(vectors)
    return search(rows, rows.filter(F.col("vec_id") % step == 0), k)
