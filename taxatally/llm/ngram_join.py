"""Jaccard join of documents by their word n-grams, using relations between sets.

Two documents link when ``100 * shared >= percent * union`` of their shingle sets. All links
between different sets count; only the classes they make are returned, so a group of copies
costs one row each and no pair of a group is written out without need.

1. Equal sets are one node. Nodes that agree in some of their minima are compared with the node
   that agrees with the most others; those near enough become members of its star.
2. Index lists: each set enters the lists of its prefix, the tokens among which every partner
   must share some. Tokens that are common in any stretch of the table are ordered last, and then
   those whose lists, counted over all sets, come out long. A star enters a list once for all its members. A list is ordered by size and left early: once
   a partner is too large, so are all behind it. A pair goes on only if it shares as many prefix
   tokens as its sizes demand.
3. Answers from answers: what a member has and its centre has not, and the other way round, is
   its difference. Two members differ by what their differences don't share, so all links inside
   a star follow from these short sets, in blocks of members. For two stars that meet the
   centres are compared; partners lie within the centres' distance, less the members' own, so
   only members near enough are compared, and only where the classes found so far don't hold
   the answer.

Texts without words have no shingles and link with nothing. Null texts count as empty. Rows
with a null doc_id take part; they take the smallest doc_id of their class, null if there is
none. Repeated rows are rows of one class. Ties fall to the smallest doc_id. An empty table
gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .components import components
from .words import LEAN, bound_batches, fresh, mix, shingle_sets, tidy

#: Agreements of minima that make a candidate for a star, and minima in each.
KEYS, MINIMA = 6, 3
#: Tokens that are ordered last, at most, and entries from which an index list counts as long. The
#: order decides on work, not on results.
COMMON, LONG = 1 << 18, 64
#: Tokens after which a task looks for common ones, and the share of documents that makes one.
STRETCH, SHARE, LEAST = 1 << 20, 256, 8
#: Similarity to the centre, in percent, from which a node is a member of its star, and members in
#: a block. A star of many blocks costs as many block pairs.
NEAR, BLOCK = 60, 1024
#: Bytes of sets in a batch that leaves a task, and rows that a task holds before it passes them on.
OUT, HOLD = 1 << 20, 1 << 17
#: Buckets of doc_ids by which a scan drops most documents that it doesn't need; at most so many
#: rows are broadcast.
BUCKETS = 1 << 20

_EDGES = (np.arange(KEYS * MINIMA, dtype=np.float64) / (KEYS * MINIMA) * 2.0**63).astype(np.uint64)
_LAST = np.uint64(1 << 63)


def _sets(texts: pa.Array, n: int, lower: bool) -> Iterator[tuple[int, np.ndarray, int]]:
    """Row, shingle set as sorted 63-bit tokens, and its node."""
    for i, found in shingle_sets(texts, n, lower):
        found = found >> np.uint64(1)
        yield i, found, int.from_bytes(hashlib.blake2b(found.tobytes(), digest_size=8).digest(), "little", signed=True)


def _long(values) -> pa.Array:
    return pa.array(np.asarray(values).astype(np.uint64).view(np.int64))


def _profiles(docs: DataFrame, n: int, lower: bool) -> DataFrame:
    """One row per document (``what`` = 0) and the common tokens of each stretch (``what`` = 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        seen: set[int] = set()
        tokens = 0

        def common() -> pa.RecordBatch:
            every = np.sort(np.concatenate(held)) if held else np.empty(0, np.uint64)
            at = np.flatnonzero(np.append(True, every[1:] != every[:-1])) if len(every) else np.empty(0, np.int64)
            count = np.diff(np.append(at, len(every)))
            often = count >= max(LEAST, len(held) // SHARE)
            m = int(often.sum())
            return batch_of([None] * m, np.zeros(m, np.int64), every[at][often].view(np.int64), count[often], [None] * m, 1)

        def batch_of(ids, rows, nodes, sizes, keys, what) -> pa.RecordBatch:
            ids = ids if isinstance(ids, pa.Array) else pa.array(ids, kind)
            nodes = nodes if isinstance(nodes, list) else nodes.tolist()
            return pa.RecordBatch.from_arrays(
                [ids, rows if isinstance(rows, pa.Array) else pa.array(rows), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array([what] * len(nodes), pa.int32())],
                ["doc_id", "row", "node", "size", "keys", "what"],
            )

        kind = pa.int64()
        for batch in batches:
            kind = batch.schema.field(0).type
            nodes, sizes, keys = [], [], []
            for _, found, node in _sets(batch.column(2), n, lower):
                sizes.append(len(found))
                if not len(found):
                    nodes.append(None)
                    keys.append(None)
                    continue
                nodes.append(node)
                low = found[np.searchsorted(found, _EDGES) % len(found)].reshape(KEYS, MINIMA)
                key = np.arange(1, KEYS + 1, dtype=np.uint64)
                for j in range(MINIMA):
                    key = mix(key * np.uint64(31) + low[:, j])
                keys.append(key.view(np.int64).tolist())
                if node not in seen:
                    seen.add(node)
                    held.append(found)
                    tokens += len(found)
                    if tokens >= STRETCH:
                        yield common()
                        held.clear()
                        seen.clear()
                        tokens = 0
            yield batch_of(batch.column(0), batch.column(1), nodes, sizes, keys, 0)
        if held:
            yield common()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.xxhash64("text").alias("row"), F.col("text").cast("string").alias("text")).mapInArrow(
        tidy(run), f"doc_id {kind}, row long, node long, size long, keys array<long>, what int"
    )


def _bucket():
    return F.pmod(F.xxhash64("doc_id"), F.lit(BUCKETS))


def _sets_of(docs: DataFrame, wanted: DataFrame, n: int, lower: bool) -> DataFrame:
    """``node, found`` (tokens as bytes) of the wanted nodes (``node, bucket``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, found, held = [], [], 0
            last = len(batch) - 1
            for i, tokens, node in _sets(batch.column(0), n, lower):
                if len(tokens):
                    nodes.append(node)
                    found.append(tokens.tobytes())
                    held += tokens.nbytes
                if held > OUT or i == last:
                    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(found, pa.binary())], ["node", "found"])
                    nodes, found, held = [], [], 0

    # At most BUCKETS rows, so the broadcast is bounded.
    near = docs.withColumn("bucket", _bucket()).join(F.broadcast(wanted.select("bucket").distinct()), "bucket", "left_semi")
    sets = near.select(F.col("text").cast("string")).mapInArrow(tidy(run), "node long, found binary")
    return sets.join(wanted.select("node"), "node", "left_semi").groupBy("node").agg(F.first("found").alias("found"))


def _compared(docs: DataFrame, pairs: DataFrame, nodes: DataFrame, n: int, lower: bool) -> DataFrame:
    """``a, b, shared, size_a, size_b`` of distinct pairs ``a, b``, from the whole sets; stored.

    ``differ`` holds the tokens of one set only, as bytes, where the sets are near.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shared, left, right, differ = [], [], [], []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                both = int((y[at] == x).sum())
                shared.append(both)
                left.append(len(x))
                right.append(len(y))
                near = 100 * both >= NEAR * (len(x) + len(y) - both)
                differ.append(np.setxor1d(x, y, assume_unique=True).tobytes() if near else None)
            columns = [*(pa.array(v, pa.int64()) for v in (shared, left, right)), pa.array(differ, pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["a", "b", "shared", "size_a", "size_b", "differ"])

    ends = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    wanted = stored(ends.join(nodes, "node").select("node", "bucket"), "wanted")
    sets = _sets_of(docs, wanted, n, lower)
    first = pairs.join(sets.select(F.col("node").alias("b"), F.col("found").alias("y")), "b")
    both = first.join(sets.select(F.col("node").alias("a"), F.col("found").alias("x")), "a").select("a", "b", "x", "y")
    return stored(both.mapInArrow(tidy(run), "a long, b long, shared long, size_a long, size_b long, differ binary"), "compared")


def _linked_members(sizes: np.ndarray, differ: list[np.ndarray], percent: int) -> np.ndarray:
    """Of each member the first one of its class, among the members of a block pair."""
    count = np.array([len(x) for x in differ])
    owner, tokens = np.repeat(np.arange(len(differ)), count), np.concatenate(differ)
    _, place, often = np.unique(tokens, return_inverse=True, return_counts=True)
    column = np.cumsum(often > 1) - 1  # tokens of one member only are shared with none
    keep = often[place] > 1
    owner, place = owner[keep], column[place[keep]]
    shared = np.zeros((len(differ), len(differ)), dtype=np.float32)
    for first in range(0, int((often > 1).sum()), 2048):
        part = (place >= first) & (place < first + 2048)
        held = np.zeros((len(differ), 2048), dtype=np.float32)
        held[owner[part], place[part] - first] = 1
        shared += held @ held.T
    apart = count[:, None] + count[None] - 2 * shared.astype(np.int64)
    link = (100 + percent) * apart <= (100 - percent) * (sizes[:, None] + sizes[None])
    label = np.arange(len(differ))
    while True:
        low = np.where(link, label[None], len(label)).min(axis=1)
        low = np.minimum(low, label)[np.minimum(low, label)]
        if (low == label).all():
            return label
        label = low


def _inside(members: DataFrame, percent: int) -> DataFrame:
    """``a, b`` that hold the classes of the members of each star, from their differences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []

        def done() -> pa.RecordBatch:
            nodes = np.array([r[0] for r in rows])
            label = _linked_members(np.array([r[1] for r in rows]), [r[2] for r in rows], percent)
            other = label != np.arange(len(label))
            return pa.RecordBatch.from_arrays([pa.array(nodes[label[other]], pa.int64()), pa.array(nodes[other], pa.int64())], ["a", "b"])

        for batch in batches:
            star, x, y, node, size = (batch.column(i).to_pylist() for i in range(5))
            for i, key in enumerate(zip(star, x, y, strict=True)):
                if key != now:
                    if len(rows) > 1:
                        yield done()
                    now, rows = key, []
                rows.append((node[i], size[i], np.frombuffer(batch.column(5)[i].as_buffer(), np.uint64)))
        if len(rows) > 1:
            yield done()

    count = members.groupBy("star").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    dealt = members.join(count, "star").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = dealt.filter("blocks = 1 or own <> other").select("star", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "node", "size", "differ")
    ordered = dealt.repartition("star", "x", "y").sortWithinPartitions("star", "x", "y")
    return ordered.mapInArrow(tidy(run), "a long, b long")


def _cut_prefixes(batches: Iterator[pa.RecordBatch], last: np.ndarray, percent: int, n: int, lower: bool) -> Iterator[tuple[int, int, np.ndarray]]:
    """Node, size and prefix of each different set of a task, in the order "common last, then by hash"."""
    seen = set()
    for batch in batches:
        for _, found, node in _sets(batch.column(0), n, lower):
            size = len(found)
            if not size or node in seen:
                continue
            seen.add(node)
            length = size - -(-percent * size // 100) + 1
            if len(last):
                often = last[np.minimum(np.searchsorted(last, found), len(last) - 1)] == found
                rare = found[~often][:length]
                found = np.concatenate((rare, found[often][: length - len(rare)] | _LAST))
            yield node, size, found[:length]


def _prefixes(docs: DataFrame, common: np.ndarray, percent: int, n: int, lower: bool) -> DataFrame:
    """``node, size, tokens`` of every document; ``tokens`` is its prefix."""
    shared = docs.sparkSession.sparkContext.broadcast(common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0

        def flush() -> pa.RecordBatch:
            nodes, sizes, tokens = zip(*rows, strict=True)
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(tokens, pa.binary())], ["node", "size", "tokens"])

        for node, size, tokens in _cut_prefixes(batches, shared.value, percent, n, lower):
            rows.append((node, size, tokens.tobytes()))
            held += tokens.nbytes
            if held > OUT:
                yield flush()
                held = 0
        if rows:
            yield flush()

    return docs.select(F.col("text").cast("string")).mapInArrow(tidy(run), "node long, size long, tokens binary")


def _postings(prefixes: DataFrame) -> DataFrame:
    """``token, star, low, high``: one entry of an index list per token and star of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def flush() -> pa.RecordBatch:
            token, star, low, high = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.lexsort((star, token))
            token, star = token[order], star[order]
            new = np.append(True, (token[1:] != token[:-1]) | (star[1:] != star[:-1]))
            held.clear()
            return pa.RecordBatch.from_arrays([_long(token[new]), pa.array(star[new]), pa.array(low[order][new]), pa.array(high[order][new])], ["token", "star", "low", "high"])

        rows = 0
        for batch in batches:
            star, low, high = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            for i, x in enumerate(batch.column(3)):
                token = np.frombuffer(x.as_buffer(), np.uint64)
                held.append((token, *(np.full(len(token), v[i]) for v in (star, low, high))))
                rows += len(token)
                if rows > HOLD:
                    yield flush()
                    rows = 0
        if held:
            yield flush()

    return prefixes.select("star", "low", "high", "tokens").mapInArrow(tidy(run), "token long, star long, low long, high long")


def _long_lists(docs: DataFrame, common: np.ndarray, percent: int, n: int, lower: bool) -> np.ndarray:
    """Tokens of the longest index lists, from ``LONG`` entries on, counted by node without the stars.

    Tasks add up before they send anything, and prefixes stay in the task that makes them.
    """
    shared = docs.sparkSession.sparkContext.broadcast(common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        rows = 0

        def flush() -> pa.RecordBatch:
            token, count = np.unique(np.concatenate(held) & ~_LAST, return_counts=True)
            held.clear()
            return pa.RecordBatch.from_arrays([_long(token), pa.array(count)], ["token", "n"])

        for _, _, tokens in _cut_prefixes(batches, shared.value, percent, n, lower):
            held.append(tokens)
            rows += len(tokens)
            if rows > 8 * HOLD:
                yield flush()
                rows = 0
        if held:
            yield flush()

    counts = docs.select(F.col("text").cast("string")).mapInArrow(tidy(run), "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    top = counts.filter(F.col("n") > LONG).orderBy(F.desc("n"), "token").limit(COMMON)
    return top.select("token").toArrow().column(0).to_numpy().view(np.uint64)


def _meetings(postings: DataFrame, percent: int) -> DataFrame:
    """``a, b`` of stars that share as many prefix tokens as links between them demand."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        rest = tuple(np.empty(0, np.int64) for _ in range(4))

        def pair(token, star, low, high) -> Iterator[pa.RecordBatch]:
            """All pairs of the same token whose sizes fit; lists are ordered by the lower size."""
            at, step = np.arange(len(token)), 1
            while len(at):
                at = at[at + step < len(token)]
                other = at + step
                fits = (token[at] == token[other]) & (percent * low[other] <= 100 * high[at])
                at, other = at[fits], other[fits]
                step += 1
                apart = star[at] != star[other]
                x, y = at[apart], other[apart]
                if len(x):
                    # A star that comes from two tasks has two entries. A pair that is counted
                    # twice for that only passes the count below more easily.
                    a, b = np.minimum(star[x], star[y]), np.maximum(star[x], star[y])
                    least = -(-percent * (low[x] + low[y]) // (100 + percent)) + percent * -np.maximum(high[x], high[y]) // 100 + 1
                    held.append((a, b, token[x], np.maximum(least, 1)))
                    if sum(len(h[0]) for h in held) > HOLD:
                        yield flush()

        def flush() -> pa.RecordBatch:
            a, b, token, least = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.lexsort((token, b, a))
            a, b, token, least = a[order], b[order], token[order], least[order]
            new = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (token[1:] != token[:-1]))
            a, b, least = a[new], b[new], least[new]
            first = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(a[first]), pa.array(b[first]), pa.array(np.diff(np.append(first, len(a)))), pa.array(least[first])], ["a", "b", "shared", "least"])

        for batch in batches:
            now = tuple(np.concatenate((r, batch.column(i).to_numpy(zero_copy_only=False))) for i, r in enumerate(rest))
            token = now[0]
            # The last list may go on in the next batch.
            cut = int(np.searchsorted(token, token[-1], "left")) if len(token) else 0
            rest = tuple(x[cut:] for x in now)
            yield from pair(*(x[:cut] for x in now))
        yield from pair(*rest)
        if held:
            yield flush()

    lists = postings.repartition("token").sortWithinPartitions("token", "low", "star")
    met = lists.mapInArrow(tidy(run), "a long, b long, shared long, least long")
    return met.groupBy("a", "b").agg(F.sum("shared").alias("shared"), F.min("least").alias("least")).filter("shared >= least").select("a", "b")


def classes(docs: DataFrame, n: int = 5, percent: int = 80, lower: bool = True) -> DataFrame:
    """``doc_id, row, n_shingles, node, root``; equal ``root`` means the same class.

    ``row`` is a hash of the text. ``node`` and ``root`` are null for texts without words.
    """
    link = f"100 * shared >= {percent} * (size_a + size_b - shared)"
    every = stored(_profiles(bound_batches(docs, LEAN), n, lower), "profiles")
    profiles = every.filter("what = 0")
    ranked = every.filter("what = 1").groupBy("node").agg(F.sum("size").alias("n")).orderBy(F.desc("n"), "node").limit(COMMON)
    common = np.sort(ranked.select("node").toArrow().column(0).to_numpy().view(np.uint64))
    nodes = stored(
        profiles.filter("node is not null").groupBy("node").agg(F.min("size").alias("size"), F.min(_bucket()).alias("bucket"), F.first("keys").alias("keys")),
        "nodes",
    )

    # Stars: each node against the one, among those it agrees with, that agrees with the most
    # others. Among copies with changes of their own that is the one nearest to them all.
    keyed = stored(nodes.select("node", F.explode("keys").alias("key")), "keyed")
    often = keyed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    agreed = keyed.join(often, "key")
    weights = agreed.groupBy("node").agg(F.sum("n").alias("weight"))
    agreed = stored(agreed.select("node", "key").join(weights, "node").select("node", "key", F.struct("weight", "node").alias("rank")), "agreed")
    best = agreed.groupBy("key").agg(F.max("rank").alias("best"))
    candidates = agreed.join(best, "key").filter("best > rank").groupBy(F.col("node").alias("b")).agg(F.max("best").alias("best")).select(F.col("best.node").alias("a"), "b")
    stars = _compared(docs, stored(candidates, "candidates"), nodes, n, lower)
    near = stars.filter("differ is not null")
    # Only a node that hangs on no other may be a centre; members keep their distance to it.
    members = stored(
        near.join(near.select(F.col("b").alias("a")).distinct(), "a", "left_anti")
        .select(F.col("b").alias("node"), F.col("a").alias("star"), F.expr("size_a + size_b - 2 * shared").alias("distance"), F.col("size_b").alias("size"), "differ"),
        "members",
    )
    inside = stored(_inside(members, percent), "inside")
    widths = members.groupBy("star").agg(F.min("size").alias("low"), F.max("size").alias("high"), F.max("distance").alias("radius"))
    centres = widths.join(nodes.select(F.col("node").alias("star"), "size"), "star").select("star", F.least("low", "size").alias("low"), F.greatest("high", "size").alias("high"), "radius")
    belongs = members.select("node", "star").union(centres.select(F.col("star").alias("node"), "star"))
    in_star = stored(belongs.join(centres, "star"), "in_star")

    # The count only decides on the order.
    common = np.union1d(common, _long_lists(docs, common, percent, n, lower))
    # A broadcast would put the Python of prefixes and that of postings into one task, with a worker each.
    prefixes = _prefixes(docs, common, percent, n, lower).join(in_star.drop("radius").hint("merge"), "node", "left")
    prefixes = prefixes.select(*(F.coalesce(x, F.col(y)).alias(x) for x, y in (("star", "node"), ("low", "size"), ("high", "size"))), "tokens")
    meetings = stored(_meetings(_postings(prefixes), percent), "meetings")
    met = _compared(docs, meetings, nodes, n, lower)
    links = stars.filter(link).select("a", "b").union(inside).union(met.filter(link).select("a", "b"))
    found = stored(components(links), "found")

    # Members of two stars that meet, where their distances leave room for a link.
    star = in_star.filter("node = star").select("star", "high", "radius")
    ends = lambda side: star.select(F.col("star").alias(side), F.col("high").alias(f"high_{side}"), F.col("radius").alias(f"radius_{side}"))
    open_ = met.join(ends("a"), "a", "left").join(ends("b"), "b", "left").filter("radius_a is not null or radius_b is not null")
    open_ = open_.withColumn("gap", F.expr("size_a + size_b - 2 * shared")).filter(
        f"({100 + percent}) * (gap - coalesce(radius_a, 0) - coalesce(radius_b, 0)) <= {100 - percent} * (coalesce(high_a, size_a) + coalesce(high_b, size_b))"
    )
    open_ = open_.select(F.col("a").alias("star_a"), F.col("b").alias("star_b"), "gap", "size_a", "size_b")
    rooted = members.join(found, "node", "left").select("star", "node", "distance", "size", F.coalesce("root", "node").alias("root"))
    named = lambda x: [F.col(c).alias(f"{c}_{x}") for c in ("star", "node", "distance", "size", "root")]
    centre = lambda x: open_.select(F.col(f"star_{x}").alias("node"), F.col(f"size_{x}").alias("size")).distinct().join(found, "node", "left").select(
        F.col("node").alias("star"), "node", F.lit(0).cast("long").alias("distance"), "size", F.coalesce("root", "node").alias("root")
    )
    side = lambda x: rooted.union(centre(x)).select(*named(x))
    wide = open_.select("star_a", "star_b", "gap").join(side("a"), "star_a").join(side("b"), "star_b").filter("root_a <> root_b")
    wide = wide.filter(f"({100 + percent}) * (gap - distance_a - distance_b) <= {100 - percent} * (size_a + size_b)").filter("node_a <> star_a or node_b <> star_b")
    wide = wide.filter(f"{percent} * greatest(size_a, size_b) <= 100 * least(size_a, size_b)")
    wide = stored(wide.select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b")).distinct(), "wide")
    if not wide.isEmpty():
        more = _compared(docs, wide, nodes, n, lower).filter(link).select("a", "b")
        found = components(found.select(F.col("root").alias("a"), F.col("node").alias("b")).union(more))
    return profiles.join(found, "node", "left").select("doc_id", "row", F.col("size").alias("n_shingles"), "node", F.coalesce("root", F.col("node")).alias("root"))


def linked(docs: DataFrame, n: int = 4, percent: int = 85, lower: bool = True) -> DataFrame:
    """doc_id, n_shingles and component_id (smallest doc_id of the class) of every document."""
    rows = stored(classes(docs, n, percent, lower), "classes")
    least = rows.filter("root is not null").groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return rows.join(least, "root", "left").select("doc_id", "n_shingles", F.expr("if(root is null, doc_id, component_id)").alias("component_id"))


def families(docs: DataFrame, n: int = 5, percent: int = 80, lower: bool = True) -> DataFrame:
    """``page, family`` of each distinct text with words: its xxhash64 and the root of its class."""
    rows = classes(docs, n, percent, lower).filter("root is not null")
    return rows.groupBy(F.col("row").alias("page")).agg(F.min("root").alias("family"))


def keep_one(docs: DataFrame, n: int = 5, percent: int = 80, lower: bool = True) -> DataFrame:
    """One document of each class, that with the smallest doc_id (null comes last).

    Texts without words are all kept, but for repeated rows. Columns stay as they are.
    """
    rows = classes(docs, n, percent, lower)
    empty = rows.filter("root is null").select("doc_id", "row")
    first = rows.filter("root is not null").groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("m"))
    text_key, key = fresh(docs, "row", "key")
    keep = stored(empty.union(first.select("m.doc_id", "m.row")).select(F.xxhash64("doc_id", "row").alias("_key"), F.col("doc_id").alias("_doc"), F.col("row").alias("_row")).distinct(), "keep")
    marked = docs.withColumn(text_key, F.xxhash64("text")).withColumn(key, F.xxhash64("doc_id", text_key))
    same = (marked[key] == keep["_key"]) & marked["doc_id"].eqNullSafe(keep["_doc"]) & (marked[text_key] == keep["_row"])
    return marked.join(keep, same, "left_semi").dropDuplicates([key, "doc_id", text_key]).select(*(F.col(f"`{c}`") for c in docs.columns))


def linked_sql(n: int = 4, percent: int = 85) -> str:
    """What ``linked`` gives, as SQL over the table ``documents`` with distinct ids."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return rf"""
    WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
    s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {n} THEN [array_to_string(w, ' ')]
            ELSE list_transform(range(1, len(w) - {n - 2}), lambda i: array_to_string(w[i:i + {n - 1}], ' ')) END) AS g FROM d),
    sizes AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
    links AS (SELECT x, y FROM pairs JOIN sizes a ON a.doc_id = x JOIN sizes b ON b.doc_id = y WHERE 100 * shared >= {percent} * (a.n + b.n - shared)),
    ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
    reach(x, y) AS (SELECT x, y FROM ways UNION SELECT r.x, w.y FROM reach r JOIN ways w ON r.y = w.x),
    least_of AS (SELECT x, min(y) AS low FROM reach GROUP BY x)
    SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(low, d.doc_id)) AS component_id
    FROM d LEFT JOIN sizes ON sizes.doc_id = d.doc_id LEFT JOIN least_of ON x = d.doc_id"""
