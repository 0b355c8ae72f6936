"""Mixing sources to target weights by pivotal dependent rounding.

Every source has a target number of words; a document of it is wanted ``target / source size``
times. The whole part of that is taken for certain. The fractions are rounded by the pivotal
method: two documents at a time, mass moves at random from one to the other, words for words,
until one of them is all in or all out; the chance of either way keeps each document's expected
share. A task rounds a block of documents and leaves at most one fraction; the fractions that
are left go through the same rounding, some hundreds at a time, up a tree until one is left
of each source. A source thus misses its target by less than one document.

Draws are hashes of the row, its level and a seed, so reruns agree however rows are dealt out.
Rows that agree in doc_id, source and size are one item that is taken or not as a whole. Null
texts count no words, and documents without words are never taken. A null source is a source of
its own, the last. A null doc_id is an id like any other. An empty table gives an empty result.
Ties in order cannot arise. ``decide`` reads no further columns; ``mix`` keeps all of them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored
from .words import fresh

#: Items that a task rounds as one block, and fractions that meet in one step up the tree.
BLOCK, FAN_IN = 256, 512

WORDS = r"[^\x20\x09-\x0D]+"


def word_count():
    return F.coalesce(F.regexp_count("text", F.lit(WORDS)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: Sequence[float], most: float) -> DataFrame:
    """``source, source_size, target`` of every source from ``source, source_size``.

    Weights go round the sources in code point order, null last. A target stops at ``most``
    times the source's size; the excess goes to the others by weight until none is above. That
    is one level, ``min(weight * level, cap)``, found by filling the sources in order of
    ``cap / weight``. The windows run over one row per source.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("place") % len(weights) + 1).cast("int"))
    ranked = sizes.withColumn("place", F.row_number().over(order) - 1).withColumn("weight", weight)
    ranked = ranked.withColumn("cap", most * F.col("source_size")).withColumn("ratio", F.col("cap") / F.col("weight"))
    by_ratio = Window.orderBy("ratio", "place")
    ranked = ranked.withColumns(
        {
            "total": F.sum("source_size").over(Window.partitionBy()).cast("double"),
            "filled": F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)),
            "open": F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)),
        }
    ).withColumn("level", (F.col("total") - F.col("filled")) / F.col("open"))
    # The first source that is not filled at the level of those from it on sets the level of all.
    level = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "place", "level"))).over(Window.partitionBy())["level"]
    target = F.when(F.col("source_size") == 0, 0.0).otherwise(F.coalesce(F.least("cap", F.col("weight") * F.col("full")), F.col("cap")))
    return ranked.withColumn("full", level).withColumn("target", target).select("source", "source_size", "target")


def _draw(*parts) -> float:
    return int.from_bytes(hashlib.blake2b(repr(parts).encode(), digest_size=7).digest(), "little") / 2.0**56


def _round(items: DataFrame, level: int, seed: int) -> DataFrame:
    """Round the fractions (``part``) of each source and block; at most one stays in each.

    Rows come in order of source and block; the task holds one unfinished item at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict | None = None
        schema: pa.Schema | None = None
        for batch in batches:
            schema, out = batch.schema, []
            for row in batch.to_pylist():
                if held is not None and (held["source"], held["block"]) != (row["source"], row["block"]):
                    out.append(held)
                    held = None
                if not 0.0 < row["part"] < 1.0:
                    out.append(row)
                    continue
                if held is None:
                    held = row
                    continue
                a, b = held, row
                # Mass in words that can go from a to b, and from b to a.
                ab, ba = min(a["part"] * a["mass"], (1 - b["part"]) * b["mass"]), min(b["part"] * b["mass"], (1 - a["part"]) * a["mass"])
                to_b = _draw(seed, level, a["doc_id"], a["size"], b["doc_id"], b["size"]) * (ab + ba) < ba
                moved, giver, taker = (ab, a, b) if to_b else (ba, b, a)
                empty = moved == giver["part"] * giver["mass"]
                giver["part"] = 0.0 if empty else giver["part"] - moved / giver["mass"]
                full = moved == (1 - taker["part"]) * taker["mass"]
                taker["part"] = 1.0 if full else min(1.0, taker["part"] + moved / taker["mass"])
                still = [x for x in (a, b) if 0.0 < x["part"] < 1.0]
                out += [x for x in (a, b) if not 0.0 < x["part"] < 1.0]
                held = still[0] if still else None
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=schema)
        if held is not None:
            yield pa.RecordBatch.from_pylist([held], schema=schema)

    dealt = items.repartition("source", "block").sortWithinPartitions("source", "block", F.xxhash64("doc_id", "size", F.lit(seed)), "doc_id", "size")
    return dealt.mapInArrow(run, items.schema)


def decide(docs: DataFrame, weights: Sequence[float] = (1, 2, 3), most: int = 3, seed: int = 0) -> DataFrame:
    """``doc_id, source, size, source_size, target, copies, rows`` of every item.

    ``docs`` has ``doc_id, source, size``; ``rows`` counts the rows of an item.
    """
    items = docs.groupBy("doc_id", "source", "size").agg(F.count("*").alias("rows"))
    totals = stored(items.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).alias("source_size"), F.count("*").alias("n")), "sources")
    aims = targets(totals.select("source", "source_size"), weights, most).join(totals.select(F.col("source").alias("_s"), "n"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    aims = stored(aims.withColumnRenamed("source", "_source"), "targets")
    wanted = F.when((F.col("size") > 0) & (F.col("source_size") > 0), F.col("target") / F.col("source_size")).otherwise(0.0)
    items = items.join(aims, F.col("source").eqNullSafe(F.col("_source"))).drop("_source").withColumn("wanted", wanted)
    items = items.withColumn("whole", F.floor("wanted")).withColumn("part", F.col("wanted") - F.col("whole")).withColumn("mass", (F.col("size") * F.col("rows")).cast("double"))
    blocks = F.ceil(F.col("n") / BLOCK)
    now = items.withColumn("block", F.pmod(F.xxhash64("doc_id", "size"), blocks)).select("doc_id", "source", "size", "rows", "source_size", "target", "whole", "part", "mass", "block")
    most_blocks = totals.agg(F.max(F.ceil(F.col("n") / BLOCK))).first()[0] or 0
    done, level = None, 0
    while True:
        now = stored(_round(now, level, seed), "rounded")
        whole = now.filter("part = 0 or part = 1")
        done = whole if done is None else done.union(whole)
        rest = now.filter("part > 0 and part < 1")
        if most_blocks <= 1:
            break
        most_blocks = -(-most_blocks // FAN_IN)
        now, level = rest.withColumn("block", F.floor(F.col("block") / FAN_IN)), level + 1
    # The last fraction of a source goes in or out by a draw of its own.
    last = rest.withColumn("part", (F.pmod(F.xxhash64("source", "doc_id", "size", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30) < F.col("part")).cast("double"))
    return done.union(last).select("doc_id", "source", "size", "source_size", "target", (F.col("whole") + F.col("part")).cast("long").alias("copies"), "rows")


def mixed(docs: DataFrame, weights: Sequence[float] = (1, 2, 3), most: int = 3, seed: int = 0) -> DataFrame:
    """doc_id, size, source_size, target and the words taken of every row of ``docs``."""
    chosen = decide(docs.select("doc_id", "source", word_count().alias("size")), weights, most, seed)
    rows = chosen.withColumn("_row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def mix(docs: DataFrame, weights: Sequence[float] = (1, 2, 3), most: int = 3, seed: int = 0) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it."""
    size, key, copies, copy = fresh(docs, "size", "key", "copies", "copy")
    marked = docs.withColumn(size, word_count())
    chosen = decide(marked.select("doc_id", "source", F.col(size).alias("size")), weights, most, seed)
    chosen = stored(chosen.filter("copies > 0").select(F.xxhash64("doc_id", "source", "size").alias("_key"), F.col("doc_id").alias("_doc"), F.col("source").alias("_source"), F.col("size").alias("_n"), "copies"), "copies")
    marked = marked.withColumn(key, F.xxhash64("doc_id", "source", size))
    same = (marked[key] == chosen["_key"]) & marked["doc_id"].eqNullSafe(chosen["_doc"]) & marked["source"].eqNullSafe(chosen["_source"]) & (marked[size] == chosen["_n"])
    taken = marked.join(chosen.withColumnRenamed("copies", copies), same)
    return taken.withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), F.col(copies)))).select(*(marked[c] for c in docs.columns))
