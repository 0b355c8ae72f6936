"""Taxa as a table of parent pointers: ancestors, lineages with ranks, lowest common ancestors.

``nodes`` has ``taxid, parent, rank, name``; a root has no parent or is its own. Ancestors are found by
pointer doubling: after round k a node knows its ancestors up to 2^k steps away, and those of
the one 2^k steps away give the next 2^k. So a tree of depth d takes log2(d) joins, and a parent with
very many children costs one row for each of them, nothing more.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taxatally import fixed_values as fv
from taxatally.session import stored

#: Rounds of doubling before pointers are taken for a circle.
MOST_ROUNDS = 16


def ancestors(nodes: DataFrame, itself: bool = True) -> DataFrame:
    """``taxid, ancestor, steps`` for every node and all nodes above it, and with ``itself`` the node, 0 steps away.

    A parent that isn't a node ends the way up. Pointers in a circle are an error.
    """
    known = nodes.select("taxid").distinct()
    up = nodes.where(F.col("parent").isNotNull() & (F.col("parent") != F.col("taxid"))).select("taxid", F.col("parent").alias("ancestor"), F.lit(1).alias("steps")).distinct()
    up = stored(up.join(known.withColumnRenamed("taxid", "ancestor"), "ancestor", "left_semi").select("taxid", "ancestor", "steps"), "ancestors")
    for k in range(MOST_ROUNDS):
        jump = up.where(F.col("steps") == 1 << k).select(F.col("taxid").alias("ancestor"), F.col("ancestor").alias("further"))
        more = up.join(jump, "ancestor").select("taxid", F.col("further").alias("ancestor"), (F.col("steps") + (1 << k)).alias("steps"))
        more = stored(more, "ancestors")
        if more.isEmpty():
            own = known.select("taxid", F.col("taxid").alias("ancestor"), F.lit(0).alias("steps"))
            return up.unionByName(own) if itself else up
        if not more.where(F.col("taxid") == F.col("ancestor")).isEmpty():
            break
        up = stored(up.unionByName(more), "ancestors")
    raise ValueError("parent pointers go round in a circle")


def lineages(nodes: DataFrame, up: DataFrame | None = None) -> DataFrame:
    """``taxid, lineage``: structs ``taxid, rank, name`` from the root down to the node itself."""
    up = ancestors(nodes) if up is None else up
    above = up.join(nodes.select(F.col("taxid").alias("ancestor"), "rank", "name"), "ancestor")
    rows = above.groupBy("taxid").agg(F.array_sort(F.collect_list(F.struct((-F.col("steps")).alias("place"), F.col("ancestor").alias("taxid"), "rank", "name"))).alias("path"))
    return rows.select("taxid", F.transform("path", lambda p: F.struct(p["taxid"].alias("taxid"), p["rank"].alias("rank"), p["name"].alias("name"))).alias("lineage"))


def name_at(lineage: Column | str, rank: str) -> Column:
    """Name of the ancestor of a rank, null where the lineage has none."""
    col = F.col(lineage) if isinstance(lineage, str) else lineage
    return F.try_element_at(F.filter(col, lambda p: p["rank"] == rank), F.lit(1))["name"]


def resolved(records: DataFrame, nodes: DataFrame, key: str = "taxid", merged: DataFrame | None = None) -> DataFrame:
    """``records`` with ``current``, the node an id stands for; ``merged`` has ``taxid, current`` of replaced ids.

    ``current`` is null for ids that are neither nodes nor replaced by one.
    """
    known = nodes.select(F.col("taxid").alias(key), F.col("taxid").alias("_own")).distinct()
    out = records.join(known, key, "left")
    if merged is None:
        return out.withColumnRenamed("_own", "current")
    valid = merged.join(nodes.select(F.col("taxid").alias("current")).distinct(), "current", "left_semi")
    moved = valid.groupBy(F.col("taxid").alias(key)).agg(F.min("current").alias("_moved"))
    return out.join(moved, key, "left").withColumn("current", F.coalesce("_own", "_moved")).drop("_own", "_moved")


def unresolved(records: DataFrame, nodes: DataFrame, key: str = "taxid", merged: DataFrame | None = None) -> DataFrame:
    """Ids without a node and how many records hold each, for repair by hand; a null id is one of them."""
    return resolved(records, nodes, key, merged).where(F.col("current").isNull()).groupBy(key).agg(F.count("*").alias("records"))


def common_ancestors(hits: DataFrame, nodes: DataFrame, ranks: Sequence[str] | None = None, up: DataFrame | None = None) -> DataFrame:
    """``query, taxa, taxid, rank, name, depth`` of the lowest node above all taxa of each query's hits.

    ``hits`` has ``query, taxid``; ids that aren't nodes are no hits. With ``ranks`` the answer is the
    lowest common node of one of these ranks, so doubt between species ends at the genus or the family
    even where unranked nodes lie between. Without any the query is ``unassigned`` at depth 0.
    ``depth`` counts the nodes from the root.

    Every taxon of a query is sent up once, however many hits name it, to ancestors of these ranks
    only, and counts are added up before they meet, so a query with very many hits is spread over all
    tasks. Distinct taxa are stored, so no task makes them distinct and sends them up at once.
    """
    up = ancestors(nodes) if up is None else up
    depth = up.groupBy("taxid").agg(F.count("*").alias("depth"))
    known = nodes.select("taxid").distinct()
    pairs = stored(hits.select("query", "taxid").distinct().join(known, "taxid", "left_semi"), "pairs")
    named = nodes.select(F.col("taxid").alias("ancestor"), "rank", "name").join(depth.withColumnRenamed("taxid", "ancestor"), "ancestor")
    ways = up.select("taxid", "ancestor")
    if ranks is not None:
        named = named.where(F.col("rank").isin(*ranks))
        ways = ways.join(nodes.where(F.col("rank").isin(*ranks)).select(F.col("taxid").alias("ancestor")).distinct(), "ancestor", "left_semi")
    above = pairs.join(stored(ways, "ways"), "taxid").groupBy("query", "ancestor").agg(F.count("*").alias("under"))
    taxa = pairs.groupBy("query").agg(F.count("*").alias("taxa"))
    shared = above.join(taxa, "query").where(F.col("under") == F.col("taxa"))
    lowest = shared.join(named, "ancestor").groupBy("query").agg(F.max(F.struct("depth", "ancestor", "rank", "name")).alias("low"))
    rows = hits.select("query").distinct().join(taxa, "query", "left").join(lowest, "query", "left")
    return rows.select(
        "query", F.coalesce("taxa", F.lit(0)).alias("taxa"), F.col("low.ancestor").alias("taxid"), F.col("low.rank").alias("rank"),
        F.coalesce("low.name", F.lit(fv.UNASSIGNED)).alias("name"), F.coalesce("low.depth", F.lit(0)).alias("depth"),
    )
