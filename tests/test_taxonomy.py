"""Parent pointers against walks up the tree."""

import random

import pytest

from taxatally.operators import taxonomy
from taxatally.session import small_table, stored

RANKS = ["root", "class", "family", "no rank", "genus", "species"]


def tree(seed=1, n=300):
    rng = random.Random(seed)
    nodes = [(1, 1, "root", "life")]
    for i in range(2, n):
        parent = rng.choice(nodes[-40:] if rng.random() < 0.5 else nodes)
        nodes.append((i, parent[0], RANKS[min(RANKS.index(parent[2]) + rng.choice((1, 1, 2)), 5)], f"t{i}"))
    return nodes + [(n + i, n + i - 1 if i else None, "no rank", f"deep{i}") for i in range(70)] + [(5000, 4999, "species", "orphan")]


def walk(nodes, i):
    by = {t: (p, r, n) for t, p, r, n in nodes}
    out = [i]
    while by[i][0] in by and by[i][0] != i:
        i = by[i][0]
        out.append(i)
    return out


def table(spark, nodes):
    return small_table(spark, "taxid bigint, parent bigint, rank string, name string", nodes)


def test_ancestors_and_lineages(spark):
    nodes = tree()
    df = table(spark, nodes)
    got = {(r.taxid, r.ancestor, r.steps) for r in taxonomy.ancestors(df).collect()}
    assert got == {(t, a, k) for t, *_ in nodes for k, a in enumerate(walk(nodes, t))}
    rows = {r.taxid: r for r in taxonomy.lineages(df).select("*", taxonomy.name_at("lineage", "genus").alias("genus")).collect()}
    names = {t: n for t, _, _, n in nodes}
    ranks = {t: r for t, _, r, _ in nodes}
    for t, r in rows.items():
        path = walk(nodes, t)[::-1]
        assert [(p.taxid, p.rank, p.name) for p in r.lineage] == [(x, ranks[x], names[x]) for x in path]
        assert r.genus == next((names[x] for x in path if ranks[x] == "genus"), None)
    assert len(rows) == len(nodes)


@pytest.mark.parametrize("ranks", [None, ["genus", "family"]])
def test_common_ancestors(spark, ranks):
    rng, nodes = random.Random(3), tree()
    hits = [(q, rng.choice(nodes[:300])[0]) for q in range(80) for _ in range(rng.choice((1, 2, 2, 3)))]
    hits += [(200, 369), (200, 350), (201, 5000), (202, 777777), (203, 2), (203, 777777), (None, 3)] + [(204, 7)] * 50
    got = {r.query: r for r in taxonomy.common_ancestors(small_table(spark, "query bigint, taxid bigint", hits), table(spark, nodes), ranks).collect()}
    rank, name = {t: r for t, _, r, _ in nodes}, {t: n for t, _, _, n in nodes}
    for q in {q for q, _ in hits if q is not None}:
        taxa = {t for x, t in hits if x == q and t in rank}
        shared = [a for a in (walk(nodes, min(taxa)) if taxa else []) if all(a in walk(nodes, t) for t in taxa) and (ranks is None or rank[a] in ranks)]
        want = (len(taxa), shared[0], rank[shared[0]], name[shared[0]], len(walk(nodes, shared[0]))) if shared else (len(taxa), None, None, "unassigned", 0)
        assert tuple(got[q])[1:] == want


def test_resolved(spark):
    nodes = table(spark, tree(n=20))
    records = small_table(spark, "acc string, taxid bigint", [["a", 3], ["b", 900], ["c", 901], ["d", None], ["e", 902], ["f", 902]])
    merged = small_table(spark, "taxid bigint, current bigint", [[900, 4], [901, 999]])
    got = {r.acc: r.current for r in taxonomy.resolved(records, nodes, merged=merged).collect()}
    assert got == {"a": 3, "b": 4, "c": None, "d": None, "e": None, "f": None}
    assert {(r.taxid, r.records) for r in taxonomy.unresolved(records, nodes).collect()} == {(900, 1), (901, 1), (None, 1), (902, 2)}


def test_circle(spark):
    nodes = table(spark, [(1, 2, "x", "a"), (2, 3, "x", "b"), (3, 1, "x", "c"), (4, None, "x", "d")])
    with pytest.raises(ValueError):
        taxonomy.ancestors(nodes)


def test_only_ancestors_of_the_ranks_meet_the_queries(spark, monkeypatch):
    """Taxa of a query are stored distinct, and sent up to nodes of the ranks only."""
    kept = {}

    def keep(df, label="table", partition_by=()):
        kept[label] = stored(df, label, partition_by)
        return kept[label]

    monkeypatch.setattr(taxonomy, "stored", keep)
    nodes = tree()
    hits = [(q, t) for q in range(3) for t in (7, 7, 369, 777777)]
    taxonomy.common_ancestors(small_table(spark, "query bigint, taxid bigint", hits), table(spark, nodes), ["genus", "family"]).collect()
    rank = {t: r for t, _, r, _ in nodes}
    assert sorted(map(tuple, kept["pairs"].select("query", "taxid").collect())) == [(q, t) for q in range(3) for t in (7, 369)]
    ways = [tuple(r) for r in kept["ways"].select("taxid", "ancestor").collect()]
    assert sorted(ways) == sorted((t, a) for t in rank for a in walk(nodes, t) if rank[a] in ("genus", "family"))
