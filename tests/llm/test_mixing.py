"""Mixing: targets against resharing in rounds, and the properties of the rounding."""

import re
from collections import defaultdict

import pytest

from taxatally.llm import mixing


def reshared(sizes, weights, most):
    """Targets by giving excess back round after round."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, left, open_ = dict.fromkeys(names, 0.0), float(sum(sizes.values())), set(names)
    while left > 1e-9 and open_:
        total, share = sum(weight[s] for s in open_), left
        left = 0.0
        for s in list(open_):
            target[s] += share * weight[s] / total
            if target[s] >= most * sizes[s]:
                left += target[s] - most * sizes[s]
                target[s] = float(most * sizes[s])
                open_.discard(s)
    return target


def check(rows, got, weights=(1, 2, 3), most=3):
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes, longest = defaultdict(int), defaultdict(int)
    for _, s, t in rows:
        sizes[s] += count(t)
        longest[s] = max(longest[s], count(t))
    target = reshared(sizes, weights, most)
    assert len(got) == len(rows)
    by = {(d, count(t)): s for d, s, t in rows}
    taken = defaultdict(int)
    for r in got:
        s = by[r.doc_id, r.size]
        assert r.source_size == sizes[s] and abs(r.target - target[s]) <= 1e-6 * max(1, target[s])
        assert r.taken <= most * r.size and (r.size == 0 or r.taken % r.size == 0)
        taken[s] += r.taken
    return {s: abs(taken[s] - target[s]) / max(1, longest[s]) for s in sizes}


@pytest.mark.parametrize("block", [256, 3])
def test_small(spark, monkeypatch, block):
    monkeypatch.setattr(mixing, "BLOCK", block)
    monkeypatch.setattr(mixing, "FAN_IN", 2)
    rows = [(i, ["a", "b", "c", "tiny", None, "é"][min(i % 40, 5)], "w " * (1 + i * 37 % 50)) for i in range(600)]
    rows += [(1000, "empty", ""), (1001, "empty", None), (None, "b", "w w"), (1002, "", "one")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = mixing.mixed(docs).collect()
    assert max(check(rows, got).values()) <= 1
    again = mixing.mixed(docs.repartition(5)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, again), key=repr)
    other = mixing.decide(docs.select("doc_id", "source", mixing.word_count().alias("size")), seed=1).filter("copies > 0").count()
    assert other > 0


def test_expected_share(spark):
    """Over many seeds each document is taken as often as wanted."""
    docs = spark.createDataFrame([(i, "ab"[i // 6], 5 + i) for i in range(12)], "doc_id long, source string, size long")
    total = defaultdict(int)
    for seed in range(60):
        for r in mixing.decide(docs, seed=seed).collect():
            total[r.doc_id] += r.copies - r.target / r.source_size
    assert all(abs(x) / 60 < 0.25 for x in total.values())


def test_mix(spark):
    rows = [(i % 50, "ab"[i % 2], f"t{i % 50} " * (1 + i % 7), i, None) for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, copies int, rows string")
    out = mixing.mix(docs)
    assert out.columns == docs.columns
    sizes = docs.select("doc_id", "source", mixing.word_count().alias("size"))
    want, got = defaultdict(int), defaultdict(int)
    for r in mixing.decide(sizes).collect():
        want[r.doc_id] += r.copies * r.rows
    for r in out.collect():
        got[r.doc_id] += 1
    assert got == {d: n for d, n in want.items() if n}


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.source, r.text) for r in docs.collect()]
    assert max(check(rows, mixing.mixed(docs).collect()).values()) <= 1


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, source string, text string")
    assert mixing.mixed(docs).collect() == [] and mixing.mix(docs).collect() == []
