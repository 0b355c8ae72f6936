"""Whitening against dense linear algebra and whole-number sums."""

import numpy as np
import pytest

from taxatally.llm import whitening


def dense(rows):
    """vec_id -> deviation, and x, components, variances of the rows that take part."""
    x = np.array([np.floor(1024 * np.array(v, float)) + 100000 for _, v in rows]).astype(int)
    n, s = len(x), x.sum(axis=0)
    deviation = [sum((int(n) * int(a) - int(b)) ** 2 for a, b in zip(r, s)) for r in x]
    centred = x - s / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    return deviation, centred, values[::-1], vectors[:, ::-1]


def check(got, rows, most=8):
    deviation, centred, values, vectors = dense(rows)
    k = min(most, int((values > 1e-12 * values.sum()).sum()))
    assert len(got) == len(rows) * k
    by = {}
    for r in got:
        by.setdefault(r.component, {}).setdefault(r.vec_id, []).append(r)
    for c in range(k):
        want = centred @ vectors[:, c] / np.sqrt(values[c])
        ids = [i for i, _ in rows]
        mine = np.array([sorted(x.whitened for x in by[c + 1][i]) for i in dict.fromkeys(ids)], dtype=object)
        theirs = {}
        for i, w in zip(ids, want):
            theirs.setdefault(i, []).append(w)
        flip = [np.abs(np.concatenate([np.sort(sign * np.array(theirs[i])) - np.array(m, float) for i, m in zip(theirs, mine)])).max() for sign in (1, -1)]
        assert min(flip) < 1e-8
        for r in by[c + 1].values():
            assert r[0].explained == pytest.approx(values[c] / values.sum(), rel=1e-9)
    assert {r.n for r in got} == {len(rows)}
    assert sorted((r.vec_id, r.deviation, int(r.deviation_exact)) for r in by[1].values() for r in r) == sorted((i, d, d) for (i, _), d in zip(rows, deviation))
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-9


def test_table(spark, monkeypatch):
    vectors = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in vectors.collect()]
    assert whitening.whiten(vectors).columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error", "deviation_exact"]
    check(whitening.whiten(vectors).collect(), rows)
    # Many blocks of rows, products in many parts.
    monkeypatch.setattr(whitening, "BLOCK", 64 * 3)
    monkeypatch.setattr(whitening, "TOGETHER", 2)
    check(whitening.whiten(vectors.repartition(9)).collect(), rows)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = [(1, [0.5, -1.0, 0.25]), (2, [1.0, 2.0, 3.0]), (2, [1.0, 2.0, 3.0]), (3, [-0.25, 0.0, 7.0]), (4, [0.0, 0.0, 0.0]), (5, [1e3, 2.0, -3.5])]
    bad = [(6, None), (7, [nan, 1.0, 1.0]), (8, [inf, 1.0, 1.0]), (9, [1.0, None, 1.0]), (10, []), (11, [1.0, 2.0])]
    docs = spark.createDataFrame([(i, v, 1, "x", 2.0) for i, v in good + bad], "vec_id long, embedding array<float>, row int, vector string, component double")
    check(whitening.whiten(docs).collect(), good)
    assert whitening.whiten(docs.filter("vec_id > 5")).collect() == []  # one usable row, nothing varies
    assert whitening.whiten(docs.filter("vec_id > 90")).collect() == []
    equal = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(9)], "vec_id long, embedding array<double>")
    assert whitening.whiten(equal).collect() == []


def test_null_id_and_fewer_dimensions(spark):
    rows = [(None, [1.0, 5.0]), (7, [2.0, 5.0]), (8, [4.0, 5.0])]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted((r.vec_id is None, r.component) for r in got) == [(False, 1), (False, 1), (True, 1)]
    assert sum(r.whitened**2 for r in got) / 3 == pytest.approx(1)


def test_deviation_beyond_long(spark):
    rows = spark.createDataFrame([(1, [0.0]), (2, [4e6]), (3, [0.0])], "vec_id long, embedding array<double>")
    got = {r.vec_id: r for r in whitening.whiten(rows).collect()}
    assert got[2].deviation is None and int(got[2].deviation_exact) == (2 * 4096000000) ** 2 and got[1].deviation is None or got[1].deviation == 4096000000**2
