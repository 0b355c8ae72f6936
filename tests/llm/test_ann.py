"""Nearest neighbours against brute force."""

import numpy as np
import pytest

from taxatally.llm import ann


def brute(rows, k, step):
    """Exact neighbours of the queries: id -> [(id, score)]."""
    ids, vectors = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], dtype=float)
    norms = np.linalg.norm(vectors, axis=1)
    out = {}
    for i in np.flatnonzero(ids % step == 0):
        score = vectors @ vectors[i] / (norms * norms[i])
        at = np.flatnonzero(ids != ids[i])
        best = at[np.lexsort((ids[at], -np.round(score[at], 12)))[:k]]
        out[int(ids[i])] = list(zip(ids[best].tolist(), score[best].tolist(), strict=True))
    return out


def recall(got, want):
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append(r)
    hits = total = 0
    for q, best in want.items():
        mine = sorted(by.get(q, []), key=lambda r: r.rank)
        assert [r.rank for r in mine] == list(range(1, len(mine) + 1))
        assert all((a.score, -a.vec_id) >= (b.score, -b.vec_id) for a, b in zip(mine, mine[1:]))
        hits += len({r.vec_id for r in mine} & {i for i, _ in best})
        total += len(best)
        for r in mine:
            for i, s in best:
                assert r.vec_id != i or abs(r.score - s) < 1e-12
    assert set(by) <= set(want)
    return hits / max(1, total)


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.1"])
def test_recall(spark, folder):
    vectors = spark.read.parquet(f"/root/testdata/{folder}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in vectors.collect()]
    assert recall(ann.divisible(vectors).collect(), brute(rows, 5, 50)) >= 0.9


def test_clustered_copies_and_ties(spark):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((20, 16))
    rows = [(i, (centres[i % 20] + 0.05 * rng.standard_normal(16)).tolist()) for i in range(1500)]
    rows += [(i, [1.0] * 16) for i in range(1500, 2200)] + [(i, [2.0] * 16) for i in range(2200, 2300)]
    got = ann.divisible(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert recall(got, brute([(i, np.float32(v)) for i, v in rows], 5, 50)) >= 0.9
    assert [r.vec_id for r in sorted(got, key=lambda r: r.rank) if r.query_id == 1550] == [1500, 1501, 1502, 1503, 1504]


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, None), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [nan, 1.0]), (6, [inf, 1.0]), (None, [1.0, 0.0]), (50, [0.0, 3.0]), (100, [1.0, 2.0, 3.0]), (150, []), (0, [1.0, 0.0]), (1, [1.0, 1.0])]
    docs = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<float>, rank int, score int")
    got = sorted(tuple(r) for r in ann.divisible(docs).collect())
    assert [r[:3] for r in got] == [(0, 1, 1), (0, 2, 50), (50, 1, 1), (50, 2, 0)]
    assert got[0][3] == pytest.approx(0.5**0.5)
    assert ann.divisible(docs.filter("vec_id > 1000")).collect() == []
    assert ann.divisible(docs.filter("vec_id = 0")).collect() == []


def test_probing_order():
    sets = ann.perturbations(4, 81)
    assert len(sets) == 81 and not sets[0].any() and len({tuple(r) for r in sets}) == 81
    assert not (sets & sets[:, ::-1]).any()
