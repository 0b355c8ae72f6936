"""The n-gram join against all pairs of a small table."""

import re

import pytest
from pyspark.sql import functions as F

from taxatally.llm import ngram_join
from taxatally.llm.components import components
from taxatally.llm.ngram_join import keep_one, linked


def shingles(text, n, lower=True):
    text = text or ""
    if lower:
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if len(words) < n:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}


def brute(rows, n, percent):
    """(doc_id, size, smallest doc_id of the class) of every row, by comparing all pairs."""
    sets = [shingles(t, n) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    by = {}
    for i, s in enumerate(sets):
        for x in s:
            by.setdefault(x, []).append(i)
    for i, s in enumerate(sets):
        for j in {j for x in s for j in by[x] if j < i}:
            both = len(s & sets[j])
            if 100 * both >= percent * (len(s) + len(sets[j]) - both):
                root[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[find(i)] = min(d, low.get(find(i), d))
    return sorted(((d, len(sets[i]), low.get(find(i))) for i, (d, _) in enumerate(rows)), key=repr)


def base(k, size=60):
    return [f"w{k}x{(i * 7919 + k * 104729) % 9973}" for i in range(size)]


def made_rows():
    rows, k = [], 0
    for group in range(6):
        words = base(group, 40 + 15 * group)
        for copy in range(9):
            changed = list(words)
            for c in range(copy % 5):
                changed[(copy * 13 + c * 17) % len(words)] = f"new{group}y{copy}z{c}"
            rows.append((k, " ".join(changed)))
            k += 1
    # A chain in which only neighbours link, and a passage that many texts share.
    words = base(90, 80)
    for step in range(10):
        words = [*words]
        words[step * 8] = f"step{step}"
        rows.append((k, " ".join(words)))
        k += 1
    passage = " ".join(base(91, 30))
    for i in range(40):
        rows.append((k, passage + " " + " ".join(base(200 + i, 5 + i))))
        k += 1
    for text in (None, "", " \n\t", "one", "One", "one two", "ONE two three", "one two three", "a a a a a a", "é É", "É é", "x" * 5000):
        rows.append((k, text))
        k += 1
    rows += [(k, rows[0][1]), (k, rows[0][1]), (None, rows[0][1]), (None, "alone in the world of nulls"), (None, None)]
    return rows


def family(first, size=150, copies=60):
    """Copies with many changes each: some link, most only nearly."""
    words, rows = base(700 + first, size), []
    for copy in range(copies):
        changed = list(words)
        for c in range(1 + copy % 4):
            changed[(copy * 37 + c * 29 + copy * c) % size] = f"f{first}y{copy}z{c}"
        rows.append((first + copy, " ".join(changed)))
    return rows


@pytest.mark.parametrize("block", [1024, 8])
def test_family_of_near_copies(spark, monkeypatch, block):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    rows = [*family(0), *family(1000, 90, 40)]
    got = linked(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85)
    want = brute(rows, 4, 85)
    assert 4 < len({c for _, _, c in want}) < 60
    assert sorted((tuple(r) for r in got.collect()), key=repr) == want


@pytest.mark.parametrize(("n", "percent"), [(4, 85), (5, 80), (2, 60)])
def test_small_table(spark, n, percent):
    rows = made_rows()
    got = linked(spark.createDataFrame(rows, "doc_id long, text string"), n, percent)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(rows, n, percent)


@pytest.mark.parametrize(("n", "percent"), [(4, 85), (5, 80)])
def test_documents(spark, n, percent):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted((tuple(r) for r in linked(docs, n, percent).collect()), key=repr) == brute(rows, n, percent)


def test_keep_one(spark):
    rows = made_rows()
    docs = spark.createDataFrame([(d, t, "x", 1, 2) for d, t in rows], "doc_id long, text string, node string, root int, row int")
    kept = keep_one(docs)
    assert kept.columns == docs.columns
    want = {c for _, s, c in brute(rows, 5, 80) if s and c is not None}
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id in want) == sorted(want)
    assert kept.filter("doc_id is null and text is not null").count() == 1


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert linked(docs).collect() == [] and keep_one(docs).collect() == []


def test_components(spark):
    pairs = [(i, i + 1) for i in range(50, 120)] + [(7, 3), (3, 9), (9, 9), (2**62, -5)]
    got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {i: 50 for i in range(50, 121)} | {3: 3, 7: 3, 9: 3, 2**62: -5, -5: -5}
    assert components(spark.createDataFrame([(1, 1)], "a long, b long").filter(F.lit(False))).collect() == []
