"""Repeated passages against the comparison of all stretches."""

import re

import pytest

from taxatally.llm import passages


def brute(rows, length):
    """(doc_id, n_words, spans) by looking up every stretch in all texts."""
    texts = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    held, copies = {}, {}
    for (_, t), words in zip(rows, texts, strict=True):
        copies[t or ""] = copies.get(t or "", 0) + 1
        for i in range(len(words) - length + 1):
            held.setdefault(tuple(words[i : i + length]), set()).add(t)
    out = []
    for (d, t), words in zip(rows, texts, strict=True):
        spans = []
        for i in range(len(words) - length + 1):
            if len(held[tuple(words[i : i + length])]) > 1:
                if spans and i <= spans[-1][1]:
                    spans[-1][1] = i + length
                else:
                    spans.append([i, i + length])
        if copies[t or ""] > 1 and len(words) >= length:
            spans = [[0, len(words)]]
        out.append((d, len(words), [tuple(s) for s in spans]))
    return sorted(out, key=repr)


def result(docs):
    return sorted(((r.doc_id, r.n_words, [(s.start, s.stop) for s in r.spans]) for r in docs.collect()), key=repr)


def words(seed, n):
    return [f"s{seed}w{i * 31 % 997}" for i in range(n)]


@pytest.mark.parametrize("hold", [1 << 19, 40])
def test_small(spark, monkeypatch, hold):
    monkeypatch.setattr(passages, "HOLD", hold)
    rows, k = [], 0
    for size in (49, 50, 51, 60, 75, 76, 120, 300):
        passage = words(size, size)
        for copy in range(4):
            rows.append((k, " ".join([*words(1000 + k, copy * 13), *passage, *words(2000 + k, 40 - copy * 13)])))
            k += 1
    # Passages that share a middle but not their ends, so that neighbours in one order mislead.
    middle = words(7, 30)
    for left, right in ((25, 5), (25, 40), (0, 40), (10, 10), (5, 15), (15, 5)):
        for tail in ("x", "y"):
            rows.append((k, " ".join([tail, *words(8, 40)[40 - left :], *middle, *words(9, 60)[:right], tail, *words(3000 + k, 9)])))
            k += 1
    rows += [(k, "a " * 120), (k + 1, "a " * 70), (k + 2, "b " * 120), (k + 3, None), (k + 4, ""), (k + 5, "one"), (None, rows[0][1]), (None, " ".join(words(5, 80))), (k, "a " * 120)]
    rows.append((k + 6, "\n".join(words(5, 80)) + "\t end"))
    docs = spark.createDataFrame([(d, t, 1, "k") for d, t in rows], "doc_id long, text string, place int, key string")
    assert result(passages.repeats(docs.repartition(5))) == brute(rows, 50)


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = result(passages.repeats(docs))
    assert got == brute(rows, 50) and any(s for _, _, s in got)


def test_empty(spark):
    assert passages.repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []
