"""Quality rules: counts, verdicts and the order of the cascade."""

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from oracle import database, difference

from taxatally.llm import quality
from taxatally.llm.words import pieces


def counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = Counter(zip(words, words[1:], words[2:]))
    repeated = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(repeated)


ODD = [None, "", " \n\t", "a b c a b c", "x " * 500, "one\none\n one\none", "é ß 日本 🎉 " * 40, "#$% " * 60, " ".join(f"w{i}" for i in range(80)), "z" * 100_000, "\n".join(f"l{i % 3} a b c d e f g h {i}" for i in range(30)), " ".join(f"k{i} |" for i in range(60))]


def test_counts_and_verdicts(spark):
    rows = [(i, t, 1) for i, t in enumerate(ODD)] + [(None, "no id", 2), (3, ODD[3], 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words int")
    got = quality.measure(docs).collect()
    assert sorted(((r.doc_id, *(r[c] for c in quality.COUNTS)) for r in got), key=repr) == sorted(((i, *counts(t)) for i, t, _ in rows), key=repr)
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.base_failed and r.kept)
    kept = {r.doc_id for r in got if r.kept}
    assert kept == {8} and sorted(r.doc_id for r in quality.passing(docs).collect()) == [8]
    assert quality.passing(docs).columns == docs.columns
    assert quality.measure(docs.filter("n_words > 9")).collect() == [] and quality.passing(docs.filter("n_words > 9")).collect() == []


def test_order_does_not_change_verdicts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    a = sorted(map(tuple, quality.measure(docs, quality.RULES).collect()))
    assert a == sorted(map(tuple, quality.measure(docs, quality.RULES[::-1]).collect()))
    assert sorted(r.doc_id for r in quality.passing(docs, quality.RULES[::-1]).collect()) == [r[0] for r in a if r[-1]]


def test_short_circuit(spark):
    seen = []
    first = quality.Rule("first", lambda c, rows: rows % 2 == 0)
    second = quality.Rule("second", lambda c, rows: (seen.append(rows.tolist()), rows < 0)[1])
    import pyarrow as pa

    (piece,) = quality.pieces(pa.array(["a", "b", "c", "d"]))
    assert quality.run_cascade(quality.Counts(piece), [first, second]).tolist() == [False, True, False, True] and seen == [[1, 3]]
    order = quality.cascade(spark.createDataFrame([("x " * 500,)] * 20, "text string"))
    assert order[0].name in {"too_short", "repetitive", "odd_word_length"} and {r.name for r in order} == {r.name for r in quality.RULES}


def test_sql(spark):
    folder = "/root/testdata/sf0.01"
    assert difference(quality.measure(spark.read.parquet(f"{folder}/documents.parquet")), database(folder), quality.SQL) is None


def test_the_cascade_saves_work(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    n, rules = docs.count(), quality.cascade(docs)
    got = {r.rule: r for r in quality.work(docs, rules).collect()}
    left = n
    for r in rules:
        assert got[r.name].looked_at == left
        left -= got[r.name].rejected
    assert left == quality.passing(docs, rules).count()
    assert sum(r.looked_at for r in got.values()) < 0.95 * n * len(rules)


def test_counts_are_computed_for_rows_asked_for():
    texts = pa.array(["one two three", None, "a b c a b c", "x\nx\ny", "é # ü"])
    piece = next(iter(pieces(texts)))
    c = quality.Counts(piece)
    rows = np.array([2, 3])
    for name in (*quality.COUNTS, "n_lines"):
        some = getattr(c, name)(rows)
        assert c.computed[name] == 2
        every = getattr(c, name)(np.arange(5))
        assert c.computed[name] == 5 and (every[rows] == some).all() and (every == getattr(quality.Counts(piece), name)(np.arange(5))).all()
