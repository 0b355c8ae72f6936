"""The classifier on held-out rows, and the effect of the counterfactual penalty."""

import zlib

import numpy as np
import pyarrow as pa

from taxatally.llm import toxicity
from taxatally.llm.words import pieces


def probability(model, text):
    return float(np.concatenate([model.scores(p) for p in pieces(pa.array([text]))])[0])


def test_held_out(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(docs, labels)
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    assert len(got) == docs.count()
    hit = missed = false = clean = 0
    for r in labels.collect():
        out = zlib.crc32(str(r.doc_id).encode()) % 4 == 2
        assert got[r.doc_id].held_out == out
        if out:
            p = got[r.doc_id].predicted
            hit, missed, false, clean = hit + (r.toxic and p), missed + (r.toxic and not p), false + (not r.toxic and p), clean + (not r.toxic and not p)
    assert hit / (hit + missed) > 0.75 and false / (false + clean) < 0.03


def test_labels_that_are_held_out_do_not_matter(spark):
    rows = [(i, f"fine word{i % 9} here" + (" awful" if i % 5 == 0 else "")) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    truth = [(i, int(i % 5 == 0)) for i in range(400)]
    lies = [(i, t if zlib.crc32(str(i).encode()) % 4 != 2 else 1 - t) for i, t in truth]
    a, b = (toxicity.train(docs, spark.createDataFrame(x, "doc_id long, toxic int")) for x in (truth, lies))
    assert (a.words == b.words).all() and np.allclose(a.weights, b.weights, atol=1e-8) and abs(a.bias - b.bias) < 1e-8


def test_counterfactual_penalty(spark):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(800):
        words = [f"w{k}" for k in rng.integers(0, 40, 12)]
        toxic = i % 4 == 0
        if toxic:
            words.append(["nasty", "vile"][i // 4 % 2])
        # One group is named mostly in toxic texts, the other in neutral ones.
        if rng.random() < (0.8 if toxic else 0.1):
            words.append("muslim" if rng.random() < 0.9 else "christian")
        elif rng.random() < 0.3:
            words.append("christian")
        rows.append((" ".join(words), int(toxic and rng.random() < 0.8)))
    labelled = spark.createDataFrame(rows, "text string, label int")
    plain, fair = toxicity.fit(labelled, swap_weight=0.0), toxicity.fit(labelled)
    a, b = "w1 w2 the muslim family w3", "w1 w2 the christian family w3"
    assert abs(probability(fair, a) - probability(fair, b)) < 0.3 * abs(probability(plain, a) - probability(plain, b))
    assert probability(fair, a) < probability(plain, a)
    assert probability(fair, "w1 w2 nasty w3") > 0.3 > probability(fair, "w1 w2 w3")


def test_words_and_odd_rows(spark):
    a, b = (np.concatenate([toxicity.trimmed_hashes(p) for p in pieces(pa.array([t]))]) for t in ('Stupid, (IDIOT)! "x" ...  Été', "stupid idiot x - Été"))
    assert (a == b).all() and a[3] == 0
    for text in ("...", "a ...", "... a", "- -"):
        assert len(np.concatenate([toxicity.trimmed_hashes(p) for p in pieces(pa.array([text]))])) == len(text.split())
    docs = spark.createDataFrame([(1, None, 3.0), (1, None, 3.0), (None, "bad", 1.0), (2, "", 0.0), (3, "bad " * 50_000, 1.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(1, None), (None, 1), (3, 7), (3, 1), (3, 0)], "doc_id long, toxic int")
    out = toxicity.score(docs, toxicity.train(docs, labels)).collect()
    assert len(out) == 5 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in out)
    nothing = toxicity.train(docs, labels.filter("toxic = 9"))
    assert {r.score for r in toxicity.score(docs, nothing).collect()} == {0.5}
    assert toxicity.score(docs.filter("doc_id > 9"), nothing).collect() == []
