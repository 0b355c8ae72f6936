"""The pipeline against plain Python, stage by stage."""

import hashlib
import re
from collections import Counter

import numpy as np
import public_tokenizers
from test_line_dedup import brute as lines_brute
from test_mixing import check as check_mix
from test_ngram_join import brute as copies_brute
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from taxatally.llm import line_dedup, mixing, ngram_join
from taxatally.session import stored

FOLDER = "/root/testdata/sf0.001"


def good(text):
    """All quality rules on one text."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, windows = len(words), Counter(zip(words, words[1:], words[2:]))
    repeated = {j for i in range(n - 2) if windows[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    chars, symbols = sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or ""))
    return n >= 50 and 100 * len(repeated) <= 50 * n and 2 * n <= chars <= 20 * n and 100 * symbols <= 30 * n and 2 * (len(lines) - len(set(lines))) <= len(lines)


def test_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    odd = [(10_000 + i, t, None, s, None) for i, (t, s) in enumerate([(None, None), ("", "src0"), ("w " * 200, "src1"), (" ".join(f"a{i}" for i in range(80)), None), (" ".join(f"a{i}" for i in range(80)), None)])]
    docs = docs.union(spark.createDataFrame([*odd, odd[-1]], docs.schema))
    columns = docs.columns
    stage = {}
    for name, run in corpus_pipeline.STAGES:
        stage[name] = (docs.collect(), None)
        docs = stored(run(spark, docs, FOLDER), "stage")
        stage[name] = (stage[name][0], docs.collect())
        if name != "BPE encoding and decoding":
            assert docs.columns == columns
    was, now = stage["quality rules"]
    assert sorted(r.doc_id for r in now) == sorted(r.doc_id for r in was if good(r.text)) and len(now) < len(was)
    was, now = stage["line dedup"]
    assert sorted(((r.source, r.text) for r in now), key=repr) == lines_brute([(r.source, r.text) for r in was], 0.1, 3)
    was, now = stage["n-gram Jaccard join"]
    classes = copies_brute([(r.doc_id, r.text) for r in was], 5, 80)
    assert sorted(r.doc_id for r in now) == sorted({c for _, _, c in classes}) and len(now) < len(was)
    was, now = stage["mixing sources to target weights"]
    taken, by = Counter(r.doc_id for r in now), {}
    rows = [(r.doc_id, r.source, r.text) for r in was]
    from taxatally.llm import mixing

    got = mixing.mixed(spark.createDataFrame(rows, "doc_id long, source string, text string")).collect()
    assert max(check_mix(rows, got).values()) <= 1
    for r in got:
        by[r.doc_id] = r.taken // r.size if r.size else 0
    assert taken == {d: n for d, n in by.items() if n}
    was, now = stage["BPE encoding and decoding"]
    library, texts = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), {r.doc_id: r.text for r in was}
    assert sorted(r.doc_id for r in now) == sorted(r.doc_id for r in was)
    for r in now:
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert np.frombuffer(r.ids, "<u4").tolist() == ids and r.n_tokens == len(ids)
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_run_equals_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    for _, run in corpus_pipeline.STAGES:
        docs = stored(run(spark, docs, FOLDER), "stage")
    assert sorted(map(tuple, corpus_pipeline.run(spark, FOLDER).collect())) == sorted(map(tuple, docs.collect()))


def test_empty(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").filter("doc_id < 0")
    for _, run in corpus_pipeline.STAGES:
        docs = stored(run(spark, docs, FOLDER), "stage")
    assert docs.collect() == []


def test_near_copies_survive_line_dedup_once(spark):
    """A family of near copies above the ratio keeps its text in one document; real boilerplate goes."""
    words = lambda key, n: " ".join(f"{key}{j}" for j in range(n))
    report = [words(f"report{i}x", 20) for i in range(20)]
    rows = []
    for i in range(40):
        lines = [*report]
        # One line of each copy is edited, never the same way.
        lines[i % 20] = words(f"edit{i}x", 20)
        rows.append((i, "\n".join(lines)))
    for i in range(100, 200):
        rows.append((i, "\n".join([words(f"own{i}x", 60), "all rights reserved by the site", words(f"end{i}x", 60)])))
    schema = spark.read.parquet(f"{FOLDER}/documents.parquet").schema
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], schema)
    steps = dict(corpus_pipeline.STAGES)
    cut = stored(steps["line dedup"](spark, docs, FOLDER), "stage")
    texts = {r.doc_id: r.text for r in cut.collect()}
    assert all(texts[i] == t for i, t in rows if i < 100)
    assert all(texts[i] == t.replace("all rights reserved by the site\n", "") for i, t in rows if i >= 100)
    kept = sorted(r.doc_id for r in steps["n-gram Jaccard join"](spark, cut, FOLDER).collect())
    assert kept == [0, *range(100, 200)]


def test_lines_in_a_twelfth_of_a_source_go(spark):
    words = lambda key, n: " ".join(f"{key}{j}" for j in range(n))
    rows = [(i, f"{words(f'own{i}x', 60)}{chr(10)}{'all rights reserved' if i % 12 == 0 else 'now and then' if i % 25 == 1 else 'end'}{'' if i % 12 == 0 or i % 25 == 1 else i}") for i in range(300)]
    schema = spark.read.parquet(f"{FOLDER}/documents.parquet").schema
    out = corpus_pipeline.line_stage(spark, spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], schema), FOLDER)
    assert {r.doc_id: r.text for r in out.collect()} == {i: t.replace("\nall rights reserved", "") for i, t in rows}


def test_names_that_operators_use_themselves(spark):
    names = ["_row", "_key", "_size", "_bad", "_site", "_copies", "_copy", "row_", "key_", "size_", "site_", "cut_", "copies_", "copy_"]
    rows = [(i, f"line of text number {i % 4} with some more words in it\nsecond", "s", *range(i, i + len(names))) for i in range(8)]
    docs = spark.createDataFrame(rows, ", ".join(["doc_id long, text string, source string", *(f"{n} int" for n in names)]))
    for out in (ngram_join.keep_one(docs), line_dedup.drop_boilerplate(docs, F.col("source"), 0.9), mixing.mix(docs)):
        got = out.collect()
        assert out.columns == docs.columns and got
        assert all(tuple(r)[3:] == rows[r.doc_id][3:] for r in got)
