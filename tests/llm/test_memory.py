"""What a task of the operators holds and sends, without Spark around it."""

import tracemalloc
from types import SimpleNamespace

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import types as T
from tokenizers import Tokenizer

from taxatally.llm import bpe, ngram_join, words

BYTE = public_tokenizers.path("byte_bpe_50k.json")


class Captured:
    """A table of ``doc_id, text`` that keeps the function given to mapInArrow."""

    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())])
    sparkSession = SimpleNamespace(conf=SimpleNamespace(set=lambda *_: None))

    def select(self, *_):
        return self

    def mapInArrow(self, run, schema):  # noqa: N802
        self.run = run
        return self


def test_encoding_holds_little(spark):
    """A task over many new words; what it holds doesn't follow its input."""
    rng = np.random.default_rng(3)
    letters = np.frombuffer(b"abcdefghijklmnopqrstuvwxyz", np.uint8)
    texts = [" ".join(letters[rng.integers(0, 26, (2_000, 5))].view("S5").ravel().astype(str)) for _ in range(200)]
    batches = [pa.RecordBatch.from_arrays([pa.array(range(a, a + 40)), pa.array(texts[a : a + 40])], ["doc_id", "text"]) for a in range(0, 200, 40)]
    run, library = bpe.encoded(Captured(), BYTE).run, Tokenizer.from_file(BYTE)
    bpe.load(BYTE)
    tracemalloc.start()
    try:
        seen = 0
        for out in run(iter(batches)):
            assert out.nbytes <= 2 << 20
            for i, ids, text in zip(*(c.to_pylist() for c in out.columns), strict=True):
                assert i == seen and text == texts[i]
                assert i % 40 or np.frombuffer(ids, "<u4").tolist() == library.encode(texts[i], add_special_tokens=False).ids
                seen += 1
        peak = tracemalloc.get_traced_memory()[1] / 2**20
    finally:
        tracemalloc.stop()
    assert seen == len(texts)
    assert peak < 110, f"{peak:.0f} MB"


def test_batches_that_leave_a_task_are_bounded():
    column = pa.array(range(1_000_000), pa.int64())
    big = pa.RecordBatch.from_arrays([column], ["x"])
    out = list(words.tidy(lambda batches: batches)(iter([big, big.slice(0, 0), big.slice(5, 1)])))
    assert max(b.nbytes for b in out) <= 1 << 20
    assert pa.concat_arrays([b.column(0) for b in out]).equals(pa.concat_arrays([column, column.slice(5, 1)]))
    wide = pa.RecordBatch.from_arrays([pa.array(["y" * (3 << 20), "", "z"])], ["x"])
    assert [b.column(0).to_pylist() for b in words.tidy(lambda batches: batches)(iter([wide]))] == [["y" * (3 << 20)], [""], ["z"]]


def test_one_python_worker_for_each_task(spark, monkeypatch):
    """No stage of the n-gram join runs one Python function on the rows of another."""
    plans = []
    write = ngram_join.stored
    monkeypatch.setattr(ngram_join, "stored", lambda df, *a: (plans.append(df._jdf.queryExecution().executedPlan().toString()), write(df, *a))[1])
    ngram_join.linked(spark.read.parquet("/root/testdata/sf0.001/documents.parquet")).count()
    assert any("MapInArrow" in p for p in plans)
    for plan in plans:
        open_at = []
        for line in plan.split("\n"):
            depth = len(line) - len(line.lstrip(" :+-*(0123456789)"))
            open_at = [x for x in open_at if x[0] < depth]
            if "MapInArrow" in line:
                assert "Exchange" in [x[1] for x in open_at][-1:] or "MapInArrow" not in [x[1] for x in open_at]
                open_at.append((depth, "MapInArrow"))
            elif "Exchange hash" in line:
                open_at.append((depth, "Exchange"))
