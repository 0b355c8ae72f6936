"""Token stores against the tokenizers library and plain arrays."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from taxatally.llm import bpe, tokens
from taxatally.session import new_path

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
ODD = [
    None, "", " ", "\n\n \t ", "a", "It's the  end of lines\x0b\x0c\r\n\r\nwe've", "<|endoftext|>", "x<|endoftext|>y <|startoftext|> z", "aaaaaaaaaaaaaaaaa" * 9,
    "é ́x ẛ̣ ΑΣ ΌΣΟΣ İI ǅ ﬁ \x1c\x1f\x85 ﻿ ​", "日本語 テキスト 123٤५ ½ ²", "🎉👩‍👩‍👧‍👦 \U0001f1e6\U0001f1e7", "word " * 3000, "ab" * 4000, "'s't're've'm'll'd S'S", "tab\there \r x", "\x00\x01 \x7f", "plain words, with İstanbul. ÀÉÎ, ſ ŉ. ª º, a. B, c.. d., .e ,", "ﬀ ĳ Ĳ. straße STRASSE, x́ e\u0301.",
]


def test_codes():
    rng = np.random.default_rng(5)
    for n in (1, 7, 8, 511, 512, 513, 5000):
        ids = np.concatenate([rng.integers(0, 2**k, n) for k in (8, 9, 16, 17, 32)]).astype(np.uint32)
        rng.shuffle(ids)
        codes = tokens.Codes.of(ids)
        assert [codes[i] for i in range(0, len(ids), 1 + n // 50)] == ids[:: 1 + n // 50].tolist()
        for a, b in [(0, len(ids)), (3, 3), (1, 2), *np.sort(rng.integers(0, len(ids) + 1, (30, 2)), axis=1).tolist()]:
            assert (codes.read(a, b) == ids[a:b]).all()
    assert len(tokens.Codes.of(np.zeros(0, np.uint32)).read(0, 0)) == 0


@pytest.mark.parametrize("segment", [1 << 18, 50])
def test_store(spark, monkeypatch, segment):
    library = Tokenizer.from_file(WORD)
    rows = [(i * 3 % 17, t, 1) for i, t in enumerate(ODD)] + [(None, "no id", 1), (4, "again", 2), (4, "again", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start int")
    monkeypatch.setattr(tokens, "SEGMENT", segment)
    got = tokens.round_trip(docs, WORD).orderBy("start").collect()
    assert [r.doc_id for r in got] == sorted([r[0] for r in rows], key=lambda x: -1 if x is None else x)
    at, want = 0, []
    for r in got:
        assert r.start == at
        at += r.n_tokens
    for i, t, _ in rows:
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], dtype="<u4")
        want.append((i, len(ids), zlib.crc32(ids.tobytes())))
    assert sorted(((r.doc_id, r.n_tokens, r.ids_crc32) for r in got), key=repr) == sorted(want, key=repr)


def test_documents(spark):
    library = Tokenizer.from_file(WORD)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got, at = {r.doc_id: r for r in tokens.round_trip(docs.repartition(7), WORD).collect()}, 0
    for r in docs.orderBy("doc_id").collect():
        ids = np.array([*library.encode(r.text, add_special_tokens=False).ids, 2], dtype="<u4")
        assert (got[r.doc_id].start, got[r.doc_id].n_tokens, got[r.doc_id].ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_random_access_in_store(spark):
    docs = spark.createDataFrame([(1, "one two three four five"), (2, "six seven")], "doc_id long, text string")
    path = new_path(spark, "tokens")
    tokens.write(docs, path, WORD, 2)
    rows = tokens.open_store(spark, path).orderBy("first_token").collect()
    ids = Tokenizer.from_file(WORD).encode("one two three four five", add_special_tokens=False).ids
    first = rows[0]
    assert tokens.Codes([bytes(x) for x in first.chunks], [bytes(x) for x in first.bits], [bytes(x) for x in first.ranks])[3] == ids[3]


def test_tokens_over_segments(spark, monkeypatch):
    monkeypatch.setattr(tokens, "SEGMENT", 300)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    path = new_path(spark, "tokens")
    tokens.write(docs, path, WORD, 2)
    library, every = Tokenizer.from_file(WORD), []
    for r in docs.orderBy("doc_id").collect():
        every += [*library.encode(r.text, add_special_tokens=False).ids, 2]
    store = tokens.open_store(spark, path)
    assert store.count() > 20
    for a, b in [(0, 1), (0, len(every)), (250, 900), (299, 301), (len(every) - 1, len(every)), (7, 7), (5000, 5001)]:
        assert tokens.read_tokens(store, a, b).tolist() == every[a:b]


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert tokens.round_trip(docs, WORD).collect() == []
    assert bpe.round_trip(docs, BYTE).collect() == []


def test_bpe(spark):
    library = Tokenizer.from_file(BYTE)
    rows = [(i, t, b"x") for i, t in enumerate(ODD)] + [(None, "no id", None), (3, "again", None), (3, "again", None)]
    got = bpe.encoded(spark.createDataFrame(rows, "doc_id long, text string, ids binary"), BYTE).collect()
    want = []
    for i, t, _ in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((i, np.array(ids, dtype="<u4").tobytes(), library.decode(ids, skip_special_tokens=False)))
    assert sorted(((r.doc_id, bytes(r.ids), r.decoded) for r in got), key=repr) == sorted(want, key=repr)
    assert all(d == (t or "") for (_, t, _), (_, _, d) in zip(rows, want, strict=True))


def test_bpe_documents(spark):
    library = Tokenizer.from_file(BYTE)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in bpe.encoded(docs, BYTE).collect():
        assert np.frombuffer(r.ids, "<u4").tolist() == library.encode(texts[r.doc_id], add_special_tokens=False).ids and r.decoded == texts[r.doc_id]
