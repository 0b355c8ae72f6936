"""Alignment of two tokenizers against a plain version that walks over both token lists."""

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from test_tokens import ODD
from tokenizers import Tokenizer

from taxatally.llm import alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
MORE = [
    "x ", " x", "  x  y ", "a   b", "a   b　 c", "é é  é", "a▁b", "x\ty\n\n z", "don't 12345 3.14", "<|endoftext|> </s> <s> <0x41> <unk>", "▁", "日本 語 テキ スト", "a" * 700, "=" * 300 + " " * 300 + "x",
]


class Plain:
    def __init__(self):
        self.a = Tokenizer.from_file(A)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=B)
        chars = alignment.byte_characters()
        self.byte = {c: i for i, c in enumerate(chars)}

    def tokens(self, text):
        a = [(i, bytes(self.byte[c] for c in self.a.id_to_token(i))) for i in self.a.encode(" " + text, add_special_tokens=False).ids]
        b = []
        for i in self.b.encode(text):
            piece = self.b.id_to_piece(i)
            b.append((i, bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()))
        want = (" " + text).encode()
        return (a, b) if text and all(b"".join(x for _, x in side) == want for side in (a, b)) else ([], [])

    def groups(self, text):
        a, b = self.tokens(text or "")
        out, i, j, p, q = [([], [])], 0, 0, 0, 0
        while i < len(a) or j < len(b):
            if p <= q and i < len(a):
                out[-1][0].append(a[i][0])
                p += len(a[i][1])
                i += 1
            else:
                out[-1][1].append(b[j][0])
                q += len(b[j][1])
                j += 1
            if p == q:
                out.append(([], []))
        return out[:-1]

    def scored(self, rows):
        found = [(i, self.groups(t)) for i, t in rows]
        counts = Counter((g[0][-1], g[1][-1]) for _, gs in found for g in gs)
        best = {}
        for (_, b), n in counts.items():
            best[b] = max(best.get(b, 0), n)
        out = []
        for i, gs in found:
            text = ";".join("|".join(",".join(map(str, side)) for side in g) for g in gs)
            links = [(g[0][-1], g[1][-1]) for g in gs]
            out.append((i, sum(len(g[0]) for g in gs), sum(len(g[1]) for g in gs), len(gs), len(links), sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links), hashlib.sha256(text.encode()).hexdigest() if gs else ""))
        return out


def key(row):
    return repr(tuple(row))


def test_odd_texts(spark):
    rows = [(i, t) for i, t in enumerate([*ODD, *MORE])] + [(None, "no id here"), (3, "again and again"), (3, "again and again")]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, n_a int, links string")
    got = alignment.scored(docs, A, B)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    want = Plain().scored(rows)
    assert sum(r[1] == 0 for r in want) >= 4
    assert sorted(map(key, got.collect())) == sorted(map(key, want))
    assert alignment.scored(docs.filter("doc_id > 999"), A, B).collect() == []


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    plain = Plain()
    assert sorted(map(key, alignment.scored(docs.repartition(5), A, B).collect())) == sorted(map(key, plain.scored(rows)))
    for r in alignment.aligned(docs, A, B).limit(20).collect():
        cut = lambda ids, stops: [ids[a:b] for a, b in zip([0, *stops], stops)]
        assert list(zip(cut(r.a_ids, r.a_stops), cut(r.b_ids, r.b_stops))) == plain.groups(dict(rows)[r.doc_id])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("ab éß \t\n.'1日 ▁-  "), max_size=40), min_size=1, max_size=6))
def test_any_text(texts):
    import pyarrow as pa

    plain, aligner = PLAIN, alignment.load(A, B)
    got = []
    for x in aligner(pa.array(texts, pa.string())):
        for i in range(len(x)):
            gs, a0, b0 = [], x.a_edges[i], x.b_edges[i]
            for c in range(x.cut_edges[i], x.cut_edges[i + 1]):
                a1, b1 = x.a_cuts[c] + 1, x.b_cuts[c] + 1
                gs.append((x.a_ids[a0:a1].tolist(), x.b_ids[b0:b1].tolist()))
                a0, b0 = a1, b1
            got.append(gs)
    assert got == [plain.groups(t) for t in texts]


PLAIN = Plain()


def test_common_ends():
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 50, 3000):
        ends = np.cumsum(rng.integers(1, 3, 4 * n))
        a = np.unique(np.append(rng.choice(ends, n), [ends[-1]]))
        for share in (0.02, 0.5):
            b = np.unique(np.concatenate((rng.choice(ends, n), a[rng.random(len(a)) < share], [ends[-1]])))
            assert alignment.common_ends(a, b, np.array([0, len(a)])).tolist() == np.flatnonzero(np.isin(a, b)).tolist()
    a, b = np.append(np.arange(2, 40000, 2), [40001]), np.append(np.arange(3, 40000, 2), [40001])
    assert alignment.common_ends(a, b, np.array([0, len(a)])).tolist() == [len(a) - 1]


def test_pairs_hold_every_link():
    aligner = alignment.load(A, B)
    assert len(aligner.pairs) < 1_000_000
