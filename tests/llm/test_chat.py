"""Preference pairs: prefixes, masks and odd turns."""

from oracle import database, difference

from taxatally.llm import chat


def test_pairs(spark):
    u, a = ("user", "hi"), ("assistant", "hello you")
    rows = [
        (1, [u, a], [u, ("assistant", "no")]),
        (2, [u, a, u], [u, a]),
        (3, [u, a], [u, a]),
        (4, None, [u]),
        (5, [], None),
        (6, [(None, None), u], [(None, None), ("user", None)]),
        (6, [("user", "x" * 70_000)], [("user", "y")]),
        (None, [("system", "s"), u, a, u, a], [("system", "s"), u, ("assistant", "bad"), u, a]),
    ]
    pairs = spark.createDataFrame([(*r, "p", 1) for r in rows], f"id long, chosen array<{chat.TURN}>, rejected array<{chat.TURN}>, prompt string, n_shared int")
    out = chat.preferences(pairs, "id").collect()
    assert len(out) == len(rows)
    by = {r.id: r for r in out}
    said = lambda *turns: "".join(f"<|{r}|>\n{t}<|end|>\n" for r, t in turns)
    assert (by[1].n_shared, by[1].prompt, by[1].chosen, by[1].rejected) == (1, said(u), said(a), said(("assistant", "no")))
    assert (by[2].n_shared, by[2].chosen, by[2].rejected, by[2].chosen_spans) == (2, said(u), "", [])
    assert (by[3].n_shared, by[3].prompt, by[3].chosen, by[3].rejected) == (2, said(u, a), "", "")
    assert (by[4].n_shared, by[4].chosen, by[4].rejected) == (0, "", said(u)) and by[5].prompt == ""
    last = by[None]
    assert last.n_shared == 2 and [last.chosen[s.start : s.stop] for s in last.chosen_spans] == ["hello you<|end|>\n"] * 2
    assert [last.rejected[s.start : s.stop] for s in last.rejected_spans] == ["bad<|end|>\n", "hello you<|end|>\n"]
    assert {r.n_shared for r in out if r.id == 6} == {1, 0}


def test_conversations(spark):
    rows = [(1, 0, "user", "q"), (1, 1, "assistant", "one two"), (1, 1, "assistant", "one two"), (1, 2, "user", "bye"), (2, 0, "user", "alone"), (3, 0, "assistant", "same"), (None, 0, "user", "x"), (4, None, "assistant", None), (4, 5, None, "z")]
    docs = spark.createDataFrame([(*r, "c") for r in rows], "conv_id long, turn long, role string, text string, chosen string")
    got = {r.conv_id: r for r in chat.conversations(docs).collect()}
    assert set(got) == {1, 2, 3, 4}
    assert (got[1].n_shared, got[1].chosen, got[1].rejected) == (1, "<|assistant|>\none two<|end|>\n", "<|assistant|>\ntwo one<|end|>\n") and got[1].chosen_learn == 15
    assert (got[2].n_shared, got[2].chosen) == (1, "") and (got[3].n_shared, got[3].chosen) == (1, "")
    assert got[4].n_shared == 2 and chat.conversations(docs.filter("conv_id > 9")).collect() == []


def test_table(spark):
    folder = "/root/testdata/sf0.01"
    assert difference(chat.conversations(spark.read.parquet(f"{folder}/conversations.parquet")), database(folder), chat.SQL) is None
