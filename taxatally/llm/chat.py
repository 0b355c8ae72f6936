"""Preference pairs rendered as one prompt and two masked completions.

A pair has two conversations, chosen and rejected. The longest prefix of turns that both share
(role and text) is rendered once as the prompt; what follows in each is its completion. A
completion comes with the stretches of characters that are to be learned: the texts of the
assistant's turns with their end marks. All else is masked.

A null role or text is rendered as empty; turns agree if both are null or equal. A pair of equal
conversations is all prompt, and its completions are empty. A null conversation has no turns.
Repeated pairs are kept; an empty table gives an empty result. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TURN = "struct<role:string,text:string>"
SPANS = "array<struct<start:long,stop:long>>"
BEGIN, MIDDLE, END = "<|", "|>\n", "<|end|>\n"


def render(turns: list[dict | None]) -> tuple[str, list[dict]]:
    """The text of some turns and the spans of it that are the assistant's."""
    parts, spans, at = [], [], 0
    for turn in turns:
        turn = turn or {}
        head = f"{BEGIN}{turn.get('role') or ''}{MIDDLE}"
        body = (turn.get("text") or "") + END
        parts += [head, body]
        if turn.get("role") == "assistant":
            spans.append({"start": at + len(head), "stop": at + len(head) + len(body)})
        at += len(head) + len(body)
    return "".join(parts), spans


def preferences(pairs: DataFrame, key: str) -> DataFrame:
    """``key, n_shared, prompt, chosen, rejected, chosen_spans, rejected_spans`` of every pair.

    ``pairs`` has ``key`` and ``chosen``, ``rejected`` (arrays of structs of role and text).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for a, b in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                a, b = a or [], b or []
                n = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
                (chosen, learn), (rejected, other) = render(a[n:]), render(b[n:])
                rows.append((n, render(a[:n])[0], chosen, rejected, learn, other))
            spans = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
            kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), spans, spans]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(list(v), k) for v, k in zip(zip(*rows), kinds, strict=True))], names)

    names = [key, "n_shared", "prompt", "chosen", "rejected", "chosen_spans", "rejected_spans"]
    kind = pairs.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, n_shared long, prompt string, chosen string, rejected string, chosen_spans {SPANS}, rejected_spans {SPANS}"
    both = [F.col(c).cast(f"array<{TURN}>").alias(c) for c in ("chosen", "rejected")]
    return pairs.select(key, *both).mapInArrow(run, schema)


def worsened(turns: DataFrame) -> DataFrame:
    """``conv_id, chosen, rejected`` from conversations, for tables that hold no rejected replies.

    Chosen are the turns up to the last one of the assistant; rejected are the same with the
    words of that last reply in reverse order. A conversation without a reply is paired with
    itself. Turns go by number (null last), then role and text; repeated rows are one turn; rows
    without conv_id belong to no conversation.
    """
    turn = F.struct(F.col("turn").isNull().alias("none"), F.col("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    whole = turns.filter("conv_id is not null").groupBy("conv_id").agg(F.sort_array(F.collect_set(turn)).alias("turns"))
    whole = whole.withColumn("turns", F.expr("transform(turns, t -> named_struct('role', t.role, 'text', t.text))"))
    last = "size(turns) - array_position(reverse(transform(turns, t -> t.role <=> 'assistant')), true) + 1"
    whole = whole.withColumn("last", F.expr(f"cast(if(exists(turns, t -> t.role <=> 'assistant'), {last}, 0) as int)"))
    chosen = F.expr("if(last = 0, turns, slice(turns, 1, last))")
    worse = "named_struct('role', element_at(turns, last).role, 'text', array_join(reverse(split(element_at(turns, last).text, ' ')), ' '))"
    rejected = F.expr(f"if(last = 0, turns, concat(slice(turns, 1, last - 1), array({worse})))")
    return whole.select("conv_id", chosen.alias("chosen"), rejected.alias("rejected"))


def conversations(turns: DataFrame) -> DataFrame:
    """Every conversation as a preference pair, with the number of characters to learn."""
    rows = preferences(worsened(turns), "conv_id")
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda s, x: s + x["stop"] - x["start"])
    return rows.select("conv_id", "n_shared", "prompt", "chosen", "rejected", total("chosen_spans").alias("chosen_learn"), total("rejected_spans").alias("rejected_learn"))


#: What ``conversations`` gives, for tables with one row per conversation and turn.
SQL = """
WITH turns AS (
    SELECT DISTINCT conv_id, turn, role, text, '<|' || coalesce(role, '') || '|>' || chr(10) || coalesce(text, '') || '<|end|>' || chr(10) AS said
    FROM conversations WHERE conv_id IS NOT NULL),
last AS (SELECT conv_id, max(turn) FILTER (WHERE role = 'assistant') AS stop_turn FROM turns GROUP BY conv_id),
reply AS (
    SELECT t.conv_id, t.turn, t.said, length(coalesce(t.text, '')) + 8 AS learn,
           '<|assistant|>' || chr(10) || array_to_string(list_reverse(string_split(t.text, ' ')), ' ') || '<|end|>' || chr(10) AS other
    FROM turns t JOIN last l ON t.conv_id = l.conv_id AND t.turn = l.stop_turn),
split AS (SELECT t.*, r.turn AS stop_turn, r.said AS good, r.other AS bad, r.learn, r.said <> r.other AS differ
          FROM turns t LEFT JOIN reply r USING (conv_id) WHERE r.turn IS NULL OR t.turn <= r.turn)
SELECT conv_id,
       count(*) FILTER (WHERE stop_turn IS NULL OR NOT differ OR turn < stop_turn) AS n_shared,
       coalesce(string_agg(said, '' ORDER BY turn) FILTER (WHERE stop_turn IS NULL OR NOT differ OR turn < stop_turn), '') AS prompt,
       coalesce(max(good) FILTER (WHERE differ), '') AS chosen,
       coalesce(max(bad) FILTER (WHERE differ), '') AS rejected,
       coalesce(max(learn) FILTER (WHERE differ), 0) AS chosen_learn,
       coalesce(max(learn) FILTER (WHERE differ), 0) AS rejected_learn
FROM split GROUP BY conv_id"""
