"""Quality rules as a short-circuit cascade, the rules ordered by rejection per cost.

``measure`` gives the counts of every text. ``cascade`` estimates cost and rejection of each
rule on a bounded sample and returns the rules in the order of rejection per cost. ``passing`` and
``measure`` run them in that order: a rejected text isn't looked at by later rules, and a count is computed once,
for the texts that some rule looks at. ``measure`` returns all counts of all texts, so it computes what is
missing in the end. The order changes the work only, never the verdict; ``work`` counts it.

Null and empty texts have no words and fail the base rule. Repeated rows and ties are judged
row by row; an empty table gives an empty result; extra columns are untouched.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import ragged, totals
from .words import Piece, bound_batches, grams, pieces, word_hashes

#: Rows on which cost and rejection are estimated; the only use of the sample.
SAMPLE_ROWS = 500

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

_SYMBOL = np.zeros(256, dtype=np.int64)
_SYMBOL[list(b"#*$%&|<>")] = 1
#: Bytes that begin a character.
_LEAD = np.array([int(b & 0xC0 != 0x80) for b in range(256)], dtype=np.int64)
#: Bytes of words.
_INSIDE = np.array([int(b not in b" \t\n\v\f\r") for b in range(256)], dtype=np.int64)


class Counts:
    """Counts of the texts of one piece: each is computed for the rows asked for, once.

    ``computed`` says how many texts each count was computed for so far.
    """

    def __init__(self, piece: Piece):
        self.piece = piece
        self.computed: dict[str, int] = {}
        self._known: dict[str, tuple[np.ndarray, np.ndarray]] = {}

    def _count(self, name: str, rows: np.ndarray, compute: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
        if name not in self._known:
            self._known[name] = np.zeros(len(self.piece), np.int64), np.zeros(len(self.piece), bool)
        values, known = self._known[name]
        new = rows[~known[rows]]
        if len(new):
            values[new] = compute(new)
            known[new] = True
            self.computed[name] = self.computed.get(name, 0) + len(new)
        return values[rows]

    def _bytes(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of the rows in a row, and where each begins and ends there."""
        p = self.piece
        sizes = np.diff(p.offsets)[rows]
        edges = np.concatenate(([0], np.cumsum(sizes)))
        return (p.data if len(rows) == len(p) else p.data[ragged(p.offsets[rows], sizes)]), edges

    def _words(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the words of the rows, and the edges of the rows in it."""
        first, sizes = self.piece.per_text[rows], np.diff(self.piece.per_text)[rows]
        return ragged(first, sizes), np.concatenate(([0], np.cumsum(sizes)))

    def n_words(self, rows: np.ndarray) -> np.ndarray:
        return self._count("n_words", rows, lambda new: np.diff(self.piece.per_text)[new])

    def word_chars(self, rows: np.ndarray) -> np.ndarray:
        def compute(new: np.ndarray) -> np.ndarray:
            data, edges = self._bytes(new)
            # Bytes that begin a character and aren't white space.
            return totals(_LEAD[data] * _INSIDE[data], edges)

        return self._count("word_chars", rows, compute)

    def n_symbols(self, rows: np.ndarray) -> np.ndarray:
        def compute(new: np.ndarray) -> np.ndarray:
            data, edges = self._bytes(new)
            return totals(_SYMBOL[data], edges)

        return self._count("n_symbols", rows, compute)

    def _lines(self, row: int) -> list[bytes]:
        p = self.piece
        text = p.data[p.offsets[row] : p.offsets[row + 1]].tobytes()
        return [x for x in text.split(b"\n") if x.strip(b" \t\n\v\f\r")]

    def n_lines(self, rows: np.ndarray) -> np.ndarray:
        """Lines that hold a word."""
        return self._count("n_lines", rows, lambda new: np.array([len(self._lines(i)) for i in new]))

    def n_dup_lines(self, rows: np.ndarray) -> np.ndarray:
        def compute(new: np.ndarray) -> np.ndarray:
            out = np.zeros(len(new), dtype=np.int64)
            for at, i in enumerate(new):
                lines = self._lines(i)
                out[at] = len(lines) - len(set(lines))
            return out

        return self._count("n_dup_lines", rows, compute)

    def n_repeat_words(self, rows: np.ndarray) -> np.ndarray:
        def compute(new: np.ndarray) -> np.ndarray:
            p, out = self.piece, np.zeros(len(new), dtype=np.int64)
            words, edges = self._words(new)
            every = grams(word_hashes(p.data, p.starts[words], p.ends[words], False), 3)
            for at, (a, b) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)):
                if b - a < 4:
                    continue
                windows = every[a : b - 2]
                order = np.argsort(windows, kind="stable")
                ranked = windows[order]
                same = ranked[1:] == ranked[:-1]
                if not same.any():
                    continue
                often = np.zeros(len(windows), dtype=bool)
                often[order[1:][same]] = True
                often[order[:-1][same]] = True
                covered = np.zeros(b - a, dtype=bool)
                for j in range(3):
                    covered[j : j + len(often)] |= often
                out[at] = covered.sum()
            return out

        return self._count("n_repeat_words", rows, compute)


@dataclass(frozen=True)
class Rule:
    """``reject(counts, rows)`` marks those of the rows of a piece that the rule rejects."""

    name: str
    reject: Callable[[Counts, np.ndarray], np.ndarray]


def too_short(c: Counts, rows: np.ndarray) -> np.ndarray:
    return c.n_words(rows) < 50


def repetitive(c: Counts, rows: np.ndarray) -> np.ndarray:
    return 100 * c.n_repeat_words(rows) > 50 * c.n_words(rows)


def odd_word_length(c: Counts, rows: np.ndarray) -> np.ndarray:
    """Mean length of a word below 2 or above 20 characters."""
    chars, n = c.word_chars(rows), c.n_words(rows)
    return (chars < 2 * n) | (chars > 20 * n)


def many_symbols(c: Counts, rows: np.ndarray) -> np.ndarray:
    """More symbols than 30 to 100 words."""
    return 100 * c.n_symbols(rows) > 30 * c.n_words(rows)


def repeated_lines(c: Counts, rows: np.ndarray) -> np.ndarray:
    """More than half of the lines that hold a word were there before in the text."""
    repeats = c.n_dup_lines(rows)
    some = np.flatnonzero(repeats)
    out = np.zeros(len(rows), dtype=bool)
    out[some] = 100 * repeats[some] > 50 * c.n_lines(rows[some])
    return out


BASE = [Rule("too_short", too_short), Rule("repetitive", repetitive)]
RULES = [*BASE, Rule("odd_word_length", odd_word_length), Rule("many_symbols", many_symbols), Rule("repeated_lines", repeated_lines)]


def cascade(docs: DataFrame, rules: list[Rule] = RULES, sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """The rules, those that reject most per second of work first, by a bounded sample.

    The sample is spread over all rows by a hash of the text. Each rule is timed with counts of its
    own. Ties, and all rules when the sample is empty, keep the order given.
    """
    texts = docs.select(F.col("text").cast("string").alias("text"))
    step = max(1, docs.count() // sample_rows)
    sample = texts.filter(F.pmod(F.xxhash64("text"), F.lit(step)) == 0).limit(sample_rows).toArrow()
    score = {r.name: [0, 0.0] for r in rules}
    for chunk in sample.column(0).chunks:
        for piece in pieces(chunk):
            rows = np.arange(len(piece))
            for r in rules:
                began = time.perf_counter()
                score[r.name][0] += int(r.reject(Counts(piece), rows).sum())
                score[r.name][1] += time.perf_counter() - began
    return sorted(rules, key=lambda r: -score[r.name][0] / max(score[r.name][1], 1e-9))


def run_cascade(c: Counts, rules: list[Rule], left: np.ndarray | None = None, looked: dict[str, list[int]] | None = None) -> np.ndarray:
    """Which texts of a piece pass all rules; a rejected text is not looked at again.

    ``left`` are the rows to begin with, by default all. ``looked`` is given the rows each rule looked at
    and how many it rejected.
    """
    left = np.arange(len(c.piece)) if left is None else left
    for r in rules:
        if not len(left):
            break
        bad = r.reject(c, left)
        if looked is not None:
            counts = looked.setdefault(r.name, [0, 0])
            counts[0] += len(left)
            counts[1] += int(bad.sum())
        left = left[~bad]
    kept = np.zeros(len(c.piece), dtype=bool)
    kept[left] = True
    return kept


def work(docs: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """``rule, looked_at, rejected``: the texts each rule of the cascade looks at, in all rows.

    Without the cascade every rule would look at every text.
    """
    rules = cascade(docs) if rules is None else rules

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        looked: dict[str, list[int]] = {}
        for batch in batches:
            for piece in pieces(batch.column(0)):
                run_cascade(Counts(piece), rules, looked=looked)
        yield pa.RecordBatch.from_arrays([pa.array(list(looked), pa.string()), *(pa.array([v[i] for v in looked.values()], pa.int64()) for i in (0, 1))], ["rule", "looked_at", "rejected"])

    each = bound_batches(docs).select(F.col("text").cast("string")).mapInArrow(run, "rule string, looked_at long, rejected long")
    return each.groupBy("rule").agg(F.sum("looked_at").alias("looked_at"), F.sum("rejected").alias("rejected"))


def passing(docs: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """The rows of ``docs`` that pass all rules, with their columns as they are."""
    rules = cascade(docs) if rules is None else rules
    at = docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [run_cascade(Counts(p), rules) for p in pieces(batch.column(at))]
            yield batch.filter(pa.array(np.concatenate(kept))) if kept else batch

    return bound_batches(docs).mapInArrow(keep, docs.schema)


def measure(docs: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """doc_id, the counts, ``base_failed`` and ``kept`` of every row of ``docs``."""
    rules = cascade(docs) if rules is None else rules
    extra = [r for r in rules if r not in BASE]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: dict[str, list] = {name: [] for name in (*COUNTS, "base_failed", "kept")}
            for piece in pieces(batch.column(1)):
                c, rows = Counts(piece), np.arange(len(piece))
                base = run_cascade(c, BASE)
                kept = run_cascade(c, extra, rows[base])
                # What the rules didn't ask for is counted last; the rest is there already.
                for name in COUNTS:
                    columns[name].append(getattr(c, name)(rows))
                columns["base_failed"].append(~base)
                columns["kept"].append(kept)
            arrays = [pa.array(np.concatenate(v) if v else np.empty(0, bool if n in ("base_failed", "kept") else np.int64)) for n, v in columns.items()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], ["doc_id", *columns])

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, " + ", ".join(f"{n} long" for n in COUNTS) + ", base_failed boolean, kept boolean"
    return bound_batches(docs).select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(count, schema)


#: What ``measure`` gives with ``RULES``, as SQL over the table ``documents`` with distinct ids.
SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 2], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
often AS (SELECT doc_id, g FROM g GROUP BY doc_id, g HAVING count(*) > 1),
marks AS (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM g JOIN often USING (doc_id, g)),
again AS (SELECT doc_id, count(DISTINCT j) AS n FROM marks GROUP BY doc_id),
cut AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d),
dup AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n FROM cut WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
m AS (SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
        length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(again.n, 0)::BIGINT AS n_repeat_words, coalesce(n_lines, 0) AS n_lines
      FROM d LEFT JOIN dup ON dup.doc_id = d.doc_id LEFT JOIN again ON again.doc_id = d.doc_id),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND word_chars BETWEEN 2 * n_words AND 20 * n_words AND 100 * n_symbols <= 30 * n_words AND 100 * n_dup_lines <= 50 * n_lines AS kept FROM b"""
