"""Compare a query with its SQL on DuckDB.

Run as a script: ``python tests/oracle.py FOLDER [name ...]``.
"""

from __future__ import annotations

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb  # noqa: E402

from taxatally.plans.registry import TABLES  # noqa: E402


def database(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(r[i] for i in order) for r in rows), key=repr), [columns[i] for i in order]


def difference(df, con, sql: str) -> str | None:
    """None when both give the same names and rows, otherwise what differs."""
    got, names = _rows(df.columns, [tuple(r) for r in df.collect()])
    cursor = con.execute(sql)
    want, expected = _rows([d[0] for d in cursor.description], cursor.fetchall())
    if names != expected:
        return f"columns {names} != {expected}"
    if len(got) != len(want):
        extra = [r for r in got if r not in set(want)][:3] if len(got) < 200_000 else []
        return f"{len(got)} rows != {len(want)}; extra {extra}; e.g. {got[:2]} / {want[:2]}"
    for a, b in zip(got, want, strict=True):
        if a != b or [type(x) for x in a] != [type(x) for x in b]:
            return f"{a} != {b}"
    return None


if __name__ == "__main__":
    from __spark_entry__ import oracle_sql, queries
    from taxatally.session import local_session

    folder, *names = sys.argv[1:]
    spark, con, sqls, bad = local_session(), database(folder), oracle_sql(), []
    for name, build in queries().items():
        if names and not any(name.startswith(n) for n in names):
            continue
        start = time.time()
        try:
            df = build(spark, folder)
            note = difference(df, con, sqls[name]) if name in sqls else f"no SQL, {df.count()} rows"
        except Exception as error:  # noqa: BLE001
            note = "ERROR " + str(error)[:1500]
        if note and not note.startswith("no SQL"):
            bad.append(name)
        print(f"{time.time() - start:6.2f}s {name}: {note or 'ok'}", flush=True)
    print(f"{len(bad)} differ: {bad}")
