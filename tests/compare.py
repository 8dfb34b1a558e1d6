"""Compare a Spark result with DuckDB's answer, ignoring row order."""

from __future__ import annotations

import glob
import os

import duckdb


def connect(folder: str):
    db = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.splitext(os.path.basename(path))[0]
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return db


def _key(value):
    return (value is None, str(type(value).__name__), str(value))


def normal(rows):
    return sorted(rows, key=lambda row: [_key(v) for v in row])


def differences(frame, db, sql: str) -> str | None:
    """None if equal, else a short description."""
    names = sorted(frame.columns)
    got = normal([tuple(row[n] for n in names) for row in frame.select(*names).collect()])
    answer = db.execute(sql)
    have = [c[0] for c in answer.description]
    if sorted(have) != names:
        return f"columns {names} vs {sorted(have)}"
    at = [have.index(n) for n in names]
    want = normal([tuple(row[i] for i in at) for row in answer.fetchall()])
    if len(got) != len(want):
        return f"{len(got)} rows vs {len(want)}"
    for mine, theirs in zip(got, want):
        if mine != theirs or [type(v) for v in mine] != [type(v) for v in theirs]:
            return f"{mine!r} vs {theirs!r}"[:600]
    return None
