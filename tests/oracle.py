"""Holds a Spark result against the oracle's SQL, as the driver does: columns by name, rows in any order."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def _cell(v):
    if v is None:
        return "\0"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)):
        return "nan" if math.isnan(v) else repr(float(v))
    return str(v)


def rows(names: list[str], data) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted(tuple(_cell(r[k]) for k in order) for r in data)


def difference(df, con, sql: str) -> str | None:
    """What differs, or None."""
    found = con.execute(sql)
    want_names, want = [d[0] for d in found.description], found.fetchall()
    got = [tuple(r) for r in df.collect()]
    if sorted(df.columns) != sorted(want_names):
        return f"columns {sorted(df.columns)} and {sorted(want_names)}"
    a, b = rows(df.columns, got), rows(want_names, want)
    if a != b:
        extra = [x for x in a if x not in set(b)][:3], [x for x in b if x not in set(a)][:3]
        return f"{len(a)} and {len(b)} rows; {sorted(df.columns)}; only ours {extra[0]}; only theirs {extra[1]}"
    return None
