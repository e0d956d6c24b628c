"""Side-by-side comparison of a registered query with its SQL on the same parquet files."""

from __future__ import annotations

import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, float):
        return round(v, 9) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v


KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


def compare(name: str, df, con, sql: str) -> list[str]:
    """Human-readable differences; empty when both sides agree."""
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    types = {d[0]: str(d[1]) for d in cur.description}
    rows = cur.fetchall()
    problems = []
    if sorted(names) != sorted(df.columns):
        return [f"{name}: columns {sorted(df.columns)} vs {sorted(names)}"]
    for f in df.schema.fields:
        want = KINDS.get(f.dataType.simpleString())
        if want and types[f.name] != want:
            problems.append(f"{name}.{f.name}: type {f.dataType.simpleString()} vs {types[f.name]}")
    order = sorted(names)
    at = [names.index(c) for c in order]
    key = lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r)
    ours = sorted((tuple(norm(r[c]) for c in order) for r in df.collect()), key=key)
    theirs = sorted((tuple(norm(r[i]) for i in at) for r in rows), key=key)
    if len(ours) != len(theirs):
        problems.append(f"{name}: {len(ours)} rows vs {len(theirs)}")
    for a, b in zip(ours, theirs):
        if a != b:
            problems.append(f"{name}: {order}\n  spark {a}\n  sql   {b}")
            break
    if not ours:
        problems.append(f"{name}: no rows")
    return problems
