"""Compare a query with its SQL twin, ignoring row and column order."""

from __future__ import annotations

import datetime
import math
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else (0.0 if value == 0 else value)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None)
    return value


def bag(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(plain(r[i]) for i in order) for r in rows)


def differences(df, con, sql) -> list[str]:
    cur = con.execute(sql)
    columns = [d[0] for d in cur.description]
    expected = cur.fetchall()
    problems = []
    if sorted(columns) != sorted(df.columns):
        return [f"columns {sorted(df.columns)} != {sorted(columns)}"]
    got = df.collect()
    if len(got) != len(expected):
        problems.append(f"rows {len(got)} != {len(expected)}")
    a, b = bag(df.columns, got), bag(columns, expected)
    if a != b:
        extra, missing = list((a - b).items())[:3], list((b - a).items())[:3]
        problems.append(f"{sum((a - b).values())} rows differ, got {extra} want {missing}")
    kinds = {f[0]: f[1] for f in df.dtypes}
    sql_kinds = {d[0]: str(d[1]).lower() for d in cur.description}
    names = {"bigint": "bigint", "int": "integer", "double": "double", "string": "varchar",
             "date": "date", "boolean": "boolean"}
    off = {c: (k, sql_kinds[c]) for c, k in kinds.items()
           if names.get(k) != sql_kinds[c] and sql_kinds[c] not in ("number", "string", "bool")}
    if off:
        problems.append(f"types {off}")
    return problems
