"""Compare a query with its SQL twin: columns, types and rows."""

from __future__ import annotations

import math
from collections import Counter

import duckdb

from closebook.sources.fixtures import BASE_TABLES

_TYPES = {
    "bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE",
    "boolean": "BOOLEAN",
}


def connect(folder):
    con = duckdb.connect()
    for t in BASE_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v + 0.0
    return v


def compare(df, con, sql) -> tuple[int, list[str]]:
    """Number of rows and a list of what differs."""
    names = sorted(df.columns)
    rel = con.execute(sql)
    found = [d[0] for d in rel.description]
    if sorted(found) != names:
        return -1, [f"columns {names} and {sorted(found)}"]
    problems = []
    duck_types = {d[0]: str(d[1]) for d in rel.description}
    for name, dtype in df.dtypes:
        if _TYPES.get(dtype) != duck_types[name]:
            problems.append(f"type of {name}: {dtype} and {duck_types[name]}")
    at = [found.index(n) for n in names]
    want = Counter(tuple(_norm(r[i]) for i in at) for r in rel.fetchall())
    got = Counter(tuple(_norm(v) for v in r) for r in df.select(*[f"`{n}`" for n in names]).collect())
    if want != got:
        only_spark, only_sql = list((got - want).items())[:3], list((want - got).items())[:3]
        problems.append(f"rows {sum(got.values())} and {sum(want.values())}: spark {only_spark} sql {only_sql}")
    return sum(got.values()), problems
