"""Compare a query with its SQL on the same files."""

from __future__ import annotations

import datetime as dt
import math
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()
# Spark type -> DuckDB types that hold the same values
SAME_TYPES = {
    "tinyint": {"TINYINT"}, "smallint": {"SMALLINT"}, "int": {"INTEGER"}, "bigint": {"BIGINT"},
    "float": {"FLOAT"}, "double": {"DOUBLE"}, "string": {"VARCHAR"}, "boolean": {"BOOLEAN"},
    "date": {"DATE"}, "timestamp_ntz": {"TIMESTAMP"}, "array<string>": {"VARCHAR[]"}, "array<int>": {"INTEGER[]"},
    "array<double>": {"DOUBLE[]"},
}


def connect(sf: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def canonical(v):
    if v is None:
        return "∅"
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return repr(v + 0.0) if v != 0 else "0.0"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(canonical(x) for x in v) + "]"
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    return repr(v)


def rows_of(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(canonical(r[i]) for i in order) for r in rows)


def compare(spark, con, sf, name, query, sql):
    """None when equal, else a description of the difference."""
    df = query(spark, sf)
    theirs = con.execute(sql)
    names = [d[0] for d in theirs.description]
    types = {d[0]: str(d[1]) for d in theirs.description}
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    bad = [
        f"{f.name}: {f.dataType.simpleString()} != {types[f.name]}"
        for f in df.schema
        if types[f.name] not in SAME_TYPES.get(f.dataType.simpleString(), {"?"})
    ]
    if bad:
        return "types " + "; ".join(bad)
    a, b = rows_of(df.collect(), df.columns), rows_of(theirs.fetchall(), names)
    if not a:
        return "no rows"
    if a != b:
        only_a, only_b = a - b, b - a
        return (
            f"rows {sum(a.values())} vs {sum(b.values())}; columns {sorted(names)}\n  only spark {list(only_a.items())[:2]}\n  only sql   {list(only_b.items())[:2]}"
            f"\n  differing {sum(only_a.values())} / {sum(only_b.values())}"
        )
    return None
