"""Compares a query with its SQL in DuckDB, rows as a multiset, columns by name."""

import math
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        path = Path(sf_dir) / f"{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if path.is_dir() else ''}')")
    return con


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else float(f"{x:.9g}") + 0.0
    if hasattr(x, "as_integer_ratio") and not isinstance(x, (int, bool)):
        return float(x)
    return x


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted((tuple(plain(r[k]) for k in order) for r in rows), key=repr), [names[k] for k in order]


def differences(spark, query, sql, sf_dir):
    """An empty string if they agree."""
    got = query(spark, str(sf_dir))
    mine, names = rows_of(got.columns, [tuple(r) for r in got.collect()])
    result = connection(sf_dir).execute(sql)
    theirs, other = rows_of([c[0] for c in result.description], result.fetchall())
    if names != other:
        return f"columns {names} and {other}"
    if len(mine) != len(theirs):
        return f"{len(mine)} and {len(theirs)} rows"
    bad = [(a, b) for a, b in zip(mine, theirs, strict=True) if a != b]
    return f"{len(bad)} of {len(mine)} rows differ, {bad[:3]}" if bad else ""
