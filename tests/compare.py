"""Run a query and its DuckDB oracle side by side and compare as sorted rows."""

import math
import os

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def oracle_rows(sql: str, sf_dir: str):
    con = duckdb.connect()
    for table in TABLES:
        path = os.path.join(sf_dir, f"{table}.parquet")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{path}')")
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    return names, result.fetchall()


def canonical(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    key = lambda row: tuple((v is None, str(type(v)), v) for v in row)
    return sorted(([tuple(r[i] for i in order) for r in rows]), key=key)


def same(left, right) -> bool:
    if isinstance(left, float) and isinstance(right, float):
        return left == right or math.isclose(left, right, rel_tol=1e-12, abs_tol=1e-12)
    return left == right and type(left) is type(right)


def differences(df, sql: str, sf_dir: str, limit: int = 3):
    names, expected = oracle_rows(sql, sf_dir)
    got = [tuple(r) for r in df.collect()]
    if sorted(df.columns) != sorted(names):
        return [("columns", sorted(df.columns), sorted(names))]
    left, right = canonical(df.columns, got), canonical(names, expected)
    if len(left) != len(right):
        return [("rows", len(left), len(right), left[:2], right[:2])]
    bad = [(a, b) for a, b in zip(left, right) if not all(map(same, a, b))]
    return bad[:limit]
