"""Run a registered query and its SQL over the same tables."""

import os

import duckdb

import __spark_entry__

SF = "/root/testdata/sf0.001"


def value(x):
    if isinstance(x, (list, tuple)):
        return tuple(map(value, x))
    return round(float(x), 9) if isinstance(x, float) else str(x)


def rows(names, found):
    at = sorted(range(len(names)), key=lambda k: names[k])
    return sorted([names[k] for k in at]), sorted(tuple(value(r[k]) for k in at) for r in found)


def agree(spark, name, sf=SF):
    df = __spark_entry__.queries()[name](spark, sf)
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for f in os.listdir(sf):
        path = f"{sf}/{f}" + ("/*.parquet" if os.path.isdir(f"{sf}/{f}") else "")
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{path}'")
    got = con.execute(__spark_entry__.oracle_sql()[name])
    want = rows([c[0] for c in got.description], got.fetchall())
    mine = rows(df.columns, df.collect())
    assert mine[0] == want[0], (mine[0], want[0])
    assert len(mine[1]) == len(want[1]), (name, len(mine[1]), len(want[1]), mine[1][:3], want[1][:3])
    assert mine[1] == want[1], (name, [(a, b) for a, b in zip(mine[1], want[1]) if a != b][:3])
    return len(mine[1])
