import math
import random

import duckdb
import numpy as np

from archivist.llm import hard_negatives as h
from pyspark.sql import functions as F


def brute(rows, anchor=lambda i: i % 100 == 0):
    """Sorted result rows of (id, label, vector) rows, by plain integers."""
    ok = [(i, label, [math.floor(256 * x) for x in v]) for i, label, v in rows if i is not None and label is not None and v and all(x is not None and math.isfinite(x) and abs(x) < h.LARGEST for x in v)]
    out, seen = [], []
    for a in ok:
        if not anchor(a[0]) or a in seen:
            continue
        seen.append(a)
        all_ = sorted((-sum(x * y for x, y in zip(a[2], b[2], strict=True)), b[0], b[1]) for b in ok if b[0] != a[0] and len(b[2]) == len(a[2]))
        for s, p, _ in [x for x in all_ if x[2] == a[1]][:5]:
            fit = [x for x in all_ if x[2] != a[1] and 80 * -s <= 100 * -x[0] <= 100 * -s][:5]
            out += [(a[0], p, k, n, -s, -t) for k, (t, n, _) in enumerate(fit, 1)]
    return sorted(out)


def got(df):
    return sorted(tuple(r) for r in df.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


def test_bounds_hold():
    rnd = np.random.default_rng(3)
    for dim in (1, 3, 4, 16, 17, 64, 100):
        q = np.floor(256 * rnd.normal(rnd.normal(0, 1), 0.3, (60, dim)))
        q[0], q[1] = 0, 5
        v = h.Vectors(np.arange(60), np.zeros(60), [x.astype(np.int32).tobytes() for x in q], [x.tobytes() for x in h.summaries(q)])
        exact, before = q @ q.T, None
        for k in range(len(h.levels(dim))):
            low, high = h.bounds(v, v, k)
            assert (low <= exact).all() and (exact <= high).all()
            assert before is None or (high <= before + 1e-3).all()  # finer segments never loosen a bound by more than rounding
            before = high


def test_query_against_brute_force_and_sql(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.vec_id, None if r.label is None else (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    mine = got(h.op13_hard_negatives(spark, sf))
    assert mine == brute(rows) and mine
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    assert mine == sorted(con.execute(h.SQL["op13_hard_negatives"]).fetchall())


def test_blocks_ties_and_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(h, "BLOCK", 40)
    rnd = random.Random(8)
    base = [[rnd.gauss(0.1, 1) for _ in range(20)] for _ in range(6)]
    rows = []
    for i in range(260):
        v = [x + rnd.gauss(0, 0.15) for x in rnd.choice(base)]
        rows.append((i, rnd.choice([1, 1, 1, 2, 3, None]), v))
    rows += [(300 + k, 1, rows[5][2]) for k in range(8)] + [(310 + k, 2, rows[5][2]) for k in range(8)]  # ties
    rows += [(400, 1, None), (401, 1, []), (402, 1, [1.0, None]), (403, 1, [float("nan")] * 20), (404, 2, [float("inf")] * 20), (None, 1, base[0]), (405, 1, [3e38] * 20), (406, 2, [9e4] * 20), (410, 1, [0.0] * 20), (420, 1, [0.5, 0.25]), (421, 2, [0.5, 0.25]), (422, 1, [0.5, 0.25])]
    rows += [rows[0], rows[10], (20, 2, base[1])]  # repeats, and one id with two vectors
    df = spark.createDataFrame([(*r, 7) for r in rows], "vec_id long, label int, embedding array<double>, anchor int")
    mine = got(h.hard_negatives(df.repartition(3), is_anchor=F.col("id") % 10 == 0))
    assert mine == brute(rows, lambda i: i % 10 == 0) and len(mine) > 100
    assert got(h.hard_negatives(df.filter("false"))) == []
    assert got(h.hard_negatives(df.filter("label = 1"), is_anchor=F.col("id") % 10 == 0)) == []
