import random

import numpy as np

from archivist.llm.components import components
from archivist.llm.vector_dedup import near_vectors, op6_vector_dedup


def roots(n, pairs):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return [find(i) for i in range(n)]


def test_components(spark):
    rnd = random.Random(1)
    pairs = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(140)] + [(i, i + 1) for i in range(300, 360)] + [(5, 5), (1, 2), (2, 1)]
    got = {r.id: r.component for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    want = roots(400, pairs)
    assert all(got.get(i, i) == want[i] for i in range(400))
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute(m, threshold=0.95):
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    i, j = np.nonzero(np.triu(u @ u.T >= threshold, 1))
    return set(zip(i.tolist(), j.tolist(), strict=True))


def check(got, m, least=0.9):
    want = brute(m)
    links = np.bincount([x for p in want for x in p], minlength=len(m))
    assert len(got) == len(m)
    assert all(r.n_links <= links[r.vec_id] for r in got)
    assert sum(r.n_links for r in got) >= least * 2 * len(want)
    comp = roots(len(m), want)
    assert np.mean([r.component_id == comp[r.vec_id] for r in got]) >= 0.98
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_against_brute_force(spark):
    sf = "/root/testdata/sf0.1"
    rows = sorted(spark.read.parquet(f"{sf}/embeddings.parquet").collect(), key=lambda r: r.vec_id)
    check(op6_vector_dedup(spark, sf).collect(), np.array([r.embedding for r in rows], float))


def test_large_groups(spark):
    rnd = np.random.default_rng(1)
    base = rnd.standard_normal((900, 16))
    near = base[:1] + 0.12 * rnd.standard_normal((1500, 16))  # one dense group over several blocks
    m = np.concatenate([base, near, np.repeat(base[1:2], 700, 0), 3 * base[2:3]])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "vec_id long, embedding array<double>")
    check(near_vectors(df).collect(), m, 0.97)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [1.0, None]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, []), (9, [1.0]), (None, [1.0, 0.0]), (1, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 AS size", "'x' AS key")
    got = sorted((r.vec_id or 0, r.n_links, r.component_id, r.kept) for r in near_vectors(df).collect())
    assert got == [(0, 0, None, True), (1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False)] + [(i, 0, i, True) for i in range(3, 10)]
    assert near_vectors(df.limit(0)).count() == 0


def test_very_small_and_large_components(spark):
    rows = [(1, [1e-170, 0.0]), (2, [1e-170, 0.0]), (3, [1e160, 0.0]), (4, [1.0, 0.0]), (5, [0.0, 1e-300]), (6, [0.0, 0.0]), (7, [float("nan"), 1.0]), (8, [None, 1.0]), (9, [1.0, None]), (10, [float("inf"), 1.0]), (11, [])]
    got = {r.vec_id: (r.n_links, r.component_id) for r in near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert {i: got[i] for i in (1, 2, 3, 4)} == {i: (3, 1) for i in (1, 2, 3, 4)} and all(got[i] == (0, i) for i in range(5, 12))
