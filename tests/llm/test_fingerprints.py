import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from archivist.llm.fingerprints import compare_versions, differences, digests, likeness, op4_fingerprints

SF = "/root/testdata/sf0.001"


def pieces(t):
    """Digests of one text alone."""
    return Counter(digests([t.encode()])[1].tolist())


def near(a, b):
    a, b = pieces(a), pieces(b)
    both, every = sum((a & b).values()), sum((a | b).values())
    return both / every if every else 1.0


def test_peeling_recovers_what_differs():
    rnd = random.Random(1)
    for _ in range(30):
        n = rnd.randint(1, 6)
        sets = [[{rnd.getrandbits(64) for _ in range(rnd.choice([0, 1, 5, 200]))} for _ in range(n)] for _ in range(2)]
        shared = [{rnd.getrandbits(64) for _ in range(rnd.choice([0, 3, 400]))} for _ in range(n)]
        a, b = ([x | s for x, s in zip(v, shared, strict=True)] for v in sets)
        flat = [(np.repeat(np.arange(n), [len(x) for x in v]), np.array([k for x in v for k in x], np.uint64)) for v in (a, b)]
        doc, key, sign = differences(*flat, n)
        got = [({*key[(doc == i) & (sign == 1)].tolist()}, {*key[(doc == i) & (sign == -1)].tolist()}) for i in range(n)]
        assert got == [(x - y, y - x) for x, y in zip(a, b, strict=True)]


def test_paragraphs_stay_where_an_edit_is_far():
    words = [f"w{i % 37}x{i}" for i in range(400)]
    a, b = " ".join(words), " ".join([*words[:200], "new", *words[200:]])
    assert near(a, b) > 0.9 and near(a, a) == 1 and near("", "") == 1 and near("a b", "") == 0
    d = digests([b"x\nx\nx\n", b"x\n", b""])
    assert np.bincount(d[0], minlength=3).tolist() == [3, 1, 0] and len(set(d[1].tolist())) == 3
    assert likeness(d, d, 3).tolist() == [1, 1, 1]


def check(got, rows):
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    want = Counter()
    for k, (i, t) in enumerate(order):
        t, nxt = t or "", order[(k + 1) % len(order)][1] or ""
        e = t[: len(t) - len(t) // 4] + nxt[: len(t) // 4]
        want[i, len(t), hashlib.sha256(e.encode()).hexdigest(), round(near(t, e), 9), round(near(t, nxt), 9)] += 1
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9)) for r in got) == want


def test_query_against_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = op4_fingerprints(spark, SF).collect()
    check(got, docs)
    texts = dict(docs)
    for key in ({}, {}):
        for r in got:
            assert key.setdefault(texts[r.doc_id], r.fingerprint) == r.fingerprint
    assert len({r.fingerprint for r in got}) >= 0.95 * len(set(texts.values()))


def test_odd_rows(spark):
    rows = [(5, None), (1, ""), (3, "a"), (3, "a"), (9, "é🙂 x\n\n\ny " * 3000), (None, "null id"), (-4, "short")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS key", "1 AS id", "2 AS next")
    check(compare_versions(df).collect(), rows)
    assert compare_versions(df.limit(0)).count() == 0
    check(compare_versions(df.filter("doc_id = 9")).collect(), [rows[4]])


def test_a_digest_that_a_text_has_twice_is_an_error():
    twice = np.zeros(2, np.int64), np.full(2, 77, np.uint64)
    with pytest.raises(ValueError, match="twice"):
        differences(twice, (np.empty(0, np.int64), np.empty(0, np.uint64)), 1)
