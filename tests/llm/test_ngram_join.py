import random
import re

import numpy as np

from archivist.llm import ngram_join as ng
from archivist.llm.ngram_join import op10_ngram_join, similar_documents
from archivist.llm.shingles import shingle_sets


def words(t):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    return re.findall("[^\x20\x09-\x0d]+", low)


def shingle_set(t, k=5):
    w = words(t)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def brute(docs):
    sets = {i: shingle_set(t) for i, t in docs.items()}
    root = {i: i for i in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(docs)
    inverted = {}
    for i in ids:
        shared = {}
        for s in sets[i]:
            for j in inverted.get(s, ()):
                shared[j] = shared.get(j, 0) + 1
            inverted.setdefault(s, []).append(i)
        for j, n in shared.items():
            if 100 * n >= 75 * (len(sets[i]) + len(sets[j]) - n):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_sets():
    texts = ["", "a", "A b c d", "a B c d e", "a b c d e f", " a\tb\nc\x0bd\x0ce\rf ", "é É a b c d", "x" * 5000, "a b c d e " * 50]
    for t, s in zip(texts, shingle_sets([t.encode() for t in texts]), strict=True):
        assert len(s) == len(shingle_set(t))
    s = shingle_sets([t.encode() for t in texts])
    assert s[4].tolist() == s[5].tolist()


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in op10_ngram_join(spark, sf).collect()} == brute(docs)


def test_random_edits(spark):
    rnd = random.Random(5)
    docs = {}
    for g in range(25):
        base = [f"w{rnd.randrange(400)}" for _ in range(rnd.choice([6, 20, 60, 200]))]
        for _ in range(rnd.choice([1, 2, 8, 30])):
            t = list(base)
            for _ in range(rnd.randrange(0, max(2, len(t) // 12))):
                t[rnd.randrange(len(t))] = f"w{rnd.randrange(400)}"
            docs[len(docs)] = " ".join(t[rnd.randrange(3) :]) + " shared passage of words that ends each one" * (g % 3 == 0)
    got = similar_documents(spark.createDataFrame([*docs.items()], "doc_id long, text string"))
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.collect()} == brute(docs)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "a b"), (5, "A  B"), (6, "a"), (None, "a b"), (7, "long " * 20000), (7, "long " * 20000), (4, "a b")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS cls", "1 AS n", "2 AS id")
    got = sorted(((r.doc_id or 0), r.n_shingles, r.component_id) for r in similar_documents(df).collect())
    assert got == [(0, 1, None), (1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (4, 1, 4), (5, 1, 4), (6, 1, 6), (7, 1, 7), (7, 1, 7)]
    assert similar_documents(df.limit(0)).count() == 0


def test_pairs_whose_rare_shingles_lie_in_small_lists(spark):
    """Two texts with 86 of 113 shingles in common: the first of their run lies in a long list, that of all others is short,
    as the texts that make them frequent hold enough rarer ones."""
    rnd = random.Random(12)
    other = lambda k: [f"x{rnd.randrange(10**9)}" for _ in range(k)]
    for seed in range(2):
        run = [f"r{seed}_{k}" for k in range(90)]
        docs = {1: [*run, *other(12)], 2: [*run, *other(15)]}
        fill = [other(99) for _ in range(12)]  # 100 shingles: in between, by size
        for k, f in enumerate(fill):
            docs[10 + k] = [*f, *run[:5]]
        for k in range(30):
            docs[100 + k] = [*other(400), *run[1:], *(x for f in fill for x in f), *other(400)]
        docs = {i: " ".join(w) for i, w in docs.items()}
        df = spark.createDataFrame([*docs.items()], "doc_id long, text string")
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in similar_documents(df).collect()} == brute(docs)


def test_adversarial_lists(spark):
    """Sets of single words, drawn so that pairs at the threshold share frequent words, rare words or both."""
    rnd = random.Random(21)
    docs, i = {}, 0
    for g in range(40):
        n = rnd.choice([20, 40, 100])
        mine = [f"g{g}_{k}" for k in range(n)]
        for _ in range(rnd.choice([2, 2, 3])):
            drop = rnd.randrange(n // 8, n // 5)
            cut = mine[drop:] if rnd.random() < 0.5 else rnd.sample(mine, n - drop)
            docs[i := i + 1] = [*cut, *(f"u{i}_{k}" for k in range(rnd.randrange(n // 8)))]
        for _ in range(rnd.choice([0, 9, 12])):  # make some words of the group frequent
            docs[i := i + 1] = [*rnd.sample(mine, rnd.choice([1, 3, n // 2])), *(f"v{i}_{k}" for k in range(60))]
    docs = {k: " ".join(rnd.sample(w, len(w))) for k, w in docs.items()}
    sets = {k: set(t.split()) for k, t in docs.items()}
    root = {k: k for k in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in docs:
        for b in docs:
            if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    df = spark.createDataFrame([*docs.items()], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in similar_documents(df, words=1).collect()} == {k: find(k) for k in docs}


def test_pairs_of_many_lists_are_counted_in_one_task(spark, monkeypatch):
    """The last step makes a row for a pair, not for each list that both are in, and the same pairs as loops over lists do."""
    rnd = np.random.default_rng(8)
    cls = [int(x) for x in rnd.integers(-(2**62), 2**62, 40)]
    n = {c: int(rnd.integers(90, 130)) for c in cls}
    bits = {c: rnd.integers(-(2**63), 2**63 - 1, 8) for c in cls}
    for c in cls[1::2]:
        bits[c] = bits[cls[0]] ^ np.int64(rnd.integers(0, 2))
    bits[cls[0]][0] = -1
    component, missing = {c: int(c % 9) for c in cls}, {c: int(rnd.integers(0, 3)) for c in cls}
    lists = {h: [c for c in cls if rnd.random() < (0.9 if cls.index(c) % 4 else 0.2)] for h in range(30)}
    times = {}
    for members in lists.values():
        for a in members:
            for b in members:
                differ = sum(int(np.bitwise_count(np.uint64(int(x) % 2**64) ^ np.uint64(int(y) % 2**64))) for x, y in zip(bits[a], bits[b]))
                if a > b and component[a] != component[b] and 100 * min(n[a], n[b]) >= 75 * max(n[a], n[b]) and 175 * differ <= 25 * (n[a] + n[b]):
                    times[a, b] = times.get((a, b), 0) + 1
    want = {(a, b, n[a], n[b]) for (a, b), k in times.items() if k >= ng._needed(n[a], n[b], 75) - max(ng._long(n[a], 75), ng._long(n[b], 75)) - min(missing[a], missing[b])}
    rows = [(h, c, n[c], component[c], missing[c], *map(int, bits[c])) for h, members in lists.items() for c in members]
    df = spark.createDataFrame(rows, "h long, cls long, n int, component long, missing long, " + ", ".join(f"{b} long" for b in ng.BITS))
    assert 0 < len(want) < len(times)
    for part, counted in ((2048, 1 << 20), (7, 1 << 20), (7, 50)):  # whole lists, lists dealt to several tasks, counts passed on early
        monkeypatch.setattr(ng, "PART", part)
        monkeypatch.setattr(ng, "COUNTED", counted)
        out = ng._counted(df, 75)
        assert {tuple(r) for r in out.collect()} == want and out.count() == len(want)
    assert "Join" not in out._jdf.queryExecution().toString()
