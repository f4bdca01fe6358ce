from collections import Counter
from math import log
from zlib import crc32

import numpy as np

from archivist.llm import pseudo_likelihood as pl

SF = "/root/testdata/sf0.01"


def test_rare_words_share_their_entry(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").selectExpr("doc_id AS id", "text")
    texts = {r.id: r.text.lower().split() for r in docs.collect()}
    n = Counter(w for t in texts.values() for w in t)
    top = set(sorted(n, key=lambda w: (-n[w], w.encode()))[: pl.VOCABULARY - pl.OTHERS])
    entries = Counter()
    for w in n:
        if w not in top:
            entries[crc32(w.encode()) % pl.OTHERS] += n[w]
    assert len(n) > len(top) == pl.VOCABULARY - pl.OTHERS

    counts = pl.counted(docs)
    words = pl.vocabulary(docs, counts)
    assert set(words) == top and {r.w: r.n for r in counts.collect()} == n
    p = pl.start()
    before, after = ({r.id: r for r in pl.score(docs, words, p, c).collect()} for c in (None, counts))
    assert len(after) == len(texts)
    for i, t in texts.items():
        more = sum(log(n[w] / entries[crc32(w.encode()) % pl.OTHERS]) for w in t if w not in top)
        assert after[i].n_words == len(t) and abs(after[i].log_likelihood - before[i].log_likelihood - more) < 1e-6 * max(1, abs(more))

    *_, ((_, lc), (_, lj)) = pl.forward(p, np.arange(pl.VOCABULARY), np.full((4, pl.VOCABULARY), 5))
    share = {r.w: r.log_share for r in pl.log_shares(counts, words).collect()}
    chance = sum(np.exp((lc + lj)[words[w]] + share.get(w, 0.0)) for w in n)
    assert abs(chance - 1) < 1e-3  # over all counted words


def test_junk_is_told_from_prose(spark):
    rnd = np.random.default_rng(3)
    junk = " ".join("".join(rnd.choice(list("bcdfghjkl"), 9)) for _ in range(300))
    docs = spark.read.parquet(f"{SF}/documents.parquet").selectExpr("doc_id", "text").union(spark.createDataFrame([(-1, junk)], "doc_id long, text string"))
    got = {r.doc_id: r.mean_log_likelihood for r in pl.pseudo_likelihood(docs).collect() if r.n_words}
    assert got[-1] < np.quantile(list(got.values()), 0.05)


def test_all_documents_are_trained_on(spark):
    docs = spark.createDataFrame([(i if i % 2 else None, "alpha beta " * 40) for i in range(60)], "id long, text string").coalesce(1)
    words, rnd = pl.vocabulary(docs), np.random.default_rng(1)
    want, w = pl.start(), np.tile([words["alpha"], words["beta"]], 40)
    for r in range(pl.ROUNDS):  # the same descent, on every document and in one process
        rnd = np.random.default_rng(1)
        at, around = pl.neighbours([w] * 60)
        o = rnd.permutation(len(at))
        for k in range(0, len(o), pl.BATCH):
            pl.step(want, at[o[k : k + pl.BATCH]], around[:, o[k : k + pl.BATCH]], pl.RATE / (r + 1))
    got = pl.train(docs, words)
    assert all(np.allclose(got[k], want[k], atol=1e-4) for k in want)
    rows = pl.pseudo_likelihood(docs, "id").collect()
    assert len(rows) == 60 and min(r.mean_log_likelihood for r in rows) > -8.3  # of 4,096 entries by chance


def test_partitions_of_the_table_dont_matter(spark, monkeypatch):
    monkeypatch.setattr(pl, "SHARD", 100_000)  # several shards
    docs = spark.read.parquet(f"{SF}/documents.parquet").selectExpr("doc_id", "text")
    one, seven = ({r.doc_id: r.log_likelihood for r in pl.pseudo_likelihood(d).collect()} for d in (docs.coalesce(1), docs.repartition(7)))
    assert all(abs(one[i] - seven[i]) < 1e-3 * max(1, abs(one[i])) for i in one)


def test_step_against_loops():
    rnd = np.random.default_rng(5)
    n, rate = 40, 0.3
    words, around = rnd.integers(0, 200, n).astype(np.int32), rnd.integers(0, 12, (4, n)).astype(np.int32)
    around[0, 0] = pl.VOCABULARY
    got = pl.start()
    p = {k: v.astype(np.float64) for k, v in got.items()}
    grad, times = {k: np.zeros(v.shape) for k, v in p.items()}, Counter()
    total = 0.0
    for i in range(n):
        c, j = divmod(int(words[i]), pl.SIDE)
        h = np.tanh(sum(p["e"][k][around[k, i]] for k in range(4)) + p["b"])
        back = 0
        for w, b, at in (("wc", p["bc"], c), ("wj", p["bj"][c], j)):
            e = np.exp(h @ p[w] + b)
            d = e / e.sum()
            total += log(d[at])
            d[at] -= 1
            grad[w] += np.outer(h, d) / n
            (grad["bc"] if w == "wc" else grad["bj"][c])[:] += d / n
            back = back + p[w] @ d
        back = back * (1 - h * h)
        grad["b"] += back / n
        for k in range(4):
            grad["e"][k][around[k, i]] += back
            times[k, int(around[k, i])] += 1
    for (k, w), m in times.items():
        grad["e"][k][w] /= np.sqrt(m * n / 16)
    assert abs(pl.step(got, words, around, rate) - total / n) < 1e-5
    assert all(np.allclose(got[k], p[k] - rate * grad[k], atol=1e-5) for k in p)


def test_the_query_against_loops(spark, monkeypatch):
    """Each document's score from the trained network, a place at a time, and the shares of words without an entry of their own."""
    sf, trained = "/root/testdata/sf0.001", []
    train = pl.train
    monkeypatch.setattr(pl, "train", lambda *a: trained.append(train(*a)) or trained[0])
    monkeypatch.setattr(pl, "SHARD", 700)  # a tree of two levels and more
    monkeypatch.setattr(pl, "FAN", 3)
    got = {r.doc_id: r for r in pl.op2_pseudo_likelihood(spark, sf).collect()}
    texts = {r.doc_id: (r.text or "").lower().split() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert got.keys() == texts.keys()
    rows = spark.createDataFrame([(i, " ".join(t)) for i, t in texts.items()], "id long, text string")
    counts = pl.counted(rows)
    words = pl.vocabulary(rows, counts)
    share = {r.w: r.log_share for r in pl.log_shares(counts, words).collect()}
    for i, t in [*texts.items()][:25]:
        ids, total = words.ids(" ".join(t)), 0.0
        for k, w in enumerate(ids):
            around = np.array([[ids[k + o] if 0 <= k + o < len(ids) else pl.VOCABULARY] for o in (-2, -1, 1, 2)])
            *_, ((_, lc), (_, lj)) = pl.forward(trained[0], np.array([w]), around)
            total += (lc + lj)[0] + share.get(t[k], 0.0)
        assert got[i].n_words == len(t) and abs(got[i].log_likelihood - total) < 1e-3 * max(1, abs(total))
