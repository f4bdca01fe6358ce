import numpy as np

from archivist.llm import mixing, pseudo_likelihood as pl

SF = "/root/testdata/sf0.01"


def test_rates_meet_the_targets(spark):
    rows = mixing.op5_mixing(spark, SF).collect()
    assert len(rows) == 1000 and all(r.rate >= 0 for r in rows)
    p = np.array([[r.good, r.poor, r.toxic] for r in rows])
    t = np.array([r.n_tokens for r in rows])
    assert np.allclose(p.sum(1), 1)
    got = (p * (t * np.array([r.rate for r in rows]))[:, None]).sum(0)
    aim = np.array([mixing.TARGETS[d] for d in mixing.DOMAINS])
    assert np.abs(got / got.sum() - aim).max() < 0.02


def test_rates_against_brute_force(spark):
    rnd = np.random.default_rng(1)
    p = rnd.dirichlet([0.3, 0.3, 0.3], 300)
    t = rnd.integers(0, 100, 300)
    df = spark.createDataFrame([(i, int(t[i]), *map(float, p[i])) for i in range(300)], "id long, n_tokens long, good double, poor double, toxic double")
    got, aim = mixing.fit_rates(df, {"good": 0.2, "poor": 0.2, "toxic": 0.6}, 9000.0)
    r = np.array([x.rate for x in sorted(got.collect())])
    assert (r >= 0).all() and np.allclose((p * (r * t)[:, None]).sum(0), aim, rtol=0.01)


def test_mixing_odd_rows(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "a b"), (3, "a b"), (None, "x"), (4, "long " * 9000)], "doc_id long, text string").selectExpr("*", "'x' AS good", "1 AS rate")
    labels = spark.createDataFrame([(3, 1, 0), (4, 0, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = mixing.mixed(docs, labels).collect()
    assert len(got) == 6 and sorted(r.n_tokens for r in got) == [0, 0, 1, 2, 2, 9000]
    assert mixing.mixed(docs.limit(0), labels).count() == 0
    assert mixing.mixed(docs, labels.limit(0)).count() == 6


def test_network_is_a_distribution_and_matches_loops():
    p = {k: v + np.float32(0.01) for k, v in pl.start().items()}
    around = np.array([[1], [2], [3], [pl.VOCABULARY]])
    logs = []
    for w in range(pl.VOCABULARY):
        *_, ((_, lc), (_, lj)) = pl.forward(p, np.array([w]), around)
        logs.append((lc + lj)[0])
    assert abs(np.exp(logs).sum() - 1) < 1e-3
    w, a = pl.neighbours([np.array([5, 6, 7], np.int32), np.array([], np.int32), np.array([9], np.int32)])
    end = pl.VOCABULARY
    assert w.tolist() == [5, 6, 7, 9] and a.T.tolist() == [[end, end, 6, 7], [end, 5, 7, end], [5, 6, end, end], [end] * 4]


def test_training_helps_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").selectExpr("doc_id AS id", "text")
    words = pl.vocabulary(docs)
    trained = pl.train(docs, words, share=4)
    rest = docs.filter("pmod(xxhash64(id), 4) <> 0")
    a, b = ({r.id: r for r in pl.score(rest, words, m).collect()} for m in (trained, pl.start()))
    n = sum(r.n_words for r in a.values())
    assert sum(r.log_likelihood for r in a.values()) / n > sum(r.log_likelihood for r in b.values()) / n + 1
    texts = {r.id: r.text for r in rest.collect()}
    for i in [*texts][:20]:  # one at a time, place by place
        ids, total = words.ids(texts[i]), 0.0
        for k, w in enumerate(ids):
            around = np.array([[ids[k + o] if 0 <= k + o < len(ids) else pl.VOCABULARY] for o in (-2, -1, 1, 2)])
            *_, ((_, lc), (_, lj)) = pl.forward(trained, np.array([w]), around)
            total += (lc + lj)[0]
        assert abs(total - a[i].log_likelihood) < 1e-3 * max(1, abs(total)) and a[i].n_words == len(ids)


def test_likelihood_odd_rows(spark):
    df = spark.createDataFrame([(1, None), (2, " "), (3, "a b"), (3, "a b"), (None, "x"), (4, "long " * 9000)], "doc_id long, text string").selectExpr("*", "'x' AS w", "1 AS id")
    got = pl.pseudo_likelihood(df, share=1).collect()
    assert sorted(r.n_words for r in got) == [0, 0, 1, 2, 2, 9000]
    assert all((r.mean_log_likelihood is None) == (r.n_words == 0) for r in got)
    assert pl.pseudo_likelihood(df.limit(0)).count() == 0
