import numpy as np
import pytest

from archivist.llm import mixing

SHAPE = "id long, n_tokens long, good double, poor double, toxic double"


def few_toxic(spark, n=3000):
    """Posteriors of documents of which the toxic ones are gone."""
    rnd = np.random.default_rng(5)
    t = np.minimum(rnd.beta(0.15, 8, n), 0.5)
    q = rnd.beta(0.5, 0.25, n)
    p = np.stack([(1 - t) * q, (1 - t) * (1 - q), t], 1)
    return spark.createDataFrame([(i, int(rnd.integers(1, 400)), *map(float, p[i])) for i in range(n)], SHAPE)


def totals(rows):
    return sum(np.array([r.good, r.poor, r.toxic]) * r.n_tokens * r.rate for r in rows)


def test_each_total_meets_its_target(spark):
    got, aim = mixing.fit_rates(few_toxic(spark))
    rows = got.collect()
    assert np.abs(totals(rows) / aim - 1).max() < 2e-3 and min(r.rate for r in rows) >= 0
    assert np.allclose(aim / aim.sum(), [mixing.TARGETS[d] for d in mixing.DOMAINS])


def test_unreachable_targets_are_reported(spark):
    same = spark.createDataFrame([(i, 10, 0.5, 0.4, 0.1) for i in range(5)], SHAPE)
    for least in (0.0, 1.0):
        with pytest.warns(RuntimeWarning, match="out of reach"):
            assert mixing.fit_rates(same, least=least)[0].count() == 5


def test_the_stage_has_the_target_shares(spark, monkeypatch):
    known = few_toxic(spark)
    monkeypatch.setattr(mixing, "posteriors", lambda *_: known)
    rows = {r.id: r for r in known.collect()}
    docs = spark.createDataFrame([(i, "x") for i in rows], "doc_id long, text string")
    copies = mixing.mix_sources(spark, docs, "/root/testdata/sf0.001").groupBy("doc_id").count().collect()
    assert len(copies) == len(rows)
    got = sum(np.array([rows[r.doc_id].good, rows[r.doc_id].poor, rows[r.doc_id].toxic]) * rows[r.doc_id].n_tokens * r["count"] for r in copies)
    assert np.abs(got / got.sum() / [mixing.TARGETS[d] for d in mixing.DOMAINS] - 1).max() < 0.05  # fractions are drawn
    fit = mixing.mixed(docs, None, least=1.0).collect()
    got = totals(fit)
    assert np.abs(got / got.sum() / [mixing.TARGETS[d] for d in mixing.DOMAINS] - 1).max() < 2e-3 and min(r.rate for r in fit) >= 1


def twin(rows, share, least):
    """The same descent by loops over documents: each pass keeps the step with the smallest squares."""
    n, rates = 3, [1.0] * len(rows)

    def sums(rates, free):
        total, moments = np.zeros(n), np.zeros((n, n))
        for r, x, f in zip(rows, rates, free, strict=True):
            p = np.array([r.good, r.poor, r.toxic])
            total += x * r.n_tokens * p
            moments += f * r.n_tokens * np.outer(p, p)
        return total, moments

    now, moments = sums(rates, [True] * len(rows))
    size = max(now / share)
    across = np.eye(n) - np.outer(share, np.ones(n)) if least else np.eye(n)
    weight = np.linalg.pinv(across @ moments @ across.T, rcond=1e-10)
    while True:
        off = (share * now.sum() if least else share * size) - now
        if np.abs(off / (now + off)).max() < mixing.CLOSE:
            return rates
        best = None
        for w, lengths in ((weight, (1, 2, 4, 16)), (np.linalg.pinv(across @ moments @ across.T, rcond=1e-10), (1, 0.5, 0.25))):
            for x in lengths:
                g = x * (across.T @ w @ off)
                moved = [a + r.good * g[0] + r.poor * g[1] + r.toxic * g[2] for a, r in zip(rates, rows, strict=True)]
                new = [max(least, a) for a in moved]
                got = sums(new, [a > least for a in moved])
                d = (share * got[0].sum() if least else share * size) - got[0]
                if best is None or d @ weight @ d < best[0]:
                    best = d @ weight @ d, new, *got
        _, rates, now, moments = best


def test_rates_against_loops(spark):
    known = few_toxic(spark, 400)
    share = np.array([mixing.TARGETS[d] for d in mixing.DOMAINS])
    rows = known.orderBy("id").collect()
    for least in (0.0, 1.0):
        got = [r.rate for r in mixing.fit_rates(known, least=least)[0].orderBy("id").collect()]
        assert np.allclose(got, twin(rows, share, least), rtol=1e-6, atol=1e-6)


def test_hard_targets_take_few_passes(spark, monkeypatch):
    monkeypatch.setattr(mixing, "PASSES", 40)
    rnd = np.random.default_rng(3)
    t, q = rnd.beta(0.05, 8, 4000), rnd.beta(0.2, 0.7, 4000)
    p = np.stack([(1 - t) * q, (1 - t) * (1 - q), t], 1)
    known = spark.createDataFrame([(i, int(rnd.lognormal(5, 1.5)), *map(float, p[i])) for i in range(4000)], SHAPE)
    for least in (0.0, 1.0):
        got, aim = mixing.fit_rates(known, least=least)
        rows = got.collect()
        assert np.abs(totals(rows) / aim - 1).max() < 2e-3 and min(r.rate for r in rows) >= least
