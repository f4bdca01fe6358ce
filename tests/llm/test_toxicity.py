import random
import zlib
from math import exp, log, sqrt

import numpy as np

from archivist.llm.toxicity import FEATURES, SIZES, THRESHOLD, fit, labelled_sample, op7_toxicity, with_scores

SF = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    got = {r.doc_id: r for r in op7_toxicity(spark, SF).collect()}
    assert len(got) == spark.read.parquet(f"{SF}/documents.parquet").count()
    good = bad = hits = toxic = false = clean = 0
    for r in spark.read.parquet(f"{SF}/labels.parquet").collect():
        g = got[r.doc_id]
        assert g.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and g.predicted == int(g.score >= THRESHOLD)
        if g.held_out:
            good += g.predicted == r.toxic
            bad += g.predicted != r.toxic
            toxic += r.toxic
            hits += r.toxic and g.predicted
            clean += not r.toxic
            false += (not r.toxic) and g.predicted
    print(good, bad, hits, toxic, false, clean)
    assert hits / toxic > 0.7 and false / clean < 0.01


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, "you idiot"), (2, None), (3, ""), (None, "x"), (4, "nice day " * 5000), (4, "nice day " * 5000)], "doc_id long, text string").selectExpr("*", "'z' AS toxic", "2 AS _scores2")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (3, None), (None, 1), (4, 0)], "doc_id long, toxic int")
    m = fit(labelled_sample(docs, labels, ["toxic"]), "toxic")
    rows = with_scores(docs, {"score": m}).collect()
    assert len(rows) == 6 and all(0 <= r.score <= 1 for r in rows)
    assert rows[1].score == rows[2].score and rows[4].score == rows[5].score
    none = fit(labelled_sample(docs, labels.limit(0), ["toxic"]), "toxic")
    assert {r.score for r in with_scores(docs, {"score": none}).collect()} == {0.5}
    assert with_scores(docs.limit(0), {"score": m}).count() == 0


def hashed(text, n):
    """Buckets of the distinct n-grams, one character after another."""
    out = set()
    for at in range(len(text) - n + 1):
        h = 0
        for c in text[at : at + n]:
            h = (h * 0x01000193 & 0xFFFFFFFF) ^ (ord(c) * 0x9E3779B1 & 0xFFFFFFFF)
            h ^= h >> 15
        out.add((h * (0x85EBCA6B + 2 * n) & 0xFFFFFFFF) >> 13)
    return out


def test_ratios_and_fit_against_loops(spark):
    rnd = random.Random(4)
    words = ["river", "stone", "Garden", "quiet", "Morning", "bread", "über", "window"]
    rows = [(i, " ".join(rnd.choices(words, k=12)) + ("  you IDIOT " if i % 3 == 0 else "\nthank you "), int(i % 3 == 0)) for i in range(90)]
    docs, labels = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    got = fit(labelled_sample(docs, labels, ["toxic"]), "toxic")
    found = [set().union(*(hashed(" ".join(t.lower().split()), n) for n in SIZES)) for _, t, _ in rows]
    y = [r[2] for r in rows]
    size = [y.count(0), y.count(1)]
    ratio = {}
    for f in set().union(*found):
        n = [sum(f in x for x, k in zip(found, y, strict=True) if k == kind) for kind in (0, 1)]
        p, q = (n[1] + 1) / (size[1] + 2), (n[0] + 1) / (size[0] + 2)
        if sum(n) >= 3 and abs(p - q) / sqrt(p * (1 - p) / size[1] + q * (1 - q) / size[0]) > 2.5:
            ratio[f] = log(p) - log(q)
    assert 5 < len(ratio) < FEATURES and {*np.flatnonzero(got.weights).tolist()} == {*ratio}
    scale = 1 / max(1.0, sqrt(sum(sum(ratio[f] ** 2 for f in x if f in ratio) for x in found) / len(rows)))
    w, m, v = ({f: 0.0 for f in ratio} for _ in range(3))
    b, mb, vb = log(size[1] / size[0]), 0.0, 0.0
    for t in range(1, 101):
        gs, gb = {f: 1e-6 * w[f] for f in ratio}, 0.0
        for x, k in zip(found, y, strict=True):
            e = (1 / (1 + exp(-(b + sum(w[f] * ratio[f] * scale for f in x if f in ratio)))) - k) / len(rows)
            gb += e
            for f in x & ratio.keys():
                gs[f] += e * ratio[f] * scale
        for f, g in gs.items():
            m[f], v[f] = 0.9 * m[f] + 0.1 * g, 0.99 * v[f] + 0.01 * g * g
            w[f] -= 0.3 * (m[f] / (1 - 0.9**t)) / (sqrt(v[f] / (1 - 0.99**t)) + 1e-8)
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        b -= 0.1 * (mb / (1 - 0.9**t)) / (sqrt(vb / (1 - 0.99**t)) + 1e-8)
    assert abs(got.bias - b) < 1e-4 and all(abs(got.weights[f] - w[f] * ratio[f] * scale) < 1e-4 for f in ratio)
    scores = {r.doc_id: r.score for r in with_scores(docs, {"score": got}).collect()}
    for (i, _, _), x in zip(rows, found, strict=True):
        want = 1 / (1 + exp(-(b + sum(w[f] * ratio[f] * scale for f in x if f in ratio))))
        assert abs(scores[i] - want) < 1e-4
