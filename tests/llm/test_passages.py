import hashlib
import random

import numpy as np

from archivist.llm import passage_dedup, suffix_arrays
from archivist.llm.passage_dedup import op8_passage_dedup, remove_repeats, without_repeats


def test_suffix_arrays():
    rnd = random.Random(1)
    for trial in range(400):
        suffix_arrays.MANY = rnd.choice([0, 2000])
        b = bytes(rnd.choices(range(rnd.choice([1, 2, 3, 256])), k=rnd.randint(0, 60))) if trial % 3 else (b"abracadabra" * 6)[: rnd.randint(0, 66)]
        t = np.frombuffer(b, np.uint8)
        sa = suffix_arrays.suffix_array(t)
        assert sa.tolist() == sorted(range(len(b)), key=lambda i: b[i:])
        lcp, before = suffix_arrays.permuted_common_prefixes(t, sa, 10)
        for x, y in zip(sa[:-1], sa[1:], strict=True):
            n = 0
            while n < 10 and max(x, y) + n < len(b) and b[x + n] == b[y + n]:
                n += 1
            assert (lcp[y], before[y]) == (n, x)
    suffix_arrays.MANY = 2000


def brute(docs, length=50):
    seen, out = {}, {}
    for i in sorted(docs):
        raw = (docs[i] or "").encode()
        for k in range(len(raw) - length + 1):
            seen.setdefault(raw[k : k + length], i)
    for i in sorted(docs):
        raw = (docs[i] or "").encode()
        gone = np.zeros(len(raw) + 2, bool)
        for k in range(len(raw) - length + 1):
            if seen[raw[k : k + length]] < i:
                gone[k + 1 : k + 1 + length] = True
        left = bytes(c for c, g in zip(raw, gone[1:-1], strict=True) if not g)
        out[i] = (len(raw), int(gone.sum()), int((np.diff(gone.astype(int)) == 1).sum()), hashlib.sha256(left).hexdigest())
    return out


def rows(df):
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect()}


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    want = brute(docs)
    got = rows(op8_passage_dedup(spark, sf))
    assert {i: (got[i], want[i]) for i in want if got[i] != want[i]} == {} and len(got) == len(want)
    assert sum(x[1] for x in want.values()) > 1000


def test_random_passages(spark):
    rnd = random.Random(2)
    alphabet = "abcdefgh é\n"
    passages = ["".join(rnd.choices(alphabet, k=rnd.randint(40, 160))) for _ in range(12)] + ["ab" * 60, "x" * 90]
    docs = {}
    for i in range(150):
        parts = [rnd.choice(passages)[rnd.randrange(4) :] if rnd.random() < 0.6 else "".join(rnd.choices(alphabet, k=rnd.randint(0, 70))) for _ in range(rnd.randint(0, 5))]
        docs[i] = "".join(parts)
    df = spark.createDataFrame([*docs.items()], "doc_id long, text string").repartition(5)
    assert rows(remove_repeats(df)) == brute(docs)


def test_odd_rows(spark):
    long = "word number " * 5000
    data = [(1, None), (2, ""), (3, "a" * 49), (4, "a" * 49), (5, long), (6, long), (None, long), (7, "é" * 40), (8, "x" + "é" * 40), (6, long)]
    df = spark.createDataFrame(data, "doc_id long, text string").selectExpr("*", "'z' AS t", "1 AS id", "2 AS spans")
    got = remove_repeats(df).collect()
    assert len(got) == len(data)
    assert sorted((r.doc_id or 0, r.n_bytes, r.n_removed) for r in got) == [(0, 60000, 0), (1, 0, 0), (2, 0, 0), (3, 49, 0), (4, 49, 0), (5, 60000, 0), (6, 60000, 60000), (6, 60000, 60000), (7, 80, 0), (8, 81, 80)]
    assert remove_repeats(df.limit(0)).count() == 0


def test_texts_are_shuffled_once(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for df in (op8_passage_dedup(spark, sf), without_repeats(spark, docs, sf)):
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        shuffles = [x for x in plan.splitlines() if "Exchange hashpartitioning" in x]
        assert len([x for x in shuffles if "ReusedExchange" in x]) == 1
        assert len(shuffles) == 5  # with the reused one: texts, anchors asked for, contexts, what is gone


def test_rows_grow_with_blocks_not_with_anchors(spark, monkeypatch):
    rnd = random.Random(3)
    lines = ["".join(rnd.choices("abcdefgh ", k=120)) for _ in range(300)]
    docs = {i: "\n".join(x[rnd.randrange(40) :] for x in rnd.sample(lines, 30)) for i in range(600)}
    df = spark.createDataFrame([*docs.items()], "doc_id long, text string").coalesce(1)
    counts, keep = [], passage_dedup.stored
    monkeypatch.setattr(passage_dedup, "stored", lambda step: counts.append((out := keep(step)).count()) or out)
    assert rows(remove_repeats(df)) == brute(docs)
    assert counts == [2 * 8 * 32]  # removed and asked for, of 8 buckets, for 32 groups of texts


def test_contexts_hold_each_string_once():
    rnd = random.Random(4)
    texts = ["".join(rnd.choices("ab", k=n)).encode() for n in (0, 49, 50, 51, 700, 3000)] + [b"x" * 300, b"abc" * 200]
    strings = [(int(d), int(x) + k) for doc, low, many, _, _ in passage_dedup.anchors(texts, 50, 26) for d, x, n in zip(doc, low, many, strict=True) for k in range(n)]
    assert sorted(strings) == [(d, k) for d, x in enumerate(texts) for k in range(len(x) - 49)]


def test_other_columns_of_many_types(spark):
    passage = "a passage of more than fifty bytes that two of the texts hold "
    df = spark.createDataFrame([(1, passage + "one"), (2, "two " + passage), (None, passage)], "doc_id long, text string").selectExpr(
        "*", "timestamp '2024-05-06 07:08:09.123456' AS a", "timestamp_ntz '2024-05-06 07:08:09' AS b", "date '1890-01-02' AS c", "array(named_struct('x', timestamp '2000-01-01 00:00:00', 'y', NULL)) AS d", "map('k', 1.25BD) AS e", "binary('z') AS f", "interval '3' day AS g", "cast(NULL AS string) AS h", "true AS `text `"
    )
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        for z in ("UTC", "Asia/Tokyo"):
            spark.conf.set("spark.sql.session.timeZone", z)
            out = without_repeats(spark, df, "")
            assert out.columns == df.columns and [f.dataType for f in out.schema] == [f.dataType for f in df.schema]
            others = [c for c in df.columns if c != "text"]
            assert sorted(map(str, out.select(*[f"`{c}`" for c in others]).collect())) == sorted(map(str, df.select(*[f"`{c}`" for c in others]).collect()))
            assert {r.doc_id: len(r.text) for r in out.collect()} == {1: 65, 2: 4, None: 62}
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_repeated_ids_and_other_lengths(spark):
    rnd = random.Random(5)
    long = "".join(rnd.choices("abcdefgh ", k=900))
    data = [(4, long), (4, long), (4, long[:500]), (7, long[100:]), (7, "x" + long[400:800]), (9, long)]
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    for length, gram in ((50, 26), (300, 26), (20, 20)):
        got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans) for r in remove_repeats(df, length=length, gram=gram).collect())
        assert got == sorted([(4, 900, 0, 0), (4, 900, 0, 0), (4, 500, 0, 0), (7, 800, 800, 1), (7, 401, 400, 1), (9, 900, 900, 1)])
