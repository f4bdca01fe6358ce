import random

import sentencepiece

from archivist.llm.token_counts import PrefixCounter, default_model, longest_prefix, op9_token_counts, prefix_counts, tokens_of_prefix, truncate

TEXTS = ["", " ", "a", " a", "a ", "the  quick\nbrown\tfox", "internationalization of things", "日本語 テキスト　x", "<s> </s> <unk>", "é à ö 🙂 ok", "▁ ▁▁ x▁y", "aaaa" * 50, "x " * 300]


def test_every_prefix_is_exact():
    model = sentencepiece.SentencePieceProcessor(model_file=default_model())
    c, rnd = PrefixCounter(default_model()), random.Random(1)
    texts = TEXTS + ["".join(rnd.choices(" \nabehinorst.,é日", k=40)) for _ in range(60)]
    for t in texts:
        changes = c.texts([t])[0]
        assert len(changes) == len(t)
        for i in range(len(t) + 1):
            assert tokens_of_prefix(changes, i) == len(model.encode(t[:i])), (t, i)


def test_budget():
    c = PrefixCounter(default_model())
    changes = c.texts(["one two three four five"])[0]
    assert longest_prefix(changes, tokens_of_prefix(changes, 99)) == len("one two three four five")
    assert longest_prefix(changes, 2) == len("one two")
    assert longest_prefix(changes, 0) == 0


def test_rows(spark):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(90, None, None), (90, None, None), (None, "a b", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    model = sentencepiece.SentencePieceProcessor(model_file=default_model())
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_bytes, r.n_tokens) for r in prefix_counts(df).collect())
    assert got == sorted((i if i is not None else -1, len((t or "").encode()), len(model.encode(t or ""))) for i, t, _ in rows)
    assert prefix_counts(df.limit(0)).count() == 0
    cut = {r.doc_id: r.kept_text for r in truncate(df, 3).collect()}
    assert cut[6] == "internationalization of"[: len(cut[6])] and len(model.encode(cut[6])) <= 3


def test_query_against_library(spark):
    sf = "/root/testdata/sf0.001"
    model = sentencepiece.SentencePieceProcessor(model_file=default_model())
    want = {r.doc_id: len(model.encode(r.text or "")) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = op9_token_counts(spark, sf).collect()
    assert {r.doc_id: r.n_tokens for r in got} == want
    assert all(r.over_limit == (r.n_tokens > 4096) for r in got)
