"""Pipeline stages over odd rows: nulls, empty and long texts, ties, repeated ids with other texts, clashing columns, no rows."""

from corpus_pipeline import packed

from archivist.llm.common import gives_back
from archivist.llm.mixing import mix_sources
from archivist.llm.ngram_join import one_of_each
from archivist.llm.passage_dedup import without_repeats
from archivist.llm.token_counts import truncate
from archivist.llm.toxicity import clean, labelled_sample
from tests.llm.test_records_packing import crc, encode

SF = "/root/testdata/sf0.001"
LONG = "a long text of words " * 4000
ROWS = [(1, None), (2, ""), (3, "first text alone"), (3, "second text, another one"), (4, LONG), (5, LONG), (None, LONG), (None, None), (6, "b c d e f g"), (6, "b c d e f g")]


def odd(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string")
    return df.selectExpr("doc_id", "text", "cast(length(text) AS bigint) AS n_chars", *[f"'own' AS {c}" for c in ("_scores", "_toxic", "_id", "_t", "_left", "_rate", "_copies", "_k", "id", "cls", "n", "component_id")])


def texts(df):
    return sorted((r.doc_id or 0, r.text or "") for r in df.collect())


def test_odd_rows(spark):
    df = odd(spark)
    whole = sorted((i or 0, t or "") for i, t in ROWS)
    for stage in (clean, one_of_each, without_repeats, mix_sources):
        out = stage(spark, df, SF)
        assert out.columns == df.columns and {r[c] for r in out.collect() for c in df.columns[3:]} == {"own"}
        assert stage(spark, df.limit(0), SF).count() == 0
    assert texts(one_of_each(spark, df, SF)) == [x for x in whole if x[0] != 5]
    cut = texts(without_repeats(spark, df, SF))
    assert cut == sorted(x if x[0] != 5 else (5, "") for x in whole)
    assert set(texts(mix_sources(spark, df, SF))) == set(whole)
    assert set(texts(clean(spark, df, SF))) <= set(whole)


def test_odd_rows_are_packed(spark):
    df, by_row = odd(spark), {}
    for r in packed(spark, df, SF).collect():
        assert len(r.ids) == r.length and crc(r.ids) == r.ids_crc32 and r.offset + r.length <= 1024
        by_row.setdefault((r.doc_id or 0, r.doc_tokens), {}).setdefault(r.start, []).append(r.ids)
    got = sorted((i, tuple(sum((p[s][k] for s in sorted(p)), []))) for (i, _), p in by_row.items() for k in range(len(p[0])))
    assert got == sorted((i or 0, tuple([*encode(t), 0])) for i, t in ROWS)
    assert packed(spark, df.limit(0), SF).count() == 0


def test_truncate_keeps_the_texts_of_a_repeated_id_apart(spark):
    got = {r.kept_text for r in truncate(odd(spark).filter("doc_id = 3"), 100).collect()}
    assert got == {"first text alone", "second text, another one"}


def test_sample_is_bounded_in_rows_and_labels_checked(spark):
    docs = spark.createDataFrame([(i % 7, f"text {i}") for i in range(70)], "doc_id long, text string")
    labels = spark.createDataFrame([(0, 5), (1, -1), (2, 0), (2, 1), (3, None), (None, 1), (4, 0)], "doc_id long, toxic int")
    rows = labelled_sample(docs, labels, ["toxic"]).collect()
    assert sorted(((r.text, r.toxic) for r in rows), key=str) == sorted([("text 0", 1), ("text 1", None), ("text 16", 1), ("text 10", None), ("text 11", 0)], key=str)
    assert labelled_sample(docs, labels, ["toxic"], bound=2).count() == 2


def test_a_worker_gives_free_memory_back():
    def held():
        return int(open("/proc/self/statm").read().split()[1]) * 4096

    @gives_back
    def run(batches):
        for b in batches:
            made = [bytes(2000) for _ in range(100_000)]
            last.append(made[-1])  # on top of what is free, which stays with the process without a trim
            del made
            yield b

    last, before = [], held()
    assert list(run(iter([1, 2]))) == [1, 2] and held() - before < 50_000_000
