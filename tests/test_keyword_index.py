import math
import random

import pytest
from pyspark.sql import functions as F

from archivist.functions import text
from archivist.operators import keyword, keyword_index
from tests.oracle import agree


@pytest.mark.parametrize("name", ["fts_ranked_prefix", "fts_ranked_phrase", "fts_ranked_or", "fts_ranked_joined", "fts_web", "keyword_index_sync", "keyword_index_terms", "keyword_index_ranked", "keyword_index_compacted"])
def test_queries_against_sql(spark, name):
    rare = name in ("fts_ranked_phrase", "fts_ranked_or")  # the smallest table has no document for them
    assert agree(spark, name, "/root/testdata/sf0.01") if rare else agree(spark, name)


def fielded(spark, docs):
    rows = [(i, [text.tokens(t, False) for t in ts]) for i, ts in docs.items()]
    return spark.createDataFrame(rows, "id long, fields array<array<string>>")


QUERIES = ["ca", "cats re", "cats re-us", '"cats re"', "do*", '"red cats"', "dogs OR red", "cats NOT red", "cats NOT red use", "dogs OR cats AND re", '"re use"* OR dogs', "cats AND re NOT things", "c* NOT (x", "OR cats", "cats AND", 'a "open', "cat's AND x", "", "zzz", "re use things"]


def test_ranks_what_matching_finds(spark):
    docs = {1: ["red cats run"], 2: ["cats re use things"], 3: ["dogs"], 4: ["use re cats"], 5: [""], 6: ["reuse cats re cats re"], 7: ["cats cats red"]}
    df = fielded(spark, docs)
    plain = spark.createDataFrame([(i, " ".join(t)) for i, t in docs.items()], "id long, text string")
    p, whole = keyword_index.positional(df).cache(), keyword_index.totals(df)
    for q in QUERIES:
        found, degraded = keyword_index.ranked_search(p, whole, q)
        want, also = keyword.matching(plain, q)
        assert degraded == also, q
        assert {r.id for r in found.collect()} == {r.id for r in want.collect()}, q
    assert [r.id for r in keyword_index.ranked_search(p, whole, "do*")[0].collect()] == [3]
    assert keyword_index.ranked_search(p, whole, "c* NOT (x")[1] and keyword_index.ranked_search(p, whole, "OR cats")[1]
    n, mean = 7, sum(len(" ".join(t).split()) for t in docs.values()) / 7
    idf = max(1e-6, math.log((n - 1 + 0.5) / 1.5))
    assert keyword_index.ranked_search(p, whole, "things")[0].first().score == pytest.approx(idf * 2.2 / (1 + 1.2 * (0.25 + 0.75 * 4 / mean)))


def test_phrases_stay_in_a_field(spark):
    df = fielded(spark, {1: ["ann lee", "lee way"], 2: ["lee lee way", ""]})
    found = lambda q: {r.id for r in keyword_index.ranked_search(keyword_index.positional(df), keyword_index.totals(df), q)[0].collect()}
    assert found('"lee way"') == {1, 2} and found('"ann lee lee"') == set() and found('"lee lee"') == {2} and found("ann way") == {1}


def test_web_style(spark):
    df = fielded(spark, {1: ["red cats run"], 2: ["cats red red red"], 3: ["dogs run"], 4: ["catsuit red"]})
    found = lambda q: [r.id for r in keyword_index.web_search(keyword_index.positional(df), q).collect()]
    assert found("red") == [2, 1, 4] and found("cats -run") == [2] and found('"red cats" or dogs') == [1, 3] and found("cat") == [] and found("-run") == [] and found("") == [] and found('"cats red') == [2]


def state(index):
    return sorted(map(tuple, index.postings().collect())), sorted(map(tuple, index.documents().collect())), tuple(index.totals().first())


def test_stored_index_equals_a_rebuild(spark, tmp_path):
    rnd = random.Random(7)
    text_of = lambda: [" ".join(rnd.choices("alpha beta gamma delta red cats".split(), k=rnd.randrange(6))) for _ in range(2)]
    docs = {i: text_of() for i in range(30)}
    index = keyword_index.KeywordIndex(spark, f"file://{tmp_path}/index")
    assert index.documents() is None and index.search("cats")[1]
    assert index.sync(fielded(spark, docs)) == {"added": 30, "changed": 0, "removed": 0, "same": 0}
    for step in range(3):
        for i in rnd.sample(sorted(docs), 4):
            docs[i] = [*text_of()[:1], f"new{step}"]
        gone = rnd.sample(sorted(docs), 2)
        for i in gone:
            del docs[i]
        docs[100 + step] = text_of()
        counts = index.sync(fielded(spark, docs))
        assert counts["added"] == 1 and counts["removed"] == 2 and sum(counts.values()) == len(docs) + 2
        if step == 1:
            fresh = keyword_index.KeywordIndex(spark, f"file://{tmp_path}/fresh{step}")
            fresh.sync(fielded(spark, docs))
            before = state(index)
            assert before == state(fresh)
            index.compact()
            assert state(index) == before and len(index._commits()) == 1
    assert index.count() == len(docs) and index.sync(fielded(spark, docs))["same"] == len(docs)
    fresh = keyword_index.KeywordIndex(spark, f"file://{tmp_path}/last")
    fresh.sync(fielded(spark, docs))
    assert state(index) == state(fresh)


def test_an_update_that_died_is_done_again(spark, tmp_path, monkeypatch):
    index = keyword_index.KeywordIndex(spark, f"file://{tmp_path}/index")
    index.sync(fielded(spark, {1: ["red cats"], 2: ["dogs"]}))
    real = keyword_index.KeywordIndex._commit
    monkeypatch.setattr(keyword_index.KeywordIndex, "_commit", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        index.sync(fielded(spark, {1: ["blue cats"], 2: ["dogs"], 3: ["birds"]}))
    assert {r.id for r in index.search("red", stemmed=False)[0].collect()} == {1} and index.count() == 2
    monkeypatch.setattr(keyword_index.KeywordIndex, "_commit", real)
    assert index.sync(fielded(spark, {1: ["blue cats"], 2: ["dogs"], 3: ["birds"]})) == {"added": 1, "changed": 1, "removed": 0, "same": 1}
    assert {r.id for r in index.search("blue OR birds", stemmed=False)[0].collect()} == {1, 3} and index.count() == 3


def test_stems_and_search_documents(spark):
    items = spark.createDataFrame([(1, "Ann", None, "AbC", "reel", ["Running Shoes", None, ""], "s"), (2, None, "x1", "x1", "post", [], None)], "id long, author_username string, shortcode string, media_key string, media_type string, collections array<string>, source string")
    saves = {r.id: r.fields for r in keyword_index.search_fields(items, "saves").collect()}
    assert saves[1] == [["ann"], [], ["abc"], ["reel"], ["run", "shoe"]] and saves[2] == [[], ["x1"], ["x1"], ["post"], []]
    assert {r.id: r.fields[4] for r in keyword_index.search_fields(items, "likes", stemmed=False).collect()} == {1: ["s"], 2: []}
    df = keyword_index.search_fields(items, "saves")
    p, whole = keyword_index.positional(df), keyword_index.totals(df)
    assert [r.id for r in keyword_index.ranked_search(p, whole, "runs", stemmed=True)[0].collect()] == [1]
    assert p.filter(F.col("term") == "x1").first().positions == [keyword_index.FIELD, 2 * keyword_index.FIELD]


def test_texts_are_cut_once(spark, tmp_path):
    """A search without an index counts within rows and gives what postings give; an index cuts a text once for itself and once to compare it (F5, F15, F16)."""
    log = tmp_path / "cut"

    @F.udf("array<array<string>>")
    def cut(t):
        with open(log, "a") as out:
            out.write("x")
        return [part.split() for part in t.split("|")]

    texts = {1: "ann lee|lee way cats", 2: "lee lee way|", 3: "|", 4: "cats re cats re|red cats", 5: "way lee|ann"}
    made = [(i, [part.split() for part in t.split("|")]) for i, t in texts.items()]
    df = spark.createDataFrame(made, "id long, fields array<array<string>>")
    cuts = spark.createDataFrame(list(texts.items()), "id long, t string").select("id", cut("t").alias("fields"))
    p, whole = keyword_index.positional(df).cache(), keyword_index.totals(df)
    want = sorted((i, w, [k * keyword_index.FIELD + j for k, ws in enumerate(fs) for j, x in enumerate(ws) if x == w], sum(map(len, fs))) for i, fs in made for w in {x for ws in fs for x in ws})
    assert sorted((r.id, r.term, r.positions, r.length) for r in p.collect()) == want and p.filter("tf <> size(positions)").isEmpty()
    for q in ['"lee way"', 'l* NOT ann', '"cats r"* OR way']:
        one, two = keyword_index.ranked_search(p, whole, q), keyword_index.ranked_documents(df, q)
        assert one[0].collect() == two[0].collect() and one[1] == two[1], q
        assert keyword_index.web_search(p, q).collect() == keyword_index.web_documents(df, q).collect(), q
    keyword_index.ranked_documents(cuts, "lee")[0].collect()
    assert len(log.read_text()) == len(texts)
    index = keyword_index.KeywordIndex(spark, f"file://{tmp_path}/index")
    index.sync(cuts)
    assert len(log.read_text()) == 2 * len(texts)
    assert index.sync(cuts)["same"] == 5 and len(log.read_text()) == 3 * len(texts)
