import json
import zipfile

import pytest
from pyspark.sql import functions as F

from archivist.functions.embed import embed_column
from archivist.library import Busy, Library
from archivist.operators.hybrid import hybrid_search, resolved
from archivist.operators.vector_index import LOCAL, Cancelled, Unavailable, VectorIndex
from tests.oracle import agree


@pytest.mark.parametrize("name", ["hybrid_mode_both", "hybrid_mode_fts", "hybrid_mode_vec", "hybrid_mode_fallback", "hybrid_mode_vec_fallback", "browse_search_like", "vector_index_runs", "vector_index_healed", "rrf_merge", "bm25_topk", "fts_postings"])
def test_queries_against_sql(spark, name):
    assert agree(spark, name)


def texts(spark, rows):
    return spark.createDataFrame(rows, "id long, text string")


def test_resume_after_an_interruption(spark, tmp_path):
    """A run that stops between two chunks is gone on with: only the rest is embedded."""
    items = texts(spark, [(i, f"author{i % 7}\nkey{i}") for i in range(400)])
    index, seen = VectorIndex(spark, f"file://{tmp_path}", "saves"), []
    with pytest.raises(Cancelled):
        index.sync(items, rows_a_chunk=100, on_chunk=lambda done, of: seen.append(done), should_cancel=lambda: len(seen) > 2)
    there = index.count()
    assert 0 < there < 400 and index.can_resume(LOCAL) and not index.can_resume(LOCAL | {"model": "other"})
    assert index.gaps(items).first() == (400 - there, 0)
    counts = index.sync(items, rows_a_chunk=100)
    assert counts == {"embedded": 400 - there, "reused": 0, "skipped": there, "total": 400} and index.count() == 400
    want = {r.id: list(r.v) for r in items.select("id", embed_column(F.col("text")).alias("v")).collect()}
    assert {r.id: list(r.embedding) for r in index.vectors().collect()} == want
    assert index.sync(items)["skipped"] == 400


def test_failed_write_leaves_no_chunk(spark, tmp_path):
    bad = F.udf(lambda t: 1 / 0, "array<float>")
    items = texts(spark, [(i, str(i)) for i in range(50)])
    broken = VectorIndex(spark, f"file://{tmp_path}", "saves", embed=bad)
    with pytest.raises(Exception, match="ZeroDivision"):
        broken.sync(items)
    index = VectorIndex(spark, f"file://{tmp_path}", "saves")
    assert index.vectors() is None and index.sync(items)["embedded"] == 50


def test_changed_texts_profiles_and_the_other_library(spark, tmp_path):
    saves, likes = (VectorIndex(spark, f"file://{tmp_path}", n) for n in ("saves", "likes"))
    saves.sync(texts(spark, [(1, "a"), (2, "b"), (3, None)]))
    assert saves.sync(texts(spark, [(1, "a"), (2, "changed"), (3, None), (4, "d")])) == {"embedded": 2, "reused": 0, "skipped": 2, "total": 4}
    assert saves.count() == 4 and saves.vectors().groupBy("id").count().filter("count > 1").count() == 0
    assert likes.sync(texts(spark, [(2, "changed"), (4, "another text"), (9, "i")]), other=saves) == {"embedded": 2, "reused": 1, "skipped": 0, "total": 3}
    same = {r.id: r.embedding for r in saves.vectors().collect()}[2]
    assert {r.id: r.embedding for r in likes.vectors().collect()}[2] == same
    assert likes.can_extend(LOCAL, 1, 4) and not likes.can_extend(LOCAL, 1, 9) and likes.can_extend(LOCAL | {"model": "x"}, 5, 5)
    small = LOCAL | {"model": "small", "dimensions": 8}
    with pytest.raises(Unavailable):
        saves.search([0.0] * 8, 5, small)
    tiny = VectorIndex(spark, f"file://{tmp_path}", "saves", embed=lambda c: embed_column(c, 8))
    assert tiny.sync(texts(spark, [(1, "a")]), small, other=likes) == {"embedded": 1, "reused": 0, "skipped": 0, "total": 1}  # another profile begins anew
    assert tiny.profile() == small and tiny.count() == 1 and [r.id for r in tiny.search([1.0] * 8, 5, small).collect()] in ([1], [])
    assert likes.sync(texts(spark, [(2, "changed")]), replace=True)["embedded"] == 1 and likes.count() == 1
    likes.remove(texts(spark, [(2, None), (77, None)]))
    assert likes.count() == 0 and likes.sync(texts(spark, [(2, "changed")]))["embedded"] == 1


def test_modes(spark):
    hits = lambda *rows: spark.createDataFrame(rows, "id long, score double")
    near = lambda *rows: (lambda q, n: spark.createDataFrame(rows, "id long, distance double").limit(n))
    words = lambda *rows: (lambda q, n: (hits(*rows) if rows else None, False))

    def unavailable(q, n):
        raise Unavailable

    def failed(q, n):
        raise TimeoutError

    both = hybrid_search(spark, "q", 10, words((5, 3.0), (6, 2.0)), {"local": near((6, 0.1), (7, 0.2))})
    assert [(r.id, r.rank, r.source) for r in both.hits.orderBy("rank").collect()] == [(6, 1, "both"), (5, 2, "fts"), (7, 3, "vec")]
    assert (both.mode, both.truncated, both.fallback, both.provider) == ("hybrid", False, False, "local")
    assert hybrid_search(spark, "q", 2, words((5, 3.0)), {"local": near((6, 0.1), (7, 0.2))}).truncated
    found = lambda k, v, **more: (lambda f: (f.mode, f.provider, f.fallback, f.keyword_degraded, f.vector_degraded, f.hits.count()))(hybrid_search(spark, "q", 5, k, v, **more))
    assert found(words((1, 1.0)), {}) == ("fts", "local", False, False, False, 1)
    assert found(lambda q, n: (None, True), {"local": near((1, 0.1))}) == ("vec", "local", False, True, False, 1)
    assert found(words(), {"local": failed}) == ("none", "local", False, False, True, 0)
    assert found(words(), {"local": near((1, 0.1)), "voyage": failed}) == ("vec-local-fallback", "local", True, False, True, 1)
    assert found(words((2, 1.0)), {"local": near((1, 0.1)), "voyage": unavailable}, requested="voyage") == ("hybrid-local-fallback", "local", True, False, False, 2)
    assert found(words((2, 1.0)), {"local": failed, "voyage": failed}) == ("fts", "local", True, False, True, 1)
    assert resolved("openai", ["local", "voyage"]) == ("local", "openai is not enabled; using local semantic search.") and resolved(None, ["local", "ollama"], "openai") == ("ollama", None)


SITE = "https://www.media.example.com"


def put(path, files):
    with zipfile.ZipFile(path, "w") as z:
        for k, v in files.items():
            z.writestr(k, v if isinstance(v, str) else json.dumps(v))


def saved(code, author, at, host=SITE):
    return {"title": author, "string_map_data": {"Saved on": {"href": f"{host}/p/{code}/", "timestamp": at}}}


def test_browse_goes_through_the_search(spark, tmp_path):
    (tmp_path / "in").mkdir()
    rows = [saved("Alpha1", "nature.lover", 1_700_000_001), saved("Beta22", "city_walks", 1_700_000_002), saved("Gamma3", "nature.photos", 1_700_000_003)]
    put(tmp_path / "in/a.zip", {"saved/saved_posts.json": {"saved_saved_media": rows}, "likes/liked_posts.json": {"likes_media_likes": [{"title": "city_walks", "string_list_data": [{"href": f"{SITE}/p/Beta22/", "timestamp": 1_700_000_005}]}]}})
    lib = Library(spark, f"file://{tmp_path}/lib")
    lib.ingest(f"{tmp_path}/in/a.zip")
    page = lib.page("saves", q="nature")
    assert page.mode == "like" and page.total == 2  # no index yet
    counts = lib.sync_search("saves")
    assert counts["keyword"]["added"] == 3 and counts["vectors"]["embedded"] == 3
    assert lib.sync_search("likes")["vectors"]["reused"] == 1
    page = lib.page("saves", q="nature")
    assert page.mode == "hybrid" and {r.media_key for r in page.items.limit(2).collect()} == {"Alpha1", "Gamma3"} and not page.capped
    page = lib.page("saves", q="nature", author="nature.photos", provider="openai")
    assert page.total == 1 and page.mode == "hybrid-local-fallback" and page.fallback and "openai" in page.reason
    put(tmp_path / "in/b.zip", {"saved/saved_posts.json": {"saved_saved_media": [saved("Delta4", "zebra", 1_700_000_009)]}})
    lib.ingest(f"{tmp_path}/in/b.zip")
    assert lib.sync_search("saves")["vectors"] == {"embedded": 1, "reused": 0, "skipped": 3, "total": 4, "removed": 0}
    assert [r.comments for r in lib.stats()["likes"].collect()] == [0]
    jobs = spark.createDataFrame([(1, 2, "completed"), (7, 2, "running")], "job_id long, import_id long, state string")
    with pytest.raises(Busy, match="job 7"):
        lib.discard(2, jobs)
    assert lib.discard(2, jobs.filter("job_id = 1")) == {"before": 1, "after": 0, "saves_deleted": 1, "likes_deleted": 0}
    counts = lib.sync_search("saves")
    assert counts["keyword"]["removed"] == 1 and counts["vectors"]["removed"] == 1 and lib.vector_index("saves").count() == 3


def test_site_and_comment_keys(spark, tmp_path):
    (tmp_path / "in").mkdir()
    rows = [saved("X1", "a", 1), saved("X1", "b", 2, "https://other.example.org"), {"title": "c", "string_map_data": {"Saved on": {"href": "comment:1", "timestamp": 3}}}]
    put(tmp_path / "in/a.zip", {"saved/saved_posts.json": {"saved_saved_media": rows}, "saved/broken.json": "{"})
    lib = Library(spark, f"file://{tmp_path}/lib", site=r"www\.media\.example\.com")
    lib.ingest(f"{tmp_path}/in")
    assert {r.media_key for r in lib.items("saves").collect()} == {"X1", "other.example.org/p/X1"}
    log = lib.import_logs().first().log
    assert (log.itemsParsed, log.filesScanned, log.savedJsonFiles, log.warnings) == (2, 2, ["saved/broken.json", "saved/saved_posts.json"], ["saved/broken.json: JSONDecodeError"])


def test_many_chunks_are_read_by_one_scan(spark, tmp_path):
    items = lambda n, word: spark.range(n).select("id", F.concat(F.lit(word + " "), F.col("id").cast("string")).alias("text"))
    index = VectorIndex(spark, f"file://{tmp_path}", "saves")
    assert index.sync(items(60, "red"), rows_a_chunk=1)["embedded"] == 60
    changed = items(60, "red").filter("id >= 5").unionByName(items(5, "blue"))
    assert index.sync(changed, rows_a_chunk=1) == {"embedded": 5, "reused": 0, "skipped": 55, "total": 60}
    plan = index.vectors()._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") + plan.count("Relation[") == 2 and "Union" not in plan  # a scan for each of some 40 chunks before
    assert index.count() == 60 and index.gaps(changed).first().asDict() == {"missing": 0, "orphans": 0}
