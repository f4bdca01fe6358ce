import io
import json
import random
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from archivist.functions import embed, identity, text
from archivist.library import Library
from archivist.operators import catalog, keyword, merge, vectors
from archivist.sources import archive, exports, schema_infer
from archivist.streaming import feed, jobs

SITE = "https://www.media.example.com"


def column(spark, values, f, kind="string"):
    return [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}").orderBy("i").select(f(F.col("v"))).collect()]


def test_identity(spark):
    urls = [f"{SITE}/p/AbC_1/?x=1", f"{SITE}/reel/aBc/", f"{SITE}/stories/Some.One/123/", f"{SITE}/stories/Some.One/", "https://Other.Example.com/a/b/?q#f", " plain ", " ", None]
    assert column(spark, urls, identity.media_key) == ["AbC_1", "aBc", "story:some.one:123", f"story:some.one:{SITE}/stories/some.one", "other.example.com/a/b", "plain", None, None]
    ends = [f"{SITE}/stories/Bob/", f"{SITE}/stories/Bob", "not a url/", "not a url", "//", "https://a.com/p/X1/", "https://b.com/p/X1/"]
    assert column(spark, ends, identity.media_key) == [f"story:bob:{SITE}/stories/bob"] * 2 + ["not a url"] * 2 + [None, "X1", "X1"]
    assert column(spark, ends[-2:], lambda c: identity.media_key(c, r"a\.com")) == ["X1", "b.com/p/X1"]
    assert column(spark, urls[:5], identity.media_type) == ["post", "reel", "unknown", "unknown", "unknown"]
    assert column(spark, [f"{SITE}/p/A/c/12/", f"{SITE}/p/A/?comment_id=7", f"{SITE}/p/A/#comment-9", "x"], identity.comment_id) == ["12", "7", "9", None]
    assert column(spark, ["@@ann ", "bob", " "], identity.username) == ["ann", "bob", None]
    assert column(spark, ["ann.b", "Saved on", "a b", "x" * 65], identity.looks_like_username) == [True, False, False, False]
    got = column(spark, ["1700000000", "1700000000123", "2023-11-14T22:13:20Z", "nonsense", None], lambda c: F.unix_timestamp(identity.timestamp(c)))
    assert got == [1700000000, 1700000000, 1700000000, None, None]
    assert identity.comment_slug("  Hé llo\n❤ ok! ") == "H_llo__ok" and identity.comment_slug(" ") == "empty"


def labelled(url, owner=None, at=None, **more):
    values = [{"label": "URL", "value": url, "href": url}]
    if owner:
        values.append({"title": "Owner", "dict": [{"title": "", "dict": [{"label": "Username", "value": owner}, {"label": "Name", "value": "Full Name"}]}]})
    return {"timestamp": at, "media": [], "label_values": values, **more}


def test_layouts():
    maps = {"saved_saved_media": [{"title": "ann", "string_map_data": {"Saved on": {"href": f"{SITE}/p/A1/", "timestamp": 5}}}, None, "x"]}
    assert [*exports.saves(maps, "saved.json")] == [(f"{SITE}/p/A1/", "ann", 5, None)]
    lists = {"saved_saved_media": [{"title": "", "stringListData": [{"value": "x"}, {"href": f"{SITE}/p/A2/", "value": "bob", "timestamp": 6}]}]}
    assert [*exports.saves(lists, "saved.json")] == [(f"{SITE}/p/A2/", "bob", 6, None)]
    assert [*exports.saves([labelled(f"{SITE}/p/A3/", "cy", 7), {"no": 1}, None], "s")] == [(f"{SITE}/p/A3/", "cy", 7, None)]
    group = [{"timestamp": 1, "label_values": [{"label": "Name", "value": "Trips"}, {"title": "Media", "dict": [{"title": "", "dict": labelled(f"{SITE}/p/A4/", "di")["label_values"]}, None]}]}]
    assert [*exports.saves(group, "s")] == [(f"{SITE}/p/A4/", "di", None, "Trips")]
    nested = {"saved_saved_collections": [{"title": "Food", "media_list_data": [{"title": "ed", "string_map_data": {"Saved on": {"href": f"{SITE}/p/A5/", "timestamp": 8}}}]}]}
    assert [*exports.saves(nested, "s")] == [(f"{SITE}/p/A5/", "ed", 8, "Food"), (f"{SITE}/p/A5/", None, None, "Food")]
    flat = {"saved_saved_collections": [{"string_map_data": {"Name": {"value": "One"}}}, {"string_map_data": {"Name": {"href": f"{SITE}/p/A6/", "value": "fay"}, "Added Time": {"timestamp": 9}}}, {"string_map_data": {"Name": {"value": "Two"}}}, {"string_map_data": {"Name": {"href": f"{SITE}/p/A7/", "value": "gus"}}}]}
    assert [*exports.saves(flat, "s")] == [(f"{SITE}/p/A6/", "fay", 9, "One"), (f"{SITE}/p/A7/", "gus", None, "Two")]
    assert [*exports.saves({"a": [{"href": f"{SITE}/p/A8/"}, f"see {SITE}/p/A9/"]}, "s")] == [(f"{SITE}/p/A8/", None, None, None), (f"see {SITE}/p/A9/", None, None, None)]
    like = {"likes_media_likes": [{"title": "hal", "string_list_data": [{"href": f"{SITE}/p/B1/", "timestamp": 3}]}], "likes_comment_likes": [{"title": "x", "string_list_data": [{"href": f"{SITE}/p/B2/"}]}]}
    assert [*exports.likes(like, "story_likes")] == [(f"{SITE}/p/B1/", "hal", 3, "liked_posts"), (f"{SITE}/p/B2/", "x", None, "liked_comments")]


def put(folder, name, files):
    with zipfile.ZipFile(folder / name, "w") as z:
        for k, v in files.items():
            z.writestr(k, v if isinstance(v, (bytes, str)) else json.dumps(v))


def test_import_merge_browse_and_discard(spark, tmp_path):
    for k in (1, 2):
        (tmp_path / str(k)).mkdir()
    saved = [labelled(f"{SITE}/p/A{i}/", f"user{i % 2}", 1_700_000_000 + i) for i in range(4)]
    put(tmp_path / "1", "a.zip", {"saved/saved_posts.json": saved, "likes/liked_posts.json": [labelled(f"{SITE}/p/A0/", "user0", 1_700_000_100)], "likes/liked_comments.json": {"likes_comment_likes": [{"title": "x", "string_list_data": [{"href": f"{SITE}/p/C/c/1/"}]}]}, "__MACOSX/saved.json": "[]", "saved/.hidden.json": "[]", "saved/broken.json": "{", "notes.txt": "x"})
    put(tmp_path / "2", "b.zip", {"saved/saved_posts.json": [labelled(f"{SITE}/reel/A0/?x", "other", 1_700_000_000), labelled(f"{SITE}/p/A1/", "user1", 1_700_000_001), labelled(f"{SITE}/p/New/", "user9", 1_700_000_009)], "saved/saved_collections.json": {"saved_saved_collections": [{"title": "Food", "media_list_data": [{"string_map_data": {"Saved on": {"href": f"{SITE}/p/A1/"}}}]}]}})
    lib = Library(spark, f"file://{tmp_path}/lib")
    assert lib.ingest(f"{tmp_path}/1") == 1 and lib.ingest(f"{tmp_path}/2") == 2 and lib.ingest(f"{tmp_path}/1") == 3
    rows = {r.id: r for r in lib.imports().collect()}
    assert [(rows[k].status, rows[k].items_added, rows[k].items_updated, rows[k].items_skipped) for k in (1, 2)] == [("completed", 5, 0, 0), ("completed", 1, 2, 0)]
    assert rows[3].status == "duplicate" and rows[3].items_added == 0
    items = {r.media_key: r for r in lib.items("saves").collect()}
    assert items["New"].first_seen_import_id == 2 and items["A1"].collections == ["Food"] and items["A0"].author_username == "user0"
    assert [r.media_key for r in lib.browse("saves", page_size="2").collect()] == ["New", "A3"]
    assert [r.media_key for r in lib.browse("saves", membership="both").collect()] == ["A0"]
    assert [r.media_key for r in lib.browse("saves", collection="Food").collect()] == ["A1"]
    assert [r.value for r in lib.facets("saves")["collections"].collect()] == ["Food"]
    assert lib.stats()["likes"].first().total == 1
    paths = {r.file_path: r for r in lib.schemas().collect()}
    assert paths["saved/broken.json"].parse_error and json.loads(paths["saved/saved_posts.json"].schema_json)["type"] == ["array"]
    lib.discard(2)
    assert "New" not in {r.media_key for r in lib.items("saves").collect()}


def test_archive_caps_and_damage(spark):
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("saved/a.json", "[1]" * 50)
        z.writestr("saved/b.json", "[2]")
    data = raw.getvalue()
    assert [e[2] for e in archive.entries("x", data)] == ["saved/a.json", "saved/b.json"]
    at = data.index(b"saved/a.json") + len("saved/a.json")
    assert [e[2] for e in archive.entries("x", data[:at] + b"\xff\xff\xff" + data[at + 3 :])] == ["saved/b.json"]
    with pytest.raises(ValueError):
        [*archive.entries("x", data, entry_cap=10)]
    with pytest.raises(ValueError):
        [*archive.entries("x", data, total_cap=151)]
    docs = archive.synthetic(spark, 2000).withColumns({"archive": F.lit("x"), "entry_ord": F.lit(0), "content": F.col("content").cast("binary")})
    assert exports.parsed(exports.raw_items(docs, "saves"), "saves").count() == 2000


def test_batch_merge_against_a_fold(spark):
    rnd = random.Random(1)
    rows = [(f"k{rnd.randrange(12)}", rnd.choice(["p", "q"]), None, "post", rnd.choice([None, "", "a", "b"]), rnd.choice([None, 1, 2, 3]), [rnd.choice("xyz")], i) for i in range(80)]
    want = {}
    for k, href, code, kind, author, at, lists, _ in rows:
        w = want.setdefault(k, [href, code, kind, None, None, []])
        w[3] = w[3] or author or None
        w[4] = max((x for x in (w[4], at) if x is not None), default=None)
        w[5] += [x for x in lists if x not in w[5]]
    df = spark.createDataFrame(rnd.sample(rows, len(rows)), "media_key string, href string, shortcode string, media_type string, author_username string, at int, collections array<string>, ord int")
    got = {r.media_key: [r.href, r.shortcode, r.media_type, r.author_username, r.at, r.collections] for r in merge.merge_batch(df, "at", ["ord"]).collect()}
    assert got == want


def test_requests():
    assert catalog.browse_request({"page": "2", "type": "reel", "q": " x "}) == catalog.Browse(q="x", type="reel", page=2)
    for bad in ({"page": "0"}, {"page": "1.5"}, {"page_size": "101"}, {"type": "story"}, {"membership": "one"}, {"q": "x" * 501}):
        with pytest.raises(ValueError):
            catalog.browse_request(bad)
    assert catalog.browse_request({"type": "story"}, "likes").type == "story"
    assert [catalog.clamp(x, 25, 100) for x in (None, float("nan"), 0, 7.9, 500)] == [25, 25, 25, 7, 100]


def test_search(spark):
    assert [text.stem(w) for w in ("caresses", "ponies", "agreed", "hopping", "relational", "happy", "controlling", "electricity")] == ["caress", "poni", "agre", "hop", "relat", "happi", "control", "electr"]
    assert text.tokens("Café_au-lait 42", False) == ["cafe", "au", "lait", "42"]
    assert text.keyword_query(" ") is None and text.keyword_query("cats and dogs")[0] == "raw" and text.keyword_query("re-use x") == ("prefix", [["re", "use"], ["x"]])
    docs = spark.createDataFrame([(1, "red cats run"), (2, "cats re use things"), (3, "dogs"), (4, "use re cats")], "id long, text string")
    ids = lambda q: sorted(r.id for r in keyword.matching(docs, q)[0].collect())
    assert ids("ca") == [1, 2, 4] and ids("cats re-us") == [2] and ids("dogs OR red") == [1, 3] and ids("cats NOT red") == [2, 4] and ids('"cats re"') == [2] and ids("") == []
    assert keyword.matching(docs, '"open')[1] and not keyword.matching(docs, "fine")[1]


def test_ranks_and_vectors(spark):
    e = np.eye(1024)
    rows = [(1, e[0].tolist()), (2, (0.8 * e[0] + 0.6 * e[1]).tolist()), (3, e[1].tolist()), (4, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    hits = vectors.knn(df, e[0].tolist(), 10)
    got = hits.collect()
    assert [r.id for r in got] == [1, 2, 3] and got[0].distance == 0 and abs(got[2].distance - 2**0.5) < 1e-9
    assert [r.id for r in vectors.cutoff(hits, 10, slack=0.7).collect()] == [1, 2]
    a, b = (spark.createDataFrame(r, "id long, rank int") for r in ([(5, 1), (6, 2)], [(6, 1), (7, 2)]))
    assert [(r.id, r.source) for r in vectors.reciprocal_ranks(a, b, 10).collect()] == [(6, "both"), (5, "fts"), (7, "vec")]
    assert vectors.memory_admission(400, 10, "saves", "local") == "refuse" and vectors.memory_admission(1100, 6000, "likes", "ollama") == "refuse" and vectors.memory_admission(9000, 10, "saves", "local") == "allow"
    assert keyword.provider("openai", {}) == ("local", "openai is not available") and keyword.provider(None, {"voyage": True}) == ("voyage", None)


def test_embedder():
    v = embed.embed("Héllo wo-rld")
    assert abs(float((v * v).sum()) - 1) < 1e-5 and not embed.embed("  ").any()
    assert embed.features("Héllo a-b") == {"hello", " he", "hel", "ell", "llo", "lo ", "a-b", "ab", " ab", "ab "}
    assert embed.fnv1a(["a", "", "foobar"], 0).tolist() == [0xE40C292C, 0x811C9DC5, 0xBF9CF968]  # published test values
    many = embed.embed_all(["b a a", None, "x-y Zoë"])
    assert (many[0] == embed.embed("b a a")).all() and not many[1].any() and (many[2] == embed.embed("x-y Zoë")).all()
    assert (embed.embed("b a a") == embed.embed("a b")).all()


def test_schema_inference(spark):
    t = schema_infer.infer({"a": 1, "b": ["x", "y"], "c": [{"d": 1}, {"d": None, "e": 2}]})
    assert t["keys"]["b"]["items"] == {"type": ["string"]} and t["keys"]["c"]["items"]["keys"]["e"]["optional"]
    assert t["keys"]["c"]["items"]["keys"]["d"]["type"] == ["number", "null"] and t["keys"]["b"]["arrayLength"] == {"min": 2, "max": 2, "sample": 2}
    assert len(schema_infer.places(1000, 3)) == 20 and schema_infer.places(1000, 3) == schema_infer.places(1000, 3)
    deep = 0
    for _ in range(300):
        deep = [deep]
    assert "truncated" in json.dumps(schema_infer.infer(deep))
    files = spark.createDataFrame([(1, "f", b'{"a":1}'), (2, "f", b'{"a":"x","b":[1]}'), (3, "g", b"{")], "import_id long, name string, content binary")
    got = {r.file_path: r for r in schema_infer.merged_schemas(schema_infer.schemas(files)).collect()}
    keys = json.loads(got["f"].schema_json)["keys"]
    assert keys["a"]["type"] == ["string", "number"] and keys["b"]["optional"] and got["f"].imports == 2 and got["g"].parse_error
    assert schema_infer.parse_prefix('{"a": [1, 2, {"b": "te') == {"a": [1, 2, {"b": "te"}]} and schema_infer.parse_prefix('{"a": 1, "b"') == {"a": 1} and schema_infer.parse_prefix("x") is None


def test_job_policies(spark):
    rows = [("running", 10, 5, True, True, False, "defer"), ("running", 10, 20, True, True, False, "pending"), ("running", 10, 20, False, True, True, "cancelled"), ("running", 10, 5, False, True, False, "pending"), ("pending", 0, 5, False, False, False, "pending")]
    df = spark.createDataFrame(rows, "state string, lease int, now int, alive boolean, owned boolean, cancel boolean, want string")
    got = df.select("want", jobs.reclaimed(*[F.col(c) for c in ("state", "lease", "now", "alive", "owned", "cancel")]).alias("got")).collect()
    assert all(r.want == r.got for r in got)
    moves = spark.createDataFrame([(None, "pending"), ("pending", "running"), ("running", "completed"), ("completed", "running"), ("pending", "completed")], "a string, b string")
    assert [r[0] for r in moves.select(jobs.legal(F.col("a"), F.col("b"))).collect()] == [True, True, True, False, False]
    tries = spark.createDataFrame([(1, 9), (2, 9), (3, 9), (4, 9), (1, 1)], "n int, s int")
    assert [r[0] for r in tries.select(jobs.retry(F.col("n"), F.col("s"), F.lit(True))).collect()] == [1, 4, 15, None, None]
    q = spark.createDataFrame([(1, "completed"), (2, "pending"), (3, "pending")], "job_id long, state string")
    assert [r.job_id for r in jobs.next_job(q).collect()] == [2]
    assert jobs.next_job(q.union(spark.createDataFrame([(4, "running")], q.schema))).count() == 0


def test_throttle_stream(spark, tmp_path):
    ticks = [(1, i, 10 * i, "embed", p, 200) for i, p in enumerate((0, 10, 60, 70, 120, 130, 200))] + [(1, 9, 5000, "embed", 201, 999)]
    spark.createDataFrame(ticks, feed.SHAPE).coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(feed.SHAPE).parquet(f"{tmp_path}/in")
    q = feed.throttled(stream).writeStream.format("memory").queryName("ticks").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [r.processed for r in spark.sql("select processed from ticks order by seq").collect()] == [0, 60, 120, 200, 201]
