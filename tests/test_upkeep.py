import functools
import json
import random
import time

import pytest
from pyspark.sql import functions as F

from archivist.functions import sorting
from archivist.operators import import_log
from archivist.sources import archive, exports
from archivist.sources import schema_infer as si
from archivist.sources import verified_copy as vc
from archivist.sources.settings import Settings
from archivist.sources.store import Store
from archivist.streaming import feed
from tests.oracle import agree


@pytest.mark.parametrize("name", ["schema_catalog_files", "schema_options", "schema_rows_readable", "import_log_counts", "import_log_recovered", "copy_row_totals", "copy_changes_located", "tree_locale_order", "tree_natural_order", "jobs_listed", "jobs_waiting"])
def test_queries_against_sql(spark, name):
    assert agree(spark, name)


def value(rnd, depth=0):
    kind = rnd.randrange(7 if depth < 3 else 5)
    if kind < 5:
        return [None, True, rnd.randrange(4), 1.5, "text"][kind]
    if kind == 5:
        return [value(rnd, depth + 1) for _ in range(rnd.randrange(3))]
    return {k: value(rnd, depth + 1) for k in rnd.sample("abcd", rnd.randrange(4))}


def test_merging_in_stages_is_merging_in_order():
    rnd = random.Random(5)
    for _ in range(300):
        trees = [si.infer(value(rnd)) for _ in range(rnd.randrange(2, 7))]
        whole = functools.reduce(si.merge, trees)
        cut = rnd.randrange(1, len(trees))
        assert si.merge(functools.reduce(si.merge, trees[:cut]), functools.reduce(si.merge, trees[cut:])) == whole
    only = si.merge(si.infer({"a": 1}), si.infer("x"))
    assert only["keys"]["a"]["optional"] and si.infer(None) == {"type": ["null"], "sample": None} and "sample" not in si.infer(float("inf"))
    assert si.infer(list(range(100)))["arrayLength"] == {"min": 100, "max": 100, "sample": 20}


def test_catalog(spark):
    rows = [(k, "a.json", 10 + k, k == 40, "object", json.dumps(si.infer({"n": k} | ({"x": "t"} if k % 2 else {}))), None) for k in range(1, 70)]
    rows += [(3, "b.json", 5, False, "unknown", None, "JSONDecodeError"), (4, "b.json", 6, False, "array", "{broken", None), (99, "lost.json", 1, False, "object", "{}", None)]
    rows += [(5, "c.json", 1, False, "array", json.dumps({"type": ["string"], "sample": "secret"}), None), (6, "c.json", 1, False, "object", json.dumps({"type": ["object"], "keys": {}}), None)]
    found = spark.createDataFrame(rows, "import_id long, file_path string, byte_size long, truncated_read boolean, top_level_type string, schema_json string, parse_error string")
    imports = spark.createDataFrame([(k, f"f{k}", k * 10, "completed") for k in range(1, 72)], "id long, filename string, imported_at long, status string")
    c = si.catalog(imports, found)
    files = {r.file_path: r for r in c.files.collect()}
    assert c.mode == "all" and c.empty_reason is None and set(files) == {"a.json", "b.json", "c.json"}  # an import that isn't there has no part
    a, tree = files["a.json"], json.loads(files["a.json"].schema_json)
    assert (a.byte_size, a.truncated_read, a.top_level_type, a.imports, a.parse_error) == (79, True, "object", 69, None)
    assert tree["keys"]["n"]["sample"] == 69 and tree["keys"]["x"]["optional"] and "optional" not in tree["keys"]["n"]
    assert files["b.json"].parse_error == si.INVALID and files["b.json"].top_level_type == "array" and files["b.json"].schema_json is None
    assert files["c.json"].top_level_type == "array|object" and "secret" not in files["c.json"].schema_json
    assert [(r.id, r.schema_files, r.has_schemas) for r in c.imports.limit(3).collect()] == [(71, 0, False), (70, 0, False), (69, 1, True)]
    one = si.catalog(imports, found, "4")
    assert one.mode == "import" and {r.file_path: r.parse_error for r in one.files.collect()} == {"a.json": None, "b.json": si.INVALID}
    reasons = [si.catalog(imports, found, w).empty_reason for w in ("71", "500", "x", "-1")]
    assert reasons == ["this import has no schemas", "import not found", "invalid import id", "invalid import id"]
    assert si.catalog(imports, found.limit(0)).empty_reason == "no import has schemas yet" and si.catalog(imports.filter("id > 70"), found.filter("import_id = 99")).empty_reason
    assert {(r.file_path, r.id) for r in si.path_imports(found, imports).filter("file_path = 'b.json'").collect()} == {("b.json", 3), ("b.json", 4)}


def test_decoded_logs(spark):
    new = {"filesScanned": 3, "itemsParsed": 2, "likesParsed": 4, "authorsFound": 6, "likesWithLikedAt": 4, "typeCounts": {"post": 2}, "warnings": ["Likes: 3 added, 1 updated, 0 unchanged."]}
    notes = [json.dumps(new), json.dumps(new | {"likesAdded": 1, "likesAuthorsFound": 3}), "", None, "[1]", "{", '{"filesScanned": "3"}', '{"filesScanned": 1, "warnings": null}', "5"]
    df = spark.createDataFrame([(k, n) for k, n in enumerate(notes)], "id int, notes string").select("id", import_log.decoded(F.col("notes")).alias("l"))
    got = {r.id: r.l for r in df.collect()}
    assert [got[k] is None for k in range(9)] == [False, False, True, True, True, True, True, False, True]
    assert (got[0].likesAdded, got[0].likesUpdated, got[0].likesSkipped) == (3, 1, 0) and got[1].likesAdded == 1 and got[1].likesUpdated == 0
    assert got[0].typeCounts.post == 2 and got[0].typeCounts.reel == 0 and got[7].warnings == [] and got[7].likeTypeCounts.comment == 0
    both = df.filter("l is not null").select("id", *[c.alias(n) for c, n in zip(import_log.authors(F.col("l")), ("saves", "likes"), strict=True)])
    assert {r.id: (r.saves, r.likes) for r in both.collect()} == {0: (2, 4), 1: (6, 3), 7: (0, 0)}


def test_copies_are_verified(spark, tmp_path):
    rows = spark.createDataFrame([(k, f"n{k}", k % 3 == 0, None if k % 5 == 0 else float(k)) for k in range(200)], "id long, name string, flag boolean, x double")
    source, target = Store(spark, f"file://{tmp_path}/a"), Store(spark, f"file://{tmp_path}/b")
    source.write("things", rows)
    source.write("empty", rows.limit(0))
    tables = {"things": (["id"], {"flag": "flag", "id": "text"}), "empty": (["id"], {})}
    assert {r.table: r.rows for r in vc.copy_store(source, target, tables).collect()} == {"things": 200, "empty": 0}
    assert dict(target.read("things").dtypes) == {"id": "string", "name": "string", "flag": "int", "x": "double"}
    with pytest.raises(vc.NotEmpty):
        vc.copy_store(source, target, tables)
    lossy = Store(spark, f"file://{tmp_path}/c")
    with pytest.MonkeyPatch.context() as m:
        m.setitem(vc.CONVERSIONS, "cut", (lambda c: F.substring(c, 1, 2), lambda c: c))
        with pytest.raises(vc.Different, match="things"):
            vc.copy_store(source, lossy, {"empty": (["id"], {}), "things": (["id"], {"name": "cut"})})
    assert lossy.version("empty") is None and lossy.version("things") is None  # nothing was published
    swapped = rows.withColumn("x", F.when(F.col("id") == 7, None).otherwise(F.col("x"))).filter("id <> 9").union(rows.filter("id = 11"))
    assert sorted((r.id, r.what) for r in vc.changed_keys(rows, swapped, ["id"], 16).collect()) == [(7, "changed"), (9, "missing"), (11, "changed")]
    assert vc.differing(rows.repartition(7), rows.orderBy(F.desc("id")), ["id"]).count() == 0


def test_orders_of_names(spark):
    names = ["a10", "a2", "A3", "a02", "b", "a", "1", "10", "9", "a1b10", "a1b9", "a99999999999999999999", "a100000000000000000000", "é", "f"]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    got = [r.name for r in df.orderBy(sorting.natural_key(F.col("name"))).collect()]
    assert got == ["1", "9", "10", "a", "a1b9", "a1b10", "a02", "a2", "A3", "a10", "a99999999999999999999", "a100000000000000000000", "b", "f", "é"]
    assert [r.name for r in df.filter("name in ('é', 'f', 'b', 'A3', 'a')").orderBy(sorting.locale_key(F.col("name"))).collect()] == ["a", "A3", "b", "é", "f"]
    files = spark.createDataFrame([("z.json",), ("likes/b2.json",), ("likes/b10.json",), ("/likes//a/x.json",), ("a.json",)], "file_path string")
    rows = sorting.tree_order(sorting.tree_nodes(files), natural=True).collect()
    assert [r.path for r in sorted((r for r in rows if r.parent == ""), key=lambda r: r.place)] == ["likes", "a.json", "z.json"]
    assert [(r.path, r.kind, r.files) for r in sorted((r for r in rows if r.parent == "likes"), key=lambda r: r.place)] == [("likes/a", "folder", 1), ("likes/b2.json", "file", 1), ("likes/b10.json", "file", 1)]


def test_synthetic_layouts(spark):
    for layout, (library, kind, every, author, authors, first) in archive.LAYOUTS.items():
        docs = archive.synthetic(spark, 130, layout).withColumns({"archive": F.lit("x"), "entry_ord": F.lit(0), "content": F.col("content").cast("binary")})
        at = "saved_at" if library == "saves" else "liked_at"
        got = {r.media_key: r for r in exports.parsed(exports.raw_items(docs, library), library).withColumn("seconds", F.unix_timestamp(at)).collect()}
        assert len(got) == 130 and got["S00003l"].media_type == (kind if 129 % every == 0 else "post")
        assert got["S00003l"].author_username == f"{author}{129 % authors}" and got["S00003l"].seconds == first + 129


def test_settings(spark, tmp_path):
    env = {"OPENAI_ENABLED": "true", "LIKES_VOYAGE_ENABLED": "1", "EMBEDDING_PROVIDER": "Ollama", "MODEL": " m "}
    s = Settings(Store(spark, f"file://{tmp_path}"), env)
    assert s.get("model", "MODEL", default="d") == "m" and s.get("other", "NONE", default="d") == "d" and s.preferred() == "ollama" and s.timeout_ms() == 30_000
    assert s.enabled("local", "saves") and s.enabled("openai", "saves") and not s.enabled("voyage", "saves") and s.enabled("voyage", "likes") and not s.enabled("ollama", "saves")
    s.update({"model": " stored ", "openai_enabled": "0", "likes_openai_enabled": "1", "embedding_timeout_ms": "x", "blank": " "})
    assert s.get("model", "MODEL") == "stored" and "blank" not in s.stored()
    s.migrate()
    assert not s.enabled("openai", "saves") and s.enabled("openai", "likes") and "openai_enabled" not in s.stored()
    with pytest.raises(ValueError):
        s.timeout_ms()
    s.update({"model": None})
    assert s.get("model", "MODEL") == "m"


def test_reset(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}")
    store.write("things", spark.range(3))
    for phrase, busy in (("reset", False), ("RESET", True)):
        with pytest.raises(ValueError):
            store.reset(phrase, ["things"], busy)
    store.reset("RESET", ["things"])
    assert store.read("things").count() == 0


SNAPSHOT = "channel string, seq long, fingerprint string, idle boolean"


def test_change_feed_over_a_restart(spark, tmp_path):
    put = lambda rows: spark.createDataFrame(rows, SNAPSHOT).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    spark.createDataFrame([], SNAPSHOT).write.parquet(f"{tmp_path}/in")
    out = f"{tmp_path}/out"

    def start():
        stream = spark.readStream.schema(SNAPSHOT).parquet(f"{tmp_path}/in")
        return feed.change_feed(stream, heartbeat_ms=1500).writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{tmp_path}/cp").outputMode("append").trigger(processingTime=feed.BURST).start()

    def told():
        try:
            return [(r.channel, r.event, r.fingerprint) for r in spark.read.schema(feed.EVENTS).parquet(out).orderBy("channel", "seq", F.col("event") == "idle").collect()]
        except Exception:
            return []

    def until(f):
        end = time.time() + 60
        while time.time() < end and not f():
            time.sleep(0.3)
        return f()

    put([("a", 1, "x", False), ("a", 2, "y", False), ("b", 1, "z", True)])
    q = start()
    assert until(lambda: len([t for t in told() if t[1] != "ping"]) == 3)
    assert [t for t in told() if t[1] != "ping"] == [("a", "snapshot", "y"), ("b", "snapshot", "z"), ("b", "idle", "z")]  # of the burst only the last
    put([("a", 3, "y", False), ("b", 2, "z", True)])
    assert until(lambda: ("a", "ping", None) in told())
    q.stop()
    q.awaitTermination(30)
    put([("a", 4, "y", False)])
    put([("a", 5, "w", True), ("b", 3, "v", False)])
    q = start()
    assert until(lambda: len([t for t in told() if t[1] != "ping"]) >= 6)
    q.stop()
    assert [t for t in told() if t[1] != "ping"] == [("a", "snapshot", "y"), ("a", "snapshot", "w"), ("a", "idle", "w"), ("b", "snapshot", "z"), ("b", "idle", "z"), ("b", "snapshot", "v")]


def test_cached_status(spark, tmp_path):
    ticks = [("s", 1, 0, False, "j1", "c1"), ("s", 2, 1000, False, "j2", "c2"), ("s", 3, 2000, True, "j3", "c3"), ("s", 4, 6999, True, "j4", "c4"), ("s", 5, 7000, True, "j5", "c5"), ("s", 6, 7001, False, "j6", "c6")]
    shape = "channel string, seq long, at_ms long, active boolean, job string, counts string"
    spark.createDataFrame(ticks, shape).coalesce(1).write.parquet(f"{tmp_path}/in")
    q = feed.cached_status(spark.readStream.schema(shape).parquet(f"{tmp_path}/in")).writeStream.format("memory").queryName("statuses").option("checkpointLocation", f"{tmp_path}/cp").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [(r.job, r.counts, r.counts_seq) for r in spark.sql("select * from statuses order by seq").collect()] == [("j1", "c1", 1), ("j2", "c1", 1), ("j3", "c3", 3), ("j4", "c3", 3), ("j5", "c5", 5), ("j6", "c6", 6)]


def test_a_log_is_parsed_once(spark):
    notes = spark.createDataFrame([('{"filesScanned": 1, "likesParsed": 5, "warnings": ["Likes: 3 added, 2 updated, 0 unchanged."]}',), ("{x",), ('{"filesScanned": "1"}',), (None,)], "notes string")
    found = notes.select(import_log.decoded(F.col("notes")).alias("l"))
    assert [(r.l.likesAdded, r.l.likesUpdated, r.l.filesScanned, r.l.typeCounts.post) if r.l else None for r in found.collect()] == [(3, 2, 1, 0), None, None, None]
    plan = found.select("l.likesAdded", "l.likesUpdated", "l.likesParsed")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") == 1, plan.count("from_json")  # for each field and condition before


def test_files_are_read_once_and_trees_keep_the_order_of_imports(spark, tmp_path):
    """Import numbers may lie far apart; each path's trees are merged as a loop does, the latest first (F13)."""
    rnd, log = random.Random(5), tmp_path / "read"
    values = [(rnd.randrange(10**12), rnd.choice("fgh"), json.dumps({rnd.choice("abcd"): rnd.choice([1, 2, "x", None, [1, 2]]) for _ in range(3)})) for _ in range(300)]

    @F.udf("binary")
    def content(text):
        with open(log, "a") as out:
            out.write("x")
        return text.encode()

    rows = spark.createDataFrame(values, "import_id long, name string, text string").select("import_id", "name", content("text").alias("content"))
    got = {r.file_path: json.loads(r.schema_json) for r in si.merged_schemas(si.schemas(rows)).collect()}
    assert len(log.read_text()) == len(values)
    for name, tree in got.items():
        latest = {}
        for i, n, text in values:
            if n == name:
                made = si.file_schema(n, text.encode())[1]
                latest[made] = max(i, latest.get(made, -1))
        want = [json.loads(t) for t in sorted(latest, key=lambda t: -latest[t])]
        assert tree == functools.reduce(si.merge, want), name
