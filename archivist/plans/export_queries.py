"""Parsing of exports: documents of each layout are made from the tables, then read as an import would read them."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from archivist.plans import views as v
from archivist.sources import exports
from archivist.sources.store import scratch
from archivist.streaming import feed

QUERIES: dict = {}
SQL: dict[str, str] = {}
HOST = "https://media.example.com"


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _kind(c):
    return F.when(c % 3 == 0, "reel").otherwise("p")


def _href(c, kind=None):
    return F.concat(F.lit(HOST + "/"), _kind(c) if kind is None else F.lit(kind), F.lit("/"), c.cast("string"), F.lit("/"))


def _files(docs, name, source=None):
    """docs: (archive, doc): a file for each."""
    return docs.select("archive", F.lit(0).alias("entry_ord"), F.lit(name).alias("name"), F.to_json("doc").cast("binary").alias("content"), F.lit(source).cast("string").alias("source"))


def _order_id():
    return F.lpad(F.col("l_orderkey").cast("string"), 15, "0").alias("archive")


def _entries(s, d, entry):
    """For each order the entries of its line items as a list, by number, part and supplier; an order has few."""
    keys = ["l_linenumber", "l_partkey", "l_suppkey", "l_returnflag"]
    rows = v.read(s, d, "lineitem").select(_order_id(), *keys, entry.alias("entry"))
    return rows.groupBy("archive").agg(F.transform(F.array_sort(F.collect_list(F.struct(*keys, "entry"))), lambda x: x["entry"]).alias("entries"))


_ITEM = "i AS (SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey AS k, 'user' || l_suppkey AS author, epoch(date_trunc('second', l_shipdate)) AS sec, l_quantity > 45 AS bare, l_returnflag AS flag FROM lineitem)"
_MERGED = "SELECT CAST(k AS VARCHAR) AS media_key, CASE WHEN k % 3 = 0 THEN 'reel' ELSE 'post' END AS media_type, arg_min(author, (l_orderkey, l_linenumber, l_suppkey)) FILTER (NOT bare) AS author_username, CAST(max(sec) AS BIGINT) AS seconds"


def _out(parsed, at):
    return parsed.select("media_key", "media_type", "author_username", F.unix_timestamp(at).alias("seconds"))


@query(f"WITH {_ITEM} {_MERGED} FROM i GROUP BY k")
def parse_saves_lists(s, d):
    """String lists: the author is the list's value where it looks like a name; a blank title doesn't count."""
    value = F.when(F.col("l_quantity") > 45, "Saved on").otherwise(F.concat(F.lit("user"), F.col("l_suppkey").cast("string")))
    item = F.struct(F.lit(" ").alias("title"), F.array(F.struct(_href(F.col("l_partkey")).alias("href"), value.alias("value"), F.unix_timestamp("l_shipdate").alias("timestamp"))).alias("string_list_data"))
    docs = _entries(s, d, item).select("archive", F.struct(F.col("entries").alias("saved_saved_media")).alias("doc"))
    return _out(exports.parsed(exports.raw_items(_files(docs, "saved/saved_posts.json"), "saves"), "saves"), "saved_at")


@query(f"WITH {_ITEM} {_MERGED.replace('max(sec)', 'max(sec) + 1000000000')} FROM i GROUP BY k")
def parse_saves_maps(s, d):
    """String maps: the title is the author, the time stands in the field with the address, in milliseconds (late enough to be told from seconds)."""
    title = F.when(F.col("l_quantity") > 45, "").otherwise(F.concat(F.lit("@user"), F.col("l_suppkey").cast("string")))
    field = F.struct(_href(F.col("l_partkey")).alias("href"), ((F.unix_timestamp("l_shipdate") + 1_000_000_000) * 1000).alias("timestamp"))
    item = F.struct(title.alias("title"), F.struct(field.alias("Saved on")).alias("string_map_data"))
    docs = _entries(s, d, item).select("archive", F.struct(F.col("entries").alias("saved_posts")).alias("doc"))
    return _out(exports.parsed(exports.raw_items(_files(docs, "saved/saved_posts.json"), "saves"), "saves"), "saved_at")


def _labelled(owner, href):
    """label_values: an address and an owner with both names."""
    names = F.array(F.struct(F.lit("Name").alias("label"), F.lit("Full Name").alias("value")), F.struct(F.lit("Username").alias("label"), owner.alias("value")))
    return F.array(F.struct(F.lit("URL").alias("label"), href.alias("value"), href.alias("href"), F.lit(None).cast("string").alias("title"), F.lit(None).cast(names_type()).alias("dict")), F.struct(F.lit(None).cast("string").alias("label"), F.lit(None).cast("string").alias("value"), F.lit(None).cast("string").alias("href"), F.lit("Owner").alias("title"), F.array(F.struct(F.lit("").alias("title"), names.alias("dict"))).alias("dict")))


def names_type() -> str:
    return "array<struct<title: string, dict: array<struct<label: string, value: string>>>>"


@query(f"WITH {_ITEM} SELECT CAST(k AS VARCHAR) AS media_key, CASE WHEN k % 3 = 0 THEN 'reel' ELSE 'post' END AS media_type, arg_min(author, (l_orderkey, l_linenumber, l_suppkey)) AS author_username, CAST(max(sec) FILTER (NOT bare) AS BIGINT) AS seconds FROM i GROUP BY k")
def parse_saves_labels(s, d):
    """Label values: the owner's user name goes before the full name; entries may have no time."""
    at = F.when(F.col("l_quantity") <= 45, F.unix_timestamp("l_shipdate"))
    item = F.struct(at.alias("timestamp"), _labelled(F.concat(F.lit("user"), F.col("l_suppkey").cast("string")), _href(F.col("l_partkey"))).alias("label_values"))
    docs = _entries(s, d, item).select("archive", F.col("entries").alias("doc"))
    return _out(exports.parsed(exports.raw_items(_files(docs, "saved/saved_posts.json"), "saves"), "saves"), "saved_at")


@query("""WITH h AS (SELECT l_orderkey, 'Status ' || arg_max(l_returnflag, (l_partkey, l_suppkey, l_returnflag)) AS name FROM lineitem WHERE l_linenumber = 1 GROUP BY 1)
SELECT CAST(l_partkey AS VARCHAR) AS media_key, coalesce(string_agg(DISTINCT name, ',' ORDER BY name), '') AS collections FROM lineitem LEFT JOIN h USING (l_orderkey) WHERE l_linenumber > 1 GROUP BY l_partkey""")
def parse_collections_flat(s, d):
    """Flat collections: an order's lines of number 1 are headers, the others are members of the last one, or of none."""
    name = F.concat(F.lit("Status "), F.col("l_returnflag"))
    href = F.when(F.col("l_linenumber") > 1, _href(F.col("l_partkey")))
    field = F.struct(href.alias("href"), F.when(href.isNull(), name).otherwise(F.concat(F.lit("user"), F.col("l_suppkey").cast("string"))).alias("value"))
    item = F.struct(F.struct(field.alias("Name")).alias("string_map_data"))
    docs = _entries(s, d, item).select("archive", F.struct(F.col("entries").alias("saved_saved_collections")).alias("doc"))
    found = exports.parsed(exports.raw_items(_files(docs, "saved/saved_collections.json"), "saves"), "saves")
    return found.select("media_key", F.array_join(F.array_sort("collections"), ",").alias("collections"))


@query(f"WITH {_ITEM} SELECT CAST(k AS VARCHAR) AS media_key, string_agg(DISTINCT 'Order ' || l_orderkey, ',' ORDER BY 'Order ' || l_orderkey) AS collections, arg_min(author, (l_orderkey, l_linenumber, l_suppkey)) FILTER (NOT bare) AS author_username FROM i GROUP BY k")
def parse_collections_nested(s, d):
    """Nested collections: each order is one, its lines are its media; what an entry holds is found twice and merged."""
    title = F.when(F.col("l_quantity") > 45, "").otherwise(F.concat(F.lit("user"), F.col("l_suppkey").cast("string")))
    item = F.struct(title.alias("title"), F.struct(F.struct(_href(F.col("l_partkey")).alias("href")).alias("Saved on")).alias("string_map_data"))
    group = F.struct(F.concat(F.lit("Order "), F.col("archive").cast("long").cast("string")).alias("title"), F.col("entries").alias("media_list_data"))
    docs = _entries(s, d, item).select("archive", F.struct(F.array(group).alias("saved_saved_collections")).alias("doc"))
    found = exports.parsed(exports.raw_items(_files(docs, "saved/saved_collections.json"), "saves"), "saves")
    return found.select("media_key", F.array_join(F.array_sort("collections"), ",").alias("collections"), "author_username")


@query(f"WITH {_ITEM} SELECT CAST(k AS VARCHAR) AS media_key, CASE WHEN k % 3 = 0 THEN 'reel' ELSE 'post' END AS media_type, arg_min(author, (l_orderkey, l_linenumber, l_suppkey)) AS author_username, CAST(max(sec) AS BIGINT) AS seconds, 'liked_posts' AS source FROM i WHERE flag <> 'R' GROUP BY k")
def parse_likes_buckets(s, d):
    """Buckets of likes: each has its source; liked comments (returned lines here) are recognised and left out."""
    lists = F.array(F.struct(_href(F.col("l_partkey")).alias("href"), F.unix_timestamp("l_shipdate").alias("timestamp")))
    item = F.struct(F.concat(F.lit("user"), F.col("l_suppkey").cast("string")).alias("title"), lists.alias("string_list_data"), F.col("l_returnflag").alias("_flag"))
    rows = _entries(s, d, item)
    some = lambda comment: F.filter("entries", lambda x: (x["_flag"] == "R") if comment else (x["_flag"] != "R"))
    docs = rows.select("archive", F.struct(some(False).alias("likes_media_likes"), some(True).alias("likes_comment_likes")).alias("doc"))
    found = exports.parsed(exports.raw_items(_files(docs, "likes/liked_posts.json", "liked_posts"), "likes"), "likes")
    return found.select("media_key", "media_type", "author_username", F.unix_timestamp("liked_at").alias("seconds"), "source")


@query("""SELECT 'story:user' || user_id || ':' || event_id AS media_key, 'story' AS media_type, CASE WHEN user_id % 2 = 0 THEN 'owner' || user_id ELSE 'user' || user_id END AS author_username, CAST(epoch(date_trunc('second', ts)) AS BIGINT) AS seconds, 'story_likes' AS source FROM events""")
def parse_likes_stories(s, d):
    """Story likes in label values: without an owner the author is the story's user."""
    e = v.read(s, d, "events")
    href = F.concat(F.lit(HOST + "/stories/User"), F.col("user_id").cast("string"), F.lit("/"), F.col("event_id").cast("string"), F.lit("/"))
    values = _labelled(F.concat(F.lit("owner"), F.col("user_id").cast("string")), href)
    entry = F.struct(F.unix_timestamp("ts").alias("timestamp"), F.when(F.col("user_id") % 2 == 0, values).otherwise(F.slice(values, 1, 1)).alias("label_values"))
    docs = e.select(F.lpad(F.col("event_id").cast("string"), 15, "0").alias("archive"), F.array(entry).alias("doc"))
    found = exports.parsed(exports.raw_items(_files(docs, "likes/story_likes.json", "story_likes"), "likes"), "likes")
    return found.select("media_key", "media_type", "author_username", F.unix_timestamp("liked_at").alias("seconds"), "source")


@query("SELECT count(*) FILTER (event_type = 'error') AS warnings, count(*) FILTER (event_type <> 'error') AS items, count(DISTINCT user_id) FILTER (event_type <> 'error') AS media FROM events")
def parse_damaged(s, d):
    """Damaged documents are warnings, not failures; addresses are found wherever they stand."""
    e = v.read(s, d, "events")
    text = F.concat(F.lit('{"a": [{"b": {"HREF": "'), _href(F.col("user_id")), F.lit('"}}, 5, null]}'))
    rows = e.select(F.lpad(F.col("event_id").cast("string"), 15, "0").alias("archive"), F.lit(0).alias("entry_ord"), F.lit("saved/x.json").alias("name"), F.when(F.col("event_type") == "error", F.lit('{"a": [')).otherwise(text).cast("binary").alias("content"), F.lit(None).cast("string").alias("source"))
    raw = exports.raw_items(rows, "saves")
    return raw.agg(F.count("warning").alias("warnings"), F.count_if(F.col("warning").isNull()).alias("items")).crossJoin(exports.parsed(raw, "saves").agg(F.count("*").alias("media")))  # one row each


@query("""WITH RECURSIVE t AS (SELECT user_id AS job, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r, event_id AS seq, CAST(epoch_ms(ts) // 100000 AS BIGINT) AS ms, CASE WHEN event_type = 'error' THEN 'failed' WHEN event_type = 'purchase' THEN 'store' ELSE 'embed' END AS phase, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) * 7 AS processed FROM events),
w AS (SELECT job, r, seq, ms, phase, processed, true AS told, ms AS last_at, processed AS last_n, phase AS last_phase FROM t WHERE r = 1
UNION ALL SELECT job, r, seq, ms, phase, processed, told, CASE WHEN told THEN ms ELSE last_at END, CASE WHEN told THEN processed ELSE last_n END, CASE WHEN told THEN phase ELSE last_phase END
FROM (SELECT t.*, t.phase = 'failed' OR t.phase <> w.last_phase OR t.processed - w.last_n >= 50 OR t.ms - w.last_at >= 1000 AS told, w.last_at, w.last_n, w.last_phase FROM w JOIN t ON t.job = w.job AND t.r = w.r + 1))
SELECT job AS job_id, seq, phase, processed FROM w WHERE told""")
def throttled_ticks(s, d):
    """Progress ticks of a job, each held against the last one that was published."""
    e = v.read(s, d, "events")
    phase = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "purchase", "store").otherwise("embed")
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).cast("long") * 7
    ticks = e.select(F.col("user_id").alias("job_id"), F.col("event_id").alias("seq"), F.floor(F.unix_millis(F.col("ts").cast("timestamp")) / 100_000).alias("at_ms"), phase.alias("phase"), n.alias("processed"), F.lit(1_000_000_000).cast("long").alias("total"))
    at = scratch(s)
    ticks.write.parquet(f"{at}/in")
    told = feed.throttled(s.readStream.schema(feed.SHAPE).parquet(f"{at}/in"))
    stream = told.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start()
    stream.awaitTermination()
    return s.read.parquet(f"{at}/out").select("job_id", "seq", "phase", "processed")
