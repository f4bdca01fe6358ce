"""Schema catalogs, import logs, verified copies and orders of names."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from archivist.functions import sorting
from archivist.operators import import_log as log
from archivist.plans import views as v
from archivist.sources import schema_infer as si
from archivist.sources import verified_copy as vc
from archivist.sources.store import Store, scratch
from archivist.streaming import jobs

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _files(s, d):
    """Each event is an import of one file, named by its type: some have a user, some are damaged."""
    e = v.read(s, d, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    user = F.when(F.col("user_id") % 3 == 0, F.concat(F.lit("u"), F.col("user_id").cast("string")))
    value = F.to_json(F.struct(F.struct(k.alias("k")).alias("p"), user.alias("user"), F.array(F.col("user_id"), k).alias("pair")))
    content = F.when((F.col("event_type") == "error") & (F.col("user_id") % 5 == 0), F.lit("{")).otherwise(value)
    files = e.select(F.col("event_id").alias("import_id"), F.col("event_type").alias("name"), content.cast("binary").alias("content"))
    return files.repartition(4 * s.sparkContext.defaultParallelism)  # the table's few small files would be as few tasks


def _event_imports(s, d):
    return v.read(s, d, "events").select(F.col("event_id").alias("id"), F.concat(F.lit("export-"), F.col("user_id").cast("string")).alias("filename"), F.col("ts").alias("imported_at"), F.lit("completed").alias("status"))


_EVENT_FILES = "f AS (SELECT event_id, event_type, user_id, CAST(props->>'k' AS INTEGER) AS k, event_type = 'error' AND user_id % 5 = 0 AS bad, user_id % 3 = 0 AS named FROM events)"


@query(f"""WITH {_EVENT_FILES} SELECT event_type AS file_path, count(*) AS imports, false AS truncated_read, 'object' AS top_level_type, CASE WHEN bool_or(bad) THEN 'JSONDecodeError' END AS parse_error,
CAST(arg_max(k, event_id) FILTER (NOT bad) AS VARCHAR) AS k_sample, CASE WHEN bool_or(named AND NOT bad) AND bool_or(NOT named AND NOT bad) THEN 'true' END AS user_optional,
CASE WHEN bool_or(named AND NOT bad) THEN 'string' END AS user_type, CASE WHEN bool_or(NOT bad) THEN '2' END AS longest FROM f GROUP BY 1""")
def schema_catalog_files(s, d):
    files = si.merged_schemas(si.schemas(_files(s, d)), _event_imports(s, d))
    tree = lambda path: F.get_json_object("schema_json", path)
    return files.select("file_path", "imports", "truncated_read", "top_level_type", "parse_error", tree("$.keys.p.keys.k.sample").alias("k_sample"), tree("$.keys.user.optional").alias("user_optional"), tree("$.keys.user.type[0]").alias("user_type"), tree("$.keys.pair.arrayLength.max").alias("longest"))


@query("""SELECT id, count(x.id2) AS schema_files, count(x.id2) > 0 AS has_schemas FROM (SELECT DISTINCT year(o_orderdate) * 100 + month(o_orderdate) AS id FROM orders)
LEFT JOIN (SELECT year(l_shipdate) * 100 + month(l_shipdate) AS id2 FROM lineitem) x ON x.id2 = id GROUP BY id""")
def schema_options(s, d):
    """Months of orders are imports, line items shipped then their files."""
    month = lambda c: (F.year(c) * 100 + F.month(c)).cast("long")
    imports = v.read(s, d, "orders").groupBy(month("o_orderdate").alias("id")).agg(F.min("o_orderdate").alias("imported_at")).withColumns({"filename": F.col("id").cast("string"), "status": F.lit("completed")})
    found = v.read(s, d, "lineitem").select(month("l_shipdate").alias("import_id"))
    return si.options(imports, found).select("id", "schema_files", "has_schemas")


@query("""SELECT count(*) AS files, count(*) FILTER (parse_error IS NOT NULL) AS broken, count(*) FILTER (parse_error = 'Invalid stored schema_json') AS invalid FROM
(SELECT CASE WHEN user_id % 7 = 0 THEN 'Invalid stored schema_json' WHEN event_type = 'error' AND user_id % 5 = 0 THEN 'JSONDecodeError' END AS parse_error FROM events)""")
def schema_rows_readable(s, d):
    """Stored trees that were damaged become errors of their rows."""
    found = si.schemas(_files(s, d)).join(v.read(s, d, "events").select(F.col("event_id").alias("import_id"), "user_id"), "import_id")
    damaged = found.withColumn("schema_json", F.when(F.col("user_id") % 7 == 0, F.lit("{x")).otherwise(F.col("schema_json")))
    return si.readable(damaged).agg(F.count("*").alias("files"), F.count("parse_error").alias("broken"), F.count_if(F.col("parse_error") == si.INVALID).alias("invalid"))


def _logged(s, d):
    """Days are imports: events with an even user are saves, the others likes; errors are warnings of the day."""
    e = v.read(s, d, "events")
    kind = F.when(F.col("event_type") == "click", "post").when(F.col("event_type") == "view", "reel").when(F.col("event_type") == "signup", "igtv").otherwise("unknown")
    at = F.when(F.col("user_id") % 7 != 0, F.col("ts"))
    items = e.select(F.dayofmonth("ts").cast("long").alias("import_id"), kind.alias("media_type"), F.when(F.col("user_id") % 4 != 0, F.col("event_type")).otherwise("").alias("author_username"), at.alias("saved_at"), at.alias("liked_at"), F.array(F.concat(F.lit(" "), F.col("event_type")), F.lit("")).alias("collections"), (F.col("user_id") % 2 == 0).alias("even"), "event_type", "event_id")
    files = items.select("import_id", F.concat(F.lit("file-"), F.col("event_type")).alias("name"), F.when(F.col("event_type") == "click", "saves").when(F.col("event_type") == "view", "likes").alias("library")).distinct()
    warnings = items.filter("event_type = 'error'").select("import_id", F.concat(F.lit("file-"), F.col("event_id").cast("string"), F.lit(": damaged")).alias("warning"))
    return log.logs(files, items.filter("even"), items.filter("not even"), warnings)


@query("""SELECT CAST(day(ts) AS BIGINT) AS import_id, count(DISTINCT event_type) AS files, count(*) FILTER (user_id % 2 = 0) AS items, count(*) FILTER (user_id % 2 = 1) AS likes,
count(*) FILTER (user_id % 2 = 0 AND event_type = 'view') AS reels, count(*) FILTER (user_id % 2 = 1 AND event_type = 'click') AS liked_posts, count(*) FILTER (user_id % 2 = 0 AND user_id % 4 <> 0) AS authors,
count(*) FILTER (user_id % 2 = 1 AND user_id % 4 <> 0) AS likes_authors, count(*) FILTER (user_id % 2 = 0 AND user_id % 7 <> 0) AS timed, string_agg(DISTINCT event_type, ',' ORDER BY event_type) FILTER (user_id % 2 = 0) AS collections,
count(*) FILTER (event_type = 'error') AS warnings FROM events GROUP BY 1""")
def import_log_counts(s, d):
    got = _logged(s, d).select("import_id", log.decoded(F.col("notes")).alias("l"))
    return got.select("import_id", F.col("l.filesScanned").alias("files"), F.col("l.itemsParsed").alias("items"), F.col("l.likesParsed").alias("likes"), F.col("l.typeCounts.reel").alias("reels"), F.col("l.likeTypeCounts.post").alias("liked_posts"), F.col("l.authorsFound").alias("authors"), F.col("l.likesAuthorsFound").alias("likes_authors"), F.col("l.itemsWithSavedAt").alias("timed"), F.array_join("l.collectionsFound", ",").alias("collections"), F.size("l.warnings").cast("long").alias("warnings"))


@query("""SELECT event_id, CASE WHEN user_id % 5 = 0 THEN NULL ELSE k + 1 END AS likes, CASE WHEN user_id % 5 = 0 THEN NULL WHEN k % 2 = 0 THEN k ELSE 0 END AS added, CASE WHEN user_id % 5 = 0 THEN NULL WHEN k % 2 = 0 THEN 1 ELSE 0 END AS updated,
CASE WHEN user_id % 5 = 0 THEN NULL ELSE 0 END AS files FROM (SELECT event_id, user_id, CAST(props->>'k' AS BIGINT) AS k FROM events)""")
def import_log_recovered(s, d):
    """Logs of an older form: what became of likes is told in a warning, some logs are no JSON or have no number of files."""
    k = F.get_json_object("props", "$.k").cast("long")
    told = F.when(k % 2 == 0, F.array(F.lit("x"), F.concat(F.lit("Likes: "), k.cast("string"), F.lit(" added, 1 updated, 0 unchanged.")))).otherwise(F.array(F.lit("x")))
    notes = F.to_json(F.struct(F.lit(0).alias("filesScanned"), (k + 1).alias("likesParsed"), told.alias("warnings")))
    bad = F.when(F.col("event_id") % 2 == 0, F.lit("{not json")).otherwise(F.lit('{"filesScanned": "3"}'))
    rows = v.read(s, d, "events").select("event_id", log.decoded(F.when(F.col("user_id") % 5 == 0, bad).otherwise(notes)).alias("l"))
    return rows.select("event_id", F.col("l.likesParsed").alias("likes"), F.col("l.likesAdded").alias("added"), F.col("l.likesUpdated").alias("updated"), F.col("l.filesScanned").alias("files"))


_TABLES = {"nation": (["n_nationkey"], {}), "customer": (["c_custkey"], {"c_custkey": "text"}), "orders": (["o_orderkey"], {"o_orderdate": "seconds"}), "labels": (["doc_id"], {}), "embeddings": (["vec_id"], {"embedding": "list"}), "lineitem": (["l_orderkey", "l_linenumber"], {"l_shipdate": "seconds"})}


@query("SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{t}' AS \"table\", count(*) AS rows FROM {t}" for t in _TABLES) + ")")
def copy_row_totals(s, d):
    """Tables are copied into another store with types converted, verified and published."""
    source, target = Store(s, scratch(s)), Store(s, scratch(s))
    source.publish({t: source.stage(t, v.read(s, d, t)) for t in _TABLES})
    return vc.copy_store(source, target, _TABLES)


@query("""SELECT o_orderkey, what FROM (SELECT max(o_orderkey) AS o_orderkey, 'changed' AS what FROM orders UNION ALL SELECT min(o_orderkey), 'missing' FROM orders UNION ALL SELECT -1 - max(o_orderkey), 'added' FROM orders)""")
def copy_changes_located(s, d):
    """One order of a copy was changed, one is gone, one is new."""
    o = v.read(s, d, "orders")
    ends = o.agg(F.max("o_orderkey").alias("_max"), F.min("o_orderkey").alias("_min"))
    with_ends = o.crossJoin(F.broadcast(ends))  # one row
    copy = with_ends.filter("o_orderkey <> _min").withColumn("o_totalprice", F.when(F.col("o_orderkey") == F.col("_max"), F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")))
    new = with_ends.filter("o_orderkey = _max").withColumn("o_orderkey", -1 - F.col("_max"))
    return vc.changed_keys(o, copy.unionByName(new).select(*o.columns), ["o_orderkey"])


_NODES = """p AS (SELECT list_filter(string_split(regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', ''), '/'), lambda x: x <> '') AS p FROM pages),
n AS (SELECT array_to_string(p[1:k], '/') AS path, CASE WHEN k = len(p) THEN 'file' ELSE 'folder' END AS kind, k AS depth FROM (SELECT p, unnest(range(1, len(p) + 1)) AS k FROM p)),
g AS (SELECT path, kind, CAST(depth AS INTEGER) AS depth, count(*) AS files, regexp_extract(path, '^(.*)/[^/]*$', 1) AS parent, regexp_extract(path, '([^/]*)$', 1) AS name FROM n GROUP BY path, kind, depth)"""


def _tree(s, d):
    return sorting.tree_nodes(v.read(s, d, "pages").select(F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", "").alias("file_path")))


@query(f"WITH {_NODES} SELECT path, parent, name, kind, depth, files, CAST(row_number() OVER (PARTITION BY parent ORDER BY kind = 'file', name) AS INTEGER) AS place FROM g")
def tree_locale_order(s, d):
    return sorting.tree_order(_tree(s, d))


@query(f"""WITH {_NODES} SELECT path, parent, name, kind, depth, files, CAST(row_number() OVER (PARTITION BY parent ORDER BY kind = 'file',
list_transform(regexp_extract_all(lower(name), '([0-9]+|[^0-9]+)'), lambda r: CASE WHEN regexp_matches(r, '^[0-9]') THEN '0' || lpad(CAST(len(ltrim(r, '0')) AS VARCHAR), 5, '0') || ltrim(r, '0') ELSE r END), name) AS INTEGER) AS place FROM g""")
def tree_natural_order(s, d):
    return sorting.tree_order(_tree(s, d), natural=True)


def _jobs(s, d):
    """Orders are jobs: finished, open or in work."""
    state = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "pending").otherwise("running")
    return v.read(s, d, "orders").select(F.col("o_orderkey").alias("job_id"), state.alias("state"))


_JOBS = "j AS (SELECT o_orderkey AS job_id, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'pending' ELSE 'running' END AS state FROM orders)"


@query(f"WITH {_JOBS} SELECT * FROM (SELECT 'listed' AS list, job_id, state FROM (SELECT * FROM j ORDER BY job_id DESC LIMIT 50 OFFSET 20) UNION ALL SELECT 'recent', job_id, state FROM (SELECT * FROM j WHERE state = 'completed' ORDER BY job_id DESC LIMIT 8))")
def jobs_listed(s, d):
    named = lambda name, df: df.select(F.lit(name).alias("list"), "job_id", "state")
    return named("listed", jobs.listed(_jobs(s, d), offset=20)).unionByName(named("recent", jobs.recent(_jobs(s, d))))


@query(f"WITH {_JOBS} SELECT job_id, CAST(row_number() OVER (PARTITION BY month ORDER BY job_id) AS INTEGER) AS place FROM (SELECT j.*, month(o_orderdate) AS month FROM j JOIN orders ON o_orderkey = job_id) WHERE state = 'pending'")
def jobs_waiting(s, d):
    """The queues of each month, first come first served."""
    month = v.read(s, d, "orders").select(F.col("o_orderkey").alias("job_id"), F.month("o_orderdate").alias("month"))
    rows = jobs.waiting(_jobs(s, d)).join(month, "job_id")
    return rows.select("job_id", F.row_number().over(Window.partitionBy("month").orderBy("job_id")).alias("place"))
