"""Identity, merges, accounting, rollback and integrity."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from archivist.functions import identity as i
from archivist.operators import merge as m
from archivist.operators.catalog import coverage
from archivist.plans import views as v

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query("SELECT page_id, lower(regexp_extract(url, '^[a-zA-Z]+://([^/:?#]+)', 1)) || regexp_replace(regexp_extract(url, '^[a-zA-Z]+://[^/?#]+([^?#]*)', 1), '/+$', '') AS media_key FROM pages")
def url_media_key(s, d):
    return v.read(s, d, "pages").select("page_id", i.media_key(F.col("url")).alias("media_key"))


@query("SELECT page_id, CASE WHEN contains(lower(url), '/reel/') OR contains(lower(url), '/reels/') THEN 'reel' WHEN contains(lower(url), '/tv/') THEN 'igtv' WHEN contains(lower(url), '/p/') THEN 'post' ELSE 'unknown' END AS media_type FROM pages")
def media_type_case(s, d):
    return v.read(s, d, "pages").select("page_id", i.media_type(F.col("url")).alias("media_type"))


@query("""SELECT CAST(user_id AS VARCHAR) AS media_key, arg_min(event_type, event_id) AS media_type, arg_min(event_type, event_id) FILTER (WHERE event_type <> 'error') AS author_username, max(value) AS at,
(SELECT string_agg(t, ',' ORDER BY o) FROM (SELECT event_type AS t, min(event_id) AS o FROM events b WHERE b.user_id = a.user_id GROUP BY 1)) AS collections FROM events a GROUP BY user_id""")
def dedup_first_max(s, d):
    e = v.read(s, d, "events")
    rows = e.select(F.col("user_id").cast("string").alias("media_key"), F.col("event_type").alias("media_type"), F.when(F.col("event_type") != "error", F.col("event_type")).otherwise("").alias("author_username"), F.col("value").alias("at"), F.array("event_type").alias("collections"), "event_id")
    return m.merge_batch(rows, "at", ["event_id"], first=("media_type",)).select("media_key", "media_type", "author_username", "at", F.array_join("collections", ",").alias("collections"))


@query("""SELECT event_id, (SELECT max_by(b.event_id, b.event_id) FROM events b WHERE b.user_id = a.user_id AND b.event_type = 'signup' AND b.event_id <= a.event_id) AS header FROM events a WHERE event_type <> 'signup'""")
def carry_forward(s, d):
    w = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    header = F.last(F.when(F.col("event_type") == "signup", F.col("event_id")), ignorenulls=True).over(w)
    return v.read(s, d, "events").select("event_id", "user_id", "event_type").withColumn("header", header).filter("event_type <> 'signup'").select("event_id", "header")


@query("SELECT doc_id, sha256(text) AS content_hash, doc_id > min(doc_id) OVER (PARTITION BY text) AS duplicate FROM documents")
def content_hash_dups(s, d):
    return m.duplicate_contents(v.read(s, d, "documents").select("doc_id", "text"), "text", "doc_id").select("doc_id", "content_hash", "duplicate")


def _items(s, d):
    """Line items as media; _file and _row tell which of equal numbers stands first in the table."""
    stands = [F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_row")]
    rows = v.read(s, d, "lineitem").select(*stands, F.col("l_partkey").cast("string").alias("media_key"), F.concat(F.lit("h"), F.col("l_suppkey").cast("string")).alias("href"), F.col("l_returnflag").alias("media_type"), F.col("l_linestatus").alias("author_username"), F.col("l_shipdate").alias("at"), "l_orderkey", "l_linenumber")
    return rows.withColumn("media_type", F.when(F.col("media_type") == "N", "unknown").otherwise(F.col("media_type"))).withColumn("shortcode", F.col("media_key")).withColumn("collections", F.array("media_type"))


def _merge(early, late):
    order = ["l_orderkey", "l_linenumber", "_file", "_row"]
    stored = m.merge_batch(early, "at", order).withColumns({"first_seen_import_id": F.lit(1).cast("long"), "last_seen_import_id": F.lit(1).cast("long")})
    return m.merge_state(stored, m.merge_batch(late, "at", order), 2, "at")


def _state(s, d):
    """Line items of some orders are stored, those of others come in."""
    rows = _items(s, d)
    return _merge(rows.filter(F.col("l_orderkey") % 32 == 1), rows.filter(F.col("l_orderkey") % 64 == 0))


def _whole_state(s, d):
    """Line items shipped before 1996 are stored, all others come in."""
    rows, early = _items(s, d), F.coalesce(F.year("at") < 1996, F.lit(False))
    return _merge(rows.filter(early), rows.filter(~early))


_BATCH = """{n} AS (SELECT l_partkey AS k, arg_min('h' || l_suppkey, (l_orderkey, l_linenumber)) AS href, arg_min(CASE WHEN l_returnflag = 'N' THEN 'unknown' ELSE l_returnflag END, (l_orderkey, l_linenumber)) AS kind,
arg_min(l_linestatus, (l_orderkey, l_linenumber)) AS author, max(l_shipdate) AS at, list_sort(list(DISTINCT CASE WHEN l_returnflag = 'N' THEN 'unknown' ELSE l_returnflag END)) AS lists FROM lineitem WHERE l_orderkey % {w} GROUP BY 1)"""
_MERGED = f"""WITH {_BATCH.format(n='a', w='32 = 1')}, {_BATCH.format(n='b', w='64 = 0')},
merged AS (SELECT CAST(coalesce(a.k, b.k) AS VARCHAR) AS media_key, coalesce(b.href, a.href) AS href, CASE WHEN b.k IS NOT NULL AND (a.k IS NULL OR b.kind <> 'unknown') THEN b.kind ELSE a.kind END AS media_type,
coalesce(b.author, a.author) AS author_username, CASE WHEN a.k IS NULL THEN 2 ELSE 1 END AS first_seen, CASE WHEN b.k IS NOT NULL THEN 2 ELSE 1 END AS last_seen,
CASE WHEN b.k IS NULL THEN 'kept' WHEN a.k IS NULL THEN 'added' WHEN b.author <> a.author OR (b.kind <> 'unknown' AND b.kind <> a.kind) OR b.href <> a.href OR b.at > a.at OR NOT list_has_all(a.lists, b.lists) THEN 'updated' ELSE 'skipped' END AS outcome
FROM a FULL OUTER JOIN b ON a.k = b.k) """


@query(_MERGED + "SELECT media_key, href, media_type, author_username, outcome FROM merged")
def merge_outcomes(s, d):
    return _state(s, d).select("media_key", "href", "media_type", "author_username", "outcome")


@query(_MERGED + "SELECT count(*) FILTER (WHERE first_seen = 2) AS added, greatest(0, count(*) FILTER (WHERE last_seen = 2) - count(*) FILTER (WHERE first_seen = 2)) AS updated FROM merged")
def import_accounting(s, d):
    return m.accounting(_state(s, d), 2)


@query(_MERGED + "SELECT outcome, count(*) AS items FROM merged GROUP BY 1")
def merge_outcome_counts(s, d):
    return _state(s, d).groupBy("outcome").agg(F.count("*").alias("items"))


_WHOLE = _MERGED.replace("l_orderkey % 32 = 1", "coalesce(year(l_shipdate) < 1996, false)").replace("l_orderkey % 64 = 0", "NOT coalesce(year(l_shipdate) < 1996, false)")


@query(_WHOLE + "SELECT media_key, href, media_type, author_username, outcome FROM merged")
def merge_outcomes_whole(s, d):
    return _whole_state(s, d).select("media_key", "href", "media_type", "author_username", "outcome")


@query(_WHOLE + "SELECT count(*) FILTER (WHERE first_seen = 2) AS added, greatest(0, count(*) FILTER (WHERE last_seen = 2) - count(*) FILTER (WHERE first_seen = 2)) AS updated FROM merged")
def import_accounting_whole(s, d):
    return m.accounting(_whole_state(s, d), 2)


@query(_WHOLE + "SELECT outcome, count(*) AS items FROM merged GROUP BY 1")
def merge_outcome_counts_whole(s, d):
    return _whole_state(s, d).groupBy("outcome").agg(F.count("*").alias("items"))


def _members(s, d):
    """Memberships first seen by import 2 where the part's key is even."""
    seen = F.when(F.col("media_id") % 2 == 0, 2).otherwise(1).cast("long")
    return [x.withColumn("first_seen_import_id", seen) for x in (v.saved(s, d), v.liked(s, d).withColumn("media_id", F.col("media_id")))]


@query(v.SQL + """, gone AS (SELECT media_id FROM saved WHERE media_id % 2 = 0 UNION SELECT media_id FROM liked WHERE media_id % 2 = 0)
SELECT (SELECT count(*) FROM saved WHERE media_id % 2 = 1) AS saved, (SELECT count(*) FROM liked WHERE media_id % 2 = 1) AS liked, (SELECT count(*) FROM media WHERE id NOT IN (SELECT media_id FROM gone)) AS media,
(SELECT count(*) FROM item_collections WHERE NOT EXISTS (SELECT 1 FROM saved WHERE media_id = item_id AND media_id % 2 = 0)) AS collections""")
def rollback_orphans(s, d):
    a, b = _members(s, d)
    left = m.rollback(v.media(s, d), a, b, v.item_collections(s, d), 2)
    counts = [left[k].agg(F.count("*").alias(n)) for k, n in (("saved", "saved"), ("liked", "liked"), ("media", "media"), ("item_collections", "collections"))]
    out = counts[0]
    for c in counts[1:]:
        out = out.crossJoin(c)  # one row each
    return out


@query("""SELECT (SELECT count(*) FROM supplier WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_nationkey = s_nationkey AND c_acctbal > 9900)) AS suppliers,
(SELECT count(*) FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)) AS customers, (SELECT count(*) FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_returnflag = 'R' AND l_quantity > 48)) AS parts,
(SELECT count(*) FROM labels WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = labels.doc_id)) AS labels""")
def integrity_orphans(s, d):
    t = lambda n: v.read(s, d, n)
    pairs = [("suppliers", t("supplier"), "s_nationkey", t("customer").filter("c_acctbal > 9900"), "c_nationkey"), ("customers", t("customer"), "c_custkey", t("orders"), "o_custkey"), ("parts", t("part"), "p_partkey", t("lineitem").filter("l_returnflag = 'R' and l_quantity > 48"), "l_partkey"), ("labels", t("labels"), "doc_id", t("documents"), "doc_id")]
    out = None
    for name, child, key, parent, parent_key in pairs:
        n = m.orphans(child, key, parent, parent_key).agg(F.count("*").alias(name))
        out = n if out is None else out.crossJoin(n)  # one row each
    return out


@query("SELECT CAST(props->>'k' AS INTEGER) AS k, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1")
def json_extract_group(s, d):
    return v.read(s, d, "events").groupBy(F.get_json_object("props", "$.k").cast("int").alias("k")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("""SELECT i.month, i.orders, coalesce(f.files, 0) AS files FROM (SELECT month(o_orderdate) AS month, count(*) AS orders FROM orders GROUP BY 1) i
LEFT JOIN (SELECT month(l_shipdate) AS month, count(*) AS files FROM lineitem WHERE l_quantity > 49 AND month(l_shipdate) <> 2 GROUP BY 1) f ON i.month = f.month""")
def import_schema_counts(s, d):
    orders = v.read(s, d, "orders").groupBy(F.month("o_orderdate").alias("month")).agg(F.count("*").alias("orders"))
    files = v.read(s, d, "lineitem").filter("l_quantity > 49").groupBy(F.month("l_shipdate").alias("month")).agg(F.count("*").alias("files")).filter("month <> 2")
    return orders.join(files, "month", "left").select("month", "orders", F.coalesce("files", F.lit(0)).alias("files"))


@query("""SELECT o_orderpriority AS job, CASE WHEN count(*) = 0 THEN 0 ELSE least(100.0, round(count(*) FILTER (WHERE o_orderstatus = 'F') * 100.0 / count(*), 1)) END AS percent FROM orders GROUP BY 1""")
def progress_percent(s, d):
    g = v.read(s, d, "orders").groupBy(F.col("o_orderpriority").alias("job")).agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("f"))
    return g.select("job", coverage(F.col("f"), F.col("n")).alias("percent"))


@query("SELECT * FROM (SELECT 'customer' AS kind, c_custkey AS id FROM customer WHERE c_acctbal < -900 UNION ALL SELECT 'supplier', s_suppkey FROM supplier WHERE s_acctbal < 0)")
def busy_union(s, d):
    a = v.read(s, d, "customer").filter("c_acctbal < -900").select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("id"))
    b = v.read(s, d, "supplier").filter("s_acctbal < 0").select(F.lit("supplier").alias("kind"), F.col("s_suppkey").alias("id"))
    return a.unionByName(b).orderBy("id")
