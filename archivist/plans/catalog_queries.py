"""Statistics, browsing, facets and history."""

from __future__ import annotations

from pyspark.sql import functions as F

from archivist.operators import catalog as c
from archivist.plans import views as v

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = v.SQL + sql
        return f

    return add


def _kinds(s, d) -> list[str]:
    """Two media types that the table has."""
    got = v.media(s, d).select("media_type").distinct().orderBy("media_type").limit(2).collect()
    return [r[0] for r in got]


def _saved(s, d):
    return c.items(v.media(s, d), v.saved(s, d))


def _liked(s, d):
    return c.items(v.media(s, d), v.liked(s, d))


def _shown(df, at="saved_at"):
    return df.select("id", "media_type", "author_username", F.date_format(at, "yyyy-MM-dd").alias(at))


_STATS = """, kinds AS (SELECT min(media_type) AS a, (SELECT min(media_type) FROM media WHERE media_type > (SELECT min(media_type) FROM media)) AS b FROM media)
SELECT count(*) AS total, count(DISTINCT author_username) AS authors, CAST(coalesce(sum(CASE WHEN media_type = a THEN 1 ELSE 0 END), 0) AS BIGINT) AS posts, CAST(coalesce(sum(CASE WHEN media_type = b THEN 1 ELSE 0 END), 0) AS BIGINT) AS reels FROM {t} JOIN media ON media_id = id, kinds"""


@query(_STATS.format(t="saved"))
def stats_saved(s, d):
    return c.stats(_saved(s, d), dict(zip(("posts", "reels"), _kinds(s, d), strict=False)))


@query(_STATS.format(t="liked"))
def stats_liked(s, d):
    return c.stats(_liked(s, d), dict(zip(("posts", "reels"), _kinds(s, d), strict=False)))


@query("SELECT author_username AS name, count(*) AS count FROM saved JOIN media ON media_id = id GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def top_authors_saved(s, d):
    return c.top(_saved(s, d), "author_username", 10)


@query("SELECT author_username AS name, count(*) AS count FROM liked JOIN media ON media_id = id GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def top_authors_liked(s, d):
    return c.top(_liked(s, d), "author_username", 10)


@query("SELECT collection_name AS name, count(*) AS count FROM item_collections SEMI JOIN saved ON item_id = media_id GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 12")
def top_collections(s, d):
    inside = v.item_collections(s, d).join(v.saved(s, d).select(F.col("media_id").alias("item_id")), "item_id", "left_semi")
    return c.top(inside, "collection_name", 12)


@query("SELECT id, items_found FROM imports ORDER BY id DESC LIMIT 5")
def recent_imports(s, d):
    return v.imports(s, d).select("id", "items_found").orderBy(F.desc("id")).limit(5)


@query("SELECT id, items_found, items_added, greatest(0, items_found - items_added) AS items_updated FROM imports")
def import_history(s, d):
    return v.imports(s, d).withColumn("items_updated", F.greatest(F.lit(0).cast("long"), F.col("items_found") - F.col("items_added"))).orderBy(F.desc("id"))


@query("SELECT DISTINCT author_username AS value FROM saved JOIN media ON media_id = id WHERE author_username <> ''")
def facets_authors(s, d):
    return c.facet(_saved(s, d), "author_username")


@query("SELECT DISTINCT collection_name AS value FROM item_collections")
def facets_collections(s, d):
    return c.facet(v.item_collections(s, d), "collection_name")


_PAGE = "strftime({at}, '%Y-%m-%d') AS {at} FROM {t} JOIN media ON media_id = id {w} ORDER BY {t}.{at} DESC NULLS LAST, id DESC LIMIT 25 {o}"


def _page(t: str, at: str, w: str = "", o: str = "") -> str:
    return "SELECT id, media_type, author_username, " + _PAGE.format(t=t, at=at, w=w, o=o)


@query(_page("saved", "saved_at"))
def browse_default(s, d):
    return _shown(c.page(_saved(s, d), c.browse_order("saved_at"), 1, 25))


@query(_page("liked", "liked_at", o="OFFSET 25"))
def browse_likes_second_page(s, d):
    return _shown(c.page(_liked(s, d), c.browse_order("liked_at"), 2, 25), "liked_at")


@query(_page("saved", "saved_at", "WHERE media_type = (SELECT min(media_type) FROM media)"))
def browse_by_type(s, d):
    return _shown(c.page(c.filtered(_saved(s, d), c.Browse(type=_kinds(s, d)[0])), c.browse_order("saved_at"), 1, 25))


@query(_page("saved", "saved_at", "WHERE author_username = 'Brand#23'"))
def browse_by_author(s, d):
    return _shown(c.page(c.filtered(_saved(s, d), c.Browse(author="Brand#23")), c.browse_order("saved_at"), 1, 25))


@query(_page("saved", "saved_at", "WHERE EXISTS (SELECT 1 FROM item_collections WHERE item_id = id AND collection_name = 'NATION_0')"))
def browse_by_collection(s, d):
    return _shown(c.page(c.filtered(_saved(s, d), c.Browse(collection="NATION_0"), collections=v.item_collections(s, d)), c.browse_order("saved_at"), 1, 25))


@query(_page("saved", "saved_at", "WHERE EXISTS (SELECT 1 FROM liked k WHERE k.media_id = id)"))
def browse_overlap(s, d):
    return _shown(c.page(c.filtered(_saved(s, d), c.Browse(membership="both"), others=v.liked(s, d)), c.browse_order("saved_at"), 1, 25))


@query("SELECT id, EXISTS (SELECT 1 FROM liked k WHERE k.media_id = id) AS is_liked FROM saved JOIN media ON media_id = id")
def browse_membership_flag(s, d):
    return c.flagged(_saved(s, d), v.liked(s, d), "id", "media_id", "is_liked").select("id", "is_liked")


@query(_page("saved", "saved_at", "WHERE author_username ILIKE '%brand#1%' OR name ILIKE '%brand#1%' OR media_key ILIKE '%brand#1%'"))
def browse_like_fallback(s, d):
    return _shown(c.page(c.filtered(_saved(s, d), c.Browse(q="brand#1")), c.browse_order("saved_at"), 1, 25))


@query("""SELECT id, coalesce((SELECT string_agg(collection_name, '|' ORDER BY collection_name) FROM item_collections WHERE item_id = id), '') AS collections
FROM saved JOIN media ON media_id = id ORDER BY saved.saved_at DESC NULLS LAST, id DESC LIMIT 25""")
def browse_with_collections(s, d):
    page = c.page(_saved(s, d), c.browse_order("saved_at"), 1, 25)
    return c.with_collections(page, v.item_collections(s, d)).select("id", F.array_join("collections", "|").alias("collections"))


@query("SELECT count(*) AS total, CAST(ceil(count(*) / 25.0) AS BIGINT) AS total_pages FROM saved")
def browse_page_count(s, d):
    return c.page_count(v.saved(s, d), 25)


@query("""SELECT id, author_username, rank FROM (SELECT p_partkey AS rid, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS rank FROM part) r
JOIN media ON rid = id SEMI JOIN saved ON media_id = id WHERE rank <= 200 ORDER BY rank LIMIT 25""")
def browse_ranked(s, d):
    best = v.read(s, d, "part").orderBy(F.desc("p_retailprice"), "p_partkey").limit(200)
    from archivist.operators.vectors import ranked

    hits = ranked(best.select(F.col("p_partkey").alias("id"), "p_retailprice"), F.desc("p_retailprice"), F.asc("id"))
    return c.page(c.filtered(_saved(s, d), c.Browse(), ranked=hits), [F.asc("rank")], 1, 25).select("id", "author_username", F.col("rank").cast("long").alias("rank"))


@query("""SELECT (SELECT count(*) FROM saved) AS saves, (SELECT count(*) FROM liked) AS likes, (SELECT count(*) FROM saved SEMI JOIN liked USING (media_id)) AS overlap,
(SELECT count(*) FROM saved ANTI JOIN liked USING (media_id)) AS only_saved, (SELECT count(*) FROM media WHERE id NOT IN (SELECT media_id FROM saved) AND id NOT IN (SELECT media_id FROM liked)) AS neither""")
def overview_counts(s, d):
    a = v.saved(s, d).select(F.col("media_id").alias("id"), F.lit(1).alias("s"))
    b = v.liked(s, d).select(F.col("media_id").alias("id"), F.lit(1).alias("l"))
    both = v.media(s, d).select("id").join(a, "id", "left").join(b, "id", "left")
    has_s, has_l = F.col("s").isNotNull(), F.col("l").isNotNull()
    return both.agg(F.count_if(has_s).alias("saves"), F.count_if(has_l).alias("likes"), F.count_if(has_s & has_l).alias("overlap"), F.count_if(has_s & ~has_l).alias("only_saved"), F.count_if(~has_s & ~has_l).alias("neither"))


@query("""SELECT (SELECT count(*) FROM saved) AS total_items, (SELECT count(*) FROM saved JOIN media ON id = media_id WHERE starts_with(media_type, 'PROMO')) AS posts, (SELECT count(*) FROM saved JOIN media ON id = media_id WHERE starts_with(media_type, 'ECONOMY')) AS reels,
(SELECT count(DISTINCT author_username) FROM saved JOIN media ON id = media_id) AS authors, (SELECT count(*) FROM liked) AS total_likes, (SELECT count(*) FROM liked JOIN media ON id = media_id WHERE starts_with(media_type, 'PROMO')) AS liked_posts,
(SELECT count(*) FROM liked JOIN media ON id = media_id WHERE starts_with(media_type, 'ECONOMY')) AS liked_reels, (SELECT count(*) FROM liked JOIN media ON id = media_id WHERE starts_with(media_type, 'STANDARD')) AS liked_stories, CAST(0 AS BIGINT) AS liked_comments, (SELECT count(*) FROM imports) AS import_count""")
def overview_all(s, d):
    """The ten counts of the overview: one pass over the media with both memberships, and one over the imports."""
    both = v.media(s, d).join(v.saved(s, d).select(F.col("media_id").alias("id"), F.lit(True).alias("s")), "id", "left").join(v.liked(s, d).select(F.col("media_id").alias("id"), F.lit(True).alias("l")), "id", "left")
    has = {"s": F.col("s").isNotNull(), "l": F.col("l").isNotNull()}
    of = lambda kind: F.col("media_type").startswith(kind)
    counts = both.agg(F.count_if(has["s"]).alias("total_items"), F.count_if(has["s"] & of("PROMO")).alias("posts"), F.count_if(has["s"] & of("ECONOMY")).alias("reels"), F.count_distinct(F.when(has["s"], F.col("author_username"))).alias("authors"), F.count_if(has["l"]).alias("total_likes"), F.count_if(has["l"] & of("PROMO")).alias("liked_posts"), F.count_if(has["l"] & of("ECONOMY")).alias("liked_reels"), F.count_if(has["l"] & of("STANDARD")).alias("liked_stories"), F.lit(0).cast("long").alias("liked_comments"))
    return counts.crossJoin(v.imports(s, d).agg(F.count("*").alias("import_count")))  # one row each


@query("SELECT id, coalesce((SELECT string_agg(collection_name, chr(31) ORDER BY collection_name) FROM item_collections WHERE item_id = id), '') AS collections FROM media")
def search_rows(s, d):
    return c.search_rows(v.media(s, d), v.item_collections(s, d)).select("id", "collections")


@query("SELECT event_type AS kind, count(*) AS items, count(*) FILTER (WHERE value IS NOT NULL) AS with_value, string_agg(DISTINCT CAST(user_id % 5 AS VARCHAR), ',' ORDER BY CAST(user_id % 5 AS VARCHAR)) AS groups FROM events GROUP BY 1")
def import_log(s, d):
    e = v.read(s, d, "events")
    return e.groupBy(F.col("event_type").alias("kind")).agg(F.count("*").alias("items"), F.count("value").alias("with_value"), F.array_join(F.array_sort(F.collect_set((F.col("user_id") % 5).cast("string"))), ",").alias("groups"))
