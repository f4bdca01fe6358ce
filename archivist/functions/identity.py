"""Identity of media items from their addresses, as column expressions."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The site whose addresses are items, as a pattern: any host. The functions take a narrower one.
SITE = r"[a-z0-9-]+(?:\.[a-z0-9-]+)+"
#: Where an item's code stands in its address. Fixed values.
CODE = r"/(?:p|reel|reels|tv)/([A-Za-z0-9_-]+)"
STORY = r"/stories/([A-Za-z0-9._]+)(?:/([0-9]+))?"
COMMENT_PATH = r"/(?:p|reel|reels|tv)/[^/?#]+/c/([A-Za-z0-9_-]+)"
COMMENT_QUERY = r"[?&#](?:comment_id|commentid)=([A-Za-z0-9_-]+)"
COMMENT_HASH = r"#comment-?([A-Za-z0-9_-]+)"
#: Labels that stand where a name could stand. Fixed values.
LABELS = ("saved on", "added time", "saved post", "saved", "name", "time", "liked on", "like")


def blank_to_null(c: Column) -> Column:
    return F.nullif(F.regexp_replace(c, r"(?U)^[\s\x{FEFF}]+|[\s\x{FEFF}]+$", ""), F.lit(""))


def _found(c: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(c, "(?i)" + pattern, group), F.lit(""))


def once(rows: DataFrame, **columns: Column) -> DataFrame:
    """Rows with more columns that are computed once for each row. With withColumn a filter that uses a column would get a copy of its whole
    expression for each use; patterns of patterns then no longer compile."""
    return rows.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def media_type(href: Column) -> Column:
    h = F.lower(href)
    return F.when(h.contains("/reel/") | h.contains("/reels/"), "reel").when(h.contains("/tv/"), "igtv").when(h.contains("/p/"), "post").otherwise("unknown")


def liked_media_type(href: Column, source: Column) -> Column:
    return F.when(source == "liked_comments", "comment").when((source == "story_likes") | F.lower(href).contains("/stories/"), "story").otherwise(media_type(href))


def shortcode(href: Column, site: str = SITE) -> Column:
    return _found(href, site + CODE)


def story_user(href: Column, site: str = SITE) -> Column:
    return F.lower(_found(href, site + STORY))


def _without_end(c: Column) -> Column:
    return F.nullif(F.regexp_replace(c, "/+$", ""), F.lit(""))


def media_key(href: Column, site: str = SITE) -> Column:
    """The code; else story:user:id; else story:user:address; else host and path; else the text; else null. Slashes at the end don't count."""
    text = blank_to_null(href)
    user, number = story_user(text, site), _found(text, site + STORY, 2)
    story = F.when(user.isNotNull(), F.concat(F.lit("story:"), user, F.lit(":"), F.coalesce(number, _without_end(F.lower(text)))))
    return F.coalesce(shortcode(text, site), story, _address(text))


def _address(text: Column) -> Column:
    host, path = F.lower(F.try_parse_url(text, F.lit("HOST"))), F.try_parse_url(text, F.lit("PATH"))
    return F.coalesce(F.concat(host, F.coalesce(_without_end(path), F.lit(""))), _without_end(text))


def identified(rows: DataFrame, site: str = SITE) -> DataFrame:
    """Rows with media_key, shortcode and _story (the story's user) of their href, as the functions above tell them, and href trimmed. Each pattern is
    tried once, those of stories only on addresses without a code."""
    rows = once(rows.withColumnRenamed("href", "_href"), href=blank_to_null(F.col("_href"))).drop("_href")
    rows = once(rows, _code=F.regexp_extract("href", "(?i)" + site + CODE, 1), _about=F.lower("href").contains("/stories/"))
    rows = once(rows, shortcode=F.nullif("_code", F.lit("")), _story=F.when(F.col("_about"), story_user(F.col("href"), site)))
    rows = once(rows, media_key=F.when(F.col("shortcode").isNotNull(), F.col("shortcode")).when(F.col("_about"), media_key(F.col("href"), site)).otherwise(_address(F.col("href"))))
    return rows.drop("_code", "_about")


def comment_id(href: Column, site: str = SITE) -> Column:
    return F.coalesce(_found(href, site + COMMENT_PATH), _found(href, COMMENT_QUERY), _found(href, COMMENT_HASH))


def comment_slug(text: str | None) -> str:
    """A short name from a comment's text."""
    units = unicodedata.normalize("NFKC", (text or "").strip()).encode("utf-16-le")[:128].decode("utf-16-le", "ignore")
    return re.sub(r"[^A-Za-z0-9._-]", "", re.sub(r"\s+", "_", units)) or "empty"


def username(c: Column) -> Column:
    return blank_to_null(F.regexp_replace(c, "^@+", ""))


def looks_like_username(c: Column) -> Column:
    return c.rlike(r"(?i)^[@a-z0-9._-]{1,64}$") & ~F.lower(c).isin(*LABELS) & ~F.lower(c).startswith("http")


def timestamp(c: Column) -> Column:
    """Seconds, or milliseconds beyond 1e12, as numbers or digits; else ISO text; else null. Whole seconds."""
    n = c.try_cast("double")
    seconds = F.when(n > 1e12, n / 1000).otherwise(n)
    return F.coalesce(F.timestamp_seconds(F.floor(seconds)), F.try_to_timestamp(c))


def comment_key(base: Column, author: Column, at: Column, fbid: Column, comment: Column, content: Column) -> Column:
    """The identity of a liked comment: its own id, else the comment's in the address, else the post with author, time in milliseconds and text."""
    slug = F.pandas_udf(lambda s: s.map(comment_slug), "string")(F.coalesce(content, F.lit("")))
    told = F.concat_ws(":", F.lit("comment"), base, F.lower(F.coalesce(author, F.lit("unknown"))), F.coalesce(F.unix_millis(at), F.lit(0)).cast("string"), slug)
    return F.coalesce(F.concat(F.lit("comment:fbid:"), blank_to_null(fbid)), F.concat(F.lit("comment:id:"), blank_to_null(comment)), told)
