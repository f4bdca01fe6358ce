"""Reads over the library: statistics, browsing, facets, history, overlap."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Ids a search may hand to browsing.
RANKED_CAP = 10_000
PAGE_SIZE, MAX_PAGE_SIZE, MAX_PAGE = 25, 100, 1_000_000
#: Media types of each library. Fixed values.
MEDIA_TYPES = {"saves": ("post", "reel", "igtv", "unknown"), "likes": ("post", "reel", "igtv", "story", "unknown")}
#: Longest filter values. Fixed values.
MAX_LENGTH = {"q": 500, "author": 100, "collection": 200, "provider": 32}


@dataclass(frozen=True)
class Browse:
    """A validated browse request."""

    q: str | None = None
    type: str | None = None
    author: str | None = None
    collection: str | None = None
    membership: str | None = None
    provider: str | None = None
    page: int = 1
    page_size: int = PAGE_SIZE


def browse_request(params: dict[str, str], library: str = "saves", types: tuple[str, ...] | None = None) -> Browse:
    """Check text parameters; a wrong one is an error, never guessed at."""
    out: dict = {}
    for name, most, default in (("page", MAX_PAGE, 1), ("page_size", MAX_PAGE_SIZE, PAGE_SIZE)):
        raw = params.get(name)
        if raw is None or raw == "":
            out[name] = default
        elif not re.fullmatch(r"-?\d+", raw) or not 1 <= int(raw) <= most:
            raise ValueError(f"{name} has to be a whole number from 1 to {most}")
        else:
            out[name] = int(raw)
    for name, most in MAX_LENGTH.items():
        value = (params.get(name) or "").strip()
        if len(value) > most:
            raise ValueError(f"{name} has more than {most} characters")
        out[name] = value or None
    kind = params.get("type") or "all"
    if kind != "all" and kind not in (types or MEDIA_TYPES[library]):
        raise ValueError(f"{library} have no type {kind}")
    out["type"] = None if kind == "all" else kind
    if params.get("membership") not in (None, "", "both"):
        raise ValueError("membership can only be both")
    out["membership"] = params.get("membership") or None
    if library == "likes" and out["collection"]:
        raise ValueError("likes have no collections")
    return Browse(**out)


def clamp(value: float | None, default: int, most: int) -> int:
    """The second line of defence: not finite or under 1 gives the default, else at most `most`."""
    if value is None or value != value or value in (float("inf"), float("-inf")) or value < 1:
        return default
    return min(int(value), most)


def items(media: DataFrame, members: DataFrame) -> DataFrame:
    return members.join(media, members["media_id"] == media["id"]).drop("media_id")


def stats(items_: DataFrame, types: dict[str, str]) -> DataFrame:
    """total, distinct authors and a conditional count for each output name -> media type; 0 over nothing."""
    counts = [F.coalesce(F.sum(F.when(F.col("media_type") == t, 1).otherwise(0)), F.lit(0)).cast("long").alias(n) for n, t in types.items()]
    return items_.agg(F.count("*").alias("total"), F.countDistinct("author_username").alias("authors"), *counts)


def top(df: DataFrame, column: str, n: int, name: str = "name") -> DataFrame:
    """The n most frequent values; ties by value."""
    return df.filter(F.col(column).isNotNull() & (F.col(column) != "")).groupBy(F.col(column).alias(name)).agg(F.count("*").alias("count")).orderBy(F.desc("count"), name).limit(n)


def facet(df: DataFrame, column: str) -> DataFrame:
    return df.filter(F.col(column).isNotNull() & (F.col(column) != "")).select(F.col(column).alias("value")).distinct().orderBy("value")


def like(columns: list[str], term: str) -> Column:
    """Any column holds the term; % and _ in it are wildcards, as users are used to."""
    escape = next(c for c in "\\!~^|\x01" if c not in term)
    return reduce(or_, [F.expr(f"{c} ILIKE {_quoted('%' + term + '%')} ESCAPE {_quoted(escape)}") for c in columns])


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def flagged(df: DataFrame, other: DataFrame, key: str, other_key: str, name: str) -> DataFrame:
    """df with a boolean column: whether the key is among the other's."""
    keys = other.select(F.col(other_key).alias("_key")).distinct().withColumn(name, F.lit(True))
    return df.join(keys, df[key] == keys["_key"], "left").drop("_key").withColumn(name, F.coalesce(name, F.lit(False)))


def filtered(items_: DataFrame, request: Browse, others: DataFrame | None = None, collections: DataFrame | None = None, ranked: DataFrame | None = None) -> DataFrame:
    """All conditions of a request hold. others: the other library's (media_id); ranked: (id, rank) of a search, or None."""
    wanted = [F.col(c) == v for c, v in (("media_type", request.type), ("author_username", request.author)) if v]
    out = items_.filter(reduce(and_, wanted)) if wanted else items_
    if request.collection and collections is not None:
        inside = collections.filter(F.col("collection_name") == request.collection).select(F.col("item_id").alias("id"))
        out = out.join(inside, "id", "left_semi")
    if request.membership == "both" and others is not None:
        out = out.join(others.select(F.col("media_id").alias("id")), "id", "left_semi")
    if ranked is not None:
        out = out.join(F.broadcast(ranked), "id")  # a search cuts at RANKED_CAP and says so
    elif request.q:
        out = out.filter(like([c for c in ("author_username", "href", "name", "shortcode", "media_key") if c in items_.columns], request.q))
    return out


def page(df: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    number, size = clamp(number, 1, MAX_PAGE), clamp(size, PAGE_SIZE, MAX_PAGE_SIZE)
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def browse_order(at: str, ranked: bool = False) -> list[Column]:
    return [F.asc("rank"), F.desc("id")] if ranked else [F.col(at).desc_nulls_last(), F.desc("id")]


def page_count(df: DataFrame, size: int) -> DataFrame:
    return df.agg(F.count("*").alias("total")).select("total", F.ceil(F.col("total") / size).cast("long").alias("total_pages"))


def with_collections(page_: DataFrame, collections: DataFrame) -> DataFrame:
    """A page's rows with their collections as a sorted list."""
    keys = page_.select(F.col("id").alias("item_id"))
    lists = collections.join(keys, "item_id", "left_semi").groupBy(F.col("item_id").alias("id")).agg(F.array_sort(F.collect_list("collection_name")).alias("collections"))
    return page_.join(lists, "id", "left").withColumn("collections", F.coalesce("collections", F.array().cast("array<string>")))


def search_rows(media: DataFrame, collections: DataFrame) -> DataFrame:
    """Every media row with its collections joined by a unit separator, '' without any."""
    joined = collections.groupBy(F.col("item_id").alias("id")).agg(F.array_join(F.array_sort(F.collect_list("collection_name")), "\x1f").alias("collections"))
    return media.join(joined, "id", "left").withColumn("collections", F.coalesce("collections", F.lit("")))


def coverage(done: Column, total: Column, empty: float = 0.0) -> Column:
    """Percent with one decimal, at most 100."""
    return F.when(total <= 0, F.lit(empty)).otherwise(F.least(F.lit(100.0), F.round(done * 100.0 / total, 1)))
