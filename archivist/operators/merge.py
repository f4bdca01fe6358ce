"""Keyed merges: within one import the first wins, against the stored library the last."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def merge_batch(items: DataFrame, at: str, order: list[str], lists: bool = True, first: tuple[str, ...] = ("href", "shortcode", "media_type")) -> DataFrame:
    """One row for each media_key: first values, first author that isn't blank, latest time, and distinct collections as they came."""
    ord_ = F.struct(*order)
    author = F.nullif(F.col("author_username"), F.lit(""))
    aggs = [F.min_by(c, ord_).alias(c) for c in first] + [F.min_by(author, F.when(author.isNotNull(), ord_)).alias("author_username"), F.max(at).alias(at), F.min(ord_).alias("_ord")]
    if lists:
        aggs.append(F.array_sort(F.collect_list(F.struct(ord_.alias("o"), F.col("collections").alias("c")))).alias("_lists"))
    out = items.groupBy("media_key").agg(*aggs)
    if lists:
        out = out.withColumn("collections", F.array_distinct(F.flatten(F.col("_lists.c")))).drop("_lists")
    return out


def merge_state(stored: DataFrame, incoming: DataFrame, import_id: int, at: str, lists: bool = True, last: tuple[str, ...] = ()) -> DataFrame:
    """The full outer join of stored and incoming rows by media_key. last: more columns of which the incoming value wins.

    The last author that isn't blank and the last type that isn't unknown win, the last href always, the first
    shortcode stays, the later time counts; outcome is added, updated, skipped or kept (not in the import)."""
    s, i = stored.alias("s"), incoming.alias("i")
    both = s.join(i, F.col("s.media_key") == F.col("i.media_key"), "full_outer")
    old, new = F.col("s.media_key").isNotNull(), F.col("i.media_key").isNotNull()
    author = F.coalesce(F.nullif(F.col("i.author_username"), F.lit("")), F.col("s.author_username"))
    kind = F.when(new & (~old | (F.col("i.media_type") != "unknown")), F.col("i.media_type")).otherwise(F.col("s.media_type"))
    href = F.coalesce("i.href", "s.href")
    shortcode = F.when(old, F.col("s.shortcode")).otherwise(F.col("i.shortcode"))
    when = F.greatest(f"s.{at}", f"i.{at}")
    lists_ = F.array_union(F.coalesce("s.collections", F.array().cast("array<string>")), F.coalesce("i.collections", F.array().cast("array<string>"))) if lists else None
    changes = [~author.eqNullSafe(F.col("s.author_username")), ~kind.eqNullSafe(F.col("s.media_type")), ~href.eqNullSafe(F.col("s.href")), ~when.eqNullSafe(F.col(f"s.{at}"))]
    if lists:
        changes.append(F.size(lists_) > F.size(F.coalesce("s.collections", F.array().cast("array<string>"))))
    changes += [new & ~F.col(f"i.{c}").eqNullSafe(F.col(f"s.{c}")) for c in last]
    changed = changes[0]
    for c in changes[1:]:
        changed = changed | c
    outcome = F.when(~new, "kept").when(~old, "added").when(changed, "updated").otherwise("skipped")
    columns = [F.coalesce("s.media_key", "i.media_key").alias("media_key"), href.alias("href"), shortcode.alias("shortcode"), kind.alias("media_type"), author.alias("author_username"), when.alias(at)]
    if lists:
        columns.append(lists_.alias("collections"))
    columns += [F.when(new, F.col(f"i.{c}")).otherwise(F.col(f"s.{c}")).alias(c) for c in last]
    first = F.coalesce(F.col("s.first_seen_import_id"), F.lit(import_id).cast("long"))
    last = F.when(new, F.lit(import_id).cast("long")).otherwise(F.col("s.last_seen_import_id"))
    return both.select(*columns, first.alias("first_seen_import_id"), last.alias("last_seen_import_id"), outcome.alias("outcome"))


def accounting(members: DataFrame, import_id: int) -> DataFrame:
    """added: first seen by the import; updated: seen last by it, less the added, never negative."""
    added, touched = F.count_if(F.col("first_seen_import_id") == import_id), F.count_if(F.col("last_seen_import_id") == import_id)
    return members.agg(added.alias("added"), touched.alias("touched")).select("added", F.greatest(F.lit(0).cast("long"), F.col("touched") - F.col("added")).alias("updated"))


def rollback(media: DataFrame, saved: DataFrame, liked: DataFrame, collections: DataFrame, import_id: int) -> dict[str, DataFrame]:
    """The library without what the import brought in. Rows it only touched stay; media of it in neither membership go."""
    gone = [m.filter(F.col("first_seen_import_id") == import_id).select("media_id") for m in (saved, liked)]
    s, k = (m.filter(F.col("first_seen_import_id") != import_id) for m in (saved, liked))
    touched = gone[0].union(gone[1]).distinct()
    held = s.select("media_id").union(k.select("media_id")).distinct()
    orphans = touched.join(held, "media_id", "left_anti").select(F.col("media_id").alias("id"))
    return {"saved": s, "liked": k, "media": media.join(orphans, "id", "left_anti"), "item_collections": collections.join(gone[0].select(F.col("media_id").alias("item_id")), "item_id", "left_anti")}


def duplicate_contents(files: DataFrame, content: str, order: str) -> DataFrame:
    """Each file with its SHA-256 and whether an earlier one has the same."""
    hashed = files.withColumn("content_hash", F.sha2(F.col(content), 256))
    first = hashed.groupBy("content_hash").agg(F.min(order).alias("_first"))
    return hashed.join(first, "content_hash").withColumn("duplicate", F.col(order) > F.col("_first")).drop("_first")


def orphans(child: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    return child.join(parent.select(F.col(parent_key).alias(key)), key, "left_anti")
