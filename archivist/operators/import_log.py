"""The log of an import: counts over its items, kept as JSON with the import and read back whatever its age."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from archivist.functions.identity import blank_to_null

#: Media types that are counted. Fixed values.
SAVED_TYPES, LIKED_TYPES = ("post", "reel", "igtv", "unknown"), ("post", "reel", "igtv", "story", "comment", "unknown")
#: Numbers of a log that default to 0, and lists that default to empty. Fixed values.
NUMBERS = ("filesScanned", "jsonFilesParsed", "itemsParsed", "likesParsed", "authorsFound", "likesAuthorsFound", "itemsWithSavedAt", "likesWithLikedAt", "likesAdded", "likesUpdated", "likesSkipped")
LISTS = ("savedJsonFiles", "likedJsonFiles", "collectionsFound", "warnings")
SHAPE = ", ".join([*(f"{n} double" for n in NUMBERS), *(f"{n} array<string>" for n in LISTS), f"typeCounts struct<{', '.join(f'{t}: double' for t in SAVED_TYPES)}>", f"likeTypeCounts struct<{', '.join(f'{t}: double' for t in LIKED_TYPES)}>"])
#: How older logs told what became of likes. Fixed pattern.
LIKES_TOLD = r"(?i)^Likes:\s*(\d+)\s+added,\s*(\d+)\s+updated,\s*(\d+)\s+unchanged\.?$"


def _types(kind: str, types: tuple[str, ...]) -> Column:
    return F.struct(*[F.count_if(F.col(kind) == t).alias(t) for t in types])


def item_counts(items: DataFrame, library: str, at: str) -> DataFrame:
    """For each import_id of items (import_id, media_type, author_username, at, and collections of saves): how many, by type, with an author (not
    distinct ones), with a time, and the distinct names of collections, trimmed and sorted."""
    author = F.count_if(F.coalesce(F.col("author_username"), F.lit("")) != "")
    if library == "likes":
        return items.groupBy("import_id").agg(F.count("*").alias("likesParsed"), author.alias("likesAuthorsFound"), F.count(at).alias("likesWithLikedAt"), _types("media_type", LIKED_TYPES).alias("likeTypeCounts"))
    counts = items.groupBy("import_id").agg(F.count("*").alias("itemsParsed"), author.alias("authorsFound"), F.count(at).alias("itemsWithSavedAt"), _types("media_type", SAVED_TYPES).alias("typeCounts"))
    names = items.select("import_id", F.explode("collections").alias("name")).withColumn("name", blank_to_null(F.col("name"))).filter("name is not null").distinct()
    lists = names.groupBy("import_id").agg(F.transform(F.array_sort(F.collect_list(F.struct(F.collate("name", "UNICODE").alias("by"), "name"))), lambda x: x["name"]).alias("collectionsFound"))
    return counts.join(lists, "import_id", "left")


def logs(files: DataFrame, saves: DataFrame, likes: DataFrame, warnings: DataFrame) -> DataFrame:
    """(import_id, notes) from files (import_id, name, library: saves, likes or null), items as item_counts takes them (times saved_at, liked_at) and
    warnings (import_id, warning)."""
    named = lambda library: F.array_sort(F.collect_list(F.when(F.col("library") == library, F.col("name"))))
    scanned = files.groupBy("import_id").agg(F.count("*").alias("filesScanned"), F.count("library").alias("jsonFilesParsed"), named("saves").alias("savedJsonFiles"), named("likes").alias("likedJsonFiles"))
    told = warnings.groupBy("import_id").agg(F.array_sort(F.collect_list("warning")).alias("warnings"))
    parts = [scanned, item_counts(saves, "saves", "saved_at"), item_counts(likes, "likes", "liked_at"), told]
    whole = reduce(lambda a, b: a.join(b, "import_id", "left"), parts)
    return whole.select("import_id", F.to_json(F.struct(*[c for c in whole.columns if c != "import_id"])).alias("notes"))


def decoded(notes: Column) -> Column:
    """The log in a text, complete with defaults; null where it is none. Older logs tell what became of likes in a warning only."""
    whole = F.try_parse_json(notes)
    number = F.schema_of_variant(F.try_variant_get(whole, "$.filesScanned", "variant")).rlike("^(BIGINT|DOUBLE|DECIMAL|INT|FLOAT|SMALLINT|TINYINT)")
    whole_log = _once(F.struct(F.from_json(notes, SHAPE).alias("raw")), lambda x: _once(_complete(x["raw"]), _with_told))
    return F.when(number, whole_log)


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """What `use` makes of a value that is computed once, however often it is used; a plain expression would parse the text for each field."""
    return F.get(F.transform(F.array(value), use), 0)


def _complete(raw: Column) -> Column:
    zero = lambda c: F.coalesce(c.cast("long"), F.lit(0).cast("long"))
    fields = {n: zero(raw[n]) for n in NUMBERS} | {n: F.coalesce(raw[n], F.array().cast("array<string>")) for n in LISTS}
    fields |= {n: F.struct(*[zero(raw[n][t]).alias(t) for t in types]) for n, types in (("typeCounts", SAVED_TYPES), ("likeTypeCounts", LIKED_TYPES))}
    return F.struct(*[c.alias(n) for n, c in fields.items()])


def _with_told(log: Column) -> Column:
    """The log with what a warning tells about likes where its numbers don't."""
    fields = {n: log[n] for n in (*NUMBERS, *LISTS, "typeCounts", "likeTypeCounts")}
    told = F.get(F.filter(fields["warnings"], lambda w: w.rlike(LIKES_TOLD)), 0)
    silent = (fields["likesParsed"] > 0) & (fields["likesAdded"] + fields["likesUpdated"] + fields["likesSkipped"] == 0)
    for k, n in enumerate(("likesAdded", "likesUpdated", "likesSkipped"), 1):
        fields[n] = F.when(silent & told.isNotNull(), F.regexp_extract(told, LIKES_TOLD, k).cast("long")).otherwise(fields[n])
    return F.struct(*[c.alias(n) for n, c in fields.items()])


def authors(log: Column) -> tuple[Column, Column]:
    """(saves, likes) with an author. Older logs put both into one number; where that is more than the saves, likes are taken out of it."""
    known = (log["likesAuthorsFound"] > 0) | (log["likesParsed"] == 0)
    both = ~known & (log["authorsFound"] > log["itemsParsed"]) & (log["authorsFound"] >= log["likesWithLikedAt"])
    likes = F.when(known, log["likesAuthorsFound"]).when(both, F.least(log["likesWithLikedAt"], log["authorsFound"])).otherwise(F.lit(0).cast("long"))
    return F.when(both, F.greatest(F.lit(0).cast("long"), log["authorsFound"] - likes)).otherwise(log["authorsFound"]), likes
