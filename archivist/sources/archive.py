"""Export archives and loose JSON files as rows (archive, entry_ord, name, content, byte_size)."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Caps on the bytes of an entry and of all JSON in an archive. Fixed values.
ENTRY_CAP, TOTAL_CAP = 512 << 20, 768 << 20
SHAPE = "archive string, entry_ord int, name string, content binary, byte_size long"


def wanted(name: str) -> bool:
    last = name.rsplit("/", 1)[-1]
    return name.lower().endswith(".json") and "__MACOSX" not in name and not last.startswith(".")


def entries(archive: str, raw: bytes, entry_cap: int = ENTRY_CAP, total_cap: int = TOTAL_CAP) -> Iterator[tuple]:
    """The JSON entries of a zip in order. A corrupt entry is skipped; one over a cap fails the import."""
    total = 0
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        for k, info in enumerate(z.infolist()):
            name = info.filename.replace("\\", "/")
            if info.is_dir() or not wanted(name):
                continue
            if info.file_size > entry_cap:
                raise ValueError(f"{archive}: {name} is over the cap of an entry")
            try:
                with z.open(info) as f:
                    content = f.read(entry_cap + 1)
            except (zipfile.BadZipFile, OSError, EOFError, NotImplementedError):
                continue
            except Exception as e:  # zlib reports damage with an error of its own
                if type(e).__module__ != "zlib":
                    raise
                continue
            total += len(content)
            if len(content) > entry_cap or total > total_cap:
                raise ValueError(f"{archive}: {name} goes over a cap")
            yield archive, k, name, content, len(content)


def scan(spark: SparkSession, path: str, entry_cap: int = ENTRY_CAP, total_cap: int = TOTAL_CAP) -> DataFrame:
    """All JSON of the zip archives and JSON files under a path. Each archive is read by one task, entry by entry."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in SHAPE.split(", ")]
        for b in batches:
            for where, raw in zip(b["path"], b["content"], strict=True):
                if where.lower().endswith(".zip"):
                    for row in entries(where, raw, entry_cap, total_cap):
                        yield pd.DataFrame([row], columns=columns)
                elif wanted(where):
                    yield pd.DataFrame([(where, 0, where.rsplit("/", 1)[-1], raw, len(raw))], columns=columns)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInPandas(read, SHAPE)


def with_hash(files: DataFrame) -> DataFrame:
    return files.withColumn("content_hash", F.sha2("content", 256))


def saved_file(name: Column) -> Column:
    low = F.lower(name)
    return low.endswith(".json") & ~low.contains("__macosx") & (low.contains("saved") | low.contains("collection") | low.rlike(r"(^|/)(posts?|reels?)\.json$"))


def liked_source(name: Column) -> Column:
    """Which kind of likes a file holds by its name, or null."""
    low = F.lower(name)
    return (
        F.when(low.contains("liked_comments") | low.contains("comment_likes"), "liked_comments")
        .when(low.contains("story_likes") | low.contains("stories_likes"), "story_likes")
        .when(low.contains("liked_post") | low.contains("likes_media_likes") | low.rlike(r"/likes/[^/]+\.json$"), "liked_posts")
    )


#: Made-up documents by layout: (library, kind of every n-th item, n, authors, first time). Fixed values.
LAYOUTS = {"saved lists": ("saves", "reel", 3, "user", 50, 1_700_000_000), "liked lists": ("likes", "reel", 4, "liker", 40, 1_700_100_000), "saved labels": ("saves", "reel", 2, "owner", 30, 1_700_000_000)}


def synthetic(spark: SparkSession, n: int, layout: str = "saved lists") -> DataFrame:
    """n made-up items in one document each, (name, content, source), for tests and benchmarks."""
    library, kind, every, author, authors, first = LAYOUTS[layout]
    code = F.concat(F.lit("S"), F.lpad(F.lower(F.conv(F.col("id").cast("string"), 10, 36)), 6, "0"))
    href = F.concat(F.lit("https://media.example.com/"), F.when(F.col("id") % every == 0, kind).otherwise("p"), F.lit("/"), code, F.lit("/"))
    name, at = F.concat(F.lit(author), (F.col("id") % authors).cast("string")), F.col("id") + first
    if layout == "saved labels":
        owner = F.array(F.struct(F.lit("").alias("title"), F.array(F.struct(F.lit("Username").alias("label"), name.alias("value"))).alias("dict")))
        empty, none = F.lit(None).cast("string"), F.lit(None).cast("array<struct<title: string, dict: array<struct<label: string, value: string>>>>")
        values = F.array(F.struct(F.lit("URL").alias("label"), href.alias("value"), href.alias("href"), empty.alias("title"), none.alias("dict")), F.struct(empty.alias("label"), empty.alias("value"), empty.alias("href"), F.lit("Owner").alias("title"), owner.alias("dict")))
        doc = F.array(F.struct(at.alias("timestamp"), (F.col("id") + 10_000).cast("string").alias("fbid"), values.alias("label_values")))
    else:
        entry = F.struct(F.lit("").alias("title"), F.array(F.struct(href.alias("href"), name.alias("value"), at.alias("timestamp"))).alias("string_list_data"))
        doc = F.struct(F.array(entry).alias("saved_saved_media" if library == "saves" else "likes_media_likes"))
    folder = "saved/saved_posts_" if library == "saves" else "likes/liked_posts_"
    source = F.lit("liked_posts" if library == "likes" else None).cast("string")
    return spark.range(n).select(F.concat(F.lit(folder), "id", F.lit(".json")).alias("name"), F.to_json(doc).alias("content"), source.alias("source"))
