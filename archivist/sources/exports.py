"""Export documents of several layouts as raw item rows.

Only finding the items of one JSON document is done in Python, in key order; identity, types, times
and merging are column expressions and aggregates of Spark. A document that isn't JSON gives a warning row."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archivist.functions import identity as i
from archivist.operators.merge import merge_batch

RAW = "archive string, entry_ord int, item_ord int, href string, author string, at string, collection string, source string, warning string"
RAW_ARROW = pa.schema([(c.split()[0], pa.int32() if c.endswith(" int") else pa.string()) for c in RAW.split(", ")])
FILE = ["archive", "entry_ord", "name", "content", "source"]
_ADDRESS = re.compile(i.SITE + r"/(?:p|reel|reels|tv|stories)/", re.I)
_TIMED, _NAMED, _USER = re.compile("saved|added|time", re.I), re.compile("name|author|username|channel|creator|profile", re.I), re.compile(r"[@A-Za-z0-9._-]+")
#: Buckets of likes by the key of their list. Fixed values.
BUCKETS = {"likes_media_likes": "liked_posts", "likes_comment_likes": "liked_comments", "story_activities_story_likes": "story_likes", "liked_posts": "liked_posts", "liked_comments": "liked_comments"}
#: Rows that a task holds before it passes them on.
ROWS = 20_000
UNNAMED, FROM_FILE = "Unnamed collection", "From collections file"


def _dict(x) -> dict:
    return x if isinstance(x, dict) else {}


def _text(x) -> str | None:
    return (x.strip() or None) if isinstance(x, str) else None


def _list(entry: dict, *keys: str) -> list | None:
    for k in keys:
        if isinstance(entry.get(k), list):
            return entry[k]
    return None


def _name(value: str | None) -> str | None:
    """The value if it can be a user name."""
    ok = value and len(value) <= 64 and value.lower() not in i.LABELS and _USER.fullmatch(value)
    return value.lstrip("@").strip() or None if ok else None


def hrefs(node) -> Iterator[str]:
    """Every href, and every text that looks like an item's address, depth first."""
    if isinstance(node, str):
        if "/" in node and _ADDRESS.search(node):
            yield node
    elif isinstance(node, list):
        for x in node:
            yield from hrefs(x)
    elif isinstance(node, dict):
        for k, x in node.items():
            if k.lower() == "href" and isinstance(x, str):
                yield x
            else:
                yield from hrefs(x)


def _maps(entry: dict) -> dict:
    return _dict(entry.get("string_map_data")) or _dict(entry.get("stringMapData"))


def _string_list(entry: dict) -> tuple:
    """(href, time, value) of the first element with an address, else the first one's time and value."""
    some = [_dict(x) for x in _list(entry, "string_list_data", "stringListData") or []]
    for x in some:
        if _text(x.get("href")):
            return _text(x["href"]), x.get("timestamp"), _text(x.get("value"))
    return (None, some[0].get("timestamp"), _text(some[0].get("value"))) if some else (None, None, None)


def _saved_on(entry: dict) -> tuple:
    """(href, time, value): a field of a time's name, else Name with Added Time, else any field, else the list."""
    fields = {k: _dict(x) for k, x in _maps(entry).items()}
    if fields:
        timed = [x for k, x in fields.items() if _TIMED.search(k)]
        name = fields.get("Name") or fields.get("name") or {}
        added = fields.get("Added Time") or fields.get("Saved on") or fields.get("Time") or {}
        for x, when in [*zip(timed, timed, strict=True), (name, added), *((x, x) for x in fields.values())]:
            if _text(x.get("href")):
                return _text(x["href"]), when.get("timestamp"), _text(x.get("value"))
    return _string_list(entry)


def _author(entry: dict, value: str | None) -> str | None:
    title = _text(entry.get("title"))
    if title:
        return title.lstrip("@").strip() or None
    named = [_text(_dict(x).get("value")) for k, x in _maps(entry).items() if _NAMED.search(k)]
    return next((n for n in map(_name, [value, *named]) if n), None)


class Labels:
    """The label_values of an entry."""

    def __init__(self, entry):
        self.entry = _dict(entry)
        some = _list(self.entry, "label_values", "labelValues")
        self.values = [_dict(x) for x in some or []]

    def get(self, label: str) -> dict:
        return next((x for x in self.values if str(x.get("label", "")).strip().lower() == label.lower()), {})

    def titled(self, title: str) -> list[dict]:
        return next(([_dict(y) for y in x["dict"]] for x in self.values if str(x.get("title", "")).strip().lower() == title.lower() and isinstance(x.get("dict"), list)), [])

    def href(self) -> str | None:
        url = self.get("URL")
        return _text(url.get("href")) or _text(url.get("value"))

    def owner(self) -> str | None:
        inside = [Labels({"label_values": x.get("dict") if isinstance(x.get("dict"), list) else [x]}) for x in self.titled("Owner")]
        found = [_text(x.get(label).get("value")) for label in ("Username", "Name") for x in inside]
        return next((f.lstrip("@").strip() for f in found if f), None)

    def when(self, *more: str):
        e = self.entry.get("timestamp")
        return e if e is not None else next((t for t in (self.get("Update time").get("timestamp_value"), *(self.get(m).get("timestamp") for m in more)) if t is not None), None)


def _labelled(some: list) -> list[Labels]:
    return [Labels(x) for x in some if isinstance(x, dict) and _list(x, "label_values", "labelValues") is not None]


def _label_entry(x: Labels) -> Iterator[tuple]:
    members = x.titled("Media")
    if members:
        name = _text(x.get("Name").get("value")) or UNNAMED
        for m in members:
            child = Labels({"label_values": m.get("dict") if isinstance(m.get("dict"), list) else []})
            for h in [child.href()] if child.href() else hrefs(m):
                yield h, child.owner(), None, name
        return
    for h in [x.href()] if x.href() else hrefs(x.entry.get("label_values")):
        yield h, x.owner(), x.when(), None


def _media(some: list, collection: str | None) -> Iterator[tuple]:
    labelled = _labelled(some)
    if labelled:
        for x in labelled:
            for h, author, at, own in _label_entry(x):
                yield h, author, at, own or collection
        return
    for entry in (x for x in some if isinstance(x, dict)):
        href, at, value = _saved_on(entry)
        author = _author(entry, value)
        for h in [href] if href else hrefs(entry):
            yield h, author, at, collection


def _flat(entry: dict) -> bool:
    if _list(entry, "media_list_data", "mediaListData", "saved_saved_media"):
        return False
    fields, (href, _, value) = _maps(entry), _string_list(entry)
    return bool(fields.get("Name") or fields.get("name") or href or value)


def _collections(some: list) -> Iterator[tuple]:
    rows = [x for x in some if isinstance(x, dict)]
    if any(map(_flat, rows)):
        current = None  # the header that the following members belong to
        for entry in rows:
            name = _dict(_maps(entry).get("Name")) or _dict(_maps(entry).get("name"))
            href, at, value = _saved_on(entry)
            if name and not _text(name.get("href")) and _text(name.get("value")):
                current = _text(name["value"])
            elif not href and value:
                current = value
            else:
                author = _name(value) or _author(entry, value)
                for h in [href] if href else hrefs(entry):
                    yield h, author, at, current
        return
    for entry in rows:
        name = _text(entry.get("title")) or _text(entry.get("name")) or _text(_maps(entry).get("Name")) or UNNAMED
        yield from _media(_list(entry, "media_list_data", "mediaListData", "saved_saved_media") or [], name)
        for h in hrefs(entry):
            yield h, None, None, name


def saves(doc, name: str) -> Iterator[tuple]:
    """(href, author, time, collection) of a saves document."""
    if isinstance(doc, list):
        yield from _media(doc, None)
    elif isinstance(doc, dict):
        media, groups = _list(doc, "saved_saved_media", "saved_media", "saved_posts"), _list(doc, "saved_saved_collections", "saved_collections")
        yield from _media(media or [], FROM_FILE if "collection" in name.lower() else None)
        yield from _collections(groups or [])
        if media is None and groups is None:
            yield from ((h, None, None, None) for h in hrefs(doc))


def _likes(some: list, source: str) -> Iterator[tuple]:
    labelled = _labelled(some)
    for x in labelled:
        for h in [x.href()] if x.href() else hrefs(x.entry.get("label_values")):
            yield h, x.owner(), x.when("Liked on"), source
    for entry in [] if labelled else [x for x in some if isinstance(x, dict)]:
        href, at, value = _string_list(entry)
        for h in [href] if href else hrefs(entry):
            yield h, _author(entry, value), at, source


def likes(doc, source: str) -> Iterator[tuple]:
    """(href, author, time, source) of a likes document."""
    if isinstance(doc, list):
        yield from _likes(doc, source)
    elif isinstance(doc, dict):
        found = [(k, s) for k, s in BUCKETS.items() if isinstance(doc.get(k), list)]
        for k, s in found:
            yield from _likes(doc[k], s)
        if not found:
            yield from ((h, None, None, source) for h in hrefs(doc))


def raw_items(files: DataFrame, library: str) -> DataFrame:
    """Rows of RAW from files of (archive, entry_ord, name, content, source)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns: list[list] = [[] for _ in RAW_ARROW]

        def flush() -> pa.RecordBatch:
            rows = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, RAW_ARROW.types, strict=True)], schema=RAW_ARROW)
            for c in columns:
                c.clear()
            return rows

        def add(*row) -> None:
            for c, x in zip(columns, row, strict=True):
                c.append(x)

        for b in batches:
            for archive, entry, name, content, source in zip(*[b.column(n).to_pylist() for n in FILE], strict=True):
                try:
                    doc = json.loads(content.decode("utf-8-sig"))
                except (ValueError, RecursionError) as e:
                    add(archive, entry, 0, None, None, None, None, None, f"{name}: {type(e).__name__}")
                    continue
                found = saves(doc, name) if library == "saves" else likes(doc, source)
                for k, (h, a, t, x) in enumerate(found):
                    add(archive, entry, k, h, a, None if t is None else str(t), x if library == "saves" else None, x if library == "likes" else None, None)
                    if len(columns[0]) >= ROWS:
                        yield flush()
            yield flush()

    return files.select(*FILE).mapInArrow(read, RAW)


def parsed(raw: DataFrame, library: str, site: str = i.SITE) -> DataFrame:
    """Items of one import, merged by identity; comments are recognised and left out. site: whose addresses are items."""
    rows = i.identified(raw.filter("warning is null"), site).filter("media_key is not null and not startswith(media_key, 'comment:')")
    href = F.col("href")
    rows = i.once(rows.withColumnsRenamed({"at": "_at", "author": "_author"}), at=i.timestamp(F.col("_at")), author_username=F.coalesce(i.username(F.col("_author")), F.col("_story")))
    order = ["archive", "entry_ord", "item_ord"]
    if library == "saves":
        named = i.blank_to_null(F.col("collection"))
        rows = rows.withColumns({"media_type": i.media_type(href), "collections": F.when(named.isNotNull(), F.array(named)).otherwise(F.array().cast("array<string>"))})
        return merge_batch(rows, "at", order).withColumnRenamed("at", "saved_at")
    rows = rows.withColumn("media_type", i.liked_media_type(href, F.col("source"))).filter("media_type <> 'comment'")
    return merge_batch(rows, "at", order, lists=False, first=("href", "shortcode", "media_type", "source")).withColumnRenamed("at", "liked_at")


def ordered(items: DataFrame, at: str) -> DataFrame:
    """Latest first, without a time last; ties as they came."""
    return items.orderBy(F.coalesce(F.unix_timestamp(at), F.lit(0)).desc(), "_ord")
