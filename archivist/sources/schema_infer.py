"""Structure of JSON documents: a tree of types for each file, merged over files by Spark."""

from __future__ import annotations

import json
import math
import random
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archivist.sources.store import scratch

DEPTH, SAMPLED, ENDS = 256, 20, 7


def _type(v) -> str:
    if v is None:
        return "null"
    return {bool: "boolean", int: "number", float: "number", str: "string", list: "array", dict: "object"}[type(v)]


def places(n: int, seed: int) -> list[int]:
    """All of up to 20 elements; else the first and last 7 and 6 of the others, by a seed."""
    if n <= SAMPLED:
        return list(range(n))
    middle = random.Random(seed).sample(range(ENDS, n - ENDS), SAMPLED - 2 * ENDS)
    return [*range(ENDS), *sorted(middle), *range(n - ENDS, n)]


def infer(v, seed: int = 0, depth: int = 0) -> dict:
    """The tree of a value. Texts are never kept as samples."""
    node: dict = {"type": [_type(v)]}
    if depth >= DEPTH:
        return node | {"truncated": True}
    if isinstance(v, dict):
        node["keys"] = {k: infer(x, seed, depth + 1) for k, x in v.items()}
    elif isinstance(v, list):
        parts = [infer(v[k], seed, depth + 1) for k in places(len(v), seed)]
        node["arrayLength"] = {"min": len(v), "max": len(v), "sample": len(parts)}
        node["homogeneous"] = len({json.dumps(p["type"]) for p in parts}) <= 1
        if parts:
            merged = parts[0]
            for p in parts[1:]:
                merged = merge(merged, p)
            node["items"] = merged
    elif not isinstance(v, (str, float)) or isinstance(v, float) and math.isfinite(v):
        node["sample"] = v
    return node


def merge(a: dict, b: dict) -> dict:
    """Types in the order first seen; a key that one side lacks is optional. Of samples the first is kept while all are of one type. Merging is
    associative, so trees may be merged in stages as long as their order is kept."""
    out: dict = {"type": [*a["type"], *(t for t in b["type"] if t not in a["type"])]}
    if "keys" in a or "keys" in b:
        x, y = a.get("keys", {}), b.get("keys", {})
        out["keys"] = {k: merge(x[k], y[k]) if k in x and k in y else (x.get(k) or y[k]) | {"optional": True} for k in [*x, *(k for k in y if k not in x)]}
    if "items" in a or "items" in b:
        out["items"] = merge(a["items"], b["items"]) if "items" in a and "items" in b else a.get("items") or b["items"]
    if "arrayLength" in a or "arrayLength" in b:
        lengths = [n["arrayLength"] for n in (a, b) if "arrayLength" in n]
        out["arrayLength"] = {"min": min(n["min"] for n in lengths), "max": max(n["max"] for n in lengths), "sample": max(n["sample"] for n in lengths)}
    if "homogeneous" in a or "homogeneous" in b:
        out["homogeneous"] = a.get("homogeneous", True) and b.get("homogeneous", True)
    for k in ("optional", "truncated", "mixed"):
        if a.get(k) or b.get(k):
            out[k] = True
    samples = [n["sample"] for n in (a, b) if "sample" in n]
    if len({_type(x) for x in samples}) > 1:
        out["mixed"] = True  # from now on no sample stands for all
    if samples and not out.get("mixed"):
        out["sample"] = samples[0]
    return out


def scrub(node: dict) -> dict:
    """The tree without samples of texts, whoever wrote it."""
    out = {k: v for k, v in node.items() if not (k == "sample" and isinstance(v, str))}
    if "keys" in out:
        out["keys"] = {k: scrub(v) for k, v in out["keys"].items()}
    if "items" in out:
        out["items"] = scrub(out["items"])
    return out


def file_schema(name: str, content: bytes) -> tuple[str, str | None, str | None]:
    """(top level type, tree as JSON, error)"""
    try:
        v = json.loads(content.decode("utf-8-sig"))
        return _type(v), json.dumps(infer(v, zlib.crc32(name.encode()))), None
    except (ValueError, RecursionError) as e:
        return "unknown", None, type(e).__name__


def schemas(files: DataFrame) -> DataFrame:
    """import_id, file_path, byte_size, truncated_read, top_level_type, schema_json, parse_error of files of (import_id, name, content). Files are read whole."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [file_schema(n, bytes(c)) for n, c in zip(b["name"], b["content"], strict=True)]
            yield pd.DataFrame({"import_id": b["import_id"], "file_path": b["name"], "byte_size": [len(c) for c in b["content"]], "truncated_read": False, "top_level_type": [g[0] for g in got], "schema_json": [g[1] for g in got], "parse_error": [g[2] for g in got]})

    return files.select("import_id", "name", "content").mapInPandas(read, "import_id long, file_path string, byte_size long, truncated_read boolean, top_level_type string, schema_json string, parse_error string")


#: What a stored tree that isn't JSON says.
INVALID = "Invalid stored schema_json"


def _read_tree(text: str | None) -> tuple[str | None, str | None]:
    """(tree without samples of texts, error)"""
    if text is None:
        return None, None
    try:
        tree = json.loads(text)
        return json.dumps(scrub(tree)) if isinstance(tree, dict) and "type" in tree else None, None if isinstance(tree, dict) and "type" in tree else INVALID
    except ValueError:
        return None, INVALID


def readable(found: DataFrame) -> DataFrame:
    """Stored schemas with trees fit to be shown: no samples of texts; a tree that can't be read is an error of its row."""
    read = F.pandas_udf(lambda s: pd.DataFrame([_read_tree(t) for t in s], columns=["tree", "error"]), "tree string, error string")
    return found.withColumn("_t", read("schema_json")).withColumns({"schema_json": F.col("_t.tree"), "parse_error": F.coalesce("_t.error", "parse_error")}).drop("_t")


def options(imports: DataFrame, found: DataFrame) -> DataFrame:
    """Imports of (id, filename, imported_at, status), latest first, with the number of their schemas."""
    counts = found.groupBy(F.col("import_id").alias("id")).agg(F.count("*").alias("schema_files"))
    out = imports.select("id", "filename", "imported_at", "status").join(counts, "id", "left").withColumn("schema_files", F.coalesce("schema_files", F.lit(0).cast("long")))
    return out.withColumn("has_schemas", F.col("schema_files") > 0).orderBy(F.desc("imported_at"), F.desc("id"))


def _fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row for each run of rows of a path: their trees merged in the order they come in."""
    part, at, out = TaskContext.get().partitionId(), _NO_PATH, None
    row = lambda: pd.DataFrame({"file_path": [at], "schema_json": [json.dumps(out)], "part": [part]})
    for b in batches:
        for path, t in zip(b["file_path"], b["schema_json"], strict=True):
            node = json.loads(t)
            if path == at:
                out = merge(out, node)
                continue
            if at is not _NO_PATH:
                yield row()
            at, out = path, node
    if at is not _NO_PATH:
        yield row()


_NO_PATH = object()


def merged_schemas(found: DataFrame, imports: DataFrame | None = None) -> DataFrame:
    """One row for each file path over all imports (of those in `imports`, if given): largest size, whether any read was cut, the top level types, the
    number of imports, the first error and the merged tree, the latest import first.

    Files are read once. Equal trees are merged once. The others are ranged by path and import, so that each task merges its stretch of a path, and at last
    a task the stretches of a path: as many as there are partitions at most, however many imports there are."""
    if imports is not None:
        found = found.join(imports.select(F.col("id").alias("import_id")), "import_id", "left_semi")
    readable(found).write.parquet(path := scratch(found.sparkSession))
    found = found.sparkSession.read.parquet(path)
    types = F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.split("top_level_type", r"\|")))))
    known = F.array_remove(types, "unknown")
    facts = found.groupBy("file_path").agg(F.max("byte_size").alias("byte_size"), F.bool_or("truncated_read").alias("truncated_read"), F.when(F.size(known) == 0, "unknown").otherwise(F.array_join(known, "|")).alias("top_level_type"), F.count_distinct("import_id").alias("imports"), F.max_by("parse_error", F.when(F.col("parse_error").isNotNull(), F.col("import_id"))).alias("parse_error"))
    trees = found.filter("schema_json is not null").groupBy("file_path", "schema_json").agg(F.max("import_id").alias("at"))
    order = [F.col("file_path"), F.desc("at"), F.col("schema_json")]
    parts = trees.repartitionByRange(*order).sortWithinPartitions(*order).select("file_path", "schema_json").mapInPandas(_fold, "file_path string, schema_json string, part int")

    def last(p: pd.DataFrame) -> pd.DataFrame:
        tree = reduce(merge, map(json.loads, p.sort_values("part")["schema_json"]))
        return pd.DataFrame({"file_path": [p["file_path"].iloc[0]], "schema_json": [json.dumps(tree)]})

    return facts.join(parts.groupBy("file_path").applyInPandas(last, "file_path string, schema_json string"), "file_path", "left")


def path_imports(found: DataFrame, imports: DataFrame) -> DataFrame:
    """(file_path, id, filename): the imports that hold a path."""
    return found.select("file_path", F.col("import_id").alias("id")).distinct().join(imports.select("id", "filename"), "id")


@dataclass
class Catalog:
    """Schemas by file, over all imports or of one; why there are none."""

    mode: str
    import_id: int | None
    imports: DataFrame
    files: DataFrame
    empty_reason: str | None


def catalog(imports: DataFrame, found: DataFrame, which: str | None = None) -> Catalog:
    """which: the text of an import's id, or nothing or all for the view over all imports."""
    listed = options(imports, found)
    if which in (None, "", "all"):
        files = merged_schemas(found, imports).orderBy(F.collate("file_path", "UNICODE"))
        reason = None
        if not found.join(imports.select(F.col("id").alias("import_id")), "import_id", "left_semi").head(1):
            reason = "no import has schemas yet" if not listed.filter("has_schemas").head(1) else "no schema files"
        return Catalog("all", None, listed, files, reason)
    none = readable(found).limit(0)
    number = int(which) if which.strip().isdigit() else 0
    if number <= 0:
        return Catalog("import", None, listed, none, "invalid import id")
    if not imports.filter(F.col("id") == number).head(1):
        return Catalog("import", number, listed, none, "import not found")
    mine = found.filter(F.col("import_id") == number)
    return Catalog("import", number, listed, readable(mine).orderBy("file_path"), None if mine.head(1) else "this import has no schemas")


def replace_schemas(stored: DataFrame, new: DataFrame, import_id: int) -> DataFrame:
    """Stored schemas with those of one import replaced."""
    return stored.filter(F.col("import_id") != import_id).unionByName(new.filter(F.col("import_id") == import_id))


def parse_prefix(text: str):
    """The value of a JSON text that was cut off: open strings, lists and objects are closed, dangling parts go; None if nothing is left."""
    ends = [k + (ch != ",") for k, ch in enumerate(text) if ch in ",[]{}"]
    for end in [len(text), *reversed(ends)]:
        open_, quoted, esc = [], False, False
        for ch in text[:end]:
            if quoted:
                if esc:
                    esc = False
                elif ch == "\\":
                    esc = True
                elif ch == '"':
                    quoted = False
            elif ch == '"':
                quoted = True
            elif ch in "[{":
                open_.append("]" if ch == "[" else "}")
            elif ch in "]}" and open_:
                open_.pop()
        try:
            return json.loads(text[:end] + '"' * quoted + "".join(reversed(open_)))
        except ValueError:
            continue
    return None
