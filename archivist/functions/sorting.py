"""Orders of names: as a locale would have them, and naturally, where numbers count as numbers; and the order of a tree of files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Digits of a number that are compared by value; longer ones by how long they are first.
WIDTH = 5


def natural_key(name: Column) -> Column:
    """An array that sorts a2 before a10, whatever the length of the numbers: runs of digits come as their length and digits without leading zeros;
    names that differ only in zeros or case are told apart by themselves, at last."""
    runs = F.regexp_extract_all(F.lower(name), F.lit(r"([0-9]+|[^0-9]+)"), F.lit(1))
    number = lambda r: F.ltrim(r, F.lit("0"))
    key = F.transform(runs, lambda r: F.when(r.rlike("^[0-9]"), F.concat(F.lit("0"), F.lpad(F.length(number(r)).cast("string"), WIDTH, "0"), number(r))).otherwise(r))
    return F.concat(key, F.array(F.lit(""), name))


def locale_key(name: Column, collation: str = "UNICODE") -> Column:
    """A text that sorts by the rules of a collation."""
    return F.collate(name, collation)


def tree_nodes(files: DataFrame, path: str = "file_path") -> DataFrame:
    """(path, parent, name, kind, depth, files) of the files and of each folder above them; empty parts of a path don't count. files: how many lie below."""
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    each = files.select(parts.alias("p")).filter(F.size("p") > 0)
    depth = F.explode(F.sequence(F.lit(1), F.size("p"))).alias("depth")
    nodes = each.select("p", depth).select(F.array_join(F.slice("p", 1, F.col("depth")), "/").alias("path"), F.when(F.col("depth") == F.size("p"), "file").otherwise("folder").alias("kind"), "depth")
    found = nodes.groupBy("path", "kind", "depth").agg(F.count("*").alias("files"))
    return found.select("path", F.coalesce(F.regexp_extract("path", "^(.*)/[^/]*$", 1), F.lit("")).alias("parent"), F.regexp_extract("path", "([^/]*)$", 1).alias("name"), "kind", "depth", "files")


def tree_order(nodes: DataFrame, natural: bool = False) -> DataFrame:
    """The nodes with their place among those of the same parent: folders first, then by name."""
    key = natural_key(F.col("name")) if natural else locale_key(F.col("name"))
    return nodes.withColumn("place", F.row_number().over(Window.partitionBy("parent").orderBy(F.col("kind") == "file", key, "name")))
