"""Connected components of a graph given as pairs of ids, by alternating stars on DataFrames.

A large star links every larger neighbour of a node to the smallest node around it, a small star
does so with the smaller neighbours; after a few rounds every node points to the smallest node of
its component. Neighbourhoods are only ever reduced to their minimum, never gathered."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archivist.llm.common import ROWS_A_TASK, free, sized, stored


def components(pairs: DataFrame) -> DataFrame:
    """(a, b) pairs of longs -> (id, component): each id that has a pair with another, and the smallest id it reaches."""
    e = stored(pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct())
    rows = e.count()
    e, state = sized(e, rows), None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        both = both.coalesce(max(1, -(-2 * rows // ROWS_A_TASK)))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("p")).select("p.u", "p.v").filter("u > v").distinct()
        before, e = e, stored(small)
        free(before)
        now = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        rows = now["n"]
        e = sized(e, rows)
        if state == (now["n"], now["h"]):
            return e.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
        state = (now["n"], now["h"])
