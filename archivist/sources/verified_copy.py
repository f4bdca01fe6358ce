"""Copies of tables between stores, with types converted, verified by digests that don't depend on order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from archivist.sources.store import Store

#: Buckets of rows that are compared at once.
BUCKETS = 1024
#: Conversions (there, back) by name.
CONVERSIONS = {
    "flag": (lambda c: c.cast("int"), lambda c: c.cast("boolean")),
    "seconds": (lambda c: F.unix_timestamp(c), lambda c: F.timestamp_seconds(c)),
    "text": (lambda c: c.cast("string"), lambda c: c.cast("bigint")),
    "list": (lambda c: F.to_json(c), lambda c: F.from_json(c, "array<double>").cast("array<float>")),
}


class NotEmpty(Exception):
    """The target holds rows already."""


class Different(Exception):
    """Source and target differ after a copy."""


def converted(df: DataFrame, conversions: dict[str, str], back: bool = False) -> DataFrame:
    return df.withColumns({c: CONVERSIONS[kind][back](F.col(c)) for c, kind in conversions.items()}) if conversions else df


def _row_hash(df: DataFrame, seed: int) -> Column:
    """A hash of a row that tells nulls from values, columns by name."""
    parts = [x for c in sorted(df.columns) for x in (F.col(c).isNull(), F.col(c))]
    return F.xxhash64(F.lit(seed), *parts)


def digests(df: DataFrame, key: list[str], buckets: int = BUCKETS) -> DataFrame:
    """(bucket, rows, a, b): of the rows whose key falls in the bucket how many, the sum of their hashes and the exclusive or of others."""
    bucket = F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")
    return df.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("rows"), F.sum(_row_hash(df, 1).cast("decimal(38,0)")).alias("a"), F.bit_xor(_row_hash(df, 2)).alias("b"))


def differing(source: DataFrame, target: DataFrame, key: list[str], buckets: int = BUCKETS) -> DataFrame:
    """(bucket, rows_source, rows_target) of the buckets whose digests differ."""
    s, t = digests(source, key, buckets), digests(target.select(*source.columns), key, buckets)
    both = s.join(t.toDF("bucket", "rows_target", "a2", "b2"), "bucket", "full_outer")
    same = F.col("rows").eqNullSafe(F.col("rows_target")) & F.col("a").eqNullSafe(F.col("a2")) & F.col("b").eqNullSafe(F.col("b2"))
    zero = F.lit(0).cast("long")
    return both.filter(~same).select("bucket", F.coalesce("rows", zero).alias("rows_source"), F.coalesce("rows_target", zero).alias("rows_target"))


def changed_keys(source: DataFrame, target: DataFrame, key: list[str], buckets: int = BUCKETS) -> DataFrame:
    """(key, what): keys whose rows differ: missing, added or changed. Only rows of differing buckets are joined."""
    wrong = F.broadcast(differing(source, target, key, buckets).select("bucket"))  # `buckets` rows at most
    bucket = F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int").alias("bucket")

    def rows(df: DataFrame, name: str) -> DataFrame:
        some = df.select("*", bucket).join(wrong, "bucket", "left_semi").drop("bucket")
        return some.groupBy(*key).agg(F.sum(_row_hash(some, 1).cast("decimal(38,0)")).alias(name))

    both = rows(source, "_s").join(rows(target.select(*source.columns), "_t"), key, "full_outer")
    what = F.when(F.col("_t").isNull(), "missing").when(F.col("_s").isNull(), "added").otherwise("changed")
    return both.filter(~F.col("_s").eqNullSafe(F.col("_t"))).select(*key, what.alias("what"))


def row_totals(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, rows) of each table."""
    return reduce(lambda a, b: a.unionByName(b), [df.agg(F.count("*").alias("rows")).select(F.lit(n).alias("table"), "rows") for n, df in tables.items()])


def copy_store(source: Store, target: Store, tables: dict[str, tuple[list[str], dict[str, str]]]) -> DataFrame:
    """Copy tables of (key, conversions) into a store that has none of their rows: all are staged and held against the source first, then the
    pointers of all move. (table, rows) of what was copied; a difference raises and leaves the target as it was."""
    there = {n: target.read(n) for n in tables if target.version(n) is not None}
    if there and row_totals(there).filter("rows > 0").head(1):
        raise NotEmpty("the target holds rows of these tables")
    staged = {}
    for name, (key, conversions) in tables.items():
        rows = source.read(name)
        staged[name] = target.stage(name, converted(rows, conversions))
        back = converted(target.staged(name, staged[name]), conversions, back=True)
        wrong = differing(rows, back, key).orderBy("bucket").head(1)
        if wrong:
            raise Different(f"{name}: bucket {wrong[0]['bucket']} has {wrong[0]['rows_source']} rows in the source, {wrong[0]['rows_target']} in the copy, or others")
    target.publish(staged)
    return row_totals({n: target.read(n) for n in tables})
