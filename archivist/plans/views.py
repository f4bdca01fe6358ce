"""The library's tables as views over the star schema: parts are media, returned line items saves, accepted ones likes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SINCE = "2001-05-01"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def media(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_partkey").cast("string").alias("media_key"), F.col("p_type").alias("media_type"), F.col("p_brand").alias("author_username"), F.col("p_name").alias("name"))


def membership(spark: SparkSession, d: str, flag: str, at: str) -> DataFrame:
    rows = read(spark, d, "lineitem").filter((F.col("l_returnflag") == flag) & (F.col("l_shipdate") >= F.lit(SINCE).cast("timestamp")))
    return rows.groupBy(F.col("l_partkey").alias("media_id")).agg(F.max("l_shipdate").alias(at))


def saved(spark: SparkSession, d: str) -> DataFrame:
    return membership(spark, d, "R", "saved_at")


def liked(spark: SparkSession, d: str) -> DataFrame:
    return membership(spark, d, "A", "liked_at")


def item_collections(spark: SparkSession, d: str) -> DataFrame:
    """(item_id, collection_name): the nations of an item's suppliers."""
    nation = read(spark, d, "nation").select("n_nationkey", "n_name")
    supplier = read(spark, d, "supplier").select("s_suppkey", "s_nationkey").join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    pairs = read(spark, d, "lineitem").select("l_partkey", "l_suppkey").join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    return pairs.select(F.col("l_partkey").alias("item_id"), F.col("n_name").alias("collection_name")).distinct()


def imports(spark: SparkSession, d: str) -> DataFrame:
    """One import for each month of orders."""
    month = F.year("o_orderdate") * 100 + F.month("o_orderdate")
    return read(spark, d, "orders").groupBy(month.cast("long").alias("id")).agg(F.count("*").alias("items_found"), F.count_if(F.col("o_orderstatus") == "F").alias("items_added"))


#: The same views for DuckDB; a query's SQL begins with them.
SQL = f"""WITH media AS (SELECT p_partkey AS id, CAST(p_partkey AS VARCHAR) AS media_key, p_type AS media_type, p_brand AS author_username, p_name AS name FROM part),
saved AS (SELECT l_partkey AS media_id, max(l_shipdate) AS saved_at FROM lineitem WHERE l_returnflag = 'R' AND l_shipdate >= TIMESTAMP '{SINCE}' GROUP BY 1),
liked AS (SELECT l_partkey AS media_id, max(l_shipdate) AS liked_at FROM lineitem WHERE l_returnflag = 'A' AND l_shipdate >= TIMESTAMP '{SINCE}' GROUP BY 1),
item_collections AS (SELECT DISTINCT l_partkey AS item_id, n_name AS collection_name FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey),
imports AS (SELECT CAST(year(o_orderdate) * 100 + month(o_orderdate) AS BIGINT) AS id, count(*) AS items_found, count(*) FILTER (WHERE o_orderstatus = 'F') AS items_added FROM orders GROUP BY 1)
"""
