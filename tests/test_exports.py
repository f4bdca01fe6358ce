import pytest
from pyspark.sql import functions as F

from archivist.functions import identity
from archivist.sources import exports
from tests.oracle import agree


@pytest.mark.parametrize("name", ["parse_saves_lists", "parse_saves_maps", "parse_saves_labels", "parse_collections_flat", "parse_collections_nested", "parse_likes_buckets", "parse_likes_stories", "parse_damaged", "throttled_ticks", "overview_all"])
def test_queries_against_sql(spark, name):
    assert agree(spark, name)


def test_comment_keys(spark):
    rows = [("b", "Ann", 5, " 77 ", "9", "x"), ("b", "Ann", 5, " ", "9", "x"), ("b", "Ann", 5, None, None, " Nice  pic! "), ("b", None, None, None, "", None)]
    df = spark.createDataFrame(rows, "base string, author string, s long, fbid string, comment string, content string").coalesce(1)
    key = identity.comment_key(F.col("base"), F.col("author"), F.timestamp_seconds("s"), F.col("fbid"), F.col("comment"), F.col("content"))
    assert [r[0] for r in df.select(key).collect()] == ["comment:fbid:77", "comment:id:9", "comment:b:ann:5000:Nice_pic", "comment:b:unknown:0:empty"]


def test_identity_is_computed_once_for_each_row(spark):
    rows = [("a", 0, 0, "https://m.example.com/p/X1/", " @ann ", "5", None, None, None), ("a", 0, 1, "https://m.example.com/stories/Bob/77/", None, "6", None, None, None), ("a", 0, 2, "https://M.example.com/Some/Path//?x", "", None, None, None, None), ("a", 0, 3, "  ", None, None, None, None, None), ("a", 0, 4, "https://m.example.com/stories/Eve/p/Y2", None, None, "c", None, None), ("a", 0, 5, "no address/", None, None, None, None, None)]
    raw = spark.createDataFrame(rows, exports.RAW)
    found = exports.parsed(raw, "saves")
    keys = raw.select("item_ord", identity.media_key(F.col("href")).alias("k"), identity.shortcode(F.col("href")).alias("c"), identity.story_user(F.col("href")).alias("s"))
    assert sorted(map(str, keys.collect())) == sorted(map(str, identity.identified(raw).select("item_ord", F.col("media_key").alias("k"), F.col("shortcode").alias("c"), F.col("_story").alias("s")).collect()))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("tv)/([A-Za-z0-9_-]+)") <= 3, plan.count("tv)/([A-Za-z0-9_-]+)")  # 13 and more when each use had its copy
