"""Exact nearest neighbours, cutoffs, reuse of vectors, integrity and health of a vector index."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

MAX_K, MIN_K = 4096, 32
ABSOLUTE, SLACK = 1.22, 0.12


def neighbours_wanted(limit: int) -> int:
    return min(max(2 * limit, MIN_K), MAX_K)


def l2(a: Column, b: Column) -> Column:
    square = F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    return F.sqrt(square)


def knn(vectors: DataFrame, query: list[float], k: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, distance) of the k nearest; ties by id. Vectors of another length are left out."""
    q = F.from_json(F.lit(json.dumps([float(x) for x in query])), "array<double>")  # folds to one constant; an array of many literals would not compile
    fit = vectors.filter(F.size(vector_col) == len(query))
    return fit.select(F.col(id_col).alias("id"), l2(F.col(vector_col).cast("array<double>"), q).alias("distance")).orderBy("distance", "id").limit(k)


def cutoff(hits: DataFrame, limit: int, absolute: float = ABSOLUTE, slack: float = SLACK) -> DataFrame:
    """Hits no farther than the absolute bound and the best one's distance plus the slack."""
    best = hits.agg(F.min("distance").alias("_best"))
    near = hits.join(F.broadcast(best)).filter(F.col("distance") <= F.least(F.lit(absolute), F.col("_best") + slack))  # one row
    return near.drop("_best").orderBy("distance", "id").limit(limit)


def normalized(v: Column) -> Column:
    """Unit length; a vector without a finite, positive norm stays as it is."""
    d = v.cast("array<double>")
    norm = F.sqrt(F.aggregate(d, F.lit(0.0), lambda s, x: s + x * x))
    return F.when((norm > 0) & (norm < float("inf")), F.transform(d, lambda x: x / norm)).otherwise(d)


def cosine_of(distance: Column) -> Column:
    return distance * distance / 2


def distance_of(cosine: Column) -> Column:
    return F.sqrt(F.greatest(F.lit(0.0), cosine) * 2)


def missing(items: DataFrame, vectors: DataFrame, provider: str) -> DataFrame:
    """Items of (media_id) without a vector of the provider."""
    return items.join(vectors.filter(F.col("provider") == provider).select("media_id"), "media_id", "left_anti")


def reusable(items: DataFrame, vectors: DataFrame, provider: str) -> DataFrame:
    """Vectors of the same media that another library's index already has: one each, for items that lack one."""
    one = vectors.filter(F.col("provider") == provider).dropDuplicates(["media_id"])
    return one.join(items.select("media_id").distinct(), "media_id", "left_semi")


def gaps(items: Column, keyword: Column, vectors: Column, same_profile: Column) -> list[Column]:
    """keyword_gap, vector_gap and degraded."""
    k, v = F.greatest(F.lit(0).cast("long"), items - keyword), F.greatest(F.lit(0).cast("long"), items - vectors)
    return [k.alias("keyword_gap"), v.alias("vector_gap"), ((k > 0) | (v > 0) | ~same_profile).alias("degraded")]


def health(available: Column, items: Column, vectors: Column, same_profile: Column, sound: Column) -> Column:
    return F.when(~available, "unavailable").when(vectors == 0, "empty").when(~same_profile | ~sound, "stale").when(vectors < items, "partial").otherwise("ready")


def integrity(vectors: DataFrame, media: DataFrame, dimensions: int) -> DataFrame:
    """orphans (vectors without media) and wrong_width, over all rows."""
    known = media.select(F.col("id").alias("media_id")).distinct().withColumn("_known", F.lit(True))
    return vectors.join(known, "media_id", "left").agg(F.count_if(F.col("_known").isNull()).alias("orphans"), F.count_if(F.coalesce(F.size("embedding"), F.lit(-1)) != dimensions).alias("wrong_width"))


def same_profile(a: dict, b: dict) -> bool:
    return all(a.get(k) == b.get(k) for k in ("provider", "model", "dimensions", "endpoint"))


def estimated_mb(items: int, dimensions: int = 1024) -> float:
    return items * dimensions * 4 / (1 << 20)


def memory_admission(free_mb: float, items: int, library: str, provider: str) -> str:
    """refuse, warn or allow a rebuild by free memory and the size of the library."""
    large = items >= (5_000 if library == "likes" else 20_000)
    least = 1536 if provider == "ollama" else 1024
    if free_mb < 512 or (large and free_mb < least):
        return "refuse"
    return "warn" if large or free_mb < 2 * least else "allow"


def reciprocal_ranks(keyword: DataFrame, vector: DataFrame, limit: int, k: int = 60) -> DataFrame:
    """Merge (id, rank) lists: score = sum of 1 / (k + rank); source both, fts or vec. Ties: the keyword list first, then rank."""
    both = keyword.select("id", "rank", F.lit(0).alias("_list")).unionByName(vector.select("id", "rank", F.lit(1).alias("_list")))
    merged = both.groupBy("id").agg(F.sum(1.0 / (k + F.col("rank"))).alias("score"), F.min(F.struct("_list", "rank")).alias("_first"), F.count("*").alias("_n"))
    source = F.when(F.col("_n") > 1, "both").when(F.col("_first._list") == 0, "fts").otherwise("vec")
    return merged.withColumn("source", source).orderBy(F.desc("score"), "_first._list", "_first.rank", "id").limit(limit).select("id", "score", "source", F.col("_first").alias("_at"))


def ranked(hits: DataFrame, *order: Column) -> DataFrame:
    """(id, rank) of an already bounded list of hits."""
    return hits.select("id", F.row_number().over(Window.orderBy(*order)).alias("rank"))
