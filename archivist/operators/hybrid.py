"""Hybrid search: keyword and vector hits merged by reciprocal ranks, with what became of either search."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from archivist.operators.vector_index import Unavailable
from archivist.operators.vectors import ranked, reciprocal_ranks
from archivist.sources.store import scratch


@dataclass
class Found:
    """Hits (id, rank, score, source), best first, at most the limit; how they came about."""

    hits: DataFrame
    mode: str
    provider: str
    fallback: bool = False
    reason: str | None = None
    keyword_degraded: bool = False
    vector_degraded: bool = False
    truncated: bool = False
    counts: dict[str, int] = field(default_factory=dict)


def resolved(requested: str | None, available: list[str], preferred: str | None = None) -> tuple[str, str | None]:
    """The provider to ask and, if it isn't the requested one, why. available: those set up, the offline one first.
    Without a request the preferred one, then the remote ones, then the offline one."""
    if requested is None:
        order = [p for p in (preferred, "openai", "voyage", "ollama") if p in available]
        return (order[0] if order else "local"), None
    if requested in available:
        return requested, None
    first = available[0] if available else "local"
    return first, f"{requested} is not enabled; using {first} semantic search."


def hybrid_search(spark: SparkSession, q: str, limit: int, keyword: Callable[[str, int], tuple[DataFrame | None, bool]], vectors: dict[str, Callable[[str, int], DataFrame]], requested: str | None = None, preferred: str | None = None) -> Found:
    """Search with both. keyword: (hits of (id, score), degraded); vectors: for each provider that is set up (id, distance) hits, or Unavailable; any
    other error is a failure. If a remote provider can't be asked, the offline one is. The mode follows from the hits that there are.

    Each list has at most `limit` rows; they are stored once, so counting and merging don't search again."""
    provider, reason = resolved(requested, sorted(vectors, key=lambda p: (p != "local", p)), preferred)
    words, keyword_degraded = keyword(q, limit)
    path = scratch(spark)

    def keep(name: str, hits: DataFrame | None, *order) -> int:
        if hits is None:
            return 0
        ranked(hits.limit(limit), *order).withColumn("list", F.lit(name)).write.mode("overwrite").parquet(f"{path}/{name}")
        return spark.read.parquet(f"{path}/{name}").count()

    n_words = keep("fts", words, F.desc("score"), F.asc("id"))

    def near(which: str) -> tuple[int, str]:
        """(hits, what became of it)"""
        ask = vectors.get(which)
        try:
            return (0, "unavailable") if ask is None else (keep("vec", ask(q, limit), F.asc("distance"), F.asc("id")), "ok")
        except Unavailable:
            return 0, "unavailable"
        except Exception:  # a provider may fail in any way; the search goes on without it
            return 0, "failed"

    n_near, status = near(provider)
    degraded, used = status == "failed", False
    if provider != "local" and status != "ok":
        used = True
        reason = reason or f"{provider} semantic search {'failed' if degraded else 'unavailable'}; using local vectors."
        provider = "local"
        n_near, status = near("local")
        degraded = degraded or status == "failed"
    fallback = used or reason is not None
    lists = {name: spark.read.parquet(f"{path}/{name}") for name, n in (("fts", n_words), ("vec", n_near)) if n}
    out = Found(words.limit(0) if words is not None else spark.createDataFrame([], "id long, score double"), "none", provider, fallback, reason if fallback else None, keyword_degraded, degraded, False, {"fts": n_words, "vec": n_near})
    if not lists:
        out.hits = out.hits.select("id", F.lit(0).alias("rank"), "score", F.lit("").alias("source"))
        return out
    none = next(iter(lists.values())).limit(0)
    both = [lists.get(name, none) for name in ("fts", "vec")]
    merged = reciprocal_ranks(*both, limit)
    n = both[0].select("id").union(both[1].select("id")).distinct().count()
    out.truncated = n > limit or n_words >= limit or n_near >= limit
    order = Window.orderBy(F.desc("score"), "_at", "id")  # at most `limit` rows
    merged.withColumn("rank", F.row_number().over(order)).select("id", "rank", "score", "source").write.mode("overwrite").parquet(f"{path}/merged")
    out.hits = spark.read.parquet(f"{path}/merged")
    out.mode = "fts" if not n_near else ("hybrid" if n_words else "vec") + ("-local-fallback" if fallback else "")
    return out
