"""Near-duplicate vectors by Euclidean p-stable hashing, followed by exact cosine checks.

A vector is normalised and projected on random normal directions; each projection, shifted and cut into
cells of WIDTH, gives an integer, and `k` of them make a bucket of one of the tables. Two unit vectors of
cosine 0.95 are sqrt(0.1) apart, so a cell holds both with probability P_NEAR. k grows with the
logarithm of the number of vectors, so that chance meetings stay in proportion, and the number of
tables follows from k for a recall of RECALL at the threshold itself; closer pairs do better.

Equal vectors are one class before anything is hashed. A bucket of more than BLOCK classes is cut
into blocks, and each pair of blocks is compared by one task, so no bucket is skipped, capped or
gathered. A pair counts in the first table where its two buckets agree. For a group of many links
only sums and spanning links leave the task.

Vectors that are null, zero, hold null or non-finite components or have no id link with nothing and are
kept. Vectors of different lengths never link. Repeated rows are vectors of their own. An empty table
gives an empty result. Only the id and the vector column are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from archivist.llm.common import partitions, stored, table
from archivist.llm.components import components

THRESHOLD, WIDTH, RECALL, BLOCK, SEED = 0.95, 1.0, 0.99, 512, 20


def _meet(distance: float, width: float = WIDTH) -> float:
    """The probability that a projection puts two points at this distance in one cell."""
    s = width / distance
    return math.erf(s / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * s) * (1 - math.exp(-s * s / 2))


P_NEAR, P_FAR = _meet(math.sqrt(2 - 2 * THRESHOLD)), _meet(math.sqrt(2))


def plan(n: int) -> tuple[int, int]:
    """(projections for each table, tables) for n vectors."""
    k = max(4, math.ceil(math.log(max(n, 1) / 100 + 1) / -math.log(P_FAR)))
    return k, math.ceil(math.log(1 - RECALL) / math.log(1 - P_NEAR**k))


def _links(ids: np.ndarray, sizes: np.ndarray, vectors: np.ndarray, keys: np.ndarray, group: np.ndarray, side: np.ndarray, at: np.ndarray, threshold: float):
    """Of rows sorted by group: (ids, links added) and pairs that span the links. at: the table of each row;
    side: 0 or 1 where only rows of different sides are compared, 2 where all are."""
    first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    last = np.r_[first[1:], len(group)]
    left: list[np.ndarray] = []
    right: list[np.ndarray] = []
    dense = []
    small = (last - first) <= 32
    longest = int((last - first)[small].max(initial=1))
    reach = np.repeat(np.where(small, last, 0), last - first)
    for d in range(1, longest):
        i = np.flatnonzero(np.arange(len(group)) + d < reach)
        if not len(i):
            break
        near = np.einsum("ij,ij->i", vectors[i], vectors[i + d]) >= threshold
        i = i[near & ((side[i] == 2) | (side[i] != side[i + d]))[: len(near)]]
        left.append(i)
        right.append(i + d)
    for a, b in zip(first[~small].tolist(), last[~small].tolist(), strict=True):
        s = side[a:b]
        x = np.flatnonzero(s != 1) + a
        y = np.flatnonzero(s != 0) + a
        if len(x) and len(y):
            near = vectors[x] @ vectors[y].T >= threshold
            i, j = np.nonzero(near)
            i, j = x[i], y[j]
            on = (i < j) if s[0] == 2 else slice(None)
            dense.append((i[on], j[on]))
    added_ids, added, pairs = [], [], []
    for parts, spanned in [((np.concatenate(left), np.concatenate(right)), False)] * bool(left) + [(p, True) for p in dense]:
        i, j = parts
        for k in range(0, len(i), 1 << 18):
            a, b = i[k : k + (1 << 18)], j[k : k + (1 << 18)]
            before = np.arange(keys.shape[1])[None, :] < at[a][:, None]
            new = ~((keys[a] == keys[b]) & before).any(1)  # else an earlier table has the pair
            a, b = a[new], b[new]
            if not len(a):
                continue
            rows, where = np.unique(np.r_[a, b], return_inverse=True)
            added_ids.append(ids[rows])
            added.append(np.bincount(where, weights=np.r_[sizes[b], sizes[a]]).astype(np.int64))
            if spanned:
                low = np.arange(len(rows))
                x, y = where[: len(a)], where[len(a) :]
                while True:
                    m = np.minimum(low[x], low[y])
                    new_low = low.copy()
                    np.minimum.at(new_low, x, m)
                    np.minimum.at(new_low, y, m)
                    if (new_low == low).all():
                        break
                    low = new_low[new_low]
                pairs.append(np.stack([ids[rows], ids[rows[low]]], 1))
            else:
                pairs.append(np.stack([ids[a], ids[b]], 1))
    return added_ids, added, pairs


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD) -> DataFrame:
    """id, n_links, component_id, kept for each row."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    largest = F.aggregate("v", F.lit(0.0), lambda s, x: F.when(x.isNull(), float("nan")).otherwise(F.greatest(s, F.abs(x))))  # not squares, which may pass a double's range
    good = F.col("id").isNotNull() & F.coalesce((largest > 0) & (largest < float("inf")) & ~F.isnan(largest), F.lit(False))  # NaN is greater than all
    rows = stored(rows.withColumn("good", good))
    classes = stored(rows.filter("good").groupBy("v").agg(F.min("id").alias("rep"), F.count("*").alias("size")))
    n = classes.count()
    k, tables = plan(n)

    def bucket(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for b in batches:
            for dim, part in b.groupby(b["v"].map(len)):
                if dim not in made:
                    rnd = np.random.default_rng(SEED + dim)
                    made[dim] = rnd.standard_normal((dim, k * tables)), rnd.uniform(0, WIDTH, k * tables)
                m = np.stack(part["v"].to_list())
                m = m / np.abs(m).max(1, keepdims=True)
                m /= np.linalg.norm(m, axis=1, keepdims=True)
                cells = np.floor((m @ made[dim][0] + made[dim][1]) / WIDTH).astype(np.int64).astype(np.uint64)
                h = np.full((len(m), tables), dim, np.uint64)
                for c in range(k):
                    h = (h ^ cells[:, c::k]) * np.uint64(0x9E3779B97F4A7C15)
                    h ^= h >> np.uint64(29)
                h = (h & np.uint64((1 << 62) - 1)).astype(np.int64)
                raw, key = [x.tobytes() for x in m], [x.tobytes() for x in h]
                for t in range(tables):
                    yield pd.DataFrame({"rep": part["rep"].to_numpy(), "size": part["size"].to_numpy(), "at": t, "key": h[:, t], "m": raw, "keys": key})

    buckets = stored(classes.mapInPandas(bucket, "rep long, size long, at long, key long, m binary, keys binary"))
    full = buckets.groupBy("at", "key").agg(F.count("*").alias("_n")).filter("_n > 1").withColumn("_blocks", F.ceil(F.col("_n") / BLOCK))
    met = buckets.join(full, ["at", "key"]).withColumn("_own", F.pmod(F.xxhash64("rep"), F.col("_blocks")))
    met = met.withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1)))
    low, high = F.least("_own", "_other"), F.greatest("_own", "_other")
    side = F.when(low == high, 2).when(F.col("_own") == low, 0).otherwise(1)
    met = met.withColumn("_group", F.xxhash64("at", "key", low, high)).withColumn("_side", side)

    def link(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []

        def done(p: pd.DataFrame) -> Iterator[pd.DataFrame]:
            p = p.assign(dim=p["m"].map(len))
            for dim, q in p.groupby("dim"):
                m = np.frombuffer(b"".join(q["m"]), np.float64).reshape(-1, dim // 8)
                key = np.frombuffer(b"".join(q["keys"]), np.int64).reshape(len(q), -1)
                ids, added, pairs = _links(q["rep"].to_numpy(), q["size"].to_numpy(), m, key, q["_group"].to_numpy(), q["_side"].to_numpy(), q["at"].to_numpy(), threshold)
                if ids:
                    yield pd.DataFrame({"a": np.concatenate(ids), "b": -1, "links": np.concatenate(added)})
                    both = np.concatenate(pairs)
                    both = both[both[:, 0] != both[:, 1]]
                    yield pd.DataFrame({"a": both[:, 0], "b": both[:, 1], "links": 0})

        n_held = 0
        for b in batches:
            held.append(b)
            n_held += len(b)
            if n_held < 20_000:
                continue
            p = pd.concat(held, ignore_index=True)
            whole = p["_group"] != p["_group"].iloc[-1]
            yield from done(p[whole]) if whole.any() else ()
            held = [p[~whole]]
            n_held = len(held[0])
        if n_held:
            yield from done(pd.concat(held, ignore_index=True))

    spread = met.select("rep", "size", "at", "m", "keys", "_group", "_side").repartition(4 * partitions(spark), "_group").sortWithinPartitions("_group")
    found = stored(spread.mapInPandas(link, "a long, b long, links long"))
    links = found.filter("b = -1").groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("_links"))
    parts = components(found.filter("b <> -1").select("a", "b")).withColumnRenamed("id", "rep")
    each = classes.join(links, "rep", "left").join(parts, "rep", "left")
    each = each.select("v", (F.coalesce("_links", F.lit(0)) + F.col("size") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    linked = rows.filter("good").join(each, "v").select("id", "n_links", "component_id")
    alone = rows.filter("not good").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = linked.unionByName(alone)
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


def op6_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


QUERIES = {"op6_vector_dedup": op6_vector_dedup}
SQL: dict[str, str] = {}
