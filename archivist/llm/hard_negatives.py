"""Hard negatives by segment summaries.

A vector is cut into segments, and each segment's mean and deviation are stored. Over one segment of s components an inner product is
s times the product of the means, plus or minus at most s times the product of the deviations (Cauchy and Schwarz), so sums over the
segments bound the score. 1, 4 and 16 segments are tried in turn, each time only for pairs that the coarser ones left; what is left after
the finest is scored exactly, in integers.

All rows are dealt to blocks of about BLOCK by a hash, whatever their labels, so a hot label is split; each block gets all anchors, which
its task streams. A first pass finds each anchor's best rows of its label: in a block, an anchor's k-th greatest lower bound rules out rows
whose upper bound is less. A second pass finds the rows of other labels whose scores lie between the two shares of a positive's score. A block returns
the k best of each, and the best of all blocks are taken by a window.

Rows with a null id, label or vector, a null or non-finite component, or one of 2**17 or more in size (scores could pass a long) take no part.
Vectors of different lengths have no score together. A row is never a positive or negative of an anchor with its own id; other repeated rows
count each for itself, but an anchor that repeats whole is one. Equal scores are told apart by the smaller id. Positives with a negative score have no
negatives, as no score lies in their range. Empty tables give an empty result. Only the id, label and vector column are read, so others can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from archivist.llm.blocks import index_and_queries
from archivist.llm.common import free, partitions, stored, table

BLOCK, PORTION = 8192, 256
SEGMENTS, SCALE, LARGEST = (1, 4, 16), 256, 1 << 17
POSITIVES, NEGATIVES = 5, 5
#: A negative's score lies between these hundredths of the positive's.
LOW, HIGH = 80, 100


def levels(dim: int) -> list[int]:
    return [m for m in SEGMENTS if m < dim]


def summaries(q: np.ndarray) -> np.ndarray:
    """For each level the means and then the deviations of its segments, each times the root of the segment's length."""
    out = []
    for m in levels(q.shape[1]):
        at = np.linspace(0, q.shape[1], m + 1).astype(int)
        size = np.sqrt(np.diff(at))
        mean = np.add.reduceat(q, at[:-1], axis=1) / size**2
        rest = q - np.repeat(mean, np.diff(at), axis=1)
        out += [mean * size, np.sqrt(np.add.reduceat(rest * rest, at[:-1], axis=1))]
    return np.concatenate(out, 1) if out else np.zeros((len(q), 0))


def prepared(rows: DataFrame) -> DataFrame:
    """(id, label, dim, v, seg) of rows (id, label, v array<double>) that take part: v as integers, seg its summaries."""
    fine = F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < LARGEST))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size = np.array([len(x) for x in b.column(2)], np.int64)
            values = b.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            q = np.floor(SCALE * values)
            at = np.cumsum(size) - size
            v: list[bytes] = [b""] * len(size)
            seg: list[bytes] = [b""] * len(size)
            for d in np.unique(size[size > 0]).tolist():
                mine = np.flatnonzero(size == d)
                m = q[at[mine][:, None] + np.arange(d)]
                for i, x, y in zip(mine.tolist(), m.astype(np.int32), summaries(m), strict=True):
                    v[i], seg[i] = x.tobytes(), y.tobytes()
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(size.astype(np.int32)), pa.array(v, pa.binary()), pa.array(seg, pa.binary())], names=["id", "label", "dim", "v", "seg"])

    return rows.filter(fine & (F.size("v") > 0)).mapInArrow(run, "id long, label long, dim int, v binary, seg binary")


class Vectors:
    """Rows of one length: ids, labels, integer vectors and, by level, scaled means and deviations. Sorted by label."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, v: list[bytes], seg: list[bytes]):
        self.ids, self.labels = ids, labels
        self.q = np.frombuffer(b"".join(v), np.int32).reshape(len(ids), -1).astype(np.float64)
        s = np.frombuffer(b"".join(seg), np.float64).reshape(len(ids), -1)
        self.levels, at = [], 0
        for m in levels(self.q.shape[1]):
            self.levels.append((s[:, at : at + m], s[:, at + m : at + 2 * m]))
            at += 2 * m
        self.most = float(np.abs(self.q).max(initial=0))

    def of(self, rows) -> Vectors:
        out = object.__new__(Vectors)
        out.ids, out.labels, out.q, out.most = self.ids[rows], self.labels[rows], self.q[rows], self.most
        out.levels = [(a[rows], b[rows]) for a, b in self.levels]
        return out


def bounds(a: Vectors, b: Vectors, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Below and above each pair's score, with room for rounding."""
    (am, ad), (bm, bd) = a.levels[level], b.levels[level]
    middle, off = am @ bm.T, ad @ bd.T
    off += 1 + 1e-9 * a.most * b.most * a.q.shape[1]
    return middle - off, middle + off


def scores(a: Vectors, b: Vectors, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Exact scores of the pairs (i, j): in doubles while sums stay below 2**53."""
    exact = a.most * b.most * a.q.shape[1] < 1 << 53
    x, y = (a.q, b.q) if exact else (a.q.astype(np.int64), b.q.astype(np.int64))
    if exact and 4 * len(i) > len(x) * len(y):
        return (x @ y.T)[i, j].astype(np.int64)
    out = np.empty(len(i), np.int64)
    for k in range(0, len(i), 1 << 18):
        out[k : k + (1 << 18)] = np.einsum("ij,ij->i", x[i[k : k + (1 << 18)]], y[j[k : k + (1 << 18)]])
    return out


def _kth(low: np.ndarray, k: int) -> np.ndarray:
    """The k-th greatest of each row, or minus infinity."""
    if low.shape[1] < k:
        return np.full((len(low), 1), -np.inf)
    return np.partition(low, low.shape[1] - k, axis=1)[:, [low.shape[1] - k]]


def _first(i: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Which of the pairs are among the k best of their i."""
    order = np.lexsort((ids, -score, i))
    si = i[order]
    start = np.searchsorted(si, si)
    return order[np.arange(len(si)) - start < k]


def positives(a: Vectors, b: Vectors, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, score) of the k best b for each a, other than itself."""
    alive = a.ids[:, None] != b.ids[None, :]
    for level in range(len(a.levels)):
        low, high = bounds(a, b, level)
        alive &= high >= _kth(np.where(alive, low, -np.inf), k)
    i, j = np.nonzero(alive)
    s = scores(a, b, i, j)
    best = _first(i, s, b.ids[j], k)
    return i[best], j[best], s[best]


def negatives(a: Vectors, b: Vectors, wanted: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(positive, i, j, score) of the k best b of other labels in the range of each positive; wanted: positives' scores, NaN where there is none."""
    alive = (a.labels[:, None] != b.labels[None, :]) & (a.ids[:, None] != b.ids[None, :])
    least, most = LOW * wanted / 100, HIGH * wanted / 100
    for level in range(len(a.levels)):
        low, high = bounds(a, b, level)
        left = np.zeros_like(alive)
        for p in range(wanted.shape[1]):
            some = alive & (high >= least[:, [p]]) & (low <= most[:, [p]])
            sure = some & (low >= least[:, [p]]) & (high <= most[:, [p]])
            left |= some & (high >= _kth(np.where(sure, low, -np.inf), k))
        alive = left
    i, j = np.nonzero(alive)
    s = scores(a, b, i, j)
    for p in range(wanted.shape[1]):
        w = np.nan_to_num(wanted[i, p], nan=-1).astype(np.int64)
        fit = np.flatnonzero((LOW * w <= 100 * s) & (100 * s <= HIGH * w) & (w >= 0))
        best = fit[_first(i[fit], s[fit], b.ids[j[fit]], k)]
        yield p, i[best], j[best], s[best]


def _load(parts: list[pa.RecordBatch]) -> tuple[dict[int, Vectors], pa.Table, dict[int, np.ndarray]]:
    """Rows (id, label, dim, v, seg, ...) by length, sorted by label; the table, and which of its rows each length has."""
    t = pa.Table.from_batches(parts)
    ids, labels, dims = (t[c].to_numpy() for c in ("id", "label", "dim"))
    out, rows = {}, {}
    for d in np.unique(dims).tolist():
        mine = np.flatnonzero(dims == d)
        mine = mine[np.argsort(labels[mine], kind="stable")]
        some = t.take(pa.array(mine))
        out[d], rows[d] = Vectors(ids[mine], labels[mine], some["v"].to_pylist(), some["seg"].to_pylist()), mine
    return out, t, rows


def _in_blocks(rows: DataFrame, anchors: DataFrame, blocks: int, more: str) -> DataFrame:
    """Index rows and, in each block, all anchors, sorted for index_and_queries."""
    spark = rows.sparkSession
    shape = ["block", "side", "id", "label", "dim", "v", "seg", "anchor", more]
    own = F.pmod(F.xxhash64("id", "v"), F.lit(blocks)).cast("int")
    index = rows.select(own.alias("block"), F.lit(0).alias("side"), "id", "label", "dim", "v", "seg", F.lit(None).cast("long").alias("anchor"), F.lit(None).cast("array<long>").alias(more))
    sent = anchors.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("side", F.lit(1)).select(*shape)
    n = max(1, min(4 * partitions(spark), blocks))
    return index.unionByName(sent).repartition(n, "block").sortWithinPartitions("block", "side", "dim", "label")


def _first_of(found: DataFrame, keys: list[str], k: int, score: Column, by: Column) -> DataFrame:
    return found.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(score.desc(), by))).filter(F.col("rank") <= k)


def hard_negatives(vectors: DataFrame, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding", is_anchor: Column | None = None, label: Column | None = None, n_positives: int = POSITIVES, n_negatives: int = NEGATIVES) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score. is_anchor: a condition on id; label: the label to use, an
    expression on the table."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), (F.col(label_col) if label is None else label).cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = stored(prepared(rows))
    key = F.xxhash64("id", "label", "v").alias("anchor")
    anchors = stored(rows.filter(F.lit(True) if is_anchor is None else is_anchor).dropDuplicates(["id", "label", "v"]).select("*", key))
    blocks = max(1, -(-rows.count() // BLOCK))

    def find_positives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for index, queries in index_and_queries(batches, 1, PORTION):
            if index is not last:
                last, (held, _, _) = index, _load(index)
            asked, t, where = _load(queries)
            names = t["anchor"].to_numpy()
            for d, a in asked.items():
                if d not in held:
                    continue
                b = held[d]
                for one in np.unique(a.labels).tolist():
                    x, y = np.searchsorted(b.labels, [one, one + 1])
                    mine = np.flatnonzero(a.labels == one)
                    if x < y:
                        i, j, s = positives(a.of(mine), b.of(slice(x, y)), n_positives)
                        yield pa.RecordBatch.from_arrays([pa.array(names[where[d][mine[i]]]), pa.array(b.ids[x:y][j]), pa.array(s)], names=["anchor", "positive_id", "positive_score"])

    def find_negatives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for index, queries in index_and_queries(batches, 1, PORTION):
            if index is not last:
                last, (held, _, _) = index, _load(index)
            asked, t, where = _load(queries)
            names, lists = t["anchor"].to_numpy(), t["positives"].to_pylist()
            for d, a in asked.items():
                if d not in held:
                    continue
                wanted = np.full((len(a.ids), n_positives), np.nan)
                for r, at in enumerate(where[d].tolist()):
                    wanted[r, : len(lists[at])] = lists[at]
                for p, i, j, s in negatives(a, held[d], wanted, n_negatives):
                    yield pa.RecordBatch.from_arrays([pa.array(names[where[d][i]]), pa.array(np.full(len(i), p, np.int32)), pa.array(held[d].ids[j]), pa.array(s)], names=["anchor", "place", "negative_id", "negative_score"])

    empty = F.lit(None).cast("array<long>").alias("positives")
    near = _in_blocks(rows, anchors.select("*", empty), blocks, "positives").mapInArrow(find_positives, "anchor long, positive_id long, positive_score long")
    near = stored(_first_of(near, ["anchor"], n_positives, F.col("positive_score"), F.col("positive_id")).withColumn("place", F.col("rank") - 1))
    lists = near.groupBy("anchor").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "positive_score"))), lambda x: x["positive_score"]).alias("positives"))  # at most n_positives
    asked = stored(anchors.join(lists, "anchor"))
    far = _in_blocks(rows, asked, blocks, "positives").mapInArrow(find_negatives, "anchor long, place int, negative_id long, negative_score long")
    far = _first_of(far, ["anchor", "place"], n_negatives, F.col("negative_score"), F.col("negative_id"))
    out = stored(far.join(near.select("anchor", "place", "positive_id", "positive_score"), ["anchor", "place"]).join(anchors.select("anchor", F.col("id").alias("anchor_id")), "anchor").select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score"))
    free(rows, anchors, near, asked)
    return out


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings"), is_anchor=F.col("id") % 100 == 0, label=label)


QUERIES = {"op13_hard_negatives": op13_hard_negatives}
SQL = {
    "op13_hard_negatives": """WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pair AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score FROM r a JOIN r b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE a.vec_id % 100 = 0),
pos AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM pair WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
neg AS (SELECT anchor_id, positive_id, id AS negative_id, positive_score, score AS negative_score, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) AS INTEGER) AS rank
FROM pos JOIN pair USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM neg WHERE rank <= 5"""
}
