"""Linear classifier over character n-grams scaled by naive Bayes log-count ratios.

A text is lower-cased and white space becomes a space. Its features are the distinct 5- and 7-grams,
hashed to BUCKETS. For a labelled sample of at most SAMPLE rows (a documented bound; the rows with the
smallest hashes of their ids), the documents that hold each feature are counted by class on the
executors. Every feature's ratio is r = log((p + 1) / (n_p + 2)) - log((q + 1) / (n_q + 2)); the FEATURES
with the clearest difference keep a weight w, fitted by logistic regression on x * r, and the score
is sigmoid(b + sum of w * r over a text's features). The model is one table of BUCKETS floats.

Nulls count as empty texts; an empty text gets the score of the bias. Several labels of one id count
as the largest, labels above 1 as 1; null and negative labels and null ids aren't learnt from, of an id with several texts the least is. With no labels at all, or one class only, every
score is the share of label 1 (0.5 with no labels). Repeated rows are scored each for itself, equal texts alike.
Very long texts are scored whole. Other columns stay, whatever their names. An empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from archivist.llm.common import fresh, gives_back, stored, table

BUCKETS, SIZES = 1 << 19, (5, 7)
SAMPLE, FEATURES, THRESHOLD = 16_000, 20_000, 0.7
_CHUNK = 1 << 20


@dataclass
class Model:
    bias: float
    weights: np.ndarray  # w * r by bucket


def _grams(texts: list[str]) -> Iterator[tuple[int, np.ndarray]]:
    """For each n: (n, bucket of the n-gram at each place of the texts in a row)."""
    chars = np.frombuffer("".join(texts).encode("utf-32-le", "replace"), "<u4")
    h = np.zeros(len(chars), np.uint32)
    for n in range(1, max(SIZES) + 1):
        m = len(chars) - n + 1
        if m <= 0:
            return
        h = h[:m] * np.uint32(0x01000193)
        h ^= chars[n - 1 :] * np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(15)
        if n in SIZES:
            yield n, (h * np.uint32(0x85EBCA6B + 2 * n)) >> np.uint32(32 - 19)


def _chunks(texts: list[str], features: int) -> Iterator[tuple[int, list[str]]]:
    """Runs of texts of about _CHUNK characters, and of no more texts than bits for so many features are worth; a longer text is a run of its own."""
    at, n, most = 0, 0, max(1, (1 << 24) // max(features, 1))
    for i, t in enumerate(texts):
        if i > at and (n + len(t) > _CHUNK or i - at >= most):
            yield at, texts[at:i]
            at, n = i, 0
        n += len(t)
    if at < len(texts):
        yield at, texts[at:]


def _features(texts: list[str], slots: np.ndarray, features: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) of each distinct feature of each text, ascending. slots: the feature of a bucket, or -1."""
    low = [" ".join(t.lower().split()) for t in texts]
    ends = np.cumsum([len(t) for t in low])
    mark = np.zeros(len(texts) * features, bool)
    for n, bucket in _grams(low):
        slot = slots[bucket]
        on = np.flatnonzero(slot >= 0)
        doc = np.searchsorted(ends, on, "right")
        inside = on + n <= ends[doc]
        mark[doc[inside] * features + slot[on[inside]]] = True
    f = np.flatnonzero(mark)
    return f // max(features, 1), f % max(features, 1)


def _slots(keep: np.ndarray) -> np.ndarray:
    return np.where(keep, np.cumsum(keep) - 1, -1).astype(np.int32)


def labelled_sample(docs: DataFrame, labels: DataFrame, columns: list[str], id_col: str = "doc_id", text_col: str = "text", bound: int = SAMPLE) -> DataFrame:
    """text and label columns of at most `bound` rows, one for each labelled id: its least text. Stored."""
    label = lambda c: F.max(F.when(F.col(c) > 0, 1).when(F.col(c) == 0, 0)).alias(f"_{c}")
    one = labels.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("_id")).agg(*[label(c) for c in columns])
    some = one.orderBy(F.xxhash64("_id"), "_id").limit(bound)
    texts = docs.select(F.col(id_col).cast("long").alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    known = texts.join(F.broadcast(some), "_id")  # broadcast: at most `bound` rows
    return stored(known.groupBy("_id").agg(F.min("text").alias("text"), *[F.first(f"_{c}").alias(c) for c in columns]).drop("_id"))


def fit(sample: DataFrame, label: str) -> Model:
    """Fit on a stored sample with text and label (0, 1 or null)."""
    spark = sample.sparkSession
    rows = sample.filter(F.col(label).isNotNull()).select("text", label)

    @gives_back
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got, every, n = np.zeros((2, BUCKETS), np.int32), np.arange(BUCKETS, dtype=np.int32), np.zeros(2, np.int64)
        for b in batches:
            y = np.array(b.column(1).to_pylist(), np.int64)
            for at, texts in _chunks(b.column(0).to_pylist(), BUCKETS):
                doc, f = _features(texts, every, BUCKETS)
                kind = y[at + doc]
                for k in (0, 1):
                    np.add.at(got[k], f[kind == k], np.int32(1))
            n += np.bincount(y, minlength=2)
        step = 1 << 13
        for k in (0, 1) if n.any() else ():
            yield pa.RecordBatch.from_arrays([pa.array([k] * (BUCKETS // step)), pa.array(range(0, BUCKETS, step)), pa.array([got[k, i : i + step].tobytes() for i in range(0, BUCKETS, step)], pa.binary()), pa.array([int(n[k])] * (BUCKETS // step))], names=["kind", "at", "counts", "n"])

    def add(pdf):
        total = np.sum([np.frombuffer(c, np.int32) for c in pdf["counts"]], axis=0, dtype=np.int32)
        return pdf.head(1).assign(counts=[total.tobytes()], n=[int(pdf["n"].sum())])

    shape = "kind long, at long, counts binary, n long"
    parts = rows.mapInArrow(count, shape).groupBy("kind", "at").applyInPandas(add, shape).collect()  # 2 * BUCKETS counts, whatever the input
    df, size = np.zeros((2, BUCKETS)), np.zeros(2)
    for p in parts:
        c = np.frombuffer(p["counts"], np.int32)
        df[p["kind"], p["at"] : p["at"] + len(c)] = c
        size[p["kind"]] = p["n"]
    if not size.all():
        share = float(np.clip(size[1] / size.sum(), 1e-3, 1 - 1e-3)) if size.sum() else 0.5
        return Model(float(np.log(share / (1 - share))), np.zeros(BUCKETS, np.float32))
    p, q = (df[1] + 1) / (size[1] + 2), (df[0] + 1) / (size[0] + 2)
    r = np.log(p) - np.log(q)
    clear = np.where(df.sum(0) >= 3, np.abs(p - q) / np.sqrt(p * (1 - p) / size[1] + q * (1 - q) / size[0]), 0)
    chosen = np.sort(np.argsort(-clear, kind="stable")[:FEATURES])
    chosen = chosen[clear[chosen] > 2.5]
    keep = np.zeros(BUCKETS, bool)
    keep[chosen] = True
    sent = spark.sparkContext.broadcast(_slots(keep))
    many = len(chosen)

    @gives_back
    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            y, found = b.column(1), []
            for _, texts in _chunks(b.column(0).to_pylist(), many):
                doc, f = _features(texts, sent.value, many)
                cut = np.searchsorted(doc, np.arange(1, len(texts)))
                found += [x.astype(np.int32).tobytes() for x in np.split(f, cut)]
            yield pa.RecordBatch.from_arrays([y, pa.array(found, pa.binary())], names=["y", "f"])

    data = rows.mapInArrow(extract, "y int, f binary").collect()  # at most SAMPLE rows of at most FEATURES features
    data.sort(key=lambda d: (d["y"], d["f"]))
    y = np.array([d["y"] for d in data], float)
    found = [np.frombuffer(d["f"], np.int32) for d in data]
    row = np.repeat(np.arange(len(data), dtype=np.int32), [len(f) for f in found])
    column = np.concatenate(found)
    del data, found
    x = np.clip(r[chosen], -8, 8)
    scale = 1 / max(1.0, float(np.sqrt(np.bincount(row, weights=x[column] ** 2, minlength=len(y)).mean())))
    w, b = np.zeros(len(chosen)), float(np.log(y.mean() / (1 - y.mean())))
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for t in range(1, 101):  # Adam over the whole sample
        z = b + np.bincount(row, weights=(w * x * scale)[column], minlength=len(y))
        e = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / len(y)
        g = x * scale * np.bincount(column, weights=e[row], minlength=len(w)) + 1e-6 * w
        gb = e.sum()
        m, v, mb, vb = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g, 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        w -= 0.3 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        b -= 0.1 * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.99**t)) + 1e-8)
    weights = np.zeros(BUCKETS, np.float32)
    weights[chosen] = w * x * scale
    return Model(float(b), weights)


def with_scores(df: DataFrame, models: dict[str, Model], text_col: str = "text") -> DataFrame:
    """The rows with one more column of scores (0 to 1) for each model."""
    names = list(models)
    keep = np.logical_or.reduce([m.weights != 0 for m in models.values()])
    many, made = int(keep.sum()), fresh(df, "_scores")[0]
    sent = df.sparkSession.sparkContext.broadcast((_slots(keep), {k: (m.bias, m.weights[keep]) for k, m in models.items()}))

    @F.pandas_udf(", ".join(f"{n} double" for n in names))
    def score(texts):
        import pandas as pd

        out = np.zeros((len(texts), len(names)))
        slots, each = sent.value
        for at, part in _chunks(texts.fillna("").tolist(), many):
            doc, f = _features(part, slots, many)
            for k, n in enumerate(names):
                bias, weights = each[n]
                z = bias + np.bincount(doc, weights=weights[f], minlength=len(part))
                out[at : at + len(part), k] = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        return pd.DataFrame(out, columns=names)

    return df.withColumn(made, score(F.col(text_col).cast("string"))).select(*df.columns, *[F.col(f"{made}.{n}").alias(n) for n in names])


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


def toxic_model(docs: DataFrame, labels: DataFrame) -> Model:
    """Learnt from the labels that aren't held out."""
    return fit(labelled_sample(docs, labels.filter(~held_out()), ["toxic"]), "toxic")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    rows = with_scores(docs.select("doc_id", "text"), {"score": toxic_model(docs, labels)})
    return rows.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that the classifier doesn't reject, with their columns.

    Rows with a null or empty text get the score of the bias and stay with it. Rows without an id are judged by their text as any other.
    Repeated rows are judged each for itself, alike where texts are equal; very long texts whole. Columns may have any names. An
    empty table stays empty."""
    toxic = fresh(docs, "_toxic")[0]
    rows = with_scores(docs, {toxic: toxic_model(docs, table(spark, sf_dir, "labels"))})
    return rows.filter(F.col(toxic) < THRESHOLD).drop(toxic)


QUERIES = {"op7_toxicity": op7_toxicity}
SQL: dict[str, str] = {}
