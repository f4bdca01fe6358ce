"""Mixing by soft membership: rates for documents whose expected domain totals match targets.

Two classifiers learnt from the labelled table give each document posteriors of three domains: toxic,
and of the rest good or poor by quality. A document of t tokens with posteriors p adds rate * t * p to the
domains. Rates start at 1 and follow projected gradients of the squared difference between the domains' totals and
their targets, each domain weighted by the inverse of the second moments of t * p: one step adds p . g to a document's rate, with g the same for all, and
then puts rates under the least back to it. A second direction takes the moments of the documents above the least only; of several lengths
of both the step with the smallest squares is kept, so the squares never grow. A rate is repeated from the steps so far, three numbers each: a
step is one distributed sum of totals and moments, and nothing of a document reaches the driver. Targets out of reach
give a RuntimeWarning with the shares met.

Targets are shares of a total that, unless given, is the least at which no domain has to shrink, or, with a least rate
above 0, the one that the rates come to. Nulls count as
empty texts and have no tokens. Repeated rows count each for itself, also those without an id. Very long texts count whole; columns
besides the id and the text are not read, so their names can't clash. An empty table gives an
empty result; a domain without tokens is left out. Classifiers are fitted on a bounded sample
(SAMPLE labelled ids); all else covers all documents.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from archivist.llm.common import fresh, stored, table
from archivist.llm.toxicity import fit, labelled_sample, with_scores

DOMAINS = ("good", "poor", "toxic")
TARGETS = {"good": 0.80, "poor": 0.15, "toxic": 0.05}
PASSES, CLOSE = 100, 1e-3
#: Lengths of a step that one pass tries: along the gradient (1 never overshoots), and scaled by the documents above the least.
_TRIES, _FREE_TRIES = (1.0, 2.0, 4.0, 16.0), (1.0, 0.5, 0.25)
#: Labelled ids that the classifiers are fitted on, at most.
SAMPLE = 5000


def posteriors(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, good, poor, toxic): tokens are words; the posteriors add up to 1."""
    sample = labelled_sample(docs, labels, ["toxic", "quality"], id_col, text_col, SAMPLE)
    models = {"_t": fit(sample, "toxic"), "_q": fit(sample.filter("toxic = 0"), "quality")}
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    words = F.regexp_count("text", F.lit(r"[^\s]+")).cast("long")
    t, q = F.col("_t"), F.col("_q")
    return with_scores(rows.withColumn("n_tokens", words), models).select("id", "n_tokens", ((1 - t) * q).alias("good"), ((1 - t) * (1 - q)).alias("poor"), t.alias("toxic"))


def _rates(p: np.ndarray, path: list[np.ndarray], least: float) -> tuple[np.ndarray, np.ndarray]:
    """The rates after the steps of the path, and whether the last one left them above the least."""
    rate, free = np.ones(len(p)), np.ones(len(p), bool)
    for step in path:
        rate = rate + p @ step
        free = rate > least
        rate = np.maximum(least, rate)
    return rate, free


def _sums(known: DataFrame, paths: list[list[np.ndarray]], least: float) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each path the totals of the domains, and the second moments of the rows whose rates are above the least."""
    n = len(DOMAINS)
    names = [f"s{i}" for i in range(len(paths) * (n + n * n))]

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((len(paths), n + n * n))
        for b in batches:
            p, t = b[list(DOMAINS)].to_numpy(), b["n_tokens"].to_numpy().astype(np.float64)
            for k, path in enumerate(paths):
                rate, free = _rates(p, path, least)
                total[k, :n] += (rate * t) @ p
                total[k, n:] += ((p * (t * free)[:, None]).T @ p).ravel()
        yield pd.DataFrame([total.ravel()], columns=names)

    got = known.mapInPandas(add, ", ".join(f"{x} double" for x in names)).agg(*[F.sum(x).alias(x) for x in names]).first()
    return [(r[:n], r[n:].reshape(n, n)) for r in np.array([x or 0.0 for x in got]).reshape(len(paths), -1)]


def fit_rates(known: DataFrame, targets: dict[str, float] | None = None, total: float | None = None, least: float = 0.0) -> tuple[DataFrame, np.ndarray]:
    """Stored posteriors with a rate of at least `least` for each row, and the totals aimed at."""
    share = np.array([(targets or TARGETS)[d] for d in DOMAINS])
    share = share / share.sum()
    paths: list[list[np.ndarray]] = [[]]
    sums = _sums(known, paths, least)
    natural, every = sums[0]
    some = natural > 0
    there = some & (share > 0)
    follows = least > 0 and total is None  # the total is what the rates make it
    size = total if total is not None else (natural[there] / share[there]).max(initial=0.0)
    part = np.where(some, share, 0.0) / max(share[some].sum(), 1e-9)
    across = np.diag(some.astype(float)) @ (np.eye(len(DOMAINS)) - np.outer(part, np.ones(len(DOMAINS))) * follows)

    def scaled(moments: np.ndarray) -> np.ndarray:
        return np.linalg.pinv(across @ moments @ across.T, rcond=1e-10)

    def aimed(now: np.ndarray) -> np.ndarray:
        return part * now.sum() if follows else share * size

    def missing(now: np.ndarray) -> np.ndarray:
        return np.where(some, aimed(now) - now, 0.0)

    weight, low = scaled(every), np.inf
    for _ in range(PASSES):
        squares = [float(missing(now) @ weight @ missing(now)) for now, _ in sums]
        k = int(np.argmin(squares))
        path, (now, moments) = paths[k], sums[k]
        gap = np.abs(missing(now)[there] / aimed(now)[there]).max(initial=0.0)
        if gap < CLOSE or squares[k] >= low * (1 - 1e-6):
            break
        low = squares[k]
        down, free = (across.T @ w @ missing(now) for w in (weight, scaled(moments)))
        paths = [[*path, x * step] for step, tries in ((down, _TRIES), (free, _FREE_TRIES)) for x in tries]
        sums = _sums(known, paths, least)
    if gap >= CLOSE:
        met = ", ".join(f"{d} {x:.4g} of {a:.4g}" for d, x, a in zip(DOMAINS, now, aimed(now), strict=True))
        warnings.warn(f"mixing targets are out of reach; tokens met: {met}", RuntimeWarning, stacklevel=2)
    rate = F.pandas_udf(lambda g, p, t: pd.Series(_rates(np.stack([g, p, t], 1), path, least)[0]), "double")
    return known.withColumn("rate", rate(*DOMAINS)), aimed(now)


def mixed(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.0) -> DataFrame:
    """(id, n_tokens, good, poor, toxic, rate) of each row."""
    return fit_rates(stored(posteriors(docs, labels, id_col, text_col)), least=least)[0]


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).withColumnRenamed("id", "doc_id")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: each document as often as its rate says, at least once, as the fit allows for; the fraction is decided by a hash of its id.

    Rows of one id share the largest of their rates; rows without an id stay once. Null and empty texts have no tokens and rates as their
    posteriors say. Repeated rows are multiplied each for itself. Columns may have any names. An empty table stays empty."""
    i, rate, copies, k = fresh(docs, "_id", "_rate", "_copies", "_k")
    rates = mixed(docs, table(spark, sf_dir, "labels"), least=1.0).filter("id is not null").groupBy(F.col("id").alias(i)).agg(F.max("rate").alias(rate))
    chance = F.pmod(F.xxhash64(i), F.lit(1_000_000)) / 1_000_000
    times = F.greatest(F.lit(1), (F.floor(rate) + (chance < F.col(rate) - F.floor(rate)).cast("int")).cast("int"))
    joined = docs.join(rates, docs["doc_id"].cast("long") == F.col(i), "left").withColumn(copies, F.coalesce(times, F.lit(1)))
    return joined.withColumn(k, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*docs.columns)


QUERIES = {"op5_mixing": op5_mixing}
SQL: dict[str, str] = {}
