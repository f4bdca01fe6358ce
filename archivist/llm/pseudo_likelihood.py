"""Masked pseudo-likelihood of documents under a bidirectional window network.

The network sees the WINDOW words on each side of a place, never the word itself, and predicts it: the sum of a
row for each neighbour goes through tanh, and a softmax over classes of words times one over the words of
the class gives the conditional probability. A document's score is the sum of their logarithms.

The vocabulary are all words of the corpus, counted by a shuffle. The most frequent have an entry of the network each, the
others share OTHERS hashed ones: such a word has its entry's probability times its share of the entry's count, joined from
the counts, which stay distributed. Texts become ids once, and all later passes read these. Training is local gradient descent in
numpy on all documents: they are dealt to shards by a hash of id and words, a shard for each SHARD words, and the shards'
parameters are averaged, weighted by their words, ROUNDS times. So the table's partitions don't change the network.

Nulls count as empty texts; a text without words has score 0 and a null mean. Repeated rows are scored each for
itself, and rows without an id as any other. Very long texts are read and scored whole. Only the id and the text column are read, so other columns can't clash. An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from archivist.llm.common import stored, table

SIDE, WIDE, WINDOW, OTHERS = 64, 32, 2, 64
VOCABULARY = SIDE * SIDE
#: Distinct words that a worker counts before it passes them on.
HELD = 200_000
ROUNDS, BATCH, RATE = 2, 2048, 0.5
#: Words of a shard that is trained on by itself.
SHARD = 2_000_000
#: Networks that are averaged in one group.
FAN = 16
_OFFSETS = [*range(-WINDOW, 0), *range(1, WINDOW + 1)]
_SHAPES = {"e": (len(_OFFSETS), VOCABULARY + 1, WIDE), "b": (WIDE,), "wc": (WIDE, SIDE), "bc": (SIDE,), "wj": (WIDE, SIDE), "bj": (SIDE, SIDE)}


class Words(dict):
    """Ids of the vocabulary's words; any other word's by its hash."""

    def __missing__(self, word: str) -> int:
        return VOCABULARY - 1 - zlib.crc32(word.encode("utf-8", "replace")) % OTHERS

    def ids(self, text: str) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, text.lower().split()), np.int32)


def counted(docs: DataFrame) -> DataFrame:
    """(w, n): every word of the documents and how often it occurs, stored."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[str] = Counter()
        for b in batches:
            for t in b.column(0).to_pylist():
                found.update(t.lower().split())
            if len(found) >= HELD:
                yield _counts(found)
                found.clear()
        yield _counts(found)

    return stored(docs.select("text").mapInArrow(count, "w string, n long").groupBy("w").agg(F.sum("n").alias("n")))


def _counts(found: Counter[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["w", "n"])


def vocabulary(docs: DataFrame, counts: DataFrame | None = None) -> Words:
    """The words with an entry of their own, from counts over all words of all documents."""
    top = (counted(docs) if counts is None else counts).orderBy(F.desc("n"), "w").limit(VOCABULARY - OTHERS).collect()
    return Words({r["w"]: i for i, r in enumerate(top)})


def log_shares(counts: DataFrame, words: Words) -> DataFrame:
    """(w, log_share): each counted word without an own entry and its share of the words of its entry."""
    known = counts.sparkSession.createDataFrame([(w,) for w in words], "w string")
    rare = counts.join(F.broadcast(known), "w", "left_anti").withColumn("_entry", F.crc32(F.col("w").cast("binary")) % OTHERS)  # one vocabulary
    totals = rare.groupBy("_entry").agg(F.sum("n").alias("_total"))
    return rare.join(F.broadcast(totals), "_entry").select("w", F.log(F.col("n") / F.col("_total")).alias("log_share"))  # OTHERS rows


def coded(docs: DataFrame, words: Words) -> DataFrame:
    """(row, id, n_words, ids, w, times), stored: the ids of each text's words, packed, and its words without an entry of their own, counted."""
    sent = docs.sparkSession.sparkContext.broadcast(dict(words))  # one vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Words(sent.value)
        others: dict[str, int] = {}  # ids of some words without an entry
        for b in batches:
            ids, rare = [], []
            for t in b.column(2).to_pylist():
                found = t.lower().split()
                x = np.fromiter((known.get(w, -1) for w in found), np.int32, len(found))
                times = Counter(found[k] for k in np.flatnonzero(x < 0).tolist())
                if len(others) > HELD:
                    others.clear()
                for w in times:
                    if w not in others:
                        others[w] = known[w]
                if times:
                    x[x < 0] = [others[found[k]] for k in np.flatnonzero(x < 0).tolist()]
                ids.append(x.astype(np.uint16).tobytes())
                rare.append(times)
            n = [len(x) // 2 for x in ids]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(ids, pa.binary()), pa.array([list(r) for r in rare], pa.list_(pa.string())), pa.array([list(r.values()) for r in rare], pa.list_(pa.int32()))], names=["row", "id", "n_words", "ids", "w", "times"])

    rows = docs.select(F.monotonically_increasing_id().alias("row"), "id", "text")
    return stored(rows.mapInArrow(run, "row long, id long, n_words long, ids binary, w array<string>, times array<int>"))


def _runs(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x, np.uint16).astype(np.int32) for x in column.to_pylist()]


def start() -> dict[str, np.ndarray]:
    rnd = np.random.default_rng(7)
    return {k: (rnd.standard_normal(s) * (0.1 if k in ("e", "wc", "wj") else 0)).astype(np.float32) for k, s in _SHAPES.items()}


def neighbours(runs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """All words of the runs, and for each the ids around it; VOCABULARY stands for the end of a text."""
    pad = np.full(WINDOW, VOCABULARY, np.int32)
    line = np.concatenate([pad, *(x for r in runs for x in (r, pad))])
    at = np.concatenate([np.arange(len(r)) + s for r, s in zip(runs, np.cumsum([WINDOW, *(len(r) + WINDOW for r in runs[:-1])]), strict=True)]) if runs else np.empty(0, np.int64)
    return line[at], np.stack([line[at + o] for o in _OFFSETS])


def forward(p: dict[str, np.ndarray], words: np.ndarray, around: np.ndarray):
    """The hidden layer, the class and the place in it of each word, and for both the probabilities and the word's own logarithm."""
    table = p["e"].reshape(-1, WIDE)
    h = p["b"] + table.take(around[0], 0)
    for k in range(1, len(_OFFSETS)):
        h += table.take(around[k] + np.int32(k * (VOCABULARY + 1)), 0)
    h = np.tanh(h, out=h)
    c, j = words // SIDE, words % SIDE
    both = h @ np.concatenate([p["wc"], p["wj"]], 1)
    both[:, :SIDE] += p["bc"]
    both[:, SIDE:] += p["bj"].take(c, 0)
    both = both.reshape(-1, 2, SIDE)
    if both.size and max(both.max(), -both.min()) > 60:  # else neither powers nor their sums leave the range of floats
        both -= both.max(2, keepdims=True)
    row = np.arange(len(words))
    own = np.stack([both[row, 0, c], both[row, 1, j]])
    np.exp(both, out=both)
    z = (both.reshape(-1, SIDE) @ np.ones(SIDE, np.float32)).reshape(-1, 2)
    own -= np.log(z.T)
    both /= z[:, :, None]
    return h, c, j, [(both[:, 0], own[0]), (both[:, 1], own[1])]


def _sums(x: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """Sums of the runs of rows that start at cut. Pairs of floats are added as complex numbers, in half the steps."""
    size = np.diff(np.r_[cut, len(x)])
    out, more = x.take(cut, 0), size > 1
    if more.any():
        more = np.flatnonzero(more)
        runs = x.take(np.flatnonzero(np.repeat(size > 1, size)), 0)
        out[more] = np.add.reduceat(runs.view(np.complex64), np.cumsum(size[more]) - size[more], axis=0).view(np.float32)
    return out


def step(p: dict[str, np.ndarray], words: np.ndarray, around: np.ndarray, rate: float) -> float:
    """One descent step on a batch; returns the mean log-probability before it."""
    o = np.argsort(words.astype(np.uint16), kind="stable")
    words, around = words[o], around[:, o]
    h, c, j, ((pc, lc), (pj, lj)) = forward(p, words, around)
    n = len(words)
    row, each = np.arange(n), np.full(n, rate / n, np.float32)
    pc[row, c] -= 1
    pj[row, j] -= 1
    both = pc.base.reshape(n, 2 * SIDE)
    gh = (both @ np.concatenate([p["wc"], p["wj"]], 1).T) * (1 - h * h)
    g = np.float32(rate / n) * (h.T @ both)
    p["wc"] -= g[:, :SIDE]
    p["wj"] -= g[:, SIDE:]
    p["bc"] -= (each @ both)[:SIDE]
    cut = np.flatnonzero(np.r_[True, c[1:] != c[:-1]])
    p["bj"][c[cut]] -= np.float32(rate / n) * np.add.reduceat(both.view(np.complex64)[:, SIDE // 2 :], cut, axis=0).view(np.float32)
    p["b"] -= each @ gh
    ids = (around + np.arange(len(_OFFSETS), dtype=np.int32)[:, None] * (VOCABULARY + 1)).ravel()
    o = np.argsort(ids.astype(np.uint16), kind="stable")  # all rows of all offsets at once
    ids = ids[o]
    cut = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
    size = np.diff(np.r_[cut, len(ids)])[:, None]
    p["e"].reshape(-1, WIDE)[ids[cut]] -= _sums(gh.take(o % n, 0), cut) * (rate / np.sqrt(size * n / 16)).astype(np.float32)  # rows of rare words take larger steps
    return float((lc + lj).mean())


def _flat(p: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([p[k].ravel() for k in _SHAPES])


def _named(v: np.ndarray) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k, s in _SHAPES.items():
        n = int(np.prod(s))
        out[k] = v[at : at + n].reshape(s).copy()
        at += n
    return out


def train(docs: DataFrame, words: Words, share: int = 1, rounds: int = ROUNDS) -> dict[str, np.ndarray]:
    """Parameters averaged over the shards of rows (id, text), or of what coded() made of them. A share above 1 holds documents
    back, by a hash of the id."""
    spark = docs.sparkSession
    some = docs if "ids" in docs.columns else coded(docs, words)
    if share > 1:
        some = some.filter(F.pmod(F.xxhash64("id"), F.lit(share)) == 0)
    shards = -(-(some.agg(F.sum("n_words").alias("n")).first()["n"] or 0) // SHARD) or 1
    some = some.select("ids", F.xxhash64("id", "ids").alias("at")).repartition(shards, "at").coalesce(shards).sortWithinPartitions("at", "ids").select("ids")  # every shard sends a whole network
    size = len(_flat(start()))
    cut = 1 << 15
    now = start()
    for r in range(rounds):
        sent = spark.sparkContext.broadcast(_flat(now))  # one network

        def fit(batches: Iterator[pa.RecordBatch], rate: float = RATE / (r + 1), sent=sent) -> Iterator[pa.RecordBatch]:
            p, n = _named(sent.value), 0
            rnd = np.random.default_rng(1)
            for b in batches:
                w, around = neighbours(_runs(b.column(0)))
                o = rnd.permutation(len(w))
                for k in range(0, len(o), BATCH):
                    step(p, w[o[k : k + BATCH]], around[:, o[k : k + BATCH]], rate)
                n += len(w)
            if n:
                v = _flat(p)
                at = range(0, size, cut)
                yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array([n] * len(at), pa.int64()), pa.array([v[i : i + cut].tobytes() for i in at], pa.binary())], names=["at", "n", "v"])

        def averaged(width: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
            def average(g: pd.DataFrame) -> pd.DataFrame:
                w = g["n"].to_numpy(np.float64)
                v = sum(np.frombuffer(x, np.float32) * k for x, k in zip(g["v"], w, strict=True)) / w.sum()
                return pd.DataFrame({"at": [g["at"].iloc[0]], "n": [int(w.sum())], "v": [v.astype(np.float32).tobytes()], "salt": [int(g["salt"].iloc[0]) % width]})

            return average

        shape = "at long, n long, v binary"
        widths = [1]
        while widths[-1] * FAN < shards:
            widths.append(widths[-1] * FAN)
        merged = some.mapInArrow(fit, shape).withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(widths[-1])))
        for width in reversed(widths):  # a tree over the shards, with some FAN networks in a group
            merged = merged.groupBy("at", F.pmod("salt", F.lit(width))).applyInPandas(averaged(width), shape + ", salt long")
        v = _flat(now)
        for x in merged.collect():  # the parameters once
            part = np.frombuffer(x["v"], np.float32)
            v[x["at"] : x["at"] + len(part)] = part
        now = _named(v)
    return now


def score(docs: DataFrame, words: Words, parameters: dict[str, np.ndarray], counts: DataFrame | None = None) -> DataFrame:
    """(id, n_words, log_likelihood, mean_log_likelihood) of rows (id, text), or of what coded() made of them; without counts, a word
    of a shared entry has the probability of the entry."""
    sent = docs.sparkSession.sparkContext.broadcast(_flat(parameters))
    texts = docs if "ids" in docs.columns else coded(docs, words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = _named(sent.value)
        for b in batches:
            w, around = neighbours(_runs(b.column(3)))
            logs = np.zeros(len(w))
            for k in range(0, len(w), 4096):
                *_, ((_, lc), (_, lj)) = forward(p, w[k : k + 4096], around[:, k : k + 4096])
                logs[k : k + 4096] = lc + lj
            total, end = np.r_[0.0, np.cumsum(logs)], np.cumsum(b.column(2).to_numpy())
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(total[end] - total[np.r_[0, end[:-1]]] if len(end) else [], pa.float64())], names=["row", "id", "n_words", "s"])

    rows = texts.select("row", "id", "n_words", "ids").mapInArrow(run, "row long, id long, n_words long, s double")
    log = F.col("s")
    if counts is not None:
        places = texts.select("row", F.explode(F.arrays_zip("w", "times")).alias("_p")).select("row", "_p.w", "_p.times")
        shares = places.join(log_shares(counts, words), "w").groupBy("row").agg(F.sum(F.col("times") * F.col("log_share")).alias("_more"))
        rows = rows.select("row", "id", "n_words", "s").join(shares, "row", "left")
        log = log + F.coalesce("_more", F.lit(0.0))
    return rows.select("id", "n_words", log.alias("log_likelihood")).withColumn("mean_log_likelihood", F.when(F.col("n_words") > 0, F.col("log_likelihood") / F.col("n_words")))


def pseudo_likelihood(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: int = 1) -> DataFrame:
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    counts = counted(rows)
    words = vocabulary(rows, counts)
    texts = coded(rows, words)
    return score(texts, words, train(texts, words, share), counts).withColumnRenamed("id", id_col)


def op2_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudo_likelihood(table(spark, sf_dir, "documents"))


QUERIES = {"op2_pseudo_likelihood": op2_pseudo_likelihood}
SQL: dict[str, str] = {}
