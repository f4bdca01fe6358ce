"""URL filter: rules first, then the ratio of two character language models.

Rules (host and path beginning) accept or reject what they fit. All URLs that a rule accepts train one model, all that a rule
rejects the other: variable-order Markov models over bytes with up to ORDER bytes of context. A context, and a next byte in it,
is kept while it makes up LEAST of all positions, as in a prediction suffix tree; what is rarer is left to the shorter context. Every
order is smoothed into the next by Witten and Bell's rule. What no rule fits is judged by the difference of the two
log-likelihoods per symbol, the end included.

The threshold is calibrated: each half of the known URLs (by a hash of the URL) is scored by models of the other half, and the
difference with the least sum of the two error rates is taken; of several the one nearest to 0. Counts cover all URLs. Per order
at most 1 / LEAST contexts and as many next bytes reach the driver and the tasks, whatever the input.

A null URL, or one without ://, has an empty host and path; no rule fits it, and the models judge its text (a null's is empty). Where no URL was
rejected by a rule all others are allowed, where none was accepted they are blocked. Very long URLs are
read whole. Repeated rows count and are judged each for itself, null ids stay. An empty table gives an empty result. Only the id and the URL
column are read, so other columns can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from archivist.llm.common import free, stored, table

ORDER, LEAST = 5, 1e-5
#: Width of a step of the difference when the threshold is looked for, and the farthest step.
STEP, FAR = 0.005, 20_000
#: (host and path beginning, verdict). Fixed values.
RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))
#: Bytes of URLs that a task counts at once.
HELD = 1 << 20
_SHIFT, _LOW = np.uint64(48), np.uint64((1 << 48) - 1)
#: Cells of known URLs: accepted or rejected, first or second half. Models: all, and without the half that is scored.
MODELS = ((0, 1), (1,), (0,))


def host_and_path(url: Column) -> tuple[Column, Column]:
    after = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    host, path = (F.coalesce(F.regexp_extract(after, p, 1), F.lit("")) for p in ("^([^/?#]*)", "^[^/?#]*([^?#]*)"))
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def fitting(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; nulls where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r, v in sorted(rules, key=lambda x: len(x[0])):
        h, slash, p = r.partition("/")
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(slash + p)
        rule, verdict = F.when(fits, r).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def _grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each order the grams (context and next byte, with the order above them), at each place of \\0 text \\0; the place
    within its text, and the text. A gram of order k is one where the place is k or more, and not 0."""
    size = np.array([len(t) + 2 for t in texts], np.int64)
    b = np.frombuffer(b"".join(b"\0" + t + b"\0" for t in texts), np.uint8).astype(np.uint64)
    of = np.repeat(np.arange(len(texts)), size)
    at = np.arange(len(b)) - np.repeat(np.cumsum(size) - size, size)
    out, g = np.empty((ORDER + 1, len(b)), np.uint64), b.copy()
    for k in range(ORDER + 1):
        if k:
            g[k:] |= b[:-k] << np.uint64(8 * k)
        out[k] = g | (np.uint64(k) << _SHIFT)
    return out, at, of


def _context(g: np.ndarray) -> np.ndarray:
    return ((g & _LOW) >> np.uint64(8)) | (g >> _SHIFT << _SHIFT)


def counted(known: DataFrame) -> DataFrame:
    """(g, c0 .. c3) of rows (text binary, cell int): how often each gram occurs in the URLs of each cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[bytes]] = [[], [], [], []]
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for cell, texts in enumerate(held):
                if texts:
                    grams, at, _ = _grams(texts)
                    for k in range(ORDER + 1):
                        g, n = np.unique(grams[k][at >= max(k, 1)], return_counts=True)
                        yield pa.RecordBatch.from_arrays([pa.array(g.astype(np.int64)), pa.array(np.full(len(g), cell, np.int32)), pa.array(n.astype(np.int64))], names=["g", "cell", "n"])
                    texts.clear()

        for b in batches:
            for t, cell in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                held[cell].append(t)
                size += len(t)
                if size >= HELD:
                    yield from flush()
                    size = 0
        yield from flush()

    each = known.select("text", "cell").mapInArrow(run, "g long, cell int, n long")
    return each.groupBy("g").agg(*[F.sum(F.when(F.col("cell") == c, F.col("n")).otherwise(0)).alias(f"c{c}") for c in range(4)])


def _sums(cells: list[Column], f) -> list[Column]:
    """f over the cells of each model: accepted and rejected, of all and of either half."""
    return [f(reduce(lambda x, y: x + y, [cells[2 * side + half] for half in halves])) for side in (0, 1) for halves in MODELS]


class Ratio:
    """The kept part of all models: grams with their share in the counts, contexts with what they leave to shorter ones."""

    def __init__(self, grams: DataFrame):
        cells = [F.col(f"c{c}") for c in range(4)]
        whole = reduce(lambda x, y: x + y, cells)
        total = grams.filter(F.shiftright("g", 48) == 0).agg(F.coalesce(F.sum(whole), F.lit(0))).first()[0]
        context = F.shiftright(F.col("g").bitwiseAND((1 << 48) - 1), 8) + F.shiftleft(F.shiftright("g", 48), 48)
        sums = [F.sum(c).alias(f"n{k}") for k, c in enumerate(_sums(cells, lambda x: x))] + [F.sum((c > 0).cast("long")).alias(f"t{k}") for k, c in enumerate(_sums(cells, lambda x: x))]
        contexts = grams.groupBy(context.alias("s")).agg(F.sum(whole).alias("_whole"), *sums).filter(F.col("_whole") >= LEAST * total).orderBy("s").toPandas()
        kept = grams.filter(whole >= LEAST * total).select("g", *[c.alias(f"n{k}") for k, c in enumerate(_sums(cells, lambda x: x))]).orderBy("g").toPandas()
        self.g, self.s = kept["g"].to_numpy(np.uint64), contexts["s"].to_numpy(np.uint64)
        seen = kept[[f"n{k}" for k in range(6)]].to_numpy(np.float64).reshape(-1, 6)
        n, t = (contexts[[f"{x}{k}" for k in range(6)]].to_numpy(np.float64).reshape(-1, 6) for x in "nt")
        at, held = np.searchsorted(self.s, _context(self.g)), np.zeros_like(n)
        np.add.at(held, at, seen)
        some = np.maximum(n + t, 1)
        # a context that a model never saw leaves all to the shorter one; the last row is one that isn't kept
        self.left = np.vstack([np.where(n > 0, (n - held + t) / some, 1), np.ones((1, 6))])
        self.share = np.vstack([seen / some[at], np.zeros((1, 6))])

    def differences(self, texts: list[bytes], which: int) -> np.ndarray:
        """By how much the accepted URLs' model of MODELS[which] finds each text likelier, per symbol."""
        if not texts:
            return np.zeros(0)
        grams, at, of = _grams(texts)
        p = np.full((2, len(at)), 1 / 256)
        both = [which, 3 + which]
        for k in range(ORDER + 1):
            here = np.flatnonzero(at >= max(k, 1))
            g, where = np.unique(grams[k][here], return_inverse=True)
            s = _context(g)
            i, j = (np.minimum(np.searchsorted(have, x), max(len(have) - 1, 0)) for have, x in ((self.g, g), (self.s, s)))
            i = np.where(self.g[i] == g, i, len(self.g)) if len(self.g) else np.zeros(len(g), np.int64)
            j = np.where(self.s[j] == s, j, len(self.s)) if len(self.s) else np.zeros(len(s), np.int64)
            for row, m in enumerate(both):
                p[row, here] = self.share[i, m][where] + self.left[j, m][where] * p[row, here]
        d = np.where(at > 0, np.log(p[0]) - np.log(p[1]), 0.0)
        return np.bincount(of, weights=d, minlength=len(texts)) / np.array([len(t) + 1 for t in texts])


def _scored(rows: DataFrame, sent, which: int | None) -> DataFrame:
    """rows with a last column text, and before it half where which is None, and the difference in place of them."""
    names = [c for c in rows.columns if c not in ("text", "half")]
    shape = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes if c in names) + ", score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(b.num_columns - 1).to_pylist()
            if which is not None:
                d = sent.value.differences(texts, which)
            else:  # by the models without the URL's own half
                half, d = np.array(b.column(b.num_columns - 2).to_pylist(), np.int64), np.zeros(len(texts))
                for h in (0, 1):
                    mine = np.flatnonzero(half == h)
                    d[mine] = sent.value.differences([texts[i] for i in mine], 1 + h)
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(names))), pa.array(d)], names=[*names, "score"])

    return rows.mapInArrow(run, shape)


def threshold(steps: list[tuple[int, int, int]]) -> float:
    """The difference from which on URLs are allowed, of (step, accepted, rejected) counts: least sum of the error rates, nearest to 0."""
    steps = sorted(steps)
    good, bad = sum(s[1] for s in steps), sum(s[2] for s in steps)
    if not good or not bad:
        return 0.0
    lost, let = 0, bad  # below a bound: accepted; from it on: rejected
    found, low = [], -FAR
    for at, a, r in [*steps, (FAR + 1, 0, 0)]:
        bound = min(max(low, 0), at)  # from the last step with URLs to this one all bounds are the same
        found.append((lost / good + let / bad, abs(bound), bound))
        lost, let, low = lost + a, let - r, at + 1
    return min(found)[2] * STEP


def filter_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES) -> DataFrame:
    """id, host, path, rule, verdict, score of each row; score is the difference of the log-likelihoods per symbol."""
    url = F.col(url_col).cast("string")
    host, path = host_and_path(url)
    rows = pages.select(F.col(id_col), host.alias("host"), path.alias("path"), F.coalesce(url, F.lit("")).cast("binary").alias("text"))
    rule, verdict = fitting(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "_given": verdict})
    half = F.pmod(F.xxhash64("text"), F.lit(2)).cast("int")
    known = rows.filter("_given is not null").select((F.col("_given") == "allow").alias("good"), half.alias("half"), "text")
    grams = stored(counted(known.select("text", (F.when(F.col("good"), 0).otherwise(2) + F.col("half")).alias("cell"))))
    model = Ratio(grams)
    sent = pages.sparkSession.sparkContext.broadcast(model)  # at most ORDER + 1 times 1 / LEAST rows
    step = F.greatest(F.lit(-FAR), F.least(F.lit(FAR), F.floor(F.col("score") / STEP))).alias("step")
    found = _scored(known, sent, None).groupBy(step).agg(F.count_if("good").alias("a"), F.count_if(~F.col("good")).alias("r")).collect()  # at most 2 FAR + 1 rows
    bound = threshold([(r["step"], r["a"], r["r"]) for r in found])
    good, bad = (any(r[x] for r in found) for x in "ar")
    free(grams)
    judged = F.lit("allow") if not bad else F.lit("block") if not good else F.when(F.col("score") >= bound, "allow").otherwise("block")
    out = _scored(rows.select(id_col, "host", "path", "rule", "_given", "text"), sent, 0)
    return out.select(id_col, "host", "path", "rule", F.coalesce("_given", judged).alias("verdict"), "score")


def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"))


QUERIES = {"op11_url_filter": op11_url_filter}
SQL: dict[str, str] = {}
