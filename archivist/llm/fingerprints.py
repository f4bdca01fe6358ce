"""Document fingerprints as invertible Bloom lookup tables of paragraph digests.

Paragraphs are content-defined: one ends at a line feed and after a word whose hash says so, on average
every fourth, so an edit changes the paragraphs around it only. The k-th copy of a paragraph counts as a paragraph of its own.
Every digest is added to three cells of (count, sum of digests, sum of check hashes). Cells of two versions
subtract; a cell with one digest left gives it away, its other cells are relieved of it, and so on until
all differing digests are recovered. Where that gets stuck both tables are built again with GROW times the
cells. Likeness is the Jaccard index of the paragraphs, from their numbers and the recovered differences;
two empty texts have likeness 1. The fingerprint is the table at its first size, in base64.

All texts of a batch are peeled in one go, each in its own cells.

Nulls count as empty texts. Ids sort ascending, nulls first, rows of one id by their text; after the
last row comes the first. Very long texts are taken whole. Only the id and the text column are read, so other columns can't clash. An empty
table gives no rows. Digests of one text have to differ, as `digests` makes them; else peeling raises a ValueError.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from archivist.llm.common import partitions, table
from archivist.llm.shingles import _SPACE, mix, powers

CELLS, GROW, HASHES = 15, 4, 3
#: Cells for each digest at which peeling can't but end, if digests differ.
ENOUGH = 64
_BYTE = np.arange(256, dtype=np.uint64) + np.uint64(1)
_SALTS = [np.uint64(s) for s in (0x8E51_2FB3_9A4C_71D5, 0xC3A5_C85C_97CB_3127, 0xB492_B66F_BE98_F273, 0x9AE1_6A3B_2F90_404F)]


def digests(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(text, digest) of all paragraphs, by text."""
    data = np.frombuffer(b"".join(t + b"\n" for t in texts), np.uint8)
    if not len(data):
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    up, down = powers(len(data) + 1)
    total = np.r_[np.uint64(0), np.cumsum(_BYTE[data] * up[: len(data)], dtype=np.uint64)]
    space = _SPACE[data]
    start = np.flatnonzero(~space & np.r_[True, space[:-1]])
    end = np.flatnonzero(space & np.r_[False, ~space[:-1]])
    word = mix((total[end] - total[start]) * down[start])
    bounds = np.cumsum([len(t) + 1 for t in texts])
    cut = np.unique(np.r_[0, end[word % np.uint64(4) == 0] + 1, np.flatnonzero(data == 10) + 1])
    a, b = cut[:-1], cut[1:]
    doc = np.searchsorted(bounds, a, "right")
    b = np.where(b == bounds[doc], b - 1, b)  # not the line feed between texts
    a, b, doc = a[b > a], b[b > a], doc[b > a]
    h = mix((total[b] - total[a]) * down[a] + (b - a).astype(np.uint64))
    o = np.lexsort((h, doc))
    h, doc = h[o], doc[o]
    new = np.r_[True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])] if len(h) else np.empty(0, bool)
    at = np.arange(len(h))
    copy = at - np.maximum.accumulate(np.where(new, at, 0)) if len(h) else at
    return doc, mix(h + copy.astype(np.uint64) * _SALTS[3])


def _places(key: np.ndarray, base: np.ndarray, part: int) -> Iterator[np.ndarray]:
    for k in range(HASHES):
        yield base + k * part + (mix(key ^ _SALTS[k]) % np.uint64(part)).astype(np.int64)


def tables(doc: np.ndarray, key: np.ndarray, n: int, cells: int, sign: int = 1, into: tuple | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(counts, sums, checks) of n tables in a row, of `cells` cells each."""
    count, total, check = into or (np.zeros(n * cells, np.int64), np.zeros(n * cells, np.uint64), np.zeros(n * cells, np.uint64))
    c = mix(key ^ _SALTS[3])
    one = np.uint64(sign % (1 << 64))
    for p in _places(key, doc * cells, cells // HASHES):
        np.add.at(count, p, sign)
        np.add.at(total, p, key * one)
        np.add.at(check, p, c * one)
    return count, total, check


def peel(parts: tuple[np.ndarray, np.ndarray, np.ndarray], n: int, cells: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(whole, text, digest, sign): which tables were emptied, and all differences recovered."""
    count, total, check = parts
    found = []
    on = np.flatnonzero(count)
    while len(on):
        c = count[on]
        one = np.abs(c) == 1
        at, c = on[one], c[one]
        s = c.astype(np.uint64)  # 1, or -1 modulo 2**64
        key = total[at] * s
        good = check[at] * s == mix(key ^ _SALTS[3])
        at, key, c = at[good], key[good], c[good]
        if not len(at):
            break
        doc = at // cells
        o = np.lexsort((key, doc))
        doc, key, c = doc[o], key[o], c[o]
        first = np.r_[True, (doc[1:] != doc[:-1]) | (key[1:] != key[:-1])]
        doc, key, c = doc[first], key[first], c[first]
        found.append((doc, key, c))
        k, s = mix(key ^ _SALTS[3]), c.astype(np.uint64)
        touched = []
        for p in _places(key, doc * cells, cells // HASHES):
            np.subtract.at(count, p, c)
            np.subtract.at(total, p, key * s)
            np.subtract.at(check, p, k * s)
            touched.append(p)
        on = np.unique(np.concatenate(touched))
        on = on[count[on] != 0]
    left = ((count != 0) | (total != 0) | (check != 0)).reshape(n, cells).any(1)
    if not found:
        return ~left, np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64)
    return ~left, *(np.concatenate(x) for x in zip(*found, strict=True))


def differences(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, digest, sign) of what differs between two versions of n texts: 1 only in a, -1 only in b."""
    out, open_, cells = [], np.arange(n), CELLS
    most = ENOUGH * max(CELLS, 1 + int((np.bincount(a[0], minlength=n) + np.bincount(b[0], minlength=n)).max(initial=0)))
    while len(open_):
        if cells > most:
            raise ValueError(f"{len(open_)} texts can't be peeled: one has a digest twice")
        index = np.full(n, -1)
        index[open_] = np.arange(len(open_))
        parts = None
        for (doc, key), sign in ((a, 1), (b, -1)):
            on = index[doc] >= 0
            parts = tables(index[doc[on]], key[on], len(open_), cells, sign, parts)
        whole, doc, key, sign = peel(parts, len(open_), cells)
        ok = whole[doc]
        out.append((open_[doc[ok]], key[ok], sign[ok]))
        open_ = open_[~whole]
        cells *= GROW
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64))


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], n: int) -> np.ndarray:
    size = np.bincount(a[0], minlength=n) + np.bincount(b[0], minlength=n)
    d = np.bincount(differences(a, b, n)[0], minlength=n)
    return np.where(size + d > 0, (size - d) / np.maximum(size + d, 1), 1.0)


def fingerprints(d: tuple[np.ndarray, np.ndarray], n: int) -> list[str]:
    count, total, check = (x.reshape(n, CELLS) for x in tables(*d, n, CELLS))
    rows = np.concatenate([count.astype("<i4").view(np.uint8).reshape(n, -1), total.astype("<u8").view(np.uint8).reshape(n, -1), check.astype("<u4").view(np.uint8).reshape(n, -1)], 1)
    return [base64.b64encode(r.tobytes()).decode() for r in rows]


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, next): each row with the text of the row after it, the first row's after the last.

    Ids are dealt to ranges by their quantiles; each range also gets a copy of the next one's first row, so
    one shuffle is enough and no window runs over all rows."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("key", F.coalesce("id", F.lit(-(1 << 63))))
    n = 4 * partitions(spark)
    cuts = rows.agg(F.percentile_approx("key", [k / n for k in range(1, n)], 100 * n).alias("q")).first()["q"]
    cuts = np.array(sorted(set(cuts or [])), np.int64)  # one for each range
    deal = F.pandas_udf(lambda s: pd.Series(np.searchsorted(cuts, s.to_numpy(np.int64), "right")), "long")
    rows = rows.withColumn("range", deal("key"))
    heads = rows.groupBy("range").agg(F.min("key").alias("key")).orderBy("range").collect()  # one for each range
    before = [(h["key"], heads[i - 1]["range"]) for i, h in enumerate(heads)]
    copies = spark.createDataFrame(before, "key long, range long")
    copied = rows.drop("range").join(F.broadcast(copies), "key").withColumn("copy", F.lit(True)).select("id", "text", "key", "range", "copy")
    both = rows.withColumn("copy", F.lit(False)).unionByName(copied)
    w = Window.partitionBy("range").orderBy("copy", "key", "text")
    return both.withColumn("next", F.lead("text").over(w)).filter("not copy").select("id", "text", "next")


def compare_versions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next: each text against itself with its
    last quarter replaced by the beginning of the next text, and against the next text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts, follow = (b.column(k).to_pylist() for k in range(3))
            a = 0
            while a < len(ids):
                z, size = a, 0
                while z < len(ids) and (z == a or size < 1 << 20):
                    size += len(texts[z])
                    z += 1
                edited = [t[: len(t) - len(t) // 4] + (x or "")[: len(t) // 4] for t, x in zip(texts[a:z], follow[a:z], strict=True)]
                raw = [e.encode("utf-8", "surrogatepass") for e in edited]
                own = digests([t.encode("utf-8", "surrogatepass") for t in texts[a:z]])
                new = digests(raw)
                next_ = digests([(x or "").encode("utf-8", "surrogatepass") for x in follow[a:z]])
                n = z - a
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[a:z], pa.int64()), pa.array([len(t) for t in texts[a:z]], pa.int64()), pa.array([hashlib.sha256(r).hexdigest() for r in raw]), pa.array(fingerprints(own, n)), pa.array(fingerprints(new, n)), pa.array(likeness(own, new, n)), pa.array(likeness(own, next_, n))],
                    names=["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
                )
                a = z

    shape = "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return with_next(docs, id_col, text_col).mapInArrow(run, shape).withColumnRenamed("id", id_col)


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_versions(table(spark, sf_dir, "documents"))


QUERIES = {"op4_fingerprints": op4_fingerprints}
SQL: dict[str, str] = {}
