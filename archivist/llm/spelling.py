"""Grouping of spelling variants by k-d trees over letter counts.

Words are runs of letters (A to Z and U+00C0 to U+00FF; only A to Z are lower-cased), so each is one byte a code point in Latin 1. An edit of one code
point changes the counts of a word's letters by at most 2 in sum (1, if the length changes): near words lie close in the space of letter counts. For each word, the
words of its own length within 2 and those one longer within 1 are looked for in k-d trees, one pair of lengths at a time, with boxes
pruned by their L1 distance. Bits that hold the counts up to two then rule out most words of a leaf, and the order of letters decides.

The upper part of the trees is fitted on a bounded sample (about SAMPLE words by a hash), with at most CELLS cells in all; every word is in
the index, in the cell that the splits send it to, and each word is sent as a query to all cells within its distance. A cell of very
many words is cut by a hash, and its queries go to each part, so no task holds more than that. Tasks build the lower part of their
cell's tree and stream the queries. Words of one anagram group differ in more than one place, or in none; no group is skipped or cut.

Nulls and texts without letters have no words. The id only takes part in slips (below), where a null id reads as an empty text. Rows that repeat count each for itself, very long
texts are counted whole. An empty table gives an empty result. Only the id and the text column are read, so other columns can't clash.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from archivist.llm.blocks import gathered, index_and_queries
from archivist.llm.common import free, partitions, stored, table

LETTERS, TIMES, FACTOR = 5, 3, 2
#: Words of a cell, about; cells in all; words that the upper part of the trees is fitted on, about.
CELL, CELLS, SAMPLE = 1 << 14, 1 << 12, 1 << 17
#: Words of a leaf, queries that a task searches at once, distinct words that a task counts before it passes them on.
LEAF, PORTION, COUNTED = 16, 1 << 15, 500_000
BINS = 27
_RUN = re.compile(rb"(?:[a-z]+|(?:\xc3[\x80-\xbf])+)+")
_BIN = np.full(256, 26, np.int64)
_BIN[97:123] = np.arange(26)


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slips: int | None = None, letters: int = LETTERS, times: int = TIMES) -> DataFrame:
    """(word, n) of all texts. slips: where it divides the unsigned crc32 h of <id>:<run>, the run loses its code point h % length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[bytes, int] = {}

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([w.decode() for w in counts], pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])
            counts.clear()
            return out

        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), strict=True):
                if t is None:
                    continue
                start = zlib.crc32(b"%d:" % i if i is not None else b":")
                for w, n in Counter(_RUN.findall(t.lower())).items():  # bytes: only A to Z have a lower case
                    if slips is not None and not (h := zlib.crc32(w, start)) % slips:
                        s = w.decode()
                        k = h % len(s)
                        w = (s[:k] + s[k + 1 :]).encode()
                    if len(w) >= letters:
                        counts[w] = counts.get(w, 0) + n
                if len(counts) >= COUNTED:
                    yield flush()
        if counts:
            yield flush()

    each = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, "word string, n long")
    return each.groupBy("word").agg(F.sum("n").alias("n")).filter((F.length("word") >= letters) & (F.col("n") >= times))


def letter_counts(words: list[bytes]) -> np.ndarray:
    """The counts of each letter, and of all others together, by row."""
    size = np.array([len(w) for w in words], np.int64)
    bins = _BIN[np.frombuffer(b"".join(words), np.uint8)]
    out = np.bincount(np.repeat(np.arange(len(words)), size) * BINS + bins, minlength=len(words) * BINS)
    return np.minimum(out.reshape(len(words), BINS), 30_000).astype(np.int16)


def count_bits(counts: np.ndarray) -> np.ndarray:
    """Two bits for each letter: occurs, occurs twice. Words are at least as far apart as their bits differ."""
    low = (counts >= 1).astype(np.uint64) | ((counts >= 2).astype(np.uint64) << np.uint64(1))
    return np.bitwise_or.reduce(low << (2 * np.arange(BINS, dtype=np.uint64)), axis=1)


class Tree:
    """A k-d tree over letter counts: splits (letter, most on the left side) in inner nodes; leaves hold rows."""

    def __init__(self, counts: np.ndarray, leaf: float):
        self.nodes: list[tuple[int, int, int, int]] = []  # letter, bound, left, right; a leaf has letter -1 and its number
        self.leaves: list[np.ndarray] = []
        self._build(counts, np.arange(len(counts)), leaf)

    def _build(self, counts: np.ndarray, rows: np.ndarray, leaf: float) -> int:
        me = len(self.nodes)
        self.nodes.append((-1, len(self.leaves), 0, 0))
        best = None
        if len(rows) > leaf:
            mine = counts[rows]
            for bound in range(int(mine.max(initial=0))):
                n = (mine <= bound).sum(0)
                letter = int(np.argmin(np.abs(2 * n - len(rows))))
                if 0 < n[letter] < len(rows) and (best is None or abs(2 * n[letter] - len(rows)) < best[0]):
                    best = abs(2 * int(n[letter]) - len(rows)), letter, bound
                if bound >= 3 and best is not None:
                    break  # counts above are too rare to part the words better
        if best is None:
            self.leaves.append(rows)
            return me
        low = counts[rows, best[1]] <= best[2]
        left = self._build(counts, rows[low], leaf)
        right = self._build(counts, rows[~low], leaf)
        self.nodes[me] = (best[1], best[2], left, right)
        return me

    def within(self, queries: np.ndarray, most: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(leaf, rows of queries): each leaf with the queries whose L1 distance to its box is at most theirs. queries: counts by column."""
        todo = [(0, np.arange(queries.shape[1]), np.zeros(queries.shape[1], np.int32), {})]
        while todo:
            node, rows, off, box = todo.pop()
            letter, bound, left, right = self.nodes[node]
            if letter < 0:
                yield bound, rows
                continue
            low, high = box.get(letter, (-1, 1 << 20))
            x = queries[letter, rows].astype(np.int32)
            # a box's distance is the sum over its letters; this letter's part changes with the split
            rest = off - np.maximum(np.maximum(low - x, x - high), 0)
            for child, a, b in ((left, low, bound), (right, bound + 1, high)):
                d = rest + np.maximum(np.maximum(a - x, x - b), 0)
                near = d <= most[rows]
                if near.any():
                    todo.append((child, rows[near], d[near], {**box, letter: (a, b)}))

    def where(self, queries: np.ndarray) -> np.ndarray:
        """The leaf of each query."""
        out = np.zeros(queries.shape[1], np.int32)
        for leaf, rows in self.within(queries, np.zeros(queries.shape[1], np.int32)):
            out[rows] = leaf
        return out


def _matrix(words: list[bytes], size: int) -> np.ndarray:
    return np.frombuffer(b"".join(words), np.uint8).reshape(len(words), size)


def one_apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether each word of a becomes the one of b by one edit; b's words are as long or one longer."""
    if a.shape[1] == b.shape[1]:
        return (a != b).sum(1) == 1
    head = np.cumprod(a == b[:, :-1], axis=1).sum(1)
    tail = np.cumprod((a == b[:, 1:])[:, ::-1], axis=1).sum(1)
    return head + tail >= a.shape[1]


def _cells(words: DataFrame, total: int) -> dict[int, Tree]:
    """For lengths with many words the upper part of the tree, fitted on a sample."""
    share = min(1.0, SAMPLE / max(total, 1))
    some = words.filter(F.pmod(F.xxhash64("word"), F.lit(1 << 30)) < share * (1 << 30)).select("word").limit(2 * SAMPLE).toPandas()["word"]  # about SAMPLE words
    by_size: dict[int, list[bytes]] = {}
    for w in some:
        by_size.setdefault(len(w), []).append(w.encode("latin-1"))
    leaf = max(CELL, total / CELLS) * len(some) / max(total, 1)
    return {n: Tree(letter_counts(sorted(ws)), leaf) for n, ws in by_size.items() if len(ws) > leaf}


def near_words(words: DataFrame) -> DataFrame:
    """(word, other, other_n) of words (word, n): each word with each that is one edit away."""
    spark = words.sparkSession
    total = words.count()
    trees = _cells(words, total)  # at most CELLS cells, with a split each

    def cell_of(ws: list[bytes]) -> np.ndarray:
        tree = trees.get(len(ws[0]))
        return np.zeros(len(ws), np.int32) if tree is None else tree.where(np.ascontiguousarray(letter_counts(ws).T))

    def by_length(b: pa.RecordBatch) -> Iterator[tuple[int, list[bytes], np.ndarray]]:
        ws, n = [w.encode("latin-1") for w in b.column(0).to_pylist()], b.column(1).to_numpy()
        size = np.array([len(w) for w in ws], np.int64)
        for s in np.unique(size).tolist():
            mine = np.flatnonzero(size == s)
            yield s, [ws[i] for i in mine.tolist()], n[mine]

    def count_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in gathered(batches, PORTION):
            for s, ws, _ in by_length(b):
                cell, n = np.unique(cell_of(ws), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cell), s, np.int32)), pa.array(cell.astype(np.int32)), pa.array(n)], names=["size", "cell", "n"])

    sizes = words.select("word", "n").mapInArrow(count_cells, "size int, cell int, n long").groupBy("size", "cell").agg(F.sum("n").alias("n"))
    most = 2 * max(CELL, total // CELLS)
    parts = {(r["size"], r["cell"]): -(-r["n"] // most) for r in sizes.filter(F.col("n") > most).collect()}  # CELLS rows at most

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each word once as a member of its cell, and as a query of all cells in reach."""

        def rows(size: int, cell: np.ndarray, part: np.ndarray, side: int, ws: list[bytes], n: np.ndarray) -> pa.RecordBatch:
            k = len(ws)
            return pa.RecordBatch.from_arrays([pa.array(np.full(k, size, np.int32)), pa.array(cell.astype(np.int32)), pa.array(part.astype(np.int32)), pa.array(np.full(k, side, np.int32)), pa.array(ws, pa.binary()), pa.array(n)], names=["size", "cell", "part", "side", "word", "n"])

        for b in gathered(batches, PORTION):
            for s, ws, n in by_length(b):
                cell = cell_of(ws)
                cut = np.array([parts.get((s, c), 1) for c in cell.tolist()], np.int64)
                yield rows(s, cell, np.array([zlib.crc32(w) for w in ws], np.int64) % cut, 0, ws, n)
                for size, radius in ((s, 2), (s + 1, 1)):
                    tree = trees.get(size)
                    found = [(0, np.arange(len(ws)))] if tree is None else tree.within(np.ascontiguousarray(letter_counts(ws).T), np.full(len(ws), radius, np.int32))
                    for c, at in found:
                        for part in range(parts.get((size, c), 1)):
                            yield rows(size, np.full(len(at), c), np.full(len(at), part), 1 + (size != s), [ws[i] for i in at.tolist()], n[at])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for index, queries in index_and_queries(batches, 3, PORTION):
            if index is not last:
                last, t = index, pa.Table.from_batches(index)
                size, have, n = t["size"][0].as_py(), t["word"].to_pylist(), t["n"].to_numpy()
                counts = letter_counts(have)
                tree, bits, chars = Tree(counts, LEAF), count_bits(counts), _matrix(have, size)
            q = pa.Table.from_batches(queries)
            all_q, all_n, sides = q["word"].to_pylist(), q["n"].to_numpy(), q["side"].to_numpy()
            for side in (1, 2):  # of the same length, then one shorter
                mine = np.flatnonzero(sides == side)
                if not len(mine):
                    continue
                ws, m = [all_q[i] for i in mine.tolist()], all_n[mine]
                counts = letter_counts(ws)
                mine_bits, mine_chars = count_bits(counts), _matrix(ws, size - (side == 2))
                left, right = [], []
                for leaf, rows in tree.within(np.ascontiguousarray(counts.T), np.full(len(ws), 3 - side, np.int32)):
                    there = tree.leaves[leaf]
                    for k in range(0, len(there), 4096):  # a leaf is large only where all its counts agree
                        some = there[k : k + 4096]
                        i, j = np.nonzero(np.bitwise_count(mine_bits[rows][:, None] ^ bits[some][None, :]) <= 3 - side)
                        i, j = rows[i], some[j]
                        good = one_apart(mine_chars[i], chars[j])
                        left.append(i[good])
                        right.append(j[good])
                if not left:
                    continue
                i, j = np.concatenate(left), np.concatenate(right)
                for a, b, an, bn, x, y in ((ws, have, m, n, i, j), (have, ws, n, m, j, i))[:side]:
                    yield pa.RecordBatch.from_arrays([pa.array([a[k].decode("latin-1") for k in x.tolist()], pa.string()), pa.array([b[k].decode("latin-1") for k in y.tolist()], pa.string()), pa.array(bn[y])], names=["word", "other", "other_n"])

    dealt = words.select("word", "n").mapInArrow(deal, "size int, cell int, part int, side int, word binary, n long")
    key = ["size", "cell", "part"]
    return dealt.repartition(4 * partitions(spark), *key).sortWithinPartitions(*key, "side").mapInArrow(search, "word string, other string, other_n long")


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): the last word that forms lead to, by doubling the steps."""
    now = stored(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        then = stored(now.join(ahead, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("moved")))
        free(now)
        if not then.filter("moved").head(1):
            return then.drop("moved")
        now = stored(then.drop("moved"))
        free(then)


def spelling_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slips: int | None = None, letters: int = LETTERS, times: int = TIMES, factor: int = FACTOR) -> DataFrame:
    """word, form, root, n, n_near, form_n: a word's form is its most frequent near word, the first of several, if that is `factor` times as frequent."""
    words = stored(word_counts(docs, id_col, text_col, slips, letters, times))
    near = near_words(words).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), "other")).alias("best"))
    near = near.select("word", "n_near", (-F.col("best.less")).alias("best_n"), F.col("best.other").alias("best"))
    fits = F.col("best_n") >= factor * F.col("n")
    each = stored(words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(fits, F.col("best")).alias("form"), F.when(fits, F.col("best_n")).alias("form_n")))
    roots = _roots(each.filter("form is not null"))
    free(words)
    return each.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_groups(table(spark, sf_dir, "documents"), slips=97)


QUERIES = {"op12_spelling_variants": op12_spelling_variants}
SQL: dict[str, str] = {}
