"""Join of documents by the Jaccard similarity of their word shingles, by T-occurrence search.

Texts of one shingle set form a class. A class of n shingles shares at least T = ceil(0.75 n) with any partner, so as in
DivideSkip its shingles divide into the L = T - 1 with the longest inverted lists and the n - L with short ones:

1. Lists of the short ones are built by a shuffle on the shingle. How long a list is comes from counts over all documents, in a
   table of counters that grows with the input up to CELLS; any total order gives the same result. A list that the counters show to be
   long is salted, so that no task sorts it alone.
2. Each query class heap-merges the members that its short lists offer it (`_merged`). Where lists offer all their pairs, these are
   counted (`_counted`): one that occurs less than T - L times, less the short lists that aren't at hand, can't link.
3. The lists of the long shingles are never merged: a candidate is probed for them by binary search, in blocks, rarest first, until it
   reaches T or no longer can (`_probed`).

What is asked for is which classes hang together, so a list offers a member the WINDOW - 1 preceding ones, which is
all a short list has. While members of a longer list still lie in several components, it then offers a hub, chosen anew for each list. A group of near copies is joined by few pairs this way. At
last each list that still lies in several components offers all its pairs across them, so no link is lost; no list is capped or skipped.
Parity bits of each set, 512 within joins and two and more for each shingle after them, tell most other pairs apart before any set is
fetched: what they let pass is a superset of the links. The candidates are gathered with these bits alone first; only classes that are left have their sets built, and what is left is probed.

Nulls and texts without words have an empty set and link with nothing; equal texts are one class. Rows without an id are left alone: they
link with nothing. Repeated ids count as one row each, linked as their texts are. Very long texts are sets as any other. An empty table
gives an empty result. Only the id and the text column are read. Sets are compared by 64-bit hashes of shingles and classes.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from heapq import merge
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from archivist.llm.common import ROWS_A_TASK, free, fresh, gives_back, partitions, sized, stored, table
from archivist.llm.components import components
from archivist.llm.shingles import mix, shingle_sets

WORDS, PERCENT = 5, 75
#: Counters of list lengths: one for each so many bytes of text, within these bounds (32 MB are broadcast at most).
BYTES_A_CELL, CELLS = 256, (1 << 18, 1 << 25)
#: Documents of a salted part of a long list, about.
PART = 2048
#: Rows that are broadcast at most; more are joined by a shuffle.
SENT = 2_000_000
#: Members of a list that are offered to each other at once; a list of more goes on to the hubs.
WINDOW = 8
#: Pairs that a task counts at once; it passes on what it has of more.
COUNTED = 1 << 20
#: Turns in which lists that lie in several components offer their members one hub, before they offer all their pairs.
HUBS = 1
BITS = [f"b{k}" for k in range(8)]
_STEP = 1 << 13


def _bytes(b: pa.RecordBatch, k: int) -> list[bytes]:
    return [x or b"" for x in b.column(k).cast(pa.binary()).to_pylist()]


def _class(s: np.ndarray) -> int:
    """A hash of a set, whatever the order."""
    with np.errstate(over="ignore"):
        return int(mix(np.array([s.sum(dtype=np.uint64) + np.uint64(0x9E3779B97F4A7C15) * mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64) + np.uint64(len(s))], np.uint64)).view(np.int64)[0])


def _parities(s: np.ndarray) -> np.ndarray:
    """How often each of 512 hash values occurs in a set, modulo two. Sets differ in at least as many shingles as in bits."""
    odd = np.bincount((s >> np.uint64(40) & np.uint64(511)).astype(np.int64), minlength=512) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _sketch(s: np.ndarray) -> bytes:
    """The same in at least two bits for each shingle; a half of the bits folds onto the other by exclusive or."""
    size = 1 << max(8, (2 * len(s)).bit_length())
    return np.packbits((np.bincount((s >> np.uint64(12) & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1).astype(np.uint8)).tobytes()


def _differ(x: bytes, y: bytes) -> int:
    """In how many bits two sketches differ, the longer folded to the other's size."""
    x, y = sorted((np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)), key=len)
    return int(np.bitwise_count(x ^ np.bitwise_xor.reduce(y.reshape(-1, len(x)), 0)).sum())


def _long(n: int, percent: int) -> int:
    """How many of n shingles have lists that are probed, not merged."""
    return -(-percent * n // 100) - 1


def _long_column(percent: int) -> F.Column:
    """The same over the rows of a class."""
    return F.floor((percent * F.max("n").cast("long") + 99) / 100) - 1


def _needed(na: int, nb: int, percent: int) -> int:
    """T: percent * union <= 100 * shared, so (100 + percent) * shared >= percent * (na + nb)."""
    return -(-percent * (na + nb) // (100 + percent))


def _sets(docs: DataFrame, words: int) -> tuple[DataFrame, np.ndarray]:
    """(id, n, cls, parity bits) of each document, and the counters of all shingles."""
    size = docs.agg(F.sum(F.octet_length("text").cast("long")).alias("n")).first()["n"] or 0
    cells = min(max(CELLS[0], 1 << (size // BYTES_A_CELL).bit_length()), CELLS[1])
    shape = "id long, n long, cls long, " + ", ".join(f"{x} long" for x in BITS) + ", sketch binary, at long, counts binary"
    names = ["id", "n", "cls", *BITS, "sketch", "at", "counts"]

    @gives_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, some = np.zeros(cells, np.uint32), False
        for b in batches:
            sets = shingle_sets(_bytes(b, 1), words)
            some = some or len(sets) > 0
            if sets:
                np.add.at(counts, (np.concatenate(sets) & np.uint64(cells - 1)).astype(np.int64), np.uint32(1))
            n = len(sets)
            bits = np.array([_parities(s) for s in sets], np.int64).reshape(-1, len(BITS))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([_class(s) for s in sets], pa.int64()), *map(pa.array, bits.T.copy()), pa.array([_sketch(s) for s in sets], pa.binary()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary())], names=names)
        for k in range(0, cells if some else 0, 64 * _STEP):
            at = range(k, min(k + 64 * _STEP, cells), _STEP)
            n = len(at)
            yield pa.RecordBatch.from_arrays([*[pa.nulls(n, pa.int64())] * (3 + len(BITS)), pa.nulls(n, pa.binary()), pa.array(at, pa.int64()), pa.array([zlib.compress(counts[i : i + _STEP].tobytes(), 1) for i in at], pa.binary())], names=names)

    def add(p: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(_STEP, np.uint32)
        for c in p["counts"]:
            total += np.frombuffer(zlib.decompress(c), np.uint32)
        return pd.DataFrame({"at": [p["at"].iloc[0]], "salt": [0], "counts": [zlib.compress(total.tobytes(), 1)]})

    both = stored(docs.mapInArrow(run, shape))
    parts = both.filter("at is not null").select("at", (F.xxhash64("counts") % 16).alias("salt"), "counts")
    for keys in (["at", "salt"], ["at"]):
        parts = parts.groupBy(*keys).applyInPandas(add, "at long, salt long, counts binary")
    counts = np.zeros(cells, np.uint32)
    for r in parts.toLocalIterator():  # at most CELLS counters, whatever the input
        counts[r["at"] : r["at"] + _STEP] = np.frombuffer(zlib.decompress(r["counts"]), np.uint32)
    return both.filter("at is null").select("id", "n", "cls", *BITS, "sketch"), counts


def _levels(counts: np.ndarray) -> np.ndarray:
    """Counts on a scale of one byte, eight steps for each doubling; equal below 8."""
    return np.minimum(8 * np.log2(np.maximum(counts, 8)), 255).astype(np.uint8)


def _ordered(s: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """The set, short lists first; by the shingle where they are as long."""
    return s[np.argsort(levels[s & np.uint64(len(levels) - 1)], kind="stable")]


def _postings(docs: DataFrame, sent, words: int, percent: int) -> DataFrame:
    """(h, part, cls, n, pos) of the shingles with short lists, of each class once a task."""

    @gives_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels, seen = sent.value, set()
        for b in batches:
            h, cls, size, of, pos = [], [], [], [], []
            for i, s in zip(b.column(0).to_pylist(), shingle_sets(_bytes(b, 1), words), strict=True):
                c = _class(s)
                if len(s) and c not in seen:
                    seen.add(c)
                    short = _ordered(s, levels)[: len(s) - _long(len(s), percent)]
                    h.append(short)
                    cls.append(c)
                    size.append(len(s))
                    of.append(i)
                    pos.append(np.arange(len(short)))
            if h:
                k = [len(x) for x in h]
                h = np.concatenate(h)
                parts = np.exp2(levels[h & np.uint64(len(levels) - 1)] / 8) / PART
                salt = mix(np.repeat(np.array(of, np.int64), k).astype(np.uint64)) % (parts.astype(np.uint64) + np.uint64(1))
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(np.where(parts >= 1, salt.astype(np.int32) + 1, 0), pa.int32()), pa.array(np.repeat(cls, k)), pa.array(np.repeat(size, k), pa.int32()), pa.array(np.concatenate(pos), pa.int32())], names=["h", "part", "cls", "n", "pos"])

    return docs.mapInArrow(run, "h long, part int, cls long, n int, pos int")


def _fits(percent: int) -> F.Column:
    """Whether sizes and places in the two orders leave room for enough shared shingles."""
    rest = F.least(F.col("n") - F.col("pos"), F.col("n2") - F.col("pos2")).cast("long")
    return rest * (100 + percent) >= (F.col("n") + F.col("n2")).cast("long") * percent


def _merged(offers: DataFrame, percent: int, few: bool = False) -> DataFrame:
    """(a, b, n, n2) of the members b in the lists of a query a, of rows (h, cls, n, c2, n2): the members c2 that list h offers cls.
    Members of a query are dealt to eight heaps, a task holds the lists of one at a time. few: one task is enough."""

    @gives_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def done(rows: np.ndarray) -> pa.RecordBatch:
            out = []
            cut = np.flatnonzero(np.r_[True, (rows[1:, :2] != rows[:-1, :2]).any(1)])
            for r in np.split(rows, cut[1:]):
                sizes = dict(zip(r[:, 4].tolist(), r[:, 5].tolist(), strict=True))
                lists = np.split(r[:, 4], np.flatnonzero(r[1:, 2] != r[:-1, 2]) + 1)
                for b, _ in groupby(merge(*(x.tolist() for x in lists))):
                    out.append((int(r[0, 0]), b, int(r[0, 3]), sizes[b]))
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.int32()))], names=["a", "b", "n", "n2"])

        for x in batches:
            if not x.num_rows:
                continue
            held.append(np.stack([x.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(6)], 1))
            last = held[-1][-1, :2]
            if (held[0][0, :2] != last).any():
                rows = np.concatenate(held)
                ended = (rows[:, :2] != last).any(1)
                held = [rows[~ended]]
                yield done(rows[ended])
        if held:
            yield done(np.concatenate(held))

    rows = offers.filter("cls <> c2").select(F.greatest("cls", "c2").alias("a"), F.pmod(F.xxhash64(F.least("cls", "c2")), F.lit(8)).alias("heap"), "h", F.when(F.col("cls") > F.col("c2"), F.col("n")).otherwise(F.col("n2")).alias("n"), F.least("cls", "c2").alias("b"), F.when(F.col("cls") > F.col("c2"), F.col("n2")).otherwise(F.col("n")).alias("n2"))
    rows = rows.coalesce(1) if few else rows.repartition(partitions(offers.sparkSession), "a", "heap")
    return rows.sortWithinPartitions("a", "heap", "h", "b").mapInArrow(run, "a long, b long, n int, n2 int")


def _counted(members: DataFrame, percent: int) -> DataFrame:
    """(a, b, n, n2) of the classes in different components that occur often enough in the same lists, of rows (h, cls, n, component, missing,
    bits): T - L times, less the short lists of both that aren't at hand, `missing`. Pairs whose sizes or bits differ too much are left out.

    Lists with the same smallest member mostly have the others in common too, so they go to one task, which counts a pair once for all of
    them. A list of more than PART members is dealt to several: each has some of the members, and all to compare them with."""
    w = Window.partitionBy("h")
    rows = members.withColumns({"low": F.min("cls").over(w), "blocks": F.floor(F.count("*").over(w) / PART) + 1})
    rows = rows.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).withColumn("asks", F.pmod(F.xxhash64("cls"), F.col("blocks")) == F.col("block"))
    rows = rows.select("low", "block", "h", "cls", "n", "component", "missing", F.col("asks").cast("long"), *BITS)
    names = ["a", "b", "n", "n2", "spare", "times"]

    def pairs(x: np.ndarray) -> Iterator[np.ndarray]:
        """(a, b, n, n2, spare) of the pairs that one list offers."""
        cls, n, component, missing, bits = x[:, 3], x[:, 4], x[:, 5], x[:, 6], np.ascontiguousarray(x[:, 8:]).view(np.uint64)
        asks = np.flatnonzero(x[:, 7])
        for k in range(0, len(asks), step := max(1, CELLS[0] // len(x))):
            q = asks[k : k + step]
            i, j = np.nonzero((cls[q, None] > cls) & (component[q, None] != component) & (100 * np.minimum(n[q, None], n) >= percent * np.maximum(n[q, None], n)))
            i = q[i]
            differ = np.bitwise_count(bits[i] ^ bits[j]).sum(1, dtype=np.int64)
            near = differ * (100 + percent) <= (n[i] + n[j]) * (100 - percent)
            i, j = i[near], j[near]
            yield np.stack([cls[i], cls[j], n[i], n[j], np.minimum(missing[i], missing[j])], 1)

    @gives_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        found: list[np.ndarray] = []  # pairs and how often they occurred
        many = 0

        def told() -> np.ndarray:
            x = np.concatenate(found)
            x = x[np.lexsort((x[:, 1], x[:, 0]))]
            cut = np.flatnonzero(np.r_[True, (x[1:, :2] != x[:-1, :2]).any(1)]) if len(x) else np.empty(0, np.int64)
            out = x[cut]
            out[:, 5] = np.add.reduceat(x[:, 5], cut) if len(cut) else 0
            return out

        def listed(x: np.ndarray) -> Iterator[pa.RecordBatch]:
            nonlocal many
            for p in pairs(x):
                found.append(np.c_[p, np.ones(len(p), np.int64)])
                many += len(p)
                if many > COUNTED:
                    yield given()
                    many = 0

        def given() -> pa.RecordBatch:
            x = told()
            found.clear()
            return pa.RecordBatch.from_arrays([pa.array(c) for c in x.T.copy()], names=names)

        for b in batches:
            if not b.num_rows:
                continue
            x = np.concatenate([*held, np.stack([c.to_numpy(zero_copy_only=False) for c in b.columns], 1)])
            cut = np.flatnonzero((x[1:, :3] != x[:-1, :3]).any(1)) + 1
            *ended, last = np.split(x, cut)
            for e in ended:
                yield from listed(e)
            held = [last]
        for e in held:
            yield from listed(e)
        if found:
            yield given()

    dealt = rows.repartition(partitions(members.sparkSession), "low", "block").sortWithinPartitions("low", "block", "h")
    each = dealt.mapInArrow(run, ", ".join(f"{x} long" for x in names)).groupBy("a", "b").agg(F.first("n").alias("n"), F.first("n2").alias("n2"), F.first("spare").alias("spare"), F.sum("times").alias("times"))
    need = F.floor((percent * (F.col("n") + F.col("n2")) + 99 + percent) / (100 + percent))
    least = need - F.floor((percent * F.greatest("n", "n2") + 99) / 100) + 1 - F.col("spare")
    return each.filter(F.col("times") >= least).select("a", "b", F.col("n").cast("int").alias("n"), F.col("n2").cast("int").alias("n2"))


def _likely(pairs: DataFrame, bits: DataFrame, percent: int) -> DataFrame:
    """The (a, b) of pairs (a, b, n, n2) whose sketches differ in no more bits than similar sets may, stored."""

    @gives_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            n, m, s, t = (x.column(k).to_pylist() for k in range(2, 6))
            good = [_differ(s[i], t[i]) * (100 + percent) <= (n[i] + m[i]) * (100 - percent) for i in range(len(n))]
            yield x.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    of, pairs = bits.select("cls", "sketch"), stored(pairs)
    n = pairs.count()
    if n <= SENT // 50:  # else both joins shuffle
        ids = F.broadcast(pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct())
        of = of.join(ids, "cls", "left_semi")
    pairs = sized(pairs, n)
    both = pairs.join(of.withColumnsRenamed({"cls": "a", "sketch": "s"}), "a").join(of.withColumnsRenamed({"cls": "b", "sketch": "t"}), "b")
    out = stored(both.select("a", "b", "n", "n2", "s", "t").mapInArrow(run, "a long, b long"))
    free(pairs)
    return out


def _probed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The (a, b) of pairs (a, b) that share T shingles. Those of the smaller set are probed in the other by binary search, the ones with short
    lists first, in blocks, until T is reached or out of reach."""

    @gives_back
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            good = []
            for x, y in zip(p["x"], p["y"], strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                if len(x) > len(y):
                    x, y = y, x
                need, shared, at, block = _needed(len(x), len(y), percent), 0, 0, max(64, len(x) - _long(len(x), percent))
                y = np.sort(y)
                while shared < need <= shared + len(x) - at:
                    part = x[at : at + block]
                    found = np.searchsorted(y, part)
                    shared += int((y[np.minimum(found, len(y) - 1)] == part).sum())
                    at += block
                good.append(shared >= need)
            yield p.loc[good, ["a", "b"]]

    with_a = pairs.select("a", "b").join(sets.select(F.col("cls").alias("a"), F.col("s").alias("x")), "a")
    return with_a.join(sets.select(F.col("cls").alias("b"), F.col("s").alias("y")), "b").select("a", "b", "x", "y").mapInPandas(run, "a long, b long")


def _apart(groups: DataFrame, rows: DataFrame) -> DataFrame:
    """The members of lists that lie in several components, with theirs."""
    found = rows.select("h", "cls", "n", "pos").join(groups, "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    several = found.groupBy("h").agg(F.min("component").alias("_low"), F.max("component").alias("_high")).filter("_low <> _high").select("h")
    return sized(stored(found.join(several, "h", "left_semi")))


def _spread(lists: DataFrame, tried: DataFrame, groups: DataFrame, bits: DataFrame, percent: int, hubs: int, check) -> tuple[DataFrame, DataFrame]:
    """All pairs tried, and components of classes as `check` links them (as before without one), from lists (h, cls, n, pos) and what is known.

    A hub is a member of the largest component of its list, chosen by a hash anew each turn: a class on the rim of a group links with some of
    it only. What the last step adds are pairs across components that no hub could join."""

    at = _apart(groups, lists)
    # short lists of a class that aren't among `lists`: a pair may share as many of them
    missing = lists.groupBy("cls").agg((F.max("n") - _long_column(percent) - F.count_distinct("h")).alias("missing"))
    for turn in range(hubs + 1):
        if turn < hubs:
            each = at.groupBy("h", "component").agg(F.count("*").alias("size"), F.max(F.struct(F.xxhash64("cls", F.lit(turn)).alias("by"), "cls", "n", "pos")).alias("hub"))
            hub = each.groupBy("h").agg(F.max(F.struct("size", "hub", "component")).alias("first"))
            offers = at.join(hub, "h").filter("component <> first.component").select("h", "cls", "n", "pos", *(F.col(f"first.hub.{x}").alias(y) for x, y in (("cls", "c2"), ("n", "n2"), ("pos", "pos2"))))
            offers = offers.filter(_fits(percent))
            found = _merged(offers, percent, at.count() <= ROWS_A_TASK)
        else:  # all that a pair shares is counted here, so places alone must not drop an offer
            found = _counted(at.join(missing, "cls").join(bits.drop("sketch"), "cls"), percent)
        pairs = _likely(found.join(tried, ["a", "b"], "left_anti"), bits, percent)
        if pairs.isEmpty():
            free(pairs)
            continue
        tried = tried.unionByName(pairs)
        if check is None:
            continue
        groups = components(groups.select(F.col("cls").alias("a"), F.col("component").alias("b")).unionByName(check(pairs))).withColumnRenamed("id", "cls")
        if turn < hubs:
            before, at = at, _apart(groups, at)
            free(before)
    free(at)
    return tried, groups


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """id, n_shingles, component_id (the smallest id reachable by links, itself included) of each row."""
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    all_rows, counts = _sets(texts, words)
    sent = spark.sparkContext.broadcast(_levels(counts))  # a byte for each counter, at most CELLS
    known = all_rows.filter("id is not null and n > 0")
    each_id = known.groupBy("cls", "id").agg(F.count("*").alias("copies"), F.first(F.struct("n", *BITS, "sketch")).alias("f"))
    classes = stored(each_id.groupBy("cls").agg(F.min(F.struct("id", "copies", "f")).alias("m")).select("cls", F.col("m.id").alias("rep"), "m.copies", "m.f.*"))
    bits = classes.select("cls", *BITS, "sketch")

    w = Window.partitionBy("h", "part").orderBy("n", "cls")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    seen = _postings(texts.filter("id is not null"), sent, words, percent)
    place = F.struct(F.col("cls").alias("c2"), F.col("n").alias("n2"), F.col("pos").alias("pos2"))
    ended = [F.first("cls").over(whole).alias("_first"), F.last("cls").over(whole).alias("_last"), F.lag("cls").over(w).alias("_before"), F.count("*").over(whole).alias("_size")]
    lists = seen.select("*", *ended).filter("_first <> _last or part > 0").filter("_before is null or _before <> cls")
    lists = lists.select("h", "cls", "n", "pos", (F.col("_size") > WINDOW).alias("long") | (F.col("part") > 0), "part", F.collect_list(place).over(w.rowsBetween(1 - WINDOW, -1)).alias("offers"))
    lists = lists.toDF("h", "cls", "n", "pos", "long", "part", "offers").drop("part")
    rest = lambda x: F.least(F.col("n") - F.col("pos"), x["n2"] - x["pos2"]).cast("long") * (100 + percent) >= (F.col("n") + x["n2"]).cast("long") * percent
    lists = stored(lists.withColumn("offers", F.filter("offers", rest)).filter(F.col("long") | (F.size("offers") > 0)))

    # candidates, linked by their bits
    first = _likely(_merged(lists.select("h", "cls", "n", F.inline("offers")), percent), bits, percent)
    groups = components(first).withColumnRenamed("id", "cls")
    lists_left = lists.filter("long").select("h", "cls", "n", "pos")
    tried, _ = _spread(lists_left, first, groups, bits, percent, 0, None)
    tried = sized(stored(tried))

    # the sets of all classes that have a candidate; no other class has a link
    wanted = stored(tried.select(F.explode(F.array("a", "b")).alias("cls")).distinct().join(classes, "cls").select(F.col("rep").alias("id"), F.col("cls").alias("of"), "copies"))
    few = wanted.count() <= SENT

    @gives_back
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = shingle_sets(_bytes(b, 1), words)
            cls = [_class(s) for s in sets]
            made = pa.RecordBatch.from_arrays([pa.array(cls, pa.int64()), pa.array([_ordered(s, sent.value).tobytes() for s in sets], pa.binary())], names=["cls", "s"])
            yield made.filter(pa.array([x == y for x, y in zip(cls, b.column(2).to_pylist(), strict=True)], pa.bool_()))

    ids = wanted.select("id", "of")
    built = texts.join(F.broadcast(ids) if few else ids, "id").select("id", "text", "of").mapInArrow(build, "cls long, s binary")
    # a class has one row by now, unless rows with its smallest id repeat
    sets = stored(built if wanted.filter("copies > 1").isEmpty() else built.dropDuplicates(["cls"]))

    links = stored(_probed(tried, sets, percent))
    groups = components(links).withColumnRenamed("id", "cls")
    _, groups = _spread(lists_left.join(wanted.select(F.col("of").alias("cls")), "cls", "left_semi"), tried, groups, bits, percent, HUBS, lambda pairs: _probed(pairs, sets, percent))

    rep = classes.select("cls", "rep")
    by_rep = groups.join(rep, "cls").groupBy("component").agg(F.min("rep").alias("least"))
    each = rep.join(groups, "cls", "left").join(by_rep, "component", "left").select("cls", F.coalesce("least", "rep").alias("component_id"))
    out = known.join(each, "cls").select("id", "n", "component_id").unionByName(all_rows.filter("id is null or n = 0").select("id", "n", F.col("id").alias("component_id")))
    free(links, sets, wanted, tried, first, lists)
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_documents(table(spark, sf_dir, "documents"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the document with the smallest id of each group, with its columns.

    Rows without an id, without a text or without words are in no group and stay. Rows of one id stay or go together: they stay where
    the id is the smallest of a group that one of them is in. Very long texts are compared whole. Columns may have any names. An
    empty table stays empty."""
    i = fresh(docs, "_id")[0]
    keep = similar_documents(docs).filter("doc_id <=> component_id").select(F.col("doc_id").alias(i)).distinct()
    return docs.join(keep, docs["doc_id"].cast("long").eqNullSafe(F.col(i)), "left_semi")


QUERIES = {"op10_ngram_join": op10_ngram_join}
SQL: dict[str, str] = {}
