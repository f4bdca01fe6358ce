"""Removal of passages that an earlier document holds, with suffix arrays over shards of the corpus.

Any 50 bytes hold an anchor: the place of the smallest hash of 26 bytes in them. Equal strings of 50
bytes have equal anchors, so anchors bring together all places where a repeat can be:

1. Each text gives its anchors, with a hash of the context that holds the 50-byte strings whose smallest
   hash is the anchor's. Anchors are shuffled in packed blocks by bucket.
2. In a bucket, a context that an earlier document has too is removed whole. Where an anchor stands in
   different contexts, the first document of each context is asked for the bytes.
3. The contexts asked for make the shards: a suffix array by induced sorting and permuted common
   prefixes of 50 bytes and more show which strings an earlier document has, to the byte.
4. The spans are cut from each text.

Texts are dealt to groups by a hash, and what is asked of a group's texts or gone from them comes in packed blocks, one from each bucket:
rows then grow with the input, not with its anchors. Both steps with the texts use one shuffle of them, which brings along the rows' other
columns where they are wanted. Buckets and groups grow with the partitions of the input.
Strings are judged on the input, not on what is left, and never cross documents.

Nulls count as empty texts. Rows without an id are kept whole and remove nothing. Rows of one id are
not earlier than each other. Texts of fewer than 50 bytes are kept. Very long texts are
judged and cut whole. Other columns are not read, so they can't clash. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from archivist.llm.common import gives_back, partitions, stored, table
from archivist.llm.shingles import chunks, mix, powers
from archivist.llm.suffix_arrays import permuted_common_prefixes, suffix_array

LENGTH, GRAM, SHARDS = 50, 26, 8
_BYTE = np.arange(256, dtype=np.uint64) + np.uint64(1)


def anchors(texts: list[bytes], length: int, gram: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(index of the text, start of the first string, number of strings, hash of the anchor, hash of its context) of all anchors, by runs of
    texts. The strings of an anchor follow each other, and each string has one anchor."""
    width, first = length - gram + 1, 0
    for run in chunks(texts):
        data = np.frombuffer(b"".join(run), np.uint8)
        sizes = np.array([len(t) for t in run], np.int64)
        ends = np.cumsum(sizes)
        n = len(data)
        if n >= length:
            up, down = powers(n + 1)
            total = np.r_[np.uint64(0), np.cumsum(_BYTE[data] * up[:n], dtype=np.uint64)]
            h = mix((total[gram:] - total[:-gram]) * down[: n - gram + 1])
            m, span = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64), 1
            while span * 2 <= width:
                m = np.minimum(m[:-span], m[span:])
                span *= 2
            if span < width:
                m = np.minimum(m[: len(m) - (width - span)], m[width - span :])
            end_of = np.repeat(ends, sizes)[: len(m)]
            start = np.flatnonzero(np.arange(len(m)) + length <= end_of)
            if len(start):
                place = (m[start] & np.uint64(0xFFFFFFFF)).astype(np.int64)
                cut = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
                many = np.diff(np.append(cut, len(place)))
                place, low = place[cut], start[cut]
                high = low + many + length - 1
                doc = np.searchsorted(ends, place, "right")
                context = mix((total[high] - total[low]) * down[low] + (place - low).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + many.astype(np.uint64))
                yield doc + first, low - ends[doc] + sizes[doc], many, mix(h[place] ^ np.uint64(0xA0761D6478BD642F)), context
        first += len(run)


#: What is packed of anchors on their way to a bucket, and of strings on theirs to a group of texts.
_ANCHOR = {"a": np.uint32, "c": np.uint64, "id": np.int64, "t": np.int64, "low": np.uint32, "many": np.uint8}
_STRINGS = {k: _ANCHOR[k] for k in ("id", "t", "low", "many")}
_ASKED = _STRINGS | {"part": np.uint8, "lead": np.bool_}


def _schema(keys: str, kinds: dict, *more: str) -> str:
    return ", ".join([*(f"{k} long" for k in keys.split()), *(f"{k} binary" for k in (*kinds, *more))])


def _binary(v: np.ndarray, cut: np.ndarray) -> pa.Array:
    """v as packed arrays that begin at the given places."""
    v = np.ascontiguousarray(v)
    return pa.Array.from_buffers(pa.binary(), len(cut), [None, pa.py_buffer((np.append(cut, len(v)) * v.itemsize).astype(np.int32)), pa.py_buffer(v)])


def _blocks(name: str, key: np.ndarray, columns: dict[str, np.ndarray], **more: int | None) -> pa.Table:
    """One row for each key, the columns as packed arrays in the order they have; more: the same number in all rows."""
    o = np.argsort(key, kind="stable")
    key = key[o]
    cut = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
    return pa.table({name: pa.array(key[cut], pa.int64()), **{k: pa.array([v] * len(cut), pa.int64()) for k, v in more.items()}, **{k: _binary(v[o], cut) for k, v in columns.items()}})


def _joined(blocks: pa.Table, kinds: dict) -> list[np.ndarray]:
    """The packed arrays of each column, one after the other."""
    return [np.frombuffer(b"".join(blocks[k].to_pylist()), d) for k, d in kinds.items()]


def _runs(n: np.ndarray) -> np.ndarray:
    """0, 1, ... for each number, as many."""
    return np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)


class _Texts:
    """The distinct (id, t) of a group's rows in order, and their texts with a byte after each."""

    def __init__(self, rows: pa.Table):
        i, t = (rows[c].to_numpy() for c in ("id", "t"))
        o = np.lexsort((i, t))
        new = np.append(True, (i[o][1:] != i[o][:-1]) | (t[o][1:] != t[o][:-1]))[: len(o)]
        self.of = np.empty(len(o), np.int64)  # each row's place among the distinct ones
        self.of[o] = np.cumsum(new) - 1
        self.id, self.t = i[o][new], t[o][new]
        self.raw = [x or b"" for x in rows["text"].cast(pa.binary()).take(pa.array(o[new])).to_pylist()]
        self.size = np.array([len(x) for x in self.raw], np.int64)
        self.begin = np.cumsum(self.size + 1) - self.size - 1
        self.data = np.frombuffer(b"\xff".join([*self.raw, b""]), np.uint8)

    def begins(self, i: np.ndarray, t: np.ndarray) -> np.ndarray:
        """Where the texts of these rows, which have to be there, begin."""
        k = np.searchsorted(self.t, t)
        while (other := self.id[k] != i).any():  # the same t with several ids
            k[other] += 1
        return self.begin[k]


def repeats(docs: DataFrame, length: int, gram: int, made: Callable[[pa.Table, list[bytes], list[bytes], list[int]], pa.Table], schema: str | StructType) -> DataFrame:
    """What `made` makes of the rows of (id, text, and what else there is): it gets some of them, their texts, what is left of each and the number of removed runs."""
    spark = docs.sparkSession
    gram = max(gram, length - 254)  # of any size it finds the same; an anchor's strings are counted in a byte
    buckets = max(8, 4 * docs.rdd.getNumPartitions())
    groups = 4 * max(buckets, partitions(spark))
    t = F.xxhash64("text", "id")
    texts = docs.select(F.pmod(t, F.lit(groups)).alias("d"), t.alias("t"), "*")

    @gives_back
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, t = (b.column(c).to_numpy(zero_copy_only=False) for c in ("id", "t"))
            found = list(anchors([x or b"" for x in b.column("text").cast(pa.binary()).to_pylist()], length, gram))
            if found:
                doc, low, many, a, c = (np.concatenate(x) for x in zip(*found, strict=True))
                values = (a >> np.uint64(32), c, ids[doc], t[doc], low, many)
                yield from _blocks("bucket", (a % np.uint64(buckets)).astype(np.int64), {k: v.astype(d) for (k, d), v in zip(_ANCHOR.items(), values, strict=True)}).to_batches()

    @gives_back
    def judge(p: pa.Table) -> pa.Table:
        a, c, i, t, low, many = _joined(p, _ANCHOR)
        o = np.argsort(a)
        bounds = np.flatnonzero(np.append(True, a[o][1:] != a[o][:-1]))
        several = np.minimum.reduceat(i[o], bounds) < np.maximum.reduceat(i[o], bounds)  # else no document is earlier
        o = o[np.repeat(several, np.diff(np.append(bounds, len(o))))]
        o = o[np.lexsort((t[o], i[o], c[o], a[o]))]
        a, c, i, t, low, many = (v[o] for v in (a, c, i, t, low, many))
        new_a = np.append(True, a[1:] != a[:-1])[: len(a)]
        new_c = new_a | np.append(True, c[1:] != c[:-1])[: len(a)]
        removed = i > i[np.maximum.accumulate(np.where(new_c, np.arange(len(a)), 0))]
        group = np.cumsum(new_a) - 1
        asked = ~removed & (np.bincount(group, weights=new_c)[group] > 1)
        lead = new_c | np.append(True, t[1:] != t[:-1])[: len(a)]  # the others are further places of the same context
        part = (a % SHARDS).astype(np.uint8)
        whole = dict(zip(_ASKED, (i, t, low, many, part, lead), strict=True))
        out = []
        for on, bucket in ((np.flatnonzero(removed), None), (np.flatnonzero(asked), p["bucket"][0].as_py())):
            on = on[np.argsort(part[on], kind="stable")]
            out.append(_blocks("d", np.mod(t[on], groups), {k: v[on] for k, v in whole.items()}, bucket=bucket))
        return pa.concat_tables(out)

    known = texts.filter("id is not null")
    packed = known.select("id", "t", "text").mapInArrow(find, _schema("bucket", _ANCHOR))
    found = stored(packed.groupBy("bucket").applyInArrow(judge, _schema("d bucket", _ASKED)))

    # all columns are read in both steps, else each had a shuffle of its own
    base = known.repartition(partitions(spark), "d").groupBy("d")

    @gives_back
    def cut(rows: pa.Table, blocks: pa.Table) -> pa.Table:
        group = _Texts(rows)
        i, t, low, many, part, lead = _joined(blocks, _ASKED)
        size = many[lead] + np.int64(length - 1)
        raw = group.data[np.repeat(group.begins(i[lead], t[lead]) + low[lead], size) + _runs(size)]
        of = np.repeat(np.arange(blocks.num_rows), pc.binary_length(blocks["part"]).to_numpy())[lead]
        ends = np.cumsum(np.bincount(of, weights=size, minlength=blocks.num_rows)).astype(np.int64)
        return blocks.select(["bucket", *_ASKED]).append_column("raw", _binary(raw, np.append(0, ends)[:-1]))

    contexts = base.cogroup(found.filter("bucket is not null").groupBy("d")).applyInArrow(cut, _schema("bucket", _ASKED, "raw"))

    @gives_back
    def compare(p: pa.Table) -> pa.Table:
        i, t, low, many, part, lead = _joined(p, _ASKED)
        (data,) = _joined(p, {"raw": np.uint8})
        head = np.flatnonzero(lead)
        places = np.diff(np.append(head, len(lead)))
        size = many[head] + np.int64(length - 1)
        start = np.cumsum(size) - size
        got = []
        for k in np.unique(part):
            on = np.flatnonzero(part[head] == k)
            row, inside = np.repeat(on, size[on] + 1), _runs(size[on] + 1)
            within = inside < size[row]
            text = np.full(len(row), 255, np.uint8)  # a byte that UTF-8 doesn't have, after each
            text[within] = data[(start[row] + inside)[within]]
            sa = suffix_array(text)
            sa = sa[inside[sa] < many[head[row[sa]]]]  # whole strings; no other suffix shares all of their bytes
            lcp, _ = permuted_common_prefixes(text, sa, length)
            new = lcp[sa] < length
            own = i[head[row[sa]]]
            least = np.minimum.reduceat(own, np.flatnonzero(new))
            gone = np.sort(sa[least[np.cumsum(new) - 1] < own])
            first = np.flatnonzero(np.append(True, gone[1:] != gone[:-1] + 1)[: len(gone)])
            n, at = np.diff(np.append(first, len(gone))), gone[first]
            again = places[row[at]]
            place = np.repeat(head[row[at]], again) + _runs(again)
            got.append((place, low[place] + np.repeat(inside[at], again), np.repeat(n, again)))
        place, at, n = (np.concatenate(x) for x in zip(*got, strict=True))
        values = (i[place], t[place], at, n)
        return _blocks("d", np.mod(t[place], groups), {k: v.astype(d) for (k, d), v in zip(_STRINGS.items(), values, strict=True)})

    exact = contexts.groupBy("bucket").applyInArrow(compare, _schema("d", _STRINGS))
    gone = found.filter("bucket is null").select("d", *_STRINGS).unionByName(exact)

    @gives_back
    def left(rows: pa.Table, blocks: pa.Table) -> pa.Table:
        group = _Texts(rows)
        i, t, low, many = _joined(blocks, _STRINGS)
        at = group.begins(i, t) + low
        step = np.zeros(len(group.data) + 1, np.int32)
        np.add.at(step, at, 1)
        np.add.at(step, at + many + (length - 1), -1)
        kept = np.cumsum(step[:-1], dtype=np.int32) <= 0
        rest = group.data[kept].tobytes()
        before = np.append(0, np.cumsum(kept))
        starts = np.flatnonzero(~kept & np.append(True, kept[:-1])[: len(kept)])
        ends = group.begin + group.size
        texts = [rest[x:y] if y - x < len(raw) else raw for raw, x, y in zip(group.raw, before[group.begin].tolist(), before[ends].tolist(), strict=True)]
        runs = (np.searchsorted(starts, ends) - np.searchsorted(starts, group.begin)).tolist()
        of = group.of.tolist()
        return made(rows, [group.raw[k] for k in of], [texts[k] for k in of], [runs[k] for k in of])

    @gives_back
    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = [x or b"" for x in b.column("text").cast(pa.binary()).to_pylist()]
            yield from made(pa.table(b), raw, raw, [0] * len(raw)).to_batches()

    return base.cogroup(gone.groupBy("d")).applyInArrow(left, schema).unionByName(texts.filter("id is null").mapInArrow(whole, schema))


def _rows(docs: DataFrame, id_col: str, text_col: str, *more: Column) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), *more)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, with_text: bool = True) -> DataFrame:
    """id, text (what is left; characters cut in two go), n_bytes, n_removed, n_spans, kept_sha256 (of the bytes left)."""

    def made(rows: pa.Table, raw: list[bytes], kept: list[bytes], runs: list[int]) -> pa.Table:
        out = {"id": rows["id"]} | ({"text": pa.array([k.decode("utf-8", "ignore") for k in kept], pa.string())} if with_text else {})
        numbers = {"n_bytes": [len(r) for r in raw], "n_removed": [len(r) - len(k) for r, k in zip(raw, kept, strict=True)], "n_spans": runs}
        return pa.table(out | {c: pa.array(v, pa.int64()) for c, v in numbers.items()} | {"kept_sha256": pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string())})

    schema = f"id long, {'text string, ' * with_text}n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    return repeats(_rows(docs, id_col, text_col), length, gram, made, schema).withColumnsRenamed({"id": id_col, "text": text_col})


def op8_passage_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), with_text=False)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents without repeated passages, with their columns; n_chars follows the text.

    Rows without an id keep their text; a null text becomes an empty one. Rows of one id are told apart by their texts, and equal rows
    are cut alike; a text of nothing but repeats becomes empty and stays. Very long texts are cut whole. Columns may have any names, and any
    types that Arrow takes. An empty table stays empty."""
    others = {c: f"own_{k}" for k, c in enumerate(docs.columns) if c.lower() != "text" and c != "n_chars"}
    rows = _rows(docs, "doc_id", "text", *[F.col(c).alias(k) for c, k in others.items()])
    schema = rows.select(*others.values(), "text").schema
    kinds = {f.name: to_arrow_type(f.dataType) for f in schema}

    def made(rows: pa.Table, raw: list[bytes], kept: list[bytes], runs: list[int]) -> pa.Table:
        text = pa.array([k.decode("utf-8", "ignore") for k in kept], pa.string())
        return pa.table({c: text if c == "text" else rows[c] if rows[c].type == kind else rows[c].cast(kind) for c, kind in kinds.items()})

    cut = repeats(rows, LENGTH, GRAM, made, schema)
    chars = F.length("text").cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else None
    return cut.select(*[(F.col(others[c]) if c in others else F.col("text") if c.lower() == "text" else chars).alias(c) for c in docs.columns])


QUERIES = {"op8_passage_dedup": op8_passage_dedup}
SQL: dict[str, str] = {}
