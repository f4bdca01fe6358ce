"""Packing of token sequences by shortest-pack-first over the histogram of lengths.

Documents are cut into pieces of at most `width` ids; whole pieces fill a sequence each. The lengths
of all pieces are counted, and the histogram, of `width` bins at most whatever the size of the input,
is packed on the driver: from the longest length to the shortest, each length joins the emptiest packs
that it fits (packs are counted by pattern, not one by one), or opens new ones. Patterns are then joined back to the pieces by length and rank within the length. Ranks are counted within partitions first, so a
length that most pieces have is spread over all tasks.

Nulls count as empty texts; every document has at least the end id. Rows without an id are packed as any other, and repeated rows each
for itself. Very long texts are cut whole. Only the id and the text column are read, so other columns can't clash. An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from archivist.llm.common import stored, table
from archivist.llm.encode import MEMORY, default_tokenizer, encoder

WIDTH, END = 1024, 0
#: Parts whose counts are broadcast at most, an array of `width` numbers each (80 MB); of more parts they are joined by a shuffle.
PARTS = 10_000


def shortest_pack_first(histogram: dict[int, int], width: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a pack, number of such packs), whole packs last. The work depends on the histogram's bins only."""
    free: list[dict[tuple[int, ...], int]] = [{} for _ in range(width + 1)]  # by free room
    for length in sorted(histogram, reverse=True):
        left, room = histogram[length], width
        while left and room >= length:
            if not free[room]:
                room -= 1
                continue
            pack, n = free[room].popitem()
            take = min(n, left)
            if n > take:
                free[room][pack] = n - take
            grown = (*pack, length)
            free[room - length][grown] = free[room - length].get(grown, 0) + take
            left -= take
        while left:  # new packs hold as many of this length as fit, so that they count as one pattern
            each = min(width // length, left)
            packs = left // each
            pack = (length,) * each
            free[width - each * length][pack] = free[width - each * length].get(pack, 0) + packs
            left -= packs * each
    return [(pack, n) for room in range(width, -1, -1) for pack, n in free[room].items()]


def _slots(patterns: list[tuple[tuple[int, ...], int]]) -> pd.DataFrame:
    """length, low, high, sequence, offset: pieces of a length with ranks in [low, high) go to the sequences from `sequence` on."""
    rows, used, sequence = [], {}, 0
    for pack, n in patterns:
        offset = 0
        for length in pack:
            low = used.get(length, 0)
            rows.append((length, low, low + n, sequence, offset))
            used[length] = low + n
            offset += length
        sequence += n
    return pd.DataFrame(rows, columns=["length", "low", "high", "sequence", "offset"], dtype="int64")


def cut_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, width: int = WIDTH, end: int | None = END, with_ids: bool = False, memory: int = MEMORY) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, part, rank (within the part and length) and, if asked for, ids."""
    path = tokenizer or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e, part, ranks = encoder(path, memory), TaskContext.get().partitionId(), np.zeros(width + 1, np.int64)
        tail = np.array([] if end is None else [end], e.dtype).tobytes()
        for b in batches:
            ids, doc, start, crc, total, kept = b.column(0).to_pylist(), [], [], [], [], []
            for i, raw in zip(ids, e.encode(b.column(1).to_pylist()), strict=True):
                tokens = np.frombuffer(raw + tail, e.dtype).astype("<u4")
                for s in range(0, len(tokens), width):
                    doc.append(i)
                    start.append(s)
                    crc.append(zlib.crc32(tokens[s : s + width].tobytes()))
                    total.append(len(tokens))
                if with_ids:
                    kept.append(tokens.astype(np.int32))
            starts, totals = np.array(start, np.int64), np.array(total, np.int64)
            lengths = np.minimum(width, totals - starts)
            order = np.argsort(lengths, kind="stable")
            run_start = np.searchsorted(lengths[order], lengths[order], "left")
            rank = np.empty(len(lengths), np.int64)
            rank[order] = np.arange(len(lengths)) - run_start
            rank += ranks[lengths]
            ranks += np.bincount(lengths, minlength=width + 1)
            columns = [pa.array(doc, pa.int64()), pa.array(starts), pa.array(lengths), pa.array(crc, pa.int64()), pa.array(totals), pa.array(np.full(len(rank), part), pa.int64()), pa.array(rank)]
            if with_ids:
                bounds = np.r_[0, np.cumsum(lengths)].astype(np.int32)  # pieces follow one another as the ids do
                columns.append(pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.concatenate(kept) if kept else np.empty(0, np.int32))))
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "part", "rank"] + ["ids"] * with_ids)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part long, rank long" + (", ids array<int>" if with_ids else ""))


def place(pieces: DataFrame, width: int = WIDTH) -> DataFrame:
    """Pieces (with length, part, rank) with their sequence_id and offset. Read twice, so they have to be stored."""
    spark = pieces.sparkSession
    counts = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    parts = counts.select("part").distinct()
    dense = parts.select("part", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(width).cast("long"))).alias("length")).join(counts, ["length", "part"], "left")
    w = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # rows of a length: one for each part
    before = dense.select("length", "part", F.coalesce(F.sum("n").over(w), F.lit(0).cast("long")).alias("_before"))
    before = before.groupBy("part").agg(F.sort_array(F.collect_list(F.struct("length", "_before"))).alias("b")).select("part", F.col("b._before").alias("_before"))
    if parts.count() <= PARTS:
        before = F.broadcast(before)  # so that the pieces with their ids aren't shuffled
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `width` rows
    slots = _slots(shortest_pack_first(histogram, width))
    frame = spark.createDataFrame(slots, "length long, low long, high long, sequence long, offset long") if len(slots) else spark.createDataFrame([], "length long, low long, high long, sequence long, offset long")
    # bounded by the patterns, which depend on the bins of the histogram only
    ranked = pieces.join(before, "part").withColumn("rank", F.col("rank") + F.element_at("_before", F.col("length").cast("int"))).drop("_before")
    s = F.broadcast(frame.withColumnRenamed("length", "_length"))
    on = (F.col("length") == F.col("_length")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high"))
    return ranked.join(s, on).withColumn("sequence_id", F.col("sequence") + F.col("rank") - F.col("low")).drop("_length", "low", "high", "sequence", "part", "rank")


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, width: int = WIDTH, with_ids: bool = False, memory: int = MEMORY) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids). memory: words that a worker remembers."""
    pieces = stored(cut_pieces(docs, id_col, text_col, tokenizer, width, with_ids=with_ids, memory=memory))
    return place(pieces, width).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *["ids"] * with_ids)


def sequences(packed: DataFrame, width: int = WIDTH, pad: int = 0) -> DataFrame:
    """sequence_id, ids (padded to width) and lengths, from pack(..., with_ids=True). A group has `width` pieces at most."""
    g = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids", "length"))).alias("p"))
    ids = F.flatten(F.col("p.ids"))
    return g.select("sequence_id", F.concat(ids, F.array_repeat(F.lit(pad).cast("int"), F.lit(width) - F.size(ids))).alias("ids"), F.col("p.length").alias("lengths"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


QUERIES = {"op3_packing": op3_packing}
SQL: dict[str, str] = {}
