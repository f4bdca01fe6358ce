"""Token ids as length-delimited binary records, with an offset index for shuffled reads.

A record file is a sequence of frames, each
    length      8 bytes, little-endian
    length crc  4 bytes, masked CRC-32C of the 8 length bytes
    payload     `length` bytes: token ids, little-endian unsigned, 2 bytes each (4 if the vocabulary needs it)
    payload crc 4 bytes, masked CRC-32C of the payload
with mask(c) = rotate_right(c, 15) + 0xa282ead8 mod 2^32. Files hold ranges of ascending ids, and part
numbers ascend with them. The index is a Parquet table: part, file, doc_id, position (of the frame in
the file), n_tokens, part_start (ids before it in its file).

Files go through pyarrow.fs to the folder that all machines share. A task writes under a name of its
own and renames at the end; index rows name the file of the attempt that Spark kept, so retried and
speculative tasks do no harm.

Nulls count as empty texts, and an empty text gives a record with the end id alone. A null id sorts
first. Repeated rows give a record each. Very long texts are one record each. Only the id and the text column are read, so other columns
can't clash. An empty table gives an empty index.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from archivist.llm.common import partitions, shared_folder, shuffles_freed, table
from archivist.llm.encode import default_tokenizer, encoder

END = 2
_BLOCK = 256


def _crc_tables() -> np.ndarray:
    t = np.zeros((8, 256), np.uint32)
    v = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        v = np.where(v & 1, (v >> 1) ^ np.uint32(0x82F63B78), v >> 1).astype(np.uint32)  # the reflected Castagnoli polynomial
    t[0] = v
    for k in range(1, 8):
        t[k] = (t[k - 1] >> 8) ^ t[0][t[k - 1] & 255]
    return t


_T = _crc_tables()


def _advance(regs: np.ndarray, n: int) -> np.ndarray:
    """CRC registers after n zero bytes."""
    for _ in range(n):
        regs = (regs >> 8) ^ _T[0][regs & 255]
    return regs


#: What _BLOCK zero bytes make of each byte of a register; the map is linear.
_SHIFT = np.stack([_advance(np.arange(256, dtype=np.uint32) << (8 * k), _BLOCK) for k in range(4)])


def crc32c(payloads: list[bytes]) -> np.ndarray:
    """CRC-32C of each payload. All blocks of all payloads advance together, then are joined by payload."""
    sizes = np.array([len(p) for p in payloads], np.int64)
    blocks = np.maximum(-(-sizes // _BLOCK), 1)
    first = np.cumsum(blocks) - blocks
    data = np.zeros((int(blocks.sum()), _BLOCK), np.uint8)  # zeros stand before the first block's bytes
    flat = data.reshape(-1)
    ends = (first + blocks) * _BLOCK
    for p, n, e in zip(payloads, sizes.tolist(), ends.tolist(), strict=True):
        flat[e - n : e] = np.frombuffer(p, np.uint8)
    regs = np.zeros(len(data), np.uint32)
    words = data.view("<u4")
    for k in range(0, _BLOCK // 4, 2):
        a, b = regs ^ words[:, k], words[:, k + 1]
        regs = _T[7][a & 255] ^ _T[6][a >> 8 & 255] ^ _T[5][a >> 16 & 255] ^ _T[4][a >> 24] ^ _T[3][b & 255] ^ _T[2][b >> 8 & 255] ^ _T[1][b >> 16 & 255] ^ _T[0][b >> 24]
    out = regs[first]
    for k in range(1, int(blocks.max(initial=1))):
        on = np.flatnonzero(blocks > k)
        r = out[on]
        out[on] = _SHIFT[0][r & 255] ^ _SHIFT[1][r >> 8 & 255] ^ _SHIFT[2][r >> 16 & 255] ^ _SHIFT[3][r >> 24] ^ regs[first[on] + k]
    # what the start value of all ones becomes after as many bytes; by powers of two
    start = np.full(len(sizes), 0xFFFFFFFF, np.uint32)
    step = [np.arange(256, dtype=np.uint32) << (8 * k) for k in range(4)]
    step = np.stack([_advance(s, 1) for s in step])
    left = sizes.copy()
    while left.any():
        on = np.flatnonzero(left & 1)
        r = start[on]
        start[on] = step[0][r & 255] ^ step[1][r >> 8 & 255] ^ step[2][r >> 16 & 255] ^ step[3][r >> 24]
        step = np.stack([step[0][s & 255] ^ step[1][s >> 8 & 255] ^ step[2][s >> 16 & 255] ^ step[3][s >> 24] for s in step])
        left >>= 1
    return ~(out ^ start)


def mask(c: np.ndarray) -> np.ndarray:
    return ((c >> np.uint32(15)) | (c << np.uint32(17))) + np.uint32(0xA282EAD8)


def frames(payloads: list[bytes]) -> list[bytes]:
    heads = [struct.pack("<Q", len(p)) for p in payloads]
    a, b = mask(crc32c(heads)).tolist(), mask(crc32c(payloads)).tolist()
    return [h + struct.pack("<I", x) + p + struct.pack("<I", y) for h, x, p, y in zip(heads, a, payloads, b, strict=True)]


def unframe(raw: list[bytes]) -> list[bytes]:
    """Payloads of whole frames; raises where a length or a checksum is wrong."""
    payloads = [r[12:-4] for r in raw]
    if any(struct.unpack("<Q", r[:8])[0] != len(p) for r, p in zip(raw, payloads, strict=True)):
        raise ValueError("a record has another length than its frame says")
    heads = np.array([struct.unpack("<I", r[8:12])[0] for r in raw], np.uint32)
    tails = np.array([struct.unpack("<I", r[-4:])[0] for r in raw], np.uint32)
    if (mask(crc32c([r[:8] for r in raw])) != heads).any() or (mask(crc32c(payloads)) != tails).any():
        raise ValueError("a record's checksum is wrong")
    return payloads


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def write_records(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end: int | None = END) -> DataFrame:
    """Write one file for each range of ids under the folder (a URI) and the index beside them; returns the index."""
    spark, path = docs.sparkSession, tokenizer or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e, part, files = encoder(path), TaskContext.get().partitionId(), None
        tail = np.array([] if end is None else [end], e.dtype).tobytes()
        name = f"part-{part:06d}-{uuid.uuid4().hex}.rec"
        at = start = 0
        out = None
        for b in batches:
            if not b.num_rows:
                continue
            if out is None:
                files, root = _filesystem(folder)
                files.create_dir(root, recursive=True)
                out = files.open_output_stream(f"{root}/_{name}")
            payloads = [x + tail for x in e.encode(b.column(1).to_pylist())]
            framed = frames(payloads)
            for f in framed:
                out.write(f)
            n = np.array([len(p) for p in payloads], np.int64)
            tokens = n // e.dtype.itemsize
            position, starts = at + np.cumsum(n + 16) - n - 16, start + np.cumsum(tokens) - tokens
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), part), pa.int32()), pa.array([name] * len(n)), b.column(0), pa.array(position), pa.array(tokens), pa.array(starts)], names=["part", "file", "doc_id", "position", "n_tokens", "part_start"])
            at, start = int(position[-1] + n[-1] + 16), int(starts[-1] + tokens[-1])
        if out is not None:
            out.close()
            files.move(f"{root}/_{name}", f"{root}/{name}")

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    ordered = rows.repartitionByRange(2 * partitions(spark), "doc_id").sortWithinPartitions("doc_id", "text")
    index = ordered.mapInArrow(run, "part int, file string, doc_id long, position long, n_tokens long, part_start long")
    with shuffles_freed(spark):
        index.write.parquet(f"{folder}/index")
    return spark.read.schema(index.schema).parquet(f"{folder}/index")


def starts(index: DataFrame) -> DataFrame:
    """The index with `start`: ids of all documents before. The running sum goes over files, not documents."""
    files = index.groupBy("part").agg(F.sum("n_tokens").alias("_n"))
    before = files.select("part", (F.sum("_n").over(Window.orderBy("part")) - F.col("_n")).alias("_before"))
    return index.join(F.broadcast(before), "part").withColumn("start", F.col("_before") + F.col("part_start")).drop("_before")


def read_records(index: DataFrame, folder: str, width: int) -> DataFrame:
    """Each index row with the payload of its record, read at its offset and checked."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, root = _filesystem(folder)
        name, opened = None, None
        for b in batches:
            raw = []
            for f, p, n in zip(b["file"], b["position"], b["n_tokens"], strict=True):
                if f != name:
                    if opened is not None:
                        opened.close()
                    name, opened = f, files.open_input_file(f"{root}/{f}")
                opened.seek(p)
                raw.append(opened.read(n * width + 16))
            yield b.assign(payload=unframe(raw))
        if opened is not None:
            opened.close()

    return index.mapInPandas(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in index.schema) + ", payload binary")


def width_of(tokenizer: str | None = None) -> int:
    return encoder(tokenizer or default_tokenizer()).dtype.itemsize


def op1_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, width = shared_folder(spark), width_of()
    index = starts(write_records(table(spark, sf_dir, "documents"), folder))

    @F.pandas_udf("long")
    def crc(payload: pd.Series) -> pd.Series:
        return payload.map(lambda p: zlib.crc32(np.frombuffer(p, f"<u{width}").astype("<u4").tobytes()))

    read = read_records(index, folder, width)
    return read.select("doc_id", "start", F.col("n_tokens"), crc("payload").alias("ids_crc32"))


QUERIES = {"op1_token_records": op1_token_records}
SQL: dict[str, str] = {}
