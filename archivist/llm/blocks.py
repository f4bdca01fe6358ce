"""Searches of many queries in blocks of an index: tasks hold one block at a time and stream the queries sent to it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def index_and_queries(batches: Iterator[pa.RecordBatch], keys: int, held: int) -> Iterator[tuple[list[pa.RecordBatch], list[pa.RecordBatch]]]:
    """Of rows sorted by their first `keys` columns, which name a block, and then by a side (0 the index, 1 queries): the batches of each
    block's index, with its queries in portions of about `held` rows. The list of a block's index stays the same object; a block without
    an index or without queries is left out."""
    index: list[pa.RecordBatch] = []
    queries: list[pa.RecordBatch] = []
    n, now = 0, None
    for b in batches:
        if not b.num_rows:
            continue
        k = np.stack([b.column(i).to_numpy(zero_copy_only=False) for i in range(keys + 1)], 1)
        cut = np.flatnonzero((k[1:] != k[:-1]).any(1)) + 1
        for x, y in zip([0, *cut.tolist()], [*cut.tolist(), len(k)], strict=True):
            key = tuple(k[x, :-1].tolist())
            if key != now:
                if index and queries:
                    yield index, queries
                index, queries, n, now = [], [], 0, key
            part = b.slice(x, y - x)
            if k[x, -1] == 0:
                index.append(part)
            elif index:
                queries.append(part)
                n += y - x
                if n >= held:
                    yield index, queries
                    queries, n = [], 0
    if index and queries:
        yield index, queries


def gathered(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at least so many."""
    held: list[pa.RecordBatch] = []
    n = 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= rows:
            yield pa.concat_batches(held)
            held, n = [], 0
    if n:
        yield pa.concat_batches(held)
