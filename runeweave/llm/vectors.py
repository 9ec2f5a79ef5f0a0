"""What the searches over vectors share: clean rows, blocks of queries, packed chunks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Queries that are broadcast at once.
BLOCK = 2048


def finite(embedding: Column) -> Column:
    """Whether a vector takes part: not null, not empty, no null, NaN or infinite component."""
    bad = F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return embedding.isNotNull() & (F.size(embedding) > 0) & ~bad


def clean(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id long, v array<double>) of the vectors that take part; rows without an id take none."""
    v = F.col(vec_col).cast("array<double>")
    return vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & finite(F.col("v")))


def by_length(ids: np.ndarray, column: pa.Array):
    """(ids, matrix) for each length of vector that the rows have."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = np.asarray(column.value_lengths())
    flat, at = np.asarray(column.flatten(), np.float64), np.concatenate([[0], np.cumsum(n)])
    for length in np.unique(n):
        rows = np.flatnonzero(n == length)
        yield int(length), ids[rows], flat[at[rows][:, None] + np.arange(length)]


def query_blocks(queries: DataFrame, size: int = BLOCK):
    """The queries as lists of (id, vector), at most `size` at a time on the driver, whatever their number."""
    block = []
    for row in queries.toLocalIterator():
        block.append((row[0], row[1]))
        if len(block) == size:
            yield block
            block = []
    if block:
        yield block


def stacked(block: list) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """A block's queries by length: ids and matrix."""
    out: dict[int, tuple[list, list]] = {}
    for i, v in block:
        ids, rows = out.setdefault(len(v), ([], []))
        ids.append(i)
        rows.append(v)
    return {n: (np.array(ids, np.int64), np.array(rows, np.float64)) for n, (ids, rows) in out.items()}


def largest(s: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest scores, ties to smaller ids."""
    if len(s) > k:
        edge = np.partition(s, len(s) - k)[len(s) - k]
        at = np.flatnonzero(s >= edge)
    else:
        at = np.arange(len(s))
    return at[np.lexsort((ids[at], -s[at]))[:k]]
