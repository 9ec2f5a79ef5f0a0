"""Helpers shared by the operators of this folder."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a side that grows with the data may be broadcast; beyond it, joins shuffle.
BROADCAST_ROWS = 300_000
#: Elements of arrays in all rows of such a side, up to which it may be broadcast.
BROADCAST_ITEMS = 1_000_000
#: Bytes of text that numpy works on at once in a Python worker.
SLICE_BYTES = 1 << 20


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir; in a local session without it, a temporary one.

    A cluster must name one: a folder of the driver's own would be out of the executors' reach.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        set_to = spark.sparkContext._jsc.sc().getCheckpointDir()
        if set_to.isDefined():
            return set_to.get()
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and the executors share")
        where = tempfile.mkdtemp(prefix="checkpoint-")
        spark.sparkContext.setCheckpointDir(where)
        where = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    elif not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(where)
    return where


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Compute df once and cut its lineage: the rows go to the shared folder, from which any executor can read them."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def whole_text(text: str = "text") -> Column:
    """A text column in which null counts as empty."""
    return F.coalesce(F.col(text).cast("string"), F.lit(""))


def small_enough(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether df has at most so many rows; reads no more than that."""
    return df.limit(rows + 1).count() <= rows


def with_side(df: DataFrame, side: DataFrame, on: str | list[str], how: str = "inner", rows: int = BROADCAST_ROWS, items: str | None = None) -> DataFrame:
    """Join df with a narrow side: broadcast if its row count, and the elements of its array column `items`, allow it; by a shuffle of both otherwise.

    `side` should be cheap to count (a checkpoint).
    """
    small = small_enough(side, rows)
    if small and items:
        small = (side.agg(F.sum(F.size(items))).first()[0] or 0) <= BROADCAST_ITEMS
    return df.join(F.broadcast(side) if small else side, on, how)


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of an Arrow column of texts, or the bytes of a binary one, and where each row begins and the last one ends. Null counts as empty."""
    column = column.cast(pa.large_binary()).fill_null(b"") if pa.types.is_binary(column.type) else column.cast(pa.large_string()).fill_null("")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, n + 1, column.offset * 8)
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def slices(at: np.ndarray, most: int = SLICE_BYTES):
    """Ranges of rows of about `most` bytes; a longer row is alone."""
    first, n = 0, len(at) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(at, at[first] + most, "right")) - 1)
        yield first, min(last, n)
        first = last
