"""Near-duplicate documents by SuperMinHash: signatures, banding, exact verification, union-find."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, slices, text_buffers, with_side
from .linking import Links, mates
from .minhash import bands, super_minhash
from .textstats import mix, word_shingles


def _digests(row: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of each row's set: equal for equal sets."""
    total = np.zeros(n + 1, np.uint64)
    at = np.searchsorted(row, np.arange(n + 1))
    np.cumsum(mix(h ^ np.uint64(0xA5A5A5A5A5A5A5A5)), out=(sums := np.zeros(len(h) + 1, np.uint64))[1:])
    total = sums[at[1:]] - sums[at[:-1]]
    return mix(total + mix(np.diff(at).astype(np.uint64))).view(np.int64)


def signed(docs: DataFrame, size: int, length: int, each: int, id_col: str, text_col: str) -> DataFrame:
    """(id, n, node, bands): set size, set hash and bands of each row; no bands for an empty set."""

    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            data, at = text_buffers(b.column(1))
            for i, j in slices(at):
                row, h = word_shingles(data[at[i] : at[j]], at[i : j + 1] - at[i], size)
                n = np.bincount(row, minlength=j - i)
                s = bands(super_minhash(h, row, j - i, length), each)
                flat = pa.array(s[n > 0].ravel(), pa.int64())
                ends = np.concatenate([[0], np.cumsum(np.where(n > 0, s.shape[1], 0))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(n, pa.int64()), pa.array(_digests(row, h, j - i), pa.int64()), pa.ListArray.from_arrays(pa.array(ends), flat)], names=["id", "n", "node", "bands"])

    chosen = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return chosen.mapInArrow(run, f"id {chosen.schema['id'].dataType.simpleString()}, n long, node long, bands array<long>")


def shingle_set(text: str, size: int) -> np.ndarray:
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    return word_shingles(data, np.array([0, len(data)]), size)[1]


def shingle_sets(texts: pa.Array, size: int) -> list[np.ndarray]:
    """`shingle_set` of each text of a column."""
    out = []
    data, at = text_buffers(texts)
    for i, j in slices(at):
        row, h = word_shingles(data[at[i] : at[j]], at[i : j + 1] - at[i], size)
        ends = np.searchsorted(row, np.arange(j - i + 1)).tolist()
        out += [h[a:b] for a, b in zip(ends[:-1], ends[1:])]
    return out


def groups(docs: DataFrame, size: int = 5, numerator: int = 80, denominator: int = 100, length: int = 100, each: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of each row of docs.

    A document's set holds its distinct shingles of `size` lower-cased words, or the whole sequence
    if it has fewer; documents with denominator * |intersection| >= numerator * |union| are linked.
    component_id is the smallest id reachable, kept says whether it is the row's own.  Null or empty
    texts, and texts without words, are linked with nothing, and their component is their own id.
    A row without an id is linked with nothing, belongs to no component and is kept.  Repeated rows
    count as copies, each with its own row in the result; an empty table gives no rows.
    """
    x = cut(signed(docs, size, length, each, id_col, text_col))
    used = x.where("n > 0 and id is not null")
    shared = mates(used)
    wanted = cut(shared.select("node").distinct().join(used.groupBy("node").agg(F.min("id").alias("rep")), "node"))
    texts = cut(_texts(docs, wanted, size, id_col, text_col))
    roots = Links(lambda t: shingle_set(t, size), numerator, denominator, lambda t: shingle_sets(t, size)).components(shared, texts)
    rooted = used.select("id", "node").join(roots.withColumnRenamed("id", "node"), "node", "left").select("id", "node", F.coalesce("root", "node").alias("root"))
    least = rooted.groupBy("root").agg(F.min("id").alias("component_id"))
    by_node = rooted.groupBy("node").agg(F.first("root").alias("root")).join(least, "root").select("node", "component_id")
    out = x.select("id", "n", F.when(F.expr("n > 0 and id is not null"), F.col("node")).alias("node")).join(by_node, "node", "left")
    component = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))


def _texts(docs: DataFrame, wanted: DataFrame, size: int, id_col: str, text_col: str) -> DataFrame:
    """(node, text) of the wanted nodes, by a document of each."""

    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            data, at = text_buffers(b.column("text"))
            own = [np.zeros(0, np.int64)]
            for i, j in slices(at):
                row, h = word_shingles(data[at[i] : at[j]], at[i : j + 1] - at[i], size)
                own.append(_digests(row, h, j - i))
            right = np.concatenate(own) == np.asarray(b.column("node"))
            yield b.select(["node", "text"]).filter(pa.array(right))

    side = wanted.select(F.col("rep").alias("id"), "node")
    found = with_side(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")), side, "id")
    return found.select("node", "text").mapInArrow(run, "node long, text string").dropDuplicates(["node"])


def deduplicate(docs: DataFrame, id_col: str = "doc_id", **how) -> DataFrame:
    """docs with one document of each group: the one of the smallest id.  Of repeated rows of that id one stays; rows without an id stay."""
    found = cut(groups(docs, id_col=id_col, **how))
    stay = with_side(docs, cut(found.where("not kept").select(id_col).distinct()), id_col, "left_anti")
    again = cut(found.where(F.col(id_col).isNotNull()).groupBy(id_col).count().where("count > 1").select(id_col))
    if not again.head(1):
        return stay
    return with_side(stay, again, id_col, "left_anti").unionByName(with_side(stay, again, id_col, "left_semi").dropDuplicates([id_col]))
