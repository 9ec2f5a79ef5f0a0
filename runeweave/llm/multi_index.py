"""Approximate nearest neighbours by multi-index hashing.

Codes: the unit vectors are rotated by orthogonal matrices learned on a bounded sample (iterative
quantisation: alternate between the signs and the best rotation onto them); the signs of each
rotation give as many bits as there are dimensions.  The code is split into substrings, and each
substring has its own index.  With radius r = parts * a + b, a code within r of the query's is
within a in one of the first b + 1 substrings or within a - 1 in another: probing those values
finds every code within r.  The found codes are checked and their vectors compared in double
precision.  The radius is learned on the sample too, as that which holds `reach` of its true
neighbours; a sample's neighbours are farther than the whole table's, so it errs to the wide side.

Every row is indexed: a task indexes the chunk of rows that it holds and probes it for a broadcast
block of queries; only each chunk's k best leave it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut
from .vectors import BLOCK, by_length, clean, largest, query_blocks, stacked

#: Bits of a substring.
PART_BITS = 8


@dataclass(frozen=True)
class Codes:
    """Learned rotations of vectors of one length, and the radius to search."""

    rotations: np.ndarray
    radius: int

    def code(self, x: np.ndarray) -> np.ndarray:
        """Packed codes, a byte for each substring."""
        return np.packbits(x @ self.rotations > 0, axis=1)

    @property
    def parts(self) -> int:
        return (self.rotations.shape[1] + 7) // 8


def unit(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        top = np.abs(x).max(axis=1, keepdims=True)
        x = x / top
        return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def learn(sample: np.ndarray, bits: int, k: int, reach: float, rounds: int = 30, seed: int = 7) -> Codes:
    """Rotations and radius from unit vectors."""
    n, d = sample.shape
    random = np.random.default_rng(seed)
    _, axes = np.linalg.eigh(sample.T @ sample)
    rotations = []
    for _ in range(-(-bits // d)):
        turn, _ = np.linalg.qr(random.standard_normal((d, d)))
        v = sample @ axes
        for _ in range(rounds):
            u, _, w = np.linalg.svd(np.where(v @ turn > 0, 1.0, -1.0).T @ v)
            turn = (u @ w).T
        rotations.append(axes @ turn)
    codes = Codes(np.concatenate(rotations, axis=1), 0)
    own = codes.code(sample)
    far = []
    for i in range(min(n, 300)):
        s = sample @ sample[i]
        s[i] = -2
        near = np.argsort(-s)[: min(k, n - 1)]
        far += np.bitwise_count(own[near] ^ own[i]).sum(axis=1).tolist()
    return Codes(codes.rotations, int(np.ceil(np.quantile(far, reach))) if far else bits)


class Index:
    """The substring indexes of a chunk."""

    def __init__(self, codes: Codes, x: np.ndarray):
        self.codes, self.packed = codes, codes.code(x)
        self.order = np.argsort(self.packed, axis=0, kind="stable")
        values = np.take_along_axis(self.packed, self.order, axis=0)
        self.start = np.stack([np.searchsorted(values[:, j], np.arange(257)) for j in range(codes.parts)])
        self.near = [np.flatnonzero(np.bitwise_count(np.arange(256, dtype=np.uint8)) <= a).astype(np.uint8) for a in range(PART_BITS + 1)]

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Rows whose code is within the radius."""
        a, b = divmod(radius, self.codes.parts)
        hit = np.zeros(len(self.packed), bool)
        for j in range(self.codes.parts):
            reach = min(a if j <= b else a - 1, PART_BITS)
            if reach < 0:
                continue
            values = (self.near[reach] ^ code[j]).astype(np.int64)
            first, n = self.start[j, values], self.start[j, values + 1] - self.start[j, values]
            at = np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())
            hit[self.order[at, j]] = True
        rows = np.flatnonzero(hit)
        return rows[np.bitwise_count(self.packed[rows] ^ code).sum(axis=1) <= radius]


def nearest(vectors: DataFrame, k: int = 5, every: int = 50, bits: int = 128, sample_rows: int = 4096, reach: float = 0.98, block: int = BLOCK, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score double): each query's k nearest found by cosine, ties to the smaller id.

    Queries: rows whose id is divisible by `every`; candidates: all rows of the same length and
    another id.  The index is fitted on at most `sample_rows` rows, taken by a hash of the id, and
    holds every row.  A query that finds fewer than k rows within the radius is searched again with
    the widest radius, which holds every row.  Vectors null, empty, zero, or with null or non-finite
    components, and rows without an id, take no part; an empty table gives no rows; repeated rows
    are candidates each.
    """
    spark = vectors.sparkSession
    whole = clean(vectors, id_col, vec_col).where(F.exists("v", lambda x: x != 0))
    taken = whole.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample_rows).collect()
    learned = {n: learn(unit(x), bits, k, reach) for n, (_, x) in stacked([(r[0], r[1]) for r in taken]).items()}
    blocks = [_search(whole, b, learned, k) for b in query_blocks(whole.where(F.col("vec_id") % every == 0), block)]
    if not blocks:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    out = blocks[0]
    for b in blocks[1:]:
        out = out.unionByName(b)
    return out


def _search(whole: DataFrame, block: list, learned: dict[int, Codes], k: int) -> DataFrame:
    """The block's queries within the radius; those that found too few, of candidates enough, without one."""
    found = cut(_probed(whole, block, learned, k))
    enough = {r[0] for r in found.groupBy("query_id").count().where(F.col("count") >= k).select("query_id").collect()}
    few = [(i, v) for i, v in block if i not in enough]
    if not few:
        return found
    widest = {n: replace(c, radius=c.rotations.shape[1]) for n, c in learned.items()}
    rest = [i for i, _ in few]
    return found.where(~F.col("query_id").isin(rest)).unionByName(_probed(whole, few, widest, k))


def _probed(whole: DataFrame, block: list, learned: dict[int, Codes], k: int) -> DataFrame:
    sent = whole.sparkSession.sparkContext.broadcast((stacked(block), learned))

    def probe(batches: Iterator[pa.RecordBatch]):
        queries, codes = sent.value
        for b in batches:
            out = [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]]
            for n, ids, x in by_length(np.asarray(b.column("vec_id")), b.column("v")):
                if n not in queries:
                    continue
                qid, q = queries[n]
                x, q = unit(x), unit(q)
                index = Index(codes[n], x) if n in codes else None
                coded = codes[n].code(q) if n in codes else q
                for i, query in enumerate(qid):
                    rows = index.within(coded[i], codes[n].radius) if index else np.arange(len(ids))
                    rows = rows[ids[rows] != query]
                    score = np.einsum("ij,j->i", x[rows], q[i])
                    best = largest(score, ids[rows], k)
                    for column, values in zip(out, (np.full(len(best), query), ids[rows[best]], score[best])):
                        column.append(values)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], names=["query_id", "vec_id", "score"])

    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found = whole.mapInArrow(probe, "query_id long, vec_id long, score double")
    return found.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
