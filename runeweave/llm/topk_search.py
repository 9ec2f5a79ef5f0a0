"""Exact top-k search by a three-phase uniform threshold.

A vector's dimensions are dealt to `lists` groups; each group is a list of local scores, and a
candidate's score is the sum over the lists.  With every list shifted so that its least value is 0:

1. each list's k best entries give lower bounds; the k-th best bound of a query is its cutoff t;
2. t / lists is broadcast; a candidate below it in all lists cannot reach t, so the entries at or
   above it suffice.  They give a better cutoff, and an upper bound (the entry where there is one,
   t / lists where not) for each candidate seen;
3. only candidates whose upper bound reaches the better cutoff are resolved exactly.

Candidates stay where they are: a task goes through them in tiles of bounded size with all lists,
only bounds and survivors move.  Queries are broadcast in blocks of bounded size.  Local scores are
not kept between the phases: the second job computes them again, which costs less than storing them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut
from .vectors import BLOCK, by_length, clean, largest, query_blocks, stacked

#: Sums up to this are exact in double precision.
EXACT = float(1 << 53)
#: Bytes of the local scores that a task holds at once.
TILE = 64 << 20


def _lists(q: np.ndarray, x: np.ndarray, lists: int) -> list[np.ndarray]:
    """Local scores, exact integers: float64 where it holds them, else Python's integers."""
    if q.size and x.size and q.shape[1] * max(1.0, np.abs(q).max()) * max(1.0, np.abs(x).max()) >= EXACT:
        exact = np.vectorize(int, otypes=[object])
        q, x = exact(q), exact(x)
    return [q[:, part] @ x[:, part].T for part in np.array_split(np.arange(q.shape[1]), min(lists, q.shape[1]))]


def _cutoff(t: float, low: list[float]) -> tuple[float, list[float]]:
    """The cutoff and the least values as they are; no cutoff where a double may have rounded one of them."""
    return (t if max(map(abs, [t, sum(low), *low])) < EXACT else -np.inf), low


def _long(x) -> int:
    return max(-(1 << 63), min((1 << 63) - 1, int(x)))


def top_k(vectors: DataFrame, k: int = 10, every: int = 100, scale: float = 1024.0, lists: int = 4, block: int = BLOCK, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score long): the k largest integer inner products of floor(scale * x).

    Queries: rows whose id is divisible by `every`; candidates: all rows of the same length and
    another id.  Ties go to the smaller id.  Vectors null, empty, or with null or non-finite
    components, and rows without an id, take no part; an empty table gives no rows; repeated rows
    are candidates each.  Scores beyond 64 bits are held at its ends.
    """
    whole = clean(vectors, id_col, vec_col).withColumn("v", F.transform("v", lambda x: F.floor(x * scale).cast("double")))
    blocks = [_search(whole, b, k, lists) for b in query_blocks(whole.where(F.col("vec_id") % every == 0), block)]
    if not blocks:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    out = blocks[0]
    for b in blocks[1:]:
        out = out.unionByName(b)
    return out


def _search(whole: DataFrame, block: list, k: int, lists: int) -> DataFrame:
    spark = whole.sparkSession
    sent = spark.sparkContext.broadcast(stacked(block))

    def chunks(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            for n, ids, x in by_length(np.asarray(b.column("vec_id")), b.column("v")):
                if n in sent.value:
                    qid, q = sent.value[n]
                    tile = max(1, TILE // (8 * lists * len(qid)))
                    for i in range(0, len(ids), tile):
                        yield qid, ids[i : i + tile], _lists(q, x[i : i + tile], lists)

    def first(batches):
        """Phase 1: each list's k best entries, as whole-score bounds, and the lists' least values: of each query those of all the task's candidates."""
        least: dict[int, np.ndarray] = {}
        bounds: dict[int, np.ndarray] = {}
        for qid, ids, local in chunks(batches):
            for i, query in enumerate(qid.tolist()):
                own = ids != query
                if not own.any():
                    continue
                of, s = ids[own], np.array([x[i][own] for x in local])
                seen = np.unique(np.concatenate([largest(x, of, k) for x in s]))
                low, whole_ = s.min(axis=1).astype(np.float64), s[:, seen].sum(axis=0).astype(np.float64)
                least[query] = np.minimum(least[query], low) if query in least else low
                bounds[query] = np.sort(np.concatenate([bounds.get(query, whole_[:0]), whole_]))[-k:]
        for query, low in least.items():
            yield pa.RecordBatch.from_pylist([{"query_id": query, "low": low.tolist(), "bound": x} for x in bounds[query].tolist()], schema=one)

    one = pa.schema([("query_id", pa.int64()), ("low", pa.list_(pa.float64())), ("bound", pa.float64())])
    bounds = cut(whole.mapInArrow(first, "query_id long, low array<double>, bound double"))
    best = bounds.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("bound")))).where(f"r <= {k}").groupBy("query_id").agg(F.min("bound").alias("t"), F.count("*").alias("n"))
    lows = bounds.select("query_id", F.posexplode("low")).groupBy("query_id", "pos").agg(F.min("col").alias("low")).groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("pos", "low"))).alias("low"))
    safe = {r["query_id"]: _cutoff(r["t"] if r["n"] == k else -np.inf, [x["low"] for x in r["low"]]) for r in best.join(lows, "query_id").collect()}
    cutoffs = spark.sparkContext.broadcast(safe)

    def second(batches):
        """Phases 2 and 3: entries at or above the cutoff, bounds, and the exact scores of what may still be among the best, of each query the task's k best."""
        kept: dict[int, list[tuple[int, int]]] = {}
        for qid, ids, local in chunks(batches):
            for i, query in enumerate(qid):
                if int(query) not in cutoffs.value:
                    continue
                t, low = cutoffs.value[int(query)]
                own = np.flatnonzero(ids != query)
                s = np.array([x[i][own] for x in local])
                above = s - np.array(low, dtype=s.dtype)[:, None]
                if t == -np.inf:
                    alive = np.arange(len(own))
                else:
                    share = np.floor((t - sum(low)) / len(low))
                    entry = above >= share
                    seen = np.flatnonzero(entry.any(axis=0))
                    known = np.where(entry[:, seen], above[:, seen], 0).sum(axis=0)
                    better = max(t - sum(low), np.partition(known, len(known) - k)[len(known) - k] if len(known) >= k else -np.inf)
                    upper = known + share * (~entry[:, seen]).sum(axis=0)
                    alive = seen[upper >= better]
                score = s[:, alive].sum(axis=0)
                found = [(-_long(score[j]), int(ids[own[alive[j]]])) for j in largest(score, ids[own[alive]], k)]
                kept[int(query)] = sorted(kept.get(int(query), []) + found)[:k]
        for query, best_ in kept.items():
            yield pa.RecordBatch.from_pylist([{"query_id": query, "vec_id": i, "score": -x} for x, i in best_], schema=two)

    two = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found = whole.mapInArrow(second, "query_id long, vec_id long, score long")
    return found.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
