"""Quality scores: random Fourier features, ridge by partition-summed normal equations, isotonic calibration.

Document statistics (never labels, language, source or id) are standardised and mapped to random
Fourier features, whose inner products approximate a Gaussian kernel.  Each partition of the
labelled rows sums its share of the normal equations; Spark adds the shares row by row of the
matrix, so that the driver gets one matrix of fixed size.  Ridge scores are then calibrated by
isotonic regression on rows that the fit has not seen, over a fixed number of score bins.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, slices, text_buffers, with_side
from .textstats import LOWER, SPACE, prefix, ranges, words

#: Statistics of a document, in this order.
STATISTICS = ["bytes", "words", "lines", "word_length", "word_length_sd", "line_length", "upper", "digit", "space", "symbol", "stop", "comma", "bang", "pipe", "markup", "high", "distinct_words", "distinct_lines", "top_word", "title", "ends_symbol", "short_words", "entropy"]
#: Score bins of the calibration.
BINS = 400


def statistics(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A row of STATISTICS for each text."""
    n = len(at) - 1
    out = np.zeros((n, len(STATISTICS)))
    if not len(data):
        return out
    start, end = words(data, at)
    hashed = ranges(prefix(LOWER[data]), start, end)
    length = (end - start).astype(float)
    upper = (data >= 65) & (data <= 90)
    first_upper, last = upper[start], data[end - 1]
    odd_end = (last < 127) & (last > 32) & ~((last >= 48) & (last <= 57)) & ~((last >= 65) & (last <= 90)) & ~((last >= 97) & (last <= 122)) & (last != 46) & (last != 44)
    first = np.searchsorted(start, at)
    for i in range(n):
        a, b = at[i], at[i + 1]
        if a == b:
            continue
        f, g = first[i], first[i + 1]
        count = np.bincount(data[a:b], minlength=256)
        size, m = b - a, g - f
        share = count / size
        lines = bytes(data[a:b]).split(b"\n")
        row = [np.log1p(size), np.log1p(m), np.log1p(len(lines)), 0, 0, np.log1p(size / len(lines)), share[65:91].sum(), share[48:58].sum(), share[SPACE].sum(), share[[35, 36, 37, 38, 42]].sum(), share[46], share[44], share[[33, 63]].sum(), share[124], share[[60, 62, 123, 125, 91, 93, 61, 59, 95, 92]].sum(), share[128:].sum(), 1, len(set(lines)) / len(lines), 0, 0, 0, 0, 0]
        if m:
            l = length[f:g]
            _, times = np.unique(hashed[f:g], return_counts=True)
            row[3:5] = l.mean(), l.std()
            row[16], row[18] = len(times) / m, times.max() / m
            row[19:22] = first_upper[f:g].mean(), odd_end[f:g].mean(), (l <= 2).mean()
        p = share[share > 0]
        row[22] = -(p * np.log(p)).sum()
        out[i] = row
    return np.nan_to_num(out)


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    scale: np.ndarray
    frequencies: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    knots: tuple[np.ndarray, np.ndarray]

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        waves = np.cos(z @ self.frequencies + self.phases) * np.sqrt(2 / len(self.phases))
        return np.hstack([waves, z / 10, np.ones((len(z), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(x), *self.knots), 0.0, 1.0)


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots (x, value) of the weighted monotone fit by pooling adjacent violators; x ascending.  A slope of 1e-9 keeps the order within a block."""
    blocks: list[list[float]] = []
    for a, b, c in zip(x, y, w):
        blocks.append([a * c, b * c, c])
        while len(blocks) > 1 and blocks[-2][1] / blocks[-2][2] >= blocks[-1][1] / blocks[-1][2]:
            last = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], last)]
    at, value = np.array([[s / c, v / c] for s, v, c in blocks]).T
    at = np.concatenate([[min(at[0], x[0]) - 1], at, [max(at[-1], x[-1]) + 1]])
    value = np.concatenate([[value[0] - 1e-3], value, [value[-1] + 1e-3]])
    value = 1e-3 + (1 - 2e-3) * np.clip(value, -1e-3, 1 + 1e-3)
    return at, np.maximum.accumulate(value + 1e-9 * np.arange(len(value)))


def summed(rows: DataFrame, partial, size: int) -> np.ndarray:
    """The sum over partitions of what `partial` makes of their batches: a matrix with `size` rows, added by Spark row by row."""

    def shares(batches: Iterator[pa.RecordBatch]):
        total = 0
        for b in batches:
            if b.num_rows:
                total = total + partial(b)
        if isinstance(total, np.ndarray):
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(list(total), pa.list_(pa.float64()))], names=["i", "v"])

    parts = rows.mapInArrow(shares, "i int, v array<double>").select("i", F.posexplode("v"))
    flat = parts.groupBy("i", "pos").agg(F.sum("col").alias("s")).groupBy("i").agg(F.sort_array(F.collect_list(F.struct("pos", "s"))).alias("r")).select("i", F.transform("r", lambda x: x["s"]).alias("r"))
    got = {r["i"]: r["r"] for r in flat.collect()}
    return np.array([got[i] for i in range(size)]) if got else np.zeros((0, 0))


def matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(len(column), -1)


def fit(labelled: DataFrame, features: int = 160, width: float = 3.0, ridge: float = 1e-3, seed: int = 11) -> Model:
    """From (x array<double>, y double, fold int): folds 0-2 fit, fold 3 calibrates.  Without rows of both labels every score is the labels' mean, 0.5 without labels."""
    k = len(STATISTICS)
    moments = summed(labelled, lambda b: np.vstack([(x := matrix(b.column("x"))).sum(axis=0), (x * x).sum(axis=0), np.full(k, len(x)), np.full(k, np.asarray(b.column("y")).sum())]), 4)
    random = np.random.default_rng(seed)
    frequencies, phases = random.standard_normal((k, features)) / width, random.uniform(0, 2 * np.pi, features)
    width_all = features + k + 1
    if not len(moments) or moments[3, 0] in (0, moments[2, 0]):
        flat = moments[3, 0] / moments[2, 0] if len(moments) else 0.5
        return Model(np.zeros(k), np.ones(k), frequencies, phases, np.zeros(width_all), (np.array([-1.0, 1.0]), np.array([flat, flat])))
    n = moments[2]
    mean = moments[0] / n
    model = Model(mean, np.sqrt(np.maximum(moments[1] / n - mean**2, 0)) + 1e-9, frequencies, phases, np.zeros(width_all), (np.zeros(1), np.zeros(1)))
    rate = moments[3, 0] / n[0]

    def normal(b: pa.RecordBatch) -> np.ndarray:
        y, fits = np.asarray(b.column("y")), np.asarray(b.column("fold")) < 3
        z = model.features(matrix(b.column("x")))[fits]
        w = np.where(y[fits] > 0, 0.5 / rate, 0.5 / (1 - rate))
        return np.hstack([z.T @ (z * w[:, None]), (z.T @ (w * (2 * y[fits] - 1)))[:, None]])

    a = summed(labelled, normal, width_all)
    weights = np.linalg.solve(a[:, :-1] + ridge * n[0] / width_all * np.eye(width_all), a[:, -1])
    model = Model(model.mean, model.scale, frequencies, phases, weights, model.knots)

    def binned(b: pa.RecordBatch) -> np.ndarray:
        held = np.asarray(b.column("fold")) == 3
        y, s = np.asarray(b.column("y"))[held], model.raw(matrix(b.column("x")))[held]
        at = np.clip(((s + 2) / 4 * BINS).astype(int), 0, BINS - 1)
        return np.stack([np.bincount(at, minlength=BINS), np.bincount(at, s, BINS), np.bincount(at, y, BINS)], axis=1)

    bins = summed(labelled, binned, BINS)
    bins = bins[bins[:, 0] > 0]
    knots = isotonic(bins[:, 1] / bins[:, 0], bins[:, 2] / bins[:, 0], bins[:, 0]) if len(bins) else (np.array([-1.0, 1.0]), np.array([0.0, 1.0]))
    return Model(model.mean, model.scale, frequencies, phases, weights, knots)


def measured(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, x array<double>) of each row's whole text; null counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            data, at = text_buffers(b.column(1))
            rows = [statistics(data[at[i] : at[j]], at[i : j + 1] - at[i]) for i, j in slices(at)]
            x = np.concatenate(rows) if rows else np.zeros((0, len(STATISTICS)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(x), pa.list_(pa.float64()))], names=["id", "x"])

    chosen = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return chosen.mapInArrow(run, f"id {chosen.schema['id'].dataType.simpleString()}, x array<double>")


def remainder(doc_id: Column, salt: str = "") -> Column:
    return F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(salt)).cast("binary"))


def train(x: DataFrame, labels: DataFrame, label_col: str = "quality") -> Model:
    """Fit on the rows of labels that learning may use: crc32(id) mod 3 is not 1.  A null label or id is passed over; of repeated labels of one id the largest counts."""
    usable = labels.select(F.col("doc_id").alias("id"), F.col(label_col).cast("double").alias("y")).where((remainder(F.col("id")) % 3 != 1) & F.col("y").isNotNull() & F.col("id").isNotNull())
    rows = with_side(x, usable.groupBy("id").agg(F.max("y").alias("y")), "id")
    return fit(cut(rows.select("x", "y", (remainder(F.col("id"), "fold") % 4).cast("int").alias("fold"))))


def scored(x: DataFrame, model: Model) -> DataFrame:
    """(id, score) of each row of (id, x)."""
    sent = x.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            s = sent.value.score(matrix(b.column("x"))) if b.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(s, pa.float64())], names=["id", "score"])

    return x.mapInArrow(run, f"id {x.schema['id'].dataType.simpleString()}, score double")


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row of docs.

    Null texts count as empty, and empty texts are scored too; a null id is not held out; repeated
    rows get the same score each; an empty table gives no rows.
    """
    x = cut(measured(docs, id_col, text_col))
    out = scored(x, train(x, labels))
    held = (remainder(F.col("id")) % 3 == 1) & F.col("id").isNotNull()
    return out.select(F.col("id").alias(id_col), held.alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
