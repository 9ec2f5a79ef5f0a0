"""Fuzzy line deduplication by MinHash over a corpus.

Equal lines are one node.  A node's set holds its shingles of `size` characters; lines whose sets
have a Jaccard similarity of numerator / denominator or more are linked: MinHash bands propose,
the exact sets decide, distributed union-find joins.  Of each component the line that comes first
(smallest id, then text hash, then line number) stays; the others go from their documents.  Lines
without a character other than white space stay where they are.

A document is an id with a text: rows of one id and different texts are different documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, slices, text_buffers, with_side
from .linking import Links, packed, unpacked_mates
from .minhash import bands, minhash
from .textstats import INVERSE, SPACE, char_shingles, mix, powers, prefix, ranges


NAMES = ["id", "h", "nodes", "part", "pairs"]
#: Bytes of text at once: what they need stays in the cache.
SLICE = 1 << 18
#: Parts that bands are dealt to, for each partition of the documents: their number follows the input, so a part's size does not.
PARTS = 8


def _lines(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row, number) of every line of the rows, blank ones too."""
    breaks = np.flatnonzero(data == 10)
    start = np.sort(np.concatenate([at[:-1], breaks + 1]), kind="stable")
    # A break that ends a row starts an empty line at the next row's start: the rows' own starts sort after it.
    row = np.sort(np.concatenate([np.arange(len(at) - 1), np.searchsorted(at, breaks, "right") - 1]), kind="stable")
    n = np.bincount(row, minlength=len(at) - 1)
    first = np.concatenate([[0], np.cumsum(n)])
    number = np.arange(len(row)) - first[row]
    end = np.empty(len(start), np.int64)
    end[:-1] = start[1:] - 1
    last = first[1:] - 1
    end[last] = at[1:]
    return start, end, row, number


def _hashed(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return ranges(prefix(data), start, end)


def _solid(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Which lines have a character other than white space."""
    seen = np.zeros(len(data) + 1, np.int32)
    np.cumsum(~SPACE[data], dtype=np.int32, out=seen[1:])
    return seen[end] > seen[start]


def signed(docs: DataFrame, size: int, length: int, each: int, parts: int) -> DataFrame:
    """Rows of two sorts: (id, h, nodes) of every document, with null for a blank line; (part, pairs) with packed bands of a batch's lines.

    Equal lines of a slice share their work.  A batch gives a part one pair of each band; the pairs
    of bands that several lines of the batch share come without a part.
    """
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            ids, hashes = b.column("id"), b.column("h")
            data, at = text_buffers(b.column("text"))
            seen, nodes = [], []
            for i, j in slices(at, SLICE):
                d, a = data[at[i] : at[j]], at[i : j + 1] - at[i]
                start, end, row, _ = _lines(d, a)
                blank = ~_solid(d, start, end)
                solid = np.flatnonzero(~blank)
                node = _hashed(d, start, end)
                if len(solid):
                    own, first = np.unique(node[solid], return_index=True)
                    units, cut_at = _units(d, start[solid[first]], end[solid[first]])
                    h, ends = _shingles(units, cut_at, size)
                    seen.append(bands(minhash(h, ends, length), each))
                    nodes.append(own.view(np.int64))
                n = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=j - i))]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(n), pa.array(node.view(np.int64), mask=blank))
                yield pa.RecordBatch.from_arrays([ids.slice(i, j - i), hashes.slice(i, j - i), lists, pa.nulls(j - i, pa.int32()), pa.nulls(j - i, pa.binary())], names=NAMES)
            if seen:
                part, pairs = packed(np.concatenate(seen), np.concatenate(nodes), parts)
                n = len(part)
                yield pa.RecordBatch.from_arrays([pa.nulls(n, ids.type), pa.nulls(n, pa.int64()), pa.nulls(n, pa.list_(pa.int64())), pa.array(part, pa.int32()), pa.array(pairs, pa.binary())], names=NAMES)

    return docs.mapInArrow(run, f"id {kind}, h long, nodes array<long>, part int, pairs binary")


def _units(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the lines one after the other, and where each begins."""
    n = end - start
    at = np.concatenate([[0], np.cumsum(n)])
    whole = data[np.repeat(start - at[:-1], n) + np.arange(at[-1])]
    units = np.frombuffer(whole.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    leads = np.concatenate([[0], np.cumsum((whole & 0xC0) != 0x80)])
    return units, leads[at] if leads[-1] == len(units) else np.minimum(at, len(units))


def _shingles(units: np.ndarray, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of each line, with repeats, and where each line's begin."""
    n = np.diff(at)
    count = np.maximum(n - size + 1, 1)
    ends = np.concatenate([[0], np.cumsum(count)])
    start = np.repeat(at[:-1] - ends[:-1], count) + np.arange(ends[-1])
    h = prefix(units)
    if len(units) < size:
        return ranges(h, start, np.minimum(start + size, np.repeat(at[1:], count))), ends
    everywhere = mix((h[size:] - h[:-size]) * powers(len(h), INVERSE)[: len(h) - size])
    out = everywhere[np.minimum(start, len(everywhere) - 1)]
    short = np.flatnonzero(n < size)
    out[ends[short]] = ranges(h, at[short], at[short + 1])
    return out, ends


def line_sets(texts: pa.Array, size: int) -> list[np.ndarray]:
    """The distinct shingles of each text, sorted; an empty text has none."""
    out = []
    data, at = text_buffers(texts)
    for i, j in slices(at, SLICE):
        units, starts = _units(data, at[i:j], at[i + 1 : j + 1])
        h, ends = _shingles(units, starts, size)
        for a, b in zip(ends[:-1].tolist(), ends[1:].tolist()):
            h[a:b].sort()
        new = np.ones(len(h), bool)
        new[1:] = h[1:] != h[:-1]
        new[ends[:-1]] = True
        new[ends[:-1][np.diff(starts) == 0]] = False
        upto = np.concatenate([[0], np.cumsum(new)])[ends].tolist()
        h = h[new]
        out += [h[a:b] for a, b in zip(upto[:-1], upto[1:])]
    return out


def doomed(docs: DataFrame, size: int = 8, numerator: int = 80, denominator: int = 100, length: int = 60, each: int = 5) -> DataFrame:
    """(id, h, gone array<int>): the line numbers to remove from each document that loses some. docs: (id, h, text), h a hash of the text."""
    both = cut(signed(docs, size, length, each, PARTS * max(8, docs.rdd.getNumPartitions())))
    x = both.where("nodes is not null").select("id", "h", F.posexplode("nodes").alias("line", "node")).where("node is not null")
    shared = unpacked_mates(both.where("pairs is not null").select("part", "pairs"))
    reps = x.groupBy("node").agg(F.min(F.struct("id", "h", "line")).alias("rep"), F.count("*").alias("n"))
    mates = shared.select("node", F.lit(True).alias("mate")).distinct()
    some = cut(reps.join(mates, "node", "left").where("mate or n > 1"))
    wanted = some.where("mate").groupBy("rep.id", "rep.h").agg(F.collect_list(F.struct("rep.line", "node")).alias("want"))
    texts = cut(_texts(docs, cut(wanted)))
    roots = Links(lambda t: char_shingles(t, size), numerator, denominator, lambda t: line_sets(t, size)).components(shared, texts)
    rooted = some.join(roots.withColumnRenamed("id", "node"), "node", "left").select("node", "rep", "n", F.coalesce("root", "node").alias("root"))
    first = rooted.groupBy("root").agg(F.min("rep").alias("first"), F.sum("n").alias("all")).where("all > 1")
    stays = cut(rooted.join(first, "root").select("node", "first"))
    gone = with_side(x, stays, "node").where("id <> first.id or h <> first.h or line <> first.line")
    return gone.groupBy("id", "h").agg(F.sort_array(F.collect_set("line")).alias("gone"))


def _texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, text) of the wanted lines, by a line of each; a document's wanted lines are in its row."""

    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            nodes, texts = [], []
            for text, want in zip(b.column("text"), b.column("want")):
                raw = (text.as_py() or "").encode("utf-8", "surrogatepass")
                lines = raw.split(b"\n")
                for w in want.as_py():
                    if w["line"] < len(lines):
                        line = np.frombuffer(lines[w["line"]], np.uint8)
                        if _hashed(line, np.array([0]), np.array([len(line)])).view(np.int64)[0] == w["node"]:
                            nodes.append(w["node"])
                            texts.append(lines[w["line"]].decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(texts, pa.string())], names=["node", "text"])

    return with_side(docs, wanted, ["id", "h"], items="want").select("text", "want").mapInArrow(run, "node long, text string").dropDuplicates(["node"])


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """docs with `text_col` rid of the lines to remove, and columns n_lines and n_removed.

    A null text stays null and has no lines, an empty one has one blank line.  Lines end at line
    feeds only.  Rows without an id keep their lines and take part in nothing.  Rows that repeat an
    id and its text are one document and keep the same lines; those of an id with another text are
    another document.  An empty table gives no rows; columns named n_lines or n_removed are replaced.
    """
    text = F.col(text_col).cast("string")
    used = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("h"), text.alias("text"))
    gone = cut(doomed(used.where("id is not null and text is not null"), **how))
    lines = F.split(text, "\n", -1)
    side = gone.select(F.col("id").alias(id_col), F.col("h").alias("__h"), F.col("gone").alias("__gone"))
    kept = F.array_join(F.filter(lines, lambda x, i: ~F.array_contains("__gone", i)), "\n")
    out = with_side(docs.drop("n_lines", "n_removed").withColumn("__h", F.xxhash64(text)), side, [id_col, "__h"], "left", items="__gone")
    out = out.withColumn("n_lines", F.when(text.isNull(), 0).otherwise(F.size(lines)).cast("long")).withColumn("n_removed", F.coalesce(F.size("__gone"), F.lit(0)).cast("long"))
    return out.withColumn(text_col, F.when(F.col("__gone").isNull(), F.col(text_col)).otherwise(kept)).drop("__gone", "__h").select(*[c for c in docs.columns if c not in ("n_lines", "n_removed")], "n_lines", "n_removed")


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """(doc_id, n_lines, n_removed, kept_sha256) of each row; the hash of a null text is that of an empty one."""
    out = deduplicate(docs.select(id_col, text_col), id_col, text_col, **how)
    return out.select(id_col, "n_lines", "n_removed", F.sha2(F.coalesce(text_col, F.lit("")), 256).alias("kept_sha256"))
