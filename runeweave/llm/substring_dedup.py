"""Removal of long byte strings that occur more than once, by interval expansion on a Burrows-Wheeler transform.

A window is a start of `length` bytes.  Every window has an anchor: the gram in it with the least
hash (the leftmost of equals).  Equal windows have equal anchors at equal offsets, so a window can
only repeat among the contexts of one anchor.  A context is the stretch of consecutive windows
that share an anchor occurrence.

1. A scan emits each document's contexts: place, anchor hash, content hash.
2. Equal contexts are counted as one; anchors that occur once are dropped.
3. The distinct contexts of an anchor are brought together, many anchors to a task, and the windows
   that repeat among them are found on the Burrows-Wheeler transform of the batch: starting from
   the empty string, intervals are extended backwards breadth first, one character a level, which
   yields the boundaries between neighbouring suffixes by increasing length of their common
   prefix.  The expansion stops at `length`: boundaries not yet found join suffixes that share at
   least so many bytes.
4. Contexts that occur more than once, and windows found in 3, give the bytes to remove.

Contexts of an anchor with more than `hot` distinct ones do not go to one transform.  They are scanned
again as if they were documents, with other hashes: windows that share a frequent gram have other
grams too, so most get anchors that few share.  What is hot after LEVELS such scans, windows that
are alike in nearly all grams, is counted by the hash of the whole window, spread over all tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, slices, text_buffers, with_side
from .textstats import BASE, mix, prefix, ranges

#: Bytes of an anchor's gram: a longer one brings fewer contexts together that share no window.
GRAM = 96
#: Bytes of contexts in one transform.
BATCH = 2 << 20
#: Distinct contexts of an anchor that go to one transform: about as many bytes.
HOT = 2048
#: Scans with hashes of their own.
LEVELS = 4


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` neighbours."""
    n = len(x) - width + 1
    blocks = -(-len(x) // width)
    padded = np.full(blocks * width, np.iinfo(x.dtype).max, x.dtype)
    padded[: len(x)] = x
    padded = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    back = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def contexts(data: np.ndarray, at: np.ndarray, length: int, level: int = 0) -> tuple[np.ndarray, ...]:
    """(row, place, windows, anchor hash, content hash) of the contexts of the rows in data; each level has anchors of its own."""
    gram = min(GRAM, length)
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none, none, none, none
    h = prefix(data)
    start = np.arange(len(data) - gram + 1)
    grams = ranges(h, start, start + gram)
    if level:
        grams = mix(grams ^ (BASE * np.uint64(level)))
    least = sliding_least((grams & np.uint64(0xFFFFFFFF00000000)) | start.astype(np.uint64), length - gram + 1)
    anchor = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    row = np.searchsorted(at, np.arange(len(anchor)), "right") - 1
    inside = np.arange(len(anchor)) + length <= at[row + 1]
    new = np.empty(len(anchor), bool)
    new[:1] = True
    new[1:] = (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1]) | (inside[1:] != inside[:-1])
    first = np.flatnonzero(new)
    n = np.diff(np.append(first, len(anchor)))
    first, n = first[inside[first]], n[inside[first]]
    content = ranges(h, first, first + n - 1 + length)
    return row[first], first - at[row[first]], n, grams[anchor[first]].view(np.int64), content.view(np.int64)


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Starts of the suffixes in order of their first `depth` characters at least, by prefix doubling."""
    n = len(text)
    padded = np.zeros(n + 4, np.uint64)
    padded[:n] = text
    key = padded[:n] * np.uint64(1 << 27) + padded[1 : n + 1] * np.uint64(1 << 18) + padded[2 : n + 2] * np.uint64(1 << 9) + padded[3 : n + 3]
    known = 4
    while True:
        order = np.argsort(key)
        sorted_key = key[order]
        rank_of = np.empty(n, np.uint64)
        rank_of[order] = np.cumsum(np.concatenate([[True], sorted_key[1:] != sorted_key[:-1]])).astype(np.uint64)
        if known >= depth or rank_of[order[-1]] == n:
            return order
        after = np.zeros(n, np.uint64)
        after[: n - known] = rank_of[known:]
        key = rank_of * np.uint64(n + 1) + after
        known *= 2


def boundaries(text: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, found): found[r] says that the suffixes at ranks r - 1 and r share fewer than `length` characters. text: values 0..256."""
    n = len(text)
    order = suffix_order(text, length)
    bwt = text[order - 1]
    by_char = np.argsort(bwt, kind="stable")
    back = np.empty(n, np.int64)  # from a rank to that of the suffix one longer
    back[by_char] = np.arange(n)
    same = bwt[by_char[1:]] == bwt[by_char[:-1]]
    later, earlier = np.full(n, n, np.int64), np.full(n, -1, np.int64)  # ranks of the next and the last equal character
    later[by_char[:-1][same]] = by_char[1:][same]
    earlier[by_char[1:][same]] = by_char[:-1][same]
    found = np.zeros(n + 1, bool)
    found[[0, n]] = True
    low, high = np.array([0]), np.array([n])
    for _ in range(length):
        if not len(low):
            break
        size = high - low
        ends = np.cumsum(size)
        rank = np.repeat(low - ends + size, size) + np.arange(ends[-1])
        firsts = np.sort(back[rank[earlier[rank] < np.repeat(low, size)]])
        lasts = np.sort(back[rank[later[rank] >= np.repeat(high, size)]]) + 1
        fresh = ~found[lasts]
        low, high = firsts[fresh], lasts[fresh]
        found[high] = True
    return order, found


def repeated(segments: list[bytes], length: int) -> list[np.ndarray]:
    """For each segment, which of its windows start in another place of the segments too."""
    n = np.array([len(s) for s in segments])
    at = np.concatenate([[0], np.cumsum(n + 1)])
    text = np.zeros(at[-1], np.uint16)
    raw = np.frombuffer(b"\0".join(segments) + b"\0", np.uint8)
    text[:] = raw
    text += 1
    text[at[1:] - 1] = 0
    order, found = boundaries(text, length)
    twice = np.empty(len(text), bool)
    twice[order] = ~found[:-1] | ~found[1:]
    return [twice[a : a + m - length + 1] for a, m in zip(at, n)]


def runs(flags: np.ndarray) -> list[int]:
    """Starts and ends of the runs of true flags, one after the other."""
    return np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))).tolist()


def _scan(docs: DataFrame, length: int, level: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            data, at = text_buffers(b.column("text"))
            for i, j in slices(at):
                row, place, n, anchor, content = contexts(data[at[i] : at[j]], at[i : j + 1] - at[i], length, level)
                yield pa.RecordBatch.from_arrays([b.column("key").slice(i, j - i).take(pa.array(row)), pa.array(place), pa.array(n), pa.array(anchor), pa.array(content)], names=["key", "place", "n", "anchor", "content"])

    return docs.mapInArrow(run, f"key {docs.schema['key'].dataType.simpleString()}, place long, n long, anchor long, content long")


def _fetch(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """(anchor, content, n, twice, segment): the bytes of the wanted contexts. wanted: (key, want array<struct>)."""

    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            for text, want in zip(b.column("text"), b.column("want")):
                raw, out = text.as_py(), want.as_py()
                raw = raw if isinstance(raw, bytes) else raw.encode("utf-8", "surrogatepass")
                for w in out:
                    w["segment"] = raw[w["place"] : w["place"] + w["n"] - 1 + length]
                    del w["place"]
                yield pa.RecordBatch.from_pylist(out, schema=shape)

    shape = pa.schema([("anchor", pa.int64()), ("content", pa.int64()), ("n", pa.int64()), ("twice", pa.bool_()), ("hot", pa.bool_()), ("segment", pa.binary())])
    return with_side(docs, wanted, "key", items="want").select("text", "want").mapInArrow(run, "anchor long, content long, n long, twice boolean, hot boolean, segment binary")


def _expanded(found: DataFrame, length: int) -> DataFrame:
    """(anchor, content, runs) of contexts with windows that repeat among the contexts of their anchor."""

    def solve(rows: list) -> pa.RecordBatch:
        flags = repeated([r[2] for r in rows], length)
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([runs(f) for f in flags], pa.list_(pa.int32()))], names=["anchor", "content", "runs"])

    def run(batches: Iterator[pa.RecordBatch]):
        rows, size, last = [], 0, None
        for b in batches:
            for anchor, content, segment in zip(*(b.column(c).to_pylist() for c in ("anchor", "content", "segment"))):
                if size > BATCH and anchor != last:
                    yield solve(rows)
                    rows, size = [], 0
                rows.append((anchor, content, segment))
                size, last = size + len(segment), anchor
        if rows:
            yield solve(rows)

    together = found.repartition("anchor").sortWithinPartitions("anchor").select("anchor", "content", "segment")
    return together.mapInArrow(run, "anchor long, content long, runs array<int>")


def _counted(found: DataFrame, length: int) -> DataFrame:
    """The same for what is hot at every level: windows counted by hash."""

    def explode(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            for anchor, content, segment in zip(*(b.column(c).to_pylist() for c in ("anchor", "content", "segment"))):
                data = np.frombuffer(segment, np.uint8)
                start = np.arange(len(data) - length + 1)
                h = ranges(prefix(data), start, start + length).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), anchor)), pa.array(np.full(len(h), content)), pa.array(start.astype(np.int32)), pa.array(h)], names=["anchor", "content", "i", "window"])

    windows = found.select("anchor", "content", "segment").mapInArrow(explode, "anchor long, content long, i int, window long")
    often = windows.groupBy("window").count().where("count > 1").select("window")
    return windows.join(often, "window").groupBy("anchor", "content").agg(F.flatten(F.sort_array(F.collect_list(F.array(F.col("i"), F.col("i") + 1)))).alias("runs"))


def _hits(docs: DataFrame, length: int, hot: int, level: int = 0) -> DataFrame:
    """(key, place, runs): the contexts of docs (key, text) with windows that start elsewhere too, and the runs of these windows. key may not be null."""
    x = cut(_scan(docs, length, level))
    distinct = x.groupBy("anchor", "content").agg(F.count("*").alias("times"), F.min(F.struct("key", "place", "n")).alias("rep"))
    anchors = x.groupBy("anchor").agg(F.count("*").alias("all"))
    often = cut(distinct.join(anchors.where("all > 1").select("anchor"), "anchor"))
    several = often.groupBy("anchor").agg(F.count("*").alias("contexts")).where("contexts > 1")
    wanted = often.join(several, "anchor").select("rep.key", F.struct("anchor", "content", "rep.n", (F.col("times") > 1).alias("twice"), (F.col("contexts") > hot).alias("hot"), "rep.place").alias("w"))
    found = cut(_fetch(docs, cut(wanted.groupBy("key").agg(F.collect_list("w").alias("want"))), length))
    some = _expanded(found.where("not hot"), length)
    if found.where("hot").head(1):
        some = some.unionByName(_again(found.where("hot"), length, hot, level + 1) if level + 1 < LEVELS else _counted(found.where("hot"), length))
    full = often.where("times > 1").select("anchor", "content", F.lit(None).cast("array<int>").alias("runs"))
    part = some.where(F.size("runs") > 0).join(full.select("anchor", "content"), ["anchor", "content"], "left_anti")
    marks = cut(full.unionByName(part))
    return x.join(marks, ["anchor", "content"]).select("key", "place", F.coalesce("runs", F.array(F.lit(0), F.col("n").cast("int"))).alias("runs"))


def _again(found: DataFrame, length: int, hot: int, level: int) -> DataFrame:
    """(anchor, content, runs) of hot contexts: each is a document of the next level."""
    inner = _hits(found.select(F.struct("anchor", "content").alias("key"), F.col("segment").alias("text")), length, hot, level)
    shifted = F.transform("runs", lambda r: r + F.col("place").cast("int"))
    runs_ = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("place", shifted.alias("r")))), lambda s: s["r"]))
    return inner.groupBy("key").agg(runs_.alias("runs")).select("key.anchor", "key.content", "runs")


def spans(docs: DataFrame, length: int = 400, hot: int = HOT) -> DataFrame:
    """(key, spans array<struct<start, end>>): bytes to remove, merged, for the rows of docs (key, text) that have some. key may not be null."""
    pieces = F.transform(F.sequence(F.lit(0), F.shiftright(F.size("runs"), 1) - 1), lambda i: F.struct((F.col("place") + F.get("runs", i * 2)).alias("start"), (F.col("place") + F.get("runs", i * 2 + 1) - 1 + length).alias("end")))
    return _hits(docs, length, hot).select("key", pieces.alias("s")).groupBy("key").agg(F.array_sort(F.flatten(F.collect_list("s"))).alias("spans")).select("key", _merged("spans").alias("spans"))


def _merged(spans: str) -> Column:
    """Sorted spans without overlaps or touching ends."""
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")

    def add(state: Column, s: Column) -> Column:
        last = state["last"]
        grown = F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))
        joins = last["end"] >= s["start"]
        return F.struct(F.when(joins | last.isNull(), state["out"]).otherwise(F.array_append(state["out"], last)).alias("out"), F.when(joins, grown).otherwise(s).alias("last"))

    start = F.struct(none.alias("out"), F.lit(None).cast("struct<start:bigint,end:bigint>").alias("last"))
    return F.aggregate(spans, start, add, lambda state: F.array_append(state["out"], state["last"]))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.struct(F.coalesce(F.col(id_col).cast("string"), F.lit("null")).alias("id"), F.xxhash64(text).alias("h")).alias("key"), F.col(id_col).alias("id"), text.alias("text"))


def cleaned(docs: DataFrame, length: int = 400, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept binary) of each row of docs.

    Each byte covered by a string of `length` bytes that also starts anywhere else, in the same row
    or another, is removed; strings are those of the input, and never cross rows.  Null texts count
    as empty; texts shorter than `length` keep all; repeated rows count as copies of each other;
    ids may be null.  An empty table gives no rows.
    """
    keyed = _keyed(docs, id_col, text_col)
    marked = with_side(keyed, cut(spans(keyed.select("key", "text"), length, hot)), "key", "left", items="spans").select("id", "text", "spans")

    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            n, removed, many, kept = [], [], [], []
            for text, found in zip(b.column("text"), b.column("spans")):
                raw = text.as_py().encode("utf-8", "surrogatepass")
                merged = [(s["start"], s["end"]) for s in found.as_py() or ()]
                ends = [0, *(x for s in merged for x in s), len(raw)]
                n.append(len(raw))
                removed.append(sum(e - s for s, e in merged))
                many.append(len(merged))
                kept.append(b"".join(raw[s:e] for s, e in zip(ends[::2], ends[1::2])))
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(many, pa.int64()), pa.array(kept, pa.binary())], names=[id_col, "n_bytes", "n_removed", "n_spans", "kept"])

    return marked.mapInArrow(run, f"{id_col} {keyed.schema['id'].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept binary")


def digest(docs: DataFrame, **how) -> DataFrame:
    """`cleaned` with the hash of the kept bytes instead of the bytes."""
    out = cleaned(docs, **how)
    return out.withColumn("kept_sha256", F.sha2("kept", 256)).drop("kept")
