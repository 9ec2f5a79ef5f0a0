"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie of pieces with log scores.

The best segmentation maximises the sum of its pieces' scores; of equal sums the one whose last
piece is longest, then the one before it, and so on.  A character that no piece covers costs the
least score less 10 and becomes its bytes' pieces (or the unknown piece, in a model without them).
White space is a marker that begins pieces: spaces in the text are written as the marker, one is
put before the text, and decoding turns markers back and takes that one off.  Bytes that are not
valid UTF-8 when decoded become U+FFFD.  The marker character itself (U+2581) in a text is read as
a space, as the format does.

No piece continues past a marker that follows another character, so a text falls into chunks that
are encoded independently; a slice of texts encodes each distinct chunk once, all of them side by
side in numpy.
"""

from __future__ import annotations

import struct
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices, text_buffers
from .textstats import prefix, ranges

MARKER = "▁"
#: Kinds of pieces in the model format.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def fields(data: bytes):
    """(number, value) of a protocol buffer's fields: integers, 4 or 8 raw bytes, or bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            byte = data[at]
            at += 1
            out |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return out

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(kind) or varint()
            yield key >> 3, data[at : at + size]
            at += size


#: Bytes of texts that are segmented at once.
STRETCH = 1 << 20
#: Slots looked through at once for a node of several children.
WINDOW = 256


class DoubleArray:
    """A trie of byte strings in two arrays: node s has child s' = base[s] + byte + 1 if check[s'] is s."""

    def __init__(self, keys: list[bytes]):
        order = sorted(range(len(keys)), key=lambda i: keys[i])
        base, check, value = np.zeros(1 << 16, np.int32), np.full(1 << 16, -1, np.int32), np.full(1 << 16, -1, np.int32)
        check[0] = 0
        queue, free, wide = deque([(0, 0, len(order), 0)]), 1, 1
        while queue:
            node, low, high, depth = queue.popleft()
            while low < high and len(keys[order[low]]) == depth:
                value[node] = order[low]
                low += 1
            if low == high:
                continue
            edges: list[tuple[int, int]] = []
            for i in range(low, high):
                if not edges or keys[order[i]][depth] != edges[-1][0]:
                    edges.append((keys[order[i]][depth], i))
            codes = np.array([c for c, _ in edges])
            while len(check) - 3 * WINDOW - 512 < max(free, wide):
                base, check, value = (np.concatenate([x, np.full(len(x), fill, np.int32)]) for x, fill in ((base, 0), (check, -1), (value, -1)))
            if len(edges) == 1:
                free = max(free, codes[0] + 2)
                while check[free] >= 0:
                    free += 1
                at = free - codes[0] - 1
            else:
                while True:
                    tried = np.flatnonzero(check[wide : wide + WINDOW] < 0) + wide - codes[0] - 1
                    fits = tried[(tried > 0) & (check[np.maximum(tried, 0)[:, None] + codes + 1] < 0).all(axis=1)]
                    if len(fits):
                        at = int(fits[0])
                        break
                    wide += WINDOW
            base[node] = at
            check[at + codes + 1] = node
            for (c, i), (_, j) in zip(edges, [*edges[1:], (0, high)]):
                queue.append((at + c + 1, i, j, depth + 1))
        used = np.flatnonzero(check >= 0)[-1] + 258
        self.base, self.check, self.value = base[:used], check[:used], value[:used]


@dataclass
class Model:
    """Pieces (a space for the marker) with scores, and how texts are prepared."""

    pieces: list[bytes]
    scores: np.ndarray
    kinds: np.ndarray
    prefix_space: bool

    def __post_init__(self):
        usable = [i for i in range(len(self.pieces)) if self.kinds[i] in (NORMAL, USER) and self.pieces[i]]
        self.trie = DoubleArray([self.pieces[i] for i in usable])
        self.trie.value = np.where(self.trie.value >= 0, np.array([*usable, -1], np.int32)[self.trie.value], -1)
        self.longest = max((len(self.pieces[i]) for i in usable), default=0)
        self.unknown_score = float(self.scores[usable].min()) - 10 if usable else -10.0
        self.unknown = int(np.flatnonzero(self.kinds == UNKNOWN)[0]) if (self.kinds == UNKNOWN).any() else 0
        self.byte_ids = np.full(256, -1, np.int32)
        for i in np.flatnonzero(self.kinds == BYTE):
            self.byte_ids[int(self.pieces[i][3:5], 16)] = i
        self.by_space = not any(b" " in self.pieces[i].lstrip(b" ") for i in usable)
        self.by_line = not any(b"\n" in self.pieces[i] for i in usable)
        written = [bytes([int(p[3:5], 16)]) if k == BYTE else b"" if k == CONTROL else " ⁇ ".encode() if k == UNKNOWN else p for p, k in zip(self.pieces, self.kinds)]
        self.lengths = np.array([len(w) for w in written])
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)])
        self.written = np.frombuffer(b"".join(written), np.uint8)

    @staticmethod
    def parse(data: bytes) -> Model:
        pieces, scores, kinds, prefix_space = [], [], [], True
        for number, value in fields(data):
            if number == 1:
                x = dict(fields(value))
                pieces.append(x.get(1, b"").decode().replace(MARKER, " ").encode())
                scores.append(struct.unpack("<f", x.get(2, b"\0\0\0\0"))[0])
                kinds.append(x.get(3, NORMAL))
            elif number == 3:
                x = dict(fields(value))
                if x.get(2):
                    raise ValueError("models with a normalisation table are not supported; normalise the text first")
                if x.get(4, 1):
                    raise ValueError("models that remove extra white space are not supported; trim the text first")
                prefix_space = bool(x.get(3, 1))
        return Model(pieces, np.array(scores, np.float64), np.array(kinds), prefix_space)

    @staticmethod
    def load(spark: SparkSession, path: str) -> Model:
        """From a path on the driver, or on any store by its scheme."""
        if "://" in path:
            return Model.parse(bytes(spark.read.format("binaryFile").load(path).first()["content"]))
        with open(path, "rb") as f:
            return Model.parse(f.read())

    def viterbi(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, at): the pieces of each chunk [start, end) one after the other, and where each chunk's begin. Starts are ascending, chunks apart."""
        order = np.argsort(start - end, kind="stable")
        first, n = start[order], (end - start)[order]
        at = np.concatenate([[0], np.cumsum(n + 1)])[:-1]  # a chunk's places, one more than its bytes
        best = np.full(int((n + 1).sum()), -np.inf)
        back, piece = np.zeros(len(best), np.int64), np.full(len(best), -1, np.int32)
        best[at] = 0
        base, check, value = self.trie.base, self.trie.check, self.trie.value
        for k in range(int(n[0]) if len(n) else 0):
            p = at[: np.searchsorted(-n, -k, "left")] + k
            live = np.flatnonzero(best[p] > -np.inf)
            p, byte, left = p[live], first[live] + k, n[live] - k
            node = np.zeros(len(p), np.int64)
            lead, here, room = data[byte], p, left
            at_byte = byte
            for d in range(1, self.longest + 1):
                if not len(here):
                    break
                to = base[node] + data[at_byte].astype(np.int64) + 1
                ok = np.flatnonzero(check[to] == node)
                node, here, at_byte, room = to[ok], here[ok], at_byte[ok], room[ok]
                v = value[node]
                hit = np.flatnonzero(v >= 0)
                if len(hit):
                    cost, goal = best[here[hit]] + self.scores[v[hit]], here[hit] + d
                    up = cost > best[goal]
                    goal = goal[up]
                    best[goal], back[goal], piece[goal] = cost[up], here[hit][up], v[hit][up]
                more = np.flatnonzero(room > d)
                node, here, at_byte, room = node[more], here[more], at_byte[more] + 1, room[more]
            size = np.minimum(1 + (lead >= 0xC0) + (lead >= 0xE0).astype(np.int64) + (lead >= 0xF0), left)
            goal, cost = p + size, best[p] + self.unknown_score
            up = cost > best[goal]
            goal = goal[up]
            best[goal], back[goal], piece[goal] = cost[up], p[up], -1
        ids, owner = [], []
        here, chunk = at + n, np.arange(len(n))
        while True:
            going = here > at[chunk]
            here, chunk = here[going], chunk[going]
            if not len(here):
                break
            for_bytes = piece[here] < 0
            if for_bytes.any() and self.byte_ids.min() >= 0:
                f, c = here[for_bytes], chunk[for_bytes]
                size = f - back[f]
                for i in range(4):  # last byte first
                    has = size > i
                    ids.append(np.where(has, self.byte_ids[data[np.where(has, first[c] + f - at[c] - 1 - i, 0)]], -1))
                    owner.append(c)
                ids.append(np.where(for_bytes, -1, piece[here]))
            else:
                ids.append(np.where(for_bytes, self.unknown, piece[here]))
            owner.append(chunk)
            here = back[here]
        if not ids:
            return np.zeros(0, np.int32), np.zeros(len(start) + 1, np.int64)
        flat, owner = np.concatenate(ids)[::-1], np.concatenate(owner)[::-1]
        owner, flat = order[owner[flat >= 0]], flat[flat >= 0]
        place = np.argsort(owner, kind="stable")
        return flat[place].astype(np.int32), np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(start)))])

    def encode(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, at) of rows that stand one after the other in data, prepared. Data is taken in stretches of whole chunks, so a long row needs no more memory than many short ones."""
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(len(at), np.int64)
        new = np.zeros(len(data), bool)
        new[at[:-1][at[:-1] < len(data)]] = True
        if self.by_space:
            new[1:] |= (data[1:] == 32) & (data[:-1] != 32)
        if self.by_line:
            new |= data == 10
            new[1:] |= data[:-1] == 10
        start = np.flatnonzero(new).astype(np.int32 if len(data) < 1 << 31 else np.int64)
        cuts = [0]
        while cuts[-1] < len(start):
            cuts.append(max(cuts[-1] + 1, int(np.searchsorted(start, start[cuts[-1]] + STRETCH))))
        whole, counts = [], []
        for i, j in zip(cuts[:-1], cuts[1:]):
            a, b = int(start[i]), int(start[j]) if j < len(start) else len(data)
            ids, n = self._stretch(data[a:b], start[i:j].astype(np.int64) - a)
            whole.append(ids)
            counts.append(n)
        to = np.concatenate([[0], np.cumsum(np.concatenate(counts))])
        return np.concatenate(whole), to[np.searchsorted(start, at)]

    def _stretch(self, data: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pieces of the chunks that make up data, and how many each has; equal chunks are encoded once."""
        end = np.append(start[1:], len(data))
        _, one, back = np.unique(ranges(prefix(data), start, end), return_index=True, return_inverse=True)
        by_place = np.argsort(one)
        ids, ends = self.viterbi(data, start[one[by_place]], end[one[by_place]])
        rank = np.empty(len(one), np.int64)
        rank[by_place] = np.arange(len(one))
        chunk = rank[back]
        n = ends[chunk + 1] - ends[chunk]
        to = np.concatenate([[0], np.cumsum(n)])
        return ids[np.repeat(ends[chunk] - to[:-1], n) + np.arange(to[-1])], n

    def decode(self, ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(data, at): the bytes of rows of ids, with the leading space; ids outside the model count for nothing."""
        ids = ids.astype(np.int64)
        known = (ids >= 0) & (ids < len(self.pieces))
        ids = np.where(known, ids, 0)
        n = np.where(known, self.lengths[ids], 0)
        to = np.concatenate([[0], np.cumsum(n)])
        return self.written[np.repeat(self.starts[ids] - to[:-1], n) + np.arange(to[-1])], to[at]


def _prepared(texts: pa.Array, model: Model) -> pa.Array:
    """Texts as they are segmented: null as empty, the marker character as a space, a space before each text that has something."""
    texts = pc.replace_substring(texts.cast(pa.large_string()).fill_null(""), MARKER, " ")
    if not model.prefix_space:
        return texts
    spaced = pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), texts, pa.scalar("", pa.large_string()))
    return pc.if_else(pc.equal(texts, ""), texts, spaced)


def _encoded(column: pa.Array, model: Model):
    """(i, j, data, at, ids, ends) of the column's rows i to j, a slice at a time."""
    at = text_buffers(column)[1]
    for i, j in slices(at):
        data, to = text_buffers(_prepared(column.slice(i, j - i), model))
        yield i, j, data, to, *model.encode(data, to)


def _same(data: np.ndarray, at: np.ndarray, ids: np.ndarray, ends: np.ndarray, model: Model, texts: pa.Array) -> pa.Array:
    """Which texts their ids decode to; data: the texts prepared."""
    out = []
    for i, j in slices(at, 1 << 19):
        back, to = model.decode(ids[ends[i] : ends[j]], ends[i : j + 1] - ends[i])
        was, now, a = data[at[i] : at[j]].tobytes(), back.tobytes(), at[i : j + 1] - at[i]
        out += [was[p:q] == now[r:s] for p, q, r, s in zip(a[:-1], a[1:], to[:-1], to[1:])]
    return pc.and_not(pa.array(out, pa.bool_()), pc.match_substring(texts.fill_null(""), MARKER))


def encode(docs: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids", same_col: str | None = None) -> DataFrame:
    """docs with `ids_col` array<int>: each whole text's pieces, none for a null or empty text. A column of that name is replaced; repeated rows and other columns do not matter.

    With `same_col`, the ids are decoded too, and it says whether they give the text as it was, as round_trip of `digest` does.
    """
    model = Model.load(docs.sparkSession, path)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    added = [ids_col, same_col] if same_col else [ids_col]
    given = docs.drop(*added)
    if text_col in given.columns and given.schema[text_col].dataType == T.StringType():
        place, extra = given.columns.index(text_col), given
    else:  # a text of another type travels beside its column
        place, extra = len(given.columns), given.withColumn("__text", docs[text_col].cast("string"))
    width = len(given.columns)

    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            texts = b.column(place)
            for i, j, data, at, ids, ends in _encoded(texts, sent.value):
                cols = [*[c.slice(i, j - i) for c in b.columns[:width]], pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids))]
                if same_col:
                    cols.append(_same(data, at, ids, ends, sent.value, texts.slice(i, j - i)))
                yield pa.RecordBatch.from_arrays(cols, names=[*b.schema.names[:width], *added])

    schema = T.StructType([*given.schema.fields, T.StructField(ids_col, T.ArrayType(T.IntegerType())), *([T.StructField(same_col, T.BooleanType())] if same_col else [])])
    return extra.mapInArrow(run, schema)


def decode(rows: DataFrame, path: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """rows with `text_col`: the text of ids_col, empty for null or no ids. A column of that name is replaced."""
    model = Model.load(rows.sparkSession, path)
    sent = rows.sparkSession.sparkContext.broadcast(model)
    given = rows.drop(text_col)

    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            column = b.column(b.num_columns - 1)
            n = np.asarray(column.value_lengths().fill_null(0))
            at = np.concatenate([[0], np.cumsum(n)])
            data, ends = sent.value.decode(np.asarray(column.flatten().fill_null(-1)), at)
            raw = data.tobytes()
            texts = [raw[s:e].decode("utf-8", "replace") for s, e in zip(ends[:-1], ends[1:])]
            if sent.value.prefix_space:
                texts = [t[1:] if t[:1] == " " else t for t in texts]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(texts, pa.string())], names=[*b.schema.names[:-1], text_col])

    return given.withColumn("__ids", F.col(ids_col)).mapInArrow(run, given.schema.add(text_col, T.StringType()))


def digest(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_ids, n_byte_ids, ids_sha256, round_trip) of each row.

    ids_sha256 is that of the ids as little-endian 32-bit integers; round_trip says that decoding
    them gives the text as it was (a null one: empty), which fails only for texts with U+2581.
    """
    import hashlib

    model = Model.load(docs.sparkSession, path)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    byte_kind = model.kinds == BYTE

    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            texts = b.column("text")
            for i, j, data, at, ids, ends in _encoded(texts, sent.value):
                counts = np.concatenate([[0], np.cumsum(byte_kind[ids])])
                raw = ids.tobytes()
                sha = [hashlib.sha256(raw[4 * s : 4 * e]).hexdigest() for s, e in zip(ends[:-1], ends[1:])]
                cols = [b.column("id").slice(i, j - i), pa.array(np.diff(ends)), pa.array(counts[ends[1:]] - counts[ends[:-1]]), pa.array(sha), _same(data, at, ids, ends, sent.value, texts.slice(i, j - i))]
                yield pa.RecordBatch.from_arrays(cols, names=["id", "n_ids", "n_byte_ids", "ids_sha256", "round_trip"])

    chosen = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = chosen.schema["id"].dataType.simpleString()
    out = chosen.mapInArrow(run, f"id {kind}, n_ids long, n_byte_ids long, ids_sha256 string, round_trip boolean")
    return out.withColumnRenamed("id", id_col)
