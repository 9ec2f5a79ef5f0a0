"""Links between similar texts from shared bands of signatures, exactly verified, without all pairs of a group.

Each item has a node (a 64-bit content hash, so that copies are one node) and bands.  Items that
share a band are mates.  Only the components of the links matter, so a pair within a component
needs no comparison:

1. each node is compared with one pivot, the smallest of its bands' smallest mates;
2. bands whose mates are still in different components are looked through with sketches (bitmaps
   of the sets, from which follows an upper bound of the similarity), and a spanning forest of the
   likeliest links between components is compared;
3. all pairs of mates in different components that the bound does not rule out are compared.  So no
   link that a band proposes is lost.

Bands with the same mates count once.

Every link is decided on the whole sets.  A band's mates are looked through in blocks of bounded
size, a task for each two blocks; what a task gives out is a forest, not its pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, small_enough, with_side
from .components import components

#: Bands that may be broadcast: 8 bytes each.
BANDS = 1_000_000
#: Mates of a band in a block.
BLOCK = 1024
#: Sizes of sketches in 64-bit words: the least that has eight bits for each element, up to the last.
WORDS = (8, 16, 32, 64, 128, 256, 512)

#: Bytes of texts whose sets a comparison holds at once.
TEXTS = 4 << 20

Sets = Callable[[str], np.ndarray]
#: The sets of a column of texts.
Many = Callable[[pa.Array], list[np.ndarray]]


def mates(items: DataFrame) -> DataFrame:
    """(band, node) of bands that at least two nodes share, as a checkpoint. items: (node long, bands array<long>), a row or more for each node.

    One aggregation finds the shared bands.  Of a band with two rows it has both; the rows of larger
    bands are looked up, without a shuffle as long as those bands are few.
    """
    rows = items.select("node", F.explode("bands").alias("band"))
    shared = cut(rows.groupBy("band").agg(F.min("node").alias("lo"), F.max("node").alias("hi"), F.count("*").alias("n")).where("lo < hi"))
    two = shared.where("n = 2").select("band", F.explode(F.array("lo", "hi")).alias("node"))
    more = with_side(rows, shared.where("n > 2").select("band"), "band", rows=BANDS).select("band", "node").distinct()
    return cut(once(cut(two.unionByName(more))))


def once(shared: DataFrame) -> DataFrame:
    """(band, node) with one band of those that have the same mates. shared: distinct rows, a checkpoint."""
    h = F.xxhash64("node")
    sets = shared.groupBy("band").agg(F.count("*").alias("n"), F.bit_xor(h).alias("x"), F.sum(h.bitwiseAND(F.lit((1 << 40) - 1))).alias("s"))
    return shared.join(sets.groupBy("n", "x", "s").agg(F.min("band").alias("band")).select("band"), "band").select("band", "node")


#: A band's last 32 bits and a node, as they travel.
PAIR = np.dtype([("band", "<u4"), ("node", "<i8")])


def packed(bands: np.ndarray, nodes: np.ndarray, parts: int) -> tuple[list, list[bytes]]:
    """Bands dealt to parts with one node each: the parts that have some, and their pairs as bytes; and under the part None all (band, node) of bands that several nodes here share.

    So a band that very many nodes share brings a part one pair from here, however many they are.  A
    band is known by its part and 32 bits more: a chance meeting proposes a pair, which is verified.
    """
    flat, owner = bands.ravel().view(np.uint64), np.repeat(nodes, bands.shape[1])
    part = ((flat >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
    band = (part << np.uint64(32)) | (flat & np.uint64(0xFFFFFFFF))
    order = np.argsort(band)
    band, owner = band[order], owner[order]
    first = np.ones(len(band), bool)
    first[1:] = band[1:] != band[:-1]
    several = ~first
    several[:-1] |= ~first[1:]
    known = np.stack([band[several].view(np.int64), owner[several]], axis=1)
    pairs = np.empty(int(first.sum()), PAIR)
    pairs["band"], pairs["node"] = band[first] & np.uint64(0xFFFFFFFF), owner[first]
    part = (band[first] >> np.uint64(32)).astype(np.int64)
    at = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(part) else np.zeros(0, np.int64)
    ends = np.append(at[1:], len(part))
    return [*part[at].tolist(), None], [*(pairs[a:b].tobytes() for a, b in zip(at, ends)), known.tobytes()]


def unpacked_mates(dealt: DataFrame) -> DataFrame:
    """`mates` from packed pairs, as a checkpoint. dealt: (part int, pairs binary)."""

    def shared(band: np.ndarray) -> np.ndarray:
        same = band[1:] == band[:-1]
        out = np.zeros(len(band), bool)
        out[1:] |= same
        out[:-1] |= same
        return out

    def solve(part: int, blobs: list[bytes]) -> pa.RecordBatch:
        pairs = np.frombuffer(b"".join(blobs), PAIR)
        band = pairs["band"].copy()
        order = np.argsort(band)
        order = order[shared(band[order])]
        pairs = np.unique(pairs[order])
        pairs = pairs[shared(pairs["band"])]
        return pa.RecordBatch.from_arrays([pa.array(pairs["band"].astype(np.int64) | (part << 32)), pa.array(pairs["node"].copy())], names=["band", "node"])

    def run(batches: Iterator[pa.RecordBatch]):
        blobs, last = [], None
        for b in batches:
            for part, pairs in zip(b.column("part").to_pylist(), b.column("pairs")):
                if part != last and blobs:
                    yield solve(last, blobs)
                    blobs = []
                blobs.append(pairs.as_py())
                last = part
        if blobs:
            yield solve(last, blobs)

    def known(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            for pairs in b.column("pairs"):
                own = np.frombuffer(pairs.as_py(), np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(own[:, 0].copy()), pa.array(own[:, 1].copy())], names=["band", "node"])

    together = dealt.where("part is not null").repartition("part").sortWithinPartitions("part")
    found = together.select("part", "pairs").mapInArrow(run, "band long, node long")
    at_once = dealt.where("part is null").select("pairs").mapInArrow(known, "band long, node long")
    return cut(once(cut(found.unionByName(at_once).distinct())))


class Links:
    """Finds components of texts whose sets have denominator * |intersection| >= numerator * |union|."""

    def __init__(self, sets: Sets, numerator: int, denominator: int, many: Many | None = None):
        self.numerator, self.denominator = numerator, denominator
        self.many = many or (lambda texts: [sets(t) for t in texts.to_pylist()])

    def enough(self, both: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return self.denominator * both >= self.numerator * (x + y - both)

    def verified(self, pairs: DataFrame, texts: DataFrame) -> DataFrame:
        """The pairs (a, b) whose texts are similar."""
        a = texts.select(F.col("node").alias("a"), F.col("text").alias("ta"))
        b = texts.select(F.col("node").alias("b"), F.col("text").alias("tb"))

        def similar(x: np.ndarray, y: np.ndarray) -> bool:
            if not (len(x) and len(y) and self.enough(min(len(x), len(y)), len(x), len(y))):
                return False
            whole = np.concatenate([x, y])
            whole.sort(kind="stable")
            return self.enough(np.count_nonzero(whole[1:] == whole[:-1]), len(x), len(y))

        def run(batches: Iterator[pa.RecordBatch]):
            for batch in batches:
                ends = [batch.column("a").to_pylist(), batch.column("b").to_pylist()]
                size = [pc.binary_length(batch.column(c)).to_pylist() for c in ("ta", "tb")]
                keep, first = [], 0
                while first < len(ends[0]):  # as many pairs as have so many bytes of different texts
                    places: list[dict[int, int]] = [{}, {}]
                    last, total = first, 0
                    while last < len(ends[0]) and (total < TEXTS or last == first):
                        for nodes, n, own in zip(ends, size, places):
                            if nodes[last] not in own:
                                own[nodes[last]] = last
                                total += n[last]
                        last += 1
                    x, y = (dict(zip(own, self.many(batch.column(c).take(pa.array(own.values(), pa.int64()))))) for own, c in zip(places, ("ta", "tb")))
                    keep += [(i, j) for i, j in zip(ends[0][first:last], ends[1][first:last]) if similar(x[i], y[j])]
                    first = last
                yield _pairs(keep)

        return pairs.select("a", "b").join(a, "a").join(b, "b").select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")

    def sketched(self, texts: DataFrame) -> DataFrame:
        """(node, n, sketch): set sizes and bitmaps."""

        def run(batches: Iterator[pa.RecordBatch]):
            for b in batches:
                n, bits = [], []
                for h in self.many(b.column("text")):
                    words = next((w for w in WORDS if 8 * w >= len(h)), WORDS[-1])
                    n.append(len(h))
                    bits.append(np.packbits(np.bincount((h % np.uint64(64 * words)).astype(np.int64), minlength=64 * words) > 0, bitorder="little").tobytes())
                yield pa.RecordBatch.from_arrays([b.column("node"), pa.array(n, pa.int32()), pa.array(bits, pa.binary())], names=["node", "n", "sketch"])

        return texts.select("node", "text").mapInArrow(run, "node long, n int, sketch binary")

    def possible(self, shared: DataFrame, roots: DataFrame, sketches: DataFrame, every: bool) -> DataFrame:
        """Pairs (a < b) of mates in different components that the sketches do not rule out: a forest over each band's components, or all."""
        rows = _apart(shared, roots)
        block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
        rows = rows.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        rows = rows.select("band", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "node", "root").join(sketches, "node")
        together = rows.repartition("band", "i", "j").sortWithinPartitions("band", "i", "j", "node").select("band", "i", "j", "node", "root", "n", "sketch")
        compare = self._compare

        def run(batches: Iterator[pa.RecordBatch]):
            group, key = [], None
            for b in batches:
                rows = zip(*(b.column(c).to_pylist() for c in ("band", "i", "j", "node", "root", "n", "sketch")))
                out = []
                for band, i, j, *rest in rows:
                    if (band, i, j) != key:
                        out += compare(group, every)
                        group, key = [], (band, i, j)
                    group.append(rest)
                yield _pairs(out)
            yield _pairs(compare(group, every))

        return together.mapInArrow(run, "a long, b long").distinct()

    def _compare(self, group: list, every: bool) -> list[tuple[int, int]]:
        if len(group) < 2:
            return []
        nodes, n = np.array([g[0] for g in group]), np.array([g[2] for g in group])
        if len({g[1] for g in group}) < 2:
            return []
        _, root = np.unique([g[1] for g in group], return_inverse=True)
        own = np.array([len(g[3]) // 8 for g in group])
        parent = np.arange(root.max() + 1)

        def top(r: int) -> int:
            while parent[r] != r:
                parent[r] = parent[parent[r]]
                r = parent[r]
            return r

        tables = {}
        for words in np.unique(own):
            rows = np.flatnonzero((own == words) | (own == 2 * words))
            m = np.zeros((len(rows), words), np.uint64)
            for k, r in enumerate(rows):
                bits = np.frombuffer(group[r][3], np.uint64)
                m[k] = bits if own[r] == words else bits[:words] | bits[words:]
            tables[words] = rows, m
        out = []
        for i in range(len(group)):
            rows, m = tables[own[i]]
            at = (rows > i) | (own[rows] != own[i])
            at &= root[rows] != root[i]
            at &= self.enough(np.minimum(n[rows], n[i]), n[rows], n[i])
            rows, others = rows[at], m[at]
            if not len(rows):
                continue
            x = np.frombuffer(group[i][3], np.uint64)
            both = np.minimum(n[i] - np.bitwise_count(x & ~others).sum(axis=1, dtype=np.int64), n[rows] - np.bitwise_count(others & ~x).sum(axis=1, dtype=np.int64))
            ok = np.flatnonzero(self.enough(both, n[rows], n[i]))
            for k in ok[np.argsort(-(both[ok] / (n[rows[ok]] + n[i] - both[ok])), kind="stable")]:
                if not every:
                    p, q = top(root[i]), top(root[rows[k]])
                    if p == q:
                        continue
                    parent[p] = q
                out.append((int(min(nodes[i], nodes[rows[k]])), int(max(nodes[i], nodes[rows[k]]))))
        return out

    def components(self, shared: DataFrame, texts: DataFrame) -> DataFrame:
        """(id, root) of nodes that have a verified link. shared: (band, node), a checkpoint; texts: (node, text) of these nodes, a checkpoint."""
        pivots = shared.groupBy("band").agg(F.min("node").alias("p"))
        tested = cut(pivots.join(shared, "band").groupBy("node").agg(F.min("p").alias("p")).where("p < node").select(F.col("p").alias("a"), F.col("node").alias("b")))
        links = cut(self.verified(tested, texts))
        roots = cut(components(links))
        apart = cut(_apart(shared, roots).select("node").distinct())
        if not apart.head(1):
            return roots
        sketches = cut(self.sketched(texts.join(apart, "node", "left_semi")))
        for every in (False, True):
            left = cut(self.possible(shared, roots, sketches, every).join(tested, ["a", "b"], "left_anti"))
            links, tested = links.unionByName(cut(self.verified(left, texts))), tested.unionByName(left)
            roots = cut(components(links))
        return roots


def _apart(shared: DataFrame, roots: DataFrame) -> DataFrame:
    """(band, node, root, blocks) of bands whose mates are in different components."""
    side = roots.select(F.col("id").alias("node"), "root")
    labelled = shared.join(F.broadcast(side) if small_enough(side) else side, "node", "left").select("band", "node", F.coalesce("root", "node").alias("root"))
    mixed = labelled.groupBy("band").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("size")).where("lo < hi").select("band", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks"))
    return labelled.join(mixed, "band")


def _pairs(out: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p[k] for p in out], pa.int64()) for k in (0, 1)], names=["a", "b"])
