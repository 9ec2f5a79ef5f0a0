"""Signatures of sets of 64-bit hashes, and their bands."""

from __future__ import annotations

import numpy as np

from .textstats import BASE, mix

GOLD = 0x9E3779B97F4A7C15
SPLIT = np.uint64(0xD1B54A32D192ED03)
NONE = np.uint64(0xFFFFFFFFFFFFFFFF)

#: Hashes that MinHash works on at once.
PART = 1 << 15


def super_minhash(h: np.ndarray, row: np.ndarray, rows: int, size: int) -> np.ndarray:
    """SuperMinHash signatures (Ertl, 2017), `size` <= 256 values for each of `rows` sets; h are hashes of the elements, row their set, ascending.

    Each element deals the ranks 0, 1, 2, ... to the slots by a random permutation of its own, and
    offers slot j its rank plus a random fraction; a slot keeps the least offer.  Offers of rank t
    are below t + 1, so ranks are dealt level by level to all elements at once, and a set stops as
    soon as all its slots are taken: later ranks cannot change them.
    """
    out = np.full(rows * size, NONE, np.uint64)
    deal = np.tile(np.arange(size, dtype=np.uint8), (len(h), 1))
    for t in range(size):
        if not len(h):
            break
        x = mix(h + np.uint64((t + 1) * GOLD & 0xFFFFFFFFFFFFFFFF))
        y = mix(x ^ SPLIT)
        k = t + ((y >> np.uint64(32)) * np.uint64(size - t) >> np.uint64(32)).astype(np.int64)
        at = np.arange(len(h))
        slot = deal[at, k]
        deal[at, k] = deal[:, t]
        np.minimum.at(out, row * size + slot, (np.uint64(t) << np.uint64(56)) | (x >> np.uint64(8)))
        taken = ~(out.reshape(rows, size) == NONE).any(axis=1)
        going = ~taken[row]
        if not going.all():
            h, row, deal = h[going], row[going], deal[going]
    return out.reshape(rows, size)


def minhash(h: np.ndarray, at: np.ndarray, size: int, seed: int = 5) -> np.ndarray:
    """MinHash signatures of `size` 32-bit values: the least of each of `size` multiply-add hashes over h[at[i]:at[i + 1]], no range empty."""
    random = np.random.default_rng(seed)
    a = random.integers(0, 1 << 32, size, np.uint32) | np.uint32(1)
    b = random.integers(0, 1 << 32, size, np.uint32)
    low = (h >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(at) - 1, size), np.uint32)
    first = 0
    while first < len(at) - 1:  # in parts that stay in the cache
        last = max(first + 1, int(np.searchsorted(at, at[first] + PART, "right")) - 1)
        part, starts = low[at[first] : at[last]], at[first:last] - at[first]
        work = np.empty_like(part)
        for j in range(size):
            np.multiply(part, a[j], out=work)
            work += b[j]
            out[first:last, j] = np.minimum.reduceat(work, starts)
        first = last
    return out


def bands(signatures: np.ndarray, each: int) -> np.ndarray:
    """A signed 64-bit value for each band of `each` values of a signature; different bands never share one but by chance."""
    n, size = signatures.shape
    s = signatures.astype(np.uint64).reshape(n, size // each, each)
    h = np.broadcast_to(np.arange(1, size // each + 1, dtype=np.uint64) * BASE, s.shape[:2]).copy()
    for i in range(each):
        h = mix(h * BASE + s[:, :, i])
    return h.view(np.int64)
