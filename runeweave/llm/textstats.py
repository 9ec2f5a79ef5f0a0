"""Hashes and word boundaries of whole texts in numpy, a slice of rows at a time."""

from __future__ import annotations

import numpy as np

#: Odd multipliers of 64 bits: the base of the polynomial and the rounds of the finaliser.
BASE = np.uint64(0x9E3779B97F4A7C15)
MIX1 = np.uint64(0xBF58476D1CE4E5B9)
MIX2 = np.uint64(0x94D049BB133111EB)
#: The inverse of BASE modulo 2**64.
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
#: Bytes of [\x20\x09-\x0D]; A-Z in lower case.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Powers that a worker keeps: enough for a slice of texts. Longer ranges make theirs anew.
KEPT = (1 << 20) + 64
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads all bits."""
    x = x ^ (x >> np.uint64(30))
    x *= MIX1
    x ^= x >> np.uint64(27)
    x *= MIX2
    x ^= x >> np.uint64(31)
    return x


def powers(n: int, of: np.uint64 = BASE) -> np.ndarray:
    """of**0 ... of**(n - 1) modulo 2**64."""
    name = str(of)
    if n > KEPT:
        return _made(n, of)
    if name not in _powers:
        _powers[name] = _made(KEPT, of)
    return _powers[name][:n]


def _made(n: int, of: np.uint64) -> np.ndarray:
    out = np.full(n, of, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out, out=out)


#: Values of the units that are frequent in texts: bytes and the first code points.
VALUE = mix(np.arange(1, (1 << 13) + 1, dtype=np.uint64) * BASE)


def prefix(units: np.ndarray) -> np.ndarray:
    """Polynomial hashes of all prefixes: bytes by a table, larger units by mixing."""
    if units.dtype == np.uint8 or not len(units) or units.max() < len(VALUE):
        value = VALUE[units]
    else:
        value = mix((units.astype(np.uint64) + np.uint64(1)) * BASE)
    out = np.zeros(len(units) + 1, np.uint64)
    np.multiply(value, powers(len(units)), out=out[1:])
    del value
    return np.cumsum(out, out=out)


def ranges(h: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of [start, end), the same wherever the content stands."""
    return mix((h[end] - h[start]) * powers(len(h), INVERSE)[start])


def words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of rows that stand one after the other in data."""
    space = SPACE[data]
    before = np.empty(len(data), bool)
    before[:1] = True
    before[1:] = space[:-1]
    rows = at[:-1][at[:-1] < len(data)]
    before[rows] = True
    start = np.flatnonzero(before & ~space)
    after = np.empty(len(data), bool)
    after[-1:] = True
    after[:-1] = space[1:]
    after[rows[rows > 0] - 1] = True
    return start, np.flatnonzero(after & ~space) + 1


def word_shingles(data: np.ndarray, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the distinct shingles of `size` words of each row, in lower case, sorted; fewer words count as one shingle."""
    data = LOWER[data]
    start, end = words(data, at)
    w = ranges(prefix(data), start, end)
    first = np.searchsorted(start, at)
    n = np.diff(first)
    row = np.repeat(np.arange(len(n)), n)
    left = first[1:][row] - np.arange(len(w))
    h = mix(w + np.uint64(1))
    whole = left >= size
    for i in range(1, size):
        has = left > i
        h[has] = mix(h[has] * BASE + w[np.flatnonzero(has) + i] + np.uint64(i))
    keep = whole | ((n[row] < size) & (np.arange(len(w)) == first[:-1][row]))
    return distinct(row[keep], h[keep], len(n))


def distinct(row: np.ndarray, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, hash), sorted; row is ascending."""
    if not len(h):
        return row, h
    at = np.searchsorted(row, np.arange(n + 1))
    parts = [np.unique(h[a:b]) for a, b in zip(at[:-1], at[1:])]
    return np.repeat(np.arange(n), [len(p) for p in parts]), np.concatenate(parts)


def char_shingles(text: str, size: int) -> np.ndarray:
    """Distinct hashes of the shingles of `size` code points of one text, sorted; a shorter text counts as one shingle."""
    units = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    if not len(units):
        return np.zeros(0, np.uint64)
    start = np.arange(max(1, len(units) - size + 1))
    return np.unique(ranges(prefix(units), start, np.minimum(start + size, len(units))))
