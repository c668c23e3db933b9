"""Words of UTF-8 texts as arrays of places and 64-bit hashes, without an object per word.

A word is a maximal run of bytes outside a set of separators; it never crosses rows. Its hash is a
polynomial over random byte codes, mixed; equal words hash alike everywhere, different ones collide
with a chance near 2**-50 or less. Long shingles and windows are hashed from the words' hashes.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

U = np.uint64
_MIX = (U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB))
_GOLDEN = U(0x9E3779B97F4A7C15)
_BASE = 0xD1342543DE82EF95
_MASK = (1 << 64) - 1
CHUNK = 1 << 17


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values after which every bit depends on every bit."""
    h = h ^ (h >> U(30))
    h *= _MIX[0]
    h ^= h >> U(27)
    h *= _MIX[1]
    h ^= h >> U(31)
    return h


def table(*members: int) -> np.ndarray:
    """A lookup of bytes: true for ``members``."""
    out = np.zeros(256, bool)
    out[list(members)] = True
    return out


WHITE = table(0x20, *range(0x09, 0x0E))
NOT_ALNUM = np.array([b < 0x80 and not chr(b).isalnum() for b in range(256)])
NEWLINE = table(0x0A)
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
_CODES = mix(np.arange(1, 257, dtype=U) * _GOLDEN)


def _powers(n: int, base: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, by doubling."""
    out = np.ones(n, U)
    done, step = 1, base
    while done < n:
        more = min(done, n - done)
        out[done : done + more] = out[:more] * U(step)
        done, step = done + more, step * step & _MASK
    return out


_tables = {"up": _powers(CHUNK * 2, _BASE), "down": _powers(CHUNK * 2, pow(_BASE, -1, 1 << 64))}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if n <= CHUNK * 2:
        return _tables["up"], _tables["down"]
    return _powers(n, _BASE), _powers(n, pow(_BASE, -1, 1 << 64))


class Words(NamedTuple):
    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    hash: np.ndarray


def runs(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray):
    """Start, end and row of each maximal run of bytes outside ``separators``."""
    inside = ~separators[data]
    if not inside.any():
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    full = np.flatnonzero(np.diff(offsets))
    before = np.empty_like(inside)
    before[0], before[1:] = False, inside[:-1]
    before[offsets[full]] = False
    start = np.flatnonzero(inside & ~before)
    after = before
    after[-1], after[:-1] = False, inside[1:]
    after[offsets[full + 1] - 1] = False
    end = np.flatnonzero(inside & ~after) + 1
    row = full[np.searchsorted(offsets[full], start, "right") - 1]
    return start, end, row


def run_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of each run's bytes; works through the data in pieces that fit a cache."""
    out = np.empty(len(start), U)
    first = 0
    while first < len(start):
        origin = start[first]
        last = max(first + 1, int(np.searchsorted(end, origin + CHUNK, "right")))
        piece = data[origin : end[last - 1]]
        up, down = _power_tables(len(piece) + 1)
        sums = np.zeros(len(piece) + 1, U)
        np.cumsum(_CODES[piece] * up[: len(piece)], out=sums[1:])
        a, b = start[first:last] - origin, end[first:last] - origin
        out[first:last] = (sums[b] - sums[a]) * down[a] + (b - a).astype(U)
        first = last
    return mix(out)


def words(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = WHITE) -> Words:
    start, end, row = runs(data, offsets, separators)
    return Words(start, end, row, run_hashes(data, start, end))


def sequence_hashes(hashes: np.ndarray, row: np.ndarray, width: int):
    """Hash and first place of each ``width`` neighbours of one row."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, U), np.empty(0, np.int64)
    h = hashes[:n].copy()
    for k in range(1, width):
        h *= U(_BASE)
        h += hashes[k : k + n]
    if width > 1:
        at = np.flatnonzero(row[:n] == row[width - 1 :])
        h = h[at]
    else:
        at = np.arange(n)
    return mix(h + U(width)), at


def per_row(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many true bytes each row has."""
    sums = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=sums[1:])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def with_row(h: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Keys that are equal for equal hashes of one row."""
    return mix(h ^ mix((row.astype(U) + U(1)) * _GOLDEN))


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int):
    """Distinct ``width``-word shingles of each row, A-Z lower-cased: hashes sorted by row and value,
    and how many each row has. A row of fewer words has its whole sequence as one shingle."""
    w = words(LOWER[data], offsets)
    n_rows = len(offsets) - 1
    counts = np.bincount(w.row, minlength=n_rows)
    h, at = sequence_hashes(w.hash, w.row, width)
    row = w.row[at]
    short = np.flatnonzero((counts > 0) & (counts < width))
    if len(short):
        firsts = np.cumsum(counts) - counts
        extra = np.empty(len(short), U)
        for k in range(1, width):
            of = np.flatnonzero(counts[short] == k)
            if len(of):
                acc = np.zeros(len(of), U)
                for j in range(k):
                    acc = acc * U(_BASE) + w.hash[firsts[short[of]] + j]
                extra[of] = mix(acc + U(k))
        h, row = np.concatenate([h, extra]), np.concatenate([row, short])
        order = np.argsort(row, kind="stable")
        h, row = h[order], row[order]
    sizes = np.bincount(row, minlength=n_rows)
    ends = np.cumsum(sizes)
    for a, b in zip((ends - sizes).tolist(), ends.tolist(), strict=True):
        h[a:b].sort()
    new = np.ones(len(h), bool)
    if len(h) > 1:
        new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    h, row = h[new], row[new]
    return h, np.bincount(row, minlength=n_rows)
