"""Array kernels over the UTF-8 bytes of many texts at once."""

from __future__ import annotations

import functools

import numpy as np

#: After A-Z went to a-z, words are runs of digits, a-z and bytes beyond ASCII; other bytes are 0 here.
FOLDED = np.array([b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 0 for b in range(256)], np.uint8)
_B = 0x9E3779B97F4A7C15
_B_INV = pow(_B, -1, 1 << 64)
U = np.uint64


def mixed(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ U(seed & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


@functools.lru_cache(1)
def _powers(log: int) -> tuple[np.ndarray, np.ndarray]:
    n = 1 << log
    up, down = np.full(n, _B, U), np.full(n, _B_INV, U)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=U), np.cumprod(down, dtype=U)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """B^i and B^-i modulo 2^64 for at least n values of i; the largest asked for is kept."""
    up, down = _powers(max(16, int(n - 1).bit_length()))
    return up, down


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts, and the offsets of each text's words. A word's hash depends on its bytes only."""
    n = len(data)
    if not n:
        return np.zeros(0, U), np.zeros(len(offsets), np.int64)
    b = FOLDED[data]
    on = b != 0
    start = on.copy()
    start[1:] &= ~on[:-1]
    edge = offsets[:-1][(offsets[:-1] < n) & (np.diff(offsets) > 0)]
    start[edge] = on[edge]
    stop = on.copy()
    stop[:-1] &= ~on[1:]
    last = edge[edge > 0] - 1
    stop[last] = on[last]
    s, e = np.flatnonzero(start), np.flatnonzero(stop) + 1
    up, down = powers(n)
    total = np.zeros(n + 1, U)
    np.cumsum(b.astype(U) * up[:n], dtype=U, out=total[1:])
    h = mixed((total[e] - total[s]) * down[s])
    return h, np.searchsorted(s, offsets).astype(np.int64)


def shingles(h: np.ndarray, at: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of `width` consecutive words (of a shorter text: of all its words), sorted within each text, and offsets."""
    n = np.diff(at)
    count = np.where(n >= width, n - width + 1, np.minimum(n, 1))
    out_at = np.concatenate([[0], np.cumsum(count)]).astype(np.int64)
    total = int(out_at[-1])
    if not total:
        return np.zeros(0, U), out_at
    first = np.repeat(at[:-1], count) + np.arange(total) - np.repeat(out_at[:-1], count)
    end = np.repeat(at[1:], count)
    acc = np.zeros(total, U)
    k = 1
    for j in range(width):
        i = first + j
        ok = i < end
        acc += np.where(ok, h[np.minimum(i, len(h) - 1)], U(0x5851F42D4C957F2D)) * U(k)
        k = k * 0xD6E8FEB86659FD93 & 0xFFFFFFFFFFFFFFFF
    acc = mixed(acc)
    for i, j in zip(out_at[:-1], out_at[1:], strict=True):
        if j - i > 1:
            acc[i:j].sort()
    return acc, out_at


def runs(sh: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text, how often each occurs, and the index of the text."""
    if not len(sh):
        return sh, np.zeros(0, np.int64), np.zeros(0, np.int64)
    new = np.ones(len(sh), bool)
    new[1:] = sh[1:] != sh[:-1]
    new[at[:-1][at[:-1] < len(sh)]] = True
    i = np.flatnonzero(new)
    doc = np.searchsorted(at, i, side="right") - 1
    return sh[i], np.diff(np.append(i, len(sh))), doc
