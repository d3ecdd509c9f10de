"""Repeated windows by merging Burrows-Wheeler transforms.

Strings are cut, from every offset, into symbols of SYMBOL bytes, so that a string is SYMBOL interleaved chains of symbols
and a window of WINDOW bytes is a prefix of WINDOW / SYMBOL symbols. Each shard of strings has a transform of its own: for
its suffixes in order, the symbol before each. Shards are merged by refining their interleave: one pass over the
transforms in the present interleave, dealing entries stably by symbol, makes it right for one symbol more. A boundary
that appears in a pass is a common prefix of that many symbols; blocks that are whole after the last pass are the
intervals of equal windows. Suffixes are never sorted again.
"""

from __future__ import annotations

import numpy as np

from .kernels import U, mixed, powers

WINDOW, SYMBOL = 100, 25
DEPTH = WINDOW // SYMBOL
#: Bytes of strings in one shard.
SHARD = 1 << 17


def symbols(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Dense number (from 1) of the symbol at each place where a whole one fits, string by string, and their offsets."""
    up, down = powers(len(data))
    total = np.zeros(len(data) + 1, U)
    np.cumsum((data.astype(U) + U(1)) * up[: len(data)], dtype=U, out=total[1:])
    n = np.diff(at) - SYMBOL + 1
    out = np.concatenate([[0], np.cumsum(n)])
    p = np.arange(out[-1]) - np.repeat(out[:-1], n) + np.repeat(at[:-1], n)
    h = mixed((total[p + SYMBOL] - total[p]) * down[p])
    _, number = np.unique(h, return_inverse=True)
    return number.astype(np.int32) + 1, out


def dealt(number: np.ndarray) -> np.ndarray:
    """Stable order of int32 numbers from 0, dealt by their lower, then by their upper 16 bits: numpy deals numbers that
    short in linear time, and sorts longer ones."""
    order = np.argsort(number.astype(np.uint16), kind="stable")
    if len(number) and (upper := number >> 16).any():
        order = order[np.argsort(upper.astype(np.uint16)[order], kind="stable")]
    return order


class Shard:
    """Transform of some strings: bwt[i] is the symbol before the i-th suffix (0: none); place[i] is where that suffix
    begins (index in the symbols of all strings), -1 for the ends of chains."""

    def __init__(self, sym: np.ndarray, at: np.ndarray, lo: int, hi: int):
        size = np.diff(at[lo : hi + 1])
        base = at[lo]
        n = int(at[hi] - base)
        own = sym[base : base + n]
        local = at[lo : hi + 1] - base
        begin, end = np.repeat(local[:-1], size), np.repeat(local[1:], size)
        i = np.arange(n)
        before = np.where(i - SYMBOL >= begin, i - SYMBOL, -1)  # the suffix one symbol longer
        last = np.flatnonzero(i + SYMBOL >= end)  # chains' last symbols
        # rows 0..n-1 are suffixes, n.. the ends of chains; what stands before each row
        prev = np.concatenate([before, last])
        char = np.where(prev >= 0, own[prev], 0)
        longest = -(-int(size.max()) // SYMBOL) if len(size) else 0  # symbols of the longest chain
        order = np.concatenate([np.arange(n, n + len(last)), i])
        ends = np.arange(n, n + len(last))
        for _ in range(longest):
            p = prev[order]
            p = p[p >= 0]
            order = np.concatenate([ends, p[dealt(own[p])]])
        self.bwt = char[order].astype(np.int32)
        self.place = np.where(order < n, order + base, -1)


def merged(shards: list[Shard], depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """(places in merged order, block of each): suffixes of a block have their first `depth` symbols in common."""
    bwt = np.concatenate([s.bwt for s in shards])
    place = np.concatenate([s.place for s in shards])
    z = np.repeat(np.arange(len(shards), dtype=np.uint16), [len(s.bwt) for s in shards])
    block = np.zeros(len(z), np.int64)
    for _ in range(depth):
        row = np.empty(len(z), np.int64)  # the row that the k-th entry of a shard in the interleave stands for
        row[np.argsort(z, kind="stable")] = np.arange(len(z))
        c = bwt[row]
        deal = dealt(c)
        z, c, block = z[deal], c[deal], block[deal]
        new = np.ones(len(z), bool)
        new[1:] = (c[1:] != c[:-1]) | (block[1:] != block[:-1])
        block = np.cumsum(new)
    row = np.empty(len(z), np.int64)
    row[np.argsort(z, kind="stable")] = np.arange(len(z))
    return place[row], block


def later_windows(data: np.ndarray, at: np.ndarray, ids: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Strings (all of WINDOW bytes or more) that begin at (ids, starts) of their documents. Returns (string, offset) of
    each window that also begins at a smaller (id, place) among them."""
    sym, sat = symbols(data, at)
    cuts = [0]
    while cuts[-1] < len(at) - 1:
        j = int(np.searchsorted(at, at[cuts[-1]] + SHARD, side="right")) - 1
        cuts.append(min(max(j, cuts[-1] + 1), len(at) - 1))
    place, block = merged([Shard(sym, sat, i, j) for i, j in zip(cuts, cuts[1:], strict=False)])
    ok = place >= 0
    place, block = place[ok], block[ok]
    s = np.repeat(np.arange(len(at) - 1), np.diff(sat))[place]
    off = place - sat[s]
    ok = off <= (at[s + 1] - at[s]) - WINDOW
    s, off, block = s[ok], off[ok], block[ok]
    n = np.bincount(block) if len(block) else np.zeros(1, np.int64)
    ok = n[block] > 1
    s, off, block = s[ok], off[ok], block[ok]
    if not len(s):
        return s, off
    _, document = np.unique(ids, return_inverse=True)
    where = (document[s] << 32) | (starts[s] + off)  # places in the order of documents
    first = np.flatnonzero(np.append(True, block[1:] != block[:-1]))
    late = where > np.repeat(np.minimum.reduceat(where, first), np.diff(np.append(first, len(s))))
    return s[late], off[late]
