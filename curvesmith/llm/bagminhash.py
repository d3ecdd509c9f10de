"""BagMinHash signatures of word-shingle multisets.

A shingle that occurs w times covers the weights [0, w). Weights are discretised at the integers and grouped in a
hierarchy of intervals [0,1), [1,2), [2,4), [4,8) ...; each interval of each shingle has a Poisson process of its own, with
a rate equal to its width, whose points carry a weight and a component. A text sees those points of its shingles whose
weight is below w, so the first point of a component is the same for two texts with a probability equal to their weighted
Jaccard similarity. A text draws points only up to the latest first point of its components.
"""

from __future__ import annotations

import numpy as np

from .kernels import U, mixed

#: Signature components; bands of ROWS components each. At a similarity of 0.8 a pair shares no band with 5e-6.
COMPONENTS, ROWS = 240, 6
BANDS = COMPONENTS // ROWS
NEVER = U(0xFFFFFFFFFFFFFFFF)
#: Points drawn at a time.
STEP = 1 << 18


def entries(x: np.ndarray, w: np.ndarray, doc: np.ndarray):
    """Interval of the hierarchy for each (shingle, weight): seeds, low ends, widths, weights, texts."""
    seeds, low, width, weight, owner = [mixed(x, 1)], [np.zeros(len(x))], [np.ones(len(x))], [w], [doc]
    lo = 1
    more = np.flatnonzero(w > lo)
    while len(more):
        seeds.append(mixed(x[more], 1 + lo * 0x9E3779B9))
        low.append(np.full(len(more), float(lo)))
        width.append(np.full(len(more), float(lo)))
        weight.append(w[more])
        owner.append(doc[more])
        lo *= 2
        more = more[w[more] > lo]
    return tuple(np.concatenate(v) for v in (seeds, low, width, weight, owner))


def signatures(x: np.ndarray, w: np.ndarray, doc: np.ndarray, n_docs: int, m: int = COMPONENTS) -> np.ndarray:
    """(n_docs, m): for each component the first point's time (upper 32 bits) and number. Texts without shingles have
    NEVER throughout."""
    best = np.full(n_docs * m, NEVER, U)
    seed, low, width, weight, owner = entries(x, w, doc)
    t, drawn = np.zeros(len(seed)), 0
    while len(seed):
        k = int(min(64, max(1, STEP // len(seed))))
        index = np.arange(drawn + 1, drawn + k + 1, dtype=U) * U(0xA0761D6478BD642F)
        bits = mixed(seed[:, None] + index[None, :])
        gap = -np.log(((bits >> U(11)).astype(np.float64) + 0.5) * 2.0**-53) / width[:, None]
        at = t[:, None] + np.cumsum(gap, axis=1)
        t = at[:, -1].copy()
        drawn += k
        more = mixed(bits, 0x2545F4914F6CDD1D)
        level = low[:, None] + (more >> U(40)).astype(np.float64) * 2.0**-24 * width[:, None]
        slot = (more & U(0xFFFFF)).astype(np.int64) % m + owner[:, None] * m
        time = at.astype(np.float32).view(np.uint32).astype(U)
        packed = (time << U(32)) | (mixed(bits, 77) >> U(32))
        ok = (level < weight[:, None]) & (packed < best[slot])
        np.minimum.at(best, slot[ok], packed[ok])
        limit = best.reshape(n_docs, m).max(1)
        alive = t.astype(np.float32).view(np.uint32).astype(U) <= (limit >> U(32))[owner]
        if not alive.all():
            seed, low, width, weight, owner, t = (v[alive] for v in (seed, low, width, weight, owner, t))
    return best.reshape(n_docs, m)


def bands(sig: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """(n_docs, bands): one key for each band."""
    n, m = sig.shape
    b = m // rows
    part = sig[:, : b * rows].reshape(n, b, rows)
    acc = np.broadcast_to(np.arange(1, b + 1, dtype=U) * U(0x9E3779B97F4A7C15), (n, b)).copy()
    for j in range(rows):
        acc = mixed(acc ^ part[:, :, j]) + U(j)
    return acc
