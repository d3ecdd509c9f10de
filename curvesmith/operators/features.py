"""Curve features: 366 numbers a curve, in fixed slices, by a grouped map over ordered points."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .ordered import cubic_weights

#: Fixed layout: slice of each block.
SCHEMA = {"raw": (0, 128), "fft": (128, 160), "fft_phase": (160, 192), "deriv": (192, 320), "stats": (320, 329), "curv": (329, 366)}
WIDTH = 366
#: What is smaller is not scaled up.
TINY = 1e-10


def resampled(y: np.ndarray, n: int) -> np.ndarray:
    return np.interp(np.linspace(0, 1, n), np.linspace(0, 1, len(y)), y) if len(y) > 1 else np.full(n, y[0] if len(y) else 0.0)


def unit(v: np.ndarray) -> np.ndarray:
    """Over its greatest size."""
    top = np.abs(v).max(initial=0.0)
    return v / top if top > TINY else v


def bend(y: np.ndarray) -> np.ndarray:
    """Signed curvature of a curve with even steps of one."""
    d1 = np.gradient(y)
    return np.nan_to_num(np.gradient(d1) / (1 + np.clip(d1, -1e4, 1e4) ** 2) ** 1.5)


def turns(v: np.ndarray) -> int:
    """Places where the sign differs from the one before; 0 is a sign of its own."""
    return int(np.count_nonzero(np.diff(np.sign(v))))


def shape(y: np.ndarray, n: int = 128, pull: float = 5.0) -> np.ndarray:
    """The curve at n places that lie denser where it bends (density 1 + pull * curvature), from 0 to 1."""
    if len(y) < 3:
        v = resampled(y, n)
    else:
        share = np.cumsum(np.maximum(1 + pull * np.abs(bend(y)), 1e-4))
        x = np.linspace(0, 1, len(y))
        v = np.interp(np.interp(np.linspace(0, 1, n), share / share[-1], x), x, y)
    span = v.max() - v.min()
    return (v - v.min()) / span if span > TINY else np.zeros(n)


def spectrum(y: np.ndarray, n: int = 32) -> tuple[np.ndarray, np.ndarray]:
    """Magnitudes over the greatest, and phases over pi (0 where the magnitude is below a hundredth), of the first n
    frequencies of the curve less its mean under a Hann window."""
    z = np.fft.rfft((y - y.mean()) * np.hanning(len(y)) if len(y) > 1 else y)[:n]
    z = np.pad(z, (0, n - len(z)))
    mag = unit(np.abs(z))
    weak = (mag < 0.01) & (np.abs(z).max() > TINY)
    return mag, np.where(weak, 0.0, np.angle(z) / np.pi)


def slopes(y: np.ndarray, n: int = 64) -> np.ndarray:
    """First and second differences of the smoothed curve at n places each."""
    if len(y) < 3:
        return np.zeros(2 * n)
    if len(y) >= 11:
        p = cubic_weights()
        y = np.concatenate([p[:5] @ y[:11], np.convolve(y, p[5], "valid"), p[6:] @ y[-11:]])
    d1 = np.gradient(y)
    return np.concatenate([unit(resampled(d1, n)), unit(resampled(np.gradient(d1), n))])


def moments(y: np.ndarray) -> np.ndarray:
    """Of the standardised curve: mean, deviation, least, greatest, median, skewness, excess kurtosis, sign changes and
    extrema."""
    z = (y - y.mean()) / (y.std() + TINY)
    c = z - z.mean()
    m2, m3, m4 = ((c**k).mean() for k in (2, 3, 4))
    level = m2 <= (np.finfo(float).eps * z.mean()) ** 2
    return np.array([z.mean(), z.std(), z.min(), z.max(), np.median(z), 0.0 if level else m3 / m2**1.5, 0.0 if level else m4 / m2**2 - 3, turns(z), turns(np.diff(z))])


def bends(y: np.ndarray, n: int = 32) -> np.ndarray:
    """Signed curvature of the curve's moving average at n places over its greatest size; mean, deviation, least,
    greatest and sign changes of that."""
    if len(y) < 2:
        return np.zeros(n + 5)
    k = unit(resampled(np.clip(bend(np.convolve(y, np.full(7, 1 / 7), "same") if len(y) >= 7 else y), -100, 100), n))
    return np.concatenate([k, [k.mean(), k.std(), k.min(), k.max(), turns(k)]])


def features(y: np.ndarray) -> np.ndarray:
    """All blocks in the order of the layout; zeros for a curve without points. What is not finite counts as 0 or as the
    bound of 1e100."""
    y = np.nan_to_num(np.asarray(y, float), nan=0.0).clip(-1e100, 1e100)
    return np.concatenate([shape(y), *spectrum(y), slopes(y), moments(y), bends(y)]) if len(y) else np.zeros(WIDTH)


def curve_features(points: DataFrame, key: str, pos: str, y: str) -> DataFrame:
    """(key, features). A curve is one group: its points are ordered in the task, and a curve is bounded by nature."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(pos)
        return pd.DataFrame({key: [pdf[key].iloc[0]], "features": [features(pdf[y].to_numpy()).tolist()]})

    kind = points.schema[key].dataType.simpleString()
    return points.select(key, pos, y).groupBy(key).applyInPandas(run, f"{key} {kind}, features array<double>")


def frequencies(x: np.ndarray, y: np.ndarray, top: int = 3, grid: int = 1024, lo: float = 0.1, hi: float = 50.0) -> list[float]:
    """Angular frequencies of the strongest peaks on an even grid, harmonics of a stronger one left out."""
    o = np.argsort(x, kind="stable")
    x, y = np.asarray(x, float)[o], np.asarray(y, float)[o]
    if len(x) < 8 or x[-1] <= x[0]:
        return []
    g = np.linspace(x[0], x[-1], grid)
    v = np.interp(g, x, y)
    v = (v - v.mean()) * np.hanning(grid)
    mag = np.abs(np.fft.rfft(v, 4 * grid))
    w = 2 * np.pi * np.fft.rfftfreq(4 * grid, g[1] - g[0])
    peak = np.flatnonzero((mag[1:-1] > mag[:-2]) & (mag[1:-1] >= mag[2:])) + 1
    peak = peak[(w[peak] > lo) & (w[peak] < hi) & (mag[peak] > 0.1 * mag.max())]
    out: list[float] = []
    for p in peak[np.argsort(-mag[peak], kind="stable")]:
        if all(abs(w[p] / o - round(w[p] / o)) > 0.05 or round(w[p] / o) < 2 for o in out):
            out.append(float(w[p]))
        if len(out) == top:
            break
    return out
