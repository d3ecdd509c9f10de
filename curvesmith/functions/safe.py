"""The numeric contract: guarded scalar functions as Column expressions, without UDFs and safe under ANSI mode."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

BIG, HUGE = 1e6, 1e8
#: Corners of the blended arithmetic operator: (beta, gamma) to what they mean.
CORNERS = {"add": (1.0, 1.0), "mul": (2.0, 1.0), "div": (2.0, -1.0), "sub": (1.0, -1.0)}


def lit(v) -> Column:
    return v if isinstance(v, Column) else F.lit(float(v))


def clamp(v: Column, most: float) -> Column:
    """To [-most, most]; NaN becomes `most`, as it sorts above all numbers."""
    return F.greatest(F.least(v, F.lit(most)), F.lit(-most))


def is_finite(v: Column) -> Column:
    return v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))


def rounded(v: Column, digits: int) -> Column:
    """Half up by floor, so that other engines can say the same."""
    scale = float(10**digits)
    return F.floor(v * scale + 0.5) / F.lit(scale)


def divided(a: Column, b: Column) -> Column:
    """a / b, null where b is 0 (a plain division raises under ANSI mode)."""
    return a / F.nullif(b, F.lit(0.0))


def periodic(x: Column, amplitude=1.0, omega=1.0, phi=0.0) -> Column:
    return lit(amplitude) * F.sin(lit(omega) * x + lit(phi))


def signed_power(x: Column, p: float, eps: float = 1e-10, most: float | None = HUGE) -> Column:
    """(|x| + eps)^p, with the sign of x unless p is an even whole number."""
    even = abs(p - round(p)) < 1e-6 and round(p) % 2 == 0
    size = F.pow(F.abs(x) + F.lit(eps), F.lit(float(p)))
    v = size if even else F.signum(x) * size
    return v if most is None else clamp(v, most)


def int_power(x: Column, p: float) -> Column:
    n = min(6, max(2, round(p)))
    return clamp(F.pow(x, F.lit(float(n))), HUGE)


def clamped_exp(x: Column, omega=1.0, phi=0.0) -> Column:
    return clamp(F.exp(F.least(lit(omega) * x + lit(phi), F.lit(700.0))), BIG)


def safe_log(x: Column, eps: float = 1e-6) -> Column:
    return clamp(F.ln(F.abs(x) + F.lit(eps)), BIG)


def safe_division(a: Column, b: Column) -> Column:
    """a / (|b| + 1e-6) with the sign of b; 0 where b is 0."""
    return clamp(a / (F.abs(b) + F.lit(1e-6)) * F.signum(b), BIG)


def corner_weights(beta: float, gamma: float, sharpness: float = 5.0) -> dict[str, float]:
    """Softmax of the negative squared distances to the corners."""
    t = min(100.0, max(0.1, sharpness))
    z = {k: -t * ((beta - b) ** 2 + (gamma - g) ** 2) for k, (b, g) in CORNERS.items()}
    top = max(z.values())
    e = {k: math.exp(v - top) for k, v in z.items()}
    return {k: v / sum(e.values()) for k, v in e.items()}


def soft_arithmetic(a: Column, b: Column, beta: float, gamma: float, sharpness: float = 5.0) -> Column:
    w = corner_weights(beta, gamma, sharpness)
    ratio = a / (F.abs(b) + F.lit(1e-6)) * F.signum(b)
    return clamp(F.lit(w["add"]) * (a + b) + F.lit(w["mul"]) * (a * b) + F.lit(w["div"]) * ratio + F.lit(w["sub"]) * (a - b), BIG)


def soft_aggregation(a: Column, b: Column, tau: float) -> Column:
    """Mean of a and b weighted by exp(value / tau)."""
    t = tau if abs(tau) >= 1e-3 else math.copysign(1e-3, tau)
    top = F.greatest(a / F.lit(t), b / F.lit(t))
    ea, eb = F.exp(a / F.lit(t) - top), F.exp(b / F.lit(t) - top)
    return (a * ea + b * eb) / (ea + eb)
