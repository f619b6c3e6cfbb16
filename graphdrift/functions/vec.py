"""Column arithmetic for 2-D vectors and the force formulas.

Everything here returns Column expressions, so the formulas run inside
whole-stage codegen next to the joins and aggregations that feed them.
ANSI mode raises on division by zero, so every denominator is floored or
guarded.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def lit(v) -> Column:
    return v if isinstance(v, Column) else F.lit(v)


def length(dx: Column, dy: Column) -> Column:
    return F.sqrt(dx * dx + dy * dy)


def floored_length(dx: Column, dy: Column, eps: float) -> Column:
    """l = max(eps, |d|)."""
    return F.greatest(F.lit(float(eps)), length(dx, dy))


def repulsion(dx: Column, dy: Column, k: float | Column, scale: float, eps: float) -> tuple[Column, Column]:
    """Force on i from j with d = p_i - p_j: scale * (k^2 / l) * d / l."""
    k = lit(k)
    l = floored_length(dx, dy, eps)
    f = F.lit(float(scale)) * k * k / (l * l)
    return f * dx, f * dy


def attraction(dx: Column, dy: Column, k: float | Column, scale: float, eps: float,
               weight: Column | None = None) -> tuple[Column, Column]:
    """Pull for a link with d = p_s - p_t: scale * (l^2 / k) * d / l (added to t, taken from s)."""
    k = lit(k)
    l = floored_length(dx, dy, eps)
    f = F.lit(float(scale)) * l / k
    if weight is not None:
        f = f * weight
    return f * dx, f * dy


def gravity(x: Column, y: Column, gamma: float, eps: float) -> tuple[Column, Column]:
    """(gamma / l) * (0 - p) / l with l = max(eps, |p|)."""
    l = floored_length(x, y, eps)
    f = F.lit(-float(gamma)) / (l * l)
    return f * x, f * y


def cap_factor(dx: Column, dy: Column, temperature: float) -> Column:
    """min(T, |D|) / |D|, 0 when |D| = 0."""
    n = length(dx, dy)
    return F.when(n > 0, F.least(F.lit(float(temperature)), n) / n).otherwise(F.lit(0.0))


def clamp(v: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(float(lo)), F.least(F.lit(float(hi)), v))


def on_grid(v: Column, step: float) -> Column:
    """The nearest point of the grid of ``step``.  Positions live on this grid, so vertices that
    meet in exact arithmetic meet in floating point too, in whatever order sums were taken."""
    return F.floor(v / F.lit(float(step)) + F.lit(0.5)).cast("double") * F.lit(float(step))


def unit_hash(*parts: Column) -> Column:
    """A number in [0, 1) with 48 random bits from the parts (md5, so any engine can repeat it)."""
    digest = F.md5(F.concat_ws("|", *[p.cast("string") for p in parts]).cast("binary"))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))


def r4(c: Column) -> Column:
    """Round to 4 decimals and normalise -0.0 (used where results are compared)."""
    return F.round(c, 4) + F.lit(0.0)
