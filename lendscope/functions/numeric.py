"""Numeric helpers shared by operators and oracle SQL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def np_round(c, digits: int) -> Column:
    """Round like NumPy/pandas ``round``: scale, round half to even on the
    scaled binary value, unscale.  (``bround(x, d)`` rounds the shortest
    decimal string of x instead, which differs on values like 1.015.)"""
    c = F.col(c) if isinstance(c, str) else c
    s = float(10 ** digits)
    return F.bround(c * s, 0) / s


def clip(c: Column, lo: float | None = None, hi: float | None = None) -> Column:
    """Clip to [lo, hi] (None = open)."""
    if lo is not None:
        c = F.greatest(c, F.lit(lo))
    if hi is not None:
        c = F.least(c, F.lit(hi))
    return c


def _split(x: Column):
    """Veltkamp split: x = hi + lo with 26-bit halves."""
    c = x * 134217729.0  # 2^27 + 1
    hi = c - (c - x)
    return hi, x - hi


def fma(a: Column, b: Column, c: Column) -> Column:
    """a * b + c with one rounding (emulated with exact products and sums:
    Dekker's two-product and Knuth's two-sum), as a fused multiply-add
    gives; used where results must agree bit-for-bit with engines that
    interpolate with FMA."""
    p = a * b
    ah, al = _split(a)
    bh, bl = _split(b)
    e = ((ah * bh - p) + ah * bl + al * bh) + al * bl   # a*b = p + e exactly
    s = p + c
    bb = s - p
    t = (p - (s - bb)) + (c - bb)                        # p + c = s + t exactly
    return s + (t + e)
