"""Per-pixel transforms of spectra: array expressions that stay inside the JVM and need no shuffle."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(s) -> Column:
    return F.col(s) if isinstance(s, str) else s


def bound(f, **values) -> Column:
    """f of a struct of values, each computed once for a row: a reduction named inside another array function's lambda
    would be computed again for every element."""
    one = F.array(F.struct(*(_c(v).alias(k) for k, v in values.items())))
    return F.get(F.transform(one, f), F.lit(0))


def rescale(s, lo: float, hi: float, new_lo: float, new_hi: float) -> Column:
    """From one range to another; equal ranges change nothing."""
    if (lo, hi) == (new_lo, new_hi) or hi == lo:
        return _c(s)
    return F.transform(_c(s), lambda v: (v - lo) * (new_hi - new_lo) / (hi - lo) + new_lo)


def rescale_between(s, lo: Column, hi: Column, new_lo: float, new_hi: float) -> Column:
    """As rescale, from a range in columns; an empty range gives new_lo."""
    return F.transform(_c(s), lambda v: F.when(hi > lo, (v - lo) * (new_hi - new_lo) / F.nullif(hi - lo, F.lit(0.0)) + new_lo).otherwise(F.lit(float(new_lo))))


def stretch_bands(s, lows: Column, highs: Column, new_lo: float, new_hi: float) -> Column:
    """Each band from its own range (arrays by band)."""
    return F.transform(_c(s), lambda v, i: F.when(F.get(highs, i) > F.get(lows, i), (v - F.get(lows, i)) * (new_hi - new_lo) / F.nullif(F.get(highs, i) - F.get(lows, i), F.lit(0.0)) + new_lo).otherwise(F.lit(float(new_lo))))


def clamp(s, lo: float, hi: float) -> Column:
    return F.transform(_c(s), lambda v: F.least(F.greatest(v, F.lit(lo)), F.lit(hi)))


def log(s) -> Column:
    """max(ln v, 0); values without a logarithm become 0."""
    return F.transform(_c(s), lambda v: F.when(v > 0, F.greatest(F.ln(v), F.lit(0.0))).otherwise(F.lit(0.0)))


def norm(s) -> Column:
    return F.sqrt(F.aggregate(_c(s), F.lit(0.0), lambda a, v: a + v * v))


def normalise(s) -> Column:
    """Divided by the L2 norm; a zero norm counts as 1."""
    n = F.coalesce(F.nullif(norm(s), F.lit(0.0)), F.lit(1.0))
    return bound(lambda z: F.transform(z["s"], lambda v: v / z["n"]), s=s, n=n)


def gradient(s) -> Column:
    """Differences of neighbouring bands (one band fewer)."""
    return bound(lambda z: F.transform(F.slice(z["s"], 2, F.greatest(F.size(z["s"]) - 1, F.lit(0))), lambda v, i: v - F.get(z["s"], i)), s=s)


def resize_plan(n: int, m: int) -> list[tuple[int, int, float]]:
    """(lower band, upper band, fraction) of each of m bands: linear interpolation at half-pixel centres, ends clamped."""
    out = []
    for i in range(m):
        p = (i + 0.5) * n / m - 0.5
        lo = math.floor(p)
        out.append((min(max(lo, 0), n - 1), min(max(lo + 1, 0), n - 1), p - lo))
    return out


def resize(s, n: int, m: int) -> Column:
    plan = resize_plan(n, m)
    table = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(f).alias("f")) for a, b, f in plan))
    return bound(lambda z: F.transform(table, lambda t: F.get(z["s"], t["a"]) * (1 - t["f"]) + F.get(z["s"], t["b"]) * t["f"]), s=s)


def black_body(wavelength_nm: Column, temperature: float) -> Column:
    """Planck's law over wavelengths rounded to whole nm, 100 at 560 nm."""
    return _planck(F.round(wavelength_nm) * 1e-9, temperature) * F.lit(100.0 / _planck_value(560e-9, temperature))


def _planck(metres: Column, t: float) -> Column:
    return F.lit(3.7418e-16) * F.pow(metres, F.lit(-5.0)) / (F.exp(F.lit(1.4388e-2) / (F.lit(t) * metres)) - 1)


def _planck_value(metres: float, t: float) -> float:
    return 3.7418e-16 * metres**-5.0 / (math.exp(1.4388e-2 / (t * metres)) - 1)


def illuminate(s, coefficients, remove: bool = False) -> Column:
    """Multiply (or divide) each band by its coefficient."""
    return bound(lambda z: F.transform(z["s"], lambda v, i: v / F.get(z["c"], i) if remove else v * F.get(z["c"], i)), s=s, c=coefficients)


def quantise(s, lo: float, hi: float, top: int = 65535) -> Column:
    """Truncated to 0..top over the range."""
    return F.transform(_c(s), lambda v: F.floor((v - lo) * top / (hi - lo)).cast("int"))


def dequantise(s, lo: float, hi: float, top: int = 65535) -> Column:
    return F.transform(_c(s), lambda v: v * (hi - lo) / top + lo)


def bin_position(s, lo: float, hi: float, bins: int) -> Column:
    """Position in bins; the bin size leaves the top value in the last bin."""
    size = (hi - lo) / (bins - 1)
    return F.transform(_c(s), lambda v: (v - lo) / size)


def bin_index(s, lo: float, hi: float, bins: int) -> Column:
    size = (hi - lo) / (bins - 1)
    return F.transform(_c(s), lambda v: F.least(F.greatest(F.floor((v - lo) / size), F.lit(0)), F.lit(bins - 1)).cast("int"))


def opacity(weight: Column, total: Column, alpha: float = 1.0) -> Column:
    """Line opacity on a logarithmic scale, at most 1."""
    ratio = F.when(total > 1, F.ln(weight + 1) / F.ln(F.greatest(total, F.lit(2.0)))).otherwise(F.lit(1.0))
    return F.least(F.lit(1.0), alpha * (0.01 + 0.99 * ratio))


def gauss_weight(distance2: Column, sigma: float, rate: float) -> Column:
    """Neighbourhood weight on a squared distance."""
    return rate * F.exp(-distance2 / (2 * sigma * sigma))


def geometric_weights(n: int) -> list[float]:
    """2^(n-1-i) / (2^n - 1)."""
    return [2.0 ** (n - 1 - i) / (2.0**n - 1) for i in range(n)]


def som_coordinate(index: Column, side: int, dims: int) -> list[Column]:
    """Coordinates of a neuron in an isometric map, divided by side - 1."""
    return [(F.floor(index / side**d) % side) / float(max(1, side - 1)) for d in range(dims)]
