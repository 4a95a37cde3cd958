"""Distances of two spectra, as column expressions. Each is symmetric where its definition is."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .spectral import bound


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda t, v: t + v)


def _zip(a: Column, b: Column, f) -> Column:
    return F.zip_with(a, b, f)


def dot(a: Column, b: Column) -> Column:
    return _sum(_zip(a, b, lambda x, y: x * y))


def manhattan(a, b):
    return _sum(_zip(a, b, lambda x, y: F.abs(x - y)))


def euclidean(a, b):
    return F.sqrt(_sum(_zip(a, b, lambda x, y: (x - y) * (x - y))))


def chebyshev(a, b):
    return F.array_max(_zip(a, b, lambda x, y: F.abs(x - y)))


def spectral_angle(a, b):
    """Radians. Two zero vectors are at 0, one at pi/2; the cosine is clamped."""
    na, nb = F.sqrt(dot(a, a)), F.sqrt(dot(b, b))
    cosine = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / F.nullif(na * nb, F.lit(0.0))))
    return F.when((na == 0) & (nb == 0), F.lit(0.0)).when((na == 0) | (nb == 0), F.acos(F.lit(0.0))).otherwise(F.acos(cosine))


def information_divergence(a, b):
    """Symmetric Kullback-Leibler divergence of the spectra as distributions, at least 0; 0 if a sum is 0."""

    def terms(z):
        pa, pb = F.transform(z["a"], lambda v: v / F.nullif(z["sa"], F.lit(0.0))), F.transform(z["b"], lambda v: v / F.nullif(z["sb"], F.lit(0.0)))
        t = _zip(pa, pb, lambda x, y: F.when((x > 0) & (y > 0), (x - y) * (F.ln(x) - F.ln(y))).otherwise(F.lit(0.0)))
        return F.when((z["sa"] == 0) | (z["sb"] == 0), F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), _sum(t)))

    return bound(terms, a=a, b=b, sa=_sum(a), sb=_sum(b))


def sid_sam_sin(a, b):
    return F.sqrt(F.greatest(F.lit(0.0), information_divergence(a, b) * F.sin(spectral_angle(a, b))))


def sid_sam_tan(a, b):
    return F.sqrt(F.greatest(F.lit(0.0), information_divergence(a, b) * F.tan(spectral_angle(a, b))))


def normalised_l2(a, b):
    """L2 of the spectra divided by their means; 0 if a mean is 0."""

    def distance(z):
        d = _zip(z["a"], z["b"], lambda x, y: F.pow(x / F.nullif(z["ma"], F.lit(0.0)) - y / F.nullif(z["mb"], F.lit(0.0)), F.lit(2.0)))
        return F.when((z["ma"] == 0) | (z["mb"] == 0), F.lit(0.0)).otherwise(F.sqrt(_sum(d)))

    return bound(distance, a=a, b=b, ma=_sum(a) / F.size(a), mb=_sum(b) / F.size(b))


def mean_squares(a, b):
    return _sum(_zip(a, b, lambda x, y: (x - y) * (x - y))) / F.size(a)


def reciprocal_square_difference(a, b, scale: float = 30.0):
    return _sum(_zip(a, b, lambda x, y: 1 / (1 + (x - y) * (x - y) / (scale * scale))))


def normalised_cross_correlation(a, b):
    n = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(n == 0, F.lit(0.0)).otherwise(-dot(a, b) / F.nullif(n, F.lit(0.0)))


def correlation(a, b):
    """Pearson correlation over the bands (population form); 0 if a variance is 0."""

    def moments(z):
        cov = _sum(_zip(z["a"], z["b"], lambda x, y: (x - z["ma"]) * (y - z["mb"])))
        va = _sum(F.transform(z["a"], lambda x: (x - z["ma"]) * (x - z["ma"])))
        vb = _sum(F.transform(z["b"], lambda x: (x - z["mb"]) * (x - z["mb"])))
        return F.struct(cov.alias("cov"), (va * vb).alias("v"))

    m = bound(moments, a=a, b=b, ma=_sum(a) / F.size(a), mb=_sum(b) / F.size(b))
    return bound(lambda z: F.when(z["m"]["v"] <= 0, F.lit(0.0)).otherwise(z["m"]["cov"] / F.sqrt(F.nullif(z["m"]["v"], F.lit(0.0)))), m=m)


def spectral_distance(a, b, lo: float = 0.0, hi: float = 1.0):
    """L2 distance as a share of the declared range lo..hi; unscaled if that is empty."""
    d = euclidean(a, b)
    return d if hi == lo else (d - lo) / (hi - lo)


def similarity_value(a, b, lo: float = 0.0, hi: float = 1.0):
    """Distance and correlation in one value: the correlation as an angle in [0, 1] lowers the squared distance."""
    d = spectral_distance(a, b, abs(lo), abs(hi))
    cosine = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (correlation(a, b) + 1) / 2))
    angle = F.acos(cosine) / F.acos(F.lit(0.0))
    both = d * d - (1 - angle) * (1 - angle)
    return F.sqrt(F.when(both < 0, d * d).otherwise(both))


def anywhere(measure):
    """A measure of two spectra as one of spectra and places, which it doesn't look at."""
    return lambda a, b, at_a, at_b: measure(a, b)


def spatial(measure, scale: float):
    """A measure of spectra and places (structs of y and x): the spectra's, and scale for each pixel that lies between."""
    def placed(a, b, at_a, at_b):
        dy, dx = at_a["y"] - at_b["y"], at_a["x"] - at_b["x"]
        return measure(a, b) + scale * F.sqrt((dy * dy + dx * dx).cast("double"))

    return placed


def within(measure, reach: int):
    """A measure of spectra and places that is infinite beyond so many rows or columns."""
    def placed(a, b, at_a, at_b):
        far = F.greatest(F.abs(at_a["y"] - at_b["y"]), F.abs(at_a["x"] - at_b["x"])) > reach
        return F.when(far, F.lit(float("inf"))).otherwise(measure(a, b))

    return placed


#: Measures that a user chooses by name.
MEASURES = {
    "MANHATTAN": manhattan,
    "EUCLIDEAN": euclidean,
    "CHEBYSHEV": chebyshev,
    "MOD_SPEC_ANGLE": spectral_angle,
    "SPEC_INF_DIV": information_divergence,
    "SIDSAM1": sid_sam_sin,
    "SIDSAM2": sid_sam_tan,
    "NORM_L2": normalised_l2,
}
