"""Colour: spectra to CIE XYZ to sRGB, and false colour from components or map coordinates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cubeflux.functions import cie

#: XYZ (D65) to linear sRGB, and the gamma curve's constants (fixed values of the sRGB standard).
TO_RGB = ((3.2406, -1.5372, -0.4986), (-0.9689, 1.8758, 0.0415), (0.0557, -0.2040, 1.0570))


def default_centers(n: int, first: float = 400.0, step: float = 5.0) -> list[float]:
    return [first + step * i for i in range(n)]


def xyz(s, centers: list[float], top: float) -> list[Column]:
    """X, Y, Z of a spectrum: weighted sums over the bands the observer knows, divided by the sum of its second curve."""
    c = F.col(s) if isinstance(s, str) else s
    index = [round((w - 360) / 5) for w in centers]
    known = [0 <= k < len(cie.CIE_Y) for k in index]
    green = sum(cie.CIE_Y[k] for k, ok in zip(index, known, strict=True) if ok) or 1.0
    out = []
    for curve in (cie.CIE_X, cie.CIE_Y, cie.CIE_Z):
        w = F.array(*(F.lit(curve[k] if ok else 0.0) for k, ok in zip(index, known, strict=True)))
        out.append(F.aggregate(F.zip_with(c, w, lambda v, k: v * k / top), F.lit(0.0), lambda t, v: t + v) / green)
    return out


def srgb(x: Column, y: Column, z: Column) -> list[Column]:
    """R, G, B in 0..1."""
    out = []
    for a, b, c in TO_RGB:
        v = F.least(F.greatest(a * x + b * y + c * z, F.lit(0.0)), F.lit(1.0))
        out.append(F.when(v <= 0.0031308, 12.92 * v).otherwise(1.055 * F.pow(v, F.lit(1 / 2.4)) - 0.055))
    return out


def bytes_of(channel: Column) -> Column:
    """0..1 to 0..255, truncated."""
    return F.floor(channel * 255).cast("int")
