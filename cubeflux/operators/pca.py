"""Principal components: one distributed pass for the moments, a small eigenproblem on the driver, projection per row."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cubeflux.functions.spectral import bound
from cubeflux.model import Cube


def moments(cube: Cube) -> tuple[np.ndarray, np.ndarray]:
    """Mean and covariance. Each partition's sums are added row by row in a shuffle; the driver gets one matrix."""
    n = cube.n_bands

    def sums(batches):
        import pandas as pd

        count, total, gram = 0, np.zeros(n), np.zeros((n, n))
        for pdf in batches:
            if len(pdf):
                m = np.array(pdf["s"].tolist())
                count, total, gram = count + len(m), total + m.sum(axis=0), gram + m.T @ m
        if count:
            yield pd.DataFrame({"band": range(n), "n": count, "t": total, "g": list(gram)})

    parts = cube.pixels.select("s").mapInPandas(sums, "band int, n long, t double, g array<double>")
    row = F.array(*(F.sum(F.get("g", F.lit(k))) for k in range(n)))
    rows = sorted(parts.groupBy("band").agg(F.sum("n").alias("n"), F.sum("t").alias("t"), row.alias("g")).collect())  # one row per band
    if not rows:
        return np.zeros(n), np.zeros((n, n))
    count = rows[0].n
    mean = np.array([r.t for r in rows]) / count
    return mean, np.array([r.g for r in rows]) / count - np.outer(mean, mean)


def fit(cube: Cube, components: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean, components (rows, largest variance first, largest entry positive), variances; 0 components means all."""
    mean, cov = moments(cube)
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(-values, kind="stable")[: components or None]
    rows = vectors[:, order].T
    rows *= np.sign(rows[np.arange(len(rows)), np.abs(rows).argmax(axis=1)])[:, None]
    return mean, rows, values[order]


def _matrix(m: np.ndarray) -> Column:
    return F.array(*(F.array(*map(F.lit, row.tolist())) for row in m))


def project(s, mean: np.ndarray, components: np.ndarray) -> Column:
    """Coordinates of a spectrum: dot products of the centred spectrum with literal components."""
    c = F.col(s) if isinstance(s, str) else s
    centred = F.zip_with(c, F.array(*map(F.lit, mean.tolist())), lambda v, m: v - m)
    return bound(lambda z: F.transform(_matrix(components), lambda row: F.aggregate(F.zip_with(z["x"], row, lambda v, k: v * k), F.lit(0.0), lambda t, v: t + v)), x=centred)


def back_project(coords, mean: np.ndarray, components: np.ndarray) -> Column:
    """The mean plus the components, each times its coordinate."""
    c = F.col(coords) if isinstance(coords, str) else coords
    parts = F.zip_with(c, _matrix(components), lambda k, row: F.transform(row, lambda v: v * k))
    return F.aggregate(parts, F.array(*map(F.lit, mean.tolist())), lambda t, v: F.zip_with(t, v, lambda x, y: x + y))


def false_colour(cube: Cube, per_band: bool = False) -> DataFrame:
    """(vec_id, r, g, b) in 0..1 from the first three components: first to green, second to blue, third to red."""
    mean, rows, _ = fit(cube, 3)
    px = cube.pixels.select("vec_id", project("s", mean, rows).alias("p"))
    names = ("g", "b", "r")
    px = px.select("vec_id", *(F.get("p", F.lit(i)).alias(n) for i, n in enumerate(names)))
    span = px.agg(*(f(n).alias(f"{k}{n}") for n in names for k, f in (("lo", F.min), ("hi", F.max))))
    px = px.join(F.broadcast(span), F.lit(True))
    lo, hi = F.least("log", "lob", "lor"), F.greatest("hig", "hib", "hir")

    def scaled(n):
        a, z = (F.col(f"lo{n}"), F.col(f"hi{n}")) if per_band else (lo, hi)
        return F.when(z > a, (F.col(n) - a) / F.nullif(z - a, F.lit(0.0))).otherwise(F.lit(0.0)).alias(n)

    return px.select("vec_id", *(scaled(n) for n in ("r", "g", "b")))
