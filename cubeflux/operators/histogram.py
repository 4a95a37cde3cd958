"""Ranges and histograms: per band, joint, and sparse N-dimensional per label, with incremental updates."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cubeflux.functions import spectral
from cubeflux.model import Cube


def data_range(pixels: DataFrame) -> DataFrame:
    """(lo, hi) over all bands; partial ranges are aggregated before the one-row shuffle."""
    return pixels.agg(F.min(F.array_min("s")).alias("lo"), F.max(F.array_max("s")).alias("hi"))


def band_ranges(cube: Cube) -> DataFrame:
    """One row with arrays lows and highs by band."""
    b = [F.get("s", F.lit(i)) for i in range(cube.n_bands)]
    return cube.pixels.agg(F.array(*map(F.min, b)).alias("lows"), F.array(*map(F.max, b)).alias("highs"))


def norm_range(cube: Cube, mode: str, gradient: bool = False, fixed: tuple[float, float] | None = None) -> DataFrame:
    """The range to normalise by: observed, theoretical, or fixed."""
    if mode == "observed":
        return data_range(cube.pixels)
    top = math.log(255.0)
    lo, hi = fixed if mode == "fixed" else ((-top, top) if gradient else (0.0, 255.0))
    return cube.pixels.sparkSession.range(1).select(F.lit(lo).alias("lo"), F.lit(hi).alias("hi"))


def robust_range(cube: Cube, share: float, bins: int = 100) -> DataFrame:
    """The range without ceil(share * n) samples at each end, on conservative bin borders; the top value counts in the last bin."""
    r = data_range(cube.pixels)
    v = cube.samples().select("value").join(F.broadcast(r), F.lit(True))
    width = (F.col("hi") - F.col("lo")) / bins
    b = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col("value") - F.col("lo")) / F.nullif(width, F.lit(0.0))), F.lit(bins - 1))).otherwise(F.lit(0))
    h = v.groupBy(b.cast("int").alias("bin")).agg(F.count("*").alias("n"), F.first("lo").alias("lo"), F.first("hi").alias("hi"))
    up, down = Window.partitionBy(F.lit(1)).orderBy("bin"), Window.partitionBy(F.lit(1)).orderBy(F.desc("bin"))
    c = h.withColumns({"below": F.sum("n").over(up), "above": F.sum("n").over(down), "all": F.sum("n").over(Window.partitionBy(F.lit(1)))})
    cut = F.ceil(F.col("all") * share)
    return c.agg(
        F.min(F.when(F.col("below") > cut, F.col("lo") + F.col("bin") * width)).alias("lo"),
        F.max(F.when(F.col("above") > cut, F.col("lo") + (F.col("bin") + 1) * width)).alias("hi"),
    )


def band_histogram(cube: Cube, lo: float, hi: float, bins: int = 64) -> DataFrame:
    """(label, band, bin, n): the marginals of the N-dimensional histogram."""
    px = cube.pixels.select("label", F.posexplode(spectral.bin_index("s", lo, hi, bins)).alias("band", "bin"))
    return px.groupBy("label", "band", "bin").agg(F.count("*").alias("n"))


def keyed(cube: Cube, lo: float, hi: float, bins: int, n_labels: int | None = None) -> DataFrame:
    """label, key (bin of every band), s. Labels from n_labels on count as background."""
    label = F.col("label") if n_labels is None else F.when(F.col("label") >= n_labels, 0).otherwise(F.col("label"))
    return cube.pixels.select(label.alias("label"), spectral.bin_index("s", lo, hi, bins).alias("key"), "s")


def _sums(n: int, sign: Column | None = None) -> Column:
    return F.array(*(F.sum(F.get("s", F.lit(i)) * sign if sign is not None else F.get("s", F.lit(i))) for i in range(n)))


def nd_histogram(cube: Cube, lo: float, hi: float, bins: int = 64, n_labels: int | None = None) -> DataFrame:
    """(label, key, weight, sums). Sums of bands are plain aggregates, so they combine map-side."""
    return keyed(cube, lo, hi, bins, n_labels).groupBy("label", "key").agg(F.count("*").alias("weight"), _sums(cube.n_bands).alias("sums"))


def apply_changes(state: DataFrame, added: DataFrame, removed: DataFrame, n_bands: int) -> DataFrame:
    """A histogram after adding and retracting partial histograms; bins of weight 0 vanish."""
    neg = removed.select("label", "key", (-F.col("weight")).alias("weight"), F.transform("sums", lambda v: -v).alias("sums"))
    both = state.select("label", "key", "weight", "sums").unionByName(added.select("label", "key", "weight", "sums")).unionByName(neg)
    sums = F.array(*(F.sum(F.get("sums", F.lit(i))) for i in range(n_bands)))
    return both.groupBy("label", "key").agg(F.sum("weight").alias("weight"), sums.alias("sums")).filter("weight <> 0")


def keeps_context(old: tuple[float, float], new: tuple[float, float]) -> bool:
    """Whether a range moved so little (10 % at each end) that an existing histogram can be updated."""
    span = (old[1] - old[0]) or 1.0
    return abs(new[0] - old[0]) <= 0.1 * span and abs(new[1] - old[1]) <= 0.1 * span


def boundary(bins: DataFrame) -> DataFrame:
    """(label, band, lo, hi): the occupied bins of each band."""
    long = bins.select("label", F.posexplode("key").alias("band", "bin"))
    return long.groupBy("label", "band").agg(F.min("bin").alias("lo"), F.max("bin").alias("hi"))


def vertices(bins: DataFrame, use_mean: bool = False, lo: float = 0.0, size: float = 1.0) -> DataFrame:
    """Polyline vertices of bins: (label, key, band, position)."""
    if use_mean:
        return bins.select("label", "key", F.posexplode(F.transform("sums", lambda v: (v / F.col("weight") - lo) / size)).alias("band", "position"))
    return bins.select("label", "key", F.posexplode(F.transform("key", lambda v: v + 0.5)).alias("band", "position"))


def _bin1(cube: Cube, band: int, bins: int) -> Column:
    return F.least(F.greatest(F.floor((F.get("s", F.lit(band)) - cube.lo) * bins / (cube.hi - cube.lo)), F.lit(0)), F.lit(bins - 1)).cast("int")


def joint_histogram(cube: Cube, a: int, b: int, bins: int) -> DataFrame:
    """(b1, b2, p, p1, p2): joint and marginal probabilities of two bands."""
    j = cube.pixels.groupBy(_bin1(cube, a, bins).alias("b1"), _bin1(cube, b, bins).alias("b2")).agg(F.count("*").alias("n"))
    t = F.sum("n").over(Window.partitionBy(F.lit(1)))
    return j.select("b1", "b2", (F.col("n") / t).alias("p"), (F.sum("n").over(Window.partitionBy("b1")) / t).alias("p1"), (F.sum("n").over(Window.partitionBy("b2")) / t).alias("p2"))


def mutual_information(cube: Cube, a: int, b: int, bins: int) -> DataFrame:
    """mutual = H1 + H2 - H12 and normalised = (H1 + H2) / H12. Each cell's share of a marginal entropy sums to it."""
    j = joint_histogram(cube, a, b, bins)
    h1, h2, h12 = (-F.sum(F.col("p") * F.log2(c)) for c in ("p1", "p2", "p"))
    return j.agg(F.round(h1 + h2 - h12, 6).alias("mutual"), F.round((h1 + h2) / F.nullif(h12, F.lit(0.0)), 6).alias("normalised"))


def two_histograms(cube: Cube, a: int, b: int, bins: int) -> DataFrame:
    """(bin, n1, n2) with empty bins."""
    grid = cube.pixels.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    one = cube.pixels.groupBy(_bin1(cube, a, bins).alias("bin")).agg(F.count("*").cast("double").alias("n1"))
    two = cube.pixels.groupBy(_bin1(cube, b, bins).alias("bin")).agg(F.count("*").cast("double").alias("n2"))
    return grid.join(one, "bin", "left").join(two, "bin", "left").na.fill(0.0)


def earth_mover(h: DataFrame) -> DataFrame:
    """1-D earth mover's distance: the sum of differences of the cumulative shares."""
    up, all_ = Window.partitionBy(F.lit(1)).orderBy("bin"), Window.partitionBy(F.lit(1))
    c = h.select((F.sum("n1").over(up) / F.sum("n1").over(all_)).alias("c1"), (F.sum("n2").over(up) / F.sum("n2").over(all_)).alias("c2"))
    return c.agg(F.round(F.sum(F.abs(F.col("c1") - F.col("c2"))), 6).alias("distance"))


def entropy(cube: Cube, band: int, bins: int) -> DataFrame:
    """Entropy in bits of a band's histogram over its observed range."""
    v = F.get("s", F.lit(band))
    r = cube.pixels.agg(F.min(v).alias("lo"), F.max(v).alias("hi"))
    b = F.least(F.floor((v - F.col("lo")) * bins / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0))), F.lit(bins - 1))
    h = cube.pixels.join(F.broadcast(r), F.lit(True)).groupBy(F.coalesce(b, F.lit(0)).alias("bin")).agg(F.count("*").alias("n"))
    p = F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1)))
    return h.select((-p * F.log2(p)).alias("e")).agg(F.round(F.sum("e"), 6).alias("entropy"))
