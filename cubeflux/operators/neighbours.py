"""Neighbourhoods of the pixel lattice and nearest neighbours, as joins."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cubeflux.model import Cube

EAST_SOUTH = ((0, 1), (1, 0))
EIGHT = ((0, 1), (1, 0), (1, 1), (-1, 1))


def edges(pixels: DataFrame, offsets=EAST_SOUTH) -> DataFrame:
    """(u, v, su, sv): each lattice edge once. One equi-join for all offsets: pixels meet at the shifted coordinate."""
    b = pixels.select(F.col("vec_id").alias("v"), F.col("y").alias("vy"), F.col("x").alias("vx"), F.col("s").alias("sv"))
    shift = F.array(*(F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in offsets))
    a = pixels.select(F.col("vec_id").alias("u"), "y", "x", F.col("s").alias("su"), F.explode(shift).alias("d"))
    a = a.select("u", "su", (F.col("y") + F.col("d.dy")).alias("vy"), (F.col("x") + F.col("d.dx")).alias("vx"))
    return a.join(b, ["vy", "vx"]).select("u", "v", "su", "sv")


def weighted(e: DataFrame, measure) -> DataFrame:
    return e.select("u", "v", measure(F.col("su"), F.col("sv")).alias("weight"))


def placed_pairs(pixels: DataFrame, offsets=EIGHT, with_self: bool = False) -> DataFrame:
    """(u, v, su, sv, at_u, at_v): pixels and their neighbours at the offsets, with the places (y, x) of both."""
    offsets = (*offsets, (0, 0)) if with_self else offsets
    b = pixels.select(F.col("vec_id").alias("v"), F.col("y").alias("vy"), F.col("x").alias("vx"), F.col("s").alias("sv"), F.struct("y", "x").alias("at_v"))
    shift = F.array(*(F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in offsets))
    a = pixels.select(F.col("vec_id").alias("u"), F.col("s").alias("su"), F.struct("y", "x").alias("at_u"), F.explode(shift).alias("d"))
    a = a.select("u", "su", "at_u", (F.col("at_u.y") + F.col("d.dy")).alias("vy"), (F.col("at_u.x") + F.col("d.dx")).alias("vx"))
    return a.join(b, ["vy", "vx"]).select("u", "v", "su", "sv", "at_u", "at_v")


def weighted_at(pairs: DataFrame, measure) -> DataFrame:
    """(u, v, weight) by a measure of spectra and places."""
    return pairs.select("u", "v", measure(F.col("su"), F.col("sv"), F.col("at_u"), F.col("at_v")).alias("weight"))


def with_top(e: DataFrame) -> DataFrame:
    """e with the largest weight of all edges: one row, found by partial maxima, that goes to every task."""
    return e.join(F.broadcast(e.agg(F.max("weight").alias("top"))), F.lit(True))


def standard_weights(e: DataFrame, geodesic: bool = False) -> DataFrame:
    """Weights scaled to 0..255; similarity (255 - scaled) unless geodesic."""
    top = F.col("top")
    w = F.when(top > 0, F.col("weight") * 255 / F.nullif(top, F.lit(0.0))).otherwise(F.lit(0.0))
    return with_top(e).select("u", "v", (w if geodesic else 255 - w).alias("weight"))


def equalised(e: DataFrame, bins: int = 20000) -> DataFrame:
    """Edge weights replaced by their place in the cumulative histogram over 0..max."""
    b = F.least(F.ceil(F.col("weight") * (bins - 1) / F.nullif("top", F.lit(0.0)) + 0.5), F.lit(bins - 1))
    h = with_top(e).withColumn("bin", F.coalesce(b, F.lit(0)).cast("int"))
    counts = h.groupBy("bin").agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy(F.lit(1)))
    cdf = counts.withColumn("cdf", F.sum("n").over(Window.partitionBy(F.lit(1)).orderBy("bin")) * (bins - 1) / (2.0 * total))
    return h.join(cdf, "bin").select("u", "v", F.col("cdf").alias("weight"))


def reflect(i: Column, last: Column) -> Column:
    """Border rule that mirrors without repeating the edge."""
    return F.when(last == 0, F.lit(0)).when(i < 0, -i).when(i > last, 2 * last - i).otherwise(i)


def gaussian_blur(cube: Cube, radius: int, sigma: float) -> DataFrame:
    """Each band blurred, down the columns and then along the rows: a pixel takes 2 radius + 1 weighted spectra in each pass."""
    g = [math.exp(-(d * d) / (2 * sigma * sigma)) for d in range(-radius, radius + 1)]
    size = cube.pixels.agg(F.max("y").alias("my"), F.max("x").alias("mx"))
    steps = F.array(*(F.struct(F.lit(d).alias("d"), F.lit(g[d + radius] / sum(g)).alias("w")) for d in range(-radius, radius + 1)))
    sums = F.array(*(F.sum(F.col("w") * F.get("s", F.lit(i))) for i in range(cube.n_bands)))
    now = cube.pixels.select("vec_id", "y", "x", "s")
    for axis, last in (("y", "my"), ("x", "mx")):
        at = now.select("vec_id", F.col("y").alias("ty"), F.col("x").alias("tx"), "y", "x", F.explode(steps).alias("k")).join(F.broadcast(size), F.lit(True))
        at = at.withColumn(axis, reflect(F.col(axis) + F.col("k.d"), F.col(last))).select("vec_id", "ty", "tx", "y", "x", "k.w")
        now = at.join(now.select("y", "x", "s"), ["y", "x"]).groupBy("vec_id", F.col("ty").alias("y"), F.col("tx").alias("x")).agg(sums.alias("s"))
    return now.select("vec_id", "s")


def nearest(pixels: DataFrame, neurons: DataFrame, n: int, distance) -> DataFrame:
    """(vec_id, rank, idx, dist): the n nearest of a small table of neurons (idx, w), ties to the lower index.

    The table goes to every pixel as one array, whose size is the map's and is known before; no pair leaves its row.
    """
    table = neurons.agg(F.array_sort(F.collect_list(F.struct("idx", "w"))).alias("all"))
    scored = F.transform("all", lambda z: F.struct(F.round(distance(F.col("s"), z["w"]), 9).alias("dist"), z["idx"].alias("idx")))
    best = pixels.join(F.broadcast(table), F.lit(True)).select("vec_id", F.posexplode(F.slice(F.array_sort(scored), 1, n)).alias("rank", "z"))
    return best.select("vec_id", "rank", "z.idx", "z.dist")


SOBEL_X = ((-1, -1, -1.0), (-1, 1, 1.0), (0, -1, -2.0), (0, 1, 2.0), (1, -1, -1.0), (1, 1, 1.0))
SOBEL_Y = tuple((dx, dy, w) for dy, dx, w in SOBEL_X)


def sobel(cube: Cube, bands: tuple[int, ...]) -> DataFrame:
    """vec_id and gx, gy (arrays by band): first derivatives of the bands as images, mirrored at the border."""
    taps = {(dy, dx): [0.0, 0.0] for dy in (-1, 0, 1) for dx in (-1, 0, 1) if dy or dx}
    for k, mask in enumerate((SOBEL_X, SOBEL_Y)):
        for dy, dx, w in mask:
            taps[dy, dx][k] = w
    kernel = F.array(*(F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx"), F.lit(a).alias("a"), F.lit(b).alias("b")) for (dy, dx), (a, b) in taps.items()))
    size = cube.pixels.agg(F.max("y").alias("my"), F.max("x").alias("mx"))
    at = cube.pixels.select("vec_id", "y", "x", F.explode(kernel).alias("k")).join(F.broadcast(size), F.lit(True))
    at = at.select("vec_id", "k.a", "k.b", reflect(F.col("y") + F.col("k.dy"), F.col("my")).alias("y"), reflect(F.col("x") + F.col("k.dx"), F.col("mx")).alias("x"))
    values = cube.pixels.select("y", "x", *(F.get("s", F.lit(i)).alias(f"v{i}") for i in bands))
    sums = [F.array(*(F.sum(F.col(w) * F.col(f"v{i}")) for i in bands)).alias(name) for w, name in (("a", "gx"), ("b", "gy"))]
    return at.join(values, ["y", "x"]).groupBy("vec_id").agg(*sums)


def gradient_difference(cube: Cube, a: int, b: int, bins: int = 150) -> DataFrame:
    """(scale, distance) of two bands as images: the scale of the second one's gradients, in steps of 0.2 up to 2, that
    leaves the differences with the least entropy; then each difference counts sd / (sd + difference squared).

    Without any spread a zero difference counts 1 and any other 0.
    """
    steps, x = [], 0.0
    while x < 2.0:  # the sums of 0.2, the last of which stays below 2
        steps.append(x)
        x += 0.2
    dx, dy = (F.abs(F.get(g, F.lit(0)) - F.col("step") * F.get(g, F.lit(1))) for g in ("gx", "gy"))
    d = sobel(cube, (a, b)).withColumn("step", F.explode(F.array(*map(F.lit, steps)))).select("step", dx.alias("dx"), dy.alias("dy"))
    d = d.withColumn("d", F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")))
    stats = d.groupBy("step").agg(F.count("*").alias("n"), F.min("d").alias("lo"), F.max("d").alias("hi"), F.stddev_pop("dx").alias("sx"), F.stddev_pop("dy").alias("sy"))
    place = F.floor((F.col("d") - F.col("lo")) * bins / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0)))
    hist = d.join(F.broadcast(stats), "step").filter(F.col("d") < F.col("hi")).groupBy("step", place.alias("bin")).agg(F.count("*").alias("k"), F.first("n").alias("n"))
    p = F.col("k") / F.col("n")
    entropies = stats.select("step", "sx", "sy").join(hist.groupBy("step").agg(F.round(F.sum(-p * F.log2(p)), 9).alias("e")), "step", "left")
    best = entropies.agg(F.min_by(F.struct("step", "sx", "sy"), F.struct(F.coalesce("e", F.lit(0.0)), "step")).alias("z")).select("z.*")

    def bell(v, sd):
        return F.when(F.col(sd) > 0, F.col(sd) / (F.col(sd) + F.col(v) * F.col(v))).when(F.col(v) == 0, 1.0).otherwise(0.0)

    return d.join(F.broadcast(best), "step").agg(F.first("step").alias("scale"), F.sum(bell("dx", "sx") + bell("dy", "sy")).alias("distance"))
