"""Self-organizing maps: training, map files, and edge detection in map space."""

from __future__ import annotations

import struct

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cubeflux.functions import distances as D
from cubeflux.functions.hashes import text_hash
from cubeflux.model import Cube
from cubeflux.shared import read_file, write_file

from . import neighbours

MAGIC = b"CUBEFLUX SOM MAP"
LAYOUTS = {"square": 2, "cube": 3, "tesseract": 4}


def grid(side: int, dims: int) -> np.ndarray:
    """Coordinates of the neurons, the first varying fastest."""
    i = np.arange(side**dims)
    return np.stack([i // side**d % side for d in range(dims)], 1)


def train(samples: np.ndarray, side: int = 32, dims: int = 2, steps: int = 40_000, sigma=(4.0, 1.0), rate=(0.75, 0.01), uniform: bool = False, seed: int = 42) -> np.ndarray:
    """Online training on a random sequence of sample rows; rate and radius decay geometrically."""
    rng = np.random.default_rng(seed)
    at = grid(side, dims)
    w = rng.uniform(samples.min(), samples.max(), (len(at), samples.shape[1]))
    order = rng.integers(0, len(samples), steps)
    for i, j in enumerate(order):
        t = i / steps
        s, r = sigma[0] * (sigma[1] / sigma[0]) ** t, rate[0] * (rate[1] / rate[0]) ** t
        x = samples[j]
        best = int(np.argmin(((w - x) ** 2).sum(axis=1)))
        if uniform:
            if dims < 4 and r < 0.01:
                continue
            reach = int(s ** (1, 1, 1, 2, 3)[dims])
            g = np.where(np.abs(at - at[best])[:, :2].sum(axis=1) <= reach, r, 0.0)
            if dims > 2:
                g *= (np.abs(at - at[best])[:, 2:] <= reach).all(axis=1)
        else:
            g = r * np.exp(-((at - at[best]) ** 2).sum(axis=1) / (2 * s * s))
            g[g < 0.01] = 0.0
        hit = np.flatnonzero(g)
        w[hit] += (x - w[hit]) * g[hit, None]
    return w


def fit(pixels: DataFrame, steps: int, seed: int = 42, **more) -> np.ndarray:
    """Train on at most ``steps`` pixels, chosen by a hash of their id: what reaches the driver is bounded by that."""
    rows = pixels.select("vec_id", "s").orderBy(F.xxhash64("vec_id", F.lit(seed))).limit(steps).toPandas()
    return train(np.array(rows.s.tolist(), float), steps=steps, seed=seed, **more)


def neurons(spark, w: np.ndarray) -> DataFrame:
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(w)], "idx int, w array<double>")


def packed(w: np.ndarray, layout: str, side: int) -> bytes:
    """Header (magic, version, type of numbers, layout, side, bands), then 32-bit floats, little endian."""
    return MAGIC + struct.pack("<5I", 3, 1, LAYOUTS[layout], side, w.shape[1]) + w.astype("<f4").tobytes()


def unpacked(data: bytes, bands: int | None = None) -> tuple[np.ndarray, str, int]:
    if data[:16] != MAGIC or len(data) < 36:
        raise ValueError("not a map file")
    version, kind, dims, side, n = struct.unpack("<5I", data[16:36])
    if version != 3 or kind != 1 or dims not in LAYOUTS.values():
        raise ValueError("unknown version, number type or layout")
    if bands is not None and n != bands:
        raise ValueError(f"the map has {n} bands, not {bands}")
    if len(data) - 36 != 4 * side**dims * n:
        raise ValueError("the map file is cut short")
    return np.frombuffer(data[36:], "<f4").reshape(-1, n).astype(float), next(k for k, v in LAYOUTS.items() if v == dims), side


def save(path: str, w: np.ndarray, layout: str, side: int) -> None:
    write_file(path, [packed(w, layout, side)])


def load(path: str, bands: int | None = None) -> tuple[np.ndarray, str, int]:
    return unpacked(read_file(path), bands)


def fingerprint(pixels: DataFrame) -> str:
    """What a map was trained on: the number of pixels, and a sum over hashes of their ids and spectra, in any order."""
    r = pixels.agg(F.count("*").alias("n"), F.sum(F.xxhash64("vec_id", "s").cast("decimal(38,0)")).alias("h")).first()
    return f"{r.n}/{r.h or 0}"


def create_or_load(pixels: DataFrame, folder: str, layout: str = "square", side: int = 32, steps: int = 40_000, **options) -> tuple[np.ndarray, bool]:
    """(neurons, trained): the map of these pixels and options from the folder, or trained and stored there. The file is
    named by the hash of the options and the pixels' fingerprint, so another input or setting is another map. A file that
    can't be read is trained anew. What is stored has 32-bit floats, and so has what is returned."""
    settings = "\n".join(f"{k} = {v}" for k, v in sorted({"layout": layout, "side": side, "steps": steps, **options}.items()))
    path = f"{folder}/{text_hash(settings):016x}-{text_hash(fingerprint(pixels), 'sdbm'):016x}.map"
    try:
        return unpacked(read_file(path))[0], False
    except (FileNotFoundError, ValueError):
        w = fit(pixels, steps, side=side, dims=LAYOUTS[layout], **options)
        write_file(path, [packed(w, layout, side)])
        return unpacked(read_file(path))[0], True


def as_cube(spark, w: np.ndarray, side: int, dims: int, lo: float, hi: float) -> Cube:
    """A map as an image: two coordinates are the pixel's, each further one stands below or beside, so that 4 dimensions are
    a square of squares."""
    at = grid(side, dims)
    x = at[:, 0] + (at[:, 2] * side if dims > 2 else 0)
    y = at[:, 1] + (at[:, 3] * side if dims > 3 else 0)
    width = side * (side if dims > 2 else 1)
    rows = [(int(b * width + a), int(b), int(a), 0, v.tolist()) for a, b, v in zip(x, y, w, strict=True)]
    return Cube(spark.createDataFrame(rows, "vec_id long, y int, x int, label int, s array<double>"), width, w.shape[1], lo, hi)


def edge_detection(cells: DataFrame, absolute: bool = False, sobel: bool = False) -> DataFrame:
    """(vec_id, dx, dy) of interior pixels from map coordinates (vec_id, y, x, c).

    sobel: the kernel a + 2b + c; the default weighs the middle and the far corner negatively.
    """
    e = neighbours.edges(cells.withColumnRenamed("c", "s"), tuple((dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if dy or dx))
    # each neighbour knows its direction from the coordinates of both ends
    at = cells.select(F.col("vec_id").alias("u"), F.col("y").alias("uy"), F.col("x").alias("ux"))
    to = cells.select(F.col("vec_id").alias("v"), F.col("y").alias("vy"), F.col("x").alias("vx"))
    d = e.select("u", "v", "sv").join(at, "u").join(to, "v").withColumn("k", (F.col("vy") - F.col("uy")) * 3 + F.col("vx") - F.col("ux"))
    wide = d.groupBy("u").agg(F.count("*").alias("n"), *(F.first(F.when(F.col("k") == k, F.col("sv")), ignorenulls=True).alias(n) for n, k in (("nw", -4), ("n_", -3), ("ne", -2), ("w", -1), ("e", 1), ("sw", 2), ("s_", 3), ("se", 4)))).filter("n = 8")
    sign = 1.0 if sobel else -1.0

    def side(a: str, b: str, c: str):
        part = F.zip_with(F.col(a), F.col(b), lambda p, q: p + sign * 2 * q)
        return F.zip_with(part, F.col(c), lambda p, q: 0.25 * (p + sign * q))

    sides = {"west": side("nw", "w", "sw"), "east": side("ne", "e", "se"), "north": side("nw", "n_", "ne"), "south": side("sw", "s_", "se")}
    g = wide.select(F.col("u").alias("vec_id"), *(v.alias(k) for k, v in sides.items()))

    def signed(a: str, b: str):
        size = D.euclidean(F.col(a), F.col(b))
        na, nb = (F.sqrt(D.dot(F.col(x), F.col(x))) for x in (a, b))
        return size if absolute else F.when(nb > na + 1e-9, -size).otherwise(size)

    return g.select("vec_id", signed("west", "east").alias("dx"), signed("north", "south").alias("dy"))
