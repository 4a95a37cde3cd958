"""Sources and sinks of cubes and labels.

Image files are decoded where they are read (``binaryFile`` and an Arrow kernel); parquet is the storage format.
"""

from __future__ import annotations

import configparser
import os
import re
import struct
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cubeflux.model import Cube, band_table
from cubeflux.operators.select import Rect, crop, scope
from cubeflux.shared import is_folder, read_file
from cubeflux.sources.imagery import LAN_MAGIC, SIGNATURE, decode_png, read_raw, write_bands

PIXELS = "vec_id long, y int, x int, label int, s array<double>"


@dataclass(frozen=True)
class Band:
    file: str
    start: float = 0.0
    end: float = 0.0

    @property
    def empty(self) -> bool:
        return not self.start

    @property
    def center(self) -> float:
        return (self.start + self.end) / 2


def parse_file_list(text: str, folder: str) -> list[Band]:
    """Count, base directory, then 'file [start [end]]' per line; a relative base is relative to the list's folder."""
    lines = [x.strip() for x in text.splitlines() if x.strip()]
    n, base = int(lines[0]), lines[1]
    base = base if os.path.isabs(base) else os.path.join(folder, base)
    out = []
    for line in lines[2 : 2 + n]:
        name, *nm = line.split()
        start = float(nm[0]) if nm else 0.0
        out.append(Band(os.path.join(base, name), start, float(nm[1]) if len(nm) > 1 else start))
    if len(out) != n:
        raise ValueError(f"{n} files announced, {len(out)} listed")
    return out


def from_depth(value: Column, bits: int, lo: float, hi: float) -> Column:
    """Samples of 8 or 16 bits (or floats in 0..1) to the declared range."""
    top = {8: 255.0, 16: 65535.0, 32: 1.0}[bits]
    return value / top * (hi - lo) + lo


def raster_semantics(cube: Cube, roi: Rect, low: int, factor: float) -> Cube:
    """What a raster reader does on the way in: crop, scale, negatives to 0; column top is the declared maximum, the
    next power of two from 256 on above the observed one."""
    c = crop(scope(cube, roi), low, 0)
    px = c.pixels.withColumn("s", F.transform("s", lambda v: F.greatest(v * factor, F.lit(0.0))))
    top = px.agg(F.max(F.array_max("s")).alias("m")).select(F.greatest(F.lit(256.0), F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest("m", F.lit(1.0)))))).alias("top"))
    return Cube(px.join(F.broadcast(top), F.lit(True)), roi.w, c.n_bands, 0.0, 256.0)


def empty_cube(spark: SparkSession, height: int, width: int, bands: int) -> Cube:
    i = F.col("id")
    px = spark.range(height * width).select(i.alias("vec_id"), F.floor(i / width).cast("int").alias("y"), (i % width).cast("int").alias("x"), F.lit(0).alias("label"), F.array_repeat(F.lit(0.0), bands).alias("s"))
    return Cube(px, width, bands, 0.0, 255.0)


def from_array(spark: SparkSession, a: np.ndarray, lo: float = 0.0, hi: float = 255.0) -> Cube:
    """A cube from a (height, width, bands) array."""
    h, w, n = a.shape
    pdf = pd.DataFrame({"vec_id": np.arange(h * w), "y": np.repeat(np.arange(h), w).astype(np.int32), "x": np.tile(np.arange(w), h).astype(np.int32), "label": np.zeros(h * w, np.int32), "s": a.reshape(-1, n).astype(float).tolist()})
    return Cube(spark.createDataFrame(pdf, PIXELS), w, n, lo, hi)


def decode_pgm(data: bytes) -> np.ndarray:
    """A binary grey image (P5) of 8 or 16 bits."""
    fields, at = [], 0
    while len(fields) < 4:
        while data[at : at + 1].isspace():
            at += 1
        if data[at : at + 1] == b"#":
            at = data.index(b"\n", at) + 1
            continue
        end = at
        while not data[end : end + 1].isspace():
            end += 1
        fields.append(data[at:end])
        at = end
    if fields[0] != b"P5":
        raise ValueError("not a binary grey image")
    w, h, top = map(int, fields[1:])
    return np.frombuffer(data, ">u2" if top > 255 else np.uint8, w * h, at + 1).reshape(h, w)


def encode_pgm(a: np.ndarray, bits: int = 8) -> bytes:
    top = 255 if bits == 8 else 65535
    return f"P5\n{a.shape[1]} {a.shape[0]}\n{top}\n".encode() + a.astype(np.uint8 if bits == 8 else ">u2").tobytes()


def decode_grey(data: bytes) -> np.ndarray:
    """The first channel of a grey image file, PGM or PNG."""
    return decode_pgm(data) if data[:2] == b"P5" else decode_png(data)[:, :, 0]


def plain_path(path: Column | str) -> Column | str:
    """A path as Spark names it, or as a user does, without the scheme of local files."""
    if isinstance(path, str):
        return os.path.abspath(re.sub("^file:/+", "/", path)) if path.startswith("file:") or "://" not in path else path
    return F.regexp_replace(path, "^file:/+", "/")


def read_bands(spark: SparkSession, bands: list[Band], lo: float = 0.0, hi: float = 255.0) -> tuple[Cube, DataFrame]:
    """One image file per band, decoded where it is read. Files of another size than the first are skipped; a file may be
    several bands."""
    order = spark.createDataFrame([(i, plain_path(b.file)) for i, b in enumerate(bands)], "band int, name string")
    files = spark.read.format("binaryFile").load(sorted({b.file for b in bands})).select(plain_path(F.col("path")).alias("name"), "content")

    def decode(batches):
        for pdf in batches:
            for band, content in zip(pdf["band"], pdf["content"], strict=True):
                a = decode_grey(content)
                v = a.astype(float) / (255.0 if a.dtype == np.uint8 else 65535.0) * (hi - lo) + lo
                h, w = a.shape
                yield pd.DataFrame({"band": np.int32(band), "h": np.int32(h), "w": np.int32(w), "vec_id": np.arange(h * w), "value": v.ravel()})

    samples = files.join(order, "name").select("band", "content").mapInPandas(decode, "band int, h int, w int, vec_id long, value double")
    size = samples.groupBy("band").agg(F.first("h").alias("h"), F.first("w").alias("w")).orderBy("band").collect()  # one row per band
    h, w = size[0].h, size[0].w
    good = [r.band for r in size if (r.h, r.w) == (h, w)]
    from cubeflux.operators.select import from_samples

    px = from_samples(samples.filter(F.col("band").isin(good))).select("vec_id", F.floor(F.col("vec_id") / w).cast("int").alias("y"), (F.col("vec_id") % w).cast("int").alias("x"), F.lit(0).alias("label"), "s")
    meta = spark.createDataFrame([(i, float(bands[b].center), float(bands[b].start), float(bands[b].end), bands[b].empty) for i, b in enumerate(good)], "band int, center double, range_start double, range_end double, empty boolean")
    return Cube(px, w, len(good), lo, hi), meta


#: Wavelengths of blue, green and red, fixed values, of a colour image that says nothing else.
COLOUR_CENTRES = (460.0, 540.0, 620.0)


def read_colour(spark: SparkSession, path: str, lo: float = 0.0, hi: float = 255.0) -> tuple[Cube, DataFrame]:
    """A colour image as three bands, blue, green and red; alpha is dropped."""

    def decode(batches):
        for pdf in batches:
            for content in pdf["content"]:
                a = decode_png(content)
                h, w, _ = a.shape
                v = a[:, :, 2::-1].reshape(-1, 3).astype(float) / (255.0 if a.dtype == np.uint8 else 65535.0) * (hi - lo) + lo
                for r in range(0, h * w, 65536):
                    i = np.arange(r, min(h * w, r + 65536))
                    yield pd.DataFrame({"vec_id": i, "y": (i // w).astype(np.int32), "x": (i % w).astype(np.int32), "label": np.int32(0), "s": list(v[i])})

    px = spark.read.format("binaryFile").load(path).select("content").mapInPandas(decode, PIXELS)
    width = px.agg(F.max("x")).first()[0] + 1
    meta = spark.createDataFrame([(i, c, c, c, False) for i, c in enumerate(COLOUR_CENTRES)], "band int, center double, range_start double, range_end double, empty boolean")
    return Cube(px, width, 3, lo, hi), meta


def decode_lan(data: bytes) -> np.ndarray:
    """Line-interleaved raw file: magic, depth 0 (8 bits) or 2 (16 bits), bands, columns and rows at byte 16, samples at 128."""
    if data[:6] not in LAN_MAGIC:
        raise ValueError("not a raw line-interleaved file")
    depth, bands = struct.unpack("<HH", data[6:10])
    cols, rows = struct.unpack("<II", data[16:24])
    if depth not in (0, 2):
        raise ValueError(f"unknown depth {depth}")
    a = np.frombuffer(data, np.uint8 if depth == 0 else "<u2", rows * bands * cols, 128)
    return a.reshape(rows, bands, cols).transpose(0, 2, 1)


def encode_lan(a: np.ndarray, bits: int = 8) -> bytes:
    rows, cols, bands = a.shape
    head = LAN_MAGIC[0] + struct.pack("<HH", 0 if bits == 8 else 2, bands) + bytes(6) + struct.pack("<II", cols, rows)
    return head.ljust(128, b"\0") + np.ascontiguousarray(a.transpose(0, 2, 1)).astype(np.uint8 if bits == 8 else "<u2").tobytes()


def read_image(spark: SparkSession, path: str) -> Cube:
    """By content: parquet folder, raw file, band list, single grey or colour image."""
    if is_folder(path):
        px = spark.read.parquet(path)
        shape = px.agg(F.max("x").alias("x"), F.first(F.size("s")).alias("n")).first()
        return Cube(px, shape.x + 1, shape.n, 0.0, 255.0)
    head = read_file(path, 0, 26)
    if head[:6] in LAN_MAGIC:
        return read_raw(spark, path)
    if head[:8] == SIGNATURE:
        return read_colour(spark, path)[0] if head[25] in (2, 6) else read_bands(spark, [Band(path)])[0]
    if head[:2] == b"P5":
        return read_bands(spark, [Band(path)])[0]
    return read_bands(spark, parse_file_list(read_file(path).decode(), os.path.dirname(path)))[0]


def write_cube(cube: Cube, path: str) -> None:
    cube.pixels.write.parquet(path)


def read_points_ppm(spark: SparkSession, path: str) -> DataFrame:
    """Points (vec_id, s) of an ASCII colour image (P3)."""
    words = F.filter(F.split(F.regexp_replace("value", "#[^\n]*", " "), r"\s+"), lambda w: w != "")
    t = spark.read.text(path, wholetext=True).select(words.alias("w")).filter(F.get("w", F.lit(0)) == "P3")
    n = F.get("w", F.lit(1)).cast("int") * F.get("w", F.lit(2)).cast("int")
    point = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.transform(F.slice("w", i * 3 + 5, 3), lambda v: v.cast("double")))
    return t.select(F.posexplode(point).alias("p", "s")).select(F.col("p").cast("long").alias("vec_id"), "s")


def write_modes(modes: np.ndarray, path: str) -> None:
    """A mode per line, values separated by blanks."""
    with open(path, "w", encoding="utf-8") as f:
        f.writelines(" ".join(f"{v:g}" for v in m) + "\n" for m in modes)


def read_options(text: str, section: str, defaults: dict) -> dict:
    """Options of an INI section over typed defaults; unknown names are errors."""
    cfg = configparser.ConfigParser()
    cfg.optionxform = str
    cfg.read_string(text)
    out = dict(defaults)
    for k, v in cfg.items(section) if cfg.has_section(section) else []:
        if k not in defaults:
            raise ValueError(f"unknown option {k}")
        d = defaults[k]
        out[k] = cfg.getboolean(section, k) if isinstance(d, bool) else type(d)(v)
    return out


def write_options(section: str, options: dict) -> str:
    return f"[{section}]\n" + "".join(f"{k} = {v}\n" for k, v in options.items())


def label_colours(n: int) -> list[tuple[int, int, int]]:
    """Colours (b, g, r) of labels: white background, six fixed ones, then evenly spaced hues without yellow."""
    import colorsys

    fixed = [(255, 255, 255), (0, 255, 0), (0, 0, 255), (255, 255, 0), (255, 0, 255), (255, 0, 0), (0, 165, 255)]
    rest = []
    for i in range(max(0, n - len(fixed))):
        hue = (i + 0.5) / (n - len(fixed)) * 300 / 360
        hue += 60 / 360 if hue > 30 / 360 else 0
        r, g, b = colorsys.hsv_to_rgb(hue % 1.0, 1.0, 0.9)
        rest.append((int(b * 255), int(g * 255), int(r * 255)))
    return (fixed + rest)[:n]


__all__ = [n for n in dir() if not n.startswith("_")] + ["band_table"]
