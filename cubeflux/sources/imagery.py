"""Images written and read by tasks: grey and colour PNG, raw line-interleaved files, bands as partitions.

A task writes strips of rows. Strips of a PNG are compressed on their own, each up to a byte boundary, so the commit step of
an image, a task of its own, only puts them one after the other and works out the common checksum from theirs; a raw file's
strips are put together as they are. No image is on the driver, and no task holds more than a strip.

Raw files are a Spark data source of row ranges: with bands named, a range reads the lines of those bands only.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from cubeflux.model import Cube
from cubeflux.shared import located, read_file, shared_folder, write_file

#: Samples of a strip, and bytes of a range of rows.
STRIP, RANGE = 1 << 20, 32 << 20
SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: PNG colour types by samples a pixel.
COLOURS = {1: 0, 3: 2}
LAN_HEAD, LAN_MAGIC = 128, (b"HEAD74", b"HEADER")
ADLER = 65521


def adler_of(first: int, second: int, length: int) -> int:
    """The checksum of two strips one after the other, from theirs and the length of the second."""
    a1, b1, a2, b2 = first & 0xFFFF, first >> 16, second & 0xFFFF, second >> 16
    a = (a1 + a2 - 1) % ADLER
    b = (b1 + b2 + length * (a1 - 1)) % ADLER
    return b << 16 | a


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def _deflated(raw: bytes) -> bytes:
    """Blocks that end on a byte boundary and leave the stream open."""
    z = zlib.compressobj(6, zlib.DEFLATED, -15)
    return z.compress(raw) + z.flush(zlib.Z_FULL_FLUSH)


def _png_rows(a: np.ndarray, bits: int) -> bytes:
    """Rows of samples (height, width, channels), each with filter 0 before it."""
    rows = a.reshape(len(a), -1).astype(">u2" if bits == 16 else np.uint8)
    return b"".join(b"\0" + r.tobytes() for r in rows)


def decode_png(data: bytes) -> np.ndarray:
    """(height, width, channels) of a PNG of 8 or 16 bits, grey, grey with alpha, colour or colour with alpha, not interlaced."""
    if data[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at, body, head = 8, [], None
    while at < len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", data[at + 8 : at + 21])
        elif kind == b"IDAT":
            body.append(data[at + 8 : at + 8 + n])
        at += 12 + n
    if head is None:
        raise ValueError("a PNG without a header")
    w, h, bits, colour, _, _, laced = head
    channels = {0: 1, 2: 3, 4: 2, 6: 4}.get(colour)
    if channels is None or bits not in (8, 16) or laced:
        raise ValueError("a kind of PNG that isn't read")
    step = channels * bits // 8
    rows = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(h, 1 + w * step)
    out, above = np.empty((h, w * step), np.uint8), np.zeros(w * step, np.uint8)
    for y, row in enumerate(rows):
        above = out[y] = _unfiltered(int(row[0]), row[1:], above, step)
    return out.reshape(h, -1).view(np.uint8 if bits == 8 else ">u2").reshape(h, w, channels)


def _unfiltered(kind: int, row: np.ndarray, above: np.ndarray, step: int) -> np.ndarray:
    """A row's bytes, of which the filter kept differences: to the left, above, to the mean of both or to their best guess."""
    if kind == 0:
        return row
    if kind == 1:
        return np.cumsum(row.reshape(-1, step), axis=0, dtype=np.uint8).ravel()
    if kind == 2:
        return row + above
    r, up, out = row.tolist(), above.tolist(), [0] * len(row)
    for i, v in enumerate(r):
        left, corner = (out[i - step], up[i - step]) if i >= step else (0, 0)
        if kind == 3:
            guess = (left + up[i]) // 2
        elif kind == 4:
            guess = min((left, up[i], corner), key=lambda c: abs(left + up[i] - corner - c))
        else:
            raise ValueError(f"unknown filter {kind}")
        out[i] = (v + guess) & 255
    return np.array(out, np.uint8)


STRIPS = "image string, strip long, height long, file string, size long, adler long"


def _strips(pixels: DataFrame, width: int, height: int, channels: int, lines: int, folder: str, encode) -> DataFrame:
    """Write strips of some lines; pixels: image, y, x, v (samples). Pixels that are missing are 0."""

    def run(key, table):
        import pyarrow as pa

        image, strip = key[0].as_py(), key[1].as_py()
        a = np.zeros((min(lines, height - strip * lines), width, channels), np.int64)
        v = table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(table.num_rows, channels)
        a[table.column("y").to_numpy() - strip * lines, table.column("x").to_numpy()] = v
        data, adler, raw = encode(a)
        path = f"{folder}/strips/{image}/{strip}"
        size = write_file(path, [data])
        return pa.table({"image": [image], "strip": pa.array([strip], pa.int64()), "height": pa.array([raw], pa.int64()), "file": [path], "size": pa.array([size], pa.int64()), "adler": pa.array([adler], pa.int64())})

    rows = pixels.select("image", "y", "x", F.col("v").cast("array<long>").alias("v"), F.expr(f"y div {lines}").alias("strip"))
    return rows.groupBy("image", "strip").applyInArrow(run, STRIPS)


def _lines(width: int, channels: int) -> int:
    return max(1, STRIP // max(1, width * channels))


def write_png(pixels: DataFrame, width: int, height: int, folder: str, bits: int = 8, channels: int = 1) -> DataFrame:
    """Write an image folder/<image>.png for each name in pixels (image, y, x, v: its samples); a row (image, file, size) for
    each. Every strip of a height must have pixels."""

    def encode(a):
        raw = _png_rows(a, bits)
        return _deflated(raw), zlib.adler32(raw), len(raw)

    head = _chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, bits, COLOURS[channels], 0, 0, 0))

    def commit(key, strips):
        import pyarrow as pa

        path, t = f"{folder}/{key[0].as_py()}.png", strips.sort_by("strip").to_pydict()

        def pieces():
            adler = 1
            yield SIGNATURE + head + _chunk(b"IDAT", b"\x78\x9c")
            for file, own, n in zip(t["file"], t["adler"], t["height"], strict=True):
                adler = adler_of(adler, own, n)
                yield _chunk(b"IDAT", read_file(file))
            yield _chunk(b"IDAT", b"\x03\x00" + struct.pack(">I", adler)) + _chunk(b"IEND", b"")

        return pa.table({"image": [key[0].as_py()], "file": [path], "size": pa.array([write_file(path, pieces())], pa.int64())})

    strips = _strips(pixels, width, height, channels, _lines(width, channels), folder, encode)
    return _kept(strips, folder).groupBy("image").applyInArrow(commit, "image string, file string, size long")


def _kept(strips: DataFrame, folder: str) -> DataFrame:
    """The rows of strips, once they are written."""
    path = f"{folder}/strips-written"
    strips.write.mode("overwrite").parquet(path)
    return strips.sparkSession.read.schema(strips.schema).parquet(path)


def _shape(pixels: DataFrame) -> tuple[int, int]:
    r = pixels.agg(F.max("y").alias("y"), F.max("x").alias("x")).first()
    return (r.x or 0) + 1, (r.y or 0) + 1


def write_bands(cube: Cube, bands: list, folder: str, bits: int = 8, normalise: bool = False) -> str:
    """A grey PNG for each band and the list of them, whose path is returned; bands: file, start, end, empty."""
    lo, hi = cube.lo, cube.hi
    if normalise:
        r = cube.pixels.agg(F.min(F.array_min("s")).alias("lo"), F.max(F.array_max("s")).alias("hi")).first()
        lo, hi = r.lo, r.hi
    top = 255 if bits == 8 else 65535
    width, height = _shape(cube.pixels)
    level = F.least(F.greatest(F.round((F.col("value") - lo) / ((hi - lo) or 1.0) * top), F.lit(0)), F.lit(top))
    samples = cube.pixels.select("y", "x", F.posexplode("s").alias("band", "value"))
    write_png(samples.select(F.format_string("band%03d", "band").alias("image"), "y", "x", F.array(level).alias("v")), width, height, folder, bits).write.mode("overwrite").parquet(f"{folder}/written")
    lines = [str(cube.n_bands), "."]
    for b in range(cube.n_bands):
        d = bands[b] if b < len(bands) else None
        lines.append(f"band{b:03d}.png" + ("" if d is None or d.empty else f" {d.start:g} {d.end:g}"))
    path = f"{folder}/bands.txt"
    write_file(path, ["\n".join(lines).encode() + b"\n"])
    return path


def write_labels(labels: DataFrame, palette: list[tuple[int, int, int]], folder: str, name: str = "labels") -> None:
    """A colour image of labels (y, x, label); palette: (b, g, r) by label."""
    table = F.array(*(F.array(*map(F.lit, (r, g, b))) for b, g, r in palette))
    write_colours(labels.select("y", "x", F.get(table, F.col("label").cast("int")).alias("v")), folder, name)


def write_colours(pixels: DataFrame, folder: str, name: str = "rgb") -> None:
    """A colour image of pixels (y, x, v: red, green, blue in 0..255)."""
    width, height = _shape(pixels)
    write_png(pixels.select(F.lit(name).alias("image"), "y", "x", "v"), width, height, folder, 8, 3).write.mode("overwrite").parquet(f"{folder}/written-{name}")


def write_grey(pixels: DataFrame, folder: str, name: str, lo: float, hi: float, bits: int = 8) -> None:
    """A grey image of pixels (y, x, value): gradients, probabilities, masks."""
    top = 255 if bits == 8 else 65535
    level = F.least(F.greatest(F.round((F.col("value") - lo) / ((hi - lo) or 1.0) * top), F.lit(0)), F.lit(top))
    width, height = _shape(pixels)
    write_png(pixels.select(F.lit(name).alias("image"), "y", "x", F.array(level).alias("v")), width, height, folder, bits).write.mode("overwrite").parquet(f"{folder}/written-{name}")


def mode_cube(labels: DataFrame, modes: np.ndarray, width: int, lo: float, hi: float) -> Cube:
    """Each pixel with the spectrum of its label's mode, in the cube's own range: labels (vec_id, y, x, label from 1), modes
    quantised to 16 bits."""
    table = F.array(*(F.array(*(F.lit(float(v) / 65535 * (hi - lo) + lo) for v in m)) for m in modes))
    px = labels.select("vec_id", "y", "x", F.col("label").cast("int").alias("label"), F.get(table, F.col("label").cast("int") - 1).alias("s"))
    return Cube(px, width, len(modes[0]) if len(modes) else 0, lo, hi)


def export(spark: SparkSession, source: str, folder: str, bits: int = 8, normalise: bool = False) -> str:
    """Any image that is read, written as a band list and an image for each band."""
    from cubeflux.sources.images import read_image

    return write_bands(read_image(spark, source), [], folder, bits, normalise)


# raw files


def write_raw(cube: Cube, path: str, bits: int = 8) -> int:
    """A raw line-interleaved file of a cube, put together by one task from strips; returns its size."""
    top, n = (255, cube.n_bands) if bits == 8 else (65535, cube.n_bands)
    width, height = _shape(cube.pixels)

    def encode(a):
        data = np.ascontiguousarray(a.transpose(0, 2, 1)).astype(np.uint8 if bits == 8 else "<u2").tobytes()
        return data, 0, len(data)

    head = LAN_MAGIC[0] + struct.pack("<HH", 0 if bits == 8 else 2, n) + bytes(6) + struct.pack("<II", width, height)

    def commit(key, strips):
        import pyarrow as pa

        def pieces():
            yield head.ljust(LAN_HEAD, b"\0")
            for file in strips.sort_by("strip").column("file").to_pylist():
                yield read_file(file)

        return pa.table({"size": pa.array([write_file(path, pieces())], pa.int64())})

    folder = shared_folder(cube.pixels.sparkSession, "raw")
    level = F.transform("s", lambda v: F.least(F.greatest(F.round((v - cube.lo) / ((cube.hi - cube.lo) or 1.0) * top), F.lit(0)), F.lit(top)))
    strips = _strips(cube.pixels.select(F.lit("raw").alias("image"), "y", "x", level.alias("v")), width, height, n, _lines(width, n), folder, encode)
    return _kept(strips, folder).groupBy("image").applyInArrow(commit, "size long").first()[0]


def raw_head(path: str) -> tuple[int, int, int, int]:
    """Bytes of a sample, bands, columns and rows."""
    data = read_file(path, 0, LAN_HEAD)
    if data[:6] not in LAN_MAGIC:
        raise ValueError("not a raw line-interleaved file")
    depth, bands = struct.unpack("<HH", data[6:10])
    cols, rows = struct.unpack("<II", data[16:24])
    if depth not in (0, 2):
        raise ValueError(f"unknown depth {depth}")
    return 1 if depth == 0 else 2, bands, cols, rows


class Lines(InputPartition):
    def __init__(self, start: int, end: int):
        self.start, self.end = start, end


class RawSource(DataSource):
    """spark.read.format("rawlines").option("path", ...).option("bands", "0,5"): vec_id, y, x, label, s of a raw file; s has the
    bands named, in that order, or all."""

    @classmethod
    def name(cls) -> str:
        return "rawlines"

    def schema(self) -> str:
        return "vec_id long, y int, x int, label int, s array<double>"

    def reader(self, schema) -> DataSourceReader:
        return RawReader(self.options)


class RawReader(DataSourceReader):
    def __init__(self, options):
        self.path, named = options["path"], options.get("bands", "")
        self.unit, self.n, self.cols, self.rows = raw_head(self.path)
        self.bands = [int(b) for b in named.split(",")] if named else list(range(self.n))
        self.most = int(options.get("rangebytes", RANGE))
        if any(not 0 <= b < self.n for b in self.bands):
            raise ValueError(f"bands are 0..{self.n - 1}")

    def partitions(self):
        lines = max(1, self.most // max(1, self.cols * self.unit * len(self.bands)))
        return [Lines(y, min(self.rows, y + lines)) for y in range(0, self.rows, lines)] or [Lines(0, 0)]

    def read(self, partition):
        import pyarrow as pa

        line = self.cols * self.unit
        kind = np.uint8 if self.unit == 1 else "<u2"
        files, place = located(self.path)
        with files.open_input_file(place) as f:
            for y in range(partition.start, partition.end):
                begin = LAN_HEAD + y * self.n * line
                if len(self.bands) == self.n:
                    f.seek(begin)
                    a = np.frombuffer(f.read(self.n * line), kind).reshape(self.n, self.cols)[self.bands]
                else:
                    a = np.empty((len(self.bands), self.cols), kind)
                    for k, b in enumerate(self.bands):
                        f.seek(begin + b * line)
                        a[k] = np.frombuffer(f.read(line), kind)
                v = np.ascontiguousarray(a.T).astype(float) / (255.0 if self.unit == 1 else 65535.0) * 255.0
                x = np.arange(self.cols)
                s = pa.ListArray.from_arrays(pa.array(np.arange(0, v.size + 1, len(self.bands), dtype=np.int32)), pa.array(v.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(y * self.cols + x), pa.array(np.full(self.cols, y, np.int32)), pa.array(x.astype(np.int32)), pa.array(np.zeros(self.cols, np.int32)), s], ["vec_id", "y", "x", "label", "s"])


def read_raw(spark: SparkSession, path: str, bands: list[int] | None = None, range_bytes: int = RANGE) -> Cube:
    """A cube of a raw file, or of some of its bands; ranges of rows are read side by side."""
    spark.dataSource.register(RawSource)
    _, n, cols, _ = raw_head(path)
    reader = spark.read.format("rawlines").option("path", path).option("rangebytes", str(range_bytes))
    if bands is not None:
        reader = reader.option("bands", ",".join(map(str, bands)))
    return Cube(reader.load(), cols, n if bands is None else len(bands), 0.0, 255.0)


# bands as partitions


def write_by_band(cube: Cube, path: str) -> None:
    """A cube as a table with a partition for each band, in rows of the image within it, so a band is read without the others."""
    samples = cube.pixels.select("vec_id", "y", "x", "label", F.posexplode("s").alias("band", "value"))
    parts = int(cube.pixels.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    samples.repartitionByRange(parts, "band", "vec_id").sortWithinPartitions("band", "vec_id").write.partitionBy("band").parquet(path)


def lazy_bands(spark: SparkSession, path: str) -> DataFrame:
    """vec_id, y, x, label, value, band; a filter on band reads its partitions only."""
    return spark.read.schema("vec_id long, y int, x int, label int, value double, band int").parquet(path)


def lazy_band(spark: SparkSession, path: str, band: int) -> DataFrame:
    return lazy_bands(spark, path).filter(F.col("band") == band).drop("band")
