"""Image files written by tasks and read again."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cubeflux.model import Cube
from cubeflux.sources import imagery, images


def values(cube):
    return np.array([r.s for r in cube.pixels.orderBy("vec_id").collect()])


@pytest.fixture
def small_strips(monkeypatch):
    monkeypatch.setattr(imagery, "STRIP", 40)


@pytest.mark.parametrize("bits", [8, 16])
def test_bands_in_strips_round_trip(spark, tmp_path, small_strips, bits):
    top = 255 if bits == 8 else 65535
    a = np.random.default_rng(0).integers(0, top + 1, (9, 7, 3)) / top * 255
    path = images.write_bands(images.from_array(spark, a), [images.Band("", 400, 410), images.Band("", 500, 510)], str(tmp_path / "out"), bits)
    cube, meta = images.read_bands(spark, images.parse_file_list(open(path).read(), str(tmp_path / "out")))
    assert np.abs(values(cube).reshape(9, 7, 3) - a).max() < 1e-9 and cube.width == 7
    assert [(r.center, r.empty) for r in meta.orderBy("band").collect()] == [(405, False), (505, False), (0, True)]
    data = (tmp_path / "out" / "band000.png").read_bytes()
    assert data.count(b"IDAT") > 3  # several strips in one stream that any reader takes
    kinds = [data[i + 4 : i + 8] for i in _chunks(data)]
    assert kinds[0] == b"IHDR" and kinds[-1] == b"IEND"


def _chunks(data):
    at = 8
    while at < len(data):
        n = struct.unpack(">I", data[at : at + 4])[0]
        assert zlib.crc32(data[at + 4 : at + 8 + n]) == struct.unpack(">I", data[at + 8 + n : at + 12 + n])[0]
        yield at
        at += 12 + n


def test_checksums_of_parts():
    a, b, c = b"first strip", bytes(70000), b"x"
    whole = imagery.adler_of(imagery.adler_of(imagery.adler_of(1, zlib.adler32(a), len(a)), zlib.adler32(b), len(b)), zlib.adler32(c), len(c))
    assert whole == zlib.adler32(a + b + c)


def test_every_filter_of_a_png():
    """Rows with each filter, made from their definition."""
    a = np.random.default_rng(1).integers(0, 256, (10, 6, 3), dtype=np.uint8)
    raw, above = b"", np.zeros(18, int)
    for y, row in enumerate(a.reshape(10, 18).astype(int)):
        left, corner = np.append([0] * 3, row[:-3]), np.append([0] * 3, above[:-3])
        guess = left + above - corner
        near = np.array([min((int(p), int(q), int(r)), key=lambda v, g=g: abs(g - v)) for p, q, r, g in zip(left, above, corner, guess, strict=True)])
        wanted = [np.zeros(18, int), left, above, (left + above) // 2, near][y % 5]
        raw += bytes([y % 5]) + ((row - wanted) % 256).astype(np.uint8).tobytes()
        above = row
    head = struct.pack(">IIBBBBB", 6, 10, 8, 2, 0, 0, 0)
    data = imagery.SIGNATURE + imagery._chunk(b"IHDR", head) + imagery._chunk(b"IDAT", zlib.compress(raw)) + imagery._chunk(b"IEND", b"")
    assert (imagery.decode_png(data) == a).all()
    with pytest.raises(ValueError):
        imagery.decode_png(b"GIF89a")


def test_label_and_grey_images(spark, tmp_path, small_strips):
    px = spark.range(30).select(F.expr("int(id div 6)").alias("y"), F.expr("int(id % 6)").alias("x"), F.expr("int(id % 3)").alias("label"), (F.col("id") / 29).alias("value"))
    palette = [(1, 2, 3), (40, 50, 60), (255, 0, 128)]
    imagery.write_labels(px, palette, str(tmp_path))
    c = images.read_image(spark, str(tmp_path / "labels.png"))
    assert np.round(values(c)).astype(int).tolist() == [list(palette[i % 3]) for i in range(30)]
    imagery.write_grey(px, str(tmp_path), "p", 0.0, 1.0, 16)
    assert np.abs(values(images.read_image(spark, str(tmp_path / "p.png"))).ravel() / 255 - np.arange(30) / 29).max() < 1e-5


@pytest.mark.parametrize("bits", [8, 16])
def test_raw_file_by_ranges_and_bands(spark, tmp_path, small_strips, bits):
    top = 255 if bits == 8 else 65535
    a = np.random.default_rng(2).integers(0, top + 1, (11, 5, 4)) / top * 255
    path = str(tmp_path / "x.raw")
    assert imagery.write_raw(images.from_array(spark, a), path, bits) == 128 + a.size * bits // 8
    assert np.abs(images.decode_lan(open(path, "rb").read()) / top * 255 - a).max() < 1e-9
    c = imagery.read_raw(spark, path, range_bytes=60)
    assert np.abs(values(c).reshape(a.shape) - a).max() < 1e-9 and c.pixels.rdd.getNumPartitions() >= 4
    some = imagery.read_raw(spark, path, [3, 1], range_bytes=20)
    assert np.abs(values(some).reshape(11, 5, 2) - a[:, :, [3, 1]]).max() < 1e-9 and some.n_bands == 2


def test_named_bands_read_only_their_lines(spark, tmp_path, monkeypatch):
    a = np.random.default_rng(3).integers(0, 256, (4, 100, 50))
    (tmp_path / "x.raw").write_bytes(images.encode_lan(a))
    reader, read = imagery.RawReader({"path": str(tmp_path / "x.raw"), "bands": "7,20"}), []

    class Counted:
        def __init__(self, f):
            self.f = f

        def __enter__(self):
            return self

        def __exit__(self, *_):
            self.f.close()

        def seek(self, at):
            self.f.seek(at)

        def read(self, n):
            read.append(n)
            return self.f.read(n)

    class Files:
        def open_input_file(self, place):
            return Counted(open(place, "rb"))

    monkeypatch.setattr(imagery, "located", lambda p: (Files(), p))
    for p in reader.partitions():
        list(reader.read(p))
    assert sum(read) == 4 * 100 * 2
    with pytest.raises(ValueError):
        imagery.RawReader({"path": str(tmp_path / "x.raw"), "bands": "50"})


def test_a_band_is_read_alone(spark, tmp_path):
    a = np.random.default_rng(4).random((6, 5, 4))
    imagery.write_by_band(images.from_array(spark, a), str(tmp_path / "c"))
    df = imagery.lazy_band(spark, str(tmp_path / "c"), 2)
    assert np.allclose([r.value for r in df.orderBy("vec_id").collect()], a[:, :, 2].ravel())
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(band" in plan


def test_bands_of_one_name_in_two_folders(spark, tmp_path):
    for k, folder in enumerate(("one", "two")):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "b.pgm").write_bytes(images.encode_pgm(np.full((2, 3), 10 * (k + 1))))
    cube, _ = images.read_bands(spark, [images.Band(str(tmp_path / f / "b.pgm")) for f in ("two", "one", "two")])
    assert np.round(values(cube)).tolist() == [[20, 10, 20]] * 6


def test_mode_image(spark):
    px = spark.createDataFrame([(0, 0, 0, 2), (1, 0, 1, 1)], "vec_id long, y int, x int, label int")
    c = imagery.mode_cube(px, np.array([[0, 65535], [65535, 13107]]), 2, 0.0, 10.0)
    assert values(c).tolist() == [[10.0, 2.0], [0.0, 10.0]] and isinstance(c, Cube)
