"""Queries give a row for everything in their tables: an image of 24 rows of 25 pixels, more than the SQL forms cover."""

import numpy as np
import pytest

from cubeflux.operators import meanshift
from cubeflux.plans import selections
from cubeflux.plans.registry import QUERIES

N = 600


@pytest.fixture(scope="module")
def image(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("image"))
    v = np.random.default_rng(3).uniform(-0.3, 0.3, (N, 64))
    spark.createDataFrame([(i, i % 7, r.tolist()) for i, r in enumerate(v)], "vec_id long, label int, embedding array<float>").write.parquet(f"{path}/embeddings.parquet")
    return path, v.astype(np.float32).astype(float)


def test_flip_blur_and_lookup_cover_the_table(spark, image):
    path, v = image
    assert {(r.vec_id, r.y, r.x) for r in QUERIES["p27_flip"](spark, path).collect()} == {(i, 23 - i // 25, 24 - i % 25) for i in range(N)}
    look = QUERIES["j13_band_lookup_all"](spark, path).collect()
    assert {(r.vec_id, r.band, r.center) for r in look} == {(i, b, 400.0 + 5 * b) for i in range(N) for b in range(64)} and len(look) == 64 * N
    got = {(r.vec_id, r.band): r.value for r in QUERIES["t18_blur_all"](spark, path).collect()}
    k = np.exp([-0.5, 0.0, -0.5])
    k /= k.sum()
    p = np.pad(v.reshape(24, 25, 64), ((1, 1), (1, 1), (0, 0)), "reflect")
    want = sum(k[a] * k[b] * p[a : a + 24, b : b + 25] for a in range(3) for b in range(3)).reshape(N, 64)
    assert len(got) == 64 * N and all(abs(got[i, b] - want[i, b]) < 2e-6 for i in range(N) for b in range(64))


def test_density_step_and_candidates_for_every_pixel(spark, image):
    path, v = image
    q = np.floor((v + 1) * 65535 / 2)
    d = np.abs(q[:, None] - q[None]).sum(axis=2)
    got = {r.vec_id: r.window_ for r in QUERIES["j9_pilot_density_all"](spark, path).collect()}
    k = int(N**0.5)  # 24, not the 22 of 500 pixels
    assert got == {i: (int(np.sort(np.minimum(d[i] // 640, 699))[k]) + 1) * 640 for i in range(N)}
    step = {r.vec_id: (r.members, r.mean0) for r in QUERIES["j10_mean_shift_step_all"](spark, path).collect()}
    w = np.where(d < 400000, (1 - d / 400000) ** 2, 0.0)
    mean = np.floor(w @ q[:, 0] / w.sum(axis=1) + 1e-6)
    assert step == {i: ((d[i] < 400000).sum(), mean[i]) for i in range(N)}
    keys = [np.stack([v[:, band] > at for band, at in table], axis=1) for table in selections._CUTS]
    near = np.logical_or.reduce([(x[:, None] == x[None]).all(axis=2) for x in keys])
    got = QUERIES["j14_lsh_candidates_all"](spark, path).collect()
    assert {(r.query, r.candidate) for r in got} == {*map(tuple, np.argwhere(near).tolist())} and len(got) == near.sum()


def test_mean_shift_weighs_points_by_size(spark):
    pts = spark.createDataFrame([(0, [1000.0]), (1, [1010.0]), (2, [1020.0]), (3, [40000.0])], "vec_id long, s array<double>")
    sizes = spark.createDataFrame([(0, 1), (1, 1), (2, 98)], "vec_id long, size long")
    modes = meanshift.segment(pts, k=2, min_members=1, sizes=sizes)[1]
    assert modes.shape == (1, 1) and 1015 < modes[0, 0] <= 1020  # the point without pixels forms no mode
    assert meanshift.neighbour_threshold(500) == 22 and meanshift.neighbour_threshold(2000) == 44
    assert meanshift.segment(pts.filter("vec_id = 0"), k=1)[0].count() == 1


def test_superpixel_segments_follow_superpixels(spark, tmp_path):
    v = np.random.default_rng(4).normal(0, 0.002, (N, 64)) + np.where(np.arange(N) % 25 < 12, -0.5, 0.5)[:, None]
    spark.createDataFrame([(i, 0, r.tolist()) for i, r in enumerate(v)], "vec_id long, label int, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    part = {r.vec_id: r.label for r in QUERIES["i12_superpixels"](spark, str(tmp_path)).collect()}
    for name in ("i10_mean_shift_superpixels", "i11_mean_shift_map"):
        got = {r.vec_id: r.label for r in QUERIES[name](spark, str(tmp_path)).collect()}
        assert set(got) == set(range(N))
        left, right = {got[i] for i in got if i % 25 < 12}, {got[i] for i in got if i % 25 >= 12}
        assert not left & right, name
        if name.startswith("i10"):
            assert all(len({got[i] for i in got if part[i] == s}) == 1 for s in set(part.values()))
