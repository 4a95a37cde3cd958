"""Kernels, region algebra, file formats and degenerate cubes against independent computations."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cubeflux.functions import distances as D
from cubeflux.functions import spectral
from cubeflux.model import from_embeddings
from cubeflux import shared
from cubeflux.operators import histogram, meanshift, neighbours, pca, segmentation, select, som
from cubeflux.sources import images
from cubeflux.streaming import histogram as stream

rect = st.builds(select.Rect, st.integers(0, 9), st.integers(0, 9), st.integers(0, 9), st.integers(0, 9))


def cells(r):
    return {(x, y) for x in range(r.x, r.x + r.w) for y in range(r.y, r.y + r.h)}


@settings(max_examples=200, deadline=None)
@given(rect, rect)
def test_rectangle_difference(a, b):
    parts = a.minus(b)
    union = [c for p in parts for c in cells(p)]
    assert len(union) == len(set(union)) and set(union) == cells(a) - cells(b) and len(parts) <= 8
    assert cells(a.meet(b)) == cells(a) & cells(b)


def test_roi_text():
    assert select.parse_roi("1:2:3:4") == select.Rect(1, 2, 3, 4)
    assert select.parse_roi("1:2:3") is None and select.parse_roi("a:b:c:d") is None


@pytest.mark.parametrize("name", sorted(D.MEASURES))
def test_measures_are_symmetric_and_zero_on_the_diagonal(spark, name):
    f = D.MEASURES[name]
    df = spark.createDataFrame([([1.0, 2.0, 4.0], [2.0, 1.0, 5.0]), ([0.0, 0.0, 0.0], [1.0, 1.0, 1.0]), ([0.0] * 3, [0.0] * 3)], "a array<double>, b array<double>")
    for r in df.select(f(F.col("a"), F.col("b")).alias("x"), f(F.col("b"), F.col("a")).alias("y"), f(F.col("a"), F.col("a")).alias("z")).collect():
        assert r.x == pytest.approx(r.y, abs=1e-9) and r.z == pytest.approx(0, abs=1e-3)


@pytest.mark.parametrize("shape", [(1, 1, 3), (4, 4, 1), (4, 4, 2)])
def test_degenerate_cubes(spark, shape):
    c = images.from_array(spark, np.zeros(shape))
    assert c.pixels.select(F.size(spectral.gradient("s")).alias("n")).first().n == shape[2] - 1
    assert c.pixels.select(F.array_max(spectral.log("s")).alias("m")).first().m == 0
    assert histogram.data_range(c.pixels).first() == (0.0, 0.0)
    assert neighbours.edges(c.pixels).count() == 2 * shape[0] * shape[1] - shape[0] - shape[1]
    assert histogram.nd_histogram(c, 0.0, 1.0, 4).count() == 1
    r = histogram.robust_range(c, 0.1).first()
    assert r.lo == 0.0


def test_top_value_is_in_the_last_bin(spark):
    c = images.from_array(spark, np.array([[[0.0], [255.0]]]))
    assert sorted(r.bin for r in histogram.band_histogram(c, 0.0, 255.0, 8).collect()) == [0, 7]


def test_incremental_histogram_equals_new(spark, sf):
    c = select.crop(from_embeddings(spark, sf), 0, 3)
    a, b = select.Rect(3, 2, 10, 8), select.Rect(6, 4, 10, 8)
    sub, add, gain = select.roi_change(a, b)

    def h(where):
        return histogram.nd_histogram(select.Cube(c.pixels.filter(where), c.width, 4, c.lo, c.hi), -1.0, 1.0, 4)

    got = histogram.apply_changes(h(a.contains()), h(select.in_any(add)), h(select.in_any(sub)), 4)
    key = lambda df: sorted((r.label, tuple(r.key), r.weight, tuple(round(v, 9) for v in r.sums)) for r in df.collect())
    assert key(got) == key(h(b.contains())) and isinstance(gain, bool)


def test_pca_against_numpy(spark, sf):
    c = from_embeddings(spark, sf)
    m = np.array([r.s for r in c.pixels.orderBy("vec_id").collect()])
    mean, rows, values = pca.fit(c, 5)
    assert np.allclose(mean, m.mean(axis=0))
    assert np.allclose(values, np.sort(np.linalg.eigvalsh(np.cov(m.T, bias=True)))[::-1][:5])
    got = np.array([r.p for r in c.pixels.orderBy("vec_id").select(pca.project("s", mean, rows).alias("p")).collect()])
    assert np.allclose(got, (m - mean) @ rows.T)


def lattice(h, w, weight):
    u, v, x = [], [], []
    for i in range(h * w):
        for j in ([i + 1] if i % w < w - 1 else []) + ([i + w] if i < (h - 1) * w else []):
            u.append(i), v.append(j), x.append(weight(i, j))
    order = np.lexsort((v, u, x))
    return np.array(u)[order], np.array(v)[order], np.array(x, float)[order]


def test_two_flat_halves_are_two_superpixels():
    side = lambda i: i % 6 >= 3
    u, v, w = lattice(4, 6, lambda i, j: 100.0 * (side(i) != side(j)))
    s = segmentation.superpixels(24, u, v, w, c=1.0, min_size=2)
    assert sorted(set(s)) == [0, 1] and all((s[i] == 1) == side(i) for i in range(24))


@pytest.mark.parametrize("algorithm", segmentation.ALGORITHMS)
def test_seeded_segmentation_of_two_halves(algorithm):
    side = lambda i: i % 6 >= 3
    u, v, w = lattice(4, 6, lambda i, j: 255.0 - 200.0 * (side(i) != side(j)))
    for geodesic in (False, True):
        out = segmentation.seeded(24, u, v, w, {0: 1, 23: 2}, algorithm, geodesic)
        assert all(out[i] == 1 + side(i) for i in range(24))


def test_prim_and_kruskal_agree_on_distinct_weights():
    rng = np.random.default_rng(1)
    u, v, _ = lattice(7, 8, lambda i, j: 0.0)
    w = rng.permutation(len(u)).astype(float)
    seeds = {0: 1, 30: 2, 55: 3}
    assert (segmentation.prim(56, u, v, w, seeds) == segmentation.kruskal(56, u, v, w, seeds)).all()


def test_unreached_pixels_are_zero():
    none = np.array([], int)
    assert segmentation.prim(3, none, none, none.astype(float), {0: 1}).tolist() == [1, 0, 0]


def test_random_walker_against_a_dense_solve():
    u, v, w = lattice(3, 3, lambda i, j: 1.0 + (i + j) % 3)
    lap = np.zeros((9, 9))
    for a, b, x in zip(u, v, w, strict=True):
        lap[a, a] += x
        lap[b, b] += x
        lap[a, b] -= x
        lap[b, a] -= x
    p = segmentation.random_walker(9, u, v, w, {0: np.array([1.0, 0]), 8: np.array([0, 1.0])}, 2)
    free = list(range(1, 8))
    want = np.linalg.solve(lap[np.ix_(free, free)], -lap[np.ix_(free, [0])]).ravel()
    assert np.allclose(p[free, 0], want, atol=1e-6) and np.allclose(p.sum(axis=1), 1)


def test_pilot_windows_against_numpy(spark, sf):
    px = from_embeddings(spark, sf).pixels.withColumn("s", spectral.quantise("s", -1.0, 1.0))
    m = np.array([r.s for r in px.orderBy("vec_id").collect()], float)
    got = {r.vec_id: r.window_ for r in meanshift.pilot_windows(px, px.filter("vec_id < 20"), 22, 64).collect()}
    for i in range(20):
        d = np.minimum(np.abs(m - m[i]).sum(axis=1) // 640, 699)
        c = np.cumsum(np.bincount(d.astype(int), minlength=700))
        assert got[i] == (int(np.argmax(c > 22)) + 1) * 640


def test_mean_shift_finds_separate_clusters(spark):
    rng = np.random.default_rng(0)
    a = np.concatenate([rng.normal(10000, 50, (30, 3)), rng.normal(40000, 50, (30, 3))]).round()
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(a)], "vec_id long, s array<double>")
    labels, modes = meanshift.segment(df, k=5)
    got = [r.label for r in labels.orderBy("vec_id").collect()]
    assert not set(got[:30]) & set(got[30:]) and min(got) >= 1 and len(modes) >= 2


def test_map_training_and_file(tmp_path):
    x = np.random.default_rng(0).uniform(0, 1, (200, 3))
    w = som.train(x, side=5, dims=2, steps=1500, sigma=(2.0, 0.3), seed=1)
    err = lambda w: np.sqrt(((x[:, None] - w[None]) ** 2).sum(axis=2)).min(axis=1).mean()
    assert err(w) < err(np.random.default_rng(42).uniform(0, 1, (25, 3))) and (w == som.train(x, side=5, dims=2, steps=1500, sigma=(2.0, 0.3), seed=1)).all()
    p = str(tmp_path / "map.bin")
    som.save(p, w, "square", 5)
    back, layout, side = som.load(p, 3)
    assert np.allclose(back, w, atol=1e-6) and (layout, side) == ("square", 5)
    with pytest.raises(ValueError):
        som.load(p, 4)


def test_raw_and_band_files(spark, tmp_path):
    a = np.random.default_rng(0).integers(0, 256, (3, 4, 2))
    assert (images.decode_lan(images.encode_lan(a)) == a).all()
    (tmp_path / "x.lan").write_bytes(images.encode_lan(a))
    c = images.read_image(spark, str(tmp_path / "x.lan"))
    assert (np.array([r.s for r in c.pixels.orderBy("vec_id").collect()]).reshape(3, 4, 2) == a).all()
    path = images.write_bands(images.from_array(spark, a), [images.Band("", 400, 410), images.Band("", 500, 510)], str(tmp_path / "out"))
    back = images.read_image(spark, path)
    assert (np.round([r.s for r in back.pixels.orderBy("vec_id").collect()]).reshape(3, 4, 2) == a).all()
    bands = images.parse_file_list(open(path).read(), str(tmp_path / "out"))
    assert [b.center for b in bands] == [405, 505]


def test_points_and_options(spark, tmp_path):
    (tmp_path / "p.ppm").write_text("P3\n# note\n2 1\n255\n1 2 3 4 5 6\n")
    assert [r.s for r in images.read_points_ppm(spark, str(tmp_path / "p.ppm")).orderBy("vec_id").collect()] == [[1, 2, 3], [4, 5, 6]]
    d = {"dsize": 32, "sigma": 1.5, "verbose": False, "type": "square"}
    assert images.read_options(images.write_options("som", d | {"dsize": 10}), "som", d)["dsize"] == 10
    with pytest.raises(ValueError):
        images.read_options("[som]\nnone = 1\n", "som", d)


def test_stream_equals_batch(spark, sf, tmp_path):
    e = spark.read.parquet(f"{sf}/events.parquet")
    changes = stream.changes_of_events(e)
    changes.repartition(5).write.parquet(str(tmp_path / "in"))
    q = stream.start(spark, str(tmp_path / "in"), "hist", 0.0, 500.0, 16, str(tmp_path / "ck"))
    q.awaitTermination(120)
    key = lambda df: sorted((r.label, r.bin, r.weight) for r in df.collect())
    assert key(spark.table("hist")) == key(stream.histogram(changes, 0.0, 500.0, 16))


def test_bandwidths_by_setting(spark):
    pts = spark.createDataFrame([(i, [float(i * 10), 0.0]) for i in range(30)], "vec_id long, s array<double>")
    pilot = meanshift.bandwidths(pts, 3, 2)
    assert pilot.count() == 30 and {r.window_ for r in pilot.collect()} <= {20 * k for k in range(1, 702)}
    assert {(r.window_, r.weight) for r in meanshift.bandwidths(pts, 3, 2, bandwidth=0.5).collect()} == {(int(0.5 * 65535) * 2, 1.0)}
    local = spark.createDataFrame([(i, 0.25) for i in range(30)], "vec_id long, value double")
    got = meanshift.bandwidths(pts, 3, 2, bandwidth=0.5, local=local).collect()
    assert {r.window_ for r in got} == {int(0.25 * 65535)} and got[0].weight == pytest.approx((1e5 / int(0.25 * 65535)) ** 4)
    assert {r.window_ for r in meanshift.bandwidths(pts, 3, 2, bandwidth=0.5, superpixel_weight=2).collect()} == {r.window_ for r in pilot.collect()}


def test_cluster_presets_find_two_groups(spark):
    rng = np.random.default_rng(2)
    s = np.concatenate([rng.normal(8000, 300, (40, 3)), rng.normal(50000, 300, (40, 3))]).round()
    pts = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(s)], "vec_id long, s array<double>")
    sp = spark.createDataFrame([(i, i // 8) for i in range(80)], "vec_id long, segment int")
    for method in meanshift.PRESETS:
        got = dict(meanshift.cluster(pts, method, sp).collect())
        assert len(got) == 80 and len({got[i] for i in range(40)} & {got[i] for i in range(40, 80)}) == 0, method
        assert all(len({got[i] for i in range(8 * k, 8 * k + 8)}) == 1 for k in range(10)) or method == "FAMS"


def test_measures_are_linear_in_the_bands(spark):
    """The same work a band, whatever their number: no reduction is repeated for every band."""
    import time

    from cubeflux.functions import distances, spectral

    spent = {}
    for n in (64, 512):
        df = spark.range(400).select(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda v: v.cast("double") + F.col("id")).alias("a"), F.transform(F.sequence(F.lit(1), F.lit(n)), lambda v: F.sqrt(v) + 1).alias("b")).cache()
        df.count()
        for f in (distances.information_divergence, distances.correlation, distances.normalised_l2, lambda a, b: F.element_at(spectral.normalise(a), 1), lambda a, b: F.element_at(spectral.gradient(spectral.log(a)), 1)):
            df.agg(F.sum(f(F.col("a"), F.col("b")))).collect()
            started = time.monotonic()
            df.agg(F.sum(f(F.col("a"), F.col("b")))).collect()
            spent[n] = spent.get(n, 0) + time.monotonic() - started
    assert spent[512] < 24 * spent[64]


def test_ranks_and_nearest_without_one_partition(spark):
    from cubeflux.operators import lsh, neighbours

    rng = np.random.default_rng(4)
    rows = [(i, float(v)) for i, v in enumerate(rng.integers(0, 40, 500))]
    df = spark.createDataFrame(rows, "u long, weight double").repartition(5)
    got = {r.u: r.place for r in shared.numbered(df, "place", "weight", "u").collect()}
    assert got == {u: k for k, (_, u) in enumerate(sorted((w, u) for u, w in rows))}
    down = shared.numbered(df, "place", -F.col("weight"), -F.col("u"))
    assert {r.u: r.place for r in down.collect()} == {u: 499 - k for u, k in got.items()}
    pts = rng.normal(size=(90, 5))
    near = lsh.nearest_of_sample(spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(pts)], "vec_id long, s array<double>"), spark.createDataFrame([(i, pts[i].tolist()) for i in (3, 50)], "vec_id long, s array<double>"), 4)
    for q in (3, 50):
        d = np.abs(pts - pts[q]).sum(axis=1)
        d[q] = np.inf
        assert {r.candidate for r in near.filter(F.col("query") == q).collect()} == set(np.argsort(d)[:4].tolist())


def test_measures_of_spectra_and_places(spark):
    from cubeflux.functions import distances
    from cubeflux.operators import neighbours

    px = spark.createDataFrame([(y * 4 + x, y, x, [float(y), float(x * x)]) for y in range(3) for x in range(4)], "vec_id long, y int, x int, s array<double>")
    pairs = neighbours.placed_pairs(px, ((0, 1), (0, 3)), with_self=True)
    read = lambda m: {(r.u, r.v): r.weight for r in neighbours.weighted_at(pairs, m).collect()}
    plain, far, near = read(distances.anywhere(distances.euclidean)), read(distances.spatial(distances.euclidean, 10.0)), read(distances.within(distances.euclidean, 2))
    assert len(plain) == 9 + 3 + 12 and plain[0, 1] == 1.0 and plain[0, 3] == 9.0 and plain[5, 5] == 0.0
    assert far[0, 1] == 11.0 and far[0, 3] == 39.0 and far[5, 5] == 0.0
    assert near[0, 1] == 1.0 and near[0, 3] == float("inf")
