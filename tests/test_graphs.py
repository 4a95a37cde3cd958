"""Seeded forest, random walker and superpixels on graphs of several tiles against brute force."""

import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_queries_numpy import lattice, seeded_forest

from cubeflux.operators import forest, lsh, regions, segmentation, walker

EDGES, SEEDS = "u long, v long, weight double", "vec_id long, label int"


def labels(df):
    rows = sorted(df.select("vec_id", "label").collect())
    assert len({r.vec_id for r in rows}) == len(rows)
    return {r.vec_id: r.label for r in rows}


def image(h, w, bands=3, seed=0):
    rng = np.random.default_rng(seed)
    return rng.random((h * w, bands))


@pytest.mark.parametrize("rest", [0, 200, forest.REST])
def test_forest_on_a_larger_image(spark, rest):
    """In rounds of joins alone, ending in one task, and in one task alone."""
    x = image(20, 30)
    e = lattice(x, ((0, 1), (1, 0)), 30)
    seeds = {0: 1, 29: 2, 599: 3, 300: 1}
    got = labels(forest.seeded_forest(spark.createDataFrame(e, EDGES), spark.createDataFrame(list(seeds.items()), SEEDS), rest))
    assert [got[i] for i in range(600)] == seeded_forest(600, e, seeds)


def test_forest_with_ties_gaps_and_odd_tables(spark):
    flat = [(u, v, 1.0) for u, v, _ in lattice(image(6, 6), ((0, 1), (1, 0)), 6)]
    seeds = {0: 1, 35: 2}
    edges = [*flat, (100, 101, 5.0), (200, 200, 9.0), (0, 1, 0.5)]  # out of reach, a loop, a parallel edge
    got = labels(forest.seeded_forest(spark.createDataFrame(edges, EDGES), spark.createDataFrame([*seeds.items(), (0, 4), (500, 3)], SEEDS), rest=0))
    turned = {35 - i: k for i, k in seeds.items()}  # equal weights rank by the larger (u, v): the image upside down by the smaller
    want = seeded_forest(36, [(35 - u, 35 - v, w) for u, v, w in flat], turned)[::-1]
    assert [got[i] for i in range(36)] == want
    assert got[100] == got[101] == got[200] == 0 and got[500] == 3
    assert labels(forest.seeded_forest(spark.createDataFrame([], EDGES), spark.createDataFrame([(3, 2)], SEEDS))) == {3: 2}
    assert set(labels(forest.seeded_forest(spark.createDataFrame(flat, EDGES), spark.createDataFrame([], SEEDS))).values()) == {0}


def dense_walker(n, edges, seeds, k):
    a = np.zeros((n, n))
    for u, v, w in edges:
        a[u, u] += w
        a[v, v] += w
        a[u, v] -= w
        a[v, u] -= w
    free = [i for i in range(n) if i not in seeds]
    known = sorted(seeds)
    one = np.zeros((len(known), k))
    one[np.arange(len(known)), [seeds[i] - 1 for i in known]] = 1
    out = np.zeros((n, k))
    out[known] = one
    out[free] = np.linalg.solve(a[np.ix_(free, free)], -a[np.ix_(free, known)] @ one)
    return out


@pytest.mark.parametrize("side", [5, 32])
def test_walker_equals_a_dense_solve(spark, side):
    """In one tile, and over six of them."""
    x = image(9, 13, seed=1)
    e = [(u, v, 1 / (0.01 + w)) for u, v, w in lattice(x, ((0, 1), (1, 0)), 13)]
    seeds = {0: 1, 60: 2, 116: 3, 12: 2}
    found = walker.random_walker(spark.createDataFrame(e, EDGES), spark.createDataFrame(list(seeds.items()), SEEDS), walker.tiles(13, side))
    got = np.array([r.probabilities for r in found.orderBy("vec_id").collect()])
    want = dense_walker(117, e, seeds, 3)
    assert np.abs(got - want).max() < 1e-7
    assert [r.label for r in found.orderBy("vec_id").collect()] == (want.argmax(axis=1) + 1).tolist()


@pytest.mark.parametrize("width, height", [(32, 100), (1, 40), (7, 9)])
def test_walker_solves_a_block_without_its_whole_matrix(width, height):
    n, rng = width * height, np.random.default_rng(4)
    at = np.arange(n).reshape(height, width)
    u, v = (np.concatenate([p.ravel(), q.ravel()]) for p, q in ((at[:, :-1], at[:-1]), (at[:, 1:], at[1:])))
    order = rng.permutation(len(u))
    u, v, w = u[order], v[order], rng.uniform(0.5, 2, len(u))
    row, col, both = np.append(u, v), np.append(v, u), np.append(w, w)
    diagonal = np.bincount(row, both, n) + rng.uniform(0, 1, n)
    r = rng.normal(size=(n, 2))
    tracemalloc.start()
    x = walker._solve({"ids": np.arange(n), "diagonal": diagonal, "row": row, "col": col, "w": both}, r)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    got = diagonal[:, None] * x
    np.subtract.at(got, row, both[:, None] * x[col])
    assert np.abs(got - r).max() < 1e-9
    assert n < 1000 or most < n * n  # an eighth of the whole matrix


def test_walker_of_odd_tables(spark):
    edges = [(0, 1, 1.0), (1, 2, 1.0), (1, 2, 1.0), (5, 6, 2.0), (7, 8, 0.0), (3, 3, 1.0)]
    run = lambda e, s: {r.vec_id: (r.label, r.probabilities) for r in walker.random_walker(spark.createDataFrame(e, EDGES), spark.createDataFrame(s, SEEDS), lambda i: F.col(i) % 2).collect()}
    got = run(edges, [(0, 1), (2, 2), (2, 3)])
    assert got[0] == (1, [1.0, 0.0]) and got[2] == (2, [0.0, 1.0])
    assert got[1][0] == 2 and np.allclose(got[1][1], [1 / 3, 2 / 3])
    assert all(got[i] == (0, [0.0, 0.0]) for i in (3, 5, 6, 7, 8))
    assert run([], [(4, 1)]) == {4: (1, [1.0])}
    assert run(edges, [])[5] == (0, [])


def ordered(spark, edges):
    """Edges in the order of the operator: equal weights by their hash."""
    rows = spark.createDataFrame(edges, EDGES).orderBy("weight", F.xxhash64("u", "v"), "u", "v").collect()
    return [np.array(c) for c in zip(*((r.u, r.v, r.weight) for r in rows), strict=True)]


@pytest.mark.parametrize(("rest", "h", "w", "c", "least"), [(0, 6, 7, 1.0, 4), (90, 12, 14, 0.6, 6), (100_000, 12, 14, 0.6, 6), (100_000, 12, 14, 2.0, 1)])
def test_superpixels_equal_the_sequential_algorithm(spark, rest, h, w, c, least):
    """In rounds of joins alone, ending in one task, and in one task alone; with weights that tie."""
    x, n = image(h, w, 2, seed=3), h * w
    x[: n // 2] *= 0.2
    e = [(u, v, round(d, 1)) for u, v, d in lattice(x, ((0, 1), (1, 0), (1, 1), (-1, 1)), w)]
    got = labels(regions.superpixels(spark.range(n).withColumnRenamed("id", "vec_id"), spark.createDataFrame(e, EDGES), c, least, rest))
    want = segmentation.superpixels(n, *ordered(spark, e), c=c, min_size=least)
    assert [got[i] for i in range(n)] == want.tolist()
    assert 1 < len(set(got.values())) < n


def test_superpixels_of_odd_tables(spark):
    px = spark.range(5).withColumnRenamed("id", "vec_id")
    assert labels(regions.superpixels(px, spark.createDataFrame([], EDGES))) == {i: i for i in range(5)}
    assert labels(regions.superpixels(px, spark.createDataFrame([(3, 1, 0.0), (1, 3, 9.0), (2, 2, 0.0)], EDGES), rest=0)) == {0: 0, 1: 1, 2: 2, 3: 1, 4: 3}
    assert labels(regions.superpixels(px.filter("vec_id < 0"), spark.createDataFrame([], EDGES))) == {}


def test_tuning_by_the_worst_of_trials(spark):
    rng = np.random.default_rng(7)
    x = rng.random((80, 4))
    px = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, s array<double>")
    sample, ks, tables, lows, highs, trials = px.filter("vec_id % 8 = 0"), (1, 3), (1, 2, 4), [0.0] * 4, [1.0] * 4, 3
    d = np.abs(x[:, None] - x[None]).sum(axis=2)
    near = [(q, int(c)) for q in range(0, 80, 8) for c in sorted((j for j in range(80) if j != q), key=lambda j: (d[q, j], j))[:3]]
    worst, looked = {}, {}
    for k in ks:
        for n in tables:
            shares = []
            for t in range(trials):
                cuts = [c[:k] for c in lsh.random_cuts(3, 4, lows, highs, 42 + t)][:n]
                key = [[tuple(v[b] > at for b, at in c) for c in cuts] for v in x]
                shares.append(sum(any(a == b for a, b in zip(key[q], key[c], strict=True)) for q, c in near) / len(near))
                if t == 0:
                    looked[k, n] = sum(sum(key[q][j] == key[c][j] for q in range(0, 80, 8) for c in range(80)) for j in range(n)) / 10
            worst[k, n] = min(shares)
    got = lsh.trial_scores(px, lsh.nearest_of_sample(px, sample, 3), ks, tables, lows, highs, trials, 42)
    assert {c: min(v) for c, v in got.items()} == pytest.approx(worst) and all(len(v) == trials for v in got.values())
    assert lsh.bucket_sizes(px, sample, ks, tables, lows, highs, 42) == pytest.approx(looked)
    for epsilon in (0.1, 0.4, 0.7):
        good = [c for c in worst if worst[c] >= 1 - epsilon]
        k, n, cost = lsh.tune(px, ks, tables, lows, highs, sample, 3, epsilon, trials=trials)
        assert (k, n) == (min(good, key=lambda c: (looked[c], c)) if good else max(worst, key=lambda c: (worst[c], -looked[c]))) and cost == pytest.approx(looked[k, n])
    assert lsh.bounded_sample(px, 7).count() == 7
