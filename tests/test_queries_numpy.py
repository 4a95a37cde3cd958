"""Registered queries without SQL against independent results on their own tables."""

import numpy as np
import pyarrow.parquet as pq
import pytest

from cubeflux.plans.registry import QUERIES


@pytest.fixture(scope="module")
def spectra(sf):
    t = pq.read_table(f"{sf}/embeddings.parquet").sort_by("vec_id")
    assert t.column("vec_id").to_pylist() == list(range(len(t)))
    return np.array(t.column("embedding").to_pylist(), np.float32).astype(float)


def by_id(df, *cols):
    rows = sorted(df.select("vec_id", *cols).collect())
    assert [r.vec_id for r in rows] == list(range(len(rows)))
    return [r[1:] if len(cols) > 1 else r[1] for r in rows]


def components(x, k):
    values, vectors = np.linalg.eigh(np.cov(x.T, bias=True))
    rows = vectors[:, ::-1][:, :k].T
    return values[::-1], rows * np.sign(rows[np.arange(k), np.abs(rows).argmax(axis=1)])[:, None]


def test_principal_components(spark, sf, spectra):
    values, rows = components(spectra, 3)
    got = [r.variance for r in QUERIES["a9_pca_variances"](spark, sf).orderBy("component").collect()]
    assert np.allclose(got, values[:10], atol=1e-8)
    coordinates = (spectra - spectra.mean(axis=0)) @ rows.T
    assert np.allclose(by_id(QUERIES["a10_pca_projection"](spark, sf), "coordinates"), coordinates, atol=2e-6)
    assert max(by_id(QUERIES["t24_pca_back_projection"](spark, sf), "error")) < 1e-6
    colours = np.array(by_id(QUERIES["i24_pca_false_colour"](spark, sf), *"rgb"), float)
    assert colours.shape == (len(spectra), 3)
    for k in range(3):  # each colour is one coordinate, stretched: in the same order, from end to end
        own = [abs(np.corrcoef(colours[:, k], coordinates[:, j])[0, 1]) for j in range(3)]
        assert max(own) > 0.999


def test_shuffle_is_a_permutation(spark, sf, spectra):
    got = by_id(QUERIES["o8_shuffle"](spark, sf), "place")
    assert sorted(got) == list(range(1, len(spectra) + 1)) and got != sorted(got)


def lattice(x, offsets, width=25):
    n, out = len(x), []
    for i in range(n):
        for dy, dx in offsets:
            yy, xx = i // width + dy, i % width + dx
            j = yy * width + xx
            if 0 <= xx < width and yy >= 0 and j < n:
                out.append((i, j, float(np.sqrt(((x[i] - x[j]) ** 2).sum()))))
    return out


def seeded_forest(n, edges, seeds):
    """The strongest edges first; a tree takes its seed's label, and two seeds never meet."""
    tree, label = list(range(n)), dict(seeds)

    def root(i):
        while tree[i] != i:
            i = tree[i]
        return i

    for _, u, v in sorted(((-w, u, v) for u, v, w in edges)):
        a, b = root(u), root(v)
        if a != b and not (a in label and b in label):
            tree[a] = b
            if a in label:
                label[b] = label.pop(a)
    return [label.get(root(i), 0) for i in range(n)]


def test_seeded_forests(spark, sf, spectra):
    edges = lattice(spectra, ((0, 1), (1, 0)))
    top = max(w for *_, w in edges)
    weights = [(u, v, 255 - w * 255 / top) for u, v, w in edges]
    seeds = {i: 1 if i % 50 == 0 else 2 for i in range(len(spectra)) if i % 50 in (0, 7)}
    want = seeded_forest(len(spectra), weights, seeds)
    assert by_id(QUERIES["i14_kruskal"](spark, sf), "label") == want
    assert by_id(QUERIES["i13_prim"](spark, sf), "label") == want


def test_superpixels_are_connected_and_large_enough(spark, sf, spectra):
    got = by_id(QUERIES["i12_superpixels"](spark, sf), "label")
    near = {}
    for u, v, _ in lattice(spectra, ((0, 1), (1, 0), (1, 1), (-1, 1))):
        near.setdefault(u, []).append(v)
        near.setdefault(v, []).append(u)
    members = {}
    for i, s in enumerate(got):
        members.setdefault(s, set()).add(i)
    for mine in members.values():
        seen, todo = set(), [min(mine)]
        while todo:
            i = todo.pop()
            if i not in seen:
                seen.add(i)
                todo += [j for j in near[i] if j in mine]
        assert seen == mine and len(mine) >= 5
    firsts = [min(members[s]) for s in sorted(members)]
    assert firsts == sorted(firsts)


def test_every_cluster_query_labels_every_pixel(spark, sf, spectra):
    for name in ("i7_mean_shift", "i10_mean_shift_superpixels", "i11_mean_shift_map", "i26_pspms", "i26_fspms"):
        got = by_id(QUERIES[name](spark, sf), "label")
        assert len(got) == len(spectra) and min(got) >= 1, name


def test_pixels_that_start_themselves_need_no_superpixels(spark, sf, monkeypatch):
    """i26_fams made superpixels that it didn't use."""
    from cubeflux.plans import kernels

    monkeypatch.setattr(kernels, "_superpixels", lambda *_: pytest.fail("superpixels are made"))
    assert by_id(QUERIES["i26_fams"](spark, sf), "label") == by_id(QUERIES["i7_mean_shift"](spark, sf), "label")
