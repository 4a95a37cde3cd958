"""Queries agree with their SQL on an image of more than 20 rows whose last row is not full."""

import duckdb
import numpy as np
import pytest

from cubeflux.operators import lsh
from cubeflux.plans.registry import ORACLE, QUERIES

N = 610  # 24 rows of 25 pixels, and 10 pixels


@pytest.fixture(scope="module")
def ragged(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("ragged"))
    v = np.random.default_rng(7).uniform(-0.3, 0.3, (N, 64))
    spark.createDataFrame([(i, i % 7, r.tolist()) for i, r in enumerate(v)], "vec_id long, label int, embedding array<float>").coalesce(1).write.parquet(f"{path}/embeddings.parquet")
    return path


@pytest.mark.parametrize("name", ["p27_flip", "s10_export", "s17_label_image", "s4_raw_bands", "s9_band_images", "j14_lsh_candidates", "j11_nearest_mode"])
def test_matches_sql(spark, ragged, name):
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{ragged}/embeddings.parquet/*.parquet'")
    df = QUERIES[name](spark, ragged)
    want = con.sql(ORACLE[name]).select(*[f'"{c}"' for c in df.columns]).fetchall()
    assert sorted(map(tuple, df.collect())) == sorted(want)


def test_pairs_need_no_shuffle_of_pairs(spark, ragged):
    from cubeflux.plans.base import cube
    from cubeflux.plans.selections import _CUTS

    px = cube(spark, ragged).pixels
    h = lsh.hashed(px, _CUTS)
    found = lsh.pairs(px, px, _CUTS)
    assert sorted(found.collect()) == sorted(lsh.candidates(h, h).collect())
    assert "Aggregate" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_every_band_is_exported(spark, ragged):
    """Two bands of 64 were, before."""
    rows = QUERIES["s10_export"](spark, ragged).collect()
    assert {(r.vec_id, r.band) for r in rows} == {(i, b) for i in range(N) for b in range(64)} and len(rows) == 64 * N


def test_written_pairs_repeat_the_same_bytes(spark, tmp_path):
    """0.6 bytes and more a pair were written before, as lists had any length."""
    v = np.random.default_rng(8).uniform(-0.3, 0.3, (5000, 2))
    px = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(v)], "vec_id long, s array<double>").coalesce(1)
    lsh.pairs(px, px, (((0, 0.0),), ((1, 0.0),))).write.parquet(f"{tmp_path}/pairs")
    below = v > 0
    n = sum(int((below == b).any(axis=1).sum()) for b in below)
    assert spark.read.parquet(f"{tmp_path}/pairs").distinct().count() == n
    assert sum(f.stat().st_size for f in (tmp_path / "pairs").iterdir()) < 0.3 * n
