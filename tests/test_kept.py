"""Kept sums, derived tables and stored maps."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cubeflux.functions.hashes import text_hash
from cubeflux.model import from_embeddings
from cubeflux.operators import derived, select, som
from cubeflux.operators import histogram as H
from cubeflux.operators.select import Rect
from cubeflux.streaming import histogram as stream
from cubeflux.streaming import kept


def rows(df):
    return sorted((r.label, tuple(r.key), r.weight, tuple(round(v, 9) for v in r.sums)) for r in df.collect())


def test_a_moving_region_and_new_labels(spark, sf, tmp_path):
    cube = select.crop(from_embeddings(spark, sf), 0, 2)
    h = kept.KeptHistogram(cube, str(tmp_path / "h"), -1.0, 1.0, 4, parts=8)

    def direct(px):
        return rows(H.nd_histogram(select.Cube(px, cube.width, cube.n_bands, cube.lo, cube.hi), -1.0, 1.0, 4))

    at = Rect(3, 2, 10, 8)
    h.create(at)
    for new in (Rect(4, 2, 10, 8), Rect(4, 4, 9, 8), Rect(20, 15, 3, 3), Rect(20, 15, 3, 3), Rect(0, 0, 25, 20)):
        h.move(at, new)
        at = new
        assert rows(h.read()) == direct(cube.pixels.filter(at.contains()))
    few = cube.pixels.filter("vec_id in (3, 77)").select("vec_id", F.lit(9).alias("new_label"))
    assert 0 < len(h.relabel(few)) <= 4  # two bins lose a pixel and two gain one
    now = cube.pixels.join(few, "vec_id", "left").withColumn("label", F.coalesce("new_label", "label").cast("int")).drop("new_label")
    assert rows(h.read()) == direct(now)


def test_an_update_reads_the_changed_rows_only(spark, sf, tmp_path):
    cube = select.crop(from_embeddings(spark, sf), 0, 2)
    h = kept.KeptHistogram(cube, str(tmp_path / "h"), -1.0, 1.0, 4)
    plan = h.rows([Rect(0, 3, 25, 1)])._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(vec_id,75)" in plan and "LessThanOrEqual(vec_id,99)" in plan
    assert h.rows([]).count() == 0


def test_versions_batches_and_empty_changes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(kept, "MOST_VERSIONS", 4)
    state = kept.Kept(spark, str(tmp_path / "s"), ["k"], parts=3)
    make = lambda *r: spark.createDataFrame(list(r), "k string, weight long, total double")
    state.create(make(("a", 2, 1.0), (None, 1, 5.0)))
    assert state.merge(make()) == []
    for n in range(10):
        state.merge(make(("a", 1, 0.5), (f"x{n}", 1, 1.0), (f"x{n - 1}", -1, -1.0) if n else ("y", 1, 2.0)), batch=n)
        assert state.merge(make(("a", 100, 0.0)), batch=n) == []  # the same batch again
    assert sorted(map(tuple, state.read().collect()), key=repr) == sorted([("a", 12, 6.0), (None, 1, 5.0), ("x9", 1, 1.0), ("y", 1, 2.0)], key=repr)
    assert len(set(state._manifest()["parts"].values())) <= 4


def test_a_stream_into_a_kept_histogram(spark, sf, tmp_path):
    changes = stream.changes_of_events(spark.read.parquet(f"{sf}/events.parquet"))
    changes.repartition(3).write.parquet(str(tmp_path / "in"))
    kept.follow(spark, str(tmp_path / "in"), str(tmp_path / "h"), 0.0, 500.0, 16, str(tmp_path / "ck")).awaitTermination(120)
    key = lambda df: sorted((r.label, r.bin, r.weight, round(r.total, 6)) for r in df.collect() if r.weight)
    assert key(kept.Kept(spark, str(tmp_path / "h"), ["label", "bin"]).read()) == key(stream.histogram(changes, 0.0, 500.0, 16))


def test_derived_tables_are_made_for_subscribers_and_after_changes(spark):
    d = derived.Derived()
    d.set("IMG", spark.range(3))
    d.define("NORM", ("IMG",), lambda i: i.select((F.col("id") * 2).alias("id")))
    d.define("GRAD", ("NORM",), lambda n: n.filter("id > 0"))
    d.define("other", (), lambda: spark.range(1))
    with pytest.raises(KeyError):
        d.get("GRAD")
    d.subscribe("GRAD")
    assert d.stale() == ["GRAD"] and d.get("GRAD").count() == 2 and d.get("GRAD").count() == 2
    assert d.made == {"NORM": 1, "GRAD": 1} and d.stale() == []
    d.subscribe("other")
    d.get("other")
    d.set("IMG", spark.range(10))
    assert d.stale() == ["GRAD"] and d.get("GRAD").count() == 9 and d.made["other"] == 1
    d.subscribe("GRAD")
    d.unsubscribe("GRAD")
    assert d.get("GRAD").count() == 9 and d.made["GRAD"] == 2
    d.unsubscribe("GRAD")
    assert "GRAD" not in d.kept
    with pytest.raises(ValueError):
        d.define("IMG", ("GRAD",), lambda g: g)
    with pytest.raises(KeyError):
        d.subscribe("nothing")
    assert derived.title("GRADPCA") == "Spectral Gradient PCA" and derived.title("?") == "None" and derived.representation("?") is None


def test_text_hashes():
    assert text_hash("") == 5381 and text_hash("a") == 5381 * 33 + 97 and text_hash("", "sdbm") == 0
    assert text_hash("ab", "sdbm") == 97 * 65599 + 98
    assert text_hash("é" * 40) < 1 << 64 and text_hash("x = 1") != text_hash("x = 2")


def test_a_stored_map_is_found_by_input_and_options(spark, sf, tmp_path):
    px = from_embeddings(spark, sf).pixels
    w, trained = som.create_or_load(px, str(tmp_path), side=4, steps=200)
    again, more = som.create_or_load(px.orderBy(F.desc("vec_id")), str(tmp_path), side=4, steps=200)
    assert trained and not more and (w == again).all()
    assert som.create_or_load(px, str(tmp_path), side=4, steps=201)[1] and som.create_or_load(px.filter("vec_id > 0"), str(tmp_path), side=4, steps=200)[1]
    for f in tmp_path.glob("*.map"):
        f.write_bytes(b"broken")
    assert som.create_or_load(px, str(tmp_path), side=4, steps=200)[1]


def test_a_map_as_an_image(spark):
    w = np.arange(32, dtype=float).reshape(16, 2)
    c = som.as_cube(spark, w, 2, 4, 0.0, 31.0)
    got = {(r.y, r.x): r.s for r in c.pixels.collect()}
    assert len(got) == 16 and c.width == 4
    at = som.grid(2, 4)
    assert all(got[b + 2 * e, a + 2 * d] == w[i].tolist() for i, (a, b, d, e) in enumerate(at.tolist()))
    flat = som.as_cube(spark, w[:4], 2, 2, 0.0, 31.0)
    assert [r.s for r in flat.pixels.orderBy("vec_id").collect()] == w[:4].tolist()
