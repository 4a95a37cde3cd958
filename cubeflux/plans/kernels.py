"""Queries of iterative operators and of the change stream."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from cubeflux.functions import distances as D
from cubeflux.functions import spectral
from cubeflux.operators import forest, meanshift, pca, regions, segmentation, shifting, som, walker
from cubeflux.operators import neighbours as N
from cubeflux.shared import shared_folder
from cubeflux.streaming import histogram as stream

from .base import cube, query


@query("r2_change_histogram", "with c as (select event_type as label, value, 1 as op from events union all select event_type, value, -1 from events where event_id % 10 = 3) select label, least(greatest(floor(value / (500.0 / 63)), 0), 63)::int as bin, sum(op)::bigint as weight, round(sum(op * value), 4) as total from c group by all")
def r2(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    return stream.histogram(stream.changes_of_events(e), 0.0, 500.0, 64).withColumn("total", F.round("total", 4))


@query("a9_pca_variances")
def a9(spark, sf):
    _, _, values = pca.fit(cube(spark, sf), 10)
    return spark.createDataFrame([(i, float(round(v, 9))) for i, v in enumerate(values)], "component int, variance double")


@query("a10_pca_projection")
def a10(spark, sf):
    c = cube(spark, sf)
    mean, rows, _ = pca.fit(c, 3)
    return c.pixels.select("vec_id", F.transform(pca.project("s", mean, rows), lambda v: F.round(v, 6)).alias("coordinates"))


@query("t24_pca_back_projection")
def t24(spark, sf):
    c = cube(spark, sf)
    mean, rows, _ = pca.fit(c)
    return c.pixels.select("vec_id", F.round(D.chebyshev(F.col("s"), pca.back_project(pca.project("s", mean, rows), mean, rows)), 6).alias("error"))


@query("i24_pca_false_colour")
def i24(spark, sf):
    out = pca.false_colour(cube(spark, sf))
    return out.select("vec_id", *(F.round(n, 6).alias(n) for n in "rgb"))


@query("i1_som_training")
def i1(spark, sf):
    w = som.fit(cube(spark, sf).pixels, 2000, side=8)
    return som.neurons(spark, w)


def _edges(spark, sf, offsets, measure=D.euclidean):
    px = cube(spark, sf).pixels
    return px.count(), N.weighted(N.edges(px, offsets), measure)


def _labels(spark, labels: np.ndarray):
    return spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(len(labels)), "label": labels.astype(np.int32)}), "vec_id long, label int")


def _superpixels(px, measure):
    return regions.superpixels(px, N.equalised(N.weighted(N.edges(px, N.EIGHT), measure)), c=0.05, min_size=5)


@query("i4_map_store")
def i4(spark, sf):
    """The map that a second call finds stored, as an image."""
    px, folder = cube(spark, sf).pixels, shared_folder(spark, "maps")
    som.create_or_load(px, folder, side=6, steps=1000)
    w, trained = som.create_or_load(px, folder, side=6, steps=1000)
    return som.as_cube(spark, w, 6, 2, -1.0, 1.0).pixels.select("vec_id", "y", "x", F.transform("s", lambda v: F.round(v, 6)).alias("s"), F.lit(trained).alias("trained"))


@query("i12_superpixels")
def i12(spark, sf):
    return _superpixels(cube(spark, sf).pixels, D.euclidean)


def _seeds(px):
    return px.filter("vec_id % 50 in (0, 7)").select("vec_id", F.when(F.col("vec_id") % 50 == 0, 1).otherwise(2).alias("label"))


def _forest(spark, sf):
    px = cube(spark, sf).pixels
    return forest.seeded_forest(N.standard_weights(N.weighted(N.edges(px, N.EAST_SOUTH), D.euclidean)), _seeds(px))


# one forest, found from the seeds or from the strongest edges alike
query("i13_prim")(_forest)
query("i14_kruskal")(_forest)


@query("i16_random_walker")
def i16(spark, sf):
    c = cube(spark, sf)
    e = N.standard_weights(N.weighted(N.edges(c.pixels, N.EAST_SOUTH), D.euclidean))
    found = walker.random_walker(e, _seeds(c.pixels), walker.tiles(c.width))
    return found.select("vec_id", "label", F.transform("probabilities", lambda p: F.round(p, 6)).alias("probabilities"))


def _seeded(algorithm, geodesic=False):
    def run(spark, sf):
        n, e = _edges(spark, sf, N.EAST_SOUTH)
        u, v, w = segmentation.sorted_edges(N.standard_weights(e))
        seeds = {i: 1 if i % 50 == 0 else 2 for i in range(n) if i % 50 in (0, 7)}
        return _labels(spark, segmentation.seeded(n, u, v, w, seeds, algorithm, geodesic))

    return run


query("i15_power_watershed")(_seeded("WATERSHED2"))
query("i17_geodesic_watershed")(_seeded("WATERSHED2", True))


@query("i7_mean_shift")
def i7(spark, sf):
    px = cube(spark, sf).pixels.withColumn("s", spectral.quantise("s", -1.0, 1.0)).withColumn("s", F.transform("s", lambda v: v.cast("double")))
    return meanshift.segment(px, k=meanshift.neighbour_threshold(px.count()))[0]


@query("i21_mean_shift_index")
def i21(spark, sf):
    px = cube(spark, sf).pixels.select("vec_id", F.transform(spectral.quantise("s", -1.0, 1.0), lambda v: v.cast("double")).alias("s"))
    return shifting.segment(px, meanshift.neighbour_threshold(px.count()), tables=4, bits=2, exact=True)


@query("i10_mean_shift_superpixels")
def i10(spark, sf):
    segment = i12(spark, sf).withColumnRenamed("label", "segment")
    px = cube(spark, sf).pixels.join(segment, "vec_id")
    means = px.groupBy("segment").agg(F.array(*(F.floor((F.avg(F.get("s", F.lit(i))) + 1) * 32767.5).cast("double") for i in range(64))).alias("s"), F.count("*").alias("size"))
    means = means.withColumn("vec_id", F.col("segment").cast("long")).cache()
    labels, _ = meanshift.segment(means.select("vec_id", "s"), k=meanshift.neighbour_threshold(means.count()), sizes=means.select("vec_id", "size"))
    return segment.join(labels.select(F.col("vec_id").alias("segment"), F.col("label").alias("found")), "segment").select("vec_id", F.col("found").alias("label"))


@query("i11_mean_shift_map")
def i11(spark, sf):
    c = cube(spark, sf)
    w = som.fit(c.pixels, 2000, side=6)
    pts = som.neurons(spark, np.floor((w + 1) * 32767.5)).select(F.col("idx").cast("long").alias("vec_id"), F.col("w").alias("s"))
    near = N.nearest(c.pixels, som.neurons(spark, w), 1, D.euclidean)
    influence = near.groupBy(F.col("idx").cast("long").alias("vec_id")).agg(F.count("*").alias("size"))
    labels, _ = meanshift.segment(pts, k=meanshift.neighbour_threshold(pts.count()), sizes=influence)
    return near.join(labels.select(F.col("vec_id").alias("idx"), "label"), "idx").select("vec_id", "label")


def _presets(method):
    def run(spark, sf):
        c = cube(spark, sf)
        pixels = meanshift.PRESETS[method]["starts"] == "pixels"  # they need no superpixels
        segment = None if pixels else _superpixels(c.pixels, D.information_divergence).withColumnRenamed("label", "segment")
        points = c.pixels.select("vec_id", F.transform(spectral.quantise("s", -1.0, 1.0), lambda v: v.cast("double")).alias("s"))
        return meanshift.cluster(points, method, segment)

    return run


for _m in meanshift.PRESETS:
    query(f"i26_{_m.lower()}")(_presets(_m))


@query("i22_lsh_tuning")
def i22(spark, sf):
    from cubeflux.operators import lsh

    px = cube(spark, sf).pixels
    k, t, n = lsh.tune(px, (4, 8), (2, 4, 8), [-0.2] * 64, [0.2] * 64, lsh.bounded_sample(px, 40), 3, epsilon=0.5)
    return spark.createDataFrame([(k, t, n)], "k int, tables int, candidates double")
