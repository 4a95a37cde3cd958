"""Queries of selection, update, label, histogram, join and window operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from cubeflux.functions import distances as D
from cubeflux.functions import spectral
from cubeflux.model import band_table
from cubeflux.operators import histogram as H
from cubeflux.operators import neighbours as N
from cubeflux.operators import select as S
from cubeflux.shared import numbered, shared_folder
from cubeflux.streaming.kept import KeptHistogram

from .base import ORACLE, P255, PX, SAMPLES, cube, cube255, lineitem_cube, long_form, long_sql, query

ROI_A, ROI_B = S.Rect(3, 2, 10, 8), S.Rect(6, 4, 10, 8)
IN_A, IN_B = "(x >= 3 and x < 13 and y >= 2 and y < 10)", "(x >= 6 and x < 16 and y >= 4 and y < 12)"
R6 = "round({}, 6)"


def _mask(spark, sf, k=7):
    return cube(spark, sf).pixels.filter(F.col("vec_id") % k == 0).select("vec_id")


def _lab(df):
    return df.select("vec_id", F.col("label").cast("int").alias("label"))


@query("p1_band", f"with {PX} select vec_id, round(s[6], 6) as value from px")
def p1(spark, sf):
    return cube(spark, sf).pixels.select("vec_id", F.round(S.band(5), 6).alias("value"))


@query("p2_pixel", long_sql("s", "px").replace("from px)", "from px where y = 3 and x = 4)"))
def p2(spark, sf):
    return long_form(cube(spark, sf).pixels.filter("y = 3 and x = 4"), "s")


@query("p3_roi", f"with {PX} select vec_id, y - 2 as y, x - 3 as x, round(s[1], 6) as v0 from px where {IN_A}")
def p3(spark, sf):
    return S.scope(cube(spark, sf), ROI_A).pixels.select("vec_id", "y", "x", F.round(S.band(0), 6).alias("v0"))


@query("p5_crop", long_sql("s[11:20]"))
def p5(spark, sf):
    return long_form(S.crop(cube(spark, sf), 10, 19).pixels, "s")


@query("p6_segment", f"with {PX}, q as (select vec_id, (row_number() over (order by y, x) - 1)::int as place, s from px where vec_id % 7 = 0) select vec_id, place, unnest(range(len(s)))::int as band, round(unnest(s)::double, 6) as value from q")
def p6(spark, sf):
    found = S.segment(cube(spark, sf), _mask(spark, sf)).select("vec_id", F.col("place").cast("int").alias("place"), F.posexplode("s").alias("band", "value"))
    return found.withColumn("value", F.round("value", 6))


@query("p7_set_pixel", long_sql("case when vec_id = 5 then list_transform(s, lambda v: 0.5) else s end"))
def p7(spark, sf):
    c = cube(spark, sf)
    new = c.pixels.filter("vec_id = 5").select("vec_id", F.transform("s", lambda v: F.lit(0.5)).alias("s"))
    return long_form(S.set_pixels(c, new).pixels, "s")


@query("p8_set_band", f"with {PX}, {SAMPLES} select vec_id, band, round(case when band = 3 and vec_id % 7 = 0 then 9.5 else value end, 6) as value from samples")
def p8(spark, sf):
    c = cube(spark, sf)
    return long_form(S.set_band(c, 3, c.pixels.select("vec_id", F.lit(9.5).alias("value")), _mask(spark, sf)).pixels, "s")


@query("p9_set_segment", f"with {PX}, g as (select vec_id, row_number() over (order by y, x) - 1 as place from px where vec_id % 7 = 0), {SAMPLES} select samples.vec_id, band, round(coalesce(g.place + 0.5, value), 6) as value from samples left join g using (vec_id)")
def p9(spark, sf):
    c = cube(spark, sf)
    values = spark.range(c.pixels.count()).select(F.col("id").alias("place"), F.array_repeat((F.col("id") + 0.5).cast("double"), c.n_bands).alias("s"))
    return long_form(S.set_segment(c, _mask(spark, sf), values).pixels, "s")


@query("p10_fill", long_sql("list_transform(range(64), lambda i: i * 0.25)"))
def p10(spark, sf):
    c = cube(spark, sf)
    return long_form(c.with_spectrum(F.array(*(F.lit(i * 0.25) for i in range(64)))).pixels, "s")


@query("p11_assemble", long_sql("s"))
def p11(spark, sf):
    return long_form(S.from_samples(cube(spark, sf).samples()), "s")


@query("p12_unpivot", f"with {PX}, {SAMPLES} select vec_id, y, x, label, band, round(value, 6) as value from samples")
def p12(spark, sf):
    return cube(spark, sf).samples().withColumn("value", F.round("value", 6))


_POS = "(v + 1.0) / (2.0 / 63)"


@query("p13_bin_mask", f"with {PX} select vec_id from px where floor((s[9] + 1.0) / (2.0 / 63)) = 33")
def p13(spark, sf):
    px = cube(spark, sf).pixels
    return px.filter(F.floor(F.get(spectral.bin_position("s", -1.0, 1.0, 64), F.lit(8))) == 33).select("vec_id")


@query("p14_limits_mask", f"with {PX} select vec_id from px where len(list_filter(s, lambda v: floor({_POS}) < 19 or floor({_POS}) > 44)) = 0")
def p14(spark, sf):
    c = cube(spark, sf)
    return c.pixels.filter(S.limits_mask(spectral.bin_position("s", -1.0, 1.0, 64), [19.0] * 64, [44.0] * 64)).select("vec_id")


@query("p15_limits_update", f"with {PX} select vec_id from px where len(list_filter(s, lambda v: floor({_POS}) < 19 or floor({_POS}) > 44)) = 0 and floor((s[3] + 1.0) / (2.0 / 63)) between 28 and 36")
def p15(spark, sf):
    # an updated mask equals a new one: Spark evaluates the predicate once per row either way
    lo, hi = [19.0] * 64, [44.0] * 64
    lo[2], hi[2] = 28.0, 36.0
    return cube(spark, sf).pixels.filter(S.limits_mask(spectral.bin_position("s", -1.0, 1.0, 64), lo, hi)).select("vec_id")


@query("p16_label_limits", f"with {PX}, l as (select vec_id, label, unnest(range(len(s)))::int as band, unnest(s) as v from px) select band, min(least(greatest(floor({_POS}), 0), 63))::int as lo, max(least(greatest(floor({_POS}), 0), 63))::int as hi from l where label = 3 group by band")
def p16(spark, sf):
    return H.boundary(H.nd_histogram(cube(spark, sf), -1.0, 1.0, 64)).filter("label = 3").select("band", "lo", "hi")


@query("p17_overlay", long_sql("list_transform(s, lambda v: (v + 1.0) / (2.0 / 63))").replace("from px)", "from px where vec_id = 17)"))
def p17(spark, sf):
    return long_form(cube(spark, sf).pixels.filter("vec_id = 17"), spectral.bin_position("s", -1.0, 1.0, 64))


_GRAY = "least(greatest((s[1] + 0.3) * 425, 0), 255)"


def _gray():
    return F.least(F.greatest((S.band(0) + 0.3) * 425, F.lit(0.0)), F.lit(255.0))


@query("p18_seeds", f"with {PX} select vec_id, (case when {_GRAY} > 192 then 1 when {_GRAY} < 64 then 2 else 0 end)::int as seed from px")
def p18(spark, sf):
    return cube(spark, sf).pixels.select("vec_id", S.seeds(_gray()).alias("seed"))


@query("p19_seed_box", f"with {PX} select min(x) as x0, min(y) as y0, max(x) as x1, max(y) as y1 from px where {_GRAY} > 192 or {_GRAY} < 64")
def p19(spark, sf):
    return S.seed_box(cube(spark, sf).pixels, _gray())


@query("p20_label_clear", f"with {PX} select vec_id, case when label = 4 then 0 else label end as label from px")
def p20(spark, sf):
    return _lab(S.alter_label(cube(spark, sf).pixels, 4, None))


@query("p20_label_add", f"with {PX} select vec_id, case when vec_id % 7 = 0 then 4 else label end as label from px")
def p20b(spark, sf):
    return _lab(S.alter_label(cube(spark, sf).pixels, 4, _mask(spark, sf)))


@query("p20_label_remove", f"with {PX} select vec_id, case when vec_id % 7 = 0 and label = 4 then 0 else label end as label from px")
def p20c(spark, sf):
    return _lab(S.alter_label(cube(spark, sf).pixels, 4, _mask(spark, sf), negative=True))


@query("p21_overwrite_labels", f"with {PX} select vec_id, case when vec_id % 7 = 0 then (vec_id % 3)::int else label end as label from px")
def p21(spark, sf):
    new = _mask(spark, sf).select("vec_id", (F.col("vec_id") % 3).cast("int").alias("new_label"))
    return _lab(S.overwrite_labels(cube(spark, sf).pixels, new))


@query("p22_brush", f"with {PX} select vec_id, case when label = 0 then 2 else label end as marked, 2 as marked_over, case when label = 2 then 0 else label end as rubbed, 0 as rubbed_over from px")
def p22(spark, sf):
    o = F.col("label")
    return cube(spark, sf).pixels.select("vec_id", *(S.brush(o, 2, r, v).cast("int").alias(n) for n, r, v in (("marked", False, False), ("marked_over", False, True), ("rubbed", True, False), ("rubbed_over", True, True))))


@query("p23_label_selection", f"with {PX} select vec_id from px where label in (1, 3, 5)")
def p23(spark, sf):
    return cube(spark, sf).pixels.filter(F.col("label").isin(1, 3, 5)).select("vec_id")


@query("p25_outside", f"with {PX} select vec_id from px where {IN_A} except select vec_id from px where {IN_B}")
def p25(spark, sf):
    return cube(spark, sf).pixels.filter(S.in_any(ROI_A.minus(ROI_B))).select("vec_id")


@query("p26_roi_change", f"with {PX} select 'sub' as change, count(*) as n from px where {IN_A} and not {IN_B} union all select 'add', count(*) from px where {IN_B} and not {IN_A}")
def p26(spark, sf):
    sub, add, _ = S.roi_change(ROI_A, ROI_B)
    px = cube(spark, sf).pixels
    return px.filter(S.in_any(sub)).agg(F.lit("sub").alias("change"), F.count("*").alias("n")).union(px.filter(S.in_any(add)).agg(F.lit("add").alias("change"), F.count("*").alias("n")))


@query("p27_flip", f"with {PX} select vec_id, (select max(y) from px) - y as y, 24 - x as x from px")
def p27(spark, sf):
    c = cube(spark, sf)
    height = (c.pixels.agg(F.max("y")).first()[0] or 0) + 1
    return S.flip(c, height, True, True).select("vec_id", "y", "x")


@query("p28_transpose", f"with {PX} select vec_id, x as y, y as x from px")
def p28(spark, sf):
    return cube(spark, sf).pixels.select("vec_id", F.col("x").alias("y"), F.col("y").alias("x"))


@query("p29_band_order", "with b as (select range::int as band, 400.0 + 5 * ((range * 29) % 64) as center, range % 9 = 0 as empty from range(64)) select band, (row_number() over (order by empty desc, center, band) - 1)::int as place from b")
def p29(spark, sf):
    b = band_table(spark).withColumns({"center": 400.0 + 5 * ((F.col("band") * 29) % 64), "empty": F.col("band") % 9 == 0})
    return S.order_bands(b).select("band", "place")


@query("p30_label_roi", f"with {PX} select y - 2 as y, x - 3 as x, label from px where {IN_A}")
def p30(spark, sf):
    return S.scope(cube(spark, sf), ROI_A).pixels.select("y", "x", "label")


@query("p31_label_write", f"with {PX} select vec_id, case when {IN_A} then (label + 1) % 5 else label end as label from px")
def p31(spark, sf):
    px = cube(spark, sf).pixels
    return _lab(S.overwrite_labels(px, px.filter(ROI_A.contains()).select("vec_id", ((F.col("label") + 1) % 5).cast("int").alias("new_label"))))


@query("p32_interleaved", f"with {PX} select y, x, round(list_sum(s), 6) as total, len(s)::int as bands from px")
def p32(spark, sf):
    return S.from_samples(cube(spark, sf).samples()).join(cube(spark, sf).pixels.select("vec_id", "y", "x"), "vec_id").select("y", "x", F.round(F.aggregate("s", F.lit(0.0), lambda a, v: a + v), 6).alias("total"), F.size("s").alias("bands"))


@query("s3_depth_conversion", f"with {PX} select vec_id, round(floor((s[1] + 1) * 127.5) / 255.0 * 255, 6) as from8, round(floor((s[1] + 1) * 32767.5) / 65535.0 * 255, 6) as from16 from px")
def s3(spark, sf):
    from cubeflux.sources.images import from_depth

    v = S.band(0)
    return cube(spark, sf).pixels.select("vec_id", F.round(from_depth(F.floor((v + 1) * 127.5), 8, 0.0, 255.0), 6).alias("from8"), F.round(from_depth(F.floor((v + 1) * 32767.5), 16, 0.0, 255.0), 6).alias("from16"))


@query("s5_raster_semantics", f"with {PX} select vec_id, round(greatest(s[1] * 1000, 0), 6) as value, 512 as top from px where {IN_A}")
def s5(spark, sf):
    from cubeflux.sources.images import raster_semantics

    return raster_semantics(cube(spark, sf), ROI_A, 0, 1000.0).pixels.select("vec_id", F.round(S.band(0), 6).alias("value"), F.col("top").cast("int").alias("top"))


@query("s8_empty_cube", "select (range // 6)::int as y, (range % 6)::int as x, 3 as bands, 0.0::double as total from range(24)")
def s8(spark, sf):
    from cubeflux.sources.images import empty_cube

    px = empty_cube(spark, 4, 6, 3).pixels
    return px.select("y", "x", F.size("s").alias("bands"), F.aggregate("s", F.lit(0.0), lambda a, v: a + v).alias("total"))


@query("s13_label_palette", f"with {PX}, pal(label, b, g, r) as (values (0, 255, 255, 255), (1, 0, 255, 0), (2, 0, 0, 255), (3, 0, 255, 255)) select vec_id, b, g, r from px join pal using (label)")
def s13(spark, sf):
    pal = spark.createDataFrame([(0, 255, 255, 255), (1, 0, 255, 0), (2, 0, 0, 255), (3, 0, 255, 255)], "label int, b int, g int, r int")
    return cube(spark, sf).pixels.join(F.broadcast(pal), "label").select("vec_id", "b", "g", "r")


@query("s14_seed_table", f"with {PX} select vec_id, y, x, case when vec_id % 50 = 0 then 1 else 2 end as seed from px where vec_id % 50 in (0, 7)")
def s14(spark, sf):
    px = cube(spark, sf).pixels
    return px.filter((F.col("vec_id") % 50).isin(0, 7)).select("vec_id", "y", "x", F.when(F.col("vec_id") % 50 == 0, 1).otherwise(2).alias("seed"))


@query("s18_band_gray", f"with {P255} select vec_id, floor(s[1] * 255 / 255.0)::int as gray from p255")
def s18(spark, sf):
    return cube255(spark, sf).pixels.select("vec_id", F.floor(S.band(0) * 255 / 255.0).cast("int").alias("gray"))


@query("s19_rgb_bytes", f"with {PX} select vec_id, floor(abs(s[1]) * 255)::int as r, floor(abs(s[2]) * 255)::int as g from px")
def s19(spark, sf):
    from cubeflux.operators.color import bytes_of

    return cube(spark, sf).pixels.select("vec_id", bytes_of(F.abs(S.band(0))).alias("r"), bytes_of(F.abs(S.band(1))).alias("g"))


@query("s22_band_request", f"with {P255} select 5 as band, '425 nm' as title, vec_id, floor(s[6] * 255 / 255.0)::int as gray from p255")
def s22(spark, sf):
    b = band_table(spark).filter("band = 5").select("band", S.wavelength_label(F.col("range_start"), F.col("range_end"), F.col("empty")).alias("title"))
    return cube255(spark, sf).pixels.join(F.broadcast(b), F.lit(True)).select("band", "title", "vec_id", F.floor(S.band(5)).cast("int").alias("gray"))


# aggregates


@query("a1_data_range", f"with {PX} select round(min(list_min(s)), 6) as lo, round(max(list_max(s)), 6) as hi from px")
def a1(spark, sf):
    return H.data_range(cube(spark, sf).pixels).select(F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"))


@query("a2_robust_range", f"with {PX}, {SAMPLES}, r as (select min(value) as lo, max(value) as hi, count(*) as total from samples), h as (select least(floor((value - lo) / ((hi - lo) / 100)), 99) as bin, count(*) as n from samples, r group by all), c as (select bin, sum(n) over (order by bin) as below, sum(n) over (order by bin desc) as above from h) select round(min(case when below > ceil(total * 0.02) then lo + bin * (hi - lo) / 100 end), 6) as lo, round(max(case when above > ceil(total * 0.02) then lo + (bin + 1) * (hi - lo) / 100 end), 6) as hi from c, r")
def a2(spark, sf):
    return H.robust_range(cube(spark, sf), 0.02).select(F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"))


@query("a3_band_histogram", f"with {PX}, l as (select label, unnest(range(len(s)))::int as band, unnest(s) as v from px) select label, band, least(greatest(floor((v + 1.0) / (2.0 / 63)), 0), 63)::int as bin, count(*) as n from l group by all")
def a3(spark, sf):
    return H.band_histogram(cube(spark, sf), -1.0, 1.0, 64)


_K4 = "array_to_string(list_transform(s[1:4], lambda v: least(greatest(floor((v + 1.0) / (2.0 / 3)), 0), 3)::int), ',')"


def _four(spark, sf):
    return S.crop(cube(spark, sf), 0, 3)


def _hist_out(df):
    return df.select("label", F.array_join(F.transform("key", lambda v: v.cast("string")), ",").alias("key"), "weight", F.round(F.get("sums", F.lit(0)), 6).alias("sum0"))


@query("a3_nd_histogram", f"with {PX} select label, {_K4} as key, count(*) as weight, round(sum(s[1]), 6) as sum0 from px group by all")
def a3n(spark, sf):
    return _hist_out(H.nd_histogram(_four(spark, sf), -1.0, 1.0, 4))


@query("a3_nd_histogram_lineitem", "select case l_returnflag when 'A' then 0 when 'N' then 1 else 2 end as label, concat_ws(',', least(floor(l_quantity / (105000.0 / 15)), 15)::int, least(floor(l_extendedprice / (105000.0 / 15)), 15)::int, least(floor(l_discount / (105000.0 / 15)), 15)::int, least(floor(l_tax / (105000.0 / 15)), 15)::int) as key, count(*) as weight, round(sum(l_quantity), 6) as sum0 from lineitem group by all")
def a3l(spark, sf):
    return _hist_out(H.nd_histogram(lineitem_cube(spark, sf), 0.0, 105000.0, 16))


@query("a4_boundary", f"with {PX}, l as (select label, unnest(range(len(s)))::int as band, unnest(s) as v from px) select label, band, min(least(greatest(floor({_POS}), 0), 63))::int as lo, max(least(greatest(floor({_POS}), 0), 63))::int as hi from l group by all")
def a4(spark, sf):
    return H.boundary(H.nd_histogram(cube(spark, sf), -1.0, 1.0, 64))


@query("a5_bin_means", f"with {PX} select label, {_K4} as key, round(avg(s[1]), 6) as mean0, round(avg(s[4]), 6) as mean3 from px group by all")
def a5(spark, sf):
    b = H.nd_histogram(_four(spark, sf), -1.0, 1.0, 4)
    return b.select("label", F.array_join(F.transform("key", lambda v: v.cast("string")), ",").alias("key"), F.round(F.get("sums", F.lit(0)) / F.col("weight"), 6).alias("mean0"), F.round(F.get("sums", F.lit(3)) / F.col("weight"), 6).alias("mean3"))


def _four_sums(df):
    return df.select("label", F.array_join(F.transform("key", lambda v: v.cast("string")), ",").alias("key"), "weight", *(F.round(F.get("sums", F.lit(i)), 6).alias(f"sum{i}") for i in range(4)))


def _kept(spark, sf):
    return KeptHistogram(_four(spark, sf), shared_folder(spark, "kept"), -1.0, 1.0, 4)


@query("a6_incremental_histogram", f"with {PX} select label, {_K4} as key, count(*) as weight, round(sum(s[1]), 6) as sum0, round(sum(s[2]), 6) as sum1, round(sum(s[3]), 6) as sum2, round(sum(s[4]), 6) as sum3 from px where {IN_B} group by all")
def a6(spark, sf):
    kept = _kept(spark, sf)
    kept.create(ROI_A)
    kept.move(ROI_A, ROI_B)
    return _four_sums(kept.read())


@query("a7_label_update_histogram", f"with {PX} select case when vec_id % 7 = 0 then 4 else label end as label, {_K4} as key, count(*) as weight, round(sum(s[1]), 6) as sum0, round(sum(s[2]), 6) as sum1, round(sum(s[3]), 6) as sum2, round(sum(s[4]), 6) as sum3 from px group by all")
def a7(spark, sf):
    kept = _kept(spark, sf)
    kept.create(S.Rect(0, 0, kept.cube.width, 1 << 30))
    kept.relabel(_mask(spark, sf).withColumn("new_label", F.lit(4)))
    return _four_sums(kept.read())


@query("a8_vertices", f"with {PX}, k as (select distinct label, list_transform(s[1:4], lambda v: least(greatest(floor((v + 1.0) / (2.0 / 3)), 0), 3)::int) as key from px) select label, array_to_string(key, ',') as key, unnest(range(4))::int as band, unnest(key) + 0.5::double as position from k")
def a8(spark, sf):
    v = H.vertices(H.nd_histogram(_four(spark, sf), -1.0, 1.0, 4))
    return v.select("label", F.array_join(F.transform("key", lambda z: z.cast("string")), ",").alias("key"), "band", F.col("position").cast("double").alias("position"))


_SEG = "seg as (select vec_id, (vec_id % 10)::int as segment, s from px)"


@query("a12_segment_statistics", f"with {PX}, g as (select vec_id % 13 as segment, count(*) as n from px group by all) select count(*) as segments, round(avg(n), 6) as mean, round(stddev_pop(n), 6) as deviation from g")
def a12(spark, sf):
    g = cube(spark, sf).pixels.groupBy((F.col("vec_id") % 13).alias("segment")).agg(F.count("*").alias("n"))
    return g.agg(F.count("*").alias("segments"), F.round(F.avg("n"), 6).alias("mean"), F.round(F.stddev_pop("n"), 6).alias("deviation"))


@query("a13_superpixel_points", f"with {PX}, {SAMPLES}, w as (select vec_id % 10 as segment, round(avg(s[2]), 6) as weight from px group by 1), g as (select vec_id % 10 as segment, band, count(*) as size, floor(sum(floor((value + 1) * 32767.5)) / count(*))::bigint as mean, max(vec_id) as window_ from samples group by 1, 2) select g.segment::int as segment, band, size, mean, window_, weight from g join w using (segment)")
def a13(spark, sf):
    c = cube(spark, sf)
    means = F.array(*(F.floor(F.sum(F.floor((S.band(b) + 1) * 32767.5)) / F.count("*")) for b in range(c.n_bands)))
    g = c.pixels.groupBy((F.col("vec_id") % 10).cast("int").alias("segment")).agg(F.count("*").alias("size"), F.max("vec_id").alias("window_"), F.round(F.avg(S.band(1)), 6).alias("weight"), means.alias("means"))
    return g.select("segment", "size", "window_", "weight", F.posexplode("means").alias("band", "mean"))


@query("a14_superpixel_means", f"with {PX}, {SAMPLES}, n as (select vec_id % 13 as segment, count(*) as n from px group by 1), w as (select segment, round(n / avg(n) over (), 6) as weight from n), g as (select vec_id % 13 as segment, band, round(avg(value), 6) as mean from samples group by 1, 2) select g.segment, band, mean, weight from g join w using (segment)")
def a14(spark, sf):
    c = cube(spark, sf)
    g = c.pixels.groupBy((F.col("vec_id") % 13).alias("segment")).agg(F.array(*(F.avg(S.band(b)) for b in range(c.n_bands))).alias("means"), F.count("*").alias("n"))
    weighed = g.withColumn("weight", F.round(F.col("n") / F.avg("n").over(Window.partitionBy(F.lit(1))), 6))
    return weighed.select("segment", "weight", F.posexplode("means").alias("band", "mean")).withColumn("mean", F.round("mean", 6))


@query("a17_label_reindex", f"with {PX}, d as (select distinct label * 10 as v from px union select 0) select v, (dense_rank() over (order by v) - 1)::int as label from d")
def a17(spark, sf):
    d = cube(spark, sf).pixels.select((F.col("label") * 10).alias("v")).union(spark.range(1).select(F.lit(0).alias("v"))).distinct()
    return d.withColumn("label", (F.dense_rank().over(Window.partitionBy(F.lit(1)).orderBy("v")) - 1).cast("int"))


@query("a18_colour_labels", f"with {PX}, c as (select distinct label % 3 as b, label % 2 as g, label as r from px) select b, g, r, (dense_rank() over (order by b, g, r) - 1)::int as label from c")
def a18(spark, sf):
    c = cube(spark, sf).pixels.select((F.col("label") % 3).alias("b"), (F.col("label") % 2).alias("g"), F.col("label").alias("r")).distinct()
    return c.withColumn("label", (F.dense_rank().over(Window.partitionBy(F.lit(1)).orderBy("b", "g", "r")) - 1).cast("int"))


@query("a19_binary_labels", f"with {PX} select vec_id, (greatest(s[1], s[2], s[3]) > 0)::int as label from px")
def a19(spark, sf):
    return cube(spark, sf).pixels.select("vec_id", (F.greatest(S.band(0), S.band(1), S.band(2)) > 0).cast("int").alias("label"))


@query("a20_consolidate", f"with {PX}, p as (select distinct label from px where label in (2, 5, 7)), r as (select label, row_number() over (order by label) as n from p) select vec_id, coalesce(n, 0)::int as label from px left join r using (label)")
def a20(spark, sf):
    px = cube(spark, sf).pixels.withColumn("label", F.when(F.col("label").isin(2, 5, 7), F.col("label")).otherwise(0))
    return _lab(S.consolidate(px))


@query("a21_merge_labels", f"with {PX} select vec_id, case when label in (3, 6, 8) then 3 else label end as label from px")
def a21(spark, sf):
    return _lab(S.merge_labels(cube(spark, sf).pixels, [8, 3, 6]))


@query("a22_label_count", f"with {PX} select (max(label) + 1)::int as labels from px")
def a22(spark, sf):
    return cube(spark, sf).pixels.agg((F.max("label") + 1).cast("int").alias("labels"))


@query("a25_memory_estimate", f"with {PX} select ((max(y) + 1) * 25 * 64 * 4)::bigint as cube_bytes, ((max(y) + 1) * 25 * 63 * 4)::bigint as gradient_bytes from px")
def a25(spark, sf):
    h = F.max("y") + 1
    return cube(spark, sf).pixels.agg((h * 25 * 64 * 4).cast("long").alias("cube_bytes"), (h * 25 * 63 * 4).cast("long").alias("gradient_bytes"))


# neighbourhoods

_E4 = "e as (select a.vec_id as u, b.vec_id as v, a.s as su, b.s as sv from px a join px b on (a.y = b.y and a.x + 1 = b.x) or (a.x = b.x and a.y + 1 = b.y))"
_E8 = "e as (select a.vec_id as u, b.vec_id as v, a.s as su, b.s as sv from px a join px b on (a.y = b.y and a.x + 1 = b.x) or (a.x = b.x and a.y + 1 = b.y) or (a.y + 1 = b.y and a.x + 1 = b.x) or (a.y - 1 = b.y and a.x + 1 = b.x))"
_W = ", l as (select u, v, unnest(su) as a, unnest(sv) as b from e), w as (select u, v, sqrt(sum((a - b) * (a - b))) as weight from l group by u, v)"


@query("j1_edges4", f"with {PX}, {_E4} select u, v from e")
def j1(spark, sf):
    return N.edges(cube(spark, sf).pixels).select("u", "v")


@query("j2_standard_weights", f"with {PX}, {_E4}{_W} select u, v, round(255 - weight * 255 / (select max(weight) from w), 6) as weight from w")
def j2(spark, sf):
    return N.standard_weights(N.weighted(N.edges(cube(spark, sf).pixels), D.euclidean)).withColumn("weight", F.round("weight", 6))


@query("j3_edges8", f"with {PX}, {_E8}{_W} select u, v, round(weight, 6) as weight from w")
def j3(spark, sf):
    return N.weighted(N.edges(cube(spark, sf).pixels, N.EIGHT), D.euclidean).withColumn("weight", F.round("weight", 6))


@query("m25_positioned_measure", f"with {PX}, {_E8}{_W} select w.u, w.v, round(w.weight + 0.1::double * sqrt(((a.y - b.y) * (a.y - b.y) + (a.x - b.x) * (a.x - b.x))::double), 6) as weight from w join px a on a.vec_id = w.u join px b on b.vec_id = w.v")
def m25(spark, sf):
    return N.weighted_at(N.placed_pairs(cube(spark, sf).pixels), D.spatial(D.euclidean, 0.1)).withColumn("weight", F.round("weight", 6))


@query("a11_equalised_weights", f"with {PX}, {_E8}{_W}, b as (select u, v, least(ceil(weight * 19999 / (select max(weight) from w) + 0.5), 19999)::int as bin from w), c as (select bin, count(*) as n from b group by bin), d as (select bin, sum(n) over (order by bin) * 19999 / (2.0 * (select count(*) from b)) as cdf from c) select u, v, round(cdf, 6) as weight from b join d using (bin)")
def a11(spark, sf):
    return N.equalised(N.weighted(N.edges(cube(spark, sf).pixels, N.EIGHT), D.euclidean)).withColumn("weight", F.round("weight", 6))


@query("t29_edge_neighbours", f"with {PX}, {_E4}, b as (select u as n, u, v from e union all select v, u, v from e) select n as node, count(*) as edges from b group by n")
def t29(spark, sf):
    e = N.edges(cube(spark, sf).pixels)
    return e.select(F.explode(F.array("u", "v")).alias("node")).groupBy("node").agg(F.count("*").alias("edges"))


@query("t30_weight_buckets", f"with {PX}, {_E4}{_W} select u, v, floor(weight / ((select max(weight) from w) / 250))::int as bucket from w")
def t30(spark, sf):
    e = N.weighted(N.edges(cube(spark, sf).pixels), D.euclidean)
    return N.with_top(e).select("u", "v", F.floor(F.col("weight") / (F.col("top") / 250)).cast("int").alias("bucket"))


@query("o1_sorted_edges", f"with {PX}, {_E8}{_W} select u, v, (row_number() over (order by round(weight, 9), u, v) - 1)::int as place from w")
def o1(spark, sf):
    e = N.weighted(N.edges(cube(spark, sf).pixels, N.EIGHT), D.euclidean)
    w = F.round("weight", 9)
    return numbered(e, "place", w, "u", "v").select("u", "v", F.col("place").cast("int").alias("place"))


@query("o2_sorted_edges_descending", f"with {PX}, {_E4}{_W} select u, v, (row_number() over (order by round(weight, 9) desc, u desc, v desc) - 1)::int as place from w")
def o2(spark, sf):
    e = N.weighted(N.edges(cube(spark, sf).pixels), D.euclidean)
    w = -F.round("weight", 9)
    return numbered(e, "place", w, -F.col("u"), -F.col("v")).select("u", "v", F.col("place").cast("int").alias("place"))


@query("o6_start_points", f"with {PX} select vec_id from px where vec_id % 5 = 0")
def o6(spark, sf):
    return cube(spark, sf).pixels.filter(F.col("vec_id") % 5 == 0).select("vec_id")


@query("o8_shuffle")
def o8(spark, sf):
    px = cube(spark, sf).pixels
    h = F.xxhash64("vec_id", F.lit(42))
    return numbered(px, "place", h, "vec_id").select("vec_id", (F.col("place") + 1).cast("int").alias("place"))


_NEU = "neurons as (select (vec_id // 31)::int as idx, s as w from px where vec_id % 31 = 0 and vec_id < 496)"
_NEAR = f"with {PX}, {_NEU}, l as (select p.vec_id, n.idx, unnest(p.s) as a, unnest(n.w) as b from px p, neurons n), d as (select vec_id, idx, round(sqrt(sum((a - b) * (a - b))), 9) as dist from l group by all), r as (select vec_id, idx, dist, (row_number() over (partition by vec_id order by dist, idx) - 1)::int as rank from d)"


def _neurons(spark, sf):
    return cube(spark, sf).pixels.filter("vec_id % 31 = 0 and vec_id < 496").select(F.expr("cast(vec_id div 31 as int)").alias("idx"), F.col("s").alias("w"))


def _near(spark, sf, n):
    return N.nearest(cube(spark, sf).pixels, _neurons(spark, sf), n, D.euclidean)


@query("j7_best_match", f"{_NEAR} select vec_id, idx, round(dist, 6) as dist from r where rank = 0")
def j7(spark, sf):
    return _near(spark, sf, 1).select("vec_id", "idx", F.round("dist", 6).alias("dist"))


@query("j8_nearest_neurons", f"{_NEAR} select vec_id, rank, idx, round(dist, 6) as dist from r where rank < 3")
def j8(spark, sf):
    return _near(spark, sf, 3).withColumn("dist", F.round("dist", 6))


@query("o4_top_n", f"{_NEAR} select vec_id, rank, idx from r where rank < 5")
def o4(spark, sf):
    return _near(spark, sf, 5).select("vec_id", "rank", "idx")


@query("a15_neuron_influence", f"{_NEAR}, c as (select idx, count(*) as n from r where rank = 0 group by idx), a as (select neurons.idx, coalesce(n, 0) as n from neurons left join c using (idx)) select idx, round(n / avg(n) over (), 6) as influence from a")
def a15(spark, sf):
    c = _near(spark, sf, 1).groupBy("idx").agg(F.count("*").alias("n"))
    a = _neurons(spark, sf).select("idx").join(c, "idx", "left").na.fill(0)
    return a.select("idx", F.round(F.col("n") / F.avg("n").over(Window.partitionBy(F.lit(1))), 6).alias("influence"))


@query("j6_map_result", f"{_NEAR} select vec_id, (idx % 3 + 1)::int as label from r where rank = 0")
def j6(spark, sf):
    result = _neurons(spark, sf).select("idx", (F.col("idx") % 3 + 1).cast("int").alias("label"))
    return _near(spark, sf, 1).join(F.broadcast(result), "idx").select("vec_id", "label")


@query("m21_map_distance", f"{_NEAR}, b as (select vec_id, (idx % 4) / 3.0 as cx, (idx // 4) / 3.0 as cy from r where rank = 0) select a.vec_id, round(sqrt(pow(a.cx - z.cx, 2) + pow(a.cy - z.cy, 2)), 6) as distance from b a, (select * from b where vec_id = 0) z")
def m21(spark, sf):
    cx, cy = spectral.som_coordinate(F.col("idx"), 4, 2)
    b = _near(spark, sf, 1).select("vec_id", F.array(cx, cy).alias("c"))
    z = b.filter("vec_id = 0").select(F.col("c").alias("z"))
    return b.join(F.broadcast(z), F.lit(True)).select("vec_id", F.round(D.euclidean(F.col("c"), F.col("z")), 6).alias("distance"))


_G = [16 / 31, 8 / 31, 4 / 31, 2 / 31, 1 / 31]


@query("i25_map_false_colour", f"{_NEAR} select vec_id, round(sum(pow(2, 4 - rank) / 31 * (idx % 4) / 3.0), 6) as r, round(sum(pow(2, 4 - rank) / 31 * (idx // 4) / 3.0), 6) as g from r where rank < 5 group by vec_id")
def i25(spark, sf):
    cx, cy = spectral.som_coordinate(F.col("idx"), 4, 2)
    w = F.get(F.array(*map(F.lit, spectral.geometric_weights(5))), F.col("rank"))
    return _near(spark, sf, 5).groupBy("vec_id").agg(F.round(F.sum(w * cx), 6).alias("r"), F.round(F.sum(w * cy), 6).alias("g"))


def _edge_sql() -> str:
    off = {"nw": (-1, -1), "n": (-1, 0), "ne": (-1, 1), "w": (0, -1), "e": (0, 1), "sw": (1, -1), "so": (1, 0), "se": (1, 1)}
    joins = " ".join(f"join c {k} on {k}.y = m.y + {dy} and {k}.x = m.x + {dx}" for k, (dy, dx) in off.items())
    d = []
    for a in ("cx", "cy"):
        d.append(f"0.25*(nw.{a}-2*w.{a}-sw.{a}) as w{a}, 0.25*(ne.{a}-2*e.{a}-se.{a}) as e{a}, 0.25*(nw.{a}-2*n.{a}-ne.{a}) as n{a}, 0.25*(sw.{a}-2*so.{a}-se.{a}) as s{a}")
    return f"{_NEAR}, c as (select px.vec_id, y, x, (idx % 4) / 3.0 as cx, (idx // 4) / 3.0 as cy from r join px using (vec_id) where rank = 0), g as (select m.vec_id, {', '.join(d)} from c m {joins}) select vec_id, round(sqrt(pow(wcx-ecx,2)+pow(wcy-ecy,2)) * (case when sqrt(ecx*ecx+ecy*ecy) > sqrt(wcx*wcx+wcy*wcy) + 1e-9 then -1 else 1 end), 6) as dx, round(sqrt(pow(ncx-scx,2)+pow(ncy-scy,2)) * (case when sqrt(scx*scx+scy*scy) > sqrt(ncx*ncx+ncy*ncy) + 1e-9 then -1 else 1 end), 6) as dy from g"


@query("i23_edge_detection", _edge_sql())
def i23(spark, sf):
    from cubeflux.operators.som import edge_detection

    cx, cy = spectral.som_coordinate(F.col("idx"), 4, 2)
    c = _near(spark, sf, 1).select("vec_id", F.array(cx, cy).alias("c")).join(cube(spark, sf).pixels.select("vec_id", "y", "x"), "vec_id")
    return edge_detection(c).select("vec_id", F.round("dx", 6).alias("dx"), F.round("dy", 6).alias("dy"))


@query("j4_label_colour", f"with {PX}, pal as (select range::int as label, (range * 20)::int as shade from range(10)) select vec_id, shade from px join pal using (label)")
def j4(spark, sf):
    pal = spark.range(10).select(F.col("id").cast("int").alias("label"), (F.col("id") * 20).cast("int").alias("shade"))
    return cube(spark, sf).pixels.join(F.broadcast(pal), "label").select("vec_id", "shade")


@query("j5_superpixel_result", f"with {PX} select vec_id, ((vec_id % 13) % 4 + 1)::int as label from px")
def j5(spark, sf):
    px = cube(spark, sf).pixels.select("vec_id", (F.col("vec_id") % 13).alias("segment"))
    result = px.select("segment").distinct().withColumn("label", (F.col("segment") % 4 + 1).cast("int"))
    return px.join(result, "segment").select("vec_id", "label")


_Q16 = "qz as (select vec_id, list_transform(s, lambda v: floor((v + 1) * 65535 / 2)) as s from px)"
_L1 = f"with {PX}, {_Q16}, st as (select vec_id, s from qz where vec_id % 50 = 0), l as (select a.vec_id as start, b.vec_id as id, unnest(a.s) as a, unnest(b.s) as b from st a, qz b), d as (select start, id, sum(abs(a - b)) as dist from l group by all)"

_L1_ALL = _L1.replace(" where vec_id % 50 = 0", "")


def _starts(spark, sf):
    px = cube(spark, sf).pixels.withColumn("s", spectral.quantise("s", -1.0, 1.0))
    return px, px.filter(F.col("vec_id") % 50 == 0)


@query("j9_pilot_density", f"{_L1_ALL}, c as (select start, least(floor(dist / 640), 699)::int as cell, count(*) as n from d group by all), k as (select start, cell, sum(n) over (partition by start order by cell) as below from c), w as (select start, min(cell) as cell from k where below > (select floor(sqrt(count(*))) from qz) group by start) select start as vec_id, ((cell + 1) * 640)::bigint as window_ from w")
def j9(spark, sf):
    from cubeflux.operators.meanshift import neighbour_threshold, pilot_windows

    px, _ = _starts(spark, sf)
    return pilot_windows(px, px, k=neighbour_threshold(px.count()), n_bands=64)


@query("j10_mean_shift_step", f"{_L1_ALL}, w as (select start, id, (1 - dist / 400000.0) * (1 - dist / 400000.0) as w from d where dist < 400000) select w.start as vec_id, count(*) as members, floor(sum(w.w * qz.s[1]) / sum(w.w) + 1e-6)::bigint as mean0 from w join qz on qz.vec_id = w.id group by w.start")
def j10(spark, sf):
    from cubeflux.operators.meanshift import shift_step

    px, _ = _starts(spark, sf)
    return shift_step(px, px, 400000.0, slice(0, 1)).select("vec_id", "members", F.floor(F.get("mean", F.lit(0)) + 1e-6).alias("mean0"))


query("j9_pilot_density_all", ORACLE["j9_pilot_density"])(j9)


@query("a24_pilot_averages", f"{_L1_ALL}, c as (select start, least(floor(dist / 640), 699)::int as cell, count(*) as n from d group by all), k as (select start, cell, sum(n) over (partition by start order by cell) as below from c), w as (select start, min(cell) as cell from k where below > (select floor(sqrt(count(*))) from qz) group by start) select round(avg((cell + 1) * 640), 6) as window_, ((select count(*) from qz) - count(*))::bigint as without from w")
def a24(spark, sf):
    from cubeflux.operators.meanshift import pilot_averages

    px, _ = _starts(spark, sf)
    return pilot_averages(px, n_bands=64).withColumn("window_", F.round("window_", 6))


query("j10_mean_shift_step_all", ORACLE["j10_mean_shift_step"])(j10)


@query("j11_nearest_mode", f"{_L1}, r as (select id, start, row_number() over (partition by id order by dist, start) as k from d) select id as vec_id, start as mode from r where k = 1")
def j11(spark, sf):
    from cubeflux.operators.meeting import nearest

    px, st = (p.withColumn("s", F.col("s").cast("array<double>")) for p in _starts(spark, sf))
    return nearest(px, st).select("vec_id", F.col("other").alias("mode"))


@query("j12_neighbourhood", f"with {PX} select a.vec_id, count(*) as neighbours, round(sum(b.s[1]), 6) as total from px a join px b on abs(a.y - b.y) <= 1 and abs(a.x - b.x) <= 1 and a.vec_id <> b.vec_id group by a.vec_id having count(*) = 8")
def j12(spark, sf):
    e = N.edges(cube(spark, sf).pixels, tuple((dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if dy or dx))
    return e.groupBy(F.col("u").alias("vec_id")).agg(F.count("*").alias("neighbours"), F.round(F.sum(F.get("sv", F.lit(0))), 6).alias("total")).filter("neighbours = 8")


@query("j13_band_lookup", f"with {PX}, {SAMPLES} select vec_id, band, 400.0::double + 5 * band as center from samples")
def j13(spark, sf):
    return cube(spark, sf).samples().join(F.broadcast(band_table(spark).select("band", "center")), "band").select("vec_id", "band", "center")


query("j13_band_lookup_all", ORACLE["j13_band_lookup"])(j13)


_CUTS = ((3, 0.0), (11, 0.02), (27, -0.02), (40, 0.01)), ((1, 0.01), (20, 0.0), (33, 0.02), (50, -0.01))
_LSH = ", ".join(f"(select vec_id, {t} as t, concat({', '.join(f'(s[{d + 1}] > {v})::int' for d, v in c)}) as h from px)" for t, c in enumerate(_CUTS)).replace("), (select", ") union all (select")


@query("j14_lsh_candidates", f"with {PX}, h as ({_LSH}) select distinct a.vec_id as query, b.vec_id as candidate from h a join h b using (t, h)")
def j14(spark, sf):
    from cubeflux.operators.lsh import pairs

    px = cube(spark, sf).pixels
    return pairs(px, px, _CUTS)


query("j14_lsh_candidates_all", ORACLE["j14_lsh_candidates"])(j14)


@query("o7_largest_buckets", f"with {PX}, h as ({_LSH}) select t, h, count(*) as n from h group by all having count(*) > 0.1 * (select count(*) from px)")
def o7(spark, sf):
    from cubeflux.operators.lsh import hashed, largest_buckets

    px = cube(spark, sf).pixels
    return largest_buckets(hashed(px, _CUTS), px.count(), 0.1)


@query("j15_similarity_image", f"with {PX}, l as (select p.vec_id, unnest(p.s) as a, unnest(r.s) as b from px p, (select s from px where y = 2 and x = 3) r) select vec_id, round(-sqrt(sum((a - b) * (a - b))), 6) as similarity from l group by vec_id")
def j15(spark, sf):
    px = cube(spark, sf).pixels
    ref = px.filter("y = 2 and x = 3").select(F.col("s").alias("r"))
    return px.join(F.broadcast(ref), F.lit(True)).select("vec_id", F.round(-D.euclidean(F.col("s"), F.col("r")), 6).alias("similarity"))


@query("j16_mask_restriction", f"with {PX} select vec_id, label from px where vec_id in (select vec_id from px where vec_id % 7 = 0)")
def j16(spark, sf):
    return cube(spark, sf).pixels.join(_mask(spark, sf), "vec_id", "left_semi").select("vec_id", "label")


@query("j17_region_exclusion", f"with {PX} select vec_id from px where not {IN_A}")
def j17(spark, sf):
    px = cube(spark, sf).pixels
    return px.join(px.filter(ROI_A.contains()).select("vec_id"), "vec_id", "left_anti").select("vec_id")


# windows and sets


@query("w1_adjacent_difference", f"with {PX}, {SAMPLES}, d as (select vec_id, band, value - lag(value) over (partition by vec_id order by band) as value from samples) select vec_id, band, round(value, 6) as value from d where value is not null")
def w1(spark, sf):
    d = F.col("value") - F.lag("value").over(Window.partitionBy("vec_id").orderBy("band"))
    return cube(spark, sf).samples().select("vec_id", "band", F.round(d, 6).alias("value")).filter("value is not null")


@query("w2_cumulative_histogram", f"with {PX}, b as (select floor((s[1] + 1) * 50)::int as bin, count(*) as n from px group by all) select bin, (sum(n) over (order by bin))::bigint as below, (sum(n) over (order by bin desc))::bigint as above from b")
def w2(spark, sf):
    b = cube(spark, sf).pixels.groupBy(F.floor((S.band(0) + 1) * 50).cast("int").alias("bin")).agg(F.count("*").alias("n"))
    one = Window.partitionBy(F.lit(1))
    return b.select("bin", F.sum("n").over(one.orderBy("bin")).alias("below"), F.sum("n").over(one.orderBy(F.desc("bin"))).alias("above"))


@query("w3_cdf", f"with {PX}, b as (select floor((s[2] + 1) * 50)::int as bin, count(*) as n from px group by all) select bin, round(sum(n) over (order by bin) / sum(n) over (), 6) as cdf from b")
def w3(spark, sf):
    b = cube(spark, sf).pixels.groupBy(F.floor((S.band(1) + 1) * 50).cast("int").alias("bin")).agg(F.count("*").alias("n"))
    one = Window.partitionBy(F.lit(1))
    return b.select("bin", F.round(F.sum("n").over(one.orderBy("bin")) / F.sum("n").over(one), 6).alias("cdf"))


@query("w5_segment_numbering", f"with {PX}, f as (select vec_id, label, min(vec_id) over (partition by label) as first from px) select vec_id, (dense_rank() over (order by first) - 1)::int as segment from f")
def w5(spark, sf):
    px = cube(spark, sf).pixels
    first = px.groupBy("label").agg(F.min("vec_id").alias("first"))
    numbered = first.withColumn("segment", (F.dense_rank().over(Window.partitionBy(F.lit(1)).orderBy("first")) - 1).cast("int"))
    return px.join(F.broadcast(numbered), "label").select("vec_id", "segment")


@query("w6_mode_ranking", f"with {PX}, m as (select label as mode, count(*) as members from px group by label), r as (select *, row_number() over (order by members desc, mode) as k from m) select mode, members from r where k = 1 or (members >= 50 and k <= 5)")
def w6(spark, sf):
    m = cube(spark, sf).pixels.groupBy(F.col("label").alias("mode")).agg(F.count("*").alias("members"))
    k = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("members"), "mode"))
    return m.withColumn("k", k).filter("k = 1 or (members >= 50 and k <= 5)").select("mode", "members")


@query("u1_intersection", f"with {PX} select vec_id from px where {IN_A} intersect select vec_id from px where {IN_B}")
def u1(spark, sf):
    return cube(spark, sf).pixels.filter(ROI_A.meet(ROI_B).contains()).select("vec_id")


@query("u2_difference", f"with {PX} select vec_id from px where {IN_B} except select vec_id from px where {IN_A}")
def u2(spark, sf):
    px = cube(spark, sf).pixels
    return px.filter(ROI_B.contains()).select("vec_id").exceptAll(px.filter(ROI_A.contains()).select("vec_id"))


@query("u3_mask_union", f"with {PX} select vec_id from px where vec_id % 7 = 0 union select vec_id from px where label = 3")
def u3(spark, sf):
    return _mask(spark, sf).union(cube(spark, sf).pixels.filter("label = 3").select("vec_id")).distinct()


@query("u5_bag_difference", f"with {PX} select label from px except all select label from px where vec_id % 7 = 0")
def u5(spark, sf):
    px = cube(spark, sf).pixels
    return px.select("label").exceptAll(px.filter(F.col("vec_id") % 7 == 0).select("label"))


@query("str_wavelength_label", "with b as (select range::int as band, 400.0 + 5 * range as a, 400.0 + 5 * range + (range % 2) * 4 as z, range % 9 = 0 as empty from range(64)) select band, case when empty then '' when a = z then a::int || ' nm' else a::int || ' nm - ' || z::int || ' nm' end as title from b")
def str1(spark, sf):
    b = band_table(spark).withColumns({"range_end": F.col("range_start") + (F.col("band") % 2) * 4, "empty": F.col("band") % 9 == 0})
    return b.select("band", S.wavelength_label(F.col("range_start"), F.col("range_end"), F.col("empty")).alias("title"))


@query("str_float_prefix", "select range::int as k, try_cast(nullif(regexp_extract(range || '.5 nm band', '^[0-9]+(\\.[0-9]+)?'), '') as double) as value from range(5)")
def str2(spark, sf):
    t = F.concat(F.col("id").cast("string"), F.lit(".5 nm band"))
    return spark.range(5).select(F.col("id").cast("int").alias("k"), F.regexp_extract(t, r"^[0-9]+(\.[0-9]+)?", 0).cast("double").alias("value"))
