"""Queries of the transforms, distances and colour operators."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from cubeflux.functions import cie, spectral
from cubeflux.functions import distances as D
from cubeflux.model import band_table
from cubeflux.operators import color, histogram

from .base import ORACLE, P255, PX, cube, cube255, long_form, long_sql, query


@query("t1_rescale", long_sql("list_transform(s, lambda v: (v + 1.0) * 255.0 / 2.0 + 0.0)"))
def t1(spark, sf):
    return long_form(cube255(spark, sf).pixels, "s")


@query("t2_stretch", f"with {PX}, r as (select min(list_min(s)) as lo, max(list_max(s)) as hi from px), l as (select vec_id, unnest(range(len(s)))::int as band, unnest(s) as v from px) select vec_id, band, round((v - lo) * 2.0 / (hi - lo) - 1.0, 6) as value from l, r")
def t2(spark, sf):
    c = cube(spark, sf)
    r = histogram.data_range(c.pixels)
    return long_form(c.pixels.join(F.broadcast(r), F.lit(True)), spectral.rescale_between("s", F.col("lo"), F.col("hi"), -1.0, 1.0))


@query("t3_stretch_bands", f"with {PX}, l as (select vec_id, unnest(range(len(s)))::int as band, unnest(s) as v from px) select vec_id, band, round(case when max(v) over w > min(v) over w then (v - min(v) over w) * 2.0 / (max(v) over w - min(v) over w) - 1.0 else -1.0 end, 6) as value from l window w as (partition by band)")
def t3(spark, sf):
    c = cube(spark, sf)
    r = histogram.band_ranges(c)
    return long_form(c.pixels.join(F.broadcast(r), F.lit(True)), spectral.stretch_bands("s", F.col("lows"), F.col("highs"), -1.0, 1.0))


@query("t4_clamp", long_sql("list_transform(s, lambda v: least(greatest(v, -0.2), 0.2))"))
def t4(spark, sf):
    return long_form(cube(spark, sf).pixels, spectral.clamp("s", -0.2, 0.2))


@query("t5_log", long_sql("list_transform(s, lambda v: case when v > 0 then greatest(ln(v), 0) else 0 end)", "p255"))
def t5(spark, sf):
    return long_form(cube255(spark, sf).pixels, spectral.log("s"))


@query("t6_normalise", long_sql("list_transform(s, lambda v: v / (case when list_sum(list_transform(s, lambda z: z * z)) > 0 then sqrt(list_sum(list_transform(s, lambda z: z * z))) else 1 end))"))
def t6(spark, sf):
    return long_form(cube(spark, sf).pixels, spectral.normalise("s"))


@query("t7_gradient", f"with {P255}, l as (select vec_id, unnest(range(len(s)))::int as band, unnest(s) as v from p255), d as (select vec_id, band - 1 as band, v - lag(v) over (partition by vec_id order by band) as value from l) select vec_id, band::int as band, round(value, 6) as value from d where value is not null")
def t7(spark, sf):
    return long_form(cube255(spark, sf).pixels, spectral.gradient("s"))


@query("t8_log_gradient", f"with {P255}, l as (select vec_id, unnest(range(len(s)))::int as band, case when unnest(s) > 0 then greatest(ln(unnest(s)), 0) else 0 end as v from p255), d as (select vec_id, band - 1 as band, v - lag(v) over (partition by vec_id order by band) as value from l) select vec_id, band::int as band, round(value, 6) as value from d where value is not null")
def t8(spark, sf):
    px = cube255(spark, sf).pixels.withColumn("s", spectral.log("s"))
    return long_form(px, spectral.gradient("s"))


@query("t9_resize", long_sql("list_transform(range(24), lambda i: s[(least(greatest(floor((i + 0.5) * 64 / 24 - 0.5), 0), 63) + 1)::int] * (1 - (((i + 0.5) * 64 / 24 - 0.5) - floor((i + 0.5) * 64 / 24 - 0.5))) + s[(least(greatest(floor((i + 0.5) * 64 / 24 - 0.5) + 1, 0), 63) + 1)::int] * (((i + 0.5) * 64 / 24 - 0.5) - floor((i + 0.5) * 64 / 24 - 0.5)))"))
def t9(spark, sf):
    return long_form(cube(spark, sf).pixels, spectral.resize("s", 64, 24))


_BANDS = "bands as (select range::int as band, 400.0::double + 5 * range as center from range(64))"
_PLANCK = "(3.7418e-16::double * pow({l} * 1e-9::double, -5) / (exp(0.014388::double / (5000 * {l} * 1e-9::double)) - 1))"
_BB = f"100 * {_PLANCK.format(l='round(center)')} / {_PLANCK.format(l='560')}"


@query("t10_black_body", f"with {_BANDS} select band, round({_BB}, 6) as coefficient from bands")
def t10(spark, sf):
    return band_table(spark).select("band", F.round(spectral.black_body(F.col("center"), 5000.0), 6).alias("coefficient"))


@query("t11_illuminant_weight", f"with w as (select (400 + 10 * range)::double as center from range(32)) select round(1 / max({_BB}), 9) as weight from w")
def t11(spark, sf):
    w = spark.range(1).select(F.explode(F.transform(F.sequence(F.lit(400), F.lit(710), F.lit(10)), lambda v: v.cast("double"))).alias("center"))
    return w.agg(F.round(1 / F.max(spectral.black_body(F.col("center"), 5000.0)), 9).alias("weight"))


def _coefficients(spark):
    b = band_table(spark).select("band", spectral.black_body(F.col("center"), 5000.0).alias("c"))
    return b.agg(F.transform(F.array_sort(F.collect_list(F.struct("band", "c"))), lambda z: z["c"]).alias("coeff"))


_ILLUM = f"with {P255}, {_BANDS}, l as (select vec_id, unnest(range(len(s)))::int as band, unnest(s) as v from p255) select vec_id, band, round(v OP ({_BB}), 6) as value from l join bands using (band)"


@query("t12_apply_illuminant", _ILLUM.replace("OP", "*"))
def t12(spark, sf):
    px = cube255(spark, sf).pixels.join(F.broadcast(_coefficients(spark)), F.lit(True))
    return long_form(px, spectral.illuminate("s", "coeff"))


@query("t12_remove_illuminant", _ILLUM.replace("OP", "/"))
def t12b(spark, sf):
    px = cube255(spark, sf).pixels.join(F.broadcast(_coefficients(spark)), F.lit(True))
    return long_form(px, spectral.illuminate("s", "coeff", remove=True))


@query("t13_coefficients", f"with {_BANDS} select band, round({_BB}, 6) as coefficient from bands")
def t13(spark, sf):
    return _coefficients(spark).select(F.posexplode("coeff").alias("band", "coefficient")).withColumn("coefficient", F.round("coefficient", 6))


def _cie_sql() -> str:
    rows = ", ".join(f"({i}, {x!r}::double, {y!r}::double, {z!r}::double)" for i, (x, y, z) in enumerate(zip(cie.CIE_X, cie.CIE_Y, cie.CIE_Z, strict=True)))
    return f"cie(k, cx, cy, cz) as (values {rows})"


_XYZ = f"with {P255}, {_cie_sql()}, l as (select vec_id, unnest(range(len(s)))::int as band, unnest(s) as v from p255), xyz as (select vec_id, sum(cx * v / 255) / sum(cy) as cx, sum(cy * v / 255) / sum(cy) as cy, sum(cz * v / 255) / sum(cy) as cz from l join cie on k = 8 + band group by vec_id)"


@query("t14_xyz", f"{_XYZ} select vec_id, round(cx, 6) as x, round(cy, 6) as y, round(cz, 6) as z from xyz")
def t14(spark, sf):
    xyz = color.xyz("s", color.default_centers(64), 255.0)
    return cube255(spark, sf).pixels.select("vec_id", *(F.round(c, 6).alias(n) for n, c in zip("xyz", xyz, strict=True)))


_GAMMA = "(case when {c} <= 0.0031308 then 12.92 * {c} else 1.055 * pow({c}, 1 / 2.4::double) - 0.055 end)"
_LIN = {"r": "3.2406 * cx - 1.5372 * cy - 0.4986 * cz", "g": "-0.9689 * cx + 1.8758 * cy + 0.0415 * cz", "b": "0.0557 * cx - 0.2040 * cy + 1.0570 * cz"}
_RGB = ", ".join(f"round({_GAMMA.format(c=f'least(greatest({e}, 0), 1)')}, 6) as {n}" for n, e in _LIN.items())


@query("t15_srgb", f"{_XYZ} select vec_id, {_RGB} from xyz")
def t15(spark, sf):
    rgb = color.srgb(*color.xyz("s", color.default_centers(64), 255.0))
    return cube255(spark, sf).pixels.select("vec_id", *(F.round(c, 6).alias(n) for n, c in zip("rgb", rgb, strict=True)))


@query("t16_true_colour", f"{_XYZ}, c as (select vec_id, {_RGB} from xyz) select vec_id, floor(r * 255)::int as r, floor(g * 255)::int as g, floor(b * 255)::int as b from c")
def t16(spark, sf):
    c = t15(spark, sf)
    return c.select("vec_id", *(F.floor(F.col(n) * 255).cast("int").alias(n) for n in "rgb"))


@query("t18_blur", f"""with {PX}, l as (select y, x, unnest(range(len(s)))::int as band, unnest(s) as v from px), k as (select dy, dx, g(dy) * g(dx) as w from (select range as dy from range(-1, 2)) a, (select range as dx from range(-1, 2)) b), h as (select max(y) as my, max(x) as mx from px)
select (a.y * 25 + a.x)::bigint as vec_id, a.band, round(sum(k.w * b.v), 6) as value from l a, k, h, l b where b.band = a.band and b.y = (case when a.y + dy < 0 then -(a.y + dy) when a.y + dy > my then 2 * my - a.y - dy else a.y + dy end) and b.x = (case when a.x + dx < 0 then -(a.x + dx) when a.x + dx > mx then 2 * mx - a.x - dx else a.x + dx end) group by all""".replace("g(dy)", "(exp(-dy*dy/2.0::double)/(1+2*exp(-0.5::double)))").replace("g(dx)", "(exp(-dx*dx/2.0::double)/(1+2*exp(-0.5::double)))"))
def t18(spark, sf):
    from cubeflux.operators import neighbours

    return long_form(neighbours.gaussian_blur(cube(spark, sf), 1, 1.0), "s")


query("t18_blur_all", ORACLE["t18_blur"])(t18)


@query("t19_quantise", long_sql("list_transform(s, lambda v: floor((v + 1.0) * 65535 / 2.0))"))
def t19(spark, sf):
    return long_form(cube(spark, sf).pixels, spectral.quantise("s", -1.0, 1.0))


@query("t20_dequantise", long_sql("list_transform(s, lambda v: floor((v + 1.0) * 65535 / 2.0) * 2.0 / 65535 - 1.0)"))
def t20(spark, sf):
    px = cube(spark, sf).pixels.withColumn("s", spectral.quantise("s", -1.0, 1.0))
    return long_form(px, spectral.dequantise("s", -1.0, 1.0))


@query("t21_bin_position", long_sql("list_transform(s, lambda v: (v + 1.0) / (2.0 / 63))"))
def t21(spark, sf):
    return long_form(cube(spark, sf).pixels, spectral.bin_position("s", -1.0, 1.0, 64))


@query("t22_norm_range", f"with {P255}, r as (select min(list_min(s)) as lo, max(list_max(s)) as hi from p255) select 'observed' as mode, round(lo, 6) as lo, round(hi, 6) as hi from r union all select 'theoretical', 0, 255 union all select 'theoretical_gradient', round(-ln(255::double), 6), round(ln(255::double), 6) union all select 'fixed', 10, 200")
def t22(spark, sf):
    c = cube255(spark, sf)
    frames = [histogram.norm_range(c, "observed"), histogram.norm_range(c, "theoretical"), histogram.norm_range(c, "theoretical", gradient=True), histogram.norm_range(c, "fixed", fixed=(10.0, 200.0))]
    names = ["observed", "theoretical", "theoretical_gradient", "fixed"]
    out = None
    for n, f in zip(names, frames, strict=True):
        f = f.select(F.lit(n).alias("mode"), F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"))
        out = f if out is None else out.union(f)
    return out


@query("t23_opacity", f"with {PX}, b as (select label, count(*) as w from px group by label), t as (select sum(w) as total from b) select label, round(least(1.0, 0.01 + 0.99 * ln(w + 1) / ln(greatest(total, 2))), 6) as opacity from b, t")
def t23(spark, sf):
    b = cube(spark, sf).pixels.groupBy("label").agg(F.count("*").cast("double").alias("w"))
    total = F.sum("w").over(Window.partitionBy(F.lit(1)))
    return b.select("label", F.round(spectral.opacity(F.col("w"), total), 6).alias("opacity"))


@query("t26_gauss_weight", "select range::int as d2, round(0.3 * exp(-range / 8.0::double), 6) as weight from range(20)")
def t26(spark, sf):
    d = spark.range(20)
    return d.select(F.col("id").cast("int").alias("d2"), F.round(spectral.gauss_weight(F.col("id").cast("double"), 2.0, 0.3), 6).alias("weight"))


@query("t27_geometric_weights", "select range::int as rank, round(pow(2, 4 - range)::double / 31, 6) as weight from range(5)")
def t27(spark, sf):
    w = F.array(*(F.lit(x) for x in spectral.geometric_weights(5)))
    return spark.range(1).select(F.posexplode(w).alias("rank", "weight")).withColumn("weight", F.round("weight", 6))


@query("t28_som_coordinates", "select range as idx, round((range % 10) / 9.0::double, 6) as c0, round(((range // 10) % 10) / 9.0::double, 6) as c1, round(((range // 100) % 10) / 9.0::double, 6) as c2 from range(1000)")
def t28(spark, sf):
    d = spark.range(1000).withColumnRenamed("id", "idx")
    return d.select("idx", *(F.round(c, 6).alias(f"c{k}") for k, c in enumerate(spectral.som_coordinate(F.col("idx"), 10, 3))))


@query("t31_label_gray", f"with {PX}, c as (select max(label) + 1 as n from px) select vec_id, floor(label * 255.0 / greatest(n - 1, 1))::int as gray from px, c")
def t31(spark, sf):
    px = cube(spark, sf).pixels
    n = px.agg((F.max("label") + 1).alias("n"))
    return px.join(F.broadcast(n), F.lit(True)).select("vec_id", F.floor(F.col("label") * 255.0 / F.greatest(F.col("n") - 1, F.lit(1))).cast("int").alias("gray"))


# distances of every pixel to the first one
_PAIR = "q as (select p.vec_id, p.s as a, r.s as b from BASE p, (select s from BASE where vec_id = 0) r)"
_L = "ls as (select vec_id, unnest(a) as a, unnest(b) as b from q)"


def _sql(expr: str, base: str = "px", pre: str = "") -> str:
    """expr aggregates a and b over the bands of a pixel."""
    return f"with {P255 if base == 'p255' else PX}, {_PAIR.replace('BASE', base)}, {_L}{pre} select vec_id, round({expr}, 6) as distance from ls group by vec_id"


_ANGLE = "case when sum(a*a) = 0 and sum(b*b) = 0 then 0 when sum(a*a) = 0 or sum(b*b) = 0 then acos(0) else acos(greatest(-1, least(1, sum(a*b) / (sqrt(sum(a*a)) * sqrt(sum(b*b)))))) end"
_NORM = ", m as (select vec_id, a, b, sum(a) over w as sa, sum(b) over w as sb, count(*) over w as n from ls window w as (partition by vec_id))"
_SID = "greatest(0, sum(case when a/sa > 0 and b/sb > 0 then (a/sa - b/sb) * (ln(a/sa) - ln(b/sb)) else 0 end))"
_MEASURES = {
    "m1_manhattan": (D.manhattan, "px", "sum(abs(a - b))", "ls"),
    "m2_euclidean": (D.euclidean, "px", "sqrt(sum((a - b) * (a - b)))", "ls"),
    "m3_chebyshev": (D.chebyshev, "px", "max(abs(a - b))", "ls"),
    "m4_spectral_angle": (D.spectral_angle, "p255", _ANGLE, "ls"),
    "m5_information_divergence": (D.information_divergence, "p255", _SID, "m"),
    "m6_sidsam_sin": (D.sid_sam_sin, "p255", f"sqrt({_SID} * sin({_ANGLE}))", "m"),
    "m7_sidsam_tan": (D.sid_sam_tan, "p255", f"sqrt({_SID} * tan({_ANGLE}))", "m"),
    "m8_normalised_l2": (D.normalised_l2, "p255", "sqrt(sum(pow(a * n / sa - b * n / sb, 2)))", "m"),
    "m9_mean_squares": (D.mean_squares, "px", "avg((a - b) * (a - b))", "ls"),
    "m11_reciprocal_square": (D.reciprocal_square_difference, "p255", "sum(1 / (1 + (a - b) * (a - b) / 900.0))", "ls"),
    "m12_cross_correlation": (D.normalised_cross_correlation, "p255", "-sum(a * b) / (sqrt(sum(a * a)) * sqrt(sum(b * b)))", "ls"),
    "m18_correlation": (D.correlation, "px", "case when var_pop(a) * var_pop(b) <= 0 then 0 else covar_pop(a, b) / sqrt(var_pop(a) * var_pop(b)) end", "ls"),
    "m19_spectral_distance": (lambda a, b: D.spectral_distance(a, b, 0.0, 2.0), "px", "sqrt(sum((a - b) * (a - b))) / 2.0", "ls"),
}


def _register(name, f, base, expr, rows):
    sql = _sql(expr, base, _NORM if rows == "m" else "").replace("from ls group by", f"from {rows} group by")

    @query(name, sql)
    def run(spark, sf):
        px = (cube255 if base == "p255" else cube)(spark, sf).pixels
        ref = px.filter("vec_id = 0").select(F.col("s").alias("r"))
        return px.join(F.broadcast(ref), F.lit(True)).select("vec_id", F.round(f(F.col("s"), F.col("r")), 6).alias("distance"))


for _name, _spec in _MEASURES.items():
    _register(_name, *_spec)

_ANG = "(acos(greatest(-1, least(1, (r + 1) / 2))) / acos(0))"


@query("m20_similarity_value", f"with {PX}, {_PAIR.replace('BASE', 'px')}, {_L}, m as (select vec_id, sum((a - b) * (a - b)) as d2, case when var_pop(a) * var_pop(b) <= 0 then 0 else covar_pop(a, b) / sqrt(var_pop(a) * var_pop(b)) end as r from ls group by vec_id) select vec_id, round(sqrt(case when d2 - (1 - {_ANG}) * (1 - {_ANG}) < 0 then d2 else d2 - (1 - {_ANG}) * (1 - {_ANG}) end), 5) as distance from m")
def m20(spark, sf):
    px = cube(spark, sf).pixels
    ref = px.filter("vec_id = 0").select(F.col("s").alias("r"))
    return px.join(F.broadcast(ref), F.lit(True)).select("vec_id", F.round(D.similarity_value(F.col("s"), F.col("r")), 5).alias("distance"))


# measures on the joint histogram of two bands as images
_BINS2 = f"with {PX}, j as (select floor((s[1] + 1) * 16)::int as b1, floor((s[2] + 1) * 16)::int as b2, count(*) as n from px group by all), t as (select sum(n) as t from j), p as (select b1, b2, n / t as p, sum(n) over (partition by b1) / t as p1, sum(n) over (partition by b2) / t as p2 from j, t)"
_H = {"h1": "(select -sum(p1 * log2(p1)) from (select distinct b1, p1 from p))", "h2": "(select -sum(p2 * log2(p2)) from (select distinct b2, p2 from p))", "h12": "(select -sum(p * log2(p)) from p)"}


@query("m15_mutual_information", f"{_BINS2} select round({_H['h1']} + {_H['h2']} - {_H['h12']}, 6) as mutual, round(({_H['h1']} + {_H['h2']}) / {_H['h12']}, 6) as normalised")
def m15(spark, sf):
    return histogram.mutual_information(cube(spark, sf), 0, 1, 32)


@query("m10_mean_squares_histogram", f"{_BINS2} select round(sum(p * (p1 - p2) * (p1 - p2)), 9) as distance from p")
def m10(spark, sf):
    p = histogram.joint_histogram(cube(spark, sf), 0, 1, 32)
    return p.agg(F.round(F.sum(F.col("p") * (F.col("p1") - F.col("p2")) * (F.col("p1") - F.col("p2"))), 9).alias("distance"))


_TWO = f"with {PX}, g as (select range::int as bin from range(32)), a as (select floor((s[1] + 1) * 16)::int as bin, count(*) as n from px group by all), b as (select floor((s[2] + 1) * 16)::int as bin, count(*) as n from px group by all), h as (select bin, coalesce(a.n, 0)::double as n1, coalesce(b.n, 0)::double as n2 from g left join a using (bin) left join b using (bin))"


@query("m13_histogram_correlation", f"{_TWO} select round(corr(n1, n2), 6) as correlation from h")
def m13(spark, sf):
    h = histogram.two_histograms(cube(spark, sf), 0, 1, 32)
    return h.agg(F.round(F.corr("n1", "n2"), 6).alias("correlation"))


@query("m14_earth_mover", f"{_TWO}, c as (select sum(n1) over (order by bin) / (select sum(n1) from h) as c1, sum(n2) over (order by bin) / (select sum(n2) from h) as c2 from h) select round(sum(abs(c1 - c2)), 6) as distance from c")
def m14(spark, sf):
    return histogram.earth_mover(histogram.two_histograms(cube(spark, sf), 0, 1, 32))


# Sobel gradients of bands 0 and 1 as images, the ten or eleven scales, the least entropy
_OFFS = ", ".join(f"({dy}, {dx}, {a}, {b})" for dy, dx, a, b in ((-1, -1, -1, -1), (-1, 0, 0, -2), (-1, 1, 1, -1), (0, -1, -2, 0), (0, 1, 2, 0), (1, -1, -1, 1), (1, 0, 0, 2), (1, 1, 1, 1)))
_STEPS = ", ".join(f"({x!r}::double)" for x in (0.0, 0.2, 0.4, 0.6000000000000001, 0.8, 1.0, 1.2, 1.4, 1.5999999999999999, 1.7999999999999998, 1.9999999999999998))
_GRAD = f"""with {PX}, m as (select max(y) as my, max(x) as mx from px), o(dy, dx, a, b) as (values {_OFFS}),
n as (select vec_id, a, b, case when y + dy < 0 then -(y + dy) when y + dy > my then 2 * my - y - dy else y + dy end as y, case when x + dx < 0 then -(x + dx) when x + dx > mx then 2 * mx - x - dx else x + dx end as x from px, m, o),
g as (select n.vec_id, sum(a * s[1]) as gx1, sum(a * s[2]) as gx2, sum(b * s[1]) as gy1, sum(b * s[2]) as gy2 from n join px using (y, x) group by n.vec_id), st(step) as (values {_STEPS}),
d as (select step, abs(gx1 - step * gx2) as dx, abs(gy1 - step * gy2) as dy, sqrt(abs(gx1 - step * gx2) * abs(gx1 - step * gx2) + abs(gy1 - step * gy2) * abs(gy1 - step * gy2)) as d from g, st),
t as (select step, count(*) as n, min(d) as lo, max(d) as hi, stddev_pop(dx) as sx, stddev_pop(dy) as sy from d group by step),
h as (select step, floor((d - lo) * 150 / (hi - lo)) as bin, count(*) as k, any_value(n) as n from d join t using (step) where d < hi group by all),
e as (select step, round(sum(-k / n * log2(k / n)), 9) as e from h group by step), z as (select step from e order by e, step limit 1)
select step as scale, round(sum(sx / (sx + dx * dx) + sy / (sy + dy * dy)), 5) as distance from d join z using (step) join t using (step) group by step"""


@query("m17_gradient_difference", _GRAD)
def m17(spark, sf):
    from cubeflux.operators.neighbours import gradient_difference

    return gradient_difference(cube(spark, sf), 0, 1).withColumn("distance", F.round("distance", 5))


@query("m24_joint_histogram", f"{_BINS2} select b1, b2, round(p, 6) as p from p")
def m24(spark, sf):
    return histogram.joint_histogram(cube(spark, sf), 0, 1, 32).select("b1", "b2", F.round("p", 6).alias("p"))


@query("a23_entropy", f"with {PX}, r as (select min(s[1]) as lo, max(s[1]) as hi from px), b as (select least(floor((s[1] - lo) * 50 / (hi - lo)), 49) as bin, count(*) as n from px, r group by all), t as (select sum(n) as t from b) select round(-sum(n / t * log2(n / t)), 6) as entropy from b, t")
def a23(spark, sf):
    return histogram.entropy(cube(spark, sf), 0, 50)


@query("m22_l1_quantised", f"with {PX}, qz as (select vec_id, list_transform(s, lambda v: floor((v + 1) * 65535 / 2)) as s from px), {_PAIR.replace('BASE', 'qz')}, {_L} select vec_id, sum(abs(a - b))::bigint as distance, (sum(abs(a - b)) < 300000) as within from ls group by vec_id")
def m22(spark, sf):
    px = cube(spark, sf).pixels.withColumn("s", spectral.quantise("s", -1.0, 1.0))
    ref = px.filter("vec_id = 0").select(F.col("s").alias("r"))
    d = F.aggregate(F.zip_with("s", "r", lambda a, b: F.abs(a - b)), F.lit(0).cast("long"), lambda t, v: t + v)
    return px.join(F.broadcast(ref), F.lit(True)).select("vec_id", d.alias("distance"), (d < 300000).alias("within"))


assert math.isclose(sum(spectral.geometric_weights(5)), 1.0)
