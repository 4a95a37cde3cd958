"""Selections, point and segment updates, label edits and region algebra."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cubeflux.model import Cube

RASTER = ("y", "x")


@dataclass(frozen=True)
class Rect:
    x: int
    y: int
    w: int
    h: int

    @property
    def area(self) -> int:
        return max(0, self.w) * max(0, self.h)

    def contains(self, x: str = "x", y: str = "y") -> Column:
        """A range predicate that reaches the scan."""
        return (F.col(x) >= self.x) & (F.col(x) < self.x + self.w) & (F.col(y) >= self.y) & (F.col(y) < self.y + self.h)

    def meet(self, o: Rect) -> Rect:
        x, y = max(self.x, o.x), max(self.y, o.y)
        return Rect(x, y, max(0, min(self.x + self.w, o.x + o.w) - x), max(0, min(self.y + self.h, o.y + o.h) - y))

    def minus(self, o: Rect) -> list[Rect]:
        """What of this lies outside o: at most eight rectangles, from a 3 x 3 partition."""
        m = self.meet(o)
        if not m.area:
            return [self] if self.area else []
        xs = (self.x, m.x, m.x + m.w, self.x + self.w)
        ys = (self.y, m.y, m.y + m.h, self.y + self.h)
        parts = [Rect(xs[i], ys[j], xs[i + 1] - xs[i], ys[j + 1] - ys[j]) for j in range(3) for i in range(3) if (i, j) != (1, 1)]
        return [r for r in parts if r.area]


def parse_roi(text: str) -> Rect | None:
    """x:y:w:h, or None unless there are exactly three colons between integers."""
    parts = text.split(":")
    if len(parts) != 4 or not all(p.strip().lstrip("-").isdigit() for p in parts):
        return None
    return Rect(*map(int, parts))


def roi_change(old: Rect, new: Rect) -> tuple[list[Rect], list[Rect], bool]:
    """Rectangles to retract, rectangles to add, and whether that is less work than a new start."""
    sub, add = old.minus(new), new.minus(old)
    return sub, add, sum(r.area for r in sub + add) < new.area


def in_any(rects: list[Rect]) -> Column:
    out = F.lit(False)
    for r in rects:
        out = out | r.contains()
    return out


def band(b: int) -> Column:
    return F.get("s", F.lit(b))


def scope(cube: Cube, roi: Rect) -> Cube:
    """The cube inside a region, with rebased coordinates."""
    px = cube.pixels.filter(roi.contains()).withColumns({"y": F.col("y") - roi.y, "x": F.col("x") - roi.x})
    return Cube(px, roi.w, cube.n_bands, cube.lo, cube.hi)


def crop(cube: Cube, low: int, high: int) -> Cube:
    """Bands low..high, inclusive; high 0 means no limit, inconsistent bounds leave no pixels."""
    high = cube.n_bands - 1 if high == 0 else high
    if not 0 <= low <= high < cube.n_bands:
        return Cube(cube.pixels.filter("false"), cube.width, 0, cube.lo, cube.hi)
    return cube.with_spectrum(F.slice("s", low + 1, high - low + 1), n_bands=high - low + 1)


def segment(cube: Cube, mask: DataFrame) -> DataFrame:
    """Masked pixels in raster order, with their place."""
    from cubeflux.shared import numbered

    return numbered(cube.pixels.join(mask, "vec_id", "left_semi"), "place", *RASTER)


def set_pixels(cube: Cube, new: DataFrame) -> Cube:
    """Pixels overwritten by (vec_id, s)."""
    px = cube.pixels.join(new.select("vec_id", F.col("s").alias("_s")), "vec_id", "left").withColumn("s", F.coalesce("_s", "s")).drop("_s")
    return Cube(px, cube.width, cube.n_bands, cube.lo, cube.hi)


def set_band(cube: Cube, b: int, new: DataFrame, mask: DataFrame | None = None) -> Cube:
    """One band overwritten by (vec_id, value), where a mask is given only inside it."""
    new = new if mask is None else new.join(mask, "vec_id", "left_semi")
    px = cube.pixels.join(new.select("vec_id", F.col("value").alias("_v")), "vec_id", "left")
    px = px.withColumn("s", F.transform("s", lambda v, i: F.when((i == b) & F.col("_v").isNotNull(), F.col("_v")).otherwise(v))).drop("_v")
    return Cube(px, cube.width, cube.n_bands, cube.lo, cube.hi)


def set_segment(cube: Cube, mask: DataFrame, values: DataFrame) -> Cube:
    """Masked pixels overwritten, in raster order, by values (place, s)."""
    at = segment(cube, mask).select("vec_id", "place").join(values, "place").select("vec_id", "s")
    return set_pixels(cube, at)


def from_samples(samples: DataFrame) -> DataFrame:
    """Spectra assembled from (vec_id, band, value)."""
    return samples.groupBy("vec_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("band", "value"))), lambda z: z["value"]).alias("s"))


def limits_mask(position: Column, lows: list[float], highs: list[float], clamp_to: int | None = None) -> Column:
    """Whether every band's bin lies in its limits. Bins aren't clamped to the range unless asked for."""
    b = F.transform(position, lambda v: F.floor(v) if clamp_to is None else F.least(F.greatest(F.floor(v), F.lit(0)), F.lit(clamp_to)))
    lo, hi = F.array(*map(F.lit, lows)), F.array(*map(F.lit, highs))
    return F.forall(F.arrays_zip(b.alias("b"), lo.alias("l"), hi.alias("h")), lambda z: (z["b"] >= z["l"]) & (z["b"] <= z["h"]))


def seeds(value: Column) -> Column:
    """Seed label of a grey value: above 192 the first, below 64 the second, else none (0)."""
    return F.when(value > 192, 1).when(value < 64, 2).otherwise(0)


def seed_box(pixels: DataFrame, value: Column) -> DataFrame:
    return pixels.filter((value > 192) | (value < 64)).agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"))


def alter_label(pixels: DataFrame, label: int, mask: DataFrame | None, negative: bool = False) -> DataFrame:
    """Without a mask the label is cleared; with one its pixels get the label, or lose it if negative."""
    if mask is None:
        return pixels.withColumn("label", F.when(F.col("label") == label, 0).otherwise(F.col("label")))
    marked = pixels.join(mask.select("vec_id", F.lit(True).alias("_m")), "vec_id", "left")
    hit = F.coalesce("_m", F.lit(False))
    new = F.when(hit & (F.col("label") == label), 0) if negative else F.when(hit, label)
    return marked.withColumn("label", new.otherwise(F.col("label"))).drop("_m")


def overwrite_labels(pixels: DataFrame, new: DataFrame) -> DataFrame:
    """Labels replaced where new (vec_id, new_label) has one."""
    return pixels.join(new, "vec_id", "left").withColumn("label", F.coalesce("new_label", "label")).drop("new_label")


def brush(old: Column, label: int, rubber: bool, override: bool) -> Column:
    """Label of a pixel under the marker or rubber: without override only the background, or the own label, changes."""
    if rubber:
        return F.when(F.lit(override) | (old == label), 0).otherwise(old)
    return F.when(F.lit(override) | (old == 0), label).otherwise(old)


def merge_labels(pixels: DataFrame, labels: list[int]) -> DataFrame:
    """Labels merged into the smallest; merging with 0 deletes."""
    return pixels.withColumn("label", F.when(F.col("label").isin(labels), min(labels)).otherwise(F.col("label")))


def consolidate(pixels: DataFrame) -> DataFrame:
    """Labels renumbered without gaps from 1; background stays 0."""
    present = pixels.filter("label > 0").select("label").distinct()
    ranked = present.withColumn("new_label", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("label")).cast("int"))
    return pixels.join(F.broadcast(ranked), "label", "left").withColumn("label", F.coalesce("new_label", F.lit(0))).drop("new_label")


def flip(cube: Cube, height: int, vertical: bool, horizontal: bool) -> DataFrame:
    y = F.lit(height - 1) - F.col("y") if vertical else F.col("y")
    x = F.lit(cube.width - 1) - F.col("x") if horizontal else F.col("x")
    return cube.pixels.withColumns({"y": y, "x": x})


def order_bands(bands: DataFrame) -> DataFrame:
    """Place of each band by wavelength, empty descriptors first, stable."""
    return bands.withColumn("place", (F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("empty"), "center", "band")) - 1).cast("int"))


def wavelength_label(start: Column, end: Column, empty: Column) -> Column:
    """Empty, 'c nm', or 'a nm - b nm'."""
    return F.when(empty, "").when(start == end, F.concat(start.cast("int").cast("string"), F.lit(" nm"))).otherwise(F.concat(start.cast("int").cast("string"), F.lit(" nm - "), end.cast("int").cast("string"), F.lit(" nm")))
