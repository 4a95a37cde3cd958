"""The cube: a DataFrame of pixels (id, y, x, label, s) with declared range and band metadata."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Cube:
    """pixels has vec_id, y, x, label and the spectrum s (array of double, without nulls)."""

    pixels: DataFrame
    width: int
    n_bands: int
    lo: float
    hi: float

    def with_spectrum(self, column, lo: float | None = None, hi: float | None = None, n_bands: int | None = None) -> Cube:
        return replace(self, pixels=self.pixels.withColumn("s", column), lo=self.lo if lo is None else lo, hi=self.hi if hi is None else hi, n_bands=n_bands or self.n_bands)

    def samples(self, name: str = "value") -> DataFrame:
        """Long form, one row per pixel and band (band-planar view)."""
        return self.pixels.select("vec_id", "y", "x", "label", F.posexplode("s").alias("band", name))


WIDTH, BANDS = 25, 64


def from_embeddings(spark: SparkSession, sf_dir: str) -> Cube:
    """The vectors as a cube of width 25 with the declared range [-1, 1]."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    px = e.select("vec_id", F.expr(f"cast(vec_id div {WIDTH} as int)").alias("y"), (F.col("vec_id") % WIDTH).cast("int").alias("x"), "label", F.col("embedding").cast("array<double>").alias("s"))
    return Cube(px, WIDTH, BANDS, -1.0, 1.0)


def scaled255(cube: Cube) -> Cube:
    """The cube over [0, 255]."""
    from .functions.spectral import rescale

    return cube.with_spectrum(rescale("s", cube.lo, cube.hi, 0.0, 255.0), 0.0, 255.0)


def band_table(spark: SparkSession, n: int = BANDS, first: float = 400.0, step: float = 5.0) -> DataFrame:
    """Band descriptors with centre wavelengths in nm."""
    c = F.col("id") * step + first
    return spark.range(n).select(F.col("id").cast("int").alias("band"), c.alias("center"), c.alias("range_start"), c.alias("range_end"), F.lit(False).alias("empty"))


def from_lineitem(spark: SparkSession, sf_dir: str) -> Cube:
    """Order lines as pixels of four bands; the return flag is the label."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    label = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    px = li.select(F.col("l_orderkey").alias("vec_id"), F.lit(0).alias("y"), F.lit(0).alias("x"), label.alias("label"), F.array("l_quantity", "l_extendedprice", "l_discount", "l_tax").alias("s"))
    return Cube(px, 1, 4, 0.0, 105000.0)
