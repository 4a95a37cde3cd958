"""Histograms of change streams: +1 adds a sample, -1 retracts it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "seq long, op int, label string, value double"


def binned(changes: DataFrame, lo: float, hi: float, bins: int) -> DataFrame:
    size = (hi - lo) / (bins - 1)
    b = F.least(F.greatest(F.floor((F.col("value") - lo) / size), F.lit(0)), F.lit(bins - 1)).cast("int")
    return changes.select("label", b.alias("bin"), "op", "value")


def histogram(changes: DataFrame, lo: float, hi: float, bins: int) -> DataFrame:
    """(label, bin, weight, total): signed counts, for batch frames and streams alike. State is one row per occupied bin."""
    return binned(changes, lo, hi, bins).groupBy("label", "bin").agg(F.sum("op").alias("weight"), F.sum(F.col("op") * F.col("value")).alias("total"))


def start(spark: SparkSession, path: str, name: str, lo: float, hi: float, bins: int, checkpoint: str, files: int = 1):
    """A query over change files as they arrive; its table holds the histogram after each batch."""
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files).parquet(path)
    return histogram(stream, lo, hi, bins).writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def changes_of_events(events: DataFrame) -> DataFrame:
    """Each event as an addition; events whose id ends in 3 are retracted later."""
    add = events.select(F.col("event_id").alias("seq"), F.lit(1).alias("op"), F.col("event_type").alias("label"), "value")
    gone = events.filter("event_id % 10 = 3").select((F.col("event_id") + 1_000_000_000).alias("seq"), F.lit(-1).alias("op"), F.col("event_type").alias("label"), "value")
    return add.union(gone)
