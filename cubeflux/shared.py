"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_root(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir. Only a local session, whose one process is all there is, gets a folder of its own."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = Path(tempfile.mkdtemp(prefix="cubeflux-shared-")).as_uri()
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def shared_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/cubeflux/{name}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """df written and read again: iterations neither grow the plan nor repeat work after a loss."""
    spark = df.sparkSession
    path = shared_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, name: str, *order: str | Column, parts: int | None = None) -> DataFrame:
    """df with its place, from 0, in an order. Ranges of the whole order are sorted side by side and written with each
    row's place in its range; a range begins after the rows of those before it. Rows equal in the order take any of
    their places, and are cut between ranges too."""
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [*order, "_tie"]
    placed = df.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(parts, *keys).sortWithinPartitions(*keys).drop("_tie")
    # the partition's number times 2^33, and the row's place in it
    placed = materialize(placed.withColumn("_at", F.monotonically_increasing_id()), "numbered").withColumn("_part", F.shiftright("_at", 33))
    held = placed.groupBy("_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_from"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = held.select("_part", (before - F.col("_from")).alias("_shift"))  # a row for each range
    return placed.join(F.broadcast(starts), "_part").withColumn(name, F.col("_at") + F.col("_shift")).drop("_part", "_at", "_shift")


def located(path: str):
    """The Arrow file system of a path or URI, and the path in it: for driver and tasks alike."""
    from pyarrow import fs

    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path if "://" in path else path.replace("file:", "file://", 1))
    return fs.LocalFileSystem(), path


def is_folder(path: str) -> bool:
    from pyarrow import fs

    files, place = located(path)
    return files.get_file_info(place).type == fs.FileType.Directory


def write_file(path: str, pieces) -> int:
    """Write the bytes of pieces and then give the file its name: another attempt of a task never shows a part. Returns its size."""
    files, place = located(path)
    files.create_dir(place.rsplit("/", 1)[0])
    part, size = f"{place}.{uuid.uuid4().hex}.tmp", 0
    with files.open_output_stream(part) as out:
        for piece in pieces:
            out.write(piece)
            size += len(piece)
    files.move(part, place)
    return size


def read_file(path: str, start: int = 0, length: int | None = None) -> bytes:
    files, place = located(path)
    with files.open_input_file(place) as f:
        f.seek(start)
        return f.read() if length is None else f.read(length)
