"""Sums that are kept: a table of signed totals that changes are merged into, without a scan of what they are totals of.

The table lies in parts by a hash of its keys. A change is summed by key first; then only the parts that it touches are read,
merged and written as a new version, and a manifest, one small file that is replaced as a whole, says which version holds
each part. A reader sees the state before or after a change, never between. With a batch number, a change that is applied
again after a failure changes nothing. A key whose weight comes to 0 is no longer read; while it has a total it stays in
the table, as a removal may come before the addition that it belongs to.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cubeflux.model import Cube
from cubeflux.operators import histogram as H
from cubeflux.operators import select as S
from cubeflux.shared import read_file, write_file

#: Versions that a state may be spread over before it is written anew.
MOST_VERSIONS = 32


class Kept:
    """A state in a folder. rows: keys, weight, and columns that add up (numbers or arrays of numbers)."""

    def __init__(self, spark: SparkSession, folder: str, keys: list[str], weight: str = "weight", parts: int = 16):
        self.spark, self.folder, self.keys, self.weight, self.parts = spark, folder.rstrip("/"), keys, weight, parts

    def _manifest(self) -> dict:
        return json.loads(read_file(f"{self.folder}/manifest.json"))

    def _parted(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("part", F.pmod(F.xxhash64(*self.keys), F.lit(self.parts)).cast("int"))

    def _write(self, rows: DataFrame, version: int, held: dict[str, int], batch: int | None) -> None:
        path = f"{self.folder}/version={version}"
        rows.repartition(self.parts, "part").write.mode("overwrite").partitionBy("part").parquet(path)
        schema = T.StructType([f for f in rows.schema.fields if f.name != "part"]).json()
        for kind in ("nullable", "containsNull"):  # files are read as if anything may be null
            schema = schema.replace(f'"{kind}":false', f'"{kind}":true')
        write_file(f"{self.folder}/manifest.json", [json.dumps({"version": version, "parts": held, "batch": batch, "schema": schema}).encode()])

    def create(self, rows: DataFrame) -> None:
        """The first state."""
        self._write(self._parted(rows), 0, {str(p): 0 for p in range(self.parts)}, None)

    def _read(self, m: dict, parts: list[int] | None = None) -> DataFrame:
        schema = T.StructType.fromJson(json.loads(m["schema"]))
        out = self.spark.createDataFrame([], schema)
        by: dict[int, list[int]] = {}
        for p, v in m["parts"].items():
            if parts is None or int(p) in parts:
                by.setdefault(v, []).append(int(p))
        for v, own in sorted(by.items()):
            whole = T.StructType([*schema.fields, T.StructField("part", T.IntegerType())])
            some = self.spark.read.schema(whole).parquet(f"{self.folder}/version={v}").filter(F.col("part").isin(own))
            out = out.unionByName(some.drop("part"))
        return out

    def read(self) -> DataFrame:
        return self._read(self._manifest()).filter(F.col(self.weight) != 0)

    def _something(self, schema: T.StructType) -> Column:
        """Whether a row has a weight or any total."""
        out = F.lit(False)
        for f in schema.fields:
            if f.name not in self.keys:
                out = out | (F.exists(f.name, lambda v: v != 0) if isinstance(f.dataType, T.ArrayType) else F.col(f.name) != 0)
        return out

    def _sums(self, schema: T.StructType, lengths: dict[str, int]) -> list:
        """Totals of all columns that aren't keys. Arrays are added place by place."""
        out = []
        for f in schema.fields:
            if f.name not in self.keys:
                if isinstance(f.dataType, T.ArrayType):
                    out.append(F.array(*(F.sum(F.get(f.name, F.lit(i))) for i in range(lengths[f.name]))).alias(f.name))
                else:
                    out.append(F.sum(f.name).alias(f.name))
        return out

    def merge(self, change: DataFrame, lengths: dict[str, int] | None = None, batch: int | None = None) -> list[int]:
        """Add a change: rows like the state's, with negative weights and totals where something goes. lengths: of the
        columns that are arrays. Returns the parts that were written."""
        m = self._manifest()
        if batch is not None and m["batch"] is not None and batch <= m["batch"]:
            return []
        schema = T.StructType.fromJson(json.loads(m["schema"]))
        sums = self._sums(schema, lengths or {})
        delta = self._parted(change.groupBy(*self.keys).agg(*sums)).cache()
        try:
            touched = sorted(r.part for r in delta.select("part").distinct().collect())  # at most ``parts`` rows
            anew = m["version"] + 1 >= MOST_VERSIONS and len(set(m["parts"].values())) >= MOST_VERSIONS - 1
            if anew:
                touched = list(range(self.parts))
            if touched:
                before = self._read(m, touched)
                both = before.unionByName(delta.select(*before.columns)).groupBy(*self.keys).agg(*sums).filter(self._something(schema))
                after = both.select(*(F.col(f.name).cast(f.dataType) for f in schema.fields))
                self._write(self._parted(after), m["version"] + 1, m["parts"] | {str(p): m["version"] + 1 for p in touched}, batch if batch is not None else m["batch"])
        finally:
            delta.unpersist()
        return touched


class KeptHistogram:
    """The N-dimensional histogram per label of a cube, kept while its region and its labels change."""

    def __init__(self, cube: Cube, folder: str, lo: float, hi: float, bins: int, parts: int = 16):
        self.cube, self.lo, self.hi, self.bins = cube, lo, hi, bins
        self.state = Kept(cube.pixels.sparkSession, folder, ["label", "key"], parts=parts)

    def _part(self, pixels: DataFrame, sign: int) -> DataFrame:
        h = H.nd_histogram(Cube(pixels, self.cube.width, self.cube.n_bands, self.cube.lo, self.cube.hi), self.lo, self.hi, self.bins)
        return h if sign > 0 else h.select("label", "key", (-F.col("weight")).alias("weight"), F.transform("sums", lambda v: -v).alias("sums"))

    def rows(self, rects: list[S.Rect]) -> DataFrame:
        """The pixels of rectangles; the range of their ids reaches the scan where ids are in raster order."""
        if not rects:
            return self.cube.pixels.filter(F.lit(False))
        low, high = min(r.y for r in rects), max(r.y + r.h for r in rects)
        ids = F.col("vec_id").between(low * self.cube.width, high * self.cube.width - 1)
        return self.cube.pixels.filter(ids & S.in_any(rects))

    def create(self, roi: S.Rect) -> None:
        self.state.create(self._part(self.rows([roi]), 1))

    def move(self, old: S.Rect, new: S.Rect) -> list[int]:
        """Another region: only pixels that leave or come are read, or all of the new one where that is less."""
        sub, add, worth = S.roi_change(old, new)
        if not worth:
            self.create(new)
            return list(range(self.state.parts))
        return self.merge(self.rows(add), self.rows(sub))

    def relabel(self, changed: DataFrame) -> list[int]:
        """Pixels (vec_id, new_label) under other labels: each goes from its old one and comes to its new one."""
        old = self.cube.pixels.join(changed, "vec_id")
        new = old.withColumn("label", F.col("new_label").cast("int"))
        return self.merge(new.drop("new_label"), old.drop("new_label"))

    def merge(self, added: DataFrame, removed: DataFrame) -> list[int]:
        both = self._part(added, 1).unionByName(self._part(removed, -1))
        return self.state.merge(both, {"sums": self.cube.n_bands})

    def read(self) -> DataFrame:
        return self.state.read()


def follow(spark: SparkSession, path: str, folder: str, lo: float, hi: float, bins: int, checkpoint: str, files: int = 1):
    """A query over change files as they arrive, merged into the kept histogram of a folder: label, bin, weight, total. Each
    batch counts once, also if it runs again; the driver holds no state."""
    from cubeflux.streaming import histogram as stream

    kept = Kept(spark, folder, ["label", "bin"])
    kept.create(stream.histogram(spark.createDataFrame([], stream.SCHEMA), lo, hi, bins))
    changes = spark.readStream.schema(stream.SCHEMA).option("maxFilesPerTrigger", files).parquet(path)
    return changes.writeStream.foreachBatch(lambda df, n: kept.merge(stream.histogram(df, lo, hi, bins), batch=n)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
