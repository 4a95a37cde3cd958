"""Shared pieces of the training-data operators: shared folders, byte stores, word scanning."""

from __future__ import annotations

import gc
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path
from urllib.parse import unquote, urlparse

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: 64-bit mixing constants (public splitmix64 finaliser).
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once for each Spark context, unless it is installed there."""
    sc = spark.sparkContext
    if getattr(sc, "_cubeflux_shipped", False):
        return
    package = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp()) / f"{package.name}.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted(package.rglob("*.py")):
            z.write(p, p.relative_to(package.parent))
    sc.addPyFile(str(archive))
    sc._cubeflux_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session names it. Only a local session, as in tests, whose one
    process is all there is, gets a folder of its own where the setting is missing."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = Path(tempfile.mkdtemp(prefix="cubeflux-checkpoints-")).as_uri()
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder URI below the shared root; it lives as long as the result that reads from it."""
    return f"{checkpoint_root(spark)}/cubeflux/{name}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage through a parquet table in the shared folder: an executor lost later costs no recomputation."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Store:
    """Byte files under a URI, usable on driver and executors: local paths for file: URIs, pyarrow.fs for any other."""

    def __init__(self, uri: str):
        parsed = urlparse(uri)
        self.uri, self.local = uri.rstrip("/"), parsed.scheme in ("", "file")
        if self.local:
            self.base = unquote(parsed.path).rstrip("/")
        else:
            from pyarrow import fs

            self.fs, self.base = fs.FileSystem.from_uri(self.uri)

    def path(self, name: str) -> str:
        return f"{self.base}/{name}"

    def writer(self, name: str):
        """Write-then-rename: a retried or speculative task never shows a partial file."""
        return _Attempt(self, name)

    def size(self, name: str) -> int:
        return os.path.getsize(self.path(name)) if self.local else self.fs.get_file_info(self.path(name)).size

    def read(self, name: str, start: int = 0, length: int | None = None) -> bytes:
        if self.local:
            with open(self.path(name), "rb") as f:
                f.seek(start)
                return f.read(-1 if length is None else length)
        with self.fs.open_input_file(self.path(name)) as f:
            f.seek(start)
            return f.read() if length is None else f.read(length)

    def array(self, name: str, dtype: str) -> np.ndarray:
        """Memory-mapped where the store is a file system, otherwise read once."""
        if self.size(name) == 0:
            return np.empty(0, dtype)
        if self.local:
            return np.memmap(self.path(name), dtype=dtype, mode="r")
        return np.frombuffer(self.read(name), dtype)

    def drop(self) -> None:
        shutil.rmtree(self.base, ignore_errors=True) if self.local else self.fs.delete_dir(self.base)


class _Attempt:
    def __init__(self, store: Store, name: str):
        self.store, self.name, self.tmp = store, name, f"{name}.{uuid.uuid4().hex}.tmp"

    def __enter__(self):
        s = self.store
        if s.local:
            os.makedirs(os.path.dirname(s.path(self.name)), exist_ok=True)
            self.f = open(s.path(self.tmp), "wb")
        else:
            s.fs.create_dir(os.path.dirname(s.path(self.name)))
            self.f = s.fs.open_output_stream(s.path(self.tmp))
        return self.f

    def __exit__(self, kind, *_):
        self.f.close()
        s = self.store
        if kind is not None:
            os.remove(s.path(self.tmp)) if s.local else s.fs.delete_file(s.path(self.tmp))
        elif s.local:
            os.replace(s.path(self.tmp), s.path(self.name))
        else:
            s.fs.move(s.path(self.tmp), s.path(self.name))


def mix64(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64)
    x ^= x >> np.uint64(30)
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


def column_bytes(col) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an Arrow string or binary array and its row offsets (int64); nulls are empty."""
    import pyarrow as pa

    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.cast(pa.large_binary()) if not pa.types.is_large_binary(col.type) else col
    if col.null_count:
        col = col.fill_null(b"")
    offs = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = col.buffers()[2]
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return buf[offs[0] : offs[-1]] if len(buf) else buf, offs - offs[0]


#: White space of the word rule [^\x20\x09-\x0D]+.
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def lower_ascii(buf: np.ndarray) -> np.ndarray:
    return _LOWER[buf]


def word_spans(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words (runs without ASCII white space) and the index of each row's first word.

    Rows never share a word. The last array has len(offs) entries, as offsets.
    """
    if not len(buf):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(offs), np.int64)
    solid = ~_SPACE[buf]
    edge = np.zeros(len(buf) + 1, bool)
    edge[offs] = True
    before = np.empty(len(buf), bool)
    before[0], before[1:] = False, solid[:-1]
    starts = np.flatnonzero(solid & (~before | edge[:-1]))
    after = np.empty(len(buf), bool)
    after[-1], after[:-1] = False, solid[1:]
    ends = np.flatnonzero(solid & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offs)


#: Longer words are hashed one by one, all others eight bytes at a time for all words at once.
_LONG_WORD = 512


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, a function of its bytes alone."""
    if not len(starts):
        return np.empty(0, np.uint64)
    padded = np.zeros(len(buf) + 8, np.uint8)
    padded[: len(buf)] = buf
    eight = np.ndarray((len(buf) + 1,), "<u8", padded.data, strides=(1,))  # the eight bytes from each position on
    lens = ends - starts
    out = lens.astype(np.uint64) * GOLDEN
    at, left, now = starts, lens, np.arange(len(starts))
    while len(now):
        chunk = eight[at]
        short = left < 8
        chunk[short] &= (np.uint64(1) << (left[short].astype(np.uint64) << np.uint64(3))) - np.uint64(1)
        out[now] = mix64(out[now] ^ chunk)
        more = (left > 8) & (lens[now] <= _LONG_WORD)
        now, at, left = now[more], at[more] + 8, left[more] - 8
    for i in np.flatnonzero(lens > _LONG_WORD).tolist():
        import xxhash

        out[i] = xxhash.xxh64_intdigest(buf[starts[i] : ends[i]].tobytes())
    return out


def trim() -> None:
    """Give the memory that this process has freed back to the system. Workers stay for later tasks, and what they keep adds up
    with what those tasks need."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    free = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's alone
    if free is not None:
        free(0)


def by_bytes(batch, column: int, most: int = 2 << 20):
    """Slices of an Arrow batch whose strings in a column hold at most so many bytes together, or of one row."""
    import pyarrow.compute as pc

    size = pc.fill_null(pc.binary_length(batch.column(column)), 0)
    upto = np.cumsum(size.to_numpy(zero_copy_only=False).astype(np.int64)) if len(size) else np.empty(0, np.int64)
    lo = 0
    while lo < batch.num_rows:
        before = upto[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(upto, before + most, side="right")))
        yield batch.slice(lo, hi - lo)
        lo = hi
    trim()


def ranges(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Concatenated aranges starts[i] .. starts[i]+lens[i]."""
    total = int(lens.sum())
    if not total:
        return np.empty(0, np.int64)
    ends = np.cumsum(lens)
    return np.arange(total) + np.repeat(starts - (ends - lens), lens)


def part_count(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def uniform(col) -> F.Column:
    """A uniform number in [0, 1) fixed by the value: the first 32 bits of its MD5, the same in any SQL engine."""
    return F.conv(F.substring(F.md5(col.cast("string")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


#: Bits of a membership filter: sixteen for each member, within these bounds, so that it may go to every task.
FEWEST_BITS, MOST_BITS = 1 << 20, 1 << 30


def _slot(x: np.ndarray, bits: int) -> np.ndarray:
    return (mix64(x.view(np.uint64)) % np.uint64(bits)).astype(np.int64)


def member_bits(ids: DataFrame):
    """A bit map (broadcast, at most MOST_BITS) of the hashes of a column of longs. Very many ids pass more rows than they
    should, never fewer, so an exact join has to follow; what the map saves is the shuffle of rows in no list."""
    spark = ids.sparkSession
    ids = materialize(ids.select(F.col(ids.columns[0]).cast("long").alias("id")).na.drop(), "members")
    bits = min(MOST_BITS, max(FEWEST_BITS, 1 << (16 * ids.count()).bit_length()))

    def run(batches):
        import pyarrow as pa

        own = np.zeros(bits // 8, np.uint8)
        for batch in batches:
            p = _slot(batch.column(0).to_numpy(), bits)
            np.bitwise_or.at(own, p >> 3, (1 << (p & 7)).astype(np.uint8))
        at = np.flatnonzero(own)
        for lo in range(0, len(at), 65536):
            some = at[lo : lo + 65536]
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(own[some].astype(np.int32))], ["at", "b"])

    packed = np.zeros(bits // 8, np.uint8)
    table = ids.mapInArrow(run, "at int, b int").groupBy("at").agg(F.bit_or("b").alias("b")).toArrow()  # at most bits / 8 rows
    packed[table.column("at").to_numpy()] = table.column("b").to_numpy()
    return spark.sparkContext.broadcast(packed)


def is_member(flags: np.ndarray, x: np.ndarray) -> np.ndarray:
    p = _slot(x, 8 * len(flags))
    return (flags[p >> 3] >> (p & 7).astype(np.uint8)) & 1 == 1


def mark_members(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """rows and _likely: true if the first column (a long) is in ids, and rarely otherwise; no row moves."""
    flags, names = member_bits(ids), rows.columns

    def mark(batches):
        import pyarrow as pa

        for batch in batches:
            x = batch.column(0)
            on = is_member(flags.value, x.fill_null(0).to_numpy())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(on)], [*names, "_likely"])

    schema = T.StructType([*rows.schema.fields, T.StructField("_likely", T.BooleanType())])
    return rows.mapInArrow(mark, schema)


def likely_members(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows whose first column is in ids, and few others."""
    return mark_members(rows, ids).filter("_likely").drop("_likely")


def set_aside(df: DataFrame, *names: str) -> DataFrame:
    """df with columns of these names (in any case) renamed with the ending _input, so that results can take the names."""
    taken, out = {c.lower() for c in df.columns}, {}
    for c in df.columns:
        if c.lower() in names:
            new = f"{c}_input"
            while new.lower() in taken:
                new += "_input"
            taken.add(new.lower())
            out[c] = new
    return df.withColumnsRenamed(out) if out else df


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of steps that are done: it does so when their plans are collected."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
