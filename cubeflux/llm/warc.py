"""WARC archives with boundary-chain verification.

Writer: one file per partition; a record per page. The first page (smallest page_id) of each payload is a ``response``,
every other one a ``revisit`` that names it.

A revisit has no block: the payload's length and digest stand in its headers, and nothing on disk but its response
holds the bytes, so ``block_ok`` (the block has the stated length and digest) says nothing about a revisit's and is true.

Reader: archives are cut into byte ranges. Each task looks for the record magic in its range, parses the header there
and notes where that record would end: candidate record -> successor offset. Payloads may hold the magic too, so a
candidate counts only if the chain from the file's start reaches it. Within its range a task follows chains itself and
hands on, for each candidate, where its chain leaves the range; pointer jumping over those few hops between ranges then
finds, in logarithmically many rounds, where the true chain enters each range.

Defined cases: null html is an empty payload; empty payloads are deduplicated like any other; rows that repeat a page_id
with equal payloads are all responses (none is smaller); a null page_id comes back null, and counts as larger than any
id; very long records may span many ranges; a url over MAX_URL bytes is stored as the urn of its SHA-1; magic in payloads,
with whatever headers or lengths after it, is no record; extra columns, whatever their names, are ignored; an empty table
gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Store, mark_members, materialize, part_count, shared_dir

MAGIC = b"WARC/1.1\r\n"
SPLIT_BYTES = 8 << 20
_NO_ID = 2**63 - 1
#: Bytes of the longest url in a header, and of the longest header that a reader takes for one.
MAX_URL, MAX_HEADER = 1 << 18, 1 << 19
_LENGTH = re.compile(rb"[0-9]{1,18}")


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record; a revisit keeps the payload's length and digest in its headers and has an empty block."""
    url = re.sub(r"[\r\n]+", " ", url or "")
    if len(raw := url.encode()) > MAX_URL:
        url = f"urn:sha1:{sha1_base32(raw)}"
    kind = "response" if refers_to is None else "revisit"
    lines = [
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Target-URI: {url}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
        payload = b""
    lines += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(payload)}"]
    return MAGIC + "\r\n".join(lines).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n"


def parse(data: bytes, at: int, before: int | None = None) -> tuple[dict[str, str], int, int] | None:
    """Headers, block start and record end of the record whose magic is at ``at``; None if no header ends in data within
    MAX_HEADER bytes and before the next magic, which no header holds."""
    stop = data.find(b"\r\n\r\n", at, min(len(data) if before is None else before, at + MAX_HEADER))
    if stop < 0:
        return None
    head = {}
    for line in data[at + len(MAGIC) : stop].split(b"\r\n"):
        key, colon, value = line.partition(b":")
        if colon:
            head[key.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    n = head.get("content-length", "").encode()
    if not _LENGTH.fullmatch(n):
        return None
    return head, stop + 4, stop + 8 + int(n)


def write_archives(pages: DataFrame, folder: str) -> list[tuple[str, int]]:
    """Write pages(page_id, url, payload, refers_to); returns (file, bytes) of each partition that had rows."""

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        name = f"pages-{TaskContext.get().partitionId():05d}.warc"
        size = 0
        with Store(folder).writer(name) as f:
            for batch in batches:
                for i, url, html, ref in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                    payload = (html or "").encode()
                    rec = record(i, url, payload, sha1_base32(payload), ref)
                    f.write(rec)
                    size += len(rec)
        yield pa.RecordBatch.from_pydict({"file": [name], "bytes": pa.array([size], pa.int64())})

    made = pages.mapInArrow(run, "file string, bytes long").collect()  # one row per partition
    return sorted((r.file, r.bytes) for r in made if r.bytes)


def _window(store: Store, name: str, start: int, end: int, size: int) -> bytes:
    """The bytes from start to end, and as many more as a header that begins before the end may have."""
    data = store.read(name, start, min(size, end + len(MAGIC)) - start)
    last = data.rfind(MAGIC, 0, end - start + len(MAGIC) - 1)
    if last < 0 or data.find(b"\r\n\r\n", last) >= 0:
        return data
    return data + store.read(name, start + len(data), max(0, min(size, start + last + MAX_HEADER) - start - len(data)))


def _candidates(data: bytes, start: int, end: int, size: int) -> dict[int, int]:
    """Absolute offset of each magic in [start, end) -> where its record would end."""
    out, at = {}, data.find(MAGIC)
    while 0 <= at < end - start:
        after = data.find(MAGIC, at + 1)
        got = parse(data, at, after if after >= 0 else None)
        if got and start + got[2] <= size:
            out[start + at] = start + got[2]
        at = after
    return out


def _splits(spark: SparkSession, files: list[tuple[str, int]], split: int) -> DataFrame:
    """(file, start, end, size) of byte ranges; files: one for each partition that wrote."""
    df = spark.createDataFrame(files, "file string, size long")
    cut = df.select("file", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(split).cast("long"))).alias("start"), "size")
    ranges = sum(-(-size // split) for _, size in files)
    cut = cut.select("file", "start", F.least(F.col("start") + split, "size").alias("end"), "size")
    return cut.repartition(min(ranges, max(part_count(spark), 2 * spark.sparkContext.defaultParallelism)), "file", "start")


def verified_entries(spark: SparkSession, folder: str, files: list[tuple[str, int]], split: int = SPLIT_BYTES) -> DataFrame:
    """(file, entry): for each byte range that a true record begins in, the first such record's offset."""

    def hops(batches):
        import pyarrow as pa

        store = Store(folder)
        for batch in batches:
            for name, a, b, size in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                nxt = _candidates(_window(store, name, a, b, size), a, b, size)
                leaves = {}
                for at in sorted(nxt, reverse=True):
                    leaves[at] = leaves.get(nxt[at], nxt[at])
                yield pa.RecordBatch.from_pydict({"file": pa.array([name] * len(leaves), pa.string()), "at": pa.array(list(leaves), pa.int64()), "to": pa.array(list(leaves.values()), pa.int64())})

    jump = materialize(_splits(spark, files, split).mapInArrow(hops, "file string, at long, to long"), "warc-hops")
    reached = spark.createDataFrame([(f, 0) for f, _ in files], "file string, at long")
    longest = max((-(-size // split) for _, size in files), default=1)
    covered = 1
    while covered < longest:  # each round doubles the hops that are covered
        step = reached.join(jump, ["file", "at"]).select("file", F.col("to").alias("at"))
        reached = materialize(reached.union(step).distinct(), "warc-reached")
        covered *= 2
        if covered < longest:
            then = jump.select("file", F.col("at").alias("to"), F.col("to").alias("further"))
            jump = materialize(jump.join(then, ["file", "to"], "left").select("file", "at", F.coalesce("further", "to").alias("to")), "warc-hops")
    return reached


RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, file string, offset long, block_ok boolean"


def read_archives(spark: SparkSession, folder: str, files: list[tuple[str, int]], split: int = SPLIT_BYTES) -> DataFrame:
    """A row per verified record, from the bytes on disk."""
    if not files:
        return spark.createDataFrame([], RECORDS)
    entries = verified_entries(spark, folder, files, split)
    sizes = spark.createDataFrame(files, "file string, size long")
    ranged = entries.join(F.broadcast(sizes), "file").filter("at < size")  # a row per archive
    ranged = ranged.select("file", F.col("at").alias("start"), (F.floor(F.col("at") / split) * split + split).cast("long").alias("end"), "size").repartition("file", "start")

    def page(urn: str) -> int | None:
        digits = urn[len("<urn:page:") : -1]
        return int(digits) if digits else None

    def run(batches):
        import pyarrow as pa

        store = Store(folder)
        fields = [pa.field(x.split()[0], {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}[x.split()[1]]) for x in RECORDS.split(", ")]
        for batch in batches:
            for name, at, end, size in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                data, base, rows = _window(store, name, at, min(end, size), size), at, []
                while at < min(end, size):
                    head, block, stop = parse(data, at - base)
                    body = data[block : stop - 4]
                    if base + stop > base + len(data):  # the block reaches past the window
                        body = store.read(name, base + block, stop - 4 - block)
                    kind, digest = head["warc-type"], head["warc-payload-digest"].removeprefix("sha1:")
                    ok = kind == "revisit" or (sha1_base32(body) == digest and len(body) == int(head["x-payload-length"]))
                    ref = page(head["warc-refers-to"]) if kind == "revisit" else None
                    rows.append((page(head["warc-record-id"]), head.get("warc-target-uri"), int(head["x-payload-length"]), digest, kind, ref, name, at, ok))
                    at = base + stop
                cols = list(zip(*rows, strict=True)) or [[] for _ in fields]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, fields, strict=True)], schema=pa.schema(fields))

    return ranged.mapInArrow(run, RECORDS)


def with_references(pages: DataFrame) -> DataFrame:
    """pages with refers_to: the smallest page_id with an equal payload, null for that page itself.

    Digests travel without their payloads: first the smallest id of each digest, then that id back to each page.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha1("html"))
    least = rows.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1 and first is not null")
    # only digests that occur again need a lookup; pages of any other digest stay where they are
    keys = rows.select("digest", "page_id").join(least, "digest").filter("page_id is null or page_id > first").select(F.coalesce("page_id", F.lit(_NO_ID)).alias("key"), "digest", "first").distinct()
    keys = materialize(keys, "warc-keys")
    keyed = rows.select(F.coalesce("page_id", F.lit(_NO_ID)).alias("key"), "page_id", "url", "html", "digest")
    marked = mark_members(keyed, keys.select("key"))
    looked_up = marked.filter("_likely").join(keys, ["key", "digest"], "left")
    out = ["page_id", "url", "html"]
    return marked.filter("not _likely").select(*out, F.lit(None).cast("long").alias("refers_to")).union(looked_up.select(*out, F.col("first").alias("refers_to")))


def warc(pages: DataFrame, split: int = SPLIT_BYTES) -> DataFrame:
    """Write archives of all pages and read them back."""
    spark = pages.sparkSession
    folder = shared_dir(spark, "warc")
    return read_archives(spark, folder, write_archives(with_references(pages), folder), split)
