"""Token-ID output: flat unsigned integer files with 64-bit document offsets, memory-mapped.

Layout per partition: ``part-NNNNN.bin`` holds the ids (unsigned 16- or 32-bit, little endian), ``.idx`` the 64-bit
token offset of each document and the end, ``.doc`` the 64-bit document ids. Partitions follow one another in ascending
doc_id order; the base of each comes from a prefix sum over the partitions' token counts, so no file is rewritten.

Defined cases: null or empty text gives the end id alone; a null doc_id sorts first and comes back null; rows that share
a doc_id are each written, in the order of their text's hash; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Store, part_count, shared_dir

SCHEMA = "doc_id long, start long, n_tokens long, ids_crc32 long"
#: The doc_id stored for null.
_NULL_ID = -(2**63)


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int, folder: str, partitions: int, width: int = 4) -> list[tuple[int, int, int]]:
    """Write documents in ascending doc_id order; returns (part, documents, tokens) of each non-empty partition."""
    dtype = {2: "<u2", 4: "<u4"}[width]

    def write(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        from .fasttok import encoder

        part, store, enc = TaskContext.get().partitionId(), Store(folder), None
        docs_n, tokens = 0, 0
        bin_, idx, doc = (store.writer(f"part-{part:05d}.{x}") for x in ("bin", "idx", "doc"))
        with bin_ as b, idx as i, doc as d:
            i.write(np.zeros(1, "<i8").tobytes())
            for batch in batches:
                if not batch.num_rows:
                    continue
                enc = enc or encoder(tokenizer)
                ids, offs = enc.encode(batch.column(1))
                n = batch.num_rows
                out = np.empty(len(ids) + n, np.uint32)
                ends = offs[1:] + np.arange(n)
                body = np.ones(len(out), bool)
                body[ends] = False
                out[body], out[ends] = ids, end_id
                if width == 2 and len(out) and int(out.max()) > 0xFFFF:
                    raise ValueError("an id needs more than 16 bits")
                b.write(out.astype(dtype).tobytes())
                i.write((tokens + ends + 1).astype("<i8").tobytes())
                d.write(batch.column(0).fill_null(_NULL_ID).to_numpy().astype("<i8").tobytes())
                docs_n, tokens = docs_n + n, tokens + len(out)
        yield pa.RecordBatch.from_pydict({"part": [part], "docs": [docs_n], "tokens": [tokens]}, pa.schema([("part", pa.int64()), ("docs", pa.int64()), ("tokens", pa.int64())]))

    ordered = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
        .repartitionByRange(partitions, "doc_id")
        .sortWithinPartitions("doc_id", F.xxhash64("text"))
    )
    # one row for each partition comes to the driver, whatever the size of the table
    made = ordered.mapInArrow(write, "part long, docs long, tokens long").collect()
    return sorted((r.part, r.docs, r.tokens) for r in made if r.docs)


def read_token_files(spark, folder: str, parts: list[tuple[int, int, int]], width: int = 4) -> DataFrame:
    """A row per document with its global start, length and checksum, read through memory maps."""
    if not parts:
        return spark.createDataFrame([], SCHEMA)
    dtype = {2: "<u2", 4: "<u4"}[width]
    names = [p for p, _, _ in parts]
    bases = np.cumsum([0] + [t for _, _, t in parts])[:-1]

    def read(batches):
        import pyarrow as pa

        store = Store(folder)
        for batch in batches:
            for k in batch.column(0).to_pylist():
                ids, idx, doc = (store.array(f"part-{names[k]:05d}.{x}", t) for x, t in (("bin", dtype), ("idx", "<i8"), ("doc", "<i8")))
                for lo in range(0, len(doc), 8192):
                    hi = min(lo + 8192, len(doc))
                    offs = np.asarray(idx[lo : hi + 1])
                    crc = [zlib.crc32(np.asarray(ids[a:b]).astype("<u4", copy=False)) for a, b in zip(offs[:-1], offs[1:], strict=True)]
                    ids_of = np.asarray(doc[lo:hi])
                    yield pa.RecordBatch.from_arrays([pa.array(ids_of, mask=ids_of == _NULL_ID), pa.array(offs[:-1] + bases[k]), pa.array(np.diff(offs)), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return spark.range(0, len(parts), 1, len(parts)).mapInArrow(read, SCHEMA)


def id_width(tokenizer: str) -> int:
    """Bytes of an id: two where the vocabulary allows it."""
    from tokenizers import Tokenizer

    return 2 if Tokenizer.from_file(tokenizer).get_vocab_size() <= 0x10000 else 4


def token_files(docs: DataFrame, tokenizer: str, end_id: int = 2, width: int | None = None) -> DataFrame:
    """Encode, write, and read back every document."""
    spark = docs.sparkSession
    folder, width = shared_dir(spark, "tokens"), width or id_width(tokenizer)
    parts = write_token_files(docs, tokenizer, end_id, folder, part_count(spark), width)
    return read_token_files(spark, folder, parts, width)
