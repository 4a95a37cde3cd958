"""The corpus pipeline: toxicity, line dedup, near-duplicate removal, mixing, packing, each on what the one before kept.

A stage carries the rows it was given whole, in one column, past its operator, so columns of any name come back as they
were. Defined cases, of every stage: null and empty texts are documents like any other; of repeated rows, and of rows that
share a doc_id, each is judged by its own text, and near-duplicate removal keeps one of each group; equal scores, lines and
documents fare alike but for the order of doc_id; an empty table gives an empty table; very long texts are processed whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cubeflux.llm import line_dedup, mixing, near_dup, packing, toxicity
from cubeflux.llm.common import materialize, table
from cubeflux.llm.queries import WORD_BPE, tokenizer_path


def carried(docs: DataFrame, *names: str) -> DataFrame:
    """docs as one column, row, and the columns that an operator reads, null where docs has none of that name."""
    have = {c.lower() for c in docs.columns}
    return docs.select(F.struct(*docs.columns).alias("row"), *((F.col(c) if c in have else F.lit(None).cast("string")).alias(c) for c in names))


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored 0.7 or higher go."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(carried(docs, "text"), model).filter("predicted = 0").select("row.*")


def remove_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines like an earlier line go; every document stays, with n_chars of what is left of it."""
    out = line_dedup.dedup_lines(carried(docs, "doc_id", "text"))
    now = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        now["n_chars"] = F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType)
    return out.select(*(now.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns))


def numbered(docs: DataFrame) -> DataFrame:
    """row, text and a doc_id of its own for each row: rows that share a doc_id, or have none, get numbers after all ids."""
    rows = carried(docs, "doc_id", "text")
    odd = docs.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1 or doc_id is null").select(F.col("doc_id").alias("_id"))
    odd = materialize(odd, "repeated-ids")
    if odd.isEmpty():
        return rows
    same = F.col("doc_id").eqNullSafe(F.col("_id"))
    most = docs.agg(F.max(F.col("doc_id").cast("long"))).first()[0] or 0
    late = materialize(rows.join(odd, same, "left_semi"), "repeated-rows")
    late = materialize(late.withColumn("doc_id", F.lit(most + 1).cast("long") + F.monotonically_increasing_id()), "numbered-rows")
    return rows.join(odd, same, "left_anti").unionByName(late)


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: the one with the smallest id. Rows that share a doc_id, or
    have none, come after all others. Documents without words are in no group and stay."""
    rows = numbered(docs)
    kept = near_dup.near_duplicates(rows.select("doc_id", "text")).filter("kept").select("doc_id")
    return rows.join(kept, "doc_id", "left_semi").select("row.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The largest sample, up to the budget, whose expected tokens meet the target weights."""
    names = [c for c in ("topic",) if c in docs.columns]
    return mixing.mix(carried(docs, "doc_id", "text", "source", "lang", *names), exact=True).filter("sampled").select("row.*")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their sequence and place."""
    return packing.pack(docs, tokenizer_path(WORD_BPE), slim=True)


STAGES = [
    ("toxicity", remove_toxic),
    ("line dedup", remove_repeated_lines),
    ("near-duplicates", remove_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]
#: Toxicity scores and tokens have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents, each written and read again before the next."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, f"stage-{k}")
    return docs
