"""The registered queries: each applies one operator, with its production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bm25, decontamination, divergence, html_text, line_dedup, merkle, mixing, mpeg_audio, near_dup, packing, token_files, toxicity, warc
from .common import table

BYTE_BPE, WORD_BPE = "byte_bpe_50k.json", "word_bpe_49k.json"


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_files(table(spark, sf_dir, "documents"), tokenizer_path(BYTE_BPE))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path(WORD_BPE))


def op2_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mpeg_audio.media_columns(table(spark, sf_dir, "documents"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.warc(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "block_ok")


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_pages(table(spark, sf_dir, "pages"))


def op9_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"), words=3, num=85)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "removed", "text")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.coalesce("source", F.lit("")).alias("source"), F.coalesce("lang", F.lit("")).alias("lang"), F.col("mix_topic").alias("topic"), F.col("mix_tokens").alias("n_tokens"), F.round("probability", 6).alias("probability"), "sampled")


def op10_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return bm25.top_k(docs, docs.filter("doc_id % 20 = 0"))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents"))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(table(spark, sf_dir, "documents"))


def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("items")


QUERIES = {
    "op1_mixing": op1_mixing,
    "op2_mpeg_audio": op2_mpeg_audio,
    "op3_toxicity": op3_toxicity,
    "op4_token_files": op4_token_files,
    "op5_warc": op5_warc,
    "op6_line_dedup": op6_line_dedup,
    "op7_html_text": op7_html_text,
    "op8_packing": op8_packing,
    "op9_near_dup": op9_near_dup,
    "op10_bm25": op10_bm25,
    "op11_merkle": op11_merkle,
    "op12_divergence": op12_divergence,
    "op13_decontamination": op13_decontamination,
}
ORACLE: dict[str, str] = {
    "op1_mixing": mixing.oracle_sql(),
    "op11_merkle": merkle.oracle_sql(),
    "op12_divergence": divergence.oracle_sql(),
    "op13_decontamination": decontamination.oracle_sql(),
}
