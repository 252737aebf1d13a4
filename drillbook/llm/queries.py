"""The registered queries of this subpackage: whole tables, production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    byte_pairs,
    embeddings,
    filter_audit,
    fingerprints,
    html_text,
    lines,
    mixing,
    near_dups,
    packing,
    secrets,
    tokens,
    toxicity,
    vector_codes,
)
from .shared import read, words


def op1_embedding_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_vectors(read(spark, sf_dir, "embeddings"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(read(spark, sf_dir, "documents"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"))


def op4_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = read(spark, sf_dir, "documents").select(
        "doc_id", "source", words(F.col("text")).alias("size")
    )
    return mixing.mix_sources(sized, F.col("size")).select(
        "doc_id", "size", "source_size", "target", "taken"
    )


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_documents(read(spark, sf_dir, "documents"))


def op6_minhash_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = near_dups.near_classes(read(spark, sf_dir, "documents"))
    return classes.select("doc_id", "class_id", "kept")


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(read(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read(spark, sf_dir, "documents")
    model = toxicity.fit(documents, read(spark, sf_dir, "labels"))
    return toxicity.score_toxicity(documents, model)


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_text(read(spark, sf_dir, "pages"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read(spark, sf_dir, "documents").select("doc_id", "text")
    return lines.drop_repeated_lines(documents).select(
        "doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256")
    )


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit_documents(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op12_byte_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_pairs.digests(byte_pairs.encode_documents(read(spark, sf_dir, "documents")))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, codebooks = vector_codes.compress(read(spark, sf_dir, "embeddings"))
    return rows.select(
        "vec_id",
        "code",
        "error",
        "label_error",
        F.lit(vector_codes.codebooks_sha256(codebooks)).alias("codebooks_sha256"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_embedding_near_dups": op1_embedding_near_dups,
    "op2_token_counts": op2_token_counts,
    "op3_packing": op3_packing,
    "op4_source_mix": op4_source_mix,
    "op5_fingerprints": op5_fingerprints,
    "op6_minhash_near_dups": op6_minhash_near_dups,
    "op7_secrets": op7_secrets,
    "op8_toxicity": op8_toxicity,
    "op9_html_text": op9_html_text,
    "op10_line_dedup": op10_line_dedup,
    "op11_filter_audit": op11_filter_audit,
    "op12_byte_pairs": op12_byte_pairs,
    "op13_vector_codes": op13_vector_codes,
}
