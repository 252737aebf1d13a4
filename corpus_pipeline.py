"""From raw documents to packed training sequences.

`STAGES` are applied in order, each to what its predecessor wrote. All but the
last return the columns of documents; `n_chars` follows the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from drillbook.llm import lines, mixing, near_dups, oracle, packing, queries, toxicity
from drillbook.llm.shared import Scratch, read, words


def _like(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of `docs`, with n_chars counted anew."""
    counted = F.length("text").cast("long")
    return rows.select(
        *[counted.alias(name) if name == "n_chars" else F.col(f"`{name}`") for name in docs.columns]
    )


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, fitted on the labels, does not reject."""
    return toxicity.drop_toxic(docs, toxicity.fit(docs, read(spark, sf_dir, "labels")))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that ten or more of them share."""
    return _like(lines.drop_repeated_lines(docs), docs)


def drop_near_dups(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    return near_dups.drop_near_dups(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per copy that the mix of sources takes, the last of a source cut to its budget."""
    return _like(mixing.mixed_copies(mixing.mix_sources(docs, words(F.col("text")))), docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their places in sequences."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("minhash_near_dedup", drop_near_dups),
    ("source_mix", mix),
    ("packing", pack),
]

#: The toxicity model, the near-duplicate search and the tokenizer have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = scratch.write(stage(spark, docs, sf_dir), name)
    return docs


QUERIES = queries.QUERIES | {"pipeline": run}
ORACLES = dict(oracle.ORACLES)
