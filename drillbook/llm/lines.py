"""Line de-duplication: lines that many documents share go from all of them."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import SPACES, Scratch, packed, unpacked


def line_keys(text: Column) -> Column:
    """Array of line keys: ends stripped of ASCII white space, A-Z lower-cased."""
    return F.transform(
        F.split(F.coalesce(text, F.lit("")), "\n"),
        lambda line: F.translate(
            F.trim(line, F.lit(SPACES)), string.ascii_uppercase, string.ascii_lowercase
        ),
    )


def _hashes(text: Column, min_chars: int) -> Column:
    """Hash per line; null for a key that is too short to count."""
    return F.transform(
        line_keys(text), lambda key: F.when(F.length(key) >= min_chars, F.xxhash64(key))
    )


def repeated_lines(
    documents: DataFrame, min_documents: int = 10, min_chars: int = 1
) -> DataFrame:
    """Hashes of line keys found in at least `min_documents` documents.

    Pairs of hash and document are made distinct first, so the rows of a line
    that everybody has are spread over its documents; the count per hash then
    gets one row per hash and task.
    """
    found = documents.select(
        "doc_id", F.explode(F.array_distinct(_hashes(F.col("text"), min_chars))).alias("hash")
    ).where("hash is not null")
    return (
        found.distinct()
        .groupBy("hash")
        .agg(F.count(F.lit(1)).alias("n_documents"))
        .where(F.col("n_documents") >= min_documents)
        .select("hash")
    )


def drop_repeated_lines(
    documents: DataFrame, min_documents: int = 10, min_chars: int = 1
) -> DataFrame:
    """Documents with the remaining lines as `text`, plus `n_lines` and `n_dropped`.

    Lines are split at line feeds; a null or empty text is one empty line. A
    line's key is the line stripped of ASCII white space with A-Z lower-cased.
    A key of `min_chars` or more code points that `min_documents` documents or
    more hold loses all its lines everywhere; other lines stay in place, joined
    by line feeds. Rows that repeat a doc_id count as one document, as do all
    rows without one. A document that loses every line keeps an empty text.
    Other columns stay; an input column named n_lines or n_dropped is replaced.

    Which lines go depends on the text alone, so decisions are kept per
    distinct text and joined back; thousands of copies share one row of them.
    Frequent hashes, and then decisions, are written first: the joins with them
    have a plain shuffle on either side, which adaptive execution splits at a
    line or a text that a large part of the documents has, or none where they
    are few.
    """
    scratch = Scratch(documents.sparkSession, "lines")
    rows = packed(documents, F.md5(F.coalesce("text", F.lit(""))).alias("text_key"))
    frequent = scratch.write(
        repeated_lines(documents.select("doc_id", "text"), min_documents, min_chars), "frequent"
    )
    places = (
        documents.select(
            F.md5(F.coalesce("text", F.lit(""))).alias("text_key"),
            F.explode(F.array_distinct(_hashes(F.col("text"), min_chars))).alias("hash"),
        )
        .where("hash is not null")
        .distinct()
    )
    decided = scratch.write(
        places.join(frequent, "hash", "left_semi")
        .groupBy("text_key")
        .agg(F.collect_list("hash").alias("drop")),
        "decided",
    )
    text = F.coalesce(F.col("row.text"), F.lit(""))
    lines = F.split(text, "\n")
    left = F.transform(
        F.filter(
            F.arrays_zip(lines.alias("line"), _hashes(text, min_chars).alias("hash")),
            lambda pair: pair["hash"].isNull() | ~F.array_contains(F.col("drop"), pair["hash"]),
        ),
        lambda pair: pair["line"],
    )
    split = rows.join(decided, "text_key", "left").select(
        "row",
        F.size(lines).cast("long").alias("n_lines"),
        F.when(F.col("drop").isNotNull(), left).alias("left"),
    )
    return unpacked(
        split,
        documents,
        text=F.when(F.col("left").isNull(), text).otherwise(F.array_join("left", "\n")),
        n_lines=F.col("n_lines"),
        n_dropped=F.when(F.col("left").isNull(), F.lit(0)).otherwise(
            F.col("n_lines") - F.size("left")
        ).cast("long"),
    )
