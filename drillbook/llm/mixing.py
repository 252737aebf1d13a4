"""Mixing sources to target weights, to the word and without a random generator."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import packed, unpacked

#: Hex digits of the hash key that make up the range of a part: 16 ** 3 parts a source.
PART_DIGITS = 3


def source_targets(
    sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_repeats: int = 3
) -> DataFrame:
    """Target per source from rows of (source, size).

    Returns source, source_size and target. Sources by code point, null last,
    weigh 1, 2, 3, 1, ... and share the sum of all sizes. A target stops at
    `max_repeats` times its source's size and the excess goes to the others by
    weight, until none is above. That ends at one level L with target =
    min(weight * L, cap). With sources in order of cap / weight, L is the
    largest of (total - caps before) / (weights from here on).

    The windows below hold one row per source, never rows of documents.
    """
    totals = sizes.groupBy("source").agg(F.coalesce(F.sum("size"), F.lit(0)).alias("source_size"))
    cycle = F.array(*[F.lit(weight) for weight in weights])
    rank = F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1
    weighed = totals.select(
        "source",
        "source_size",
        F.get(cycle, rank % len(weights)).cast("long").alias("weight"),
        (F.col("source_size") * max_repeats).alias("cap"),
    )
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.asc_nulls_last("source"))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(0, Window.unboundedFollowing)
    all_rows = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    levels = weighed.withColumn(
        "level",
        (
            F.sum("source_size").over(all_rows) - F.coalesce(F.sum("cap").over(before), F.lit(0))
        ).cast("double")
        / F.sum("weight").over(after),
    )
    return levels.select(
        "source",
        "source_size",
        F.least(F.col("weight") * F.max("level").over(all_rows), F.col("cap").cast("double")).alias(
            "target"
        ),
    )


def mix_sources(
    documents: DataFrame,
    size: Column,
    weights: tuple[int, ...] = (1, 2, 3),
    max_repeats: int = 3,
    seed: str = "mix",
) -> DataFrame:
    """Documents with size, source_size, target and taken (words the mix takes).

    `size` is a column of the words of a row; null counts 0. Every row gets a
    hash key from seed and doc_id. A source is taken whole as often as its
    target holds its size; of the rest, documents go in by key until the exact
    budget (the rounded target), where the last one is cut. So taken is at
    most `max_repeats` times size and the taken words of a source sum to its
    rounded target. Rows that repeat a doc_id share a key and follow each
    other by size. Rows without a source are a source of their own; rows
    without a doc_id share the key of the empty id. Without rows there is no
    result row. Input columns with the names of results are replaced.

    A prefix sum runs within a range of hash keys of one source; the sums of
    the ranges before it are added. So the largest source is spread over 4096
    ranges and no window holds a whole source.
    """
    key = F.md5(F.concat_ws(":", F.lit(seed), F.col("doc_id").cast("string")))
    rows = packed(
        documents,
        F.col("source").alias("source"),
        F.coalesce(size, F.lit(0)).cast("long").alias("size"),
        key.alias("key"),
        F.substring(key, 1, PART_DIGITS).alias("part"),
    )
    slim = documents.select(
        F.col("source").alias("source"),
        F.coalesce(size, F.lit(0)).cast("long").alias("size"),
        F.substring(key, 1, PART_DIGITS).alias("part"),
    )
    parts = slim.groupBy("source", "part").agg(F.sum("size").alias("size"))
    targets = source_targets(parts, weights, max_repeats)
    earlier = (
        Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    )
    starts = parts.select(
        F.col("source").alias("of"),
        F.col("part").alias("in_part"),
        F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("part_start"),
    ).join(
        targets.withColumnRenamed("source", "target_of"),
        F.col("of").eqNullSafe(F.col("target_of")),
    )
    inside = (
        Window.partitionBy("source", "part")
        .orderBy("key", "size")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    summed = rows.withColumn("so_far", F.sum("size").over(inside)).join(
        starts,
        F.col("source").eqNullSafe(F.col("of")) & (F.col("part") == F.col("in_part")),
    )
    budget = F.least(F.floor(F.col("target") + 0.5), F.col("source_size") * max_repeats)
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0)
    summed = summed.withColumn("epochs", epochs).withColumn(
        "rest", budget - F.col("epochs") * F.col("source_size")
    )
    start = F.col("part_start") + F.col("so_far") - F.col("size")
    taken = F.col("epochs") * F.col("size") + F.least(
        F.col("size"), F.greatest(F.lit(0), F.col("rest") - start)
    )
    return unpacked(
        summed,
        documents,
        size=F.col("size"),
        source_size=F.col("source_size"),
        target=F.col("target"),
        taken=taken.cast("long"),
    )


def mixed_copies(mixed: DataFrame) -> DataFrame:
    """One row per copy that the mix takes, from `mix_sources` with a text.

    A whole copy keeps its text; the copy in which the budget ends keeps its
    first words with the white space between them. Rows that take nothing go.
    """
    n_copies = F.ceil(F.col("row.taken") / F.col("row.size")).cast("int")
    copies = packed(mixed.where("taken > 0")).withColumn(
        "copy", F.explode(F.sequence(F.lit(1), n_copies))
    )
    left = F.col("row.taken") - (F.col("copy") - 1) * F.col("row.size")
    cut = F.array_join(
        F.slice(
            F.regexp_extract_all("row.text", F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0)),
            F.lit(1),
            left.cast("int"),
        ),
        "",
    )
    return unpacked(
        copies,
        mixed,
        text=F.when(left >= F.col("row.size"), F.col("row.text")).otherwise(cut),
    )
