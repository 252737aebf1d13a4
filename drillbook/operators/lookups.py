"""Keyed lookups in bulk, their row-count contracts, and referential actions.

None of the joins is forced to broadcast: Spark broadcasts a side that its size
estimate, or the measured size at run time, puts under the threshold, and
splits hot shuffle partitions otherwise.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from drillbook.schemas import FOREIGN_KEYS, PRIMARY_KEYS

def single_rows(table: DataFrame, key: str = "id") -> DataFrame:
    """The rows whose key no other row has.

    Rows are counted in each task before they move, so a key repeated without
    end is one row per task. The shuffle by key serves the join behind it.
    """
    rest = [name for name in table.columns if name != key]
    return (
        table.groupBy(key)
        .agg(F.count(F.lit(1)).alias("_n"), *[F.first(name).alias(name) for name in rest])
        .where("_n = 1")
        .select(*table.columns)
    )


def lookup_join(
    rows: DataFrame,
    table: DataFrame,
    foreign_key: str,
    key: str = "id",
    optional: bool = False,
) -> DataFrame:
    """Join each row to its one looked-up row.

    A key that several rows of the table have stands for none of them, so a
    lookup never multiplies rows. A required lookup leaves out rows without a
    match; an optional one keeps them with nulls; `lookup_violations` lists
    absent and repeated keys. The lookup key itself is not repeated in the
    result; other columns of the two sides must differ.
    """
    looked_up = single_rows(table, key).withColumnRenamed(key, "_lookup_key")
    how = "left" if optional else "inner"
    return rows.join(looked_up, F.col(foreign_key) == F.col("_lookup_key"), how).drop("_lookup_key")


def lookup_violations(
    rows: DataFrame, table: DataFrame, foreign_key: str, key: str = "id"
) -> DataFrame:
    """Lookups that break the one-row contract: per key value, the problem and the row count.

    `missing` counts the rows that look for an absent key, `duplicate` the table
    rows that share a key.
    """
    wanted = (
        rows.where(F.col(foreign_key).isNotNull())
        .groupBy(F.col(foreign_key).cast("string").alias("key_value"))
        .agg(F.count("*").alias("row_count"))
    )
    held = table.groupBy(F.col(key).cast("string").alias("key_value")).agg(
        F.count("*").alias("row_count")
    )
    missing = wanted.join(held, "key_value", "left_anti").withColumn("problem", F.lit("missing"))
    duplicate = held.where("row_count > 1").withColumn("problem", F.lit("duplicate"))
    return missing.unionByName(duplicate).select("key_value", "problem", "row_count")


def cascade_delete(
    children: DataFrame, kept_parents: DataFrame, foreign_key: str, key: str = "id"
) -> DataFrame:
    """Children that survive when only `kept_parents` remain.

    A child without a parent reference stays; such rows go through the same join
    under keys of their own, so the children are read once and a column that is
    mostly null does not send its nulls to one task.
    """
    reference = F.col(foreign_key).cast("string")
    spread = F.concat(F.lit("free "), F.xxhash64(*children.columns).cast("string"))
    bound = F.concat(F.lit("bound "), reference)
    parents = (
        kept_parents.select(F.concat(F.lit("bound "), F.col(key).cast("string")).alias("_key"))
        .distinct()
        .withColumn("_kept", F.lit(True))
    )
    return (
        children.withColumn("_key", F.coalesce(bound, spread))
        .join(parents, "_key", "left")
        .where(F.col(foreign_key).isNull() | F.col("_kept"))
        .select(*children.columns)
    )


def restrict_violations(
    deletions: DataFrame, children: DataFrame, foreign_key: str, key: str = "id"
) -> DataFrame:
    """Rows asked to be deleted that children still refer to.

    References are made distinct map-side first: the right side of a semi join
    cannot be split where one row has most of the children.
    """
    used = children.select(F.col(foreign_key).alias(key)).distinct()
    return deletions.join(used, key, "left_semi").select(*deletions.columns)


def delete_rows(
    tables: dict[str, DataFrame], deletions: dict[str, DataFrame | None]
) -> tuple[dict[str, DataFrame], DataFrame | None]:
    """The tables without some rows and everything that their foreign keys take along.

    `deletions` gives per table the keys to delete, or None for every row.
    Parents are walked before their children: a cascading key deletes the
    children of deleted rows, however deep; a restricting one forbids deleting a
    row that a child still refers to after all deletions. Returns the tables
    that changed, and the forbidden deletions as (table, key_value, used_by), or
    None where no restricting key is concerned. Tables that were not given are
    not followed.
    """
    kept: dict[str, DataFrame] = {}
    waiting = [name for name in tables]
    while waiting:
        name = next(n for n in waiting if not any(c == n and p in waiting for c, _, p, _ in FOREIGN_KEYS))
        waiting.remove(name)
        rows = tables[name]
        if name in deletions:
            key, gone = PRIMARY_KEYS[name][0], deletions[name]
            rows = rows.where(F.lit(False)) if gone is None else rows.join(
                gone.select(key).distinct(), key, "left_anti"
            ).select(*rows.columns)
            kept[name] = rows
        for child, column, parent, action in FOREIGN_KEYS:
            if child == name and parent in kept and action == "cascade":
                rows = kept[name] = cascade_delete(rows, kept[parent], column)
    forbidden = None
    for child, column, parent, action in FOREIGN_KEYS:
        if action != "restrict" or parent not in kept or child not in tables:
            continue
        key = PRIMARY_KEYS[parent][0]
        used = kept.get(child, tables[child]).select(F.col(column).alias(key)).distinct()
        lost = tables[parent].select(key).join(kept[parent].select(key).distinct(), key, "left_anti")
        found = lost.distinct().join(used, key, "left_semi").select(
            F.lit(parent).alias("table"),
            F.col(key).cast("string").alias("key_value"),
            F.lit(child).alias("used_by"),
        )
        forbidden = found if forbidden is None else forbidden.unionByName(found)
    return kept, forbidden
