"""Replacing whole tables: write a new version next to the old one, then name it current.

Parquet has no row updates, so an updated table is a new folder. A version is
current once its record stands (`records`); readers resolve it once per job, so
they never see a half-written table and never read a path that is being
overwritten. The record names the folder of every table, so a version can be
read again until it is dropped.
"""

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from drillbook.sources.records import Folder, Records, RecordTaken


def shared_folder(spark: SparkSession, name: str, base: str | None = None) -> str:
    """A fresh path in the folder every executor sees: `base`, or `spark.checkpoint.dir`."""
    base = base or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        raise ValueError("set spark.checkpoint.dir to a folder shared by the cluster")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def write_once(rows: DataFrame, name: str) -> DataFrame:
    """Write rows to a fresh shared folder and go on from the written table.

    For results that several branches of a job use: the work before is done
    once, and a lost executor costs a read, not the whole lineage.
    """
    spark = rows.sparkSession
    path = shared_folder(spark, name)
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def _records(spark: SparkSession, root: str) -> Records:
    return Records(spark, f"{root.rstrip('/')}/published")


def current_version(spark: SparkSession, root: str) -> int:
    """Number of the current version, or 0 when nothing was published yet."""
    numbers = _records(spark, root).numbers()
    return numbers[-1] if numbers else 0


def publish_tables(
    spark: SparkSession, root: str, tables: dict[str, DataFrame], base: int | None = None
) -> int:
    """Write the tables as one new version; they become current together.

    `base` is the version the tables were made from: where another is current,
    the publisher is refused before it writes. Of two that began at the same
    version the first to finish wins and the other is refused; its folder is
    named by no record. What a failed publisher left is neither read nor
    overwritten.
    """
    records = _records(spark, root)
    number, state = records.latest() or (0, {"tables": {}})
    if base is not None and base != number:
        raise RecordTaken(f"made from version {base} of {root}, where {number} is current")
    folder = f"version={number + 1}-{uuid.uuid4().hex[:8]}"
    for name, table in tables.items():
        table.write.parquet(f"{root}/{folder}/{name}")
    records.put(number + 1, {"tables": {**state["tables"], **dict.fromkeys(tables, folder)}})
    return number + 1


def tables_of_version(spark: SparkSession, root: str, version: int | None = None) -> dict[str, str]:
    """The folder of every table as of a version, the current one by default."""
    records = _records(spark, root)
    if version is not None:
        if version not in records.numbers():
            raise ValueError(f"version {version} of {root} was never published or has been dropped")
        return records.read(version)["tables"]
    found = records.latest()
    return found[1]["tables"] if found else {}


def read_version(
    spark: SparkSession,
    root: str,
    name: str,
    schema: StructType | None = None,
    version: int | None = None,
) -> DataFrame:
    """The table as of a version, the current one by default."""
    folder = tables_of_version(spark, root, version).get(name)
    if folder is None:
        raise ValueError(f"table {name} was never published under {root}")
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.parquet(f"{root}/{folder}/{name}")


def replace_table(spark: SparkSession, root: str, name: str, rows: DataFrame) -> DataFrame:
    """Replace every row of one table and return the new content."""
    publish_tables(spark, root, {name: rows})
    return read_version(spark, root, name)


def drop_versions(spark: SparkSession, root: str, keep: int = 2) -> int:
    """Keep the last `keep` versions; returns the number of folders deleted.

    A folder stays as long as a kept version names it, which an old one may for
    a table that no later version replaced, and so do folders of publishers
    that began after the oldest version kept.
    """
    kept = _records(spark, root).forget(keep)
    named = {folder for _, state in kept for folder in state["tables"].values()}
    deleted, system = 0, Folder(spark, root)
    for item in system.names():
        if not item.startswith("version=") or not kept or item in named:
            continue
        if int(item.split("=")[1].split("-")[0]) <= kept[0][0]:
            system.delete(item)
            deleted += 1
    return deleted
