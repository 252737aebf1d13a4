"""Loading content drops once: files that were loaded before are known by name and digest.

    loaded/N.json         the record after N loads, which names the attempts that count
    files/name=A          name and digest of the files of attempt A
    rows/name=A           lines that parsed
    rejects/name=A        the others, with the reason

A load counts from its record on. One that died is loaded again as a whole, and
running a load again adds nothing but files that are new or have changed.
"""

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from drillbook.sources.records import Records
from drillbook.sources.tables import ingest_content

_FILES = "file string, digest string"
_REJECTS = "line string, reason string"


def _attempts(spark: SparkSession, root: str) -> tuple[int, list[str]]:
    found = Records(spark, f"{root}/loaded").latest()
    return (found[0], found[1]["attempts"]) if found else (0, [])


def _read(spark: SparkSession, root: str, table: str, schema) -> DataFrame:
    paths = [f"{root}/{table}/name={name}" for name in _attempts(spark, root)[1]]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def loaded_files(spark: SparkSession, root: str) -> DataFrame:
    """The ledger: file and digest of everything loaded."""
    return _read(spark, root, "files", _FILES)


def loaded_rows(spark: SparkSession, root: str, schema: StructType) -> DataFrame:
    return _read(spark, root, "rows", schema)


def loaded_rejects(spark: SparkSession, root: str) -> DataFrame:
    return _read(spark, root, "rejects", _REJECTS)


def load_drop(spark: SparkSession, root: str, path: str, schema: StructType) -> int:
    """Load the files of a folder that are not in the ledger; returns how many there were.

    Digests are taken where the files are read; only the paths of new files come
    to the driver, as a reader needs them. A file that changed under its name is
    loaded again beside what it held before. Of two loads at once the second to
    finish is refused.
    """
    number, attempts = _attempts(spark, root)
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(
        "path", F.substring_index("path", "/", -1).alias("file"), F.sha2("content", 256).alias("digest")
    )
    new = found.join(loaded_files(spark, root), ["file", "digest"], "left_anti")
    attempt = f"{number + 1}-{uuid.uuid4().hex[:8]}"
    new.write.parquet(f"{root}/files/name={attempt}")
    files = spark.read.parquet(f"{root}/files/name={attempt}")
    # One file of each name and content, should the folder hold it twice.
    paths = [row["path"] for row in files.groupBy("file", "digest").agg(F.min("path").alias("path")).collect()]
    if not paths:
        return 0
    good, bad = ingest_content(spark, paths, schema)
    good.write.parquet(f"{root}/rows/name={attempt}")
    bad.write.parquet(f"{root}/rejects/name={attempt}")
    Records(spark, f"{root}/loaded").put(number + 1, {"attempts": [*attempts, attempt]})
    return len(paths)
