"""What several operators of this subpackage use."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: ASCII white space, as in [\x20\x09-\x0D].
SPACES = " \t\n\x0b\x0c\r"
#: Rows and bytes that a Python worker turns into objects at a time, about.
SLICE_ROWS, SLICE_BYTES = 256, 16_000_000


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def importable(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver did.

    A cluster has the package installed; a local session may have been started
    anywhere.
    """
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    environment = spark.sparkContext.environment
    paths = environment.get("PYTHONPATH", os.environ.get("PYTHONPATH", "")).split(os.pathsep)
    if root not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([root, *filter(None, paths)])


class Scratch:
    """Tables of one job under `spark.checkpoint.dir`, which all executors share.

    A written table is read instead of computed again when an executor is lost.
    Only a local session without the setting, as in tests, gets a folder of
    this machine.
    """

    def __init__(self, spark: SparkSession, job: str):
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not re.match(r"local(\[|$)", spark.sparkContext.master):
                raise ValueError("set spark.checkpoint.dir to a folder shared by the cluster")
            base = f"file://{tempfile.gettempdir()}/drillbook-scratch"
        self.spark = spark
        self.root = f"{base.rstrip('/')}/{job}-{uuid.uuid4().hex}"

    def write(self, rows: DataFrame, name: str) -> DataFrame:
        rows.write.parquet(f"{self.root}/{name}")
        return self.read(name, rows.schema)

    def read(self, name: str, schema: str | StructType) -> DataFrame:
        """A written table, or all that were written as name/key=value, with the key after their columns."""
        return self.spark.read.schema(schema).parquet(f"{self.root}/{name}")

    def drop(self, name: str) -> None:
        """Free a table of this job that no later step reads."""
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def packed(rows: DataFrame, *more: Column) -> DataFrame:
    """The rows as one struct column `row`, so that no column name can clash."""
    return rows.select(F.struct("*").alias("row"), *more)


def unpacked(rows: DataFrame, like: DataFrame, **changed: Column) -> DataFrame:
    """The columns of `like` from `row`; `changed` replaces or adds columns."""
    kept = [
        changed.pop(name).alias(name) if name in changed else F.col("row").getField(name).alias(name)
        for name in like.columns
    ]
    return rows.select(*kept, *(column.alias(name) for name, column in changed.items()))


_held: list[Callable[[], object]] = []


def hold(free: Callable[[], object] | None = None) -> None:
    """A worker remembers for one operator at a time.

    Workers outlive stages, so what one operator keeps between tasks would
    stand beside the next one's. `free` lets go of what the caller keeps, and
    is called as soon as another one holds something, or None, nothing.
    """
    if _held and _held[0] != free:
        _held.pop()()
        pa.default_memory_pool().release_unused()
    if free and not _held:
        _held.append(free)


def words(text: Column) -> Column:
    """Number of runs of characters that are not ASCII white space; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def map_slices(
    rows: DataFrame,
    work: Callable[[dict], dict],
    schema: str | StructType,
    slice_rows: int = SLICE_ROWS,
    slice_bytes: int = SLICE_BYTES,
    as_arrow: bool = False,
) -> DataFrame:
    """`work` on column lists, or Arrow arrays, of some rows at a time, fewer if they are large."""
    importable(rows.sparkSession)
    fields = rows.sparkSession.createDataFrame([], schema).schema
    arrow = to_arrow_schema(fields)

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            share = slice_bytes / max(1, part.nbytes)
            step = max(1, min(slice_rows, int(part.num_rows * share)))
            for start in range(0, part.num_rows, step):
                piece = part.slice(start, step)
                columns = dict(zip(piece.schema.names, piece.columns))
                if not as_arrow:
                    columns = {name: column.to_pylist() for name, column in columns.items()}
                made = work(columns)
                yield pa.RecordBatch.from_pydict(made, schema=arrow)

    return rows.mapInArrow(batches, fields)
