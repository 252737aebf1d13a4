"""Typed scans of the stored tables and of bulk content drops."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from drillbook.schemas import TABLES


def read_table(spark: SparkSession, name: str, path: str) -> DataFrame:
    """Scan one of the six tables with its declared schema (nothing is inferred)."""
    return spark.read.schema(TABLES[name]).parquet(path)


def active_questions(questions: DataFrame) -> DataFrame:
    """The enabled part of the question bank; the filter reaches the Parquet scan."""
    return questions.where("enabled")


def read_content_drop(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Scan a JSON-lines content drop; a row that does not parse fails the job."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def ingest_content(
    spark: SparkSession, path: str | list[str], schema: StructType
) -> tuple[DataFrame, DataFrame]:
    """Content lines that parse into the schema, and the others as (line, reason).

    One bad line does not end the load. A line is refused as `not_json`, as
    `field_type` where a field has another type, or as `options_not_a_list`.
    Both results read the lines once more when they are used.
    """
    lines = spark.read.text(path).withColumnRenamed("value", "line").where("trim(line) <> ''")
    bad = "_bad"
    wide = StructType([*schema.fields, StructField(bad, StringType())])
    parsed = lines.withColumn(
        "_row", F.from_json("line", wide, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": bad})
    )
    whole = F.get_json_object("line", "$").isNotNull()
    reason = F.when(~whole, "not_json")
    if "options" in schema.names:
        options = F.get_json_object("line", "$.options")
        listed = F.json_array_length(options).isNotNull()
        reason = reason.when(options.isNotNull() & ~listed, "options_not_a_list")
    reason = reason.when(F.col("_row").isNull() | F.col(f"_row.{bad}").isNotNull(), "field_type")
    judged = parsed.withColumn("reason", reason)
    good = judged.where("reason IS NULL").select("_row.*").drop(bad)
    return good, judged.where("reason IS NOT NULL").select("line", "reason")


def evolve_schema(table: DataFrame, schema: StructType, defaults: dict | None = None) -> DataFrame:
    """Bring a table to a newer schema.

    A column the table lacks is added with its default. Rows from files written
    before the column existed read as null, so a required column takes the
    default there too; an optional column keeps its nulls.
    """
    defaults = defaults or {}
    columns = []
    for field in schema.fields:
        default = defaults.get(field.name, F.lit(None))
        if field.name not in table.columns:
            value = default
        elif field.nullable or field.name not in defaults:
            value = F.col(field.name)
        else:
            value = F.coalesce(F.col(field.name), default)
        columns.append(value.cast(field.dataType).alias(field.name))
    return table.select(*columns)
