"""The submission stream: button presses dropped as files, parsed into answers."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from drillbook.schemas import PRESSES


def read_submissions(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """Stream of button presses from a folder of Parquet files."""
    reader = spark.readStream.schema(PRESSES)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path)


def parse_choice_id(presses: DataFrame) -> DataFrame:
    """Split `answer:<session>:<choice>` into session_id and selected_option.

    Presses of other buttons are not answers and are left out. An empty choice
    counts as 0; one that is not a whole number gives null, which the judge
    refuses later.
    """
    parts = F.split("custom_id", ":")
    choice = F.trim(F.get(parts, 2))
    number = F.when(choice == "", F.lit(0)).when(
        choice.rlike("^[+-]?[0-9]+$"), choice.try_cast("smallint")
    )
    return (
        presses.where(F.col("custom_id").startswith("answer:"))
        .withColumn("session_id", F.get(parts, 1))
        .withColumn("selected_option", number.cast("smallint"))
        .drop("custom_id")
    )
