"""Row rules, uniqueness rules and referential rules over whole tables."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from drillbook.functions import names_failed
from drillbook.schemas import PRIMARY_KEYS, TABLES, UNIQUE_KEYS

# Allowed choice counts, session kinds and the selectable range.
CHOICE_COUNTS = [2, 4, 5]
SESSION_KINDS = ["trivia", "quiz", "daily"]
FIRST_CHOICE, LAST_CHOICE = 0, 4


def _checks() -> dict[str, dict[str, Column]]:
    choices = F.size("options")
    return {
        "questions": {
            "choice_count": choices.isin(CHOICE_COUNTS),
            "correct_option_range": F.col("correct_option").between(0, choices - 1),
        },
        "question_sessions": {"kind": F.col("kind").isin(SESSION_KINDS)},
        "question_answers": {
            "selected_option_range": F.col("selected_option").between(FIRST_CHOICE, LAST_CHOICE),
            "points_not_negative": F.col("points_awarded") >= 0,
        },
        "employee_profiles": {
            "points_not_negative": F.col("total_points") >= 0,
            "streak_not_negative": F.col("daily_streak") >= 0,
        },
    }


def required_rules(schema: StructType) -> dict[str, Column]:
    """One rule per required column of a schema."""
    return {
        f"{field.name}_required": F.col(field.name).isNotNull()
        for field in schema.fields
        if not field.nullable
    }


def table_rules(name: str) -> dict[str, Column]:
    """The rule set of a stored table: required columns, then value checks."""
    return {**required_rules(TABLES[name]), **_checks().get(name, {})}


def validate_rows(table: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Add `violations`, the names of the rules each row breaks, in one pass.

    Clean rows are those with an empty list. Replacing a rule is replacing an
    entry of the dictionary.
    """
    return table.withColumn("violations", names_failed(rules))


def clean_rows(validated: DataFrame) -> DataFrame:
    return validated.where(F.size("violations") == 0).drop("violations")


def rejected_rows(validated: DataFrame) -> DataFrame:
    return validated.where(F.size("violations") > 0)


def unique_violations(table: DataFrame, keys: list[str]) -> DataFrame:
    """Key values held by more than one row. As in SQL, a null makes a key distinct.

    The count is combined before the shuffle, so one key with most of the rows
    costs one partial row per task.
    """
    return (
        table.dropna(subset=keys)
        .groupBy(*keys)
        .agg(F.count("*").alias("row_count"))
        .where("row_count > 1")
    )


def key_violations(name: str, table: DataFrame) -> DataFrame:
    """Repeated primary and unique keys of a stored table: key_name, key_value and row_count."""
    keys = [PRIMARY_KEYS[name], *([UNIQUE_KEYS[name]] if name in UNIQUE_KEYS else [])]
    found = None
    for columns in keys:
        broken = unique_violations(table, columns).select(
            F.lit(f"{name}({', '.join(columns)})").alias("key_name"),
            F.concat_ws("/", *[F.col(column).cast("string") for column in columns]).alias("key_value"),
            "row_count",
        )
        found = broken if found is None else found.unionByName(broken)
    return found
