"""Progress of quiz runs and the question each open run shows next."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from drillbook.operators.answers import POINTS


def quiz_steps(answers: DataFrame) -> DataFrame:
    """Per run the accepted quiz answers, the right ones and the time of the last, map-side first."""
    return (
        answers.where((F.col("kind") == "quiz") & F.col("quiz_run_id").isNotNull())
        .groupBy(F.col("quiz_run_id").alias("id"))
        .agg(
            F.count("*").alias("steps"),
            F.count(F.when(F.col("is_correct"), 1)).alias("right"),
            F.max("answered_at").alias("last_at"),
        )
    )


def apply_steps(runs: DataFrame, steps: DataFrame) -> DataFrame:
    """Move runs on by their steps, which may come in several rows per run.

    Each answer moves the run on by one and counts if right; the run completes
    with the answer that reaches the end of its list. Runs without answers stay
    as they are.
    """
    folded = steps.groupBy("id").agg(
        F.sum("steps").alias("_steps"), F.sum("right").alias("_right"), F.max("last_at").alias("_last_at")
    )
    index = (F.col("current_index") + F.coalesce("_steps", F.lit(0))).cast("int")
    right = (F.col("correct_count") + F.coalesce("_right", F.lit(0))).cast("int")
    finished = F.col("_last_at").isNotNull() & (index >= F.size("question_ids"))
    return (
        runs.join(folded, "id", "left")
        .withColumns(
            {
                "completed_at": F.when(finished, F.col("_last_at")).otherwise(
                    F.col("completed_at")
                ),
                "current_index": index,
                "correct_count": right,
            }
        )
        .drop("_steps", "_right", "_last_at")
    )


def quiz_progress(runs: DataFrame, answers: DataFrame) -> DataFrame:
    """Fold accepted quiz answers, which carry quiz_run_id, into their runs."""
    return apply_steps(runs, quiz_steps(answers))


def quiz_results(runs: DataFrame) -> DataFrame:
    """The closing message of each completed run, out of as many questions as it has."""
    right = F.col("correct_count").cast("string")
    # The pieces of the closing message.
    text = F.concat(
        F.lit("You answered **"),
        right,
        F.lit("/"),
        F.size("question_ids").cast("string"),
        F.lit("** correctly and earned **"),
        (F.col("correct_count") * POINTS).cast("string"),
        F.lit(" points**."),
    )
    return runs.where(F.col("completed_at").isNotNull()).select(
        "id", "discord_user_id", "correct_count", text.alias("result")
    )


def next_quiz_questions(runs: DataFrame, questions: DataFrame) -> DataFrame:
    """The question at the current index of each run; finished runs have none."""
    shown = questions.select(
        F.col("id").alias("question_id"),
        "prompt",
        "options",
    )
    return (
        runs.withColumn("question_id", F.get("question_ids", F.col("current_index")))
        .where(F.col("question_id").isNotNull())
        .join(shown, "question_id")
        .select(
            F.col("id").alias("quiz_run_id"),
            "discord_user_id",
            "guild_id",
            "current_index",
            "question_id",
            "prompt",
            "options",
        )
    )
