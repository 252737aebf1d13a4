"""Employee profiles: points, streak, last daily date and latest display name.

Both the rebuild and the merge read the accepted answers once and reduce them,
map-side first, to one row per user, epoch and daily date. Everything after
that works on the reduced rows, so a user with a third of all answers is no
larger than the number of days that user took part.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from drillbook.operators.streaks import (
    USER,
    assign_epoch,
    chain_days,
    day_columns,
    with_epoch,
)
from drillbook.schemas import EMPLOYEE_PROFILES

PROFILE_COLUMNS = [
    USER,
    "display_name",
    "total_points",
    "daily_streak",
    "last_daily_date",
    "updated_at",
]

_STATE = StructType(
    [StructField(name, EMPLOYEE_PROFILES[name].dataType) for name in PROFILE_COLUMNS[1:]]
)


def day_totals() -> list[Column]:
    """Aggregates of answers: points, the latest name, and what a chain of days needs."""
    name = F.coalesce("global_name", "username")
    latest = F.max(F.struct("answered_at", "id", name.alias("name"))).alias("latest")
    return [F.sum("points_awarded").alias("points"), latest, *day_columns()]


def merged_totals() -> list[Column]:
    """The same totals from rows that hold totals of parts."""
    return [
        F.sum("points").alias("points"),
        F.max("latest").alias("latest"),
        F.sum("answer_count").alias("answer_count"),
        F.min("first_answer").alias("first_answer"),
        F.max("last_answer").alias("last_answer"),
    ]


def _reduce_days(answers: DataFrame) -> DataFrame:
    """One row per user, epoch and daily date (null for trivia and quiz answers)."""
    return with_epoch(answers).groupBy(USER, "epoch", "daily_date").agg(*day_totals())


def _fold(
    days: DataFrame, base: DataFrame | None, epoch: int, keep_all: bool, by_user: bool = False
) -> DataFrame:
    """Fold reduced rows onto the stored profiles; points and dates of `epoch` only.

    With `keep_all`, stored users who are not in the rows stay as they are. One
    shuffle of the reduced rows by user serves the join with the stored state,
    the chain of days and the sums; rows that lie `by_user` have had it.
    """
    if not by_user:
        days = days.repartition(USER)
    if base is None:
        days = days.withColumn("old", F.lit(None).cast(_STATE))
    else:
        old = base.select(USER, F.struct(*PROFILE_COLUMNS[1:]).cast(_STATE).alias("old"))
        days = days.join(old, USER, "full" if keep_all else "left")
    chained = chain_days(
        days.withColumns(
            {
                "epoch": F.coalesce("epoch", F.lit(0)),
                "base_date": F.col("old.last_daily_date"),
                "base_streak": F.col("old.daily_streak"),
            }
        )
    )
    current = F.col("epoch") == epoch
    dated = current & F.col("daily_date").isNotNull()
    last_day = F.max_by(
        F.struct("daily_date", "end_streak"), F.when(dated, F.col("last_answer"))
    )
    return chained.groupBy(USER).agg(
        F.first("old").alias("old"),
        F.max("latest").alias("latest"),
        F.sum(F.when(current, F.col("points"))).alias("points"),
        last_day.alias("state"),
    )


def _as_profiles(folded: DataFrame, seen: Column) -> DataFrame:
    points = F.coalesce("old.total_points", F.lit(0)) + F.coalesce("points", F.lit(0))
    streak = F.coalesce("state.end_streak", "old.daily_streak", F.lit(0))
    return folded.select(
        USER,
        F.coalesce("latest.name", "old.display_name").alias("display_name"),
        points.cast("int").alias("total_points"),
        streak.cast("int").alias("daily_streak"),
        F.coalesce("state.daily_date", "old.last_daily_date").alias("last_daily_date"),
        F.coalesce(seen, "old.updated_at").alias("updated_at"),
    )


def merge_profiles(profiles: DataFrame, answers: DataFrame) -> DataFrame:
    """Fold a batch of accepted answers into the stored profiles; the others stay."""
    folded = _fold(_reduce_days(answers.drop("epoch")), profiles, epoch=0, keep_all=True)
    return _as_profiles(folded, F.col("latest.answered_at"))


def touched_profiles(profiles: DataFrame, answers: DataFrame) -> DataFrame:
    """As `merge_profiles`, but only the users who answered in the batch."""
    folded = _fold(_reduce_days(answers.drop("epoch")), profiles, epoch=0, keep_all=False)
    return _as_profiles(folded, F.col("latest.answered_at"))


def rebuild_profiles(
    answers: DataFrame, resets: list | None = None, base: DataFrame | None = None
) -> DataFrame:
    """Profiles from the whole accepted log, as if it had been folded answer by answer.

    Only answers since the last reset count for points and streak. A user last
    seen before it stays, with zeros and no date. `base` is a snapshot the log
    goes on from; a reset wipes its scores too.
    """
    resets = sorted(resets or [])
    return fold_days(_reduce_days(assign_epoch(answers, resets)), resets, base)


def fold_days(
    days: DataFrame,
    resets: list,
    base: DataFrame | None = None,
    keep_all: bool = True,
    by_user: bool = False,
) -> DataFrame:
    """Profiles from one row of totals per user, epoch and daily date.

    `resets` is in order; with `keep_all`, users of `base` without days stay.
    With `by_user`, the rows of a user lie together already.
    """
    seen = F.col("latest.answered_at")
    if resets:
        last_reset = F.lit(resets[-1]).cast("timestamp")
        seen = F.when(seen.isNotNull(), F.greatest(seen, last_reset))
        base = reset_scores(base, resets[-1]) if base is not None else None
    return _as_profiles(_fold(days, base, len(resets), keep_all, by_user), seen)


def reset_scores(profiles: DataFrame, now) -> DataFrame:
    """Zero points and streak and clear the last date of every user; answers are kept."""
    named = F.col(USER) != ""
    cleared = {
        "total_points": F.lit(0),
        "daily_streak": F.lit(0),
        "last_daily_date": F.lit(None).cast("date"),
        "updated_at": F.lit(now).cast("timestamp"),
    }
    return profiles.withColumns(
        {name: F.when(named, value).otherwise(F.col(name)) for name, value in cleared.items()}
    )
