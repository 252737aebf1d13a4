"""Daily streaks: +1 for a correct answer the day after the last one, 0 for a wrong one, else 1.

An accepted daily answer carries the local date it was given on, so a user's
answers of one date follow each other without one of another date between. That
lets the fold run on one row per user and date instead of one row per answer:
answers are combined per date before the shuffle, and the window that follows
holds at most one row per calendar day of a user, however many answers that
user gave.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

USER = "discord_user_id"


def assign_epoch(rows: DataFrame, resets: list, at: str = "answered_at") -> DataFrame:
    """Add `epoch`, the number of score resets up to each row's time.

    Resets are a short list of administrator actions; each starts a new epoch.
    """
    instants = [F.lit(reset).cast("timestamp") for reset in resets]
    passed = [F.when(instant <= F.col(at), 1).otherwise(0) for instant in instants]
    epoch = F.lit(0)
    for one in passed:
        epoch = epoch + one
    return rows.withColumn("epoch", epoch)


def with_epoch(rows: DataFrame) -> DataFrame:
    """Rows with an epoch column; without resets everything is epoch 0."""
    return rows if "epoch" in rows.columns else rows.withColumn("epoch", F.lit(0))


def day_columns() -> list[Column]:
    """Aggregates that describe a user's answers of one date."""
    mark = F.struct("answered_at", "id", "is_correct")
    return [
        F.count("*").alias("answer_count"),
        F.min(mark).alias("first_answer"),
        F.max(mark).alias("last_answer"),
    ]


def chain_days(days: DataFrame) -> DataFrame:
    """Add `first_streak` and `end_streak` to rows of (user, epoch, daily_date).

    `base_date` and `base_streak` hold the stored state that epoch 0 goes on
    from, null where there is none. The streak at the end of a date is known
    without looking back when the date holds several answers (the later ones
    cannot be on the next day), when its answer is wrong, or when the day before
    is missing. Every other date adds one, so it is the last known value plus
    the days since. Rows without a date sort first and take no part.
    """
    by_date = Window.partitionBy(USER, "epoch").orderBy("daily_date")
    so_far = by_date.rowsBetween(Window.unboundedPreceding, Window.currentRow)

    day = F.col("daily_date")
    first_right = F.col("first_answer.is_correct")
    last_right = F.col("last_answer.is_correct")
    base_date = F.when(F.col("epoch") == 0, F.col("base_date"))
    base_streak = F.when(F.col("epoch") == 0, F.col("base_streak"))
    known = (
        F.when(F.col("answer_count") > 1, last_right.cast("int"))
        .when(~first_right, 0)
        .when(~F.col("_next_day"), 1)
    )
    last_known = F.last(
        F.when(
            day.isNotNull() & known.isNotNull(),
            F.struct(day.alias("date"), known.alias("streak")),
        ),
        ignorenulls=True,
    ).over(so_far)

    chained = (
        days.withColumn("_prior_date", F.coalesce(F.lag(day).over(by_date), base_date))
        .withColumn("_next_day", F.coalesce(F.datediff(day, "_prior_date") == 1, F.lit(False)))
        .withColumn("_known", last_known)
        .withColumn(
            "end_streak",
            F.coalesce(
                F.col("_known.streak") + F.datediff(day, F.col("_known.date")),
                base_streak + F.datediff(day, base_date),
            ),
        )
    )
    prior_end = F.coalesce(F.lag("end_streak").over(by_date), base_streak)
    return chained.withColumn(
        "first_streak",
        F.when(~first_right, 0).when(F.col("_next_day"), prior_end + 1).otherwise(1),
    ).drop("_prior_date", "_next_day", "_known")


def with_streaks(answers: DataFrame, base: DataFrame | None = None) -> DataFrame:
    """Accepted answers with the `daily_streak` each daily one left its user with, else null.

    Needs id, discord_user_id, daily_date, answered_at and is_correct, and uses
    epoch where present. `base` holds stored profiles to go on from. Only a
    date's first answer takes part in the chain; any other answer of that date
    counts 1 or 0. Answers meet the chain by user, epoch and date, a join that
    adaptive execution splits where a user has very many.
    """
    answers = with_epoch(answers)
    is_daily = F.col("daily_date").isNotNull()
    days = answers.where(is_daily).groupBy(USER, "epoch", "daily_date").agg(*day_columns())
    if base is None:
        days = days.withColumns(
            {"base_date": F.lit(None).cast("date"), "base_streak": F.lit(None).cast("int")}
        )
    else:
        state = base.select(
            USER,
            F.col("last_daily_date").alias("base_date"),
            F.col("daily_streak").alias("base_streak"),
        )
        days = days.join(state, USER, "left")
    date = [USER, "epoch", "daily_date"]
    firsts = chain_days(days).select(
        *date, F.col("first_answer.id").alias("_first_id"), F.col("first_streak").alias("_first_streak")
    )
    chained = F.when(F.col("id") == F.col("_first_id"), F.col("_first_streak"))
    streak = F.when(is_daily, F.coalesce(chained, F.col("is_correct").cast("int")))
    columns = answers.columns
    return (
        answers.join(firsts, date, "left")
        .withColumn("daily_streak", streak)
        .select(*columns, "daily_streak")
    )


def daily_streaks(answers: DataFrame, base: DataFrame | None = None) -> DataFrame:
    """The daily ones of the accepted answers, with their streaks."""
    return with_streaks(answers.where(F.col("daily_date").isNotNull()), base)


def reset_missed_streaks(profiles: DataFrame, as_of, now=None) -> DataFrame:
    """Zero the streak of users whose last daily answer is before the day before `as_of`.

    The last date stays, and a user without one is left alone. `as_of` is the
    local date of the run, `now` the clock written to changed rows.
    """
    yesterday = F.date_sub(F.lit(as_of).cast("date"), 1)
    missed = F.coalesce(
        (F.col("last_daily_date") < yesterday) & (F.col("daily_streak") > 0), F.lit(False)
    )
    changed = profiles.withColumn("_missed", missed).withColumn(
        "daily_streak", F.when(F.col("_missed"), 0).otherwise(F.col("daily_streak"))
    )
    if now is not None:
        clock = F.lit(now).cast("timestamp")
        changed = changed.withColumn(
            "updated_at", F.when(F.col("_missed"), clock).otherwise(F.col("updated_at"))
        )
    return changed.drop("_missed")
