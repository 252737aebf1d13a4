"""From submissions to accepted, scored answers.

Shuffles: the submissions move once by session to meet their sessions, and the
survivors once by (session, user) to find first answers. A daily session may be
shared by every employee, so the second step groups by a struct: it cannot
reuse the partitioning by session, which leaves Spark free to split a hot
session in the join. First answers are limited per task before their shuffle,
so a user who presses one button without end costs one row per task.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from drillbook.functions import day_word, letter, local_date
from drillbook.operators.lookups import lookup_join
from drillbook.operators.rules import FIRST_CHOICE, LAST_CHOICE
from drillbook.sources.versions import write_once

# Fixed value: points for a correct answer.
POINTS = 10
#: Columns of a row's number and of its hash while duplicates are marked.
PLACE, ROW = "_place", "_row"
#: What one submission may differ in from another of the same user to the same session.
PRESS = ["id", "answered_at", "selected_option", "global_name", "username"]
#: What the answers of one user to one session meet by; its hash stands first, as hashes sort faster.
ANSWERER = ["_answerer_hash", "_answerer"]


def enrich_submissions(
    submissions: DataFrame, sessions: DataFrame, questions: DataFrame
) -> DataFrame:
    """Add the session and its question to each submission; unknown ones leave nulls.

    The question comes from the whole bank: a disabled one can still be answered
    while its session is open. Sessions meet questions first, so the larger
    submissions are shuffled once, not twice.
    """
    keys = questions.select("id", "options", "correct_option", "explanation")
    posed = lookup_join(
        sessions.select(
            "id",
            "question_id",
            "kind",
            "guild_id",
            "owner_discord_user_id",
            "daily_date",
            "quiz_run_id",
            F.col("created_at").alias("session_created_at"),
        ),
        keys,
        "question_id",
        optional=True,
    )
    return lookup_join(submissions, posed, "session_id", optional=True)


def _refusal(zone: str) -> Column:
    owner = F.coalesce("owner_discord_user_id", F.lit(""))
    not_owner = (owner != "") & (owner != F.col("discord_user_id"))
    today = local_date(F.col("answered_at"), zone)
    expired = (F.col("kind") == "daily") & ~F.col("daily_date").eqNullSafe(today)
    choice = F.col("selected_option")
    bad_choice = choice.isNull() | ~choice.between(FIRST_CHOICE, LAST_CHOICE)
    return (
        F.when(F.col("kind").isNull(), "unknown_session")
        .when(F.col("correct_option").isNull(), "unknown_question")
        .when(not_owner, "not_owner")
        .when(expired, "expired")
        .when(bad_choice, "invalid_choice")
    )


def screen_submissions(enriched: DataFrame, zone: str) -> DataFrame:
    """Add `verdict`: the first rule a submission breaks on its own, else ok.

    The rules are a known session with a known question, ownership, expiry of a daily question outside
    its local day (event time decides, however late the row arrives) and the
    range of the choice. None of these refusals uses up the answerer's one answer.
    """
    return enriched.withColumn("verdict", F.coalesce(_refusal(zone), F.lit("ok")))


def _row_hash(screened: DataFrame) -> Column:
    """Orders submissions of one user, session, time and id; equal for equal ones only, but for chance."""
    return F.xxhash64(*[name for name in PRESS if name in screened.columns])


def as_placed(screened: DataFrame) -> DataFrame:
    """Rows with their hash and a number, which tells equal rows apart.

    The numbers hold once the rows are written: another run may deal the rows
    otherwise.
    """
    return screened.withColumns(
        {ROW: _row_hash(screened), PLACE: F.monotonically_increasing_id()}
    )


def with_places(screened: DataFrame) -> DataFrame:
    """The rows as written, each with its number."""
    return write_once(as_placed(screened), "screened")


def _by_answerer(answers: DataFrame) -> DataFrame:
    pair = ["session_id", "discord_user_id"]
    return answers.withColumns(dict(zip(ANSWERER, (F.xxhash64(*pair), F.struct(*pair)))))


def first_answers(screened: DataFrame) -> DataFrame:
    """The first passing submission of each user to each session; equal times go by id, row, number."""
    return _first_answers(screened).drop(*ANSWERER)


def _first_answers(screened: DataFrame) -> DataFrame:
    placed = PLACE in screened.columns
    last = [ROW, PLACE] if placed else [_row_hash(screened)]
    order = Window.partitionBy(*ANSWERER).orderBy("answered_at", "id", *last)
    return (
        _by_answerer(screened.where("verdict = 'ok'"))
        .withColumn("_rank", F.row_number().over(order))
        .where("_rank = 1")
        .drop("_rank")
    )


def new_answers(screened: DataFrame, stored_answers: DataFrame | None = None) -> DataFrame:
    """First passing submissions, without those of users whose answer is stored already.

    The first answers are in place and in order for the join with the stored
    ones. It is a merge join, as the size of compressed files says too little
    about the memory that their answers would take.
    """
    firsts = _first_answers(screened)
    if stored_answers is not None:
        # As nulls in structs are equal, and an unknown user is no one's equal.
        known = stored_answers.dropna(subset=["session_id", "discord_user_id"])
        taken = _by_answerer(known).select(*ANSWERER)
        firsts = firsts.join(taken.hint("merge"), ANSWERER, "left_anti")
    return firsts.drop(*ANSWERER)


def mark_duplicates(placed: DataFrame, stored_answers: DataFrame | None = None) -> DataFrame:
    """Turn the verdict of every answer but the first into `duplicate`; all rows are kept.

    A press that was delivered several times is several equal rows, of which one
    counts. Each task sends the first one it has, the first of these is
    accepted, and the rows learn by their numbers whether they are accepted. A
    number is a key of one row, so neither endless copies of a press nor endless
    presses of one user meet in a task. Accepted rows may be most of all rows,
    so they are never broadcast.
    """
    accepted = new_answers(placed, stored_answers).select(PLACE, F.lit(True).alias("_first"))
    repeated = (F.col("verdict") == "ok") & F.col("_first").isNull()
    return (
        placed.join(accepted.hint("merge"), PLACE, "left")
        .withColumn("verdict", F.when(repeated, "duplicate").otherwise(F.col("verdict")))
        .drop(PLACE, ROW, "_first")
    )


def judge_submissions(
    enriched: DataFrame, zone: str, stored_answers: DataFrame | None = None
) -> DataFrame:
    """The verdict of every submission; no row is left out.

    It is ok, unknown_session, unknown_question, not_owner, expired,
    invalid_choice or duplicate. Of a user's submissions to a session one at
    most is ok, also where a press was delivered twice.
    """
    return mark_duplicates(with_places(screen_submissions(enriched, zone)), stored_answers)


def rejected_submissions(judged: DataFrame) -> DataFrame:
    """The reject log: every refused submission with its reason."""
    return judged.where("verdict != 'ok'").withColumnRenamed("verdict", "reason")


def score_answers(answers: DataFrame) -> DataFrame:
    """Freeze correctness and points as of the answer; refused submissions have neither."""
    correct = F.col("selected_option") == F.col("correct_option")
    if "verdict" in answers.columns:
        ok = F.col("verdict") == "ok"
        return answers.withColumn("is_correct", F.when(ok, correct)).withColumn(
            "points_awarded", F.when(ok, F.when(correct, POINTS).otherwise(0))
        )
    return answers.withColumn("is_correct", correct).withColumn(
        "points_awarded", F.when(correct, POINTS).otherwise(0)
    )


def accept_answers(
    enriched: DataFrame, zone: str, stored_answers: DataFrame | None = None
) -> DataFrame:
    """Scored first answers, leaving out users who already answered in `stored_answers`."""
    return score_answers(
        new_answers(screen_submissions(enriched, zone), stored_answers).drop("verdict")
    )


def answer_rows(accepted: DataFrame) -> DataFrame:
    """The columns of the stored answer table."""
    return accepted.select(
        "id",
        "session_id",
        "discord_user_id",
        "selected_option",
        "is_correct",
        "points_awarded",
        "answered_at",
    )


def answer_results(accepted: DataFrame) -> DataFrame:
    """The reply to each accepted answer.

    Takes scored answers with their question and `daily_streak` (null where the
    answer was not a daily one).
    """
    # The pieces of the reply text.
    key = F.concat(
        F.lit("**"),
        letter(F.col("correct_option")),
        F.lit(" — "),
        F.get("options", F.col("correct_option").cast("int")),
        F.lit("**"),
    )
    why = F.when(
        F.col("explanation").rlike(r"[^\s\p{Z}\x{FEFF}]"), F.concat(F.lit("**Why:** "), F.col("explanation"))
    )
    points = F.when(F.col("is_correct"), F.lit(f"+{POINTS} points"))
    streak = F.col("daily_streak")
    streak_line = F.when(
        streak.isNotNull(),
        F.concat(
            F.lit("🔥 **Daily streak:** "), streak.cast("string"), F.lit(" "), day_word(streak)
        ),
    )
    return accepted.select(
        "id",
        "session_id",
        "discord_user_id",
        F.when(F.col("is_correct"), "✅ Correct!").otherwise("❌ Not quite").alias("title"),
        F.concat_ws("\n\n", key, why, points, streak_line).alias("description"),
    )
