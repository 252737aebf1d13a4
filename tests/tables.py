"""Small tables for the tests."""

from datetime import date, datetime, timedelta

from drillbook.schemas import QUESTION_SESSIONS, QUESTIONS, TRAINING_CARDS

ZONE = "America/Chicago"
START = datetime(2024, 1, 1, 12, 0)
SUBMISSION = (
    "id string, session_id string, discord_user_id string, global_name string, username string, "
    "selected_option smallint, answered_at timestamp"
)
ANSWER = (
    "id string, session_id string, discord_user_id string, global_name string, username string, "
    "daily_date date, is_correct boolean, points_awarded int, answered_at timestamp"
)


def question(id, options=("yes", "no"), correct=0, enabled=True, explanation="", topic="t", prompt=None):
    return (id, prompt or f"prompt {id}", list(options), correct, explanation, topic, enabled, START, START)


def questions(spark, *rows):
    return spark.createDataFrame(list(rows), QUESTIONS)


def session(
    id,
    question_id="q1",
    kind="trivia",
    guild="g",
    message=None,
    owner=None,
    day=None,
    run=None,
    created=START,
):
    return (id, question_id, kind, guild, "c", message, owner, day, None, created, run)


def sessions(spark, *rows):
    return spark.createDataFrame(list(rows), QUESTION_SESSIONS)


def submission(id, session_id, user, choice=0, at=START, name=None):
    return (id, session_id, user, name, f"user-{user}", choice, at)


def submissions(spark, *rows):
    return spark.createDataFrame(list(rows), SUBMISSION)


def answers(spark, rows):
    return spark.createDataFrame(list(rows), ANSWER)


def card(id, topic="t", title=None, signs=(), steps=(), sections=(), enabled=True):
    return (id, topic, title or f"title {id}", list(signs), list(steps), None, list(sections), enabled, START)


def cards(spark, *rows):
    return spark.createDataFrame(list(rows), TRAINING_CARDS)


def day(number: int) -> date:
    return date(2024, 1, 1) + timedelta(days=number)


def column(rows, key, value):
    """Rows of a DataFrame as a dictionary."""
    return {row[key]: row[value] for row in rows.select(key, value).collect()}
