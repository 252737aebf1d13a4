from collections import Counter

import pytest
from pyspark.sql import functions as F

from drillbook.operators import assign
from drillbook.schemas import QUESTION_SESSIONS, QUIZ_RUNS
from tests import tables
from tests.tables import START, question, session


def bank(spark, size, disabled=0):
    rows = [question(f"q{n}") for n in range(size)]
    rows += [question(f"off{n}", enabled=False) for n in range(disabled)]
    return tables.questions(spark, *rows)


def requests(spark, size):
    return spark.range(size).select(
        F.col("id").cast("string").alias("request_id"),
        F.concat(F.lit("u"), "id").alias("discord_user_id"),
        F.lit("g").alias("guild_id"),
        F.lit("c").alias("channel_id"),
        F.lit(START).alias("requested_at"),
    )


def test_bank_numbers_are_dense(spark):
    numbers = assign.index_bank(bank(spark, 500)).select("idx").collect()
    assert sorted(row.idx for row in numbers) == list(range(500))


def test_trivia_picks_are_uniform_repeatable_and_active(spark):
    made = assign.assign_trivia(requests(spark, 6000), bank(spark, 6, disabled=3), "s")
    counts = Counter(row.question_id for row in made.collect())
    assert set(counts) == {f"q{n}" for n in range(6)}
    assert all(850 < count < 1150 for count in counts.values())
    again = assign.assign_trivia(requests(spark, 6000), bank(spark, 6, disabled=3), "s")
    assert made.exceptAll(again).isEmpty()
    other = assign.assign_trivia(requests(spark, 6000), bank(spark, 6, disabled=3), "t")
    assert not made.exceptAll(other).isEmpty()
    assert made.columns == QUESTION_SESSIONS.names
    first = made.where("owner_discord_user_id = 'u0'").first()
    assert (first.kind, first.daily_date, first.message_id) == ("trivia", None, None)


def test_no_trivia_without_active_questions(spark):
    assert assign.assign_trivia(requests(spark, 3), bank(spark, 0, disabled=2), "s").collect() == []


def test_quizzes_hold_distinct_questions_in_uniform_order(spark):
    runs = assign.assign_quizzes(requests(spark, 7000), bank(spark, 7, disabled=2), "s")
    assert runs.columns == QUIZ_RUNS.names
    rows = runs.collect()
    assert len(rows) == 7000
    assert all(len(set(row.question_ids)) == 5 for row in rows)
    for place in range(5):
        counts = Counter(row.question_ids[place] for row in rows)
        assert all(850 < count < 1150 for count in counts.values()) and len(counts) == 7
    assert (rows[0].current_index, rows[0].correct_count, rows[0].completed_at) == (0, 0, None)


def test_a_quiz_of_the_whole_bank_and_one_too_large(spark):
    rows = assign.assign_quizzes(requests(spark, 4), bank(spark, 5), "s").collect()
    assert all(sorted(row.question_ids) == [f"q{n}" for n in range(5)] for row in rows)
    assert assign.assign_quizzes(requests(spark, 4), bank(spark, 4, disabled=3), "s").collect() == []


def test_quiz_sessions_open_on_the_current_question(spark):
    runs = assign.assign_quizzes(requests(spark, 2), bank(spark, 8), "s")
    channels = runs.select(F.col("id").alias("quiz_run_id"), F.lit("c").alias("channel_id"))
    rows = runs.collect()
    opened = {row.quiz_run_id: row for row in assign.quiz_sessions(runs, channels).collect()}
    assert {run.id: run.question_ids[0] for run in rows} == {
        key: row.question_id for key, row in opened.items()
    }
    assert all(row.kind == "quiz" for row in opened.values())
    done = runs.withColumn("current_index", F.lit(5))
    assert assign.quiz_sessions(done, channels).collect() == []


def test_daily_assignment_keeps_saved_sessions_and_is_idempotent(spark):
    calendar = spark.createDataFrame(
        [("g", tables.day(n)) for n in (0, 1, 2, 2)] + [("h", tables.day(0))],
        "guild_id string, daily_date date",
    )
    saved = tables.sessions(
        spark,
        session("a", "off0", "daily", day=tables.day(0), message="m"),
        session("b", "off0", "daily", day=tables.day(1)),
        session("t", "q0"),
    )
    questions = bank(spark, 9, disabled=1)
    assigned = assign.assign_daily(calendar, saved, questions, "s")
    got = {(r.guild_id, r.daily_date): (r.status, r.session_id) for r in assigned.collect()}
    assert got[("g", tables.day(0))] == ("posted", "a")
    assert got[("g", tables.day(1))] == ("pending", "b")
    assert got[("g", tables.day(2))][0] == got[("h", tables.day(0))][0] == "new"
    assert len(got) == 4 == assigned.count()
    assert assigned.where("status = 'pending'").first().question_id == "off0"
    new = assign.daily_session_rows(assigned, "c", "2024-01-01 12:00:00Z")
    again = assign.assign_daily(calendar, saved.unionByName(new), questions, "s")
    assert {(r.session_id, r.question_id, r.status) for r in again.collect()} == {
        (r.session_id, r.question_id, r.status if r.status == "posted" else "pending")
        for r in assigned.collect()
    }


def test_daily_needs_an_active_question_only_for_new_days(spark):
    calendar = spark.createDataFrame([("g", tables.day(0))], "guild_id string, daily_date date")
    saved = tables.sessions(spark, session("a", "off0", "daily", day=tables.day(0)))
    empty = bank(spark, 0, disabled=1)
    assert assign.assign_daily(calendar, saved, empty, "s").first().status == "pending"
    with pytest.raises(Exception, match="no active question"):
        assign.assign_daily(calendar, saved.limit(0), empty, "s").collect()


def test_expired_dailies(spark):
    table = tables.sessions(
        spark,
        session("gone", kind="daily", day=tables.day(1), message="m"),
        session("unposted", kind="daily", guild="h", day=tables.day(1)),
        session("older", kind="daily", day=tables.day(0), message="m"),
        session("trivia", message="m"),
    )
    got = assign.expired_daily_sessions(table, "2024-01-03").collect()
    assert [row.id for row in got] == ["gone"]
