from datetime import datetime, timedelta

from pyspark.sql import functions as F

from drillbook.operators import answers as an
from drillbook.operators.lookups import lookup_violations
from drillbook.operators.streaks import with_streaks
from drillbook.sources import parse_choice_id
from tests import tables
from tests.tables import START, ZONE, question, session, submission


def enriched(spark, sessions, submissions, questions=None):
    bank = questions or [question("q1", ("a", "b", "c", "d"), 2)]
    return an.enrich_submissions(
        tables.submissions(spark, *submissions),
        tables.sessions(spark, *sessions),
        tables.questions(spark, *bank),
    )


def verdicts(spark, sessions, submissions, stored=None, questions=None):
    judged = an.judge_submissions(enriched(spark, sessions, submissions, questions), ZONE, stored)
    return tables.column(judged, "id", "verdict")


def test_owner_rule_treats_null_and_empty_as_unowned(spark):
    got = verdicts(
        spark,
        [session("s1", owner="ann"), session("s2"), session("s3", owner="")],
        [
            submission("1", "s1", "ann"),
            submission("2", "s1", "bob"),
            submission("3", "s2", "bob"),
            submission("4", "s3", "bob"),
        ],
    )
    assert got == {"1": "ok", "2": "not_owner", "3": "ok", "4": "ok"}


def test_daily_expires_at_local_midnight_and_future_dates_are_refused(spark):
    # 2024-01-02 in Chicago is 06:00 UTC to 06:00 UTC.
    first, last = datetime(2024, 1, 2, 6), datetime(2024, 1, 3, 5, 59, 59, 999999)
    daily = [
        session("today", kind="daily", day=tables.day(1)),
        session("later", kind="daily", day=tables.day(2), guild="h"),
        session("undated", kind="daily", guild="i"),
    ]
    got = verdicts(
        spark,
        daily,
        [
            submission("1", "today", "a", at=first),
            submission("2", "today", "b", at=last),
            submission("3", "today", "c", at=first - timedelta(microseconds=1)),
            submission("4", "today", "d", at=last + timedelta(microseconds=1)),
            submission("5", "later", "a", at=first),
            submission("6", "undated", "a", at=first),
        ],
    )
    assert got == {"1": "ok", "2": "ok", "3": "expired", "4": "expired", "5": "expired", "6": "expired"}


def test_local_days_at_clock_changes(spark):
    spring, autumn = datetime(2024, 3, 10).date(), datetime(2024, 11, 3).date()
    daily = [
        session("spring", kind="daily", day=spring),
        session("autumn", kind="daily", day=autumn),
    ]
    got = verdicts(
        spark,
        daily,
        [
            # 10 March lasts 23 hours: 06:00 UTC to 05:00 UTC.
            submission("1", "spring", "a", at=datetime(2024, 3, 10, 6)),
            submission("2", "spring", "b", at=datetime(2024, 3, 11, 4, 59, 59)),
            submission("3", "spring", "c", at=datetime(2024, 3, 11, 5)),
            # 3 November lasts 25 hours: 05:00 UTC to 06:00 UTC.
            submission("4", "autumn", "a", at=datetime(2024, 11, 3, 5)),
            submission("5", "autumn", "b", at=datetime(2024, 11, 4, 5, 59, 59)),
            submission("6", "autumn", "c", at=datetime(2024, 11, 4, 6)),
        ],
    )
    assert got == {"1": "ok", "2": "ok", "3": "expired", "4": "ok", "5": "ok", "6": "expired"}


def test_refused_submissions_do_not_use_up_the_answer(spark):
    at = datetime(2024, 1, 2, 12)
    got = verdicts(
        spark,
        [session("d", kind="daily", day=tables.day(1)), session("t", owner="ann")],
        [
            submission("1", "d", "ann", at=at - timedelta(days=1)),
            submission("2", "d", "ann", choice=9, at=at),
            submission("3", "d", "ann", choice=None, at=at),
            submission("4", "d", "ann", choice=1, at=at + timedelta(minutes=1)),
            submission("5", "d", "ann", choice=2, at=at + timedelta(minutes=2)),
            submission("6", "t", "bob", at=at),
            submission("7", "t", "ann", at=at + timedelta(minutes=3)),
        ],
    )
    assert got == {
        "1": "expired",
        "2": "invalid_choice",
        "3": "invalid_choice",
        "4": "ok",
        "5": "duplicate",
        "6": "not_owner",
        "7": "ok",
    }


def test_first_answer_wins_and_ties_break_by_id(spark):
    rows = [
        submission("b", "s1", "ann", at=START),
        submission("a", "s1", "ann", at=START),
        submission("c", "s1", "ann", at=START - timedelta(seconds=1)),
        submission("d", "s1", "bob", at=START + timedelta(days=30)),
    ]
    assert verdicts(spark, [session("s1")], rows) == {
        "a": "duplicate",
        "b": "duplicate",
        "c": "ok",
        "d": "ok",
    }


def test_stored_answers_win_over_new_ones(spark):
    stored = spark.createDataFrame([("s1", "ann")], "session_id string, discord_user_id string")
    rows = [submission("1", "s1", "ann"), submission("2", "s1", "bob"), submission("3", "s2", "ann")]
    sessions = [session("s1"), session("s2")]
    assert verdicts(spark, sessions, rows, stored) == {"1": "duplicate", "2": "ok", "3": "ok"}
    accepted = an.accept_answers(enriched(spark, sessions, rows), ZONE, stored)
    assert {row.id for row in accepted.collect()} == {"2", "3"}


def test_scores_and_disabled_questions(spark):
    bank = [question("q1", ("a", "b"), 1, enabled=False)]
    rows = [submission("1", "s1", "ann", 1), submission("2", "s1", "bob", 0)]
    accepted = an.answer_rows(an.accept_answers(enriched(spark, [session("s1")], rows, bank), ZONE))
    got = {row.id: (row.is_correct, row.points_awarded) for row in accepted.collect()}
    assert got == {"1": (True, 10), "2": (False, 0)}


def test_submissions_without_a_session_are_reported(spark):
    rows = tables.submissions(spark, submission("1", "s1", "a"), submission("2", "gone", "a"))
    sessions = tables.sessions(spark, session("s1"), session("s2"), session("s2", guild="h"))
    got = lookup_violations(rows, sessions, "session_id")
    assert {tuple(row) for row in got.collect()} == {("gone", "missing", 1), ("s2", "duplicate", 2)}
    gone = [submission("1", "gone", "ann", 0), submission("2", "s1", "ann", 0)]
    assert verdicts(spark, [session("s1")], gone) == {"1": "unknown_session", "2": "ok"}


def test_reject_log(spark):
    rows = [submission("1", "s1", "bob"), submission("2", "s1", "ann"), submission("3", "s1", "ann")]
    judged = an.judge_submissions(enriched(spark, [session("s1", owner="ann")], rows), ZONE)
    assert tables.column(an.rejected_submissions(judged), "id", "reason") == {
        "1": "not_owner",
        "3": "duplicate",
    }


def test_result_texts(spark):
    bank = [
        question("q1", ("yes", "no"), 1, explanation=" "),
        question("q2", ("a", "b", "c", "d", "e"), 4, explanation="Because."),
    ]
    rows = [
        submission("1", "d1", "ann", 1, datetime(2024, 1, 2, 12)),
        submission("2", "d2", "ann", 4, datetime(2024, 1, 3, 12)),
        submission("3", "t", "ann", 1, datetime(2024, 1, 3, 13)),
    ]
    sessions = [
        session("d1", "q1", "daily", day=tables.day(1)),
        session("d2", "q2", "daily", day=tables.day(2)),
        session("t", "q2"),
    ]
    accepted = an.accept_answers(enriched(spark, sessions, rows, bank), ZONE)
    got = an.answer_results(with_streaks(accepted))
    assert tables.column(got, "id", "description") == {
        "1": "**B — no**\n\n+10 points\n\n🔥 **Daily streak:** 1 day",
        "2": "**E — e**\n\n**Why:** Because.\n\n+10 points\n\n🔥 **Daily streak:** 2 days",
        "3": "**E — e**\n\n**Why:** Because.",
    }
    assert tables.column(got, "id", "title") == {
        "1": "✅ Correct!",
        "2": "✅ Correct!",
        "3": "❌ Not quite",
    }


def test_button_ids(spark):
    texts = ["answer:s:3", "answer:s:", "answer:s", "answer:s:two", "answer:s:99999", "menu:quiz"]
    presses = spark.createDataFrame(
        [(str(i), text, "u", None, "u", START) for i, text in enumerate(texts)],
        "id string, custom_id string, discord_user_id string, global_name string, "
        "username string, answered_at timestamp",
    )
    parsed = parse_choice_id(presses)
    assert tables.column(parsed, "id", "selected_option") == {
        "0": 3,
        "1": 0,
        "2": None,
        "3": None,
        "4": None,
    }
    assert {row.session_id for row in parsed.collect()} == {"s"}


def test_local_date_does_not_depend_on_the_session_zone(spark, conf):
    rows = spark.range(1).select(F.timestamp_seconds(F.lit(1704175199)).alias("at"))  # 05:59:59Z
    from drillbook.functions import local_date

    for zone in ("UTC", "Asia/Tokyo", "America/Los_Angeles"):
        conf(spark__sql__session__timeZone=zone)
        assert str(rows.select(local_date(F.col("at"), ZONE)).first()[0]) == "2024-01-01"
