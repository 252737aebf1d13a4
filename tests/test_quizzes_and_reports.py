from datetime import timedelta

from drillbook.operators import quizzes, reports
from drillbook.operators.profiles import reset_scores
from drillbook.operators.streaks import reset_missed_streaks
from drillbook.schemas import EMPLOYEE_PROFILES, QUIZ_RUNS
from tests import tables
from tests.tables import START, card, question


def runs(spark, *rows):
    return spark.createDataFrame(list(rows), QUIZ_RUNS)


def run(id, questions=5, index=0, right=0):
    return (id, "ann", "g", [f"q{n}" for n in range(questions)], index, right, None, START)


def steps(spark, *rows):
    return spark.createDataFrame(
        list(rows), "quiz_run_id string, kind string, is_correct boolean, answered_at timestamp"
    )


def test_quiz_runs_move_on_and_complete(spark):
    log = [("full", "quiz", n % 2 == 0, START + timedelta(minutes=n)) for n in range(5)]
    log += [("half", "quiz", True, START), ("half", "quiz", False, START)]
    log += [("half", "trivia", True, START), (None, "quiz", True, START)]
    log += [("resumed", "quiz", True, START + timedelta(hours=1))]
    got = quizzes.quiz_progress(
        runs(spark, run("full"), run("half"), run("idle"), run("resumed", index=4, right=3)),
        steps(spark, *log),
    )
    state = {r.id: (r.current_index, r.correct_count, r.completed_at) for r in got.collect()}
    assert state == {
        "full": (5, 3, START + timedelta(minutes=4)),
        "half": (2, 1, None),
        "idle": (0, 0, None),
        "resumed": (5, 4, START + timedelta(hours=1)),
    }
    assert got.columns == QUIZ_RUNS.names
    assert tables.column(quizzes.quiz_results(got), "id", "result") == {
        "full": "You answered **3/5** correctly and earned **30 points**.",
        "resumed": "You answered **4/5** correctly and earned **40 points**.",
    }
    bank = tables.questions(spark, *[question(f"q{n}") for n in range(5)])
    following = quizzes.next_quiz_questions(got, bank)
    assert tables.column(following, "quiz_run_id", "question_id") == {"half": "q2", "idle": "q0"}


def profiles(spark, *rows):
    return spark.createDataFrame(
        [(u, n, p, s, d, START) for u, n, p, s, d in rows], EMPLOYEE_PROFILES
    )


def test_leaderboard_ranks_ties_by_user_and_stops_at_ten(spark):
    rows = [(f"u{n:02d}", f"name{n}", n // 2 * 10, n, None) for n in range(14)]
    board = reports.leaderboard(profiles(spark, *rows)).orderBy("position").collect()
    assert [row.discord_user_id for row in board] == [
        "u12", "u13", "u10", "u11", "u08", "u09", "u06", "u07", "u04", "u05",
    ]
    assert [row.position for row in board] == list(range(1, 11))
    assert board[0].line == "**1.** name12 — 60 points (12-day streak)"


def test_messages_of_empty_reports(spark):
    none = profiles(spark)
    assert reports.leaderboard_message(none).first().text == "No points have been earned yet."
    assert reports.employee_stats(none).collect() == []
    assert reports.training_activity(none).first()[0] == 0


def test_employee_stats(spark):
    table = profiles(spark, *[(f"u{n:02d}", f"n{n}", n, 1, None) for n in range(30)])
    top = reports.employee_stats(table).collect()
    assert len(top) == 25 and top[0].line == "**n29** — 29 points, 1-day streak"
    assert [row.discord_user_id for row in reports.employee_stats(table, "u03").collect()] == ["u03"]
    assert reports.employee_stats(table, "nobody").collect() == []


def test_activity_by_guild_counts_each_answer_once(spark):
    sessions = tables.sessions(
        spark, tables.session("s1", guild="g"), tables.session("s2", guild="h"), tables.session("s3")
    )
    answers = spark.createDataFrame([("s1",)] * 5 + [("s2",)] + [("s3",)], "session_id string")
    got = reports.training_activity_by_guild(answers, sessions)
    assert tables.column(got, "guild_id", "answer_count") == {"g": 6, "h": 1}


def test_question_text(spark):
    bank = tables.questions(spark, question("q1", ("yes", "no"), prompt="Is it?"))
    text = reports.format_questions(bank).first().description
    assert text == "Is it?\n\n**A.** yes\n**B.** no\n\nSelect an option below."


def test_card_search_matches_any_case_and_keeps_wildcards(spark):
    table = tables.cards(
        spark, card("1", "First AID"), card("2", "aid", enabled=False), card("3", "vitals")
    )

    def found(topic):
        return {row.id for row in reports.search_cards(table, topic).collect()}

    assert found("aid") == {"1"}
    assert found(None) == found("") == {"1", "3"}
    assert found("v_t%s") == {"3"}


def test_card_sections(spark):
    table = tables.cards(
        spark,
        card("kept", sections=[("h", "c"), ("", "c"), ("h", None)]),
        card("lists", signs=["a", "b"], steps=["c"], sections=[("h", "")]),
        card("steps", steps=["c"]),
        card("none"),
    )
    shown = reports.normalize_card_sections(table)
    got = {row.id: [tuple(part) for part in row.sections] for row in shown.collect()}
    assert got == {
        "kept": [("h", "c")],
        "lists": [("Warning signs", "• a\n• b"), ("First steps", "• c")],
        "steps": [("First steps", "• c")],
        "none": [],
    }


def test_missed_streaks_keep_the_date_and_skip_null_dates(spark):
    table = profiles(
        spark,
        ("old", "n", 5, 3, tables.day(0)),
        ("yesterday", "n", 5, 3, tables.day(1)),
        ("today", "n", 5, 3, tables.day(2)),
        ("never", "n", 5, 3, None),
        ("zero", "n", 5, 0, tables.day(0)),
    )
    now = "2024-01-03 06:00:00Z"
    rows = {r.discord_user_id: r for r in reset_missed_streaks(table, "2024-01-03", now).collect()}
    assert {u: r.daily_streak for u, r in rows.items()} == {
        "old": 0,
        "yesterday": 3,
        "today": 3,
        "never": 3,
        "zero": 0,
    }
    assert rows["old"].last_daily_date == tables.day(0)
    assert [u for u, r in rows.items() if r.updated_at != START] == ["old"]


def test_score_reset_spares_rows_without_a_user(spark):
    table = profiles(spark, ("ann", "n", 5, 3, tables.day(0)), ("", "n", 5, 3, tables.day(0)))
    rows = {r.discord_user_id: r for r in reset_scores(table, "2024-01-03 06:00:00Z").collect()}
    assert (rows["ann"].total_points, rows["ann"].daily_streak, rows["ann"].last_daily_date) == (0, 0, None)
    assert rows[""].total_points == 5
    assert rows["ann"].display_name == "n"
