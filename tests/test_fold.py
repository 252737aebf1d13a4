"""Streaks and profiles against the fold of single answers, on random logs."""

import random
from datetime import datetime, timedelta

import pytest

from drillbook.operators.profiles import merge_profiles, rebuild_profiles, touched_profiles
from drillbook.operators.streaks import assign_epoch, daily_streaks, reset_missed_streaks
from tests import tables
from tests.fold import fold

DAYS = 25
ZERO = datetime(2024, 1, 1)


def random_log(seed, users=40, resets=()):
    """Answers of users who skip days, repeat days in other guilds and answer trivia between."""
    rng = random.Random(seed)
    log = []
    for user in range(users):
        eager = rng.choice([0.3, 0.7, 0.95])
        for number in range(DAYS):
            while rng.random() < (eager if not log or log[-1]["user"] != f"u{user}" else eager / 2):
                second = rng.randrange(86400)
                daily = rng.random() < 0.8
                log.append(
                    {
                        "user": f"u{user}",
                        "at": ZERO + timedelta(days=number, seconds=second // 600 * 600),
                        "date": tables.day(number) if daily else None,
                        "right": rng.random() < 0.75,
                        "name": rng.choice(["a", "b", "c"]),
                    }
                )
    rng.shuffle(log)
    for number, event in enumerate(log):
        event["id"] = f"{number:06d}"
    log += [{"kind": "reset", "at": at, "id": ""} for at in resets]
    # A reset comes before an answer of the same instant, as an epoch starts with it.
    return sorted(log, key=lambda event: (event["at"], event["id"]))


def frame(spark, log):
    rows = [
        (
            e["id"],
            "s" + e["id"],
            e["user"],
            e["name"] if e["name"] != "c" else None,
            "c",
            e["date"],
            e["right"],
            10 if e["right"] else 0,
            e["at"],
        )
        for e in log
        if "user" in e
    ]
    return tables.answers(spark, rows)


def collected(profiles):
    return {
        row.discord_user_id: {
            "points": row.total_points,
            "streak": row.daily_streak,
            "last": row.last_daily_date,
            "name": row.display_name,
            "updated": row.updated_at,
        }
        for row in profiles.collect()
    }


@pytest.mark.parametrize("seed", range(3))
def test_streaks_equal_the_fold(spark, seed):
    log = random_log(seed)
    _, expected = fold(log)
    got = tables.column(daily_streaks(frame(spark, log)), "id", "daily_streak")
    assert got == expected
    assert max(expected.values()) >= 4


@pytest.mark.parametrize("seed", range(3))
def test_streaks_and_profiles_with_resets(spark, seed):
    resets = [ZERO + timedelta(days=8, hours=7), ZERO + timedelta(days=16)]
    log = random_log(10 + seed, resets=resets)
    expected, streaks = fold(log)
    answers = frame(spark, log)
    texts = [f"{reset.isoformat()}Z" for reset in resets]
    assert tables.column(daily_streaks(assign_epoch(answers, texts)), "id", "daily_streak") == streaks
    assert collected(rebuild_profiles(answers, texts)) == expected


@pytest.mark.parametrize("seed", range(2))
def test_midnight_resets_only_show_in_the_last_state(spark, seed):
    log = random_log(20 + seed)
    midnights = [
        {"kind": "midnight", "date": tables.day(n), "at": ZERO + timedelta(days=n), "id": ""}
        for n in range(1, DAYS + 3)
    ]
    expected, streaks = fold(sorted(log + midnights, key=lambda e: (e["at"], e["id"])))
    answers = frame(spark, log)
    assert tables.column(daily_streaks(answers), "id", "daily_streak") == streaks
    closed = reset_missed_streaks(rebuild_profiles(answers), tables.day(DAYS + 2).isoformat())
    assert {u: s["streak"] for u, s in collected(closed).items()} == {
        u: s["streak"] for u, s in expected.items()
    }


@pytest.mark.parametrize("parts", [2, 5])
def test_batches_go_on_from_stored_profiles(spark, parts):
    log = random_log(30 + parts)
    expected, expected_streaks = fold(log)
    cuts = [len(log) * n // parts for n in range(parts + 1)]
    profiles = rebuild_profiles(frame(spark, log[: cuts[1]]))
    streaks = fold(log[: cuts[1]])[1]
    for start, end in zip(cuts[1:], cuts[2:]):
        batch = frame(spark, log[start:end])
        streaks.update(tables.column(daily_streaks(batch, profiles), "id", "daily_streak"))
        # The stored table between two batches.
        rows = merge_profiles(profiles, batch).collect()
        touched = {row.discord_user_id: row for row in touched_profiles(profiles, batch).collect()}
        assert touched == {r.discord_user_id: r for r in rows if r.discord_user_id in touched}
        assert set(touched) == {event["user"] for event in log[start:end]}
        profiles = spark.createDataFrame(rows, profiles.schema)
    assert streaks == expected_streaks
    assert collected(profiles) == expected


def test_rebuild_on_a_snapshot_with_a_reset(spark):
    reset = ZERO + timedelta(days=15, hours=3)
    log = random_log(40, resets=[reset])
    expected, _ = fold(log)
    early = [event for event in log if event["at"] < ZERO + timedelta(days=10)]
    late = [event for event in log if event["at"] >= ZERO + timedelta(days=10)]
    base = rebuild_profiles(frame(spark, early))
    assert collected(rebuild_profiles(frame(spark, late), [f"{reset.isoformat()}Z"], base)) == expected


def test_first_answer_of_a_date_follows_the_end_of_the_day_before(spark):
    at = tables.START
    rows = [
        # Right, then wrong in another guild on the same date: the date ends at 0.
        ("1", "s1", "u", None, "u", tables.day(0), True, 10, at),
        ("2", "s2", "u", None, "u", tables.day(0), False, 0, at + timedelta(hours=1)),
        ("3", "s3", "u", None, "u", tables.day(1), True, 10, at + timedelta(days=1)),
        # Right again on the same date starts over at 1.
        ("4", "s4", "u", None, "u", tables.day(1), True, 10, at + timedelta(days=1, hours=1)),
        ("5", "s5", "u", None, "u", tables.day(2), True, 10, at + timedelta(days=2)),
        ("6", "s6", "u", None, "u", None, True, 10, at + timedelta(days=2, hours=1)),
        ("7", "s7", "u", None, "u", tables.day(4), True, 10, at + timedelta(days=4)),
    ]
    got = tables.column(daily_streaks(tables.answers(spark, rows)), "id", "daily_streak")
    assert got == {"1": 1, "2": 0, "3": 1, "4": 1, "5": 2, "7": 1}


def test_dates_follow_the_clock_not_the_calendar(spark):
    at = tables.START
    rows = [
        ("1", "s1", "u", None, "u", tables.day(5), True, 10, at),
        ("2", "s2", "u", None, "u", tables.day(6), True, 10, at + timedelta(hours=1)),
        # A session for an earlier date, answered later.
        ("3", "s3", "u", None, "u", tables.day(1), True, 10, at + timedelta(hours=2)),
        ("4", "s4", "u", None, "u", tables.day(2), True, 10, at + timedelta(hours=3)),
    ]
    answers = tables.answers(spark, rows)
    assert tables.column(daily_streaks(answers), "id", "daily_streak") == {
        "1": 1,
        "2": 2,
        "3": 1,
        "4": 2,
    }
    state = rebuild_profiles(answers).first()
    assert (state.daily_streak, state.last_daily_date) == (2, tables.day(2))


def test_empty_log(spark):
    none = tables.answers(spark, [])
    assert daily_streaks(none).collect() == []
    assert rebuild_profiles(none).collect() == []
    base = rebuild_profiles(
        tables.answers(spark, [("1", "s", "u", None, "u", None, False, 0, tables.START)])
    )
    assert collected(merge_profiles(base, none)) == collected(base)
