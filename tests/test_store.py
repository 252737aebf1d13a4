"""The store of the stream: crashes, any order of arrival, buckets, merges and old folders."""

import random
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

import drillbook.streaming.store as store_module
from drillbook.operators import answers as an
from drillbook.operators.profiles import rebuild_profiles
from drillbook.operators.streaks import reset_missed_streaks
from drillbook.schemas import EMPLOYEE_PROFILES
from drillbook.sources.records import RecordTaken, Records
from drillbook.sources import parse_choice_id
from drillbook.streaming import (
    Store,
    answer_log,
    apply_close_day,
    apply_reset,
    compact,
    current_profiles,
    current_quiz_runs,
    last_batch,
    prepare_store,
    process_batch,
    stage_batch,
    vacuum,
)
from tests import tables
from tests.tables import ZONE
from tests.test_streaming import ZERO, log, model, presses, same, verdicts_of


class Crash(Exception):
    pass


def one_press_per_answer(seed, size):
    """Presses without duplicates, so that the accepted ones do not depend on the order of arrival."""
    rows, seen = [], set()
    for row in log(seed, size):
        key = (row[1].split(":")[1], row[2])
        if key not in seen:
            seen.add(key)
            rows.append(row)
    return rows


def accepted(spark, rows):
    sessions, bank = model(spark)
    return an.accept_answers(
        an.enrich_submissions(parse_choice_id(presses(spark, rows)), sessions, bank), ZONE
    )


def run(spark, root, chunks, start=0):
    sessions, bank = model(spark)
    for number, chunk in enumerate(chunks, start):
        process_batch(presses(spark, chunk), number, root, lambda: sessions, lambda: bank, ZONE)


@pytest.mark.parametrize("last_write", range(1, 7))
def test_a_batch_that_dies_after_any_write_changes_nothing(spark, tmp_path, monkeypatch, last_write):
    """Five tables and the record: a day is closed and scores are reset before the batch comes again."""
    rows = log(11, 120)
    root = str(tmp_path / "store")
    sessions, bank = model(spark)
    prepare_store(spark, root)
    run(spark, root, [rows[:60]])
    before = verdicts_of(spark, root)
    writes, write, put = [0], Store.write, Records.put

    def counted(*args, **kwargs):
        made = write(*args, **kwargs)
        writes[0] += 1
        if writes[0] == last_write - 1:
            raise Crash
        return made

    def refused(*args):
        if last_write == 6:
            raise Crash
        return put(*args)

    def staged(self, *args, **kwargs):
        if last_write == 1:
            raise Crash
        return names(self, *args, **kwargs)

    names = Store.read
    with monkeypatch.context() as patch:
        patch.setattr(Store, "write", counted)
        patch.setattr(Store, "read", staged)
        patch.setattr(Records, "put", refused)
        with pytest.raises(Crash):
            run(spark, root, [rows[60:]], start=1)
    assert last_batch(spark, root) == 0 and verdicts_of(spark, root) == before
    apply_close_day(spark, root, sessions, "2024-01-03")
    run(spark, root, [rows[60:]], start=1)
    answers = accepted(spark, rows)
    expected = reset_missed_streaks(rebuild_profiles(answers), "2024-01-03")
    assert same(current_profiles(spark, root), expected)
    assert answer_log(spark, root).count() == len(rows)


@pytest.mark.parametrize("seed", [21, 22])
def test_profiles_do_not_depend_on_the_order_of_arrival(spark, tmp_path, monkeypatch, seed):
    monkeypatch.setattr(store_module, "FAN_IN", 3)
    rows = one_press_per_answer(seed, 400)
    shuffled = random.Random(seed).sample(rows, len(rows))
    root = str(tmp_path / "store")
    start = spark.createDataFrame(
        [("u1", "old name", 70, 4, tables.day(0), ZERO), ("idle", "someone", 20, 1, tables.day(0), ZERO)],
        EMPLOYEE_PROFILES,
    )
    prepare_store(spark, root, start, buckets=3)
    reset = ZERO + timedelta(days=3, hours=5)
    chunks = [shuffled[part::6] for part in range(6)]
    run(spark, root, chunks[:4])
    apply_reset(spark, root, f"{reset:%Y-%m-%d %H:%M:%S}Z")
    run(spark, root, chunks[4:], start=4)
    expected = rebuild_profiles(accepted(spark, rows), [reset], start)
    assert same(current_profiles(spark, root), expected)


def test_two_resets_of_one_day_put_in_the_wrong_order(spark, tmp_path):
    rows = one_press_per_answer(23, 300)
    root = str(tmp_path / "store")
    prepare_store(spark, root, buckets=2)
    run(spark, root, [rows[::2]])
    resets = [ZERO + timedelta(days=2, hours=hours) for hours in (4, 9)]
    for reset in reversed(resets):
        apply_reset(spark, root, f"{reset:%Y-%m-%d %H:%M:%S}Z")
        apply_reset(spark, root, f"{reset:%Y-%m-%d %H:%M:%S}Z")
    run(spark, root, [rows[1::2]], start=1)
    assert same(current_profiles(spark, root), rebuild_profiles(accepted(spark, rows), resets))
    assert Store(spark, root).latest()[0] == 4


def test_a_late_day_mends_the_chain_and_a_closed_day(spark, tmp_path):
    """Days 1, 2 and 4 are answered, day 5 is closed, then the answer of day 3 comes."""
    sessions, bank = model(spark)

    def press(day):
        at = ZERO + timedelta(days=day - 1, hours=1)
        return (f"{day}", f"answer:g{day - 1}:0", "u1", None, "ann", at)

    root = str(tmp_path / "store")
    prepare_store(spark, root)
    run(spark, root, [[press(1), press(2)], [press(4)]])
    assert current_profiles(spark, root).first().daily_streak == 1
    apply_close_day(spark, root, sessions, "2024-01-09", "2024-01-09 06:00:00Z")
    closed = current_profiles(spark, root).first()
    assert closed.daily_streak == 0 and closed.last_daily_date == tables.day(4)
    run(spark, root, [[press(3)]], start=2)
    mended = current_profiles(spark, root).first()
    assert (mended.daily_streak, mended.total_points) == (0, 40)
    run(spark, root, [[press(n) for n in (5, 6, 7)]], start=3)
    final = current_profiles(spark, root).first()
    assert (final.daily_streak, final.last_daily_date) == (7, tables.day(7))


def test_a_change_that_comes_second_is_made_again(spark, tmp_path):
    """Scores are reset while a batch is at work: the batch folds its users anew."""
    rows = one_press_per_answer(24, 120)
    root = str(tmp_path / "store")
    sessions, bank = model(spark)
    prepare_store(spark, root)
    run(spark, root, [rows[:40]])
    reset, calls = ZERO + timedelta(days=3), []

    def slow_sessions():
        if not calls:
            calls.append(1)
            apply_reset(spark, root, f"{reset:%Y-%m-%d %H:%M:%S}Z")
        return sessions

    process_batch(presses(spark, rows[40:]), 1, root, slow_sessions, lambda: bank, ZONE)
    assert same(current_profiles(spark, root), rebuild_profiles(accepted(spark, rows), [reset]))
    store = Store(spark, root)
    number, state = store.latest()
    with pytest.raises(RecordTaken):
        store.records.put(number, state)
    assert not store.folder.names("staged")


def test_a_batch_reads_the_buckets_of_its_users(spark, tmp_path, monkeypatch):
    rows = one_press_per_answer(25, 200)
    root = str(tmp_path / "store")
    prepare_store(spark, root, buckets=32)
    run(spark, root, [rows])
    store = Store(spark, root)
    state = store.latest()[1]
    one = spark.createDataFrame([("u3",)], "discord_user_id string")
    bucket = store.with_bucket(one, state).first()["bucket"]
    files = current_profiles(spark, root, one).inputFiles()
    assert files and all(f"/bucket={bucket}/" in file for file in files)
    assert same(current_profiles(spark, root, one), current_profiles(spark, root).where("discord_user_id = 'u3'"))
    asked, read = [], Store.read

    def noted(self, state, table, parts=None):
        asked.append((table, parts))
        return read(self, state, table, parts)

    monkeypatch.setattr(Store, "read", noted)
    late = ("late", "answer:t9:3", "u3", None, "name-u3", ZERO + timedelta(days=9))
    run(spark, root, [[late]], start=1)
    by_bucket = [(table, parts) for table, parts in asked if table in ("base", "profiles")]
    assert by_bucket == [("base", [str(bucket)])]
    assert ("days", [str(bucket)]) in asked


def test_merges_keep_every_result_and_bound_the_folders(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store_module, "FAN_IN", 3)
    rows = one_press_per_answer(26, 260)
    root = str(tmp_path / "store")
    sessions, bank = model(spark)
    prepare_store(spark, root, buckets=2)
    merged = store_module.compact
    monkeypatch.setattr("drillbook.streaming.answers.compact", lambda spark, root: 0)
    run(spark, root, [rows[part::10] for part in range(10)])
    profiles = {row[0]: row for row in current_profiles(spark, root).collect()}
    verdicts = verdicts_of(spark, root)
    assert len(Store(spark, root).latest()[1]["tables"]["judged"]) == 10
    assert merged(spark, root) > 0 and compact(spark, root) == 0
    for table, entries in Store(spark, root).latest()[1]["tables"].items():
        assert len(entries) <= 2 * 3, table
    assert {row[0]: row for row in current_profiles(spark, root).collect()} == profiles
    assert verdicts_of(spark, root) == verdicts
    assert answer_log(spark, root).count() == len(rows)
    assert vacuum(spark, root, keep=1) > 0 and vacuum(spark, root, keep=1) == 0
    assert {row[0]: row for row in current_profiles(spark, root).collect()} == profiles
    folders = Store(spark, root).folder
    state = Store(spark, root).latest()[1]
    for table, entries in state["tables"].items():
        assert len(folders.names(table)) == len(entries)
    run(spark, root, [rows[:5]], start=10)
    assert same(current_profiles(spark, root), rebuild_profiles(accepted(spark, rows)))


def test_a_hundred_changes_leave_a_bounded_number_of_folders(spark, tmp_path):
    root = str(tmp_path / "store")
    prepare_store(spark, root)
    store = Store(spark, root)
    one = spark.createDataFrame([("r", 1, 1, ZERO)], store_module.STEPS).coalesce(1)
    for _ in range(100):

        def make(number, state):
            entries = state["tables"]["steps"] + store.write(one, "steps", store.attempt(number))
            return {**state, "tables": {**state["tables"], "steps": entries}}

        store.change(make)
        compact(spark, root)
        entries = store.latest()[1]["tables"]["steps"]
        levels = [entry["level"] for entry in entries]
        assert levels == sorted(levels, reverse=True)
        assert all(levels.count(level) < store_module.FAN_IN for level in levels)
    vacuum(spark, root, keep=2)
    assert len(store.folder.names("steps")) <= len(entries) + store_module.FAN_IN
    total = store.read(store.latest()[1], "steps").agg(F.sum("steps")).first()[0]
    assert total == 100 and len(store.records.numbers()) == 2


def test_a_reader_of_an_older_record_still_has_its_folders(spark, tmp_path):
    rows = one_press_per_answer(27, 60)
    root = str(tmp_path / "store")
    prepare_store(spark, root)
    run(spark, root, [rows[:20], rows[20:40]])
    store = Store(spark, root)
    _, old = store.latest()
    pinned = store.profiles(old)
    compact(spark, root, fan_in=2)
    run(spark, root, [rows[40:]], start=2)
    vacuum(spark, root, keep=10)
    assert same(pinned, rebuild_profiles(accepted(spark, rows[:40])))


def test_a_staged_batch_without_its_record_is_not_seen_and_goes_away(spark, tmp_path):
    rows = log(28, 60)
    root = str(tmp_path / "store")
    sessions, bank = model(spark)
    prepare_store(spark, root)
    store = Store(spark, root)
    number, state = store.latest()
    made = stage_batch(store, number + 1, state, presses(spark, rows), 0, sessions, bank, ZONE)
    assert made["batch_id"] == 0 and last_batch(spark, root) == -1
    assert answer_log(spark, root).isEmpty() and current_profiles(spark, root).isEmpty()
    assert current_quiz_runs(spark, root, spark.createDataFrame([], "id string, question_ids array<string>, "
        "current_index int, correct_count int, completed_at timestamp")).isEmpty()
    run(spark, root, [rows])
    assert len(store.folder.names("judged")) == 2
    run(spark, root, [[]], start=1)
    vacuum(spark, root, keep=1)
    assert len(store.folder.names("judged")) == 1 and not store.folder.names("staged")
    assert same(current_profiles(spark, root), rebuild_profiles(accepted(spark, rows)))
