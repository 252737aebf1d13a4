"""The plans that the results depend on at scale."""

import re

import pytest
from pyspark.sql import functions as F

from drillbook.operators import answers as an
from drillbook.operators import assign, lookups, reports
from drillbook.operators.profiles import rebuild_profiles
from drillbook.operators.streaks import daily_streaks
from drillbook.schemas import EMPLOYEE_PROFILES, QUESTION_SESSIONS, QUESTIONS
from drillbook.sources import active_questions, read_table
from tests import tables
from tests.tables import ZONE, question, session
from workload.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
STREAMS = {name for name in QUERIES if "stream" in name} | {"redelivered_presses", "late_clock_answers"}


def plan(rows):
    return rows._jdf.queryExecution().executedPlan().toString()


def initial(text):
    """The plan before run-time changes."""
    return text.split("== Initial Plan ==")[-1]


def hot_log(spark, size=120000):
    """Submissions a third of which go to one daily session, and their sessions."""
    n = F.col("id")
    hot = n % 3 == 0
    submissions = spark.range(0, size, 1, 8).select(
        n.cast("string").alias("id"),
        F.when(hot, "hot").otherwise(F.concat(F.lit("s"), n % 20000)).alias("session_id"),
        F.concat(F.lit("u"), F.when(hot, n % 30000).otherwise(n % 20000)).alias("discord_user_id"),
        F.lit(None).cast("string").alias("global_name"),
        F.lit("n").alias("username"),
        (n % 2).cast("smallint").alias("selected_option"),
        F.timestamp_seconds(1704200000 + n % 50000).alias("answered_at"),
    )
    columns = [F.lit(None).cast(field.dataType).alias(field.name) for field in QUESTION_SESSIONS.fields]
    blank = spark.range(20001).withColumnRenamed("id", "n").select("n", *columns)
    first = F.col("n") == 20000
    sessions = blank.withColumns(
        {
            "id": F.when(first, "hot").otherwise(F.concat(F.lit("s"), "n")),
            "question_id": F.when(F.col("n") % 3 == 0, "7").otherwise((F.col("n") % 100).cast("string")),
            "kind": F.when(first, "daily").otherwise("trivia"),
            "guild_id": F.lit("g"),
            "daily_date": F.when(first, F.lit("2024-01-02").cast("date")),
        }
    ).drop("n")
    questions = tables.questions(spark, *[question(str(n)) for n in range(100)])
    return submissions, sessions, questions


def test_a_hot_session_is_split_in_the_join(spark, conf):
    conf(
        **{
            "spark__sql__autoBroadcastJoinThreshold": "-1",
            "spark__sql__adaptive__skewJoin__skewedPartitionThresholdInBytes": "100k",
            "spark__sql__adaptive__advisoryPartitionSizeInBytes": "50k",
            "spark__sql__shuffle__partitions": "16",
        }
    )
    enriched = an.enrich_submissions(*hot_log(spark))
    for result, count in (
        (an.accept_answers(enriched, ZONE), 30000),
        (an.screen_submissions(enriched, ZONE), 120000),  # what verdicts are marked on
    ):
        assert len(result.collect()) == count
        assert "SortMergeJoin(skew=true)" in plan(result)


def test_first_answers_are_limited_before_their_shuffle(spark):
    enriched = an.enrich_submissions(*hot_log(spark, 300))
    text = plan(an.accept_answers(enriched, ZONE))
    final, exchange, partial = (
        text.index(part) for part in ("1, Final", "Exchange hashpartitioning(_w0", "1, Partial")
    )
    assert final < exchange < partial


def test_answers_are_reduced_to_days_before_any_shuffle_by_user(spark):
    rows = [("1", "s", "u", None, "u", tables.day(0), True, 10, tables.START)]
    stored = tables.answers(spark, rows)
    text = plan(rebuild_profiles(stored))
    assert text.count("Exchange hashpartitioning") == 2
    by_user = text.index("Exchange hashpartitioning(discord_user_id#")
    assert by_user < text.index("partial_sum(points_awarded")
    # The chain, the sums and the names share one shuffle and one scan.
    assert len(re.findall(r"Scan|LocalTableScan", text)) == 1
    windows = re.findall(r"windowspecdefinition\((.*?)#", plan(daily_streaks(stored)))
    assert windows and set(windows) == {"discord_user_id"}


def test_leaderboard_takes_the_top_without_a_full_sort(spark):
    text = plan(reports.leaderboard(spark.createDataFrame([], EMPLOYEE_PROFILES)))
    assert "TakeOrderedAndProject(limit=10" in text


def test_filters_and_columns_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "questions")
    tables.questions(spark, question("1")).write.parquet(path)
    text = plan(active_questions(read_table(spark, "questions", path)).select("id"))
    assert "EqualTo(enabled,true)" in text
    assert re.search(r"ReadSchema: struct<id:string,enabled:boolean>", text)
    path = str(tmp_path / "sessions")
    tables.sessions(spark, session("1")).write.parquet(path)
    sessions = read_table(spark, "question_sessions", path)
    text = plan(assign.expired_daily_sessions(sessions, "2024-01-03").select("id"))
    assert "EqualTo(kind,daily)" in text and "EqualTo(daily_date,2024-01-02)" in text


def test_semi_join_sides_are_distinct_first(spark):
    bank = spark.createDataFrame([], QUESTIONS)
    sessions = spark.range(9).select(F.lit("1").alias("question_id"))
    text = initial(plan(lookups.restrict_violations(bank.union(bank), sessions, "question_id")))
    assert "HashAggregate" in text


@pytest.mark.parametrize("name", sorted(set(QUERIES) - STREAMS))
def test_registered_plans_stay_declarative(spark, name):
    text = plan(QUERIES[name](spark, FOLDER))
    for operator in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python", "MapInPandas"):
        assert operator not in text
    # Windows without a partition only number the ten leaders and the 4,096
    # offsets of a bank, not rows of a table.
    for window in re.findall(r"windowspecdefinition\((\S+)", text):
        assert re.match(r"(_w0|_bucket|total_points|discord_user_id)#", window), window


def test_windows_without_a_partition_are_bounded(spark):
    text = plan(QUERIES["card_picked"](spark, FOLDER))
    single = re.search(r"Exchange SinglePartition.*?\n(.*\n){2}", text.split("_offset")[-1])
    assert single and "HashAggregate(keys=[_bucket" in single.group(0)


def shuffles(rows):
    return re.findall(r"Exchange hashpartitioning\((.*?), \d+\)", initial(plan(rows)))


def test_a_quiz_takes_two_shuffles_of_its_requests_whatever_its_size(spark, conf):
    conf(spark__sql__autoBroadcastJoinThreshold="-1")
    requests = spark.range(9).select(F.col("id").alias("request_id"))
    bank = tables.questions(spark, *[question(str(n)) for n in range(30)]).select("id")
    for size in (3, 7):
        keys = shuffles(assign.pick_distinct(requests, bank, size, "s", "request_id"))
        assert sum(key.startswith(("idx#", "_key#")) for key in keys) == 3  # picks, bank, requests
        assert not any("_pick" in key for key in keys)


def test_copies_of_one_press_stay_spread(spark, conf):
    """A third of the log is one press delivered again and again: no task gets its copies."""
    conf(
        spark__sql__autoBroadcastJoinThreshold="-1",
        spark__sql__shuffle__partitions="16",
        spark__sql__adaptive__coalescePartitions__enabled="false",
    )
    submissions, sessions, questions = hot_log(spark, 6000)
    hot = F.col("session_id") == "hot"
    one = {
        "id": F.when(hot, "press").otherwise(F.col("id")),
        "discord_user_id": F.when(hot, "u1").otherwise(F.col("discord_user_id")),
        "answered_at": F.when(hot, F.timestamp_seconds(F.lit(1704200000))).otherwise(F.col("answered_at")),
        "selected_option": F.when(hot, 1).otherwise(F.col("selected_option")).cast("smallint"),
    }
    judged = an.judge_submissions(an.enrich_submissions(submissions.withColumns(one), sessions, questions), ZONE)
    rows = judged.withColumn("task", F.spark_partition_id()).where("id = 'press'").collect()
    assert sorted(row.verdict for row in rows) == ["duplicate"] * 1999 + ["ok"]
    tasks = [row.task for row in rows]
    assert max(map(tasks.count, set(tasks))) < 2 * 2000 / len(set(tasks)) and len(set(tasks)) > 2
    text = initial(plan(judged))
    assert re.findall(r"windowspecdefinition\((\S+?)#", text) and not re.search(r"windowspecdefinition\(id#", text)
    keys = shuffles(judged)
    assert sum(key.startswith("_place#") for key in keys) == 2
    assert all(key.startswith(("_place#", "_w0#")) for key in keys)


def test_streaks_move_answers_by_user_and_date_not_by_id(spark, conf):
    conf(spark__sql__autoBroadcastJoinThreshold="-1")
    rows = [("1", "s", "u", None, "u", tables.day(0), True, 10, tables.START)]
    keys = shuffles(daily_streaks(tables.answers(spark, rows)))
    assert keys and all(key.startswith("discord_user_id#") for key in keys)


def test_stats_of_one_user_filter_below_the_judging(spark):
    text = initial(plan(QUERIES["employee_stats_one"](spark, FOLDER)))
    first = text.index("WindowGroupLimit")
    assert re.search(r"Filter .*user_id#\d+.* = 7\)", text[first:])


def test_cascades_read_the_children_once(spark):
    children = spark.range(9).select("id", F.lit("1").alias("parent"))
    kept = lookups.cascade_delete(children, spark.range(3), "parent")
    assert initial(plan(kept)).count("Range (0, 9") == 1
