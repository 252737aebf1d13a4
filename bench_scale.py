"""Time the core on generated submissions, a third of which come from one user.

    python bench_scale.py [rows ...]

Writes the submissions once per size, then times judging, folding and quiz
assignment from the stored table. Prints one JSON line per size. The figures
"""

import json
import os
import sys
import tempfile
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from drillbook.operators import answers, assign, profiles, streaks

ZONE = "America/Chicago"
BANK, DAYS = 20_000, 60


def tables(spark, rows):
    """Submissions, sessions and questions: daily sessions of 200 guilds, one trivia session a press."""
    n = F.col("id")
    day = (n % DAYS).cast("int")
    user = F.when(n % 3 == 0, F.lit(0)).otherwise(n % (rows // 50))
    at = F.timestamp_seconds(F.lit(1704175200) + day * 86400 + n % 80000)
    daily = n % 5 < 2
    presses = spark.range(0, rows, 1, 64).select(
        n.cast("string").alias("id"),
        F.when(daily, F.concat_ws("-", F.lit("d"), n % 200, day))
        .otherwise(F.concat(F.lit("t"), n)).alias("session_id"),
        F.concat(F.lit("u"), user).alias("discord_user_id"),
        F.lit(None).cast("string").alias("global_name"),
        F.concat(F.lit("name"), user).alias("username"),
        (n % 4).cast("smallint").alias("selected_option"),
        at.alias("answered_at"),
        day.alias("day"),
        (n % 200).alias("guild"),
    )
    sessions = presses.dropDuplicates(["session_id"]).select(
        F.col("session_id").alias("id"),
        (F.xxhash64("session_id") % BANK).cast("string").alias("question_id"),
        F.when(F.col("session_id").startswith("d"), "daily").otherwise("trivia").alias("kind"),
        F.concat(F.lit("g"), "guild").alias("guild_id"),
        F.lit(None).cast("string").alias("owner_discord_user_id"),
        F.when(
            F.col("session_id").startswith("d"),
            F.date_add(F.lit("2024-01-02").cast("date"), F.col("day")),
        ).alias("daily_date"),
        F.lit(None).cast("string").alias("quiz_run_id"),
        (F.col("answered_at") - F.expr("INTERVAL 1 DAY")).alias("created_at"),
    )
    questions = spark.range(-BANK, BANK).select(
        n.cast("string").alias("id"),
        F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.concat(F.lit("opt-"), i)).alias("options"),
        F.pmod(n, F.lit(4)).cast("smallint").alias("correct_option"),
        F.lit("why").alias("explanation"),
        F.lit(True).alias("enabled"),
    )
    return presses.drop("day", "guild"), sessions, questions


def main():
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "32")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    for rows in [int(size) for size in sys.argv[1:]] or [1_000_000]:
        root = tempfile.mkdtemp(prefix="drillbook-scale-")
        stored = {}
        for name, table in zip(("presses", "sessions", "questions"), tables(spark, rows)):
            table.write.parquet(os.path.join(root, name))
            stored[name] = spark.read.parquet(os.path.join(root, name))
        enriched = answers.enrich_submissions(*stored.values())
        accepted = answers.accept_answers(enriched, ZONE)
        accepted.write.parquet(f"{root}/accepted")
        log = spark.read.parquet(f"{root}/accepted")
        requests = stored["presses"].select(
            F.col("id").alias("request_id"), "discord_user_id", F.lit("g").alias("guild_id"),
            F.col("answered_at").alias("requested_at"),
        )
        steps = {
            "judge and accept": accepted,
            "verdict of every row": answers.judge_submissions(enriched, ZONE),
            "submissions to profiles": profiles.rebuild_profiles(accepted),
            "streaks from stored answers": streaks.daily_streaks(log),
            "profiles from stored answers": profiles.rebuild_profiles(log),
            "quiz assignment": assign.assign_quizzes(requests, stored["questions"], "7"),
        }
        seconds = {}
        for name, frame in steps.items():
            started = time.perf_counter()
            frame.write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.perf_counter() - started, 1)
        print(json.dumps({"rows": rows, "seconds": seconds}), flush=True)


if __name__ == "__main__":
    main()
