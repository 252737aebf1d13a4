"""Repeatable random picks in bulk: trivia, quizzes and daily questions.

A pick is a hash of the request key and a seed, taken as an index into a
numbered bank. The bank is numbered without a global sort, and a request looks
at its own picks only, so the work is requests times picks however large the
bank is.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from drillbook.functions import hash_number, hash_numbers, stable_id
from drillbook.schemas import QUESTION_SESSIONS, QUIZ_RUNS
from drillbook.sources.tables import evolve_schema

# Hexadecimal digits of the hash that bucket a bank: 16^3 buckets.
_BUCKET_DIGITS = 3

# Fixed value: questions in a quiz.
QUIZ_SIZE = 5


def index_bank(bank: DataFrame, key: str = "id") -> DataFrame:
    """Number the rows of a bank 0, 1, 2, ... in `idx`, in order of hash bucket, then key.

    Rows are ranked within their bucket and moved by the sizes of the buckets
    before; there are 4,096 buckets at most, so the offsets are always small
    enough to broadcast.
    """
    bucketed = bank.withColumn(
        "_bucket", F.substring(F.md5(F.col(key).cast("string")), 1, _BUCKET_DIGITS)
    )
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        bucketed.groupBy("_bucket")
        .agg(F.count("*").alias("_size"))
        .select("_bucket", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    )
    rank = F.row_number().over(Window.partitionBy("_bucket").orderBy(key))
    return (
        bucketed.withColumn("_rank", rank)
        .join(F.broadcast(offsets), "_bucket")
        .withColumn("idx", F.col("_offset") + F.col("_rank") - 1)
        .drop("_bucket", "_rank", "_offset")
    )


def bank_size(bank: DataFrame):
    """The number of rows as a scalar for use in expressions."""
    return bank.agg(F.count("*")).scalar()


def pick_one(
    requests: DataFrame, bank: DataFrame, seed: str, request_key: str, key: str = "id"
) -> DataFrame:
    """Give each request one row of the bank, uniformly; with an empty bank none.

    Columns of requests and bank must differ, except that the bank's key comes
    back as `picked_<key>`.
    """
    draw = hash_number(F.lit(seed), F.col(request_key))
    numbered = index_bank(bank, key).withColumnRenamed(key, f"picked_{key}")
    return (
        requests.withColumn("_size", bank_size(bank))
        .withColumn("idx", F.try_mod(draw, F.col("_size")))
        .join(numbered, "idx")
        .drop("idx", "_size")
    )


def _sessions(rows: DataFrame) -> DataFrame:
    """Complete rows to the stored session table with its defaults."""
    return evolve_schema(rows, QUESTION_SESSIONS)


def assign_trivia(requests: DataFrame, questions: DataFrame, seed: str) -> DataFrame:
    """One owned trivia session per request, on a random active question.

    Requests hold request_id, discord_user_id, guild_id, channel_id and
    requested_at. Without active questions no session is made.
    """
    bank = questions.where("enabled").select("id")
    picked = pick_one(requests, bank, f"trivia:{seed}", "request_id")
    return _sessions(
        picked.select(
            stable_id("trivia", F.col("request_id")).alias("id"),
            F.col("picked_id").alias("question_id"),
            F.lit("trivia").alias("kind"),
            "guild_id",
            "channel_id",
            F.col("discord_user_id").alias("owner_discord_user_id"),
            F.col("requested_at").alias("created_at"),
        )
    )


def pick_distinct(
    requests: DataFrame, bank: DataFrame, size: int, seed: str, request_key: str
) -> DataFrame:
    """Add `picked_ids`: `size` distinct bank ids per request, in random order.

    Floyd's sampling without replacement: draw j comes from 0..n-size+j, and a
    number drawn before is replaced by the top of that range. Requests are left
    out when the bank has fewer rows than asked. Every pick becomes a row of key,
    rank and number; all picks meet the numbered bank in one join and come
    together again by request key, which must be unique, before the requests
    join them: two shuffles of narrow rows and one of the requests whatever the
    size.
    """
    key = F.col(request_key)
    total = F.col("_size")
    rows = (
        requests.withColumn("_size", bank_size(bank))
        .where(total >= size)
        .withColumns(
            {
                "_draws": hash_numbers(size, F.lit(seed), key),
                "_ranks": hash_numbers(size, F.lit(seed), key, F.lit("order")),
            }
        )
    )
    picks: list[str] = []
    for j in range(size):
        top = total - size + j
        drawn = F.get("_draws", F.lit(j)) % (top + 1)
        repeated = drawn.isin(*[F.col(pick) for pick in picks]) if picks else F.lit(False)
        rows = rows.withColumn(f"_pick{j}", F.when(repeated, top).otherwise(drawn))
        picks.append(f"_pick{j}")

    slots = F.array(
        *[
            F.struct(F.col(pick).alias("idx"), F.get("_ranks", F.lit(j)).alias("rank"))
            for j, pick in enumerate(picks)
        ]
    )
    numbered = index_bank(bank).select("idx", F.col("id").alias("_id"))
    picked = (
        rows.select(key.alias("_key"), F.inline(slots))
        .join(numbered, "idx")
        .groupBy("_key")
        .agg(F.sort_array(F.collect_list(F.struct("rank", "_id")))["_id"].alias("picked_ids"))
    )
    return requests.join(picked, key == F.col("_key")).select(*requests.columns, "picked_ids")


def assign_quizzes(
    requests: DataFrame, questions: DataFrame, seed: str, size: int = QUIZ_SIZE
) -> DataFrame:
    """One quiz run per request, of `size` distinct active questions.

    With fewer active questions than that every request is refused.
    """
    bank = questions.where("enabled").select("id")
    picked = pick_distinct(requests, bank, size, f"quiz:{seed}", "request_id")
    zero = F.lit(0)
    return evolve_schema(
        picked.select(
            stable_id("quiz", F.col("request_id")).alias("id"),
            "discord_user_id",
            "guild_id",
            F.col("picked_ids").alias("question_ids"),
            F.col("requested_at").alias("created_at"),
        ),
        QUIZ_RUNS,
        {"current_index": zero, "correct_count": zero},
    )


def quiz_sessions(runs: DataFrame, channels: DataFrame) -> DataFrame:
    """The session of the current question of each open run.

    `channels` gives channel_id per quiz_run_id. The id depends on run and
    index, so making the sessions again changes nothing.
    """
    question = F.get("question_ids", F.col("current_index"))
    opened = runs.withColumn("question_id", question).where(F.col("question_id").isNotNull())
    placed = opened.join(channels.withColumnRenamed("quiz_run_id", "id"), "id")
    return _sessions(
        placed.select(
            stable_id("quiz-session", F.col("id"), F.col("current_index")).alias("id"),
            "question_id",
            F.lit("quiz").alias("kind"),
            "guild_id",
            "channel_id",
            F.col("discord_user_id").alias("owner_discord_user_id"),
            "created_at",
            F.col("id").alias("quiz_run_id"),
        )
    )


def assign_daily(
    calendar: DataFrame, sessions: DataFrame, questions: DataFrame, seed: str
) -> DataFrame:
    """The daily session of each (guild_id, daily_date) of a calendar, and what is to do.

    `posted` sessions need nothing, `pending` ones were saved but not posted and
    keep their question, `new` ones get a random active question. Running it
    again makes the same ids. A new one fails the job when no question is active.
    """
    saved = sessions.where(F.col("daily_date").isNotNull()).select(
        "guild_id",
        "daily_date",
        F.col("id").alias("session_id"),
        "question_id",
        "message_id",
    )
    status = (
        F.when(F.col("message_id").isNotNull(), "posted")
        .when(F.col("session_id").isNotNull(), "pending")
        .otherwise("new")
    )
    planned = (
        calendar.select("guild_id", "daily_date")
        .dropDuplicates(["guild_id", "daily_date"])
        .join(saved, ["guild_id", "daily_date"], "left")
        .withColumn("status", status)
        .drop("message_id")
    )
    bank = questions.where("enabled").select("id")
    numbered = index_bank(bank).withColumnRenamed("id", "_new_question")
    is_new = F.col("status") == "new"
    draw = hash_number(F.lit(f"daily:{seed}"), F.col("guild_id"), F.col("daily_date"))
    empty = F.raise_error(F.lit("the bank has no active question to assign to a new day"))
    # Saved rows draw too, though they keep their question: a null would send
    # them all to one task of the join.
    index = F.when(
        F.col("_size") == 0, F.when(is_new, empty.cast("bigint"))
    ).otherwise(F.try_mod(draw, F.col("_size")))
    return (
        planned.withColumn("_size", bank_size(bank))
        .withColumn("idx", index)
        .join(numbered, "idx", "left")
        .select(
            "guild_id",
            "daily_date",
            "status",
            F.coalesce(
                "session_id", stable_id("daily", F.col("guild_id"), F.col("daily_date"))
            ).alias("session_id"),
            F.coalesce("question_id", "_new_question").alias("question_id"),
        )
    )


def daily_session_rows(assigned: DataFrame, channel_id: str, created_at) -> DataFrame:
    """Session rows to append for the `new` days of `assign_daily`."""
    return _sessions(
        assigned.where("status = 'new'").select(
            F.col("session_id").alias("id"),
            "question_id",
            F.lit("daily").alias("kind"),
            "guild_id",
            F.lit(channel_id).alias("channel_id"),
            "daily_date",
            F.lit(created_at).cast("timestamp").alias("created_at"),
        )
    )


def expired_daily_sessions(sessions: DataFrame, as_of) -> DataFrame:
    """Posted daily sessions of the day before the local date `as_of`."""
    yesterday = F.date_sub(F.lit(as_of).cast("date"), 1)
    return sessions.where(
        (F.col("kind") == "daily")
        & (F.col("daily_date") == yesterday)
        & F.col("message_id").isNotNull()
    )
