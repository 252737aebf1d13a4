"""Continuous answer processing.

Each micro-batch is judged against its own rows and the answers of earlier
batches, and the profiles of its users are folded anew. What it writes counts
from the moment its record is put, all of it or none (`store`); a batch that
died before is done again from the start, and one that comes again after its
record is left alone.

Answers lie under the creation date of their session, which does not depend on
any clock of the answer: whatever answered a session before is under the same
date, so a batch reads the dates of its own sessions and nothing else.

Of an answer's user the store keeps totals per daily date and day seen. Totals
of parts add up whatever their order, and a profile is always folded from all
days of its user, the resets and the closed days, each by its own time. So late
answers, answers from before a reset that come after it, and answers in any
order give the profiles that the same accepted answers give in one batch.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from drillbook.operators.answers import (
    PLACE,
    ROW,
    as_placed,
    enrich_submissions,
    mark_duplicates,
    score_answers,
    screen_submissions,
)
from drillbook.operators.assign import expired_daily_sessions
from drillbook.operators.profiles import PROFILE_COLUMNS, day_totals, fold_days
from drillbook.operators.quizzes import apply_steps, quiz_steps
from drillbook.operators.streaks import assign_epoch, reset_missed_streaks
from drillbook.schemas import EMPLOYEE_PROFILES
from drillbook.sources.streams import parse_choice_id
from drillbook.streaming.store import (
    LOG,
    STEPS,
    USER,
    Store,
    compact,
    instants,
    merge_days,
    vacuum,
)

_DAY = 86_400_000_000
#: Columns of a screened submission that the log or its making needs.
_LATER = ("is_correct", "points_awarded", "batch_id")
STAGED = [
    *[name for name in LOG.names if name not in _LATER], "session_created_at", "correct_option", ROW, PLACE
]
#: Fixed value: how Spark names the folder of a null.
NO_DATE = "__HIVE_DEFAULT_PARTITION__"


def prepare_store(
    spark: SparkSession, root: str, profiles: DataFrame | None = None, buckets: int = 8
) -> None:
    """Create the store, optionally starting from existing profiles. Run once.

    `buckets` should grow with the number of users: a batch reads the totals and
    profiles of its users' buckets, so about a hundred thousand users per bucket
    keep that small.
    """
    store, name = Store(spark, root), Store.attempt(0)
    state = {"batch_id": -1, "buckets": buckets, "resets": [], "closings": []}
    tables = {table: [] for table in ("judged", "steps", "days", "profiles", "base")}
    if profiles is not None:
        start = store.with_bucket(profiles.select(*PROFILE_COLUMNS), state)
        tables["base"] = store.write(start, "base", name)
    store.records.put(0, {**state, "tables": tables})


def answer_log(spark: SparkSession, root: str) -> DataFrame:
    """All judged submissions; filters on accepted and session_date prune folders."""
    store = Store(spark, root)
    return store.read(store.latest()[1], "judged").drop("name")


def answers_of_dates(spark: SparkSession, root: str, dates: list, state: dict | None = None) -> DataFrame:
    """Accepted answers to sessions created on these dates; no other folder is listed."""
    store = Store(spark, root)
    state = store.latest()[1] if state is None else state
    parts = [NO_DATE if date is None else str(date) for date in dates]
    return store.read(state, "judged", parts).drop("name")


def last_batch(spark: SparkSession, root: str) -> int:
    """The last batch whose record stands, or -1."""
    return Store(spark, root).latest()[1]["batch_id"]


def current_profiles(spark: SparkSession, root: str, users: DataFrame | None = None) -> DataFrame:
    """Profiles after the last change; with `users`, theirs alone from their buckets."""
    store = Store(spark, root)
    state = store.latest()[1]
    if users is None:
        return store.profiles(state)
    wanted = users.select(USER).distinct()
    return store.profiles(state, _buckets(store, state, wanted)).join(wanted, USER, "left_semi")


def current_quiz_runs(spark: SparkSession, root: str, runs: DataFrame) -> DataFrame:
    """Quiz runs moved on by the answers of all batches."""
    store = Store(spark, root)
    return apply_steps(runs, store.read(store.latest()[1], "steps").select(*STEPS.names))


def _buckets(store: Store, state: dict, users: DataFrame) -> list[str]:
    """The buckets of some users; there are no more than the store has."""
    found = store.with_bucket(users, state).select("bucket").distinct().collect()
    return [str(row["bucket"]) for row in found]


def _day_rows(accepted: DataFrame, resets: list[int]) -> DataFrame:
    """Totals that no reset divides, per user, daily date and day seen."""
    seen = F.floor(F.unix_micros("answered_at") / _DAY).cast("long")
    epochs = assign_epoch(accepted, instants(resets)).withColumn("seen_day", seen)
    return epochs.groupBy(USER, "epoch", "daily_date", "seen_day").agg(*day_totals())


def _after_closings(profiles: DataFrame, closings: list) -> DataFrame:
    """Zero the streaks that a closed day found missed; the first such day sets the clock.

    A day's closing is an event of that day: whether it found a date missing is
    asked again when a late answer fills it in.
    """
    if not closings:
        return profiles
    known = F.array(
        *[
            F.struct(
                F.lit(as_of).cast("date").alias("as_of"),
                F.timestamp_micros(F.lit(now).cast("bigint")).alias("now"),
            )
            for as_of, now in sorted(closings, key=lambda closing: closing[0])
        ]
    )
    missing = F.filter(known, lambda closing: F.date_sub(closing["as_of"], 1) > F.col("last_daily_date"))
    first = F.when(F.col("daily_streak") > 0, F.get(missing, F.lit(0)))
    return profiles.withColumn("_first", first).select(
        USER,
        "display_name",
        "total_points",
        F.when(F.col("_first").isNotNull(), 0).otherwise(F.col("daily_streak")).alias("daily_streak"),
        "last_daily_date",
        F.greatest("updated_at", "_first.now").alias("updated_at"),
    )


def _fold(state: dict, days: DataFrame, base: DataFrame, keep_all: bool) -> DataFrame:
    """Profiles from stored totals, which move once, by user: a user has few rows of them."""
    resets = instants(state["resets"])
    dealt = merge_days(days.repartition(USER), state["resets"])
    folded = fold_days(dealt, resets, base.select(*PROFILE_COLUMNS), keep_all, by_user=True)
    return _after_closings(folded, state["closings"])


def stage_batch(
    store: Store,
    number: int,
    state: dict,
    presses: DataFrame,
    batch_id: int,
    sessions: DataFrame,
    questions: DataFrame,
    zone: str,
) -> dict:
    """Write everything a batch leads to; the state to put as record `number`."""
    spark, name = store.spark, store.attempt(number)
    tables = dict(state["tables"])

    def add(rows: DataFrame, table: str) -> dict:
        """The state of the new folder alone, which is also added to the table."""
        made = store.write(rows, table, name)
        tables[table] = tables[table] + made
        return {**state, "tables": {**tables, table: made}}

    enriched = enrich_submissions(parse_choice_id(presses), sessions, questions)
    staged = store.path("staged", name)
    placed = as_placed(screen_submissions(enriched, zone)).select(*STAGED)
    placed.write.parquet(staged)
    screened = spark.read.schema(placed.schema).parquet(staged)

    created = F.to_date("session_created_at")
    passing = screened.where("verdict = 'ok'").select(created.alias("date")).distinct()
    dates = [row["date"] for row in passing.collect()]
    stored = answers_of_dates(spark, store.root, dates, state)
    judged = score_answers(mark_duplicates(screened, stored))
    accepted = F.col("verdict") == "ok"
    new = add(
        judged.withColumns(
            {
                "batch_id": F.lit(batch_id).cast("bigint"),
                "accepted": accepted,
                "session_date": F.when(accepted, created),
            }
        ),
        "judged",
    )
    made = {**state, "batch_id": batch_id, "tables": tables}
    answers = answers_of_dates(spark, store.root, dates, new)
    if any(entry["parts"] for entry in new["tables"]["judged"]):
        add(quiz_steps(answers), "steps")
        new = add(store.with_bucket(_day_rows(answers, state["resets"]), state), "days")
        buckets = new["tables"]["days"][-1]["parts"]
        users = store.days(new).select(USER).distinct()
        days = store.days(made, buckets).join(users, USER, "left_semi")
        base = store.read(state, "base", buckets).join(users, USER, "left_semi")
        add(store.with_bucket(_fold(state, days, base, keep_all=False), state), "profiles")
    return made


def process_batch(
    presses: DataFrame,
    batch_id: int,
    root: str,
    sessions: Callable[[], DataFrame],
    questions: Callable[[], DataFrame],
    zone: str,
) -> None:
    """Judge, store and fold one micro-batch, once.

    `sessions` and `questions` are read anew here, as both tables grow while the
    stream runs. Folders are merged, and old ones dropped, when enough came
    together.
    """
    store = Store(presses.sparkSession, root)
    staged = []

    def make(number: int, state: dict) -> dict | None:
        if batch_id <= state["batch_id"]:
            return None
        staged.append(number)
        return stage_batch(store, number, state, presses, batch_id, sessions(), questions(), zone)

    if store.change(make):
        for item in store.folder.names("staged"):
            if int(item.split("=")[1][:12]) in staged:
                store.folder.delete(f"staged/{item}")
        if compact(presses.sparkSession, root):
            vacuum(presses.sparkSession, root)


def _micros(spark: SparkSession, at) -> int:
    one = spark.range(1).select(F.unix_micros(F.lit(at).cast("timestamp")).alias("at"))
    return one.first()["at"]


def _undivided(store: Store, state: dict, moment: int, name: str) -> list[dict]:
    """The days table with no totals from both sides of a new reset.

    Only totals of the reset's own day can hold both; these are added up anew
    from the answers of that day.
    """
    days = store.days(state)
    at = instants([moment])[0]
    divided = (F.col("first_answer.answered_at") < at) & (F.col("latest.answered_at") >= at)
    key = [F.col(USER).alias("_user"), F.col("daily_date").alias("_date"), F.col("seen_day").alias("_seen")]
    keys = days.where(divided).select(*key).distinct()
    if keys.isEmpty():
        return state["tables"]["days"]
    same: Column = (
        (F.col(USER) == F.col("_user"))
        & F.col("daily_date").eqNullSafe(F.col("_date"))
        & (F.col("seen_day") == F.col("_seen"))
    )
    start = moment // _DAY * _DAY
    that_day = F.col("answered_at").between(*instants([start, start + _DAY - 1]))
    answers = store.read(state, "judged").where(F.col("accepted") & that_day)
    anew = _day_rows(answers, state["resets"]).join(keys, same, "left_semi")
    rows = days.join(keys, same, "left_anti").unionByName(anew.drop("epoch"))
    level = max(entry["level"] for entry in state["tables"]["days"])
    return store.write(store.with_bucket(rows, state), "days", name, level)


def apply_reset(spark: SparkSession, root: str, at) -> None:
    """Reset the scores at a time; answers given before it do not count, whenever they come."""
    store, moment = Store(spark, root), _micros(spark, at)

    def make(number: int, state: dict) -> dict | None:
        if moment in state["resets"]:
            return None
        name = store.attempt(number)
        made = {**state, "resets": sorted([*state["resets"], moment])}
        made["tables"] = {**state["tables"], "days": _undivided(store, made, moment, name)}
        everyone = _fold(made, store.days(made), store.read(made, "base"), keep_all=True)
        levels = [entry["level"] for entry in state["tables"]["profiles"]]
        made["tables"]["profiles"] = store.write(
            store.with_bucket(everyone, state), "profiles", name, max(levels, default=0)
        )
        return made

    store.change(make)


def apply_close_day(spark: SparkSession, root: str, sessions: DataFrame, as_of, now=None) -> DataFrame:
    """Zero missed streaks in the store at local midnight; returns the sessions to take down."""
    store = Store(spark, root)
    closing = [str(as_of), None if now is None else _micros(spark, now)]

    def make(number: int, state: dict) -> dict | None:
        if closing in state["closings"]:
            return None
        profiles = store.profiles(state)
        missed = reset_missed_streaks(profiles, as_of, now).where("daily_streak = 0")
        changed = missed.join(profiles.where("daily_streak > 0").select(USER), USER, "left_semi")
        made = store.write(store.with_bucket(changed, state), "profiles", store.attempt(number))
        tables = {**state["tables"], "profiles": state["tables"]["profiles"] + made}
        return {**state, "closings": [*state["closings"], closing], "tables": tables}

    store.change(make)
    return expired_daily_sessions(sessions, as_of)


def run_answer_stream(
    presses: DataFrame,
    root: str,
    sessions: Callable[[], DataFrame],
    questions: Callable[[], DataFrame],
    zone: str,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Start the stream on a prepared store. By default it handles what is there and stops."""
    handle = partial(
        process_batch, root=root, sessions=sessions, questions=questions, zone=zone
    )
    return (
        presses.writeStream.foreachBatch(handle)
        .option("checkpointLocation", f"{root}/checkpoint")
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
