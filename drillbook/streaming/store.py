"""What the answer stream keeps, as folders that a record names.

    records/N.json                                         state after N changes
    judged/name=A/accepted=true/session_date=D             the answer log
    judged/name=A/accepted=false/session_date=null         the reject log
    days/name=A/bucket=B                                   totals per user, daily date and day seen
    profiles/name=A/bucket=B                               profiles that a change led to
    base/name=A/bucket=B                                   profiles the store began with
    steps/name=A                                           answers per quiz run
    staged/name=A                                          screened submissions of a batch at work

A is the number of the record that the job wants to put, with a mark of the
attempt. A record lists the folders of every table in order, with the session
dates or user buckets in each, so a reader lists nothing and opens the dates or
buckets it needs. Batches, resets, closed days and compactions are records of
one sequence. What an attempt wrote before it died is never read.

Eight neighbouring folders of one level become one of the next, so a table has
at most seven folders for each power of eight of its changes, and a row is
written anew once per level.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from itertools import groupby

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import (
    BooleanType,
    DateType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
    TimestampType,
)

from drillbook.operators.profiles import PROFILE_COLUMNS, merged_totals
from drillbook.operators.streaks import assign_epoch
from drillbook.schemas import EMPLOYEE_PROFILES, PRESSES, QUESTION_ANSWERS, QUESTION_SESSIONS
from drillbook.sources.records import Folder, Records, RecordTaken

USER = "discord_user_id"
#: Folders of one level that are merged, and records that stay readable.
FAN_IN, KEEP_RECORDS = 8, 24
#: How often a change is made again because another one came first.
ATTEMPTS = 20


def _struct(*fields: tuple) -> StructType:
    return StructType([StructField(name, kind) for name, kind in fields])


LOG = _struct(
    *[(f.name, f.dataType) for f in QUESTION_ANSWERS.fields],
    *[(name, PRESSES[name].dataType) for name in ("global_name", "username")],
    *[
        (name, QUESTION_SESSIONS[name].dataType)
        for name in ("kind", "guild_id", "daily_date", "quiz_run_id")
    ],
    ("verdict", StringType()),
    ("batch_id", LongType()),
)
STEPS = _struct(
    ("id", StringType()), ("steps", LongType()), ("right", LongType()), ("last_at", TimestampType())
)
_MARK = _struct(("answered_at", TimestampType()), ("id", StringType()), ("is_correct", BooleanType()))
DAYS = _struct(
    (USER, StringType()),
    ("daily_date", DateType()),
    ("seen_day", LongType()),
    ("points", LongType()),
    ("latest", _struct(("answered_at", TimestampType()), ("id", StringType()), ("name", StringType()))),
    ("answer_count", LongType()),
    ("first_answer", _MARK),
    ("last_answer", _MARK),
)
_PROFILES = _struct(*[(f.name, f.dataType) for f in EMPLOYEE_PROFILES.fields])
_BUCKET = ("bucket", IntegerType())

#: Per table: its columns, the columns of its folders, and the folder above its parts.
TABLES = {
    "judged": (LOG, (("accepted", BooleanType()), ("session_date", DateType())), "accepted=true/"),
    "steps": (STEPS, (), None),
    "days": (DAYS, (_BUCKET,), ""),
    "profiles": (_PROFILES, (_BUCKET,), ""),
    "base": (_PROFILES, (_BUCKET,), ""),
}


class Store:
    """Reads and changes the store at one root."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.records = Records(spark, f"{self.root}/records")
        self.folder = Folder(spark, self.root)

    def latest(self) -> tuple[int, dict]:
        found = self.records.latest()
        if found is None:
            raise ValueError(f"{self.root} holds no records; prepare the store first")
        return found

    def change(self, make: Callable[[int, dict], dict | None]) -> bool:
        """Put the state that `make` derives from the record number to put and the latest state.

        It is asked again where another change came first; None changes nothing.
        """
        for _ in range(ATTEMPTS):
            number, state = self.latest()
            made = make(number + 1, state)
            if made is None:
                return False
            try:
                self.records.put(number + 1, made)
                return True
            except RecordTaken:
                continue
        raise RecordTaken(f"{ATTEMPTS} other changes came first under {self.root}")

    # Writing -------------------------------------------------------------------

    @staticmethod
    def attempt(number: int) -> str:
        """A folder name for an attempt at record `number`."""
        return f"{number:012d}-{uuid.uuid4().hex[:8]}"

    def path(self, table: str, name: str) -> str:
        return f"{self.root}/{table}/name={name}"

    def write(self, rows: DataFrame, table: str, name: str, level: int = 0) -> list[dict]:
        """Write rows under a fresh name; the entry for the record, none if there were no rows.

        Rows are dealt to files by the columns of the table's folders; a folder
        with many rows gets several files.
        """
        columns, places, above = TABLES[table]
        by = [place for place, _ in places]
        rows = rows.select(*columns.names, *by)
        if by:
            rows = rows.hint("rebalance", *map(F.col, by))
        writer = rows.write.partitionBy(*by) if by else rows.write
        writer.parquet(self.path(table, name))
        below = f"{table}/name={name}"
        if not [item for item in self.folder.names(below) if item[0] not in "._"]:
            return []
        parts = []
        if above is not None:
            prefix = f"{by[-1]}="
            names = self.folder.names(f"{below}/{above}")
            parts = [item[len(prefix) :] for item in names if item.startswith(prefix)]
        return [{"name": name, "level": level, "parts": parts}]

    def with_bucket(self, rows: DataFrame, state: dict) -> DataFrame:
        return rows.withColumn("bucket", F.pmod(F.xxhash64(USER), F.lit(state["buckets"])).cast("int"))

    # Reading -------------------------------------------------------------------

    def read(self, state: dict, table: str, parts: list[str] | None = None) -> DataFrame:
        """A table as of a state, or only the given dates or buckets of it."""
        columns, places, above = TABLES[table]
        schema = _struct(
            *[(f.name, f.dataType) for f in columns.fields], ("name", StringType()), *places
        )
        entries = state["tables"][table]
        if parts is None:
            paths = [self.path(table, entry["name"]) for entry in entries]
        else:
            wanted = set(parts)
            paths = [
                f"{self.path(table, entry['name'])}/{above}{places[-1][0]}={part}"
                for entry in entries
                for part in entry["parts"]
                if part in wanted
            ]
        if not paths:
            # Known to be empty while the query is planned, so joins with it fall away.
            nothing = [F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields]
            return self.spark.range(0).select(*nothing).where(F.lit(False))
        return self.spark.read.schema(schema).option("basePath", f"{self.root}/{table}").parquet(*paths)

    def profiles(self, state: dict, buckets: list[str] | None = None) -> DataFrame:
        """The last state of every profile, or of those in some buckets."""
        base = self.read(state, "base", buckets).withColumn("order", F.lit(-1))
        changed = self.read(state, "profiles", buckets)
        return _latest(base.unionByName(changed.withColumn("order", _order(state, "profiles"))))

    def days(self, state: dict, buckets: list[str] | None = None) -> DataFrame:
        return self.read(state, "days", buckets).select(*DAYS.names)


def _order(state: dict, table: str):
    """The place of a row's folder in the state's list."""
    pairs = [F.lit(x) for i, entry in enumerate(state["tables"][table]) for x in (entry["name"], i)]
    return F.create_map(*pairs)[F.col("name")] if pairs else F.lit(0)


def _latest(rows: DataFrame) -> DataFrame:
    columns = F.struct(*PROFILE_COLUMNS[1:])
    return (
        rows.groupBy(USER).agg(F.max_by(columns, "order").alias("state")).select(USER, "state.*")
    )


def instants(resets: list[int]) -> list:
    return [F.timestamp_micros(F.lit(reset)) for reset in resets]


def merge_days(days: DataFrame, resets: list[int], *by: str) -> DataFrame:
    """Totals per user, epoch, daily date and whatever else `by` names."""
    epochs = assign_epoch(days, instants(resets), "first_answer.answered_at")
    return epochs.groupBy(USER, "epoch", "daily_date", *by).agg(*merged_totals())


def _merged(store: Store, state: dict, table: str, entries: list[dict]) -> DataFrame:
    """The rows of some neighbouring folders as one folder holds them."""
    part = {**state, "tables": {**state["tables"], table: entries}}
    rows = store.read(part, table)
    if table == "steps":
        return rows.groupBy("id").agg(
            F.sum("steps").alias("steps"), F.sum("right").alias("right"), F.max("last_at").alias("last_at")
        )
    if table == "days":
        return store.with_bucket(merge_days(rows, state["resets"], "seen_day"), state)
    if table == "profiles":
        return store.with_bucket(_latest(rows.withColumn("order", _order(part, table))), state)
    return rows


def compact(spark: SparkSession, root: str, fan_in: int | None = None) -> int:
    """Merge folders until no level of any table has `fan_in` of them; returns the merges made.

    A merge is a record like any other: readers see the folders before or after
    it, with the same rows. It may run beside the stream.
    """
    store, merges = Store(spark, root), 0
    fan_in = fan_in or FAN_IN

    def merge(number: int, state: dict) -> dict | None:
        tables, name = dict(state["tables"]), store.attempt(number)
        for table in ("judged", "steps", "days", "profiles"):
            made, found = [], False
            for level, run in groupby(tables[table], lambda entry: entry["level"]):
                run = list(run)
                if len(run) >= fan_in and not found:
                    found = True
                    run = store.write(_merged(store, state, table, run), table, name, level + 1)
                made += run
            tables[table] = made
        changed = tables != state["tables"]
        return {**state, "tables": tables} if changed else None

    while store.change(merge):
        merges += 1
    return merges


def vacuum(spark: SparkSession, root: str, keep: int | None = None) -> int:
    """Forget all but the last `keep` records and delete folders that none of these names.

    Folders of attempts at later records than the oldest one kept stay, as
    their jobs may be at work. Returns the number of folders deleted. A reader
    of an older record than those kept must begin again.
    """
    store = Store(spark, root)
    kept = store.records.forget(keep or KEEP_RECORDS)
    alive = {
        (table, entry["name"])
        for _, state in kept
        for table, entries in state["tables"].items()
        for entry in entries
    }
    deleted = 0
    for table in (*TABLES, "staged"):
        for item in store.folder.names(table):
            name = item.split("=")[1]
            if int(name[:12]) <= kept[0][0] and (table, name) not in alive:
                store.folder.delete(f"{table}/{item}")
                deleted += 1
    return deleted
