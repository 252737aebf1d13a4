"""Operators put together: from raw submissions to profiles and reports."""

from pyspark.sql import DataFrame, SparkSession

from drillbook.operators.answers import accept_answers, enrich_submissions
from drillbook.operators.assign import expired_daily_sessions
from drillbook.operators.lookups import delete_rows
from drillbook.operators.profiles import rebuild_profiles
from drillbook.operators.reports import leaderboard
from drillbook.operators.streaks import reset_missed_streaks
from drillbook.sources.versions import (
    current_version,
    publish_tables,
    read_version,
    tables_of_version,
)


def profiles_from_submissions(
    submissions: DataFrame,
    sessions: DataFrame,
    questions: DataFrame,
    zone: str,
    resets: list | None = None,
) -> DataFrame:
    enriched = enrich_submissions(submissions, sessions, questions)
    return rebuild_profiles(accept_answers(enriched, zone), resets)


def leaderboard_from_submissions(
    submissions: DataFrame,
    sessions: DataFrame,
    questions: DataFrame,
    zone: str,
    resets: list | None = None,
) -> DataFrame:
    return leaderboard(
        profiles_from_submissions(submissions, sessions, questions, zone, resets)
    )


def close_day(
    profiles: DataFrame, sessions: DataFrame, as_of, now=None
) -> tuple[DataFrame, DataFrame]:
    """The job at local midnight: profiles without missed streaks, and sessions to take down.

    `as_of` is the local date that begins.
    """
    return reset_missed_streaks(profiles, as_of, now), expired_daily_sessions(sessions, as_of)


def replace_rows(
    spark: SparkSession,
    root: str,
    deletions: dict[str, DataFrame | None],
    inserts: dict[str, DataFrame] | None = None,
) -> int:
    """Delete rows with all that hangs on them and insert others, as one published version.

    Reads the tables that foreign keys can reach at the current version and is
    refused if another version is published meanwhile. A deletion that a
    restricting key forbids publishes nothing.
    """
    version = current_version(spark, root)
    tables = {
        name: read_version(spark, root, name, version=version)
        for name in tables_of_version(spark, root, version)
    }
    kept, forbidden = delete_rows(tables, deletions)
    if forbidden is not None:
        some = forbidden.take(5)
        if some:
            raise ValueError(f"still referred to: {[tuple(row) for row in some]}")
    for name, rows in (inserts or {}).items():
        kept[name] = kept.get(name, tables[name]).unionByName(rows)
    return publish_tables(spark, root, kept, base=version)
