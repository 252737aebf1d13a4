"""The registered queries: every operator over the whole driver tables.

Results use plain column types, so that another engine can be compared by
value: whole numbers as BIGINT, timestamps as microseconds, dates and arrays as
text.
"""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import (
    ArrayType,
    DateType,
    IntegralType,
    StringType,
    StructType,
    TimestampType,
)

from drillbook.operators import answers as an
from drillbook.operators import assign, content, lookups, profiles, quizzes, reports, rules, streaks
from drillbook.plans import close_day, leaderboard_from_submissions, replace_rows
from drillbook.schemas import CARD_DROP, QUESTION_DROP, TABLES, TRAINING_CARDS
from drillbook.sources import (
    drop_versions,
    evolve_schema,
    ingest_content,
    load_drop,
    loaded_files,
    loaded_rejects,
    loaded_rows,
    parse_choice_id,
    publish_tables,
    read_content_drop,
    read_submissions,
    read_table,
    read_version,
    replace_table,
    shared_folder,
    tables,
    write_once,
)
from drillbook.streaming import (
    Store,
    answer_log,
    apply_close_day,
    apply_reset,
    current_profiles,
    current_quiz_runs,
    prepare_store,
    run_answer_stream,
    stage_batch,
)
from workload.model import CUT, RESETS, SEED, ZONE, Model, instant

AS_OF = "2024-01-29"
NOW = "2024-02-01 00:00:00Z"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(build: Callable[[Model], DataFrame]):
    """Register a query under the name of its function."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        return plain(build(Model(spark, folder)))

    run.__name__ = build.__name__
    run.__doc__ = build.__doc__
    QUERIES[build.__name__] = run
    return build


def _joined(names: list[str]):
    return lambda part: F.concat_ws("=", *[F.coalesce(part[name], F.lit("~")) for name in names])


def plain(rows: DataFrame) -> DataFrame:
    columns = []
    for field in rows.schema.fields:
        value = F.col(field.name)
        kind = field.dataType
        if isinstance(kind, IntegralType):
            value = value.cast("bigint")
        elif isinstance(kind, TimestampType):
            value = F.unix_micros(value)
        elif isinstance(kind, DateType):
            value = value.cast("string")
        elif isinstance(kind, ArrayType) and isinstance(kind.elementType, StringType):
            value = F.array_join(value, "|", "~")
        elif isinstance(kind, ArrayType) and isinstance(kind.elementType, StructType):
            value = F.array_join(F.transform(value, _joined(kind.elementType.names)), "|")
        columns.append(value.alias(field.name))
    return rows.select(*columns)


def _answer_log(m: Model, *columns: str) -> DataFrame:
    """The accepted answers as a stored table, for queries that read them more than once.

    Only `columns` are stored where they are given.
    """
    accepted = m.accepted()
    return write_once(accepted.select(*columns) if columns else accepted, "answer-log")


_DAYS = ("id", "discord_user_id", "daily_date", "answered_at", "is_correct")
_FOLDED = (*_DAYS, "points_awarded", "global_name", "username")


# Answer pipeline ------------------------------------------------------------


@query
def leaderboard_top10(m: Model) -> DataFrame:
    """The flagship: raw submissions to the ranked top ten."""
    return leaderboard_from_submissions(m.submissions(), m.sessions(), m.questions(), ZONE)


@query
def leaderboard_message(m: Model) -> DataFrame:
    return reports.leaderboard_message(profiles.rebuild_profiles(m.accepted()))


@query
def submission_verdicts(m: Model) -> DataFrame:
    return an.judge_submissions(m.enriched(), ZONE).select("id", "verdict")


@query
def reject_log(m: Model) -> DataFrame:
    judged = an.judge_submissions(m.enriched(), ZONE)
    return an.rejected_submissions(judged).select(
        "id", "session_id", "discord_user_id", "answered_at", "reason"
    )


@query
def rejects_by_reason(m: Model) -> DataFrame:
    rejected = an.rejected_submissions(an.judge_submissions(m.enriched(), ZONE))
    return rejected.groupBy("reason").agg(F.count("*").alias("row_count"))


@query
def submissions_enriched(m: Model) -> DataFrame:
    return m.enriched().select(
        "id", "kind", "guild_id", "question_id", "daily_date", "correct_option"
    )


@query
def answers_scored(m: Model) -> DataFrame:
    return an.answer_rows(m.accepted())


@query
def accepted_answers_scored(m: Model) -> DataFrame:
    """Submissions after the cut against the stored answers from before it."""
    submissions = m.submissions()
    cut = instant(CUT)
    stored = an.accept_answers(m.enriched(submissions.where(F.col("answered_at") < cut)), ZONE)
    later = m.enriched(submissions.where(F.col("answered_at") >= cut))
    return an.answer_rows(an.accept_answers(later, ZONE, an.answer_rows(stored)))


@query
def answer_results(m: Model) -> DataFrame:
    return an.answer_results(streaks.with_streaks(_answer_log(m)))


# Streaks and profiles -------------------------------------------------------


@query
def daily_streaks(m: Model) -> DataFrame:
    return streaks.daily_streaks(_answer_log(m, *_DAYS)).select(
        "id", "discord_user_id", "daily_date", "daily_streak"
    )


@query
def daily_streaks_with_reset(m: Model) -> DataFrame:
    in_epochs = streaks.assign_epoch(_answer_log(m, *_DAYS), RESETS)
    return streaks.daily_streaks(in_epochs).select("id", "epoch", "daily_streak")


def _around_cut(m: Model) -> tuple[DataFrame, DataFrame]:
    accepted = _answer_log(m, *_FOLDED)
    cut = instant(CUT)
    before = accepted.where(F.col("answered_at") < cut)
    return profiles.rebuild_profiles(before), accepted.where(F.col("answered_at") >= cut)


@query
def daily_streaks_incremental(m: Model) -> DataFrame:
    base, later = _around_cut(m)
    return streaks.daily_streaks(later, base).select("id", "daily_streak")


@query
def profiles_rebuilt(m: Model) -> DataFrame:
    return profiles.rebuild_profiles(m.accepted())


@query
def profiles_merged(m: Model) -> DataFrame:
    return profiles.merge_profiles(*_around_cut(m))


@query
def profiles_after_reset(m: Model) -> DataFrame:
    return profiles.rebuild_profiles(m.accepted(), RESETS)


@query
def profiles_on_snapshot(m: Model) -> DataFrame:
    """A snapshot as of the cut, then the rest of the log with a reset in it."""
    base, later = _around_cut(m)
    return profiles.rebuild_profiles(later, ["2024-01-25 06:00:00Z"], base)


@query
def scores_reset(m: Model) -> DataFrame:
    return profiles.reset_scores(profiles.rebuild_profiles(m.accepted()), NOW)


@query
def missed_streak_reset(m: Model) -> DataFrame:
    return streaks.reset_missed_streaks(profiles.rebuild_profiles(m.accepted()), AS_OF, NOW)


@query
def quiz_progress(m: Model) -> DataFrame:
    return quizzes.quiz_progress(m.quiz_runs(), m.accepted())


@query
def quiz_results(m: Model) -> DataFrame:
    return quizzes.quiz_results(quizzes.quiz_progress(m.quiz_runs(), m.accepted()))


@query
def next_quiz_questions(m: Model) -> DataFrame:
    progress = quizzes.quiz_progress(m.quiz_runs(), m.accepted())
    return quizzes.next_quiz_questions(progress, m.questions())


# Reports --------------------------------------------------------------------


@query
def employee_stats_top25(m: Model) -> DataFrame:
    return reports.employee_stats(profiles.rebuild_profiles(m.accepted()))


@query
def employee_stats_one(m: Model) -> DataFrame:
    """Stats of one user: the filter stands below the judging, which has nothing across users."""
    own = m.enriched(m.submissions().where("discord_user_id = '7'"))
    return reports.employee_stats(profiles.rebuild_profiles(an.accept_answers(own, ZONE)), "7")


@query
def employee_stats_message(m: Model) -> DataFrame:
    return reports.employee_stats_message(profiles.rebuild_profiles(m.accepted()))


@query
def report_refusals(m: Model) -> DataFrame:
    """Replies where nothing fits: no such card, a bank without enough active questions."""
    none = reports.card_search_message(m.cards(), "no such topic").select(
        F.lit("cards").alias("kind"), "text"
    )
    short = reports.bank_refusals(m.questions().where("prompt IS NULL"))
    enough = reports.bank_refusals(m.questions(), 1)
    return none.unionByName(short).unionByName(enough)


@query
def training_activity_total(m: Model) -> DataFrame:
    return reports.training_activity(m.accepted())


@query
def training_activity_by_guild(m: Model) -> DataFrame:
    return reports.training_activity_by_guild(an.answer_rows(m.accepted()), m.sessions())


@query
def question_listing(m: Model) -> DataFrame:
    return reports.format_questions(m.questions())


@query
def cards_by_topic(m: Model) -> DataFrame:
    return reports.search_cards(m.cards(), "RC1").select("id", "topic", "title", "body")


@query
def card_sections(m: Model) -> DataFrame:
    cards = reports.search_cards(m.cards())
    return reports.normalize_card_sections(cards).select("id", "title", "sections")


# Question bank and assignment ------------------------------------------------


@query
def active_questions(m: Model) -> DataFrame:
    return tables.active_questions(m.questions()).select(
        "id", "prompt", "options", "correct_option", "explanation", "topic"
    )


@query
def card_picked(m: Model) -> DataFrame:
    """A random enabled card for every request."""
    cards = reports.search_cards(m.cards()).select("id", "title")
    requests = m.requests().select("request_id")
    return assign.pick_one(requests, cards, f"card:{SEED}", "request_id")


@query
def trivia_assigned(m: Model) -> DataFrame:
    return assign.assign_trivia(m.requests(), m.questions(), SEED).drop(
        "expires_at", "message_id", "daily_date", "quiz_run_id"
    )


@query
def quiz_assigned(m: Model) -> DataFrame:
    return assign.assign_quizzes(m.requests(), m.questions(), SEED).drop("completed_at")


@query
def quiz_sessions_opened(m: Model) -> DataFrame:
    """The first session of every assigned quiz."""
    requests = m.requests()
    runs = assign.assign_quizzes(requests, m.questions(), SEED)
    channels = requests.select(
        assign.stable_id("quiz", F.col("request_id")).alias("quiz_run_id"), "channel_id"
    )
    return assign.quiz_sessions(runs, channels).select(
        "id", "question_id", "kind", "guild_id", "channel_id", "owner_discord_user_id", "quiz_run_id"
    )


@query
def daily_assigned(m: Model) -> DataFrame:
    return assign.assign_daily(m.calendar(), m.saved_dailies(), m.questions(), SEED)


@query
def daily_sessions_created(m: Model) -> DataFrame:
    assigned = assign.assign_daily(m.calendar(), m.saved_dailies(), m.questions(), SEED)
    return assign.daily_session_rows(assigned, "C-daily", NOW).select(
        "id", "question_id", "kind", "guild_id", "channel_id", "daily_date", "created_at"
    )


@query
def expired_daily(m: Model) -> DataFrame:
    return assign.expired_daily_sessions(m.sessions(), AS_OF).select(
        "id", "guild_id", "channel_id", "message_id", "daily_date"
    )


# Content jobs ----------------------------------------------------------------


@query
def questions_inserted_missing(m: Model) -> DataFrame:
    stored, incoming = m.bank_halves()
    return content.insert_missing(stored, incoming, "prompt")


@query
def questions_seeded_if_empty(m: Model) -> DataFrame:
    """Seeding a full table changes nothing; seeding an emptied one takes the seed."""
    stored, incoming = m.bank_halves()
    emptied = stored.where(F.col("topic").isNull())
    full = content.seed_if_empty(stored, incoming).withColumn("start", F.lit("full"))
    empty = content.seed_if_empty(emptied, incoming).withColumn("start", F.lit("empty"))
    return full.unionByName(empty)


@query
def question_intake(m: Model) -> DataFrame:
    return content.intake_questions(m.intake())


@query
def questions_patched(m: Model) -> DataFrame:
    patched = content.apply_question_patches(m.questions(), m.patches(), ["ts", "patch_id"])
    return patched.select("id", "prompt", "explanation", "topic", "updated_at")


@query
def patches_refused(m: Model) -> DataFrame:
    return content.empty_patches(m.patches()).select("id", "patch_id")


@query
def questions_disabled(m: Model) -> DataFrame:
    ids = m.table("orders").where("o_orderstatus = 'F'").select(
        (F.col("o_custkey") * 2).cast("string").alias("id")
    )
    return content.disable_questions(m.questions(), ids).select("id", "enabled")


@query
def sessions_marked_posted(m: Model) -> DataFrame:
    return content.mark_posted(m.sessions(), m.postings()).select("id", "message_id", "channel_id")


@query
def explanations_cleared(m: Model) -> DataFrame:
    return content.clear_default_explanations(m.questions(), "Brand#2", NOW).select(
        "id", "explanation", "updated_at"
    )


@query
def cards_evolved(m: Model) -> DataFrame:
    """Cards from before the sections column, brought to the present schema."""
    older = m.cards().drop("sections")
    empty = F.array().cast("array<struct<heading:string,content:string>>")
    return evolve_schema(older, TRAINING_CARDS, {"sections": empty}).select(
        "id", "topic", "title", "body", F.size("sections").alias("section_count"), "enabled"
    )


@query
def card_notes_appended(m: Model) -> DataFrame:
    return content.append_card_notes(m.cards(), m.card_notes()).select("id", "sections")


@query
def table_replaced(m: Model) -> DataFrame:
    """Publish the stored half of the bank, then replace all of it by the incoming half."""
    stored, incoming = m.bank_halves()
    root = shared_folder(m.spark, "bank")
    publish_tables(m.spark, root, {"questions": stored})
    return replace_table(m.spark, root, "questions", incoming)


@query
def content_drop(m: Model) -> DataFrame:
    """The bank written as a JSON content drop and read back with its schema."""
    path = shared_folder(m.spark, "content-drop")
    m.questions().select(*QUESTION_DROP.names).write.json(path)
    return read_content_drop(m.spark, path, QUESTION_DROP)


@query
def content_drop_rejects(m: Model) -> DataFrame:
    """A content drop with lines that do not parse: the good rows are counted, the others kept."""
    number = F.col("id").cast("bigint")
    line = F.to_json(F.struct(*QUESTION_DROP.names))
    spoilt = (
        F.when(number % 10 == 0, F.concat(F.lit("{"), line))
        .when(number % 10 == 1, F.regexp_replace(line, r'"options":\[[^\]]*\]', '"options":"none"'))
        .when(number % 10 == 2, F.regexp_replace(line, r'"correct_option":\d+', '"correct_option":"x"'))
        .otherwise(line)
    )
    path = shared_folder(m.spark, "spoilt-drop")
    m.questions().select(spoilt.alias("value")).write.text(path)
    good, refused = ingest_content(m.spark, path, QUESTION_DROP)
    kept = content.question_rows(good, NOW).groupBy(F.lit("stored").alias("reason"), "enabled").agg(
        F.count("*").alias("row_count"), F.sum("correct_option").alias("key_sum")
    )
    bad = refused.groupBy("reason", F.lit(False).alias("enabled")).agg(
        F.count("*").alias("row_count"), F.lit(None).cast("bigint").alias("key_sum")
    )
    return kept.unionByName(bad)


@query
def question_intake_stored(m: Model) -> DataFrame:
    """Accepted intake rows as they are stored, with defaults."""
    accepted = content.accepted_intake(content.intake_questions(m.intake()))
    return content.question_rows(accepted, NOW)


@query
def questions_replaced_whole(m: Model) -> DataFrame:
    """The question script as a whole: answers, sessions and runs go, the bank is new, profiles stay."""
    root = shared_folder(m.spark, "whole-bank")
    answers = an.answer_rows(m.accepted())
    profile = profiles.rebuild_profiles(m.accepted())
    tables_ = {
        "questions": m.questions(),
        "question_sessions": m.sessions(),
        "question_answers": answers,
        "quiz_runs": m.quiz_runs(),
        "employee_profiles": profile,
    }
    publish_tables(m.spark, root, tables_)
    _, incoming = m.bank_halves()
    gone = dict.fromkeys(["question_answers", "question_sessions", "quiz_runs", "questions"])
    replace_rows(m.spark, root, gone, {"questions": incoming})
    counts = None
    for name in tables_:
        rows = read_version(m.spark, root, name)
        key = "discord_user_id" if name == "employee_profiles" else "id"
        one = rows.agg(F.count("*").alias("row_count"), F.max(key).alias("last_key"))
        one = one.select(F.lit(name).alias("table_name"), "row_count", "last_key")
        counts = one if counts is None else counts.unionByName(one)
    return counts


@query
def runs_deleted_with_children(m: Model) -> DataFrame:
    """Quiz runs from after the cut deleted along the foreign keys: what is left of each table."""
    root = shared_folder(m.spark, "key-graph")
    tables_ = {
        "questions": m.questions(),
        "question_sessions": m.sessions(),
        "question_answers": an.answer_rows(m.accepted()),
        "quiz_runs": m.quiz_runs(),
    }
    publish_tables(m.spark, root, tables_)
    late = m.quiz_runs().where(F.col("created_at") >= instant(CUT)).select("id")
    replace_rows(m.spark, root, {"quiz_runs": late})
    counts = None
    for name in tables_:
        rows = read_version(m.spark, root, name)
        one = rows.agg(F.count("*").alias("row_count"), F.max("id").alias("last_key"))
        one = one.select(F.lit(name).alias("table_name"), "row_count", "last_key")
        counts = one if counts is None else counts.unionByName(one)
    return counts


@query
def versions_pinned(m: Model) -> DataFrame:
    """Three versions of the bank with the oldest dropped: the last two as they were read."""
    root = shared_folder(m.spark, "pinned")
    stored, incoming = m.bank_halves()
    for number, rows in enumerate((stored, incoming, m.questions())):
        publish_tables(m.spark, root, {"questions": rows}, base=number)
    drop_versions(m.spark, root, keep=2)
    read = None
    for version in (2, 3):
        one = read_version(m.spark, root, "questions", version=version)
        one = one.select(F.lit(version).alias("version"), "id", "prompt")
        read = one if read is None else read.unionByName(one)
    return read


@query
def drop_loaded_twice(m: Model) -> DataFrame:
    """A content drop loaded, grown and loaded again twice: every line once, rejects too."""
    path, root = shared_folder(m.spark, "growing-drop"), shared_folder(m.spark, "loads")
    number = F.col("id").cast("bigint")
    line = F.to_json(F.struct(*QUESTION_DROP.names))
    spoilt = F.when(number % 10 == 0, F.concat(F.lit("{"), line)).otherwise(line)
    for half in (number % 2 == 0, number % 2 == 1):
        m.questions().where(half).select(spoilt.alias("value")).write.mode("append").text(path)
        for _ in range(2):
            load_drop(m.spark, root, path, QUESTION_DROP)
    good = loaded_rows(m.spark, root, QUESTION_DROP).select(F.lit("stored").alias("reason"), "prompt")
    bad = loaded_rejects(m.spark, root)
    prompt = F.get_json_object(F.substring("line", 2, 1_000_000), "$.prompt")
    rows = good.unionByName(bad.select("reason", prompt.alias("prompt")))
    again = F.lit(loaded_files(m.spark, root).groupBy("file", "digest").count().where("count > 1").count())
    return rows.withColumn("repeated_files", again)


@query
def typed_scan(m: Model) -> DataFrame:
    """The six tables written and scanned again with their declared schemas."""
    root = shared_folder(m.spark, "typed")
    made = {
        "questions": m.questions(),
        "training_cards": m.cards(),
        "question_sessions": m.sessions(),
        "question_answers": an.answer_rows(m.accepted()),
        "employee_profiles": profiles.rebuild_profiles(m.accepted()),
        "quiz_runs": m.quiz_runs(),
    }
    counts = None
    for name, rows in made.items():
        rows.write.parquet(f"{root}/{name}")
        scanned = read_table(m.spark, name, f"{root}/{name}")
        key = "discord_user_id" if name == "employee_profiles" else "id"
        one = scanned.agg(
            F.lit(name).alias("table_name"),
            F.count("*").alias("row_count"),
            F.countDistinct(key).alias("key_count"),
            F.lit(len(TABLES[name])).alias("column_count"),
        )
        counts = one if counts is None else counts.unionByName(one)
    return counts


@query
def card_drop(m: Model) -> DataFrame:
    path = shared_folder(m.spark, "card-drop")
    m.cards().select(*CARD_DROP.names).write.json(path)
    return read_content_drop(m.spark, path, CARD_DROP)


@query
def cards_replaced_with_notes(m: Model) -> DataFrame:
    """The content script as a whole: drop all cards, insert new ones, append the notes."""
    root = shared_folder(m.spark, "cards")
    publish_tables(m.spark, root, {"training_cards": m.cards()})
    publish_tables(
        m.spark, root, {"training_cards": content.append_card_notes(m.cards(), m.card_notes())}
    )
    return read_version(m.spark, root, "training_cards", TRAINING_CARDS).select(
        "id", "title", "sections"
    )


# Rules and contracts -----------------------------------------------------------


def _kept_sessions(m: Model) -> DataFrame:
    kept_runs = m.quiz_runs().where(F.col("created_at") < instant(CUT))
    return lookups.cascade_delete(m.sessions(), kept_runs, "quiz_run_id")


@query
def cascade_kept_sessions(m: Model) -> DataFrame:
    """Sessions left when the quiz runs from after the cut are deleted."""
    return _kept_sessions(m).select("id", "kind", "quiz_run_id")


@query
def cascade_kept_answers(m: Model) -> DataFrame:
    answers = an.answer_rows(m.accepted())
    return lookups.cascade_delete(answers, _kept_sessions(m), "session_id").select(
        "id", "session_id"
    )


@query
def restricted_questions(m: Model) -> DataFrame:
    """Disabled questions that sessions still use, so that they cannot be deleted."""
    deletions = m.questions().where("not enabled").select("id", "prompt")
    return lookups.restrict_violations(deletions, m.sessions(), "question_id")


@query
def row_rule_violations(m: Model) -> DataFrame:
    """The rules of all six tables over rows with faults."""
    number = F.col("id").cast("bigint")
    questions = m.questions().withColumns(
        {
            "options": F.slice("options", 1, (number % 6).cast("int")),
            "prompt": F.when(number % 11 != 0, F.col("prompt")),
        }
    )
    foreign = F.coalesce(F.col("owner_discord_user_id").endswith("x"), F.lit(False))
    sessions = m.sessions().withColumn(
        "kind", F.when(foreign, "survey").otherwise(F.col("kind"))
    )
    answers = m.events().select(
        F.col("event_id").cast("string").alias("id"),
        "session_id",
        F.when(F.col("k") != 50, F.col("discord_user_id")).alias("discord_user_id"),
        (F.col("k") % 7 - 1).alias("selected_option"),
        (F.col("k") < 60).alias("is_correct"),
        (F.col("k") - 5).alias("points_awarded"),
        "answered_at",
    )
    profile = m.table("customer").select(
        F.col("c_custkey").cast("string").alias("discord_user_id"),
        F.col("c_name").alias("display_name"),
        F.floor("c_acctbal").alias("total_points"),
        (F.col("c_nationkey") - 3).alias("daily_streak"),
        instant(CUT).alias("updated_at"),
    )
    doc = F.col("id").cast("bigint")
    cards = m.cards().withColumns(
        {
            "title": F.when(doc % 13 != 0, F.col("title")),
            "warning_signs": F.when(doc % 17 != 0, F.col("warning_signs")),
        }
    )
    runs = m.quiz_runs().withColumn(
        "guild_id", F.when(~F.col("discord_user_id").endswith("3"), F.col("guild_id"))
    )
    reports_ = []
    for name, rows, key in (
        ("questions", questions, "id"),
        ("training_cards", cards, "id"),
        ("quiz_runs", runs, "id"),
        ("question_sessions", sessions, "id"),
        ("question_answers", answers, "id"),
        ("employee_profiles", profile, "discord_user_id"),
    ):
        broken = rules.rejected_rows(rules.validate_rows(rows, rules.table_rules(name)))
        # A faulty profile has no null key, so the key identifies the row.
        reports_.append(
            broken.select(F.lit(name).alias("table_name"), F.col(key).alias("row_key"), "violations")
        )
    first, *others = reports_
    for one in others:
        first = first.unionByName(one)
    return first


@query
def unique_violations(m: Model) -> DataFrame:
    """Repeated keys of all six tables, with presses as answers and every press's session."""
    presses = m.submissions()
    opened = m.events().select(F.col("session_id").alias("id"), "guild_id", "daily_date")
    made = {
        "questions": m.questions().unionByName(m.questions().where("not enabled")),
        "training_cards": m.cards(),
        "question_sessions": opened,
        "question_answers": presses,
        "employee_profiles": presses,
        "quiz_runs": m.events().select(F.col("quiz_run_id").alias("id")),
    }
    found = None
    for name, rows in made.items():
        one = rules.key_violations(name, rows)
        found = one if found is None else found.unionByName(one)
    return found


@query
def lookup_violations(m: Model) -> DataFrame:
    """Event ids looked up as questions: absent ones, and prompts that are not unique."""
    wanted = m.events().select((F.col("event_id") * 7).cast("string").alias("question_id"))
    by_id = lookups.lookup_violations(wanted, m.questions(), "question_id")
    prompts = m.questions().select("prompt")
    by_prompt = lookups.lookup_violations(prompts, prompts, "prompt", "prompt")
    return by_id.unionByName(by_prompt)


@query
def lookup_repeated_keys(m: Model) -> DataFrame:
    """Every press with its question, where every fifth question stands twice: it matches none."""
    bank = m.questions().select("id", "topic")
    twice = bank.unionByName(bank.where(F.col("id").cast("bigint") % 5 == 0))
    asked = m.events().select("event_id", F.col("question_number").cast("string").alias("question_id"))
    return lookups.lookup_join(asked, twice, "question_id", optional=True).select("event_id", "topic")


@query
def optional_lookup(m: Model) -> DataFrame:
    """Profiles of all event users, where one exists for the name they have now."""
    named = m.submissions().select("id", "username")
    holders = m.table("customer").select(
        F.concat(F.lit("user"), (F.col("c_custkey") * 2).cast("string")).alias("holder"),
        "c_mktsegment",
    )
    return lookups.lookup_join(named, holders, "username", "holder", optional=True)


# Streaming -----------------------------------------------------------------------


@query
def choice_ids_parsed(m: Model) -> DataFrame:
    """Button ids back into session and choice, with other buttons and faulty choices."""
    suffix = F.when(F.col("answered_at") < instant(CUT), "").otherwise("x")
    faulty = m.presses().withColumn("custom_id", F.concat("custom_id", suffix))
    other = m.presses().withColumn("custom_id", F.lit("menu:trivia"))
    return parse_choice_id(faulty.unionByName(other)).select("id", "session_id", "selected_option")


def _stream_answers(m: Model, presses=None, sessions=None, parts=None, between=None) -> str:
    """Drop the presses in parts and run the stream after each; the parts are by time by default.

    Every batch reads the stored table of sessions anew, as a running stream does.
    """
    root = shared_folder(m.spark, "answers")
    inbox = f"{root}/inbox"
    prepare_store(m.spark, root)
    rows = m.presses() if presses is None else presses
    at = F.col("answered_at")
    reset, cut = instant(RESETS[0]), instant(CUT)
    for number, part in enumerate(parts or [at < reset, (at >= reset) & (at < cut), at >= cut]):
        rows.where(part).write.mode("append").parquet(inbox)
        stream = read_submissions(m.spark, inbox)
        run_answer_stream(
            stream, root, sessions or m.saved_sessions, m.questions, ZONE
        ).awaitTermination()
        if between:
            between(root, number)
    return root


@query
def answer_stream(m: Model) -> DataFrame:
    log = answer_log(m.spark, _stream_answers(m))
    return log.select("id", "verdict", "is_correct", "points_awarded")


@query
def answer_stream_profiles(m: Model) -> DataFrame:
    return current_profiles(m.spark, _stream_answers(m))


@query
def stream_profiles_after_reset(m: Model) -> DataFrame:
    """Scores reset in the store between the first and the second part."""

    def reset(root: str, part: int) -> None:
        if part == 0:
            apply_reset(m.spark, root, RESETS[0])

    return current_profiles(m.spark, _stream_answers(m, between=reset))


@query
def stream_after_crash(m: Model) -> DataFrame:
    """The second part's batch dies before its record and a day is closed; then it comes again."""
    at = F.col("answered_at")

    def crash(root: str, part: int) -> None:
        if part == 0:
            lost = m.presses().where((at >= instant(RESETS[0])) & (at < instant(CUT)))
            store = Store(m.spark, root)
            number, state = store.latest()
            stage_batch(store, number + 1, state, lost, 1, m.saved_sessions(), m.questions(), ZONE)
            apply_close_day(m.spark, root, m.saved_sessions(), "2024-01-16")

    return current_profiles(m.spark, _stream_answers(m, between=crash))


@query
def stream_profiles_any_order(m: Model) -> DataFrame:
    """Presses dealt by id over three batches, and a reset whose earlier answers come after it."""
    number = F.col("id").cast("bigint")

    def reset(root: str, part: int) -> None:
        if part == 0:
            apply_reset(m.spark, root, RESETS[0])

    parts = [number % 3 == part for part in range(3)]
    return current_profiles(m.spark, _stream_answers(m, parts=parts, between=reset))


@query
def stream_quiz_progress(m: Model) -> DataFrame:
    return current_quiz_runs(m.spark, _stream_answers(m), m.quiz_runs())


@query
def stream_next_questions(m: Model) -> DataFrame:
    runs = current_quiz_runs(m.spark, _stream_answers(m), m.quiz_runs())
    return quizzes.next_quiz_questions(runs, m.questions())


@query
def stream_day_close(m: Model) -> DataFrame:
    """The midnight job on the streamed profiles, written back to the store."""
    root = _stream_answers(m)
    expired = apply_close_day(m.spark, root, m.saved_sessions(), AS_OF, NOW)
    return current_profiles(m.spark, root).select(
        F.col("discord_user_id").alias("key"), F.col("daily_streak").cast("string").alias("value")
    ).unionByName(expired.select(F.col("id").alias("key"), F.col("message_id").alias("value")))


def _twice(rows: DataFrame) -> DataFrame:
    """Every row twice, from one reading."""
    return rows.withColumn("_copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("_copy")


@query
def redelivered_presses(m: Model) -> DataFrame:
    """Every press twice, in one batch and through the stream: one answer each, no double points."""
    enriched = an.enrich_submissions(_twice(m.submissions()), m.saved_sessions(), m.questions())
    judged = an.judge_submissions(enriched.drop("options", "explanation"), ZONE)
    batch = an.score_answers(judged)
    log = answer_log(m.spark, _stream_answers(m, _twice(m.presses())))
    columns = ["id", "verdict", "points_awarded"]
    return batch.select(F.lit("batch").alias("path"), *columns).unionByName(
        log.select(F.lit("stream").alias("path"), *columns)
    )


@query
def late_clock_answers(m: Model) -> DataFrame:
    """Sessions whose clock is a day ahead of the answers: earlier answers still count as given."""
    ahead = F.col("created_at") + F.expr("INTERVAL 1 DAY")
    root = _stream_answers(m, sessions=lambda: m.saved_sessions().withColumn("created_at", ahead))
    return answer_log(m.spark, root).select("id", "verdict", "points_awarded")


@query
def answer_stream_dedup(m: Model) -> DataFrame:
    """Daily answers kept across batches that come out of time order: the first to arrive counts."""
    number = F.col("id").cast("bigint")
    log = answer_log(m.spark, _stream_answers(m, parts=[number % 3 == part for part in range(3)]))
    return log.where("accepted and kind = 'daily'").select(
        "id", "session_id", "discord_user_id", "selected_option", "points_awarded", "answered_at"
    )
