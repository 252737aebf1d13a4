"""Bulk jobs on questions, cards and sessions: intake, inserts, patches and notes.

Each returns the new content of its table; `sources.versions` stores it.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from drillbook.functions import names_failed, stable_id

_PATCHABLE = {"prompt": "prompt", "why": "explanation", "topic": "topic"}


def insert_missing(existing: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """The incoming rows whose key is not in the table yet, to be appended.

    Rows that share a new key are all inserted, as is a row without a key. The
    incoming rows are read once.
    """
    held = existing.select(F.col(key).alias("_held")).distinct()
    fresh = incoming.join(held, F.col(key) == F.col("_held"), "left_anti")
    return fresh.select(*incoming.columns)


def seed_if_empty(existing: DataFrame, seed: DataFrame) -> DataFrame:
    """The table, or the seed rows when it has none. One plan, no count on the driver."""
    return existing.unionByName(seed.where(~existing.exists()))


def intake_questions(intake: DataFrame) -> DataFrame:
    """Turn raw intake rows into question columns plus a `reason` for refused ones.

    Choices come as a to e with a one-based key. Two, four or five choices are
    allowed, without gaps, and the key must name one of them.
    """
    given = {name: F.col(name).isNotNull() for name in "abcde"}
    options = F.array_compact(F.array(*[F.col(name) for name in "abcde"]))
    key = F.col("correct") - 1
    required = names_failed(
        {
            "prompt_required": F.col("prompt").isNotNull(),
            "a_required": given["a"],
            "b_required": given["b"],
            "correct_required": F.col("correct").isNotNull(),
            "correct_1_to_5": F.col("correct").between(1, 5),
        }
    )
    gap = (given["c"] != given["d"]) | (given["e"] & ~given["d"])
    reason = (
        F.when(F.size(required) > 0, F.get(required, 0))
        .when(gap, "choice_count")
        .when(key >= F.size(options), "correct_out_of_range")
    )
    return intake.withColumns(
        {
            "reason": reason,
            "options": options,
            "correct_option": key.cast("smallint"),
            "explanation": F.coalesce("why", F.lit("")),
        }
    ).drop("a", "b", "c", "d", "e", "correct", "why")


def accepted_intake(judged: DataFrame) -> DataFrame:
    return judged.where(F.col("reason").isNull()).drop("reason")


def refused_intake(judged: DataFrame) -> DataFrame:
    return judged.where(F.col("reason").isNotNull())


def empty_patches(patches: DataFrame) -> DataFrame:
    """Patches that give no replacement value; they are refused."""
    return patches.where(F.coalesce(*_PATCHABLE).isNull())


def apply_question_patches(
    questions: DataFrame, patches: DataFrame, order: list[str]
) -> DataFrame:
    """Apply partial updates in the given order; a field left out keeps its value.

    Per question and field only the last given value matters, so patches are
    folded before the shuffle. Unknown ids are ignored and updated_at is left
    alone.
    """
    when = F.struct(*order)
    last = patches.groupBy("id").agg(
        *[
            F.max_by(field, F.when(F.col(field).isNotNull(), when)).alias(f"_{field}")
            for field in _PATCHABLE
        ]
    )
    replaced = {
        column: F.coalesce(f"_{field}", column) for field, column in _PATCHABLE.items()
    }
    return (
        questions.join(last, "id", "left")
        .withColumns(replaced)
        .select(*questions.columns)
    )


def disable_questions(questions: DataFrame, ids: DataFrame) -> DataFrame:
    """Disable questions by id; unknown ids are ignored."""
    hits = ids.select("id").distinct().withColumn("_hit", F.lit(True))
    enabled = F.when(F.col("_hit"), False).otherwise(F.col("enabled"))
    return (
        questions.join(hits, "id", "left")
        .withColumn("enabled", enabled)
        .select(*questions.columns)
    )


def mark_posted(sessions: DataFrame, postings: DataFrame) -> DataFrame:
    """Record message and channel of posted sessions from a log of (session_id, posted_at, ...).

    A session posted more than once keeps its last posting.
    """
    last = postings.groupBy(F.col("session_id").alias("id")).agg(
        F.max(F.struct("posted_at", "message_id", "channel_id")).alias("_post")
    )
    return (
        sessions.join(last, "id", "left")
        .withColumns(
            {
                "message_id": F.coalesce("_post.message_id", "message_id"),
                "channel_id": F.coalesce("_post.channel_id", "channel_id"),
            }
        )
        .select(*sessions.columns)
    )


def clear_default_explanations(questions: DataFrame, default: str, now) -> DataFrame:
    """Blank the explanations that equal a default text; others and their clock stay."""
    is_default = F.coalesce(F.col("explanation") == default, F.lit(False))
    return questions.withColumns(
        {
            "updated_at": F.when(is_default, F.lit(now).cast("timestamp")).otherwise(
                F.col("updated_at")
            ),
            "explanation": F.when(is_default, "").otherwise(F.col("explanation")),
        }
    )


def append_card_notes(cards: DataFrame, notes: DataFrame) -> DataFrame:
    """Append to every card the notes of its title as further sections.

    Several notes of one title are all appended, ordered by heading and content.
    """
    note = notes.groupBy("title").agg(
        F.sort_array(F.collect_list(F.struct("heading", "content"))).alias("_notes")
    )
    kept = F.coalesce(
        "sections", F.array().cast("array<struct<heading:string,content:string>>")
    )
    grown = F.when(F.col("_notes").isNotNull(), F.concat(kept, F.col("_notes"))).otherwise(
        F.col("sections")
    )
    return (
        cards.join(note, "title", "left")
        .withColumn("sections", grown)
        .select(*cards.columns)
    )


def question_rows(accepted: DataFrame, now) -> DataFrame:
    """Accepted intake or content rows as stored questions: id, enabled and clocks filled in.

    The id depends on the prompt and options alone, so a second run makes the
    same rows.
    """
    clock = F.lit(now).cast("timestamp")
    return accepted.select(
        stable_id("question", F.col("prompt"), F.array_join("options", "|")).alias("id"),
        "prompt",
        "options",
        F.col("correct_option").cast("smallint").alias("correct_option"),
        F.coalesce("explanation", F.lit("")).alias("explanation"),
        "topic",
        F.lit(True).alias("enabled"),
        clock.alias("created_at"),
        clock.alias("updated_at"),
    )
