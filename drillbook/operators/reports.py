"""Leaderboard, employee stats, activity counts and the texts of questions and cards."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from drillbook.functions import letter

# Report lengths and the bullet of card lists.
LEADERBOARD_SIZE = 10
STATS_SIZE = 25
BULLET = "• "


def _top(profiles: DataFrame, size: int) -> DataFrame:
    return profiles.orderBy(F.desc("total_points"), "discord_user_id").limit(size)


def leaderboard(profiles: DataFrame, size: int = LEADERBOARD_SIZE) -> DataFrame:
    """The users with the most points, ranked, with their line of text.

    Equal points rank by user id. Only the limited rows are numbered.
    """
    order = Window.orderBy(F.desc("total_points"), "discord_user_id")
    # The pieces of a line.
    line = F.concat(
        F.lit("**"),
        F.col("position").cast("string"),
        F.lit(".** "),
        F.col("display_name"),
        F.lit(" — "),
        F.col("total_points").cast("string"),
        F.lit(" points ("),
        F.col("daily_streak").cast("string"),
        F.lit("-day streak)"),
    )
    columns = ["discord_user_id", "display_name", "total_points", "daily_streak"]
    return (
        _top(profiles.select(*columns), size)
        .withColumn("position", F.row_number().over(order))
        .withColumn("line", line)
    )


def report_text(lines: DataFrame, empty: str, order: str = "position") -> DataFrame:
    """One message from the few lines of a limited report, or the text for an empty one."""
    listed = F.array_sort(F.collect_list(F.struct(order, "line")))
    text = F.array_join(F.transform(listed, lambda row: row["line"]), "\n")
    return lines.agg(F.when(F.count("*") == 0, F.lit(empty)).otherwise(text).alias("text"))


def leaderboard_message(profiles: DataFrame) -> DataFrame:
    return report_text(leaderboard(profiles), "No points have been earned yet.")


def employee_stats(profiles: DataFrame, user: str | None = None) -> DataFrame:
    """Points and streaks of the top users, or of one user."""
    if user is not None:
        profiles = profiles.where(F.col("discord_user_id") == user)
    # The pieces of a line.
    line = F.concat(
        F.lit("**"),
        F.col("display_name"),
        F.lit("** — "),
        F.col("total_points").cast("string"),
        F.lit(" points, "),
        F.col("daily_streak").cast("string"),
        F.lit("-day streak"),
    )
    return _top(profiles, 1 if user is not None else STATS_SIZE).withColumn("line", line)


def employee_stats_message(profiles: DataFrame, user: str | None = None) -> DataFrame:
    """The employee stats as one message, or the text for no employees."""
    stats = employee_stats(profiles, user).withColumn(
        "place", F.struct((-F.col("total_points")).alias("points"), "discord_user_id")
    )
    return report_text(stats, "No employee data yet.", "place")


def training_activity(answers: DataFrame) -> DataFrame:
    """Number of submitted answers."""
    return answers.agg(F.count("*").alias("answer_count"))


def training_activity_by_guild(answers: DataFrame, sessions: DataFrame) -> DataFrame:
    """Number of submitted answers per guild.

    Answers are counted per session before they meet the sessions, so a session
    answered by everyone joins as one row.
    """
    counts = answers.groupBy("session_id").agg(F.count("*").alias("_answers"))
    guilds = sessions.select(F.col("id").alias("session_id"), "guild_id")
    return (
        counts.join(guilds, "session_id")
        .groupBy("guild_id")
        .agg(F.sum("_answers").alias("answer_count"))
    )


def question_text(prompt: str = "prompt", options: str = "options") -> Column:
    """A question as shown: the prompt, then one lettered line per choice."""
    # The pieces of the text.
    lines = F.transform(
        F.col(options), lambda option, i: F.concat(F.lit("**"), letter(i), F.lit(".** "), option)
    )
    return F.concat(
        F.col(prompt), F.lit("\n\n"), F.array_join(lines, "\n"), F.lit("\n\nSelect an option below.")
    )


def format_questions(questions: DataFrame) -> DataFrame:
    return questions.select("id", question_text().alias("description"))


def search_cards(cards: DataFrame, topic: str | None = None) -> DataFrame:
    """Enabled cards, optionally those whose topic contains the term in any case.

    `%` and `_` in the term act as wildcards.
    """
    found = cards.where("enabled")
    return found.where(F.col("topic").ilike(f"%{topic}%")) if topic else found


def normalize_card_sections(cards: DataFrame) -> DataFrame:
    """Replace `sections` by the ones to show.

    Sections need both a heading and a content. A card without any shows its
    warning signs and first steps as bullet lists, leaving out an empty list.
    """
    given = F.filter(
        F.coalesce("sections", F.array().cast("array<struct<heading:string,content:string>>")),
        lambda part: F.coalesce(
            (part["heading"] != "") & (part["content"] != ""), F.lit(False)
        ),
    )

    def bullets(heading, items):
        lines = F.transform(F.col(items), lambda item: F.concat(F.lit(BULLET), item))
        return F.struct(
            F.lit(heading).alias("heading"), F.array_join(lines, "\n").alias("content")
        )

    # The headings of the two lists.
    lists = F.filter(
        F.array(bullets("Warning signs", "warning_signs"), bullets("First steps", "first_steps")),
        lambda part: F.coalesce(part["content"] != "", F.lit(False)),
    )
    return cards.withColumn("sections", F.when(F.size(given) > 0, given).otherwise(lists))


def card_search_message(cards: DataFrame, topic: str | None = None) -> DataFrame:
    """The number of cards that match, and the reply where there is none."""
    # Fixed value: the reply to a search without a result.
    text = F.when(F.count("*") == 0, F.lit("No active training cards match that topic."))
    return search_cards(cards, topic).agg(F.count("*").alias("card_count"), text.alias("text"))


def bank_refusals(questions: DataFrame, quiz_size: int = 5) -> DataFrame:
    """The replies to trivia and quiz requests that the active bank is too small for."""
    # The replies to requests that cannot be met.
    active = questions.where("enabled").agg(F.count("*").alias("n"))
    quiz = F.concat(
        F.lit(f"A quiz needs at least {quiz_size} active questions. There are currently "),
        F.col("n").cast("string"),
        F.lit("."),
    )
    refusals = F.array(
        F.struct(F.lit("trivia").alias("kind"), F.lit(1).alias("needs"), F.lit("There are no active questions yet.").alias("text")),
        F.struct(F.lit("quiz").alias("kind"), F.lit(quiz_size).alias("needs"), quiz.alias("text")),
    )
    return active.select("n", F.inline(refusals)).where("n < needs").select("kind", "text")
