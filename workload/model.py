"""The driver's tables mapped to the model (see FIXTURES.md). Everything derives from whole tables."""

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from drillbook.functions import local_date
from drillbook.operators.answers import accept_answers, enrich_submissions
from drillbook.sources import read_table, shared_folder

ZONE = "America/Chicago"
RESETS = ["2024-01-15 06:00:00Z"]
CUT = "2024-01-20 06:00:00Z"
CREATED = "2023-12-01 00:00:00Z"
SEED = "7"


def instant(text: str):
    return F.lit(text).cast("timestamp")


class Model:
    """Model tables over one folder of driver tables."""

    def __init__(self, spark: SparkSession, folder: str):
        # Driver timestamps have no zone and mean UTC.
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        if not spark.conf.get("spark.checkpoint.dir", None):
            # A trial on one machine; a cluster names its shared folder itself.
            if not re.match(r"local(\[|$)", spark.sparkContext.master):
                raise ValueError("set spark.checkpoint.dir to a folder shared by the cluster")
            spark.conf.set("spark.checkpoint.dir", f"{tempfile.gettempdir()}/drillbook-scratch")
        self.spark = spark
        self.folder = folder
        self._tables: dict[str, DataFrame] = {}
        self._events: DataFrame | None = None
        self._sessions: str | None = None

    def table(self, name: str) -> DataFrame:
        """A driver table; its footer is read once per model."""
        if name not in self._tables:
            self._tables[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return self._tables[name]

    # Question bank ---------------------------------------------------------

    @staticmethod
    def choice_count(number):
        return F.when(number % 3 == 0, 2).when(number % 3 == 1, 4).otherwise(5)

    @classmethod
    def key_of(cls, number):
        return F.floor(number / 3) % cls.choice_count(number)

    def questions(self) -> DataFrame:
        number = F.col("p_partkey")
        choices = F.transform(
            F.sequence(F.lit(0), self.choice_count(number) - 1),
            lambda i: F.concat(F.lit("opt-"), i.cast("string")),
        )
        return self.table("part").select(
            number.cast("string").alias("id"),
            F.col("p_name").alias("prompt"),
            choices.alias("options"),
            self.key_of(number).cast("smallint").alias("correct_option"),
            F.when(number % 4 == 0, "").otherwise(F.col("p_brand")).alias("explanation"),
            F.col("p_type").alias("topic"),
            (F.col("p_size") > 5).alias("enabled"),
            instant(CREATED).alias("created_at"),
            instant(CREATED).alias("updated_at"),
        )

    def bank_size(self):
        return self.table("part").agg(F.count("*")).scalar()

    # Sessions and submissions ----------------------------------------------

    def events(self) -> DataFrame:
        """Every event as a press, with the facts of its session."""
        if self._events is None:
            self._events = self._build_events()
        return self._events

    def _build_events(self) -> DataFrame:
        pressed = self.table("events").selectExpr(
            "event_id",
            "cast(ts AS timestamp) AS answered_at",
            "cast(user_id AS string) AS discord_user_id",
            "user_id",
            "event_type",
            "cast(get_json_object(props, '$.k') AS int) AS k",
            "CASE event_type WHEN 'purchase' THEN 'quiz' WHEN 'error' THEN 'trivia' "
            "ELSE 'daily' END AS kind",
            "concat('G-', event_type) AS guild_id",
        )
        dated = pressed.withColumn("local_date", local_date(F.col("answered_at"), ZONE)).selectExpr(
            "*",
            "CASE WHEN kind = 'daily' THEN "
            "date_sub(local_date, if(k % 10 = 0, 1, 0)) END AS daily_date",
            "cast(floor((dayofmonth(local_date) - 1) / 7) AS bigint) AS block",
        )
        return dated.withColumn("_n", self.bank_size()).selectExpr(
            "* EXCEPT (_n)",
            "CASE WHEN kind = 'daily' THEN concat('D-', guild_id, '-', cast(daily_date AS string)) "
            "ELSE concat('S-', cast(event_id AS string)) END AS session_id",
            "CASE WHEN kind = 'trivia' AND k % 7 = 0 THEN concat(discord_user_id, 'x') "
            "WHEN kind <> 'daily' THEN discord_user_id END AS owner_discord_user_id",
            "CASE WHEN kind = 'daily' THEN datediff(daily_date, DATE '2023-12-01') * 7L "
            "ELSE event_id * 7 END % _n AS question_number",
            "CASE WHEN kind = 'quiz' "
            "THEN concat('R-', discord_user_id, '-', cast(block AS string)) END AS quiz_run_id",
        )

    def submissions(self) -> DataFrame:
        number = F.col("question_number")
        choice = (
            F.when(F.col("k") == 99, 7)
            .when(F.col("k") < 60, self.key_of(number))
            .otherwise(F.col("k") % self.choice_count(number))
        )
        user = F.col("discord_user_id")
        return self.events().select(
            F.col("event_id").cast("string").alias("id"),
            F.when(F.col("k") == 98, F.concat(F.lit("X-"), F.col("event_id").cast("string")))
            .otherwise(F.col("session_id"))
            .alias("session_id"),
            "discord_user_id",
            F.when(F.col("user_id") % 3 != 0, F.concat_ws("-", F.lit("Name"), user, "event_type"))
            .alias("global_name"),
            F.concat(F.lit("user"), user).alias("username"),
            choice.cast("smallint").alias("selected_option"),
            "answered_at",
        )

    def presses(self) -> DataFrame:
        """Submissions as button presses."""
        custom_id = F.concat_ws(
            ":", F.lit("answer"), "session_id", F.col("selected_option").cast("string")
        )
        return self.submissions().select(
            "id",
            custom_id.alias("custom_id"),
            "discord_user_id",
            "global_name",
            "username",
            "answered_at",
        )

    def sessions(self) -> DataFrame:
        events = self.events()
        # All of these follow from guild and date, so the rows are distinct map-side, unsorted.
        follows = ["guild_id", "daily_date", "session_id", "question_number", "event_type"]
        daily = events.where("kind = 'daily'").select(*follows).distinct()
        none = F.lit(None).cast("string")
        # A daily session opens at local midnight, in January 06:00 UTC.
        opened = daily.withColumns(
            {
                "created_at": F.col("daily_date").cast("timestamp") + F.expr("INTERVAL 6 HOURS"),
                "kind": F.lit("daily"),
                "owner_discord_user_id": none,
                "local_date": F.col("daily_date"),
                "quiz_run_id": none,
            }
        )
        owned = events.where("kind <> 'daily'").withColumn(
            "created_at", F.col("answered_at") - F.expr("INTERVAL 1 MINUTE")
        )
        posted = F.when(
            F.dayofmonth(F.coalesce("daily_date", "local_date")) % 5 != 0,
            F.concat(F.lit("M-"), "session_id"),
        )
        return opened.unionByName(owned.select(*opened.columns)).select(
            F.col("session_id").alias("id"),
            F.col("question_number").cast("string").alias("question_id"),
            "kind",
            "guild_id",
            F.concat(F.lit("C-"), "event_type").alias("channel_id"),
            posted.alias("message_id"),
            "owner_discord_user_id",
            "daily_date",
            F.lit(None).cast("timestamp").alias("expires_at"),
            "created_at",
            "quiz_run_id",
        )

    def saved_sessions(self) -> DataFrame:
        """The sessions as a stored table, written once per model, for queries that read it often."""
        if self._sessions is None:
            path = shared_folder(self.spark, "sessions")
            self.sessions().write.parquet(path)
            self._sessions = path
        return read_table(self.spark, "question_sessions", self._sessions)

    def quiz_runs(self) -> DataFrame:
        runs = (
            self.events()
            .where("kind = 'quiz'")
            .groupBy("quiz_run_id", "discord_user_id", "user_id", "block", "guild_id")
            .agg(F.min("answered_at").alias("first_at"))
            .withColumn("_n", self.bank_size())
        )
        slots = F.transform(
            F.sequence(F.lit(0), F.lit(4)),
            lambda slot: (
                (F.col("user_id") * 13 + F.col("block") * 31 + slot) % F.col("_n")
            ).cast("string"),
        )
        return runs.select(
            F.col("quiz_run_id").alias("id"),
            "discord_user_id",
            "guild_id",
            slots.alias("question_ids"),
            F.lit(0).alias("current_index"),
            F.lit(0).alias("correct_count"),
            F.lit(None).cast("timestamp").alias("completed_at"),
            (F.col("first_at") - F.expr("INTERVAL 1 MINUTE")).alias("created_at"),
        )

    # Answers ---------------------------------------------------------------

    def enriched(self, submissions: DataFrame | None = None) -> DataFrame:
        rows = self.submissions() if submissions is None else submissions
        return enrich_submissions(rows, self.sessions(), self.questions())

    def accepted(self) -> DataFrame:
        return accept_answers(self.enriched(), ZONE)

    # Cards and notes --------------------------------------------------------

    @staticmethod
    def title():
        return F.concat(F.lit("doc-"), F.col("doc_id").cast("string"))

    def cards(self) -> DataFrame:
        doc = F.col("doc_id")
        none = F.array().cast("array<string>")

        def section(heading, content):
            return F.struct(
                heading.cast("string").alias("heading"), content.cast("string").alias("content")
            )

        empty = F.array().cast("array<struct<heading:string,content:string>>")
        sections = (
            F.when(doc % 3 == 0, empty)
            .when(doc % 3 == 1, F.array(section(F.col("lang"), F.col("source"))))
            .otherwise(
                F.array(section(F.lit(""), F.col("source")), section(F.col("lang"), F.lit(None)))
            )
        )
        return self.table("documents").select(
            doc.cast("string").alias("id"),
            F.col("source").alias("topic"),
            self.title().alias("title"),
            F.when(doc % 5 == 0, none).otherwise(F.array("source", "lang")).alias("warning_signs"),
            F.when(doc % 2 == 0, F.array("lang")).otherwise(none).alias("first_steps"),
            F.col("text").alias("body"),
            sections.alias("sections"),
            (F.col("n_chars") > 200).alias("enabled"),
            instant(CREATED).alias("created_at"),
        )

    def card_notes(self) -> DataFrame:
        """A note per document and one per label, so some titles have two."""
        by_document = self.table("documents").select(
            self.title().alias("title"),
            F.when(F.col("n_chars") > 400, "Warning").otherwise("Pro tip").alias("heading"),
            F.col("source").alias("content"),
        )
        labelled = self.table("labels").select(
            self.title().alias("title"),
            F.when(F.col("toxic") == 1, "Warning").otherwise("Pro tip").alias("heading"),
            F.concat(F.lit("quality "), F.col("quality").cast("string")).alias("content"),
        )
        return by_document.unionByName(labelled)

    # Message inputs ---------------------------------------------------------

    def requests(self) -> DataFrame:
        """One trivia or quiz request per event."""
        return self.events().select(
            F.col("event_id").cast("string").alias("request_id"),
            "discord_user_id",
            "guild_id",
            F.concat(F.lit("C-"), "event_type").alias("channel_id"),
            F.col("answered_at").alias("requested_at"),
        )

    def postings(self) -> DataFrame:
        """A posting of the event's session for every event with k of 50 or more."""
        return self.events().where("k >= 50").select(
            "session_id",
            F.col("answered_at").alias("posted_at"),
            F.concat(F.lit("P-"), F.col("event_id").cast("string")).alias("message_id"),
            F.concat(F.lit("P-"), "event_type").alias("channel_id"),
        )

    def intake(self) -> DataFrame:
        number = F.col("c_custkey")
        segment = F.col("c_mktsegment")
        return self.table("customer").select(
            number.cast("string").alias("id"),
            F.when(number % 97 != 0, F.col("c_name")).alias("prompt"),
            F.col("c_name").alias("a"),
            segment.alias("b"),
            F.when(number % 4 != 0, F.concat(segment, F.lit("-c"))).alias("c"),
            F.when(number % 4 > 1, F.concat(segment, F.lit("-d"))).alias("d"),
            F.when(number % 5 == 0, F.concat(segment, F.lit("-e"))).alias("e"),
            (number % 7).cast("int").alias("correct"),
            F.when(number % 3 != 0, segment).alias("why"),
            F.when(F.col("c_acctbal") > 0, segment).alias("topic"),
        )

    def bank_halves(self) -> tuple[DataFrame, DataFrame]:
        """The bank split into stored and incoming rows whose prompts partly agree."""
        number = F.col("id").cast("bigint")
        tagged = F.concat("prompt", F.lit(" #"), (number % 100).cast("string"))
        rows = self.questions().withColumns({"prompt": tagged, "stored": number % 3 == 0})
        return rows.where("stored").drop("stored"), rows.where("not stored").drop("stored")

    def patches(self) -> DataFrame:
        """Partial updates from orders; some ids are unknown, some patches empty."""
        order = F.col("o_orderkey").cast("string")
        level = F.substring("o_orderpriority", 1, 1)
        return self.table("orders").select(
            (F.col("o_custkey") * 2).cast("string").alias("id"),
            F.col("o_orderdate").cast("timestamp").alias("ts"),
            F.col("o_orderkey").alias("patch_id"),
            F.when(level.isin("1", "4"), F.concat(F.lit("p-"), order)).alias("prompt"),
            F.when(level.isin("2", "4"), F.concat(F.lit("w-"), order)).alias("why"),
            F.when(level == "3", F.concat(F.lit("t-"), order)).alias("topic"),
        )

    def calendar(self) -> DataFrame:
        """The days each customer ordered on, as guilds that want a daily question."""
        return self.table("orders").select(
            F.col("o_custkey").cast("string").alias("guild_id"),
            F.to_date("o_orderdate").alias("daily_date"),
        )

    def saved_dailies(self) -> DataFrame:
        """Daily sessions saved for the days of F (posted) and P (unposted) orders."""
        order = F.col("o_orderkey").cast("string")
        saved = (
            self.table("orders")
            .where(F.col("o_orderstatus").isin("F", "P"))
            .groupBy(
                F.col("o_custkey").cast("string").alias("guild_id"),
                F.to_date("o_orderdate").alias("daily_date"),
            )
            .agg(
                F.min(F.struct("o_orderkey", "o_orderstatus")).alias("first"),
            )
        )
        order = F.col("first.o_orderkey")
        return saved.select(
            F.concat(F.lit("O-"), order.cast("string")).alias("id"),
            (order % self.bank_size()).cast("string").alias("question_id"),
            "guild_id",
            "daily_date",
            F.when(
                F.col("first.o_orderstatus") == "F", F.concat(F.lit("M-"), order.cast("string"))
            ).alias("message_id"),
        )
