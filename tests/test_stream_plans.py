"""What a micro-batch moves and holds, at any size of its rows."""

import re

from pyspark.sql import functions as F

from drillbook.operators import answers as an
from drillbook.sources import shared_folder
from drillbook.streaming import Store, prepare_store
from drillbook.streaming.answers import STAGED, _fold
from drillbook.streaming.store import DAYS
from tests import tables
from tests.tables import ZONE, question, session


def initial(rows):
    """The plan before run-time changes, of a frame that was not run yet."""
    return rows._jdf.queryExecution().executedPlan().toString()


def screened(spark, *rows):
    bank = tables.questions(spark, question("q"))
    open_sessions = tables.sessions(spark, session("s", "q"), session("t", "q"))
    enriched = an.enrich_submissions(tables.submissions(spark, *rows), open_sessions, bank)
    return an.screen_submissions(enriched, ZONE)


PRESS = [
    tables.submission("1", "s", "u"),
    tables.submission("1", "s", "u"),  # delivered twice
    tables.submission("2", "s", "v", 1),
    tables.submission("3", "t", "u"),
    tables.submission("4", "nowhere", "u"),
    tables.submission("5", "s", None),
]


def test_neither_accepted_nor_stored_answers_are_broadcast(spark):
    """Files say little of how large rows get in memory: 76 MB of them made a broadcast of 1.1 GB."""
    placed = an.with_places(screened(spark, *PRESS))
    stored = tables.answers(spark, []).select("discord_user_id").withColumn("session_id", F.lit("s"))
    plan = initial(an.mark_duplicates(placed, stored))
    assert "Broadcast" not in plan
    assert plan.count("SortMergeJoin") == 2


def test_a_row_is_told_apart_by_a_number_not_a_path(spark):
    assert an.as_placed(screened(spark, *PRESS)).schema[an.PLACE].dataType.typeName() == "long"


def test_verdicts_against_stored_answers(spark):
    """An answer of an unknown user is stored and counts for no one, as before."""
    stored = spark.createDataFrame([("s", "v"), ("s", None)], "session_id string, discord_user_id string")
    judged = an.mark_duplicates(an.with_places(screened(spark, *PRESS)), stored)
    assert not {an.PLACE, an.ROW, *an.ANSWERER} & set(judged.columns)
    found = sorted((row["id"], row["verdict"]) for row in judged.collect())
    assert found == [
        ("1", "duplicate"),
        ("1", "ok"),
        ("2", "duplicate"),
        ("3", "ok"),
        ("4", "unknown_session"),
        ("5", "ok"),
    ]


def test_a_batch_stages_no_texts_of_questions(spark):
    assert not {"options", "explanation"} & set(STAGED)


def test_nothing_stored_is_known_to_be_empty_before_the_batch_runs(spark):
    root = shared_folder(spark, "empty-store")
    prepare_store(spark, root)
    store = Store(spark, root)
    state = store.latest()[1]
    for table in state["tables"]:
        rows = store.read(state, table, ["2024-01-01"])
        assert rows.count() == 0
        left = rows.select(F.lit(1).alias("one")).unionByName(spark.range(3).select(F.lit(1).alias("one")))
        assert not re.search("Union|ExistingRDD", initial(left))


def test_stored_totals_move_once(spark):
    root = shared_folder(spark, "totals")
    prepare_store(spark, root)
    store = Store(spark, root)
    state = {**store.latest()[1], "resets": [1705298400000000]}
    days = spark.createDataFrame([], DAYS)
    folded = _fold(state, days, store.read(state, "base"), keep_all=False)
    assert initial(folded).count("Exchange") == 1
