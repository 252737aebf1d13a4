"""The sessions that the stream queries read: made once, and without a sort."""

import pytest

from workload.model import Model
from workload.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["stream_after_crash", "redelivered_presses"])
def test_sessions_are_made_once_for_all_batches(spark, monkeypatch, name):
    calls, made = [], Model.sessions
    monkeypatch.setattr(Model, "sessions", lambda self: calls.append(1) or made(self))
    QUERIES[name](spark, FOLDER)
    assert len(calls) == 1


def test_a_daily_session_needs_no_sort(spark):
    """Its columns follow from guild and date, so the presses are made distinct by hash."""
    assert "SortAggregate" not in Model(spark, FOLDER).sessions()._jdf.queryExecution().executedPlan().toString()
