from drillbook.streaming.answers import (
    answer_log,
    answers_of_dates,
    apply_close_day,
    apply_reset,
    current_profiles,
    current_quiz_runs,
    last_batch,
    prepare_store,
    process_batch,
    run_answer_stream,
    stage_batch,
)
from drillbook.streaming.store import Store, compact, vacuum

__all__ = [
    "Store",
    "answer_log",
    "answers_of_dates",
    "apply_close_day",
    "apply_reset",
    "compact",
    "current_profiles",
    "current_quiz_runs",
    "last_batch",
    "prepare_store",
    "process_batch",
    "run_answer_stream",
    "stage_batch",
    "vacuum",
]
