from drillbook.plans.flows import (
    close_day,
    leaderboard_from_submissions,
    profiles_from_submissions,
    replace_rows,
)

__all__ = ["close_day", "leaderboard_from_submissions", "profiles_from_submissions", "replace_rows"]
