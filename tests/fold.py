"""The profile fold as the interactive program does it: one answer at a time, in order."""

from datetime import timedelta


def fold(events, profiles=None):
    """Fold answers and resets; returns profiles and the streak each daily answer left.

    Events are dictionaries in time order. An answer has id, user, name, date
    (or None), right and at; a reset has kind "reset" and at; a midnight has kind
    "midnight" and the local date that begins.
    """
    profiles = {user: dict(state) for user, state in (profiles or {}).items()}
    streaks = {}
    for event in events:
        kind = event.get("kind", "answer")
        if kind == "reset":
            for state in profiles.values():
                state.update(points=0, streak=0, last=None, updated=event["at"])
        elif kind == "midnight":
            yesterday = event["date"] - timedelta(days=1)
            for state in profiles.values():
                if state["last"] is not None and state["last"] < yesterday:
                    state["streak"] = 0
        else:
            state = profiles.get(event["user"], {"points": 0, "streak": 0, "last": None})
            streak = state["streak"]
            if event["date"] is not None:
                follows = state["last"] == event["date"] - timedelta(days=1)
                streak = (streak + 1 if follows else 1) if event["right"] else 0
                streaks[event["id"]] = streak
            profiles[event["user"]] = {
                "points": state["points"] + (10 if event["right"] else 0),
                "streak": streak,
                "last": event["date"] or state["last"],
                "name": event["name"],
                "updated": event["at"],
            }
    return profiles, streaks
