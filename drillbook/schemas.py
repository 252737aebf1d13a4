"""Schemas of the stored tables and of the inputs that arrive as messages."""

from pyspark.sql.types import (
    ArrayType,
    BooleanType,
    DateType,
    IntegerType,
    ShortType,
    StringType,
    StructField,
    StructType,
    TimestampType,
)


def _fields(**columns):
    """Build a StructType; a trailing None in the pair marks a nullable column."""
    fields = []
    for name, spec in columns.items():
        nullable = isinstance(spec, tuple)
        fields.append(StructField(name, spec[0] if nullable else spec, nullable))
    return StructType(fields)


def _optional(data_type):
    return (data_type, None)


TEXT = StringType()
TEXTS = ArrayType(TEXT)
SECTION = StructType([StructField("heading", TEXT), StructField("content", TEXT)])

QUESTIONS = _fields(
    id=TEXT,
    prompt=TEXT,
    options=TEXTS,
    correct_option=ShortType(),
    explanation=TEXT,
    topic=_optional(TEXT),
    enabled=BooleanType(),
    created_at=TimestampType(),
    updated_at=TimestampType(),
)

TRAINING_CARDS = _fields(
    id=TEXT,
    topic=TEXT,
    title=TEXT,
    warning_signs=TEXTS,
    first_steps=TEXTS,
    body=_optional(TEXT),
    sections=ArrayType(SECTION),
    enabled=BooleanType(),
    created_at=TimestampType(),
)

QUESTION_SESSIONS = _fields(
    id=TEXT,
    question_id=TEXT,
    kind=TEXT,
    guild_id=TEXT,
    channel_id=TEXT,
    message_id=_optional(TEXT),
    owner_discord_user_id=_optional(TEXT),
    daily_date=_optional(DateType()),
    expires_at=_optional(TimestampType()),
    created_at=TimestampType(),
    quiz_run_id=_optional(TEXT),
)

QUESTION_ANSWERS = _fields(
    id=TEXT,
    session_id=TEXT,
    discord_user_id=TEXT,
    selected_option=ShortType(),
    is_correct=BooleanType(),
    points_awarded=IntegerType(),
    answered_at=TimestampType(),
)

EMPLOYEE_PROFILES = _fields(
    discord_user_id=TEXT,
    display_name=TEXT,
    total_points=IntegerType(),
    daily_streak=IntegerType(),
    last_daily_date=_optional(DateType()),
    updated_at=TimestampType(),
)

QUIZ_RUNS = _fields(
    id=TEXT,
    discord_user_id=TEXT,
    guild_id=TEXT,
    question_ids=TEXTS,
    current_index=IntegerType(),
    correct_count=IntegerType(),
    completed_at=_optional(TimestampType()),
    created_at=TimestampType(),
)

TABLES = {
    "questions": QUESTIONS,
    "training_cards": TRAINING_CARDS,
    "question_sessions": QUESTION_SESSIONS,
    "question_answers": QUESTION_ANSWERS,
    "employee_profiles": EMPLOYEE_PROFILES,
    "quiz_runs": QUIZ_RUNS,
}

PRIMARY_KEYS = {
    "questions": ["id"],
    "training_cards": ["id"],
    "question_sessions": ["id"],
    "question_answers": ["id"],
    "employee_profiles": ["discord_user_id"],
    "quiz_runs": ["id"],
}

# Unique keys beside the primary ones.
UNIQUE_KEYS = {
    "question_sessions": ["guild_id", "daily_date"],
    "question_answers": ["session_id", "discord_user_id"],
}

# (child, column, parent, what deleting a parent row does to its children).
FOREIGN_KEYS = [
    ("question_sessions", "question_id", "questions", "restrict"),
    ("question_sessions", "quiz_run_id", "quiz_runs", "cascade"),
    ("question_answers", "session_id", "question_sessions", "cascade"),
]

# One button press: custom_id is "answer:<session>:<choice>".
PRESSES = _fields(
    id=TEXT,
    custom_id=TEXT,
    discord_user_id=TEXT,
    global_name=_optional(TEXT),
    username=TEXT,
    answered_at=TimestampType(),
)

# Bulk content drops: the columns an author writes, before ids and clocks.
QUESTION_DROP = _fields(
    prompt=TEXT,
    options=TEXTS,
    correct_option=ShortType(),
    explanation=_optional(TEXT),
    topic=_optional(TEXT),
)

CARD_DROP = _fields(
    topic=TEXT,
    title=TEXT,
    warning_signs=_optional(TEXTS),
    first_steps=_optional(TEXTS),
    body=_optional(TEXT),
    sections=_optional(ArrayType(SECTION)),
)
