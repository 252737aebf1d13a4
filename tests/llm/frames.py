"""Small tables with awkward rows."""

from __future__ import annotations

import random

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use for their own columns, as extra input columns.
CLASHING = (
    "key string, hash string, row string, size string, part string, copy string, rank string, "
    "bin string, id string, gap string, taken string, target string, text_key string, "
    "drop string, left string, kept string, component string, bucket string, host string"
)


def documents(spark, rows):
    """Rows of (doc_id, text, source)."""
    made = [(i, text, "en", source, len(text or "")) for i, text, source in rows]
    return spark.createDataFrame(made, DOCUMENTS)


def with_clashing(frame):
    from pyspark.sql import functions as F

    names = [part.split()[0] for part in CLASHING.split(", ")]
    taken = set(frame.columns)
    return frame.select("*", *[F.lit("x").alias(name) for name in names if name not in taken])


def sentence(rng: random.Random, words: int) -> str:
    return " ".join(
        "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(words)
    )


def awkward(seed: int = 1, n: int = 40):
    """Documents with nulls, empty and long texts, repeats, odd characters and a hot source."""
    rng = random.Random(seed)
    rows = [
        (1, None, None),
        (2, "", "a"),
        (3, " \t\n ", "a"),
        (4, "one", "b"),
        (5, "één ß İ 漢字 \U0001f600 ﬁ", "é"),
        (6, "same text here for two documents", "a"),
        (7, "same text here for two documents", "b"),
        (8, "line\nline\r\n LINE \n\nlast", "a"),
        (9, sentence(rng, 30_000), "a"),
        (10, "x" * 200_000, "b"),
        (None, "no id", "a"),
        (None, "no id", "a"),
        (11, "repeated row", None),
        (11, "repeated row", None),
    ]
    rows += [(100 + i, sentence(rng, rng.randint(1, 300)), "hot") for i in range(n)]
    return rows
