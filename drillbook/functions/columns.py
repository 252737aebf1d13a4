"""Column expressions shared by the operators; all of them stay in the JVM."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# The labels of the answer choices, in order.
LETTERS = ["A", "B", "C", "D", "E"]


def letter(index) -> Column:
    """The label of a zero-based choice; null beyond the last."""
    labels = F.array(*[F.lit(label) for label in LETTERS])
    return F.get(labels, index.cast("int"))


def local_date(instant, zone: str) -> Column:
    """The calendar date of a timestamp in a zone, whatever the session zone is.

    The inner shift puts the zone's wall clock where UTC reads it, the outer one
    where the session zone reads it. With constant zones both are compiled code
    with the zone looked up once, several times as fast as convert_timezone.
    """
    wall_clock = F.from_utc_timestamp(instant, zone)
    return F.to_date(F.to_utc_timestamp(wall_clock, F.current_timezone()))


def hash_number(*parts) -> Column:
    """A repeatable number below 2^60 drawn from the md5 of the parts."""
    texts = [part if isinstance(part, Column) else F.lit(str(part)) for part in parts]
    digest = F.md5(F.concat_ws("|", *[text.cast("string") for text in texts]))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")


def hash_numbers(count: int, *parts) -> Column:
    """An array of repeatable numbers below 2^48, five from each digest of the parts."""
    texts = [part if isinstance(part, Column) else F.lit(str(part)) for part in parts]
    numbers = []
    for start in range(0, count, 5):
        digest = F.sha2(F.concat_ws("|", *[t.cast("string") for t in [*texts, F.lit(start)]]), 256)
        numbers += [
            F.conv(F.substring(digest, 12 * place + 1, 12), 16, 10).cast("bigint")
            for place in range(min(5, count - start))
        ]
    return F.array(*numbers)


def stable_id(*parts) -> Column:
    """A row id that depends on the natural key only, so a re-run makes the same ids."""
    texts = [part if isinstance(part, Column) else F.lit(str(part)) for part in parts]
    return F.sha2(F.concat_ws("|", *[text.cast("string") for text in texts]), 256)


def day_word(count) -> Column:
    return F.when(count == 1, "day").otherwise("days")


def names_failed(rules: dict[str, Column]) -> Column:
    """Names of the rules a row breaks. As with a SQL CHECK, null counts as a pass."""
    marks = [F.when(~F.coalesce(rule, F.lit(True)), F.lit(name)) for name, rule in rules.items()]
    return F.array_compact(F.array(*marks))
