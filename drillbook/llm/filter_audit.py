"""How filters of documents depend on their order: every order at once, from one histogram.

A set of filters already applied is a state of the subset lattice; applying one
more is an edge. What an edge removes depends on the state alone, not on the
order in which it was reached, so the rows are counted once by which filters
they fail. The number of orders that reach a state times the number that leave
the edge's end weighs the edge in the sum over all orders; the steps of a single
order are read from the edges on its path.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Orders and edges of the lattice are tables that grow with the factorial of the filters.
MOST_FILTERS = 6
#: White space besides the blank, and the characters of filters C and D.
OTHER_SPACES = "\t\n\x0b\x0c\r"
CAPITALS, SYMBOLS = "[A-Z]", "[#$%&*|]"


def forward_paths(n: int) -> list[int]:
    """Number of orders in which each subset of n filters can have been applied."""
    paths = [1] + [0] * (2**n - 1)
    for state in range(1, 2**n):
        paths[state] = sum(paths[state & ~(1 << i)] for i in range(n) if state >> i & 1)
    return paths


def backward_paths(n: int) -> list[int]:
    """Number of orders in which the filters outside each subset can follow."""
    paths = [0] * (2**n - 1) + [1]
    for state in range(2**n - 2, -1, -1):
        paths[state] = sum(paths[state | 1 << i] for i in range(n) if not state >> i & 1)
    return paths


def failure_mask(failures: list[Column]) -> Column:
    """Bit i is set where condition i holds; a null condition does not hold."""
    mask = F.lit(0)
    for i, failure in enumerate(failures):
        mask = mask + F.when(failure, 1 << i).otherwise(0)
    return mask.cast("int")


def audit_orders(histogram: DataFrame, names: list[str], counted: list[str]) -> DataFrame:
    """Counts of every step of every order, from rows of (part, mask, n, *counted).

    Returns part, filter_order, step, kept, removed, redundant, unique_fails,
    `<name>_lost` of each column of `counted`, and shapley, the filter's removals
    summed over all orders. The lattice has at most 2**6 states, so its tables
    are small whatever the input.
    """
    n = len(names)
    if n > MOST_FILTERS or len(set(names)) != n:
        raise ValueError(f"up to {MOST_FILTERS} filters with different names")
    spark = histogram.sparkSession
    reach, leave = forward_paths(n), backward_paths(n)
    edges = [(state, i) for state in range(2**n) for i in range(n) if not state >> i & 1]
    weights = {(state, i): reach[state] * leave[state | 1 << i] for state, i in edges}
    lattice = [
        (mask, state, i, weights[state, i], not mask & state, bool(mask >> i & 1), mask == 1 << i)
        for mask in range(2**n)
        for state, i in edges
    ]
    lattice = spark.createDataFrame(
        lattice,
        "mask int, state int, filter int, weight long, arrives boolean, fails boolean, alone boolean",
    )
    removed = F.col("arrives") & F.col("fails")

    def total(condition: Column, of: str = "n") -> Column:
        return F.sum(F.when(condition, F.col(of)).otherwise(0)).cast("long")

    made = (
        histogram.join(F.broadcast(lattice), "mask")
        .groupBy("part", "state", "filter", "weight")
        .agg(
            total(F.col("arrives") & ~F.col("fails")).alias("kept"),
            total(removed).alias("removed"),
            total(F.col("fails") & ~F.col("arrives")).alias("redundant"),
            total(F.col("alone")).alias("unique_fails"),
            *[total(removed, name).alias(f"{name}_lost") for name in counted],
        )
    )
    weighed = F.sum(F.col("removed") * F.col("weight")).over(Window.partitionBy("part", "filter"))
    made = made.withColumn("shapley", weighed)
    steps = []
    for order in permutations(range(n)):
        state = 0
        for step, i in enumerate(order, 1):
            steps.append(("".join(names[j] for j in order), step, state, i))
            state |= 1 << i
    steps = spark.createDataFrame(steps, "filter_order string, step int, state int, filter int")
    return made.join(F.broadcast(steps), ["state", "filter"]).select(
        "part",
        "filter_order",
        "step",
        "kept",
        "removed",
        "redundant",
        "unique_fails",
        *[f"{name}_lost" for name in counted],
        "shapley",
    )


def text_failures(text: Column) -> list[Column]:
    """Conditions A to D: short, repetitive, capitals, symbols."""
    words = F.array_remove(F.split(F.translate(text, OTHER_SPACES, " " * len(OTHER_SPACES)), " "), "")
    n_words = F.size(words)
    return [
        n_words < 200,
        100 * F.size(F.array_distinct(words)) < 50 * n_words,
        100 * F.regexp_count(text, F.lit(CAPITALS)) > 3 * F.length(text),
        text.rlike(SYMBOLS),
    ]


def failure_histogram(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of (part, mask, n, good, toxic): documents per part by the filters A to E they fail.

    E is failed by a document whose text a smaller doc_id has. Equal rows are
    counted in each task before they move. Copies of one text, however many,
    are never in one place as rows: per text, part and task only their number
    and the smallest doc_id's share of it are left.
    """
    text = F.coalesce("text", F.lit(""))
    rows = documents.select(
        "doc_id",
        F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"),
        F.sha2(text, 256).alias("digest"),
        failure_mask(text_failures(text)).alias("mask"),
    )
    folded = rows.groupBy("doc_id", "part", "digest", "mask").agg(F.count(F.lit(1)).alias("n"))
    marks = labels.groupBy("doc_id").agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"),
        F.max((F.col("toxic") == 1).cast("int")).alias("toxic"),
    )
    marks = marks.where("doc_id IS NOT NULL AND (good = 1 OR toxic = 1)")
    known = folded.where("doc_id IS NOT NULL").join(marks, "doc_id", "left")
    nameless = folded.where("doc_id IS NULL").withColumns(
        {"good": F.lit(None).cast("int"), "toxic": F.lit(None).cast("int")}
    )
    counts = F.struct(
        "n",
        (F.col("n") * F.coalesce("good", F.lit(0))).alias("good"),
        (F.col("n") * F.coalesce("toxic", F.lit(0))).alias("toxic"),
    )
    rows = known.unionByName(nameless).select("doc_id", "part", "digest", "mask", counts.alias("c"))
    texts = rows.groupBy("digest", "part", "mask", F.col("doc_id").isNull().alias("nameless")).agg(
        *[F.sum(f"c.{name}").alias(name) for name in ("n", "good", "toxic")],
        F.min(F.struct("doc_id", "c")).alias("first"),
    )
    smallest = F.min(F.when(~F.col("nameless"), F.col("first.doc_id"))).over(Window.partitionBy("digest"))
    leads = F.col("first.doc_id") == F.col("smallest")
    repeated = F.lit(1 << 4)

    def share(of: Column) -> list[Column]:
        return [F.when(F.col("nameless"), F.col(name)).when(leads, of[name]).otherwise(0).alias(name) for name in ("n", "good", "toxic")]

    passing = F.struct(F.col("mask"), *share(F.col("first.c")))
    failing = F.struct(
        (F.col("mask") + repeated).cast("int").alias("mask"),
        *[(F.col(name) - column).alias(name) for name, column in zip(("n", "good", "toxic"), share(F.col("first.c")))],
    )
    return (
        texts.withColumn("smallest", smallest)
        .select("part", F.explode(F.array(passing, failing)).alias("row"))
        .where("row.n > 0")
        .select("part", "row.*")
        .groupBy("part", "mask")
        .agg(*[F.sum(name).alias(name) for name in ("n", "good", "toxic")])
    )


def audit_documents(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The filters A to E over whole texts, in all 120 orders, per language.

    A null text counts as empty and a null language as the empty string. A row
    without doc_id is a document that no filter E removes and that is no one's
    original; rows that repeat a doc_id and its text are no copies of each
    other, as none has the smaller id. A document is good or toxic if any label
    row of its doc_id says so; a label without doc_id marks no row. Without documents there are no parts and no
    rows; other columns are not read.
    """
    histogram = failure_histogram(documents, labels)
    return audit_orders(histogram, list("ABCDE"), ["good", "toxic"])
