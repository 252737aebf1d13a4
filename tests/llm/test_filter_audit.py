"""Every step of every order, document by document."""

import random
import re
from itertools import permutations
from math import factorial

import pytest
from pyspark.sql import functions as F

from drillbook.llm import filter_audit as fa
from tests.llm import frames

WORD = re.compile("[^\x20\x09-\x0d]+")
LABELS = "doc_id long, quality int, toxic int"


def failures_of(rows):
    """The letters each row of (doc_id, text) fails."""
    found = []
    for doc_id, text in rows:
        text = text or ""
        words = WORD.findall(text)
        failed = "A" if len(words) < 200 else ""
        failed += "B" if 100 * len(set(words)) < 50 * len(words) else ""
        failed += "C" if 100 * len(re.findall("[A-Z]", text)) > 3 * len(text) else ""
        failed += "D" if set(text) & set("#$%&*|") else ""
        smaller = [i for i, other in rows if (other or "") == text and i is not None and doc_id is not None and i < doc_id]
        found.append(failed + ("E" if smaller else ""))
    return found


def audit(rows, labels):
    """(part, order, step) to counts, from rows of (doc_id, text, lang)."""
    failed = failures_of([row[:2] for row in rows])
    good = {i for i, quality, _ in labels if quality == 1 and i is not None}
    toxic = {i for i, _, mark in labels if mark == 1 and i is not None}
    found, shapley = {}, {}
    for part in {lang or "" for _, _, lang in rows}:
        here = [(row[0], f) for row, f in zip(rows, failed) if (row[2] or "") == part]
        for order in map("".join, permutations("ABCDE")):
            left = here
            for step, letter in enumerate(order, 1):
                gone = [row for row in left if letter in row[1]]
                left = [row for row in left if letter not in row[1]]
                fails = sum(letter in f for _, f in here)
                shapley[part, letter] = shapley.get((part, letter), 0) + len(gone)
                found[part, order, step] = [
                    len(left),
                    len(gone),
                    fails - len(gone),
                    sum(f == letter for _, f in here),
                    sum(i in good for i, _ in gone),
                    sum(i in toxic for i, _ in gone),
                ]
    return {
        key: tuple(counts + [shapley[key[0], key[1][key[2] - 1]]]) for key, counts in found.items()
    }


def table(spark, rows):
    made = [(i, text, lang, "s", len(text or "")) for i, text, lang in rows]
    return spark.createDataFrame(made, frames.DOCUMENTS)


def result(spark, rows, labels):
    made = fa.audit_documents(table(spark, rows), spark.createDataFrame(labels, LABELS))
    names = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert made.columns == ["part", "filter_order", "step", *names]
    rows = made.collect()
    found = {tuple(row[:3]): tuple(row[3:]) for row in rows}
    assert len(found) == len(rows)
    return found


def some_rows(seed=1, n=120):
    rng = random.Random(seed)
    texts = [frames.sentence(rng, rng.choice([5, 150, 200, 400])) for _ in range(25)]
    texts += ["A" * 10 + " b" * 250, "word " * 300, "x # y", "", None, "\t\n\x0b", "É" * 300 + " AAAA", "Copy me"]
    rows = [(i, rng.choice(texts), rng.choice(["en", "de", None, ""])) for i in range(n)]
    return rows + [(None, "Copy me", "en"), (None, "Copy me", "en"), (3, rows[3][1], "en"), (3, "other", "de")]


def test_against_every_order_on_its_own(spark):
    rows = some_rows()
    rng = random.Random(2)
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 120, 2)]
    labels += [(4, 1, 1), (4, 0, 0), (None, 1, 1), (9_999, 1, 1)]
    assert result(spark, rows, labels) == audit(rows, labels)


def test_removals_over_all_orders_add_up(spark):
    rows = some_rows(5, 60)
    found = result(spark, rows, [(1, 1, 1)])
    for part in {key[0] for key in found}:
        sums = {key[1][key[2] - 1]: counts[-1] for key, counts in found.items() if key[0] == part}
        removed = {sum(found[part, o, s][1] for s in range(1, 6)) for o in {k[1] for k in found}}
        assert removed == {sum(sums.values()) / factorial(5)}


@pytest.mark.parametrize("n", range(1, 7))
def test_paths_are_orders(n):
    reach, leave = fa.forward_paths(n), fa.backward_paths(n)
    for state in range(2**n):
        size = state.bit_count()
        assert (reach[state], leave[state]) == (factorial(size), factorial(n - size))


def test_other_filters_and_flags(spark):
    rows = spark.createDataFrame(
        [("p", 0, 5, 1), ("p", 1, 3, 0), ("p", 3, 2, 2), ("q", 2, 4, 4)], "part string, mask int, n long, odd long"
    )
    found = {
        (r["part"], r["filter_order"], r["step"]): (r["kept"], r["removed"], r["redundant"], r["unique_fails"], r["odd_lost"], r["shapley"])
        for r in fa.audit_orders(rows, ["x", "y"], ["odd"]).collect()
    }
    assert found == {
        ("p", "xy", 1): (5, 5, 0, 3, 2, 8),
        ("p", "xy", 2): (5, 0, 2, 0, 0, 2),
        ("p", "yx", 1): (8, 2, 0, 0, 2, 2),
        ("p", "yx", 2): (5, 3, 2, 3, 0, 8),
        ("q", "xy", 1): (4, 0, 0, 0, 0, 0),
        ("q", "xy", 2): (0, 4, 0, 4, 4, 8),
        ("q", "yx", 1): (0, 4, 0, 4, 4, 8),
        ("q", "yx", 2): (0, 0, 0, 0, 0, 0),
    }
    with pytest.raises(ValueError):
        fa.audit_orders(rows, list("abcdefg"), [])


def test_a_text_on_a_third_of_all_rows_stays_spread(spark):
    """Copies are folded where they are read: no task gets them as rows."""
    rows = [(i, "the same text" if i % 3 else f"text {i}", "en") for i in range(3000)]
    made = fa.failure_histogram(table(spark, rows).repartition(4), spark.createDataFrame([], LABELS))
    counts = {row["mask"]: row["n"] for row in made.collect()}
    assert counts == {1: 1001, 17: 1999}


def test_empty_tables_and_clashing_names(spark):
    none = spark.createDataFrame([], frames.DOCUMENTS)
    marks = spark.createDataFrame([], LABELS)
    assert fa.audit_documents(none, marks).count() == 0
    rows = frames.with_clashing(table(spark, some_rows(7, 30))).withColumn("mask", F.lit("x"))
    made = fa.audit_documents(rows, frames.with_clashing(marks).withColumn("n", F.lit("x")))
    assert made.count() == 120 * 5 * 3
