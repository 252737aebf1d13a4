import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from drillbook.llm import mixing
from drillbook.llm.shared import words
from tests.llm.frames import awkward, documents, with_clashing


def brute_targets(sizes, weights=(1, 2, 3), cap=3):
    """Shares, then the excess over the caps reshared by weight until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, target, full = sum(sizes.values()), {}, set()
    while True:
        rest = total - sum(cap * sizes[s] for s in full)
        free = [s for s in names if s not in full]
        for s in names:
            target[s] = (
                cap * sizes[s] if s in full else rest * weight[s] / sum(weight[t] for t in free)
            )
        over = {s for s in free if target[s] > cap * sizes[s]}
        if not over:
            return target
        full |= over


def size(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


@pytest.mark.parametrize(
    "rows",
    [
        awkward(),
        [(i, "w " * (i % 7), s) for i, s in enumerate("abcde" * 30)],
        [(1, "a b c", "x"), (2, "a " * 1000, "y"), (3, "", "z")],
        [(1, None, None), (2, "", "a")],
    ],
)
def test_targets_and_budgets(spark, rows):
    frame = with_clashing(documents(spark, rows)).drop("size", "taken", "target")
    found = mixing.mix_sources(frame, words(F.col("text"))).collect()
    assert len(found) == len(rows)
    sizes, taken = defaultdict(int), defaultdict(int)
    for _, text, source in rows:
        sizes[source] += size(text)
    want = brute_targets(sizes)
    for row in found:
        assert row["source_size"] == sizes[row["source"]]
        assert row["target"] == pytest.approx(want[row["source"]])
        assert 0 <= row["taken"] <= 3 * row["size"]
        taken[row["source"]] += row["taken"]
    for source in sizes:
        assert abs(taken[source] - want[source]) <= 0.5 + 1e-6


def test_reruns_agree(spark):
    frame = documents(spark, awkward(2))
    runs = [
        sorted(map(tuple, mixing.mix_sources(f, words(F.col("text"))).select("doc_id", "taken").collect()), key=repr)
        for f in (frame, frame.repartition(5))
    ]
    assert runs[0] == runs[1]


def test_copies_hold_the_words_taken(spark):
    rows = [(1, " a  b\nc ", "x"), (2, "d e f g", "x"), (3, "h " * 50, "y")]
    mixed = mixing.mix_sources(documents(spark, rows), words(F.col("text")))
    taken = {r["doc_id"]: r["taken"] for r in mixed.collect()}
    copies = mixing.mixed_copies(mixed).collect()
    got, texts = defaultdict(int), {i: t for i, t, _ in rows}
    for row in copies:
        got[row["doc_id"]] += size(row["text"])
        assert texts[row["doc_id"]].startswith(row["text"])
    assert dict(got) == {i: n for i, n in taken.items() if n}


def test_empty_table(spark):
    assert mixing.mix_sources(documents(spark, []), words(F.col("text"))).count() == 0
