import random
import tracemalloc
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from drillbook.llm import toxicity as tx
from tests.llm.frames import awkward, documents, sentence, with_clashing

LABELS = "doc_id long, quality int, toxic int"
BAD = ["zorkish", "grumbly", "vexpone", "vexptwo", "vexpthree"]


def corpus(seed=1, n=600):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        words = sentence(rng, rng.randint(20, 120)).split()
        toxic = int(i % 4 == 0)
        if toxic:
            for _ in range(rng.randint(2, 6)):
                words.insert(rng.randrange(len(words)), rng.choice(BAD))
        rows.append((i, ". ".join([" ".join(words[:15]), " ".join(words[15:])]), "s"))
        labels.append((i, 1, toxic))
    return rows, labels


@pytest.fixture(scope="module")
def fitted(spark):
    rows, labels = corpus()
    return tx.fit(documents(spark, rows), spark.createDataFrame(labels, LABELS))


def test_held_out_accuracy_and_spans(spark, fitted):
    rows, labels = corpus()
    found = tx.score_toxicity(documents(spark, rows), fitted).collect()
    wrong = 0
    for row in found:
        assert row["held_out"] == (zlib.crc32(str(row["doc_id"]).encode()) % 3 == 1)
        assert 0 <= row["score"] <= 1 and row["predicted"] == int(row["score"] >= 0.7)
        wrong += row["held_out"] and row["predicted"] != labels[row["doc_id"]][2]
        text = rows[row["doc_id"]][1]
        if row["spans"]:
            for span in row["spans"].split(","):
                start, end = map(int, span.split(":"))
                assert text[start:end] in BAD
    assert wrong <= 2


def test_held_out_labels_do_not_matter(spark):
    rows, labels = corpus()
    held = [zlib.crc32(str(i).encode()) % 3 == 1 for i, _, _ in rows]
    flipped = [(i, q, 1 - t if h else t) for (i, q, t), h in zip(labels, held)]
    models = [
        tx.fit(documents(spark, rows), spark.createDataFrame(some, LABELS)) for some in (labels, flipped)
    ]
    assert models[0].weights == models[1].weights
    assert (models[0].scoring == models[1].scoring).all()


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(1)
    moves, start = rng.normal(size=(2, 2)), rng.normal(size=2)
    lengths = np.array([5, 1, 3])
    emissions = rng.normal(size=(3, 5))
    marginals, pairs = tx.forward_backward(emissions, lengths, moves, start)
    all_pairs = np.zeros((2, 2))
    for i, n in enumerate(lengths):
        total, ones, own = 0.0, np.zeros(n), np.zeros((2, 2))
        for code in range(2**n):
            tags = [(code >> t) & 1 for t in range(n)]
            score = start[tags[0]] + sum(emissions[i, t] for t in range(n) if tags[t])
            score += sum(moves[a, b] for a, b in zip(tags, tags[1:]))
            total += np.exp(score)
            ones += np.exp(score) * np.array(tags)
            for a, b in zip(tags, tags[1:]):
                own[a, b] += np.exp(score)
        assert marginals[i, :n] == pytest.approx(ones / total)
        all_pairs += own / total
    assert pairs == pytest.approx(all_pairs)


def test_chains_end_with_sentences_and_after_so_many_words():
    text = "a bad b. c d. " + "bad " * 70
    chains = tx.chains_of(text, lambda word: 1.0 if word == "bad" else None)
    assert [len(spans) for spans, _ in chains] == [3, 64, 6]


def test_awkward_rows(spark, fitted):
    rows = awkward()
    frame = with_clashing(documents(spark, rows))
    found = tx.score_toxicity(frame, fitted).collect()
    assert sorted((r["doc_id"] for r in found), key=repr) == sorted((i for i, _, _ in rows), key=repr)
    assert not any(r["predicted"] for r in found)
    scores = {r["doc_id"]: r["score"] for r in found}
    assert scores[1] == scores[2] == scores[3]
    assert tx.drop_toxic(frame, fitted).columns == frame.columns
    assert tx.drop_toxic(frame, fitted).count() == len(rows)


def test_toxic_rows_go(spark, fitted):
    frame = documents(spark, [(1, "zorkish grumbly vexpone zorkish", "s"), (2, "calm words", "s")])
    assert [r["doc_id"] for r in tx.drop_toxic(frame, fitted).collect()] == [2]


def test_nothing_to_learn_from(spark):
    rows, labels = corpus()
    frame = documents(spark, rows)
    for some in ([], [(0, 1, None), (None, 1, 1)], [(i, 1, 0) for i in range(50)]):
        model = tx.fit(frame, spark.createDataFrame(some, LABELS))
        assert tx.score_toxicity(frame, model).agg(F.max("predicted")).first()[0] == 0
    repeated = spark.createDataFrame(labels + labels[:100] + [(i, 0, 0) for i in range(0, 40, 4)], LABELS)
    model = tx.fit(frame, repeated)
    assert "zorkish" in model.weights


def test_one_text_per_sampled_id_reaches_the_driver(spark, monkeypatch):
    rows, labels = corpus()
    hot = next(i for i, *_ in labels if zlib.crc32(str(i).encode()) % 3 != 1)
    repeats = [(hot, text, "s") for text in (None, "one text", "other text") for _ in range(100)]
    seen = []
    monkeypatch.setattr(tx, "train", lambda found: seen.append(list(found)))
    labelled = spark.createDataFrame(labels, LABELS)
    for some in (rows + repeats, repeats[::-1] + rows[::-1]):
        tx.fit(documents(spark, some), labelled)
    ids = {i for i, *_ in labels if zlib.crc32(str(i).encode()) % 3 != 1}
    assert len(seen[0]) == len(ids) and seen[0] == seen[1]


def test_empty_tables(spark, fitted):
    empty = documents(spark, [])
    assert tx.score_toxicity(empty, fitted).count() == 0
    assert tx.drop_toxic(empty, fitted).count() == 0
    assert tx.fit(empty, spark.createDataFrame([], LABELS)).weights == {}


def test_training_keeps_no_words_of_clean_documents_alone():
    """They were counted on the driver, though no such word is ever weighed."""
    clean = [(" ".join(f"clean{i}x{j}ending" for j in range(200)), 0) for i in range(300)]
    dirty = [(f"vilest{i} gruesome words {i}", 1) for i in range(20)]
    tracemalloc.start()
    try:
        tx.train(clean + dirty)
        assert tracemalloc.get_traced_memory()[1] < 16_000_000
    finally:
        tracemalloc.stop()
