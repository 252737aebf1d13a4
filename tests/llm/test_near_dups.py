import random
from collections import defaultdict

import numpy as np
import pytest

from drillbook.llm import near_dups as nd
from drillbook.llm.components import components
from drillbook.llm.fingerprints import shingle_hashes
from drillbook.llm.shared import Scratch
from tests.llm.frames import awkward, documents, sentence, with_clashing


def grouped(pairs, nodes):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    groups = defaultdict(set)
    for n in nodes:
        groups[find(n)].add(n)
    return {frozenset(g) for g in groups.values()}


@pytest.mark.parametrize("n", [0, 30, 400])
def test_components_equal_union_find(spark, n):
    rng = random.Random(n)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(n)]
    edges += [(1000 + i, 1001 + i) for i in range(40)] if n else []
    frame = spark.createDataFrame(edges, "a long, b long")
    found = components(frame, Scratch(spark, "test"), "c").collect()
    nodes = {x for edge in edges for x in edge}
    assert len(found) == len(nodes)
    groups = defaultdict(set)
    for row in found:
        groups[row["component"]].add(row["node"])
    assert {frozenset(g) for g in groups.values()} == grouped(edges, nodes)
    assert all(min(g) == root for root, g in groups.items())


@pytest.mark.parametrize("n, kept", [(300, 0.8), (40, 0.5), (5, 0.6), (3000, 0.9)])
def test_collisions_estimate_weighted_likeness(n, kept):
    rng = np.random.default_rng(n)
    missed = []
    for _ in range(60):
        base = rng.integers(0, 1 << 62, 2 * n)
        cut = int(n * (1 - kept))
        one = np.concatenate([base[:n], base[: n // 4]])
        other = base[cut : n + cut]
        first, second = nd.signatures([one, other])
        missed.append((first == second).mean() - nd.likeness(nd.regions(one), nd.regions(other)))
    assert abs(np.mean(missed)) < 0.03
    assert np.std(missed) < 0.08


def test_signature_depends_on_the_set_alone():
    sets = [np.arange(i, 50 + 3 * i) for i in range(20)] + [np.empty(0, np.int64)]
    together = nd.signatures(sets)
    alone = np.concatenate([nd.signatures([one[::-1].copy()]) for one in sets])
    assert (together == alone).all()
    assert (together[:-1] != 0).all() and not together[-1].any()


def varied(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = sentence(rng, 1)
    return " ".join(words)


def corpus(seed):
    """A group of exact copies, one of near copies, chains of edits, shared passages."""
    rng = random.Random(seed)
    texts = [text for _, text, _ in awkward(seed, 30)]
    base = sentence(rng, 300).split()
    texts += [varied(rng, base, 3) for _ in range(60)]
    texts += [" ".join(base[:200])] * 25
    chain = sentence(rng, 200).split()
    for _ in range(25):
        texts.append(" ".join(chain))
        chain = varied(rng, chain, 2).split()
    passage = sentence(rng, 60)
    texts += [f"{sentence(rng, 60)} {passage} {sentence(rng, 30)}" for _ in range(40)]
    return texts


def brute(texts, least=0.8):
    units = [np.unique(nd.regions(shingle_hashes(text or ""))) for text in texts]
    pairs = []
    for a in range(len(texts)):
        for b in range(a):
            same = (texts[a] or "") == (texts[b] or "")
            if same or (len(units[a]) and len(units[b]) and nd.likeness(units[a], units[b]) >= least):
                pairs.append((a, b))
    return grouped(pairs, range(len(texts)))


@pytest.mark.parametrize("block", [5, 128])
def test_classes_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(nd, "BLOCK", block)
    monkeypatch.setattr(nd, "UNITS_AT_ONCE", 50 * block)
    texts = corpus(11)
    frame = with_clashing(documents(spark, [(i, t, "s") for i, t in enumerate(texts)]))
    found = nd.near_classes(frame).collect()
    groups = defaultdict(set)
    for row in found:
        groups[row["class_id"]].add(row["doc_id"])
        assert row["kept"] == (row["doc_id"] == row["class_id"])
    assert {frozenset(g) for g in groups.values()} == brute(texts)
    assert all(min(g) == name for name, g in groups.items())


def test_one_document_of_a_class_stays(spark):
    texts = corpus(12)
    rows = [(i, t, "s") for i, t in enumerate(texts)] + [(0, texts[0], "s"), (3, texts[3], "s")]
    rows += [(None, "text without an id", None), (None, "text without an id", None)]
    frame = with_clashing(documents(spark, rows))
    kept = nd.drop_near_dups(frame)
    assert kept.columns == frame.columns
    got = sorted((r["doc_id"] for r in kept.collect()), key=repr)
    assert got == sorted([min(g) for g in brute(texts)] + [None], key=repr)


def test_empty_table(spark):
    assert nd.near_classes(documents(spark, [])).count() == 0
    assert nd.drop_near_dups(documents(spark, [])).count() == 0


def test_rounds_of_components_take_few_jobs(spark):
    """Every job leaves threads and plans on the driver; a round's end is seen by one aggregate."""
    edges = [(i, i + 1) for i in range(40)] + [(100 + i, 200) for i in range(30)]
    frame = spark.createDataFrame(edges, "a long, b long")
    rounds = []

    class Counting(Scratch):
        def write(self, rows, name):
            rounds.append(name)
            return super().write(rows, name)

    context = spark.sparkContext
    context.setJobGroup("components", "")
    try:
        components(frame, Counting(spark, "test"), "c")
        jobs = len(context.statusTracker().getJobIdsForGroup("components"))
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    assert jobs <= 10 * (len(rounds) - 1)


def test_few_tables(spark, monkeypatch):
    """Writing a table costs a task per partition, however small it is.

    Tables beside one per round of components: signed, bucket_rows, members,
    texts, links, mixed, choices, more_links and heads.
    """
    written = []
    write = Scratch.write
    monkeypatch.setattr(Scratch, "write", lambda self, rows, name: written.append(name) or write(self, rows, name))
    assert nd.near_classes(documents(spark, [(i, t, "s") for i, t in enumerate(corpus(13))])).collect()
    rounds = [name for name in written if name.split("-")[0] in ("stars", "groups", "all")]
    assert {"stars-1", "groups-1", "all-1"} <= set(rounds)
    assert not {"stars-0", "groups-0", "all-0"} & set(rounds)
    assert len(written) - len(rounds) <= 9


@pytest.mark.parametrize("across", [True, False])
def test_linked_pairs_equal_likeness(monkeypatch, across):
    monkeypatch.setattr(nd, "UNITS_AT_ONCE", 7)
    rng = random.Random(5)
    base = sentence(rng, 80).split()
    texts = [varied(rng, base, rng.randint(0, 6)) for _ in range(30)] + [sentence(rng, 20) for _ in range(5)]
    units = [nd.regions(shingle_hashes(text)) for text in texts]
    sides = np.array([i % 3 > 0 for i in range(len(units))], np.int32) * across
    expected = [
        (i, j)
        for i in range(len(units))
        for j in range(len(units))
        if (sides[i] < sides[j] if across else i < j) and nd.likeness(units[i], units[j]) >= 0.6
    ]
    assert expected
    assert sorted(map(tuple, nd.linked_pairs(units, sides, 0.6).tolist())) == sorted(expected)
