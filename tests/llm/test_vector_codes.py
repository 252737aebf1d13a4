"""Codes against Lloyd's rounds in plain Python, and trees against every comparison."""

import hashlib
import math

import numpy as np
import pytest

from drillbook.llm import vector_codes as vc
from tests.llm import frames

VECTORS = "vec_id long, embedding array<float>, label int"


def plain(rows, parts=8, entries=16, rounds=6, scale=4096):
    """{row number: (code, error)}, label sums and codebooks of rows of (vec_id, vector, label)."""
    kept = [
        (vec_id, [float(np.float32(x)) for x in vector], label)
        for vec_id, vector, label in rows
        if vector is not None and all(x is not None and math.isfinite(x) for x in vector)
    ]
    longest = max((len(vector) for _, vector, _ in kept), default=0)
    width = -(-longest // parts)
    whole = []
    for vec_id, vector, label in kept:
        numbers = [max(-vc.LARGEST, min(vc.LARGEST, math.floor(scale * x))) for x in vector]
        numbers += [0] * (width * parts - len(numbers))
        whole.append((vec_id, vector, label, [numbers[width * p : width * (p + 1)] for p in range(parts)]))
    first = sorted(whole, key=lambda row: (row[0] is None, row[0] or 0, row[1]))[:entries]
    books = [[row[3][p] for row in first] for p in range(parts)]

    def near(part, book):
        return min((sum((a - b) ** 2 for a, b in zip(part, entry)), e) for e, entry in enumerate(book))

    for _ in range(rounds):
        for p, book in enumerate(books):
            members = {}
            for row in whole:
                members.setdefault(near(row[3][p], book)[1], []).append(row[3][p])
            books[p] = [
                [sum(column) // len(members[e]) for column in zip(*members[e])] if e in members else entry
                for e, entry in enumerate(book)
            ]
    coded = []
    for vec_id, _, label, cut in whole:
        best = [near(part, book) for part, book in zip(cut, books)]
        coded.append((vec_id, label, "".join(f"{e:02x}" for _, e in best), sum(d for d, _ in best)))
    sums = {}
    for _, label, _, error in coded:
        sums[label] = sums.get(label, 0) + error
    return [(*row[:1], *row[2:], sums[row[1]]) for row in coded], books


def result(spark, rows, **settings):
    made, books = vc.compress(spark.createDataFrame(rows, VECTORS), **settings)
    found = made.select("vec_id", "code", "error", "label_error").collect()
    return sorted(map(tuple, found), key=repr), books


def vectors(seed=1, n=400, width=24, groups=12):
    """Groups of near vectors, copies, ties and vectors that are dropped."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, width))
    rows = []
    for i in range(n):
        vector = centres[i % groups] + rng.normal(size=width) * rng.choice([0.0, 0.01, 0.5])
        rows.append((i * 3 + 1, vector.round(3).tolist(), int(rng.integers(5)) if i % 7 else None))
    return rows


def odd_rows(width=24):
    return [
        (0, None, 1),
        (2, [1.0, None] + [0.0] * (width - 2), 1),
        (5, [float("nan")] + [0.0] * (width - 1), 1),
        (8, [float("-inf")] + [0.0] * (width - 1), 1),
        (None, [0.5] * width, None),
        (None, [0.25] * width, None),
        (11, [0.1] * width, 1),
        (11, [0.1] * width, 1),
        (11, [-0.1] * width, 2),
        (14, [0.0] * width, 9),
        (17, [1e30, -1e30] + [0.0] * (width - 2), 9),
    ]


@pytest.mark.parametrize("seed", [1, 2])
def test_against_every_comparison(spark, seed):
    rows = vectors(seed) + odd_rows()
    found, books = result(spark, rows)
    want, want_books = plain(rows)
    assert books == want_books
    assert found == sorted(want, key=repr)


@pytest.mark.parametrize("settings", [{"parts": 4, "entries": 3, "rounds": 2}, {"parts": 5, "entries": 20, "rounds": 1}])
def test_other_parts_entries_and_rounds(spark, settings):
    rows = vectors(3, 150)
    found, books = result(spark, rows, **settings)
    want, want_books = plain(rows, **settings)
    assert (found, books) == (sorted(want, key=repr), want_books)


def test_vectors_of_other_lengths_and_few_rows(spark):
    rows = [(1, [0.5, -0.5, 0.1], 1), (2, [], None), (3, [0.25] * 11, 1)]
    found, books = result(spark, rows)
    want, want_books = plain(rows)
    assert (found, books) == (sorted(want, key=repr), want_books)
    assert result(spark, [(1, [], 1)]) == ([(1, "00" * 8, 0, 0)], [[[]]] * 8)


def test_empty_table_and_clashing_names(spark):
    none = spark.createDataFrame([], VECTORS)
    rows, books = vc.compress(none)
    assert rows.count() == 0 and books == [[]] * 8
    assert vc.codebooks_sha256(books) == hashlib.sha256(b"").hexdigest()
    some = frames.with_clashing(spark.createDataFrame(vectors(4, 60), VECTORS))
    made, _ = vc.compress(some)
    assert made.columns == ["vec_id", "label", "code", "error", "label_error"] and made.count() == 60
    with pytest.raises(ValueError):
        vc.compress(none, entries=300)


def points(kind, n=400, width=6, seed=3):
    rng = np.random.default_rng(seed)
    if kind == "copies":
        return np.repeat(rng.integers(-50, 50, (5, width)), n // 5, axis=0)
    if kind == "groups":
        return (rng.integers(-5000, 5000, (8, width))[rng.integers(8, size=n)] + rng.integers(-9, 9, (n, width)))
    if kind == "grid":
        return rng.integers(0, 3, (n, width))
    return rng.integers(-4096, 4096, (n, width))


@pytest.mark.parametrize("kind", ["copies", "groups", "grid", "even"])
def test_tree_holds_and_assigns_like_every_comparison(kind):
    some = points(kind)
    tree = vc.CoverTree.load(vc.CoverTree(some).dump())
    assert sorted(tree.order.tolist()) == list(range(len(some)))
    assert (tree.points == some[tree.order]).all()
    for node in range(len(tree.start)):
        run = tree.points[tree.start[node] : tree.end[node]].astype(np.int64)
        assert tree.radius2[node] == ((run - run[0]) ** 2).sum(axis=1).max()
        assert (tree.sums[tree.end[node]] - tree.sums[tree.start[node]] == run.sum(axis=0)).all()
    entries = np.concatenate([some[:9], some[:2], points("even", 3, seed=9)])
    squares = ((some[:, None, :] - entries[None]) ** 2).sum(axis=2)
    assert (tree.entry_of_each(entries) == squares.argmin(axis=1)).all()
    start, end, entry, compared = tree.assign(entries)
    assert (end - start).sum() == len(some)
    if kind in ("copies", "groups"):
        assert compared < len(some) * 0.75  # whole subtrees are assigned


def test_groups_far_apart_are_assigned_whole():
    some = points("groups")
    entries = vc.CoverTree(some).points[:1].astype(np.int64)
    for _ in range(7):
        gaps = ((some[:, None, :] - entries[None]) ** 2).sum(axis=2).min(axis=1)
        entries = np.concatenate([entries, some[gaps.argmax()][None]])
    squares = ((some[:, None, :] - entries[None]) ** 2).sum(axis=2)
    tree = vc.CoverTree(some)
    assert (tree.entry_of_each(entries) == squares.argmin(axis=1)).all()
    assert tree.assign(entries)[3] < len(some) / 10


def test_cover_tree_levels():
    """A point is within 2**(l+1) of its parent, and points of one level lie 2**l apart."""
    some = points("even", 200)
    parent, level = vc.CoverTree._farthest_first(some)
    for child in range(1, 200):
        gap = math.sqrt(((some[child] - some[parent[child]]) ** 2).sum())
        assert gap < 2.0 ** (level[child] + 1)
        assert parent[child] == 0 or level[parent[child]] > level[child]
        same = np.nonzero(level == level[child])[0]
        for other in same[same != child]:
            assert math.sqrt(((some[child] - some[other]) ** 2).sum()) >= 2.0 ** level[child]


def test_a_label_on_a_third_of_all_rows(spark):
    rows = [(i, [float(i % 11), 1.0] * 8, 7 if i % 3 == 0 else i) for i in range(600)]
    found, _ = result(spark, rows)
    want, _ = plain(rows)
    assert found == sorted(want, key=repr)
