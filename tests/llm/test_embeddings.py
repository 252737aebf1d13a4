import numpy as np
import pytest
from pyspark.sql import functions as F

from drillbook.llm import embeddings as em

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, least=0.93):
    """Links and components over all pairs, in double precision."""
    vectors = []
    for _, vector, label in rows:
        good = vector is not None and label is not None and all(x is not None for x in vector)
        v = np.array(vector, np.float32).astype(float) if good else np.zeros(1)
        good = good and np.isfinite(v).all() and np.abs(v).sum() > 0
        vectors.append(v / np.linalg.norm(v) if good else None)
    n = len(rows)
    links, root = [0] * n, list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(n):
        for b in range(a):
            x, y = vectors[a], vectors[b]
            if x is None or y is None or rows[a][2] != rows[b][2] or len(x) != len(y):
                continue
            if x @ y >= least:
                links[a] += 1
                links[b] += 1
                p, q = find(a), find(b)
                if p != q:
                    root[max(p, q, key=lambda i: rows[i][0])] = min(p, q, key=lambda i: rows[i][0])
    return {rows[i][0]: (links[i], rows[find(i)][0]) for i in range(n)}


def awkward(seed=1):
    rng = np.random.default_rng(seed)
    rows = []
    for label in (0, 1, 2):
        centre = rng.normal(size=16)
        rows += [(v, label) for v in rng.normal(size=(60, 16))]
        rows += [(centre + 0.07 * rng.normal(size=16), label) for _ in range(50)]
        walk = rng.normal(size=16)
        for _ in range(30):
            walk = walk + 0.35 * rng.normal(size=16) * np.linalg.norm(walk) / 4
            rows.append((walk, label))
    rows += [(rows[5][0], rows[5][1])] * 30 + [(2 * rows[5][0], rows[5][1])]
    rows = [(v.astype(np.float32).tolist(), label) for v, label in rows]
    rows += [(None, 1), ([0.0] * 16, 1), ([float("nan")] * 16, 1), ([float("inf")] + [1.0] * 15, 1)]
    rows += [([None] + [1.0] * 15, 1), (rows[5][0], None), ([], 1), ([1.0, 2.0], 1), ([1.0, 2.1], 1)]
    order = rng.permutation(len(rows))
    return [(int(order[i]), vector, label) for i, (vector, label) in enumerate(rows)]


@pytest.mark.parametrize("exact", [True, False])
@pytest.mark.parametrize("shard, block", [(4096, 16384), (32, 20)])
def test_every_link_is_found(spark, monkeypatch, shard, block, exact):
    monkeypatch.setattr(em, "SHARD", shard)
    monkeypatch.setattr(em, "BLOCK", block)
    rows = awkward()
    frame = spark.createDataFrame([(i, v, l, "x", "y") for i, v, l in rows], SCHEMA + ", class string, list string")
    found = em.near_vectors(frame, exact=exact).collect()
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in found} == brute(rows)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in found)


def test_bounds_lose_no_neighbour():
    rng = np.random.default_rng(3)
    units = rng.normal(size=(800, 32))
    units[400:] = units[:400] + 0.06 * rng.normal(size=(400, 32))
    units /= np.linalg.norm(units, axis=1, keepdims=True)
    model = em.Quantiser.fit(units[::2], 12)
    lists = em.nearest_centroid(units, model.coarse)[0]
    codes, errors = model.encode(units, lists)
    radius = np.sqrt(2 - 2 * 0.93)
    probes = np.array([np.isin(lists, own) for own in model.probes(units, radius, None)])
    tables = model.square_table_distances(
        units, model.tables(units), lists, codes, model.offsets(lists, codes)
    )
    coded = model.coarse[lists] + np.concatenate(
        [book[codes[:, i]] for i, book in enumerate(model.books)], axis=1
    )
    assert np.allclose(tables, ((units[:, None] - coded) ** 2).sum(2))
    near = units @ units.T >= 0.93
    found = probes & (tables <= (radius + errors) ** 2 + em.SLACK)
    assert near.sum() > 800 and not (near & ~found).any()
    some = model.probes(units, radius, 3)
    assert all(len(own) <= 3 and own_list in own for own, own_list in zip(some, lists))


def test_probes_find_planted_links(spark):
    """Neighbours near the threshold: recall and the share of pairs that are looked at."""
    rng = np.random.default_rng(11)
    base = rng.normal(size=(9_000, 64))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    cosine = rng.uniform(0.93, 0.95, 2_000)
    away = rng.normal(size=(2_000, 64))
    away -= (away * base[:2_000]).sum(1)[:, None] * base[:2_000]
    away /= np.linalg.norm(away, axis=1, keepdims=True)
    near = cosine[:, None] * base[:2_000] + np.sqrt(1 - cosine**2)[:, None] * away
    vectors = np.concatenate([base, near]).astype(np.float32)
    units = vectors.astype(float)
    units /= np.linalg.norm(units, axis=1, keepdims=True)
    want = (units @ units.T >= 0.93).sum(1) - 1
    assert want.sum() > 3_900
    rows = [(i, v.tolist(), 1) for i, v in enumerate(vectors)]
    found = em.near_vectors(spark.createDataFrame(rows, SCHEMA)).select("vec_id", "n_links").collect()
    got = np.zeros(len(vectors), int)
    for row in found:
        got[row["vec_id"]] = row["n_links"]
    assert (got <= want).all() and got.sum() >= 0.99 * want.sum()
    assert got[:2_000].sum() == got[9_000:].sum()  # seen from both ends

    model = em.Quantiser.fit(units, int(np.sqrt(len(units))))
    lists = em.nearest_centroid(units, model.coarse)[0]
    sizes = np.bincount(lists, minlength=len(model.coarse))
    radius = np.sqrt(2 - 2 * 0.93)
    looked_at = sum(sizes[own].sum() for own in model.probes(units, radius, em.LEAST_PROBES))
    assert looked_at < 0.2 * len(units) ** 2


def test_a_link_found_from_one_side_counts_on_both(spark, monkeypatch):
    monkeypatch.setattr(em, "SHARD", 64)
    rng = np.random.default_rng(5)
    walk, vectors = rng.normal(size=12), []
    for _ in range(400):
        walk = walk + 0.3 * rng.normal(size=12) * np.linalg.norm(walk) / 4
        vectors.append((walk / np.linalg.norm(walk)).astype(np.float32))
    frame = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(vectors)], SCHEMA)
    found = em.near_vectors(frame, least_probes=2, probe_share=0.0).select("vec_id", "n_links").collect()

    classes = em.distinct_vectors(frame).withColumn("class", F.col("least_id"))
    model = em._fitted(classes)[12]
    units = np.array(vectors, float)
    units /= np.linalg.norm(units, axis=1, keepdims=True)
    lists = em.nearest_centroid(units, model.coarse)[0]
    probes = np.array([np.isin(lists, own) for own in model.probes(units, np.sqrt(2 - 2 * 0.93), 2)])
    near = (units @ units.T >= 0.93) & ~np.eye(len(units), dtype=bool)
    assert (near & probes & ~probes.T).any()
    assert {r["vec_id"]: r["n_links"] for r in found} == dict(enumerate((near & (probes | probes.T)).sum(1).tolist()))


def test_repeated_rows_and_rows_without_an_id(spark):
    v, w = [1.0, 2.0, 3.0, 4.0], [4.0, -3.0, 2.0, -1.0]
    rows = [(1, v, 1), (1, v, 1), (None, v, 1), (None, w, 1)]
    found = em.near_vectors(spark.createDataFrame(rows, SCHEMA)).collect()
    got = sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in found), key=repr)
    assert got == sorted([(1, 2, 1), (1, 2, 1), (None, 2, 1), (None, 0, None)], key=repr)


@pytest.mark.parametrize("rows", [[], [(1, None, 1), (2, [1.0], None)]])
def test_tables_without_vectors(spark, rows):
    found = em.near_vectors(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in found) == [
        (i, 0, i) for i, _, _ in rows
    ]
