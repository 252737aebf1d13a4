"""Near duplicates among vectors by product quantisation over inverted lists.

The quantiser is fitted on a bounded sample; every vector is indexed and every
vector is a query. A vector probes the lists nearest to it, or, in the exact
mode, all that a bound allows; a link is found if either of its vectors probes
the other's list, and counts on both. Candidates are cut by a bound that no link
can break, and cosines are computed exactly in the end.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .shared import Scratch, importable

#: Distinct vectors that a quantiser is fitted on, at most.
FIT_SAMPLE = 16_384
#: Inverted lists: the square root of the number of distinct vectors within these.
LEAST_LISTS, MOST_LISTS = 8, 1_024
#: Components of a subspace, codes a subspace, rounds of k-means.
SUBSPACE, CODES, ROUNDS = 4, 256, 8
#: Lists that a vector probes: so many, or a share of all if that is more.
LEAST_PROBES, PROBE_SHARE = 16, 1 / 16
#: Index vectors of a shard, queries of a block, queries compared at a time.
SHARD, BLOCK, AT_ONCE = 4_096, 16_384, 1_024
#: Slack for rounding in the bounds.
SLACK = 1e-9


def k_means(points: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Centroids by Lloyd's rounds from a seeded choice of points."""
    rng = np.random.default_rng(seed)
    centroids = points[rng.choice(len(points), min(k, len(points)), replace=False)]
    for _ in range(ROUNDS):
        nearest = nearest_centroid(points, centroids)[0]
        counts = np.bincount(nearest, minlength=len(centroids))
        sums = np.stack(
            [np.bincount(nearest, points[:, j], len(centroids)) for j in range(points.shape[1])], 1
        )
        used = counts > 0
        centroids = centroids.copy()
        centroids[used] = sums[used] / counts[used, None]
    return centroids


def square_distances(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    dots = points @ centroids.T
    out = (points**2).sum(1)[:, None] - 2 * dots + (centroids**2).sum(1)
    return np.maximum(out, 0.0)


def nearest_centroid(points: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    distances = square_distances(points, centroids)
    nearest = distances.argmin(1)
    return nearest, distances


@dataclass
class Quantiser:
    """Coarse centroids and, per subspace of the residuals, a code book."""

    coarse: np.ndarray
    books: list[np.ndarray]

    @classmethod
    def fit(cls, sample: np.ndarray, lists: int) -> Quantiser:
        coarse = k_means(sample, lists, 1)
        residuals = sample - coarse[nearest_centroid(sample, coarse)[0]]
        cuts = range(0, sample.shape[1], SUBSPACE)
        books = [k_means(residuals[:, at : at + SUBSPACE], CODES, 2 + at) for at in cuts]
        return cls(coarse, books)

    def encode(self, units: np.ndarray, lists: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes and quantisation error of unit vectors in their lists."""
        residuals = units - self.coarse[lists]
        codes = np.empty((len(units), len(self.books)), np.uint8)
        square_error = np.zeros(len(units))
        for i, book in enumerate(self.books):
            part = residuals[:, i * SUBSPACE : (i + 1) * SUBSPACE]
            codes[:, i], _ = nearest_centroid(part, book)
            square_error += ((part - book[codes[:, i]]) ** 2).sum(1)
        return codes, np.sqrt(square_error)

    def probes(self, units: np.ndarray, radius: float, most: int | None) -> list[np.ndarray]:
        """Per vector, the lists that vectors within `radius` may be in, at most the `most` nearest.

        Such a vector lies on the list's side of the plane between the list's
        centroid and the vector's own, so that plane is within the radius.
        """
        own, distances = nearest_centroid(units, self.coarse)
        between = np.sqrt(square_distances(self.coarse, self.coarse))[own]
        least = distances[np.arange(len(units)), own][:, None]
        may = distances - least <= 2 * between * radius + SLACK
        if most is not None and most < len(self.coarse):
            far = np.argpartition(distances, most - 1, axis=1)[:, most:]
            np.put_along_axis(may, far, False, axis=1)
        return [np.nonzero(row)[0].astype(np.int32) for row in may]

    def offsets(self, lists: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Per indexed vector, what its distance to a query has besides the query's tables."""
        out = np.zeros(len(lists))
        for i, book in enumerate(self.books):
            word = book[codes[:, i]]
            centre = self.coarse[lists][:, i * SUBSPACE : (i + 1) * SUBSPACE]
            out += (word**2).sum(1) + 2 * (word * centre).sum(1)
        return out

    def tables(self, units: np.ndarray) -> list[np.ndarray]:
        """Per subspace [query, code], what a code adds to the square distance."""
        cuts = range(0, units.shape[1], SUBSPACE)
        return [
            -2 * (units[:, at : at + SUBSPACE] @ book.T) for at, book in zip(cuts, self.books)
        ]

    def square_table_distances(
        self,
        units: np.ndarray,
        tables: list[np.ndarray],
        lists: np.ndarray,
        codes: np.ndarray,
        offsets: np.ndarray,
    ) -> np.ndarray:
        """[query, indexed vector]: asymmetric distances by table look-ups."""
        met, number = np.unique(lists, return_inverse=True)
        out = square_distances(units, self.coarse[met])[:, number] + offsets
        for i, table in enumerate(tables):
            out += table[:, codes[:, i]]
        return out


@dataclass
class Vectors:
    """Unit vectors of a task with their class, copies, own list and the lists they probe."""

    ids: np.ndarray
    copies: np.ndarray
    lists: np.ndarray
    units: np.ndarray
    probed: np.ndarray

    @classmethod
    def of(cls, rows: pd.DataFrame, n_lists: int) -> Vectors:
        probed = np.zeros((len(rows), n_lists), bool)
        lengths = [len(lists) for lists in rows["probes"]]
        probed[np.repeat(np.arange(len(rows)), lengths), np.concatenate(list(rows["probes"]))] = True
        return cls(
            rows["class"].to_numpy(),
            rows["copies"].to_numpy().astype(np.int64),
            rows["list"].to_numpy(),
            _matrix(rows["unit"]),
            probed,
        )


class Tile:
    """Links between the queries of a block and the vectors of a shard."""

    def __init__(self, model: Quantiser, least_cosine: float, shard: pd.DataFrame):
        self.model, self.least = model, least_cosine
        self.radius = math.sqrt(2 - 2 * least_cosine)
        self.index = index = Vectors.of(shard.sort_values("list", kind="stable"), len(model.coarse))
        self.codes, self.errors = model.encode(index.units, index.lists)
        self.offsets = model.offsets(index.lists, self.codes)
        self.label = np.arange(len(index.ids))

    def links(self, ids, units, tables, own: slice) -> np.ndarray:
        """[query, vector of one list], exact."""
        index = self.index
        wanted = self.model.square_table_distances(
            units, tables, index.lists[own], self.codes[own], self.offsets[own]
        ) <= (self.radius + self.errors[own]) ** 2 + SLACK
        wanted &= ids[:, None] != index.ids[own]
        rows, columns = np.nonzero(wanted)
        exact = np.empty(len(rows), bool)
        for at in range(0, len(rows), SHARD * 16):
            some = slice(at, at + SHARD * 16)
            exact[some] = (
                np.einsum("ij,ij->i", units[rows[some]], index.units[own][columns[some]]) >= self.least
            )
        linked = np.zeros_like(wanted)
        linked[rows[exact], columns[exact]] = True
        return linked

    def results(self, asked: Vectors) -> Iterator[tuple[int, int, int]]:
        """(class, linked vectors, tied to class): edges that keep what links connect.

        Labels spread to the smallest linked vector of the list; an edge is
        given for every query and for every change of a label, not for every
        link. A link whose other vector does not probe the query's list counts
        there too.
        """
        index = self.index
        names, first = np.unique(index.lists, return_index=True)
        ends = [*first[1:], len(index.ids)]
        for at in range(0, len(asked.ids), AT_ONCE):
            some = slice(at, at + AT_ONCE)
            tables = self.model.tables(asked.units[some])
            for name, start, end in zip(names, first, ends):
                at_list = np.nonzero(asked.probed[some, name])[0]
                own = slice(int(start), int(end))
                if len(at_list):
                    yield from self._of_list(asked, at + at_list, [t[at_list] for t in tables], own)

    def _of_list(self, asked: Vectors, which: np.ndarray, tables, own: slice):
        index = self.index
        linked = self.links(asked.ids[which], asked.units[which], tables, own)
        rows, columns = np.nonzero(linked.any(1))[0], np.nonzero(linked.any(0))[0]
        if not len(rows):
            return
        inside, which, columns = linked[np.ix_(rows, columns)], which[rows], columns + own.start
        counts = inside @ index.copies[columns]
        one_sided = inside & ~index.probed[np.ix_(columns, asked.lists[which])].T
        back = asked.copies[which] @ one_sided
        before, far = self.label[columns], len(index.ids)
        label = before.copy()
        while True:
            least = np.where(inside, label, far).min(1)
            new = np.minimum(label, np.where(inside, least[:, None], far).min(0))
            if (new == label).all():
                break
            label = new
        self.label[columns] = label
        for row, count, tie in zip(which, counts, least):
            yield int(asked.ids[row]), int(count), int(index.ids[tie])
        for column in np.nonzero(back)[0]:
            own_id = int(index.ids[columns[column]])
            yield own_id, int(back[column]), own_id
        for old, new in set(zip(before.tolist(), label.tolist())):
            if old != new:
                yield int(index.ids[old]), 0, int(index.ids[new])


def _matrix(column) -> np.ndarray:
    values = list(column)
    return np.frombuffer(b"".join(values), np.float64).reshape(len(values), -1)


def distinct_vectors(embeddings: DataFrame) -> DataFrame:
    """(label, embedding, least_id, copies): equal vectors of a label are one."""
    usable = embeddings.where(
        F.col("label").isNotNull()
        & F.col("embedding").isNotNull()
        & F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
        & F.exists("embedding", lambda x: x != 0)
    )
    return usable.groupBy("label", "embedding").agg(
        F.min("vec_id").alias("least_id"), F.count(F.lit(1)).alias("copies")
    )


def _fitted(classes: DataFrame) -> dict[int, Quantiser]:
    """A quantiser per number of components, from the sample with the smallest hashes."""
    sizes = classes.groupBy(F.size("embedding").alias("dims")).count().collect()
    models = {}
    for dims, n in sizes:
        sample = (
            classes.where(F.size("embedding") == dims)
            .orderBy(F.xxhash64("embedding"), "class")
            .limit(FIT_SAMPLE)
            .select("embedding")
            .toArrow()
        )
        flat = sample.column(0).combine_chunks().flatten().to_numpy(zero_copy_only=False)
        points = flat.astype(np.float64).reshape(-1, dims)
        points /= np.linalg.norm(points, axis=1, keepdims=True)
        lists = int(min(MOST_LISTS, max(LEAST_LISTS, math.sqrt(n))))
        models[dims] = Quantiser.fit(points, lists)
    return models


def _indexed(
    classes: DataFrame, models: dict[int, Quantiser], radius: float, most: Callable[[int], int | None]
) -> DataFrame:
    """Adds dims, list, the lists to probe (`most` of so many) and the unit vector as bytes."""
    n_probes = {dims: most(len(model.coarse)) for dims, model in models.items()}

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column("embedding").to_pylist()
            units = [np.array(vector, np.float64) for vector in vectors]
            units = [unit / np.linalg.norm(unit) for unit in units]
            lists = np.zeros(len(units), np.int32)
            dims = np.array([len(unit) for unit in units], np.int32)
            probes: list = [None] * len(units)
            for size in set(dims.tolist()):
                at, model = np.nonzero(dims == size)[0], models[size]
                some = np.stack([units[i] for i in at])
                lists[at] = nearest_centroid(some, model.coarse)[0]
                for i, found in zip(at, model.probes(some, radius, n_probes[size])):
                    probes[i] = found
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("class"),
                    batch.column("label").cast(pa.int64()),
                    batch.column("copies"),
                    pa.array(dims),
                    pa.array(lists),
                    pa.array(probes, pa.list_(pa.int32())),
                    pa.array([unit.tobytes() for unit in units], pa.binary()),
                ],
                names=["class", "label", "copies", "dims", "list", "probes", "unit"],
            )

    schema = "class long, label long, copies long, dims int, list int, probes array<int>, unit binary"
    return classes.select("class", "label", "copies", "embedding").mapInArrow(work, schema)


def _sharded(index: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """The index with `shard`, SHARD rows in order of lists, and per list its shards and size."""
    salts = min(4096, max(8, n // SHARD))
    group = ["label", "dims"]
    salted = index.withColumn("salt", F.pmod(F.xxhash64("class"), F.lit(salts)))
    counts = salted.groupBy(*group, "list", "salt").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy(*group).orderBy("list", "salt")
    starts = counts.select(
        *group,
        "list",
        "salt",
        "n",
        (F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("start"),
    )
    inside = F.row_number().over(Window.partitionBy(*group, "list", "salt").orderBy("class")) - 1
    shards = (
        salted.withColumn("inside", inside)
        .join(starts.drop("n"), [*group, "list", "salt"])
        .withColumn("shard", F.floor((F.col("start") + F.col("inside")) / SHARD))
        .select(*index.columns, "shard")
    )
    ranges = starts.groupBy(*group, "list").agg(
        F.floor(F.min("start") / SHARD).alias("first"),
        F.floor(F.max(F.col("start") + F.col("n") - 1) / SHARD).alias("last"),
        F.sum("n").alias("n"),
    )
    return shards, ranges


def _queries(index: DataFrame, ranges: DataFrame) -> DataFrame:
    """A row per query and shard that holds a list it must probe."""
    group = ["label", "dims"]
    blocks = ranges.groupBy(*group).agg(F.ceil(F.sum("n") / BLOCK).alias("blocks"))
    dealt = index.join(blocks, group).withColumn(
        "block", F.pmod(F.xxhash64("class"), F.col("blocks"))
    )
    copied = ranges.join(blocks, group).withColumn(
        "block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    )

    def work(key, asked: pd.DataFrame, lists: pd.DataFrame) -> pd.DataFrame:
        n_lists = 1 + max(int(lists["list"].max()), max(int(max(p)) for p in asked["probes"]))
        held = np.zeros((n_lists, int(lists["last"].max()) + 1), np.float32)
        for name, first, last in zip(lists["list"], lists["first"], lists["last"]):
            held[name, first : last + 1] = 1
        probed = Vectors.of(asked, n_lists).probed
        at, shard = np.nonzero(probed.astype(np.float32) @ held)
        return asked[["label", "dims", *columns]].iloc[at].assign(shard=shard)

    keys, columns = [*group, "block"], ["class", "copies", "list", "probes", "unit"]
    return (
        dealt.select(*keys, *columns)
        .groupBy(*keys)
        .cogroup(copied.select(*keys, "list", "first", "last").groupBy(*keys))
        .applyInPandas(
            work,
            "label long, dims int, class long, copies long, list int, probes array<int>, unit binary, shard long",
        )
    )


def near_vectors(
    embeddings: DataFrame,
    least_cosine: float = 0.93,
    least_probes: int = LEAST_PROBES,
    probe_share: float = PROBE_SHARE,
    exact: bool = False,
) -> DataFrame:
    """vec_id, n_links, component_id and kept for every row of `embeddings`.

    Two vectors are linked if their labels are equal and not null, they have as
    many components and their cosine in double precision is at least
    `least_cosine`. A pair is looked at if one of the two probes the other's
    list: the `least_probes` nearest lists, or `probe_share` of all lists if that is
    more; with `exact` every list that a link may reach. Vectors that are null, zero or hold null or non-finite
    components have no links. n_links counts other rows linked directly;
    component_id is the smallest vec_id reachable by links; kept says whether
    it is the row's own. Every row is a vector, also one that repeats a vec_id;
    rows without a vec_id count as links but never name a component that has
    another name. No rows give no rows; other columns are not read.

    Copies are one class in the search, so a vector that a third of all rows
    share is compared once. Shards and blocks bound a task to SHARD + BLOCK
    vectors; what leaves it are counts and spanning edges, not links.
    """
    spark = embeddings.sparkSession
    importable(spark)
    scratch = Scratch(spark, "vectors")
    rows = embeddings.select("vec_id", F.col("label").cast("long").alias("label"), "embedding")
    classes = scratch.write(
        distinct_vectors(rows).withColumn("class", F.monotonically_increasing_id()), "classes"
    )
    models = _fitted(classes)
    radius = math.sqrt(2 - 2 * least_cosine)

    def most(n_lists: int) -> int | None:
        return None if exact else max(least_probes, math.ceil(probe_share * n_lists))

    index = scratch.write(_indexed(classes, models, radius, most), "index")
    shards, ranges = _sharded(index, index.count())
    ranges = scratch.write(ranges, "ranges")
    queries = scratch.write(_queries(index, ranges), "queries")
    tile = ["label", "dims", "shard"]
    blocks = queries.groupBy(*tile).agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"))
    dealt = queries.join(blocks, tile).withColumn(
        "block", F.pmod(F.xxhash64("class"), F.col("blocks"))
    )
    copied = shards.join(blocks, tile).withColumn(
        "block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    )

    def search(key, asked: pd.DataFrame, shard: pd.DataFrame) -> pd.DataFrame:
        if not len(asked) or not len(shard):
            return pd.DataFrame({"class": [], "links": [], "tie": []}, dtype="int64")
        model = models[int(key[1])]
        made = list(Tile(model, least_cosine, shard).results(Vectors.of(asked, len(model.coarse))))
        return pd.DataFrame(made, columns=["class", "links", "tie"], dtype="int64")

    keys, columns = [*tile, "block"], ["class", "copies", "list", "probes", "unit"]
    found = scratch.write(
        dealt.select(*keys, *columns)
        .groupBy(*keys)
        .cogroup(copied.select(*keys, *columns).groupBy(*keys))
        .applyInPandas(search, "class long, links long, tie long"),
        "found",
    )
    scratch.drop("queries")
    links = found.groupBy("class").agg(F.sum("links").alias("links"))
    tied = components(
        found.select(F.col("class").alias("a"), F.col("tie").alias("b")), scratch, "tied"
    ).withColumnRenamed("node", "class")
    placed = (
        classes.join(tied, "class", "left")
        .join(links, "class", "left")
        .select(
            "label",
            "embedding",
            F.coalesce("component", "class").alias("component"),
            "least_id",
            (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
        )
    )
    names = placed.groupBy("component").agg(F.min("least_id").alias("component_id"))
    named = placed.join(names, "component").select("label", "embedding", "n_links", "component_id")
    return (
        rows.join(named, ["label", "embedding"], "left")
        .withColumn("component_id", F.coalesce("component_id", "vec_id"))
        .select(
            "vec_id",
            F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
            "component_id",
            F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"),
        )
    )
