"""Near-duplicate documents by DartMinHash signatures and banded joining.

Each unit of weight of each element (a shingle, as often as it occurs) is a
region into which hashed darts fall over time; every dart has a coordinate,
and the signature keeps the earliest dart of each. Two weighted sets agree in a
coordinate with the probability of their weighted Jaccard likeness. Only the
first darts are ever looked at, about as many for a long text as for a short
one.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import tied
from .fingerprints import shingle_hashes
from .shared import SLICE_BYTES, SLICE_ROWS, Scratch, importable

#: Bands, and coordinates a band. A pair of likeness 0.8 shares a band with
#: probability 0.99993, one of 0.3 with 0.06.
BANDS, BAND_ROWS = 24, 5
COORDINATES = BANDS * BAND_ROWS
#: The first time step is 2 ** -FINEST long, as is the second; later ones double.
FINEST = 11
#: Texts of a block; a task compares two blocks. Units counted at a time.
BLOCK, UNITS_AT_ONCE = 128, 8_192
#: Rows of a cell that a numbering window holds, about; runs of components in a cell.
RANKED_ROWS, COMPONENT_RUNS = 4_000, 16

_U = np.uint64


def _mix(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> _U(27))) * _U(0x94D049BB133111EB)
    return values ^ (values >> _U(31))


def _uniform(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> _U(11)).astype(np.float64) * 2.0**-53


def _poisson_steps(rate: float) -> np.ndarray:
    """Distribution function of the number of darts, up to rounding."""
    term, total, steps, n = math.exp(-rate), 0.0, [], 0
    while total < 1 - 1e-15 and n < 20 * rate + 40:
        total += term
        steps.append(total)
        n += 1
        term *= rate / n
    return np.array(steps)


def regions(elements: np.ndarray) -> np.ndarray:
    """A hash per unit of weight: the c-th occurrence of an element is its c-th unit."""
    if not len(elements):
        return elements.astype(np.uint64)
    ordered = np.sort(elements)
    fresh = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    first = np.maximum.accumulate(np.where(fresh, np.arange(len(ordered)), 0))
    unit = (np.arange(len(ordered)) - first).astype(np.uint64)
    return _mix(ordered.astype(np.uint64) + unit * _U(0x9E3779B97F4A7C15))


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """[set, coordinate]: hash of the earliest dart, from element hashes with repeats.

    Time goes on in steps for the sets that still lack a coordinate. A set
    without elements has a row of zeros.
    """
    flat = np.concatenate([regions(elements) for elements in sets] or [np.empty(0, np.uint64)])
    owner = np.repeat(np.arange(len(sets)), [len(elements) for elements in sets])
    best = np.zeros((len(sets), COORDINATES), np.uint64)
    filled = np.zeros(len(sets) * COORDINATES, bool)
    step, start = 0, 0.0
    while len(flat):
        length = 2.0 ** (max(step, 1) - 1 - FINEST)
        steps = _poisson_steps(COORDINATES * length)
        seeds = _mix(flat + _U((step + 1) * 0xD1342543DE82EF95 & 0xFFFFFFFFFFFFFFFF))
        chance = _uniform(seeds)
        hit = np.nonzero(chance >= steps[0])[0]
        darts = np.searchsorted(steps, chance[hit], side="right")
        at = np.repeat(hit, darts)
        number = np.arange(len(at)) - np.repeat(np.cumsum(darts) - darts, darts)
        first = _mix(seeds[at] + (number.astype(np.uint64) + _U(1)) * _U(0xA24BAED4963EE407))
        second = _mix(first + _U(0x9FB21C651E98DF25))
        cell = owner[at] * COORDINATES + (second % _U(COORDINATES)).astype(np.int64)
        usable = ~filled[cell]
        cell, time, name = cell[usable], start + length * _uniform(first[usable]), second[usable]
        order = np.lexsort((name, time, cell))
        cell, name = cell[order], name[order]
        earliest = np.concatenate([[True], cell[1:] != cell[:-1]]) if len(cell) else np.empty(0, bool)
        best.reshape(-1)[cell[earliest]] = name[earliest]
        filled[cell[earliest]] = True
        start, step = start + length, step + 1
        lacking = ~filled.reshape(best.shape).all(1)
        going = lacking[owner]
        flat, owner = flat[going], owner[going]
    return best


def band_hashes(best: np.ndarray) -> np.ndarray:
    """[set, band]: hash of the band's number and coordinates, as signed."""
    out = np.tile(np.arange(BANDS, dtype=np.uint64) + _U(1), (len(best), 1))
    grouped = best.reshape(len(best), BANDS, BAND_ROWS)
    for i in range(BAND_ROWS):
        out = _mix(out * _U(0x9E3779B97F4A7C15) + grouped[:, :, i])
    return out.view(np.int64)


def likeness(one: np.ndarray, other: np.ndarray) -> float:
    """Weighted Jaccard of two arrays of region hashes: common units over all."""
    common = len(np.intersect1d(one, other, assume_unique=True))
    total = len(one) + len(other) - common
    return common / total if total else 1.0


def text_key(text: str) -> bytes:
    return hashlib.md5(text.encode("utf-8", "surrogatepass")).digest()


def _signed(documents: DataFrame) -> DataFrame:
    """(doc_id, key, bands) per row; no bands for a text without words."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            share = SLICE_BYTES / max(1, batch.nbytes)
            size = max(1, min(SLICE_ROWS, int(batch.num_rows * share)))
            for start in range(0, batch.num_rows, size):
                piece = batch.slice(start, size)
                texts = [text or "" for text in piece.column("text").to_pylist()]
                sets = [shingle_hashes(text) for text in texts]
                bands = band_hashes(signatures(sets))
                yield pa.RecordBatch.from_arrays(
                    [
                        piece.column("doc_id"),
                        pa.array([text_key(text) for text in texts], pa.binary()),
                        pa.array([b if len(s) else [] for b, s in zip(bands, sets)], pa.list_(pa.int64())),
                    ],
                    names=["doc_id", "key", "bands"],
                )

    importable(documents.sparkSession)
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(work, "doc_id long, key binary, bands array<long>")


def linked_pairs(units: list[np.ndarray], sides: np.ndarray, least: float) -> np.ndarray:
    """Index pairs of a tile, one of either side, whose region sets are alike enough.

    Common units are counted by products of 0/1 matrices over the units that
    both sides have, some thousand at a time. If only one side is there, its
    texts are compared with each other.
    """
    across = sides.min() < sides.max()
    left = np.nonzero(sides == sides.min())[0]
    right = np.nonzero(sides > sides.min())[0] if across else left

    def owners(side: np.ndarray) -> np.ndarray:
        return np.repeat(np.arange(len(side)), [len(units[i]) for i in side])

    names, column, held = np.unique(
        np.concatenate([units[i] for i in left]), return_inverse=True, return_counts=True
    )
    ends = [(owners(left), column)]
    shared = held > 1
    if across:
        others = np.concatenate([units[i] for i in right])
        at = np.searchsorted(names, others)
        known = at < len(names)
        known[known] = names[at[known]] == others[known]
        ends.append((owners(right)[known], at[known]))
        shared = np.bincount(at[known], minlength=len(names)) > 0
    number = np.cumsum(shared) - 1
    for i, (owner, column) in enumerate(ends):
        owner, column = owner[shared[column]], number[column[shared[column]]]
        order = np.argsort(column, kind="stable")
        ends[i] = owner[order], column[order]
    common = np.zeros((len(left), len(right)), np.float32)
    total = int(shared.sum())
    for start in range(0, total, UNITS_AT_ONCE):
        width = min(UNITS_AT_ONCE, total - start)
        parts = []
        for (owner, column), side in zip(ends, (left, right)):
            low, high = np.searchsorted(column, [start, start + width])
            part = np.zeros((len(side), width), np.float32)
            part[owner[low:high], column[low:high] - start] = 1
            parts.append(part)
        common += parts[0] @ parts[-1].T
    sizes = np.array([len(one) for one in units], np.float64)
    alike = common >= least * (sizes[left][:, None] + sizes[right] - common) - 1e-9
    if not across:
        alike = np.triu(alike, 1)
    found = np.argwhere(alike)
    return np.stack([left[found[:, 0]], right[found[:, 1]]], axis=1)


def _compared(tiles: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """Edges (a, b) that connect what the links of each tile connect, compared exactly.

    `tiles` has rows of (tile, side, key, component), at most 2 * BLOCK a tile.
    Only links between different components matter, and of these a tile hands
    on which smallest component each other one is tied to.
    """

    def work(rows: pa.Table) -> pa.Table:
        units = [regions(shingle_hashes(text)) for text in rows["text"].to_pylist()]
        of_rows = rows["component"].to_pylist()
        names = sorted(set(of_rows))
        root = list(range(len(names)))
        place = {name: i for i, name in enumerate(names)}
        member = [place[name] for name in of_rows]

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for i, j in linked_pairs(units, rows["side"].to_numpy(), least).tolist():
            one, other = find(member[i]), find(member[j])
            root[max(one, other)] = min(one, other)
        edges = [(name, names[find(i)]) for i, name in enumerate(names) if root[i] != i]
        return pa.table(
            {"a": pa.array([a for a, _ in edges], pa.binary()), "b": pa.array([b for _, b in edges], pa.binary())}
        )

    shipped = tiles.join(texts, "key").select("tile", "side", "component", "text")
    return shipped.groupBy("tile").applyInArrow(work, "a binary, b binary")


def _stars(members: DataFrame) -> DataFrame:
    """Tiles of each bucket's first text with the others, BLOCK of them at a time."""
    pairs = members.where("hub != key").select("hub", "key").distinct()
    sizes = pairs.groupBy("hub").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"))
    dealt = pairs.join(sizes, "hub").select(
        F.struct("hub", F.pmod(F.xxhash64("key"), F.col("blocks")).alias("block")).alias("tile"),
        F.lit(1).alias("side"),
        "key",
    )
    heads = sizes.select("hub", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block")).select(
        F.struct("hub", "block").alias("tile"), F.lit(0).alias("side"), F.col("hub").alias("key")
    )
    return dealt.unionByName(heads).withColumn("component", F.col("key"))


def _cells(mixed: DataFrame, groups: DataFrame, scratch: Scratch) -> DataFrame:
    """(cell, key, component): the groups of texts that must still meet each other.

    `groups` has (key, group_key) for all texts but the one that names the group.
    A cell is all of a candidate group, or each of its buckets alone where that
    takes fewer rows. The choices are a row per group; they are written, so
    that Spark knows their size before it deals out the rows of a large group.
    """
    rows = F.col("n") * (F.col("n") / BLOCK + 1)
    whole = groups.groupBy("group_key").agg((F.count(F.lit(1)) + 1).alias("n")).select(
        "group_key", rows.alias("together")
    )
    apart = (
        mixed.groupBy("bucket", "hub").agg(F.count(F.lit(1)).alias("n"))
        .join(groups.withColumnRenamed("key", "hub"), "hub", "left")
        .groupBy(F.coalesce("group_key", "hub").alias("group_key")).agg(F.sum(rows).alias("apart"))
    )
    chosen = scratch.write(
        whole.join(apart, "group_key").select(
            "group_key", (F.col("together") <= F.col("apart")).alias("whole")
        ),
        "choices",
    )
    cell = F.struct("group_key", F.when(~F.col("whole"), F.col("bucket")).alias("bucket"))
    return (
        mixed.join(groups, "key", "left")
        .withColumn("group_key", F.coalesce("group_key", "key"))
        .join(chosen, "group_key")
        .select(cell.alias("cell"), "key", "component")
        .distinct()
    )


def _in_blocks(cells: DataFrame, n_rows: int) -> DataFrame:
    """Adds `block`: the rows of a cell numbered by component, BLOCK at a time.

    Numbers count within runs of a cell, which are dealt by hashes of component
    and key, and go on from the sizes of the runs before; so no window holds a
    large cell, or a large component of one.
    """
    pieces = min(256, max(8, n_rows // RANKED_ROWS))
    run = F.struct(
        F.pmod(F.xxhash64("component"), F.lit(COMPONENT_RUNS)).alias("of_component"),
        F.pmod(F.xxhash64("key"), F.lit(pieces)).alias("of_key"),
    )
    dealt = cells.withColumn("run", run)
    counts = dealt.groupBy("cell", "run").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("cell").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("cell", "run", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = F.row_number().over(Window.partitionBy("cell", "run").orderBy("component", "key")) - 1
    return (
        dealt.withColumn("inside", inside)
        .join(starts, ["cell", "run"])
        .select(*cells.columns, F.floor((F.col("start") + F.col("inside")) / BLOCK).alias("block"))
    )


def _pairwise(cells: DataFrame, n_rows: int) -> DataFrame:
    """Tiles of every two blocks of a cell, but for those within one component.

    `n_rows` bounds the rows of all cells; more of them than needed cost nothing.
    Rows are mostly ordered by component, so that most blocks of a large
    component hold nothing else and need not meet.
    """
    placed = _in_blocks(cells, n_rows)
    blocks = (
        placed.groupBy("cell", "block")
        .agg(F.min("component").alias("low"), F.max("component").alias("high"))
        .groupBy("cell")
        .agg(F.collect_list(F.struct("block", "low", "high")).alias("blocks"))
    )
    own = F.element_at(F.filter("blocks", lambda other: other["block"] == F.col("block")), 1)
    meets = F.filter(
        "blocks",
        lambda other: (other["low"] != other["high"])
        | (F.col("own.low") != F.col("own.high"))
        | (other["low"] != F.col("own.low")),
    )
    low, high = F.least("block", "other.block"), F.greatest("block", "other.block")
    return (
        placed.join(blocks, "cell")
        .withColumn("own", own)
        .select("cell", "block", "key", "component", F.explode(meets).alias("other"))
        .select(
            F.struct("cell", low.alias("low"), high.alias("high")).alias("tile"),
            F.when(F.col("block") == low, 0).otherwise(1).alias("side"),
            "key",
            "component",
        )
    )


def _members(signed: DataFrame, scratch: Scratch) -> DataFrame:
    """(bucket, key, hub) of buckets that hold several texts; a text is there once however often it occurs.

    `hub` is the bucket's first text.
    """
    rows = signed.groupBy("key").agg(F.max("bands").alias("bands")).select(
        "key", F.explode("bands").alias("bucket")
    )
    rows = scratch.write(rows, "bucket_rows")
    shared = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("hub")).where("n > 1")
    members = scratch.write(
        rows.join(shared.drop("n"), "bucket").select("bucket", "key", "hub"), "members"
    )
    scratch.drop("bucket_rows")
    return members


def near_classes(documents: DataFrame, least: float = 0.8) -> DataFrame:
    """(doc_id, key, class_id, kept) per row: classes of near-duplicate texts.

    Texts are linked if they share a band and the weighted Jaccard likeness of
    their five-word shingles, compared exactly, is at least `least`; equal texts
    are linked. A class is what links connect; class_id is its smallest doc_id
    (null only if no document of the class has one) and `kept` marks the
    document that stays. Null texts count as empty; texts without words are
    alike only to equal ones; one with fewer than five words has one shingle.
    Rows that repeat doc_id and text are both marked.

    Every text of a bucket meets the bucket's first one. Where a bucket then
    still holds several classes, the texts of its candidate group meet in tiles
    of two blocks, but for blocks of one class. So a group of any number of
    copies costs a comparison per copy and bucket, no pair across classes is
    left out, and a task holds two blocks at most.
    """
    spark = documents.sparkSession
    scratch = Scratch(spark, "near")
    signed = scratch.write(_signed(documents), "signed")
    members = _members(signed, scratch)
    keys = members.select("key").distinct()
    texts = documents.select(
        F.unhex(F.md5(F.coalesce("text", F.lit("")))).alias("key"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    once = texts.groupBy("key").agg(F.min("text").alias("text"))
    texts = scratch.write(once.join(keys, "key", "left_semi"), "texts")
    links = scratch.write(_compared(_stars(members), texts, least), "links")
    star_classes = tied(links, scratch, "stars").withColumnRenamed("node", "key")
    classed = members.join(star_classes, "key", "left").withColumn(
        "component", F.coalesce("component", "key")
    )
    several = (
        classed.groupBy("bucket")
        .agg(F.min("component").alias("low"), F.max("component").alias("high"))
        .where("low != high")
    )
    mixed = scratch.write(
        classed.join(several.select("bucket"), "bucket").select("bucket", "hub", "key", "component"),
        "mixed",
    )
    all_classes = star_classes
    n_mixed = mixed.count()
    if n_mixed:
        stars = mixed.where("hub != key").select(F.col("hub").alias("a"), F.col("key").alias("b")).distinct()
        groups = tied(stars, scratch, "groups").toDF("key", "group_key")
        tiles = _pairwise(_cells(mixed, groups, scratch), n_mixed)
        more = scratch.write(_compared(tiles, texts, least), "more_links")
        edges = star_classes.toDF("a", "b").unionByName(more)
        all_classes = tied(edges, scratch, "all").withColumnRenamed("node", "key")
    classes = signed.select("doc_id", "key").join(all_classes, "key", "left").withColumn(
        "component", F.coalesce("component", "key")
    )
    named = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "key")
    heads = scratch.write(classes.groupBy("component").agg(F.min(named).alias("head")), "heads")
    return classes.join(heads, "component").select(
        "doc_id",
        "key",
        F.col("head.doc_id").alias("class_id"),
        (F.col("doc_id").eqNullSafe(F.col("head.doc_id")) & (F.col("key") == F.col("head.key"))).alias("kept"),
    )


def drop_near_dups(documents: DataFrame, least: float = 0.8) -> DataFrame:
    """One document of each class of `near_classes`, all columns as they came.

    Of rows that repeat doc_id and text one stays.
    """
    spark = documents.sparkSession
    scratch = Scratch(spark, "near-kept")
    stays = scratch.write(
        near_classes(documents, least)
        .where("kept")
        .groupBy(F.col("doc_id").alias("stays_id"), F.col("key").alias("stays_key"))
        .agg(F.count(F.lit(1)).alias("times")),
        "stays",
    )
    key = F.unhex(F.md5(F.coalesce("text", F.lit(""))))
    rows = documents.select(
        F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("own_id"), key.alias("own_key")
    )

    def chosen(some: DataFrame) -> DataFrame:
        return rows.join(
            some, (rows["own_key"] == some["stays_key"]) & rows["own_id"].eqNullSafe(some["stays_id"])
        )

    result = chosen(stays.where("times = 1")).select("row.*")
    repeated = stays.where("times > 1")
    if not repeated.isEmpty():
        once = chosen(repeated).dropDuplicates(["own_id", "own_key"]).select("row.*")
        result = result.unionByName(once)
    return result
