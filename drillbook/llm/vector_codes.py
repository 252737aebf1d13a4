"""Vector codes by Lloyd's rounds over cover trees.

Vectors are whole numbers cut into equal parts. Each block of vectors of a
partition gets, once, a cover tree per part position: parts in farthest-first
order, each under the nearest one of the levels above, so that a node of level l
has everything below it within 2**(l+1). The parts are kept in the order of the
tree, where every subtree is a run and its sum a difference of two cumulative
sums.

A round sends the codebooks, whose size is fixed, to the trees. A node goes to
its nearest entry with everything below it if, by the triangle inequality, no
part within its radius can be as near to another entry; other nodes hand the
question down. Parts that are reached are compared exactly. Only sums per entry
leave a task.
"""

from __future__ import annotations

import hashlib
import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructType

from .shared import Scratch, importable

#: Vectors of a block, which has one tree per part position.
BLOCK = 512
#: Components are cut to this size, so that no square or sum leaves 64 bits.
LARGEST = 1 << 26
#: Share of the rows above which a label is met apart; there are at most so many of these.
HEAVY = 64
#: What rounding may add to a distance made of a square root, relative and absolute.
SLACK, LEAST = 1e-9, 1e-3


class CoverTree:
    """The tree of some points, one per row, with whole coordinates.

    `order` lists the points so that node v covers those from `start[v]` to
    `end[v]`; its own point is at `start[v]`, and `radius2[v]` is the largest
    squared distance from it. The first nodes are single points, the last is
    the root.
    """

    ARRAYS = ("order", "points", "start", "end", "radius2", "children", "child_start", "child_end")

    def __init__(self, points: np.ndarray):
        n = len(points)
        parent, level = self._farthest_first(points)
        top, below = list(range(n)), {}
        pairs = np.unique(np.stack([level[parent >= 0], parent[parent >= 0]], axis=1), axis=0)
        by_pair: dict[tuple[int, int], list[int]] = {}
        for child in np.nonzero(parent >= 0)[0].tolist():
            by_pair.setdefault((int(level[child]), int(parent[child])), []).append(child)
        for node, pair in enumerate(map(tuple, pairs.tolist()), n):
            below[node] = [top[pair[1]], *[top[child] for child in by_pair[pair]]]
            top[pair[1]] = node
        nodes = n + len(pairs)
        self.start, self.end = np.zeros(nodes, np.int32), np.zeros(nodes, np.int32)
        order, waiting = [], [nodes - 1]
        while waiting:
            node = waiting.pop()
            self.start[node] = len(order)
            if node < n:
                order.append(node)
            else:
                waiting += reversed(below[node])
        self.order = np.array(order, np.int32)
        self.points = points[self.order].astype(np.int32)
        self.end[:n] = self.start[:n] + 1
        self.radius2 = np.zeros(nodes, np.int64)
        for node in range(n, nodes):
            self.end[node] = self.end[below[node][-1]]
            run = points[self.order[self.start[node] : self.end[node]]]
            self.radius2[node] = _squares(run - run[0]).max()
        self.children = np.array([child for node in range(n, nodes) for child in below[node]], np.int32)
        counts = [0] * n + [len(below[node]) for node in range(n, nodes)]
        self.child_end = np.cumsum(counts).astype(np.int32)
        self.child_start = (self.child_end - counts).astype(np.int32)
        self._sum_up()

    @staticmethod
    def _farthest_first(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Parent and level of each point; the first is the root, copies have level -1."""
        n = len(points)
        parent, level = np.full(n, -1), np.full(n, -1)
        gap, owner = _squares(points - points[0]), np.zeros(n, np.int64)
        above, last = owner, None
        for _ in range(n - 1):
            far = int(gap.argmax())
            if gap[far] == 0:
                break
            level[far] = (int(gap[far]).bit_length() - 1) // 2
            if level[far] != last:
                above, last = owner.copy(), level[far]
            parent[far] = above[far]
            found = _squares(points - points[far])
            closer = found < gap
            gap[closer] = found[closer]
            owner[closer] = far
        copies = (parent < 0) & (np.arange(n) > 0)
        parent[copies] = owner[copies]
        return parent, level

    def _sum_up(self) -> None:
        self.sums = np.zeros((len(self.points) + 1, self.points.shape[1]), np.int64)
        np.cumsum(self.points, axis=0, dtype=np.int64, out=self.sums[1:])

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, **{name: getattr(self, name) for name in self.ARRAYS})
        return out.getvalue()

    @classmethod
    def load(cls, dumped: bytes) -> CoverTree:
        tree = cls.__new__(cls)
        with np.load(io.BytesIO(dumped)) as arrays:
            for name in cls.ARRAYS:
                setattr(tree, name, arrays[name])
        tree._sum_up()
        return tree

    def assign(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """Runs (start, end, entry) that cover all points, and the number of nodes compared.

        Ties go to the first entry. An entry that repeats an earlier one never wins.
        """
        repeated = np.array([(entries[:i] == entry).all(axis=1).any() for i, entry in enumerate(entries)])
        runs, compared = [], 0
        nodes = np.array([len(self.start) - 1])
        while len(nodes):
            compared += len(nodes)
            here = self.points[self.start[nodes]].astype(np.int64)
            found = np.stack([_squares(here - entry) for entry in entries], axis=1)
            found[:, repeated] = np.iinfo(np.int64).max
            best = found.argmin(axis=1)
            if len(entries) > 1:
                two = np.sqrt(np.partition(found, 1, axis=1)[:, :2].astype(np.float64))
                reach = 2 * np.sqrt(self.radius2[nodes].astype(np.float64)) + two[:, 1] * SLACK + LEAST
                sure = (self.radius2[nodes] == 0) | (two[:, 1] - two[:, 0] > reach)
            else:
                sure = np.ones(len(nodes), bool)
            decided = nodes[sure]
            runs.append((self.start[decided], self.end[decided], best[sure]))
            opened = nodes[~sure]
            counts = self.child_end[opened] - self.child_start[opened]
            ends = np.cumsum(counts)
            places = np.arange(ends[-1] if len(ends) else 0)
            nodes = self.children[places + np.repeat(self.child_start[opened] - (ends - counts), counts)]
        start, end, entry = (np.concatenate(column) for column in zip(*runs))
        return start, end, entry, compared

    def entry_of_each(self, entries: np.ndarray) -> np.ndarray:
        """The nearest entry of each point, in the points' first order."""
        start, end, entry, _ = self.assign(entries)
        by_place = np.argsort(start)
        found = np.empty(len(self.order), np.int64)
        found[self.order] = np.repeat(entry[by_place], (end - start)[by_place])
        return found


def _squares(rows: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", rows, rows)


def _table(book: list[list[int]]) -> np.ndarray:
    return np.array(book, np.int64).reshape(len(book), len(book[0]) if book else 0)


def whole_numbers(column: pa.Array, scale: int, width: int) -> np.ndarray:
    """floor(scale * x) of every component, one row per vector, zeros behind short ones."""
    made = np.zeros((len(column), width), np.int64)
    lengths = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    values = np.clip(np.floor(np.clip(values, -LARGEST, LARGEST) * scale), -LARGEST, LARGEST)
    made[np.arange(width) < lengths[:, None]] = values.astype(np.int64)
    return made


def kept_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id, label and embedding of the rows whose vector is whole and finite."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.select("vec_id", "label", "embedding").where(F.col("embedding").isNotNull() & finite)


def plant_trees(kept: DataFrame, scratch: Scratch, parts: int, scale: int, width: int) -> DataFrame:
    """A row per block of vectors: their ids, labels and one dumped tree per part, written once."""
    importable(kept.sparkSession)
    types = {field.name: field.dataType for field in kept.schema.fields}
    schema = StructType()
    for name in ("vec_id", "label"):
        schema = schema.add(name, ArrayType(types[name]))
    schema = schema.add("trees", ArrayType(BinaryType()))
    arrow = to_arrow_schema(schema)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                some = batch.slice(at, BLOCK)
                numbers = whole_numbers(some.column("embedding"), scale, width)
                trees = [CoverTree(part).dump() for part in np.split(numbers, parts, axis=1)]
                row = {
                    "vec_id": [some.column("vec_id").to_pylist()],
                    "label": [some.column("label").to_pylist()],
                    "trees": [trees],
                }
                yield pa.RecordBatch.from_pydict(row, schema=arrow)

    return scratch.write(kept.mapInArrow(blocks, schema), "trees")


def entry_sums(trees: DataFrame, codebooks: list[list[list[int]]]) -> list[Row]:
    """(position, entry, i, total): sums per component of the parts of each entry; i = -1 counts them.

    A task sends one row per entry and component, so what reaches the driver is
    bounded by the codebooks.
    """
    schema = "position int, entry int, i int, total long"
    fields = trees.sparkSession.createDataFrame([], schema).schema
    arrow = to_arrow_schema(fields)
    books = list(map(_table, codebooks))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = [np.zeros((len(book), book.shape[1] + 1), np.int64) for book in books]
        for batch in batches:
            for row in batch.column("trees"):
                for tree, book, total in zip(row, books, totals):
                    tree = CoverTree.load(tree.as_py())
                    start, end, entry, _ = tree.assign(book)
                    np.add.at(total[:, 1:], entry, tree.sums[end] - tree.sums[start])
                    np.add.at(total[:, 0], entry, end - start)
        made = {"position": [], "entry": [], "i": [], "total": []}
        for position, total in enumerate(totals):
            for entry, component in zip(*np.nonzero(total)):
                made["position"].append(position)
                made["entry"].append(int(entry))
                made["i"].append(int(component) - 1)
                made["total"].append(int(total[entry, component]))
        yield pa.RecordBatch.from_pydict(made, schema=arrow)

    found = trees.select("trees").mapInArrow(sums, fields)
    return found.groupBy("position", "entry", "i").agg(F.sum("total").alias("total")).collect()


def next_codebooks(codebooks: list[list[list[int]]], sums: list[Row]) -> list[list[list[int]]]:
    """Each used entry at the floor of its parts' mean; unused ones stay."""
    total = {(row["position"], row["entry"], row["i"]): row["total"] for row in sums}
    return [
        [
            [total.get((p, e, i), 0) // total[p, e, -1] for i in range(len(entry))]
            if (p, e, -1) in total
            else entry
            for e, entry in enumerate(book)
        ]
        for p, book in enumerate(codebooks)
    ]


def encode(trees: DataFrame, codebooks: list[list[list[int]]]) -> DataFrame:
    """vec_id, label, code (two hex digits per part) and error of every vector in the trees."""
    types = {field.name: field.dataType.elementType for field in trees.schema.fields}
    schema = StructType().add("vec_id", types["vec_id"]).add("label", types["label"])
    schema = schema.add("code", "string").add("error", LongType())
    arrow = to_arrow_schema(schema)
    books = list(map(_table, codebooks))

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                entries, error = [], 0
                for tree, book in zip(row["trees"], books):
                    tree = CoverTree.load(tree)
                    entry = tree.entry_of_each(book)
                    points = np.empty(tree.points.shape, np.int64)
                    points[tree.order] = tree.points
                    error = error + _squares(points - book[entry])
                    entries.append(entry.astype(np.uint8))
                code = [some.tobytes().hex() for some in np.stack(entries, axis=1)]
                made = {"vec_id": row["vec_id"], "label": row["label"], "code": code, "error": error.tolist()}
                yield pa.RecordBatch.from_pydict(made, schema=arrow)

    return trees.mapInArrow(codes, schema)


def with_label_error(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """Adds the sum of `error` over equal labels, nulls together.

    A label with more than a share of the rows meets them by broadcast; there
    are at most HEAVY of these. The others meet in a join none of whose keys is
    larger than that share.
    """
    labels = rows.groupBy("label").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("n"))
    labels = scratch.write(labels, "labels")
    n_rows = labels.agg(F.sum("n")).first()[0] or 0
    labels = labels.withColumnRenamed("label", "of_label")
    is_heavy = F.col("n") * HEAVY > n_rows
    met = F.col("label").eqNullSafe(F.col("of_label"))
    heavy = F.broadcast(labels.where(is_heavy))
    columns = [*rows.columns, "label_error"]
    return (
        rows.join(heavy, met)
        .select(*columns)
        .unionByName(rows.join(heavy, met, "left_anti").join(labels.where(~is_heavy), met).select(*columns))
    )


def codebooks_sha256(codebooks: list[list[list[int]]]) -> str:
    flat = ",".join(str(x) for book in codebooks for entry in book for x in entry)
    return hashlib.sha256(flat.encode()).hexdigest()


def compress(
    vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096
) -> tuple[DataFrame, list[list[list[int]]]]:
    """Codes of all vectors, and the codebooks by part position, entry and component.

    The rows have vec_id, label, code, error and label_error. Rows whose vector
    is null or holds null or non-finite components are dropped. Vectors shorter
    than the longest, and a length that `parts` doesn't divide, are filled up
    with zeros; an empty vector is all zeros. Components beyond 2**26 after
    scaling count as that. Rows may repeat a vec_id or have none; the first
    entries are the smallest ids', nulls last, equal ids by vector. With fewer
    rows than entries the codebooks are shorter. Without rows there are no
    codes and the codebooks are empty. Up to 256 entries; other columns are not
    read.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code has two hex digits per part")
    scratch = Scratch(vectors.sparkSession, "codes")
    kept = kept_vectors(vectors)
    longest = kept.agg(F.max(F.size("embedding"))).first()[0] or 0
    width = -(-longest // parts) * parts
    trees = plant_trees(kept, scratch, parts, scale, width)
    first = kept.orderBy(F.asc_nulls_last("vec_id"), "embedding").limit(entries).select("embedding")
    seeds = whole_numbers(pa.array([row[0] for row in first.collect()], pa.list_(pa.float64())), scale, width)
    codebooks = [part.tolist() for part in np.split(seeds, parts, axis=1)]
    for _ in range(rounds if len(seeds) else 0):
        codebooks = next_codebooks(codebooks, entry_sums(trees, codebooks))
    rows = scratch.write(encode(trees, codebooks), "coded")
    return with_label_error(rows, scratch), codebooks
