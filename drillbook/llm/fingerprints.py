"""Bottom-k sketches of the word shingles of a text: small, mergeable, comparable."""

from __future__ import annotations

import base64
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import hold, importable

#: Words of a shingle, and shingle hashes that a sketch keeps.
SHINGLE_WORDS, SKETCH_SIZE = 5, 128
#: Words whose hashes a worker keeps, and the length up to which it does; it starts anew when
#: they are so many, so it keeps some 80 MB at most.
MEMORY, KEPT_LENGTH = 300_000, 100
#: Bytes of text in a part, about.
PART_BYTES = 32_000_000
_word_hashes: dict[str, int] = {}


def _mixed(values: np.ndarray) -> np.ndarray:
    """Spread bits evenly (the finaliser of splitmix64), then 63 bits as signed."""
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((values ^ (values >> np.uint64(31))) >> np.uint64(1)).astype(np.int64)


def shingle_hashes(text: str, size: int = SHINGLE_WORDS) -> np.ndarray:
    """63-bit hash of each run of `size` words, in order, repeats included.

    Words are parted by white space. A text of fewer words has one shingle of
    all of them, a text without words none.
    """
    words = text.split()
    if not words:
        return np.empty(0, np.int64)
    try:
        hashes = np.fromiter(map(_word_hashes.__getitem__, words), np.uint64, len(words))
    except KeyError:
        hold(_word_hashes.clear)
        if len(_word_hashes) > MEMORY:
            _word_hashes.clear()
        long_words = []
        for word in set(words).difference(_word_hashes):
            _word_hashes[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
            if len(word) > KEPT_LENGTH:
                long_words.append(word)
        hashes = np.fromiter(map(_word_hashes.__getitem__, words), np.uint64, len(words))
        for word in long_words:
            del _word_hashes[word]
    size = min(size, len(words))
    n = len(words) - size + 1
    combined = np.full(n, size, np.uint64)
    for at in range(size):
        combined = combined * np.uint64(0x9E3779B97F4A7C15) + hashes[at : at + n]
    return _mixed(combined)


def sketch(text: str, k: int = SKETCH_SIZE) -> np.ndarray:
    """The k smallest distinct shingle hashes, ascending; all of a shorter text."""
    hashes = shingle_hashes(text)
    if len(hashes) > 8 * k:
        some = np.unique(np.partition(hashes, 4 * k)[: 4 * k])
        if len(some) >= k:
            return some[:k]
    return np.unique(hashes)[:k]


def merge(one: np.ndarray, other: np.ndarray, k: int = SKETCH_SIZE) -> np.ndarray:
    """The sketch of both parts together."""
    return np.union1d(one, other)[:k]


def distinct_shingles(one: np.ndarray, k: int = SKETCH_SIZE) -> float:
    """Estimated number of distinct shingles; exact below k."""
    if len(one) < k:
        return float(len(one))
    return (k - 1) / ((float(one[-1]) + 1) / 2.0**63)


def resemblance(one: np.ndarray, other: np.ndarray, k: int = SKETCH_SIZE) -> float:
    """Estimated Jaccard likeness of two shingle sets, from 0 to 1.

    The share of the k smallest hashes of the union that both have. Two empty
    sets are alike (1), an empty and another one are not (0).
    """
    union = merge(one, other, k)
    if not len(union):
        return 1.0
    both = np.intersect1d(one, other, assume_unique=True)
    return float(np.isin(union, both, assume_unique=True).sum()) / len(union)


def containment(one: np.ndarray, other: np.ndarray, k: int = SKETCH_SIZE) -> float:
    """Estimated share of the first set's shingles that the other has; 1 if it is empty."""
    own = distinct_shingles(one, k)
    if not own:
        return 1.0
    union = distinct_shingles(merge(one, other, k), k)
    return min(1.0, resemblance(one, other, k) * union / own)


def encoded(one: np.ndarray) -> str:
    return base64.b64encode(one.astype("<i8").tobytes()).decode()


def decoded(fingerprint: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(fingerprint), "<i8").astype(np.int64)


def merged_sketches(hashes: DataFrame, keys: list[str], k: int = SKETCH_SIZE) -> DataFrame:
    """Sketch per key from rows of (keys, hash): `sketch`, the k smallest hashes.

    Ranks are limited in every task before the shuffle, so a key with a third
    of all rows sends k of them per task.
    """
    order = Window.partitionBy(*keys).orderBy("hash")
    return (
        hashes.withColumn("rank", F.dense_rank().over(order))
        .where(F.col("rank") <= k)
        .groupBy(*keys)
        .agg(F.sort_array(F.collect_set("hash")).alias("sketch"))
    )


def edited_text(text: str, following: str) -> str:
    """The last quarter of the code points replaced by the first as many of the next text."""
    cut = len(text) // 4
    return text[: len(text) - cut] + following[:cut]


_SCHEMA = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, "
    "edited_fingerprint string, near_edited double, near_next double, "
    "n_shingles double, containment_next double"
)


def _in_order(rows: DataFrame) -> DataFrame:
    """(part, guest, doc_id, text) in ascending order of doc_id within each part.

    Parts are ranges of doc_id between quantiles, as many as texts of PART_BYTES
    make, so each is of bounded size and known without a shuffle; a part is a
    partition. The first document of the next part comes along as a guest, that
    of the first part to the last one; so every row's successor is in its
    partition and texts are shuffled once.
    """
    n_bytes = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n_parts = max(n_parts, math.ceil(n_bytes / PART_BYTES))
    shares = [i / n_parts for i in range(1, n_parts)]
    found = rows.approxQuantile("doc_id", shares, min(0.001, 0.2 / n_parts)) if shares else []
    bounds = np.array(sorted(set(found)), np.float64)

    @F.pandas_udf("int")
    def place(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, ids.to_numpy(np.float64), side="right"))

    part = F.when(F.col("doc_id").isNull(), len(bounds) + 1).otherwise(place("doc_id"))
    parted = rows.select(part.alias("part"), F.lit(False).alias("guest"), "doc_id", "text")
    order = Window.orderBy("part")  # over one row per part
    last = F.max("part").over(Window.partitionBy())
    heads = (
        parted.groupBy(F.col("part").alias("of"))
        .agg(F.min("doc_id").alias("head"))
        .withColumn("part", F.col("of"))
        .select("of", "head", F.coalesce(F.lag("part").over(order), last).alias("target"))
    )
    is_head = (F.col("part") == F.col("of")) & F.col("doc_id").eqNullSafe(F.col("head"))
    guests = (
        parted.join(F.broadcast(heads), is_head)
        .groupBy(F.col("target").alias("part"), "doc_id")
        .agg(F.min("text").alias("text"))
        .select("part", F.lit(True).alias("guest"), "doc_id", "text")
    )
    return (
        parted.unionByName(guests)
        .repartitionById(len(bounds) + 2, F.col("part"))
        .sortWithinPartitions("part", "guest", F.asc_nulls_last("doc_id"), "text")
    )


def fingerprint_documents(documents: DataFrame) -> DataFrame:
    """Fingerprints of every whole text and of its edited text.

    Returns doc_id, n_chars (code points), edited_sha256, fingerprint and
    edited_fingerprint (the sketch in base 64), near_edited and near_next
    (resemblance to the edited text's and to the next document's sketch). The
    next document is the one with the next doc_id; after the last comes the
    first, so a lone document follows itself. Null texts count as empty; rows
    that repeat a doc_id follow each other by text; rows without one come last,
    by text, in one part. No rows give no rows; other columns are not read.
    Besides, n_shingles and containment_next estimate the number of distinct
    shingles and the share of them that the next document has.
    """
    rows = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    importable(rows.sparkSession)
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint"]
    names += ["near_edited", "near_next", "n_shingles", "containment_next"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None
        for batch in batches:
            made: dict[str, list] = {name: [] for name in names}
            for part, guest, doc_id, text in zip(*(batch.column(i) for i in range(4))):
                text = text.as_py()
                own = sketch(text)
                if before is not None:
                    id_, old, old_sketch = before
                    edited = edited_text(old, text)
                    new_sketch = sketch(edited)
                    digest = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
                    values = (id_, len(old), digest, encoded(old_sketch), encoded(new_sketch))
                    values += (resemblance(old_sketch, new_sketch), resemblance(old_sketch, own))
                    values += (distinct_shingles(old_sketch), containment(old_sketch, own))
                    for name, value in zip(names, values):
                        made[name].append(value)
                before = None if guest.as_py() else (doc_id.as_py(), text, own)
            arrays = {
                name: pa.array(
                    column,
                    pa.int64() if i < 2 else pa.string() if i < 5 else pa.float64(),
                )
                for i, (name, column) in enumerate(made.items())
            }
            yield pa.RecordBatch.from_pydict(arrays)

    return _in_order(rows).mapInArrow(work, _SCHEMA)
