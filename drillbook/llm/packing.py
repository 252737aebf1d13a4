"""Best-fit packing of tokenised documents into sequences of fixed length.

Documents are cut into pieces of at most the capacity; a full piece is a
sequence. The others are packed in bulk-synchronous rounds: documents and gaps
are sorted by size and ranked within a size, a sweep over the sizes gives each
gap the largest documents not yet taken that fit, ranks decide which rows these
are, all matches of the round are made at once by a join, and the gaps shrink.
Ranks of shrunk gaps follow from the counts that the sweep has.
Sizes are whole numbers up to the capacity, so the sweep sees one row per size,
whatever the number of documents.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections import Counter
from functools import cache

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .shared import Scratch, hold, map_slices

#: Bytes of word parts and their ids that a worker keeps, about, what a part
#: takes besides its ids, and the length from which a part is not kept.
KEPT_BYTES, PART_BYTES, LONG_PART = 128_000_000, 200, 100
#: Bytes of text that a worker takes at a time.
TEXT_BYTES = 4_000_000
#: Rows of one size that a ranking window may hold on average.
RANKED_ROWS = 4_000
#: (size, first rank, documents, gap, first gap rank, documents a gap)
Segment = tuple[int, int, int, int, int, int]
#: (gap, first rank, bins, their new gap, what is added to their ranks)
Move = tuple[int, int, int, int, int]


#: Fixed value: the vocabulary's splitter, for lower-case texts of Latin letters, which
#: are spelled out as ranges and come first, as most parts are letters.
LATIN_PARTS = re.compile(
    "[A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f]+"
    r"|'s|'t|'re|'ve|'m|'ll|'d|\d|(?:[^\w\s]|_)+"
)
#: What that pattern or white space might treat otherwise than the splitter, and
#: the mark of special tokens, sought apart, as one class of characters is faster.
NOT_LATIN = re.compile("[\x1c-\x1f\xb2\xb3\xb9\xbc-\xbe\u0250-\U0010ffff]")
SPECIAL = "<|"
ASCII_SPACE = re.compile("[\x20\x09-\x0d]+")
#: Mark of a word that is encoded whole; no Latin part begins with it.
WHOLE = "\x1c"

#: Fixed rule of byte-level vocabularies: printable bytes stand for themselves,
#: the others, in order, for the characters from U+0100 on.
_PRINTABLE = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
BYTE_LETTERS = {
    byte: 0x100 + i for i, byte in enumerate(b for b in range(256) if b not in _PRINTABLE)
}


class WordIds:
    """Ids of a text as bytes, each distinct part of the texts encoded once.

    The vocabulary never joins what its splitter parts, nor anything across
    white space, so the ids of a text are those of its parts in a row. Words
    beyond Latin letters are encoded whole.

    What a worker remembers is bounded in bytes: parts not met again while the
    younger half filled are forgotten, long ones at once.
    """

    def __init__(self, path: str, kept_bytes: int = KEPT_BYTES):
        self.tokenizer = Tokenizer.from_file(path)
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.half = self.room = kept_bytes // 2

    @staticmethod
    def parts(text: str) -> list[str]:
        """The splitter's parts; a word that needs the tokenizer as a whole is marked."""
        lowered = text.lower()
        if SPECIAL not in lowered and not NOT_LATIN.search(lowered):
            return LATIN_PARTS.findall(lowered)
        found = []
        for word in filter(None, ASCII_SPACE.split(text)):
            lowered = word.lower()
            if SPECIAL in lowered or NOT_LATIN.search(lowered):
                found.append(WHOLE + word)
            else:
                found += LATIN_PARTS.findall(lowered)
        return found

    def _encode(self, parts: list[str]) -> dict[str, bytes]:
        """A part is one unit of the model, so its bytes go there directly.

        Only bytes 0x21 to 0x7E stand for themselves in every part: the model
        has no unknown token and returns nothing for a letter it doesn't have.
        """
        tokenize, made = self.tokenizer.model.tokenize, {}
        for part in parts:
            if part[0] == WHOLE:
                ids = self.tokenizer.encode(part[1:], add_special_tokens=False).ids
            elif part.isascii() and part.isprintable():
                ids = [token.id for token in tokenize(part)]
            else:
                unit = part.encode().decode("latin-1").translate(BYTE_LETTERS)
                ids = [token.id for token in tokenize(unit)]
            made[part] = array("I", ids).tobytes()
        return made

    def many(self, texts: list[str]) -> list[bytes]:
        pieces = [self.parts(text) for text in texts]
        young, old = self.young, self.old
        unseen = set().union(*pieces).difference(young)
        fresh = unseen.difference(old)
        kept = {part: old[part] for part in unseen.difference(fresh)}
        passing = []
        for part, ids in self._encode(list(fresh)).items():
            kept[part] = ids
            if len(part) > LONG_PART:
                passing.append(part)
        young.update(kept)
        found = [b"".join(map(young.__getitem__, some)) for some in pieces]
        for part in passing:
            del young[part]
        self.room -= sum(map(len, kept.values())) + PART_BYTES * len(kept)
        if self.room < 0:
            self.old, self.young, self.room = young, {}, self.half
        return found


@cache
def _word_ids(path: str) -> WordIds:
    return WordIds(path)


def token_pieces(documents: DataFrame, path: str | None = None, capacity: int = 2048) -> DataFrame:
    """Rows of (doc_id, piece, start, length, ids_crc32) over whole texts.

    A document's ids are those of its text by the tokenizer file, without
    special tokens added, and a 0; a null or empty text is the 0 alone.
    """
    path = path or public_tokenizers.path("word_bpe_49k.json")

    def work(columns: dict[str, list]) -> dict[str, list]:
        made = {name: [] for name in ("doc_id", "piece", "start", "length", "ids_crc32")}
        hold(_word_ids.cache_clear)
        ids = _word_ids(path).many([text or "" for text in columns["text"]])
        for doc_id, some in zip(columns["doc_id"], ids):
            some += b"\0\0\0\0"
            for piece, at in enumerate(range(0, len(some), 4 * capacity)):
                part = some[at : at + 4 * capacity]
                made["doc_id"].append(doc_id)
                made["piece"].append(piece)
                made["start"].append(at // 4)
                made["length"].append(len(part) // 4)
                made["ids_crc32"].append(zlib.crc32(part))
        return made

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long"
    return map_slices(documents.select("doc_id", "text"), work, schema, slice_rows=2048, slice_bytes=TEXT_BYTES)


def size_ranks(rows: DataFrame, size: str, id_: str, n_rows: int) -> DataFrame:
    """Adds `rank` from 0 within each size, in no window more than a share of it."""
    salts = min(4096, max(8, n_rows // RANKED_ROWS))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64(id_), F.lit(salts)))
    counts = salted.groupBy(size, "salt").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy(size).orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        size, "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset")
    )
    inside = F.row_number().over(Window.partitionBy(size, "salt").orderBy(id_))
    return (
        salted.withColumn("inside", inside)
        .join(offsets, [size, "salt"])
        .select(*rows.columns, (F.col("offset") + F.col("inside") - 1).alias("rank"))
    )


def sweep(sizes: dict[int, list[int]], gaps: dict[int, int]) -> list[Segment]:
    """Matches of one round, from {size: [next rank, documents]} and {gap: bins}.

    Gaps go from small to large; each takes the largest size that fits and is
    left: one document, or as many as fit if they are less than an eighth of
    it, so that many small ones don't take many rounds. `sizes` is brought up
    to date.
    """
    segments, open_sizes = [], []
    waiting = sorted((size for size in sizes if sizes[size][1]), reverse=True)
    for gap in sorted(gaps):
        while waiting and waiting[-1] <= gap:
            open_sizes.append(waiting.pop())
        bins, rank = gaps[gap], 0
        while bins and open_sizes:
            size = open_sizes[-1]
            first, left = sizes[size]
            per_bin = 1 if 8 * size > gap else gap // size
            taken = min(left, bins * per_bin)
            used = -(-taken // per_bin)
            segments.append((size, first, taken, gap, rank, per_bin))
            sizes[size] = [first + taken, left - taken]
            bins, rank = bins - used, rank + used
            if taken == left:
                open_sizes.pop()
    return segments


def openings(sizes: dict[int, list[int]], capacity: int, first_bin: int) -> list[Segment]:
    """New sequences for the largest documents: as many as the rest needs at least."""
    needed = max(
        sum(n for size, (_, n) in sizes.items() if 2 * size > capacity),
        -(-sum(size * n for size, (_, n) in sizes.items()) // capacity),
    )
    segments = []
    for size in sorted(sizes, reverse=True):
        first, left = sizes[size]
        taken = min(left, needed)
        if taken:
            segments.append((size, first, taken, capacity, first_bin, 1))
            sizes[size] = [first + taken, left - taken]
            needed, first_bin = needed - taken, first_bin + taken
    return segments


def _segment_rows(spark: SparkSession, segments: list[Segment]) -> DataFrame:
    """At most a few rows per size, so they go to every task."""
    schema = "size int, first long, taken long, of_gap int, first_bin long, per_bin int"
    return F.broadcast(spark.createDataFrame(segments, schema))


def _in_segment(rank: str, first: str, n: Column) -> Column:
    return (F.col(rank) >= F.col(first)) & (F.col(rank) < F.col(first) + n)


def moved(segments: list[Segment], gaps: dict[int, int], smallest: int) -> tuple[list[Move], dict[int, int]]:
    """What a round does to the bins, and {gap: bins} after it.

    The bins of a gap are ranked from 0 and a round fills them in order, so the
    ranks after it follow from counts alone. Bins that not even the smallest
    size left fits are given up.
    """
    runs, used = [], Counter()
    for size, _, taken, gap, first, per_bin in segments:
        full, more = divmod(taken, per_bin)
        runs.append((gap, first, full, gap - size * per_bin))
        runs.append((gap, first + full, min(more, 1), gap - size * more))
        used[gap] = first + full + min(more, 1)
    runs += [(gap, used[gap], n - used[gap], gap) for gap, n in gaps.items()]
    moves, after = [], Counter()
    for gap, first, n, new_gap in runs:
        if n and new_gap >= smallest:
            moves.append((gap, first, n, new_gap, after[new_gap] - first))
            after[new_gap] += n
    return moves, dict(after)


def _after_moves(bins: DataFrame, moves: list[Move]) -> DataFrame:
    """(bin, gap, rank) of the bins that stay; there are a few moves per gap, which go to every task."""
    schema = "gap int, first_rank long, n long, new_gap int, shift long"
    table = F.broadcast(bins.sparkSession.createDataFrame(moves, schema))
    return (
        bins.join(table, "gap")
        .where(_in_segment("rank", "first_rank", F.col("n")))
        .select("bin", F.col("new_gap").alias("gap"), (F.col("rank") + F.col("shift")).alias("rank"))
    )


def best_fit_bins(rows: DataFrame, scratch: Scratch, capacity: int) -> DataFrame:
    """(id, bin, offset) for rows of (id, size), 0 < size < capacity.

    Rounds go on until every row has its place, whatever their number.
    """
    spark = rows.sparkSession
    schema = "id long, bin long, offset long"
    counted = {r["size"]: r["n"] for r in rows.groupBy("size").agg(F.count("*").alias("n")).collect()}
    if not counted:
        return spark.createDataFrame([], schema)
    sizes = {size: [0, n] for size, n in counted.items()}
    documents = scratch.write(size_ranks(rows, "size", "id", sum(counted.values())), "ranked")
    gaps, bins, n_bins, rounds = {}, None, 0, 0

    while any(n for _, n in sizes.values()):
        segments = sweep(sizes, gaps)
        opened = not segments
        if opened:
            segments = openings(sizes, capacity, n_bins)
            n_bins += sum(segment[2] for segment in segments)
        table = _segment_rows(spark, segments)
        matched = documents.join(table, "size").where(_in_segment("rank", "first", F.col("taken")))
        turn = F.col("rank") - F.col("first")
        slot = F.col("first_bin") + F.floor(turn / F.col("per_bin"))
        offset = (
            F.lit(capacity) - F.col("of_gap") + F.pmod(turn, F.col("per_bin")) * F.col("size")
        ).cast("long")
        slots = matched.select("id", F.col("of_gap").alias("gap"), slot.alias("rank"), offset.alias("offset"))
        if opened:
            made = slots.select("id", F.col("rank").alias("bin"), "offset")
        else:
            made = slots.join(bins, ["gap", "rank"]).select("id", "bin", "offset")
        made = scratch.write(made, f"placed/round={rounds}")
        if opened:
            fresh = made.select("bin", F.lit(capacity).alias("gap"), F.col("bin").alias("rank"))
            bins = fresh if bins is None else bins.unionByName(fresh)
        smallest = min((size for size, (_, n) in sizes.items() if n), default=capacity)
        moves, gaps = moved(segments, gaps, smallest)
        bins = scratch.write(_after_moves(bins, moves), f"bins-{rounds}") if gaps else None
        scratch.drop(f"bins-{rounds - 1}")
        rounds += 1
    return scratch.read("placed", schema).select("id", "bin", "offset")


def pack(documents: DataFrame, path: str | None = None, capacity: int = 2048) -> DataFrame:
    """Pieces of all documents with the place of each.

    Returns doc_id, piece, start, length, ids_crc32, sequence_id and offset.
    Null texts count as empty; rows that repeat a doc_id, or have none, are
    documents of their own; without rows the result is empty; other columns
    are not read. Sequence ids are unique, in no order.
    """
    spark = documents.sparkSession
    scratch = Scratch(spark, "pack")
    pieces = scratch.write(
        token_pieces(documents, path, capacity).withColumn("id", F.monotonically_increasing_id()),
        "pieces",
    )
    rest = pieces.where(F.col("length") < capacity).select("id", F.col("length").cast("int").alias("size"))
    bins = best_fit_bins(rest, scratch, capacity)
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    whole = pieces.where(F.col("length") == capacity).select(
        *columns, (-1 - F.col("id")).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    placed = pieces.where(F.col("length") < capacity).join(bins, "id")
    return whole.unionByName(
        placed.select(*columns, F.col("bin").alias("sequence_id"), "offset")
    )
