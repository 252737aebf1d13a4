"""Byte-level pair encoding, and decoding, by segment trees over the bytes of a piece.

The leaves of a tree hold the rank of the token that a live position would make
with its live neighbour, joined with the position, so a node's minimum is the
lowest rank and, of equal ones, the leftmost. A merge takes the root, clears one
leaf, ranks two others anew and mends three paths to the root.

Short pieces are many and alike: their trees are rows of one array, and a step
makes one merge in each of them. Long ones get a tree of their own.
"""

from __future__ import annotations

import base64
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from .shared import hold, map_slices

#: Bytes up to which pieces share an array of trees, and pieces in one array.
SHORT, TREES = 64, 4096
#: Rank of a pair that is no token.
NONE = 1 << 40
#: Bytes of pieces and their ids that a worker keeps, about, and of text it takes at a time.
KEPT_BYTES, TEXT_BYTES = 64_000_000, 2_000_000


def read_ranks(path: str) -> dict[bytes, int]:
    """Tokens and ranks of a file with a base64 token and a rank per line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, lines))}


class BytePairs:
    """Encoder and decoder of one vocabulary; a token's id is its rank."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.bytes = np.array([ranks[bytes([byte])] for byte in range(256)], np.int64)
        pairs = {-1: NONE}  # never asked for; the table is never empty
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = rank
        self.pairs = np.array(sorted(pairs), np.int64)
        self.made = np.array([pairs[pair] for pair in self.pairs.tolist()], np.int64)
        spelled = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            spelled[rank] = token
        self.sizes = np.array([len(token) for token in spelled], np.int32)
        self.starts = (np.cumsum(self.sizes) - self.sizes).astype(np.int32)
        self.spelled = np.frombuffer(b"".join(spelled), np.uint8)
        #: Ids of pieces by their text, the recently used ones and those before.
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.room = KEPT_BYTES // 2

    def _pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        wanted = left << 32 | right
        at = np.minimum(np.searchsorted(self.pairs, wanted), len(self.pairs) - 1)
        return np.where(self.pairs[at] == wanted, self.made[at], NONE)

    def merge_short(self, pieces: list[bytes]) -> list[bytes]:
        """Ids, as little-endian unsigned 32-bit numbers, of pieces of at most SHORT bytes."""
        lengths = np.array([len(piece) for piece in pieces], np.int64)
        width = 1 << max(1, int(lengths.max() - 1).bit_length())
        rows, places = np.arange(len(pieces)), np.arange(width)
        inside = places < lengths[:, None]
        token = np.zeros((len(pieces), width + 1), np.int64)
        token[:, :-1][inside] = self.bytes[np.frombuffer(b"".join(pieces), np.uint8)]
        after = np.tile(np.arange(1, width + 2), (len(pieces), 1))
        before = after - 2
        bits = width.bit_length() - 1
        nothing = NONE << bits
        tree = np.full((len(pieces), 2 * width), nothing, np.int64)
        joined = places < lengths[:, None] - 1
        both = self._pair_ranks(token[:, :-1][joined], token[:, 1:][joined])
        tree[:, width:][joined] = (both << bits) + np.broadcast_to(places, joined.shape)[joined]
        half = width
        while half > 1:
            half >>= 1
            np.minimum(tree[:, 2 * half : 4 * half : 2], tree[:, 2 * half + 1 : 4 * half : 2], out=tree[:, half : 2 * half])
        rows = rows[tree[:, 1] < nothing]
        while len(rows):
            lowest = tree[rows, 1]
            here = lowest & (width - 1)
            gone = after[rows, here]
            beyond = after[rows, gone]
            last = beyond >= lengths[rows]
            token[rows, here] = lowest >> bits
            inside[rows, gone] = False
            after[rows, here] = beyond
            before[rows, np.where(last, width, beyond)] = here
            ahead = before[rows, here]
            first = ahead < 0
            ahead = np.where(first, here, ahead)
            ranks = self._pair_ranks(
                np.concatenate([token[rows, here], token[rows, ahead]]),
                np.concatenate([token[rows, np.where(last, width, beyond)], token[rows, here]]),
            )
            right = np.where(last, nothing, (ranks[: len(rows)] << bits) + here)
            left = np.where(first, right, (ranks[len(rows) :] << bits) + ahead)
            tree[rows, width + gone] = nothing
            tree[rows, width + here] = right
            tree[rows, width + ahead] = left
            thrice, node = np.concatenate([rows] * 3), np.concatenate([gone, here, ahead]) + width
            for _ in range(bits):
                node = node >> 1
                tree[thrice, node] = np.minimum(tree[thrice, 2 * node], tree[thrice, 2 * node + 1])
            rows = rows[tree[rows, 1] < nothing]
        ids = token[:, :-1][inside].astype("<u4").tobytes()
        ends = (4 * np.cumsum(inside.sum(axis=1))).tolist()
        return [ids[start:end] for start, end in zip([0, *ends], ends)]

    def merge_long(self, piece: bytes) -> bytes:
        """The same for one piece of any length."""
        n, rank_of = len(piece), self.ranks.get
        bits = max(1, (n - 1).bit_length())
        width = 1 << bits
        mask, nothing = width - 1, NONE << bits
        tree = [nothing] * (2 * width)
        for i in range(n - 1):
            tree[width + i] = (rank_of(piece[i : i + 2], NONE) << bits) + i
        for node in range(width - 1, 0, -1):
            tree[node] = min(tree[2 * node], tree[2 * node + 1])
        after, before = list(range(1, n + 2)), list(range(-1, n + 1))

        def put(place: int, rank: int) -> None:
            node = width + place
            tree[node] = (rank << bits) + place if rank != NONE else nothing
            while node > 1:
                low, node = min(tree[node], tree[node ^ 1]), node >> 1
                if tree[node] == low:
                    return
                tree[node] = low

        while tree[1] < nothing:
            here = tree[1] & mask
            gone = after[here]
            beyond = after[gone]
            after[here] = beyond
            before[beyond] = here
            put(gone, NONE)
            put(here, rank_of(piece[here : after[beyond]], NONE) if beyond < n else NONE)
            ahead = before[here]
            if ahead >= 0:
                put(ahead, rank_of(piece[ahead:beyond], NONE))
        ids, here = [], 0
        while here < n:
            ids.append(self.ranks[piece[here : after[here]]])
            here = after[here]
        return np.array(ids, "<u4").tobytes()

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each piece; one that is a token as a whole is that token."""
        made: list[bytes | None] = [None] * len(pieces)
        waiting: dict[int, list[int]] = {}
        for i, piece in enumerate(pieces):
            rank = self.ranks.get(piece)
            if rank is not None:
                made[i] = rank.to_bytes(4, "little")
            elif len(piece) > SHORT:
                made[i] = self.merge_long(piece)
            else:
                waiting.setdefault((len(piece) - 1).bit_length(), []).append(i)
        for places in waiting.values():
            for start in range(0, len(places), TREES):
                some = places[start : start + TREES]
                for i, ids in zip(some, self.merge_short([pieces[i] for i in some])):
                    made[i] = ids
        return made

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text; the texts' distinct pieces are merged together, once.

        What a worker remembers is bounded in bytes: pieces not met again while
        the younger half filled are forgotten, long ones at once.
        """
        pieces = [self.pattern.findall(text) for text in texts]
        young, old = self.young, self.old
        passing: dict[str, bytes] = {}
        fresh = []
        for piece in set().union(*pieces).difference(young):
            ids = old.get(piece)
            if ids is None:
                fresh.append(piece)
            else:
                young[piece] = ids
                self.room -= 150 + len(ids)
        for piece, ids in zip(fresh, self.merge([piece.encode() for piece in fresh])):
            if len(ids) > 4 * SHORT or len(piece) > SHORT:
                passing[piece] = ids
            else:
                young[piece] = ids
                self.room -= 150 + len(ids)
        young.update(passing)
        made = [b"".join(map(young.__getitem__, some)) for some in pieces]
        for piece in passing:
            del young[piece]
        if self.room < 0:
            self.old, self.young, self.room = young, {}, KEPT_BYTES // 2
        return made

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all tokens in a row, and where each token ends; an unknown id has none."""
        there = (ids >= 0) & (ids < len(self.sizes))
        sizes = self.sizes[ids] if there.all() else np.where(there, self.sizes[np.where(there, ids, 0)], 0)
        ids = ids if there.all() else np.where(there, ids, 0)
        ends = np.cumsum(sizes, dtype=np.int32)
        places = np.repeat(self.starts[ids] - (ends - sizes), sizes)
        places += np.arange(len(places), dtype=np.int32)
        return self.spelled[places], ends


@cache
def _coder(path: str, pattern: str) -> BytePairs:
    return BytePairs(read_ranks(path), pattern)


def _vocabulary(path: str | None, pattern: str | None) -> tuple[str, str]:
    return path or public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern or public_tokenizers.PATTERN


def encode_documents(documents: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id and ids, the token ids of every whole text, without special tokens.

    A null text is an empty one, which has no ids. One row per input row,
    repeated rows and null ids included; other columns are not read. A piece is
    a match of `pattern`; characters that it leaves out are not encoded. The
    file must be at the same path on every machine.
    """
    path, pattern = _vocabulary(path, pattern)

    def work(columns: dict[str, list]) -> dict[str, list]:
        hold(_coder.cache_clear)
        made = _coder(path, pattern).encode([text or "" for text in columns["text"]])
        ends = np.cumsum([0, *[len(ids) // 4 for ids in made]]).astype(np.int32)
        ids = pa.array(np.frombuffer(b"".join(made), "<i4"))
        return {"doc_id": columns["doc_id"], "ids": pa.ListArray.from_arrays(pa.array(ends), ids)}

    rows = documents.select("doc_id", "text")
    return map_slices(rows, work, "doc_id long, ids array<int>", slice_bytes=TEXT_BYTES)


def decode_documents(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """Adds `decoded`, the bytes of the tokens in `ids`; null ids and unknown ones have none."""
    path, pattern = _vocabulary(path, None)
    schema = encoded.select("doc_id", "ids").schema.add("decoded", BinaryType())

    def work(columns: dict[str, pa.Array]) -> dict[str, pa.Array]:
        ids = columns["ids"]
        lengths = ids.value_lengths().fill_null(0).to_numpy()
        flat = ids.flatten().fill_null(-1).to_numpy()
        hold(_coder.cache_clear)
        spelled, ends = _coder(path, pattern).decode(flat)
        ends = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(lengths)])].astype(np.int32)
        buffers = [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(spelled.tobytes())]
        columns["decoded"] = pa.Array.from_buffers(pa.binary(), len(ids), buffers)
        return columns

    rows = encoded.select("doc_id", "ids")
    return map_slices(rows, work, schema, slice_bytes=2 * TEXT_BYTES, as_arrow=True)


def digests(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of encoded documents."""
    decimals = F.array_join(F.col("ids").cast("array<string>"), " ")
    return decode_documents(encoded, path).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(decimals, 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
