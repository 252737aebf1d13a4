"""Ids against the tiktoken library, and back to the bytes."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from drillbook.llm import byte_pairs as bp
from drillbook.llm.shared import read
from tests.llm import frames

FILES = ["byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"]


def library(path):
    return tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bp.read_ranks(path), special_tokens={}
    )


@pytest.fixture(scope="module")
def coder():
    return bp.BytePairs(bp.read_ranks(public_tokenizers.path(FILES[0])), public_tokenizers.PATTERN)


def numbers(ids):
    return np.frombuffer(ids, "<u4").tolist()


def odd_texts(seed=1):
    rng = random.Random(seed)
    letters = "ab eé漢\U0001f600'\n\t\r 0123<|>_-=#\x00\x1ć"
    made = ["".join(rng.choice(letters) for _ in range(rng.randrange(120))) for _ in range(300)]
    return made + ["", " ", "\n \n", "don't we'll", "<|endoftext|>", "x" * 5000, "ab" * 3000, "=" * 700, "漢" * 900]


@pytest.mark.parametrize("file", FILES)
def test_ids_of_the_library(file):
    path = public_tokenizers.path(file)
    coder, known = bp.BytePairs(bp.read_ranks(path), public_tokenizers.PATTERN), library(path)
    texts = odd_texts()
    assert [numbers(ids) for ids in coder.encode(texts)] == [known.encode_ordinary(text) for text in texts]


@pytest.mark.parametrize("length", [2, 3, 4, 5, 8, 9, 16, 17, 33, 63, 64])
def test_trees_in_one_array_and_trees_of_their_own_agree(coder, length):
    rng = random.Random(length)
    pieces = [bytes(rng.choice(b"abcdeth \xc3\xa9\xff") for _ in range(length)) for _ in range(50)]
    assert coder.merge_short(pieces) == [coder.merge_long(piece) for piece in pieces]
    assert coder.merge_short(pieces)[7:8] == coder.merge_short(pieces[7:8])


def test_lowest_rank_then_leftmost():
    """A vocabulary in which order decides: equal pairs overlap and a higher rank lies first."""
    ranks = {bytes([byte]): byte for byte in range(256)} | {b"bc": 256, b"ab": 257, b"aa": 258, b"aaa": 259}
    coder = bp.BytePairs(ranks, r"[\s\S]+")
    spelled = {rank: token for token, rank in ranks.items()}
    for text, want in [("abc", [b"a", b"bc"]), ("aaaa", [b"aa", b"aa"]), ("aaaaa", [b"aa", b"aaa"]), ("aab", [b"a", b"ab"])]:
        for merge in (lambda piece: coder.merge_short([piece])[0], coder.merge_long):
            assert [spelled[i] for i in numbers(merge(text.encode()))] == want


def test_a_whole_token_wins_over_its_merges():
    ranks = {bytes([byte]): byte for byte in range(256)} | {b"abc": 256}
    coder = bp.BytePairs(ranks, r"\w+")
    assert [numbers(ids) for ids in coder.encode(["abc abcd"])] == [[256, 97, 98, 99, 100]]


def test_what_a_worker_keeps_is_bounded(coder):
    rng = random.Random(4)
    texts = [" ".join(f"{rng.getrandbits(90):x}" for _ in range(400)) for _ in range(60)]
    small = bp.BytePairs(coder.ranks, public_tokenizers.PATTERN)
    small.room = 40_000
    limit, bp.KEPT_BYTES = bp.KEPT_BYTES, 80_000
    try:
        for at in range(0, 60, 4):
            assert small.encode(texts[at : at + 4]) == coder.encode(texts[at : at + 4])
            assert len(small.young) < 4000 and len(small.old) < 4000
        small.encode(["y" * 100_000] * 3)
        assert all(len(piece) <= bp.SHORT for piece in small.young)
    finally:
        bp.KEPT_BYTES = limit


def test_decoding_any_ids(coder):
    rng = np.random.default_rng(1)
    ids = rng.integers(0, 50_256, 2_000)
    spelled, ends = coder.decode(ids)
    known = library(public_tokenizers.path(FILES[0]))
    assert spelled.tobytes() == known.decode_bytes(ids.tolist()) and ends[-1] == len(spelled)
    spelled, ends = coder.decode(np.array([-1, 64, 10_000_000]))
    assert spelled.tobytes() == known.decode_bytes([64]) and ends.tolist() == [0, len(spelled), len(spelled)]
    assert coder.decode(np.array([], np.int64))[0].tobytes() == b""


def want_of(rows):
    known = library(public_tokenizers.path(FILES[0]))
    made = []
    for doc_id, text in rows:
        ids = known.encode_ordinary(text or "")
        made.append(
            (
                doc_id,
                len(ids),
                hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
                hashlib.sha256((text or "").encode()).hexdigest(),
            )
        )
    return sorted(made, key=repr)


def test_documents_with_awkward_rows(spark):
    rows = frames.awkward()
    docs = frames.with_clashing(frames.documents(spark, rows))
    found = bp.digests(bp.encode_documents(docs))
    assert found.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert sorted(map(tuple, found.collect()), key=repr) == want_of([row[:2] for row in rows])
    assert bp.digests(bp.encode_documents(docs.limit(0))).count() == 0


def test_null_and_unknown_ids_have_no_bytes(spark):
    rows = spark.createDataFrame([(1, None), (2, []), (3, [64, 99_999_999, 65])], "doc_id long, ids array<int>")
    found = {row["doc_id"]: bytes(row["decoded"]) for row in bp.decode_documents(rows).collect()}
    known = library(public_tokenizers.path(FILES[0]))
    assert found == {1: b"", 2: b"", 3: known.decode_bytes([64, 65])}


def test_query_equals_the_library_on_the_whole_table(spark):
    from drillbook.llm.queries import QUERIES

    folder = "/root/testdata/sf0.001"
    rows = [(row["doc_id"], row["text"]) for row in read(spark, folder, "documents").collect()]
    found = sorted(map(tuple, QUERIES["op12_byte_pairs"](spark, folder).collect()), key=repr)
    assert found == want_of(rows)
